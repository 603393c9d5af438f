import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmark.llm import interpolation as lm
from leafmark.llm.common import crc_mod, grouped_rows
from tests.llm.helpers import awkward, frame, prose


def _tokens(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low)) + [None]


def _fold(i):
    return zlib.crc32(str(i).encode()) % 5


def _scores(texts, monkeypatch, spark, **options):
    seen = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda h, *a: seen.setdefault("w", learn(seen.setdefault("h", h), *a)))
    fold = crc_mod("doc_id", 5)
    rows = lm.score(frame(spark, texts), training=fold != 1, deleted=fold == 0, **options).collect()
    return {r.doc_id: r for r in rows}, seen


def _grams(said, wanted):
    """Counts of words, pairs and triples, and of the contexts, of the documents for which wanted holds."""
    count = Counter()
    for i, x in said.items():
        if wanted(i):
            y = ["<s>", "<s>", *x]
            for k in range(len(x)):
                count[(y[k + 2],)] += 1
                count[(y[k + 1], y[k + 2])] += 1
                count[tuple(y[k : k + 3])] += 1
                count["ctx", y[k + 1]] += 1
                count["ctx", y[k], y[k + 1]] += 1
    return count


def _parts(x, count):
    """(c3, n3, c2, n2, c1) of each token."""
    y = ["<s>", "<s>", *x]
    for k in range(len(x)):
        u, v, w = y[k : k + 3]
        # a context is as frequent as the n-gram that ends there: at a document's end it is followed by nothing
        n3 = count["ctx", u, v] if v == "<s>" else count[u, v]
        n2 = count["ctx", v] if v == "<s>" else count[v,]
        yield count[u, v, w], n3, count[v, w], n2, count[w,]


def test_scores_equal_the_definition(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randint(1, 120)) for _ in range(60)] + awkward(rnd) + ["The the THE\x0bthe\x1cx"]
    texts += texts[3:9]
    got, seen = _scores(texts, monkeypatch, spark, block_bytes=20_000, shard_bytes=20_000)
    said = {i: _tokens(t) for i, t in enumerate(texts)}
    count = _grams(said, lambda i: _fold(i) != 1)
    total, kinds = (f(n for k, n in count.items() if len(k) == 1) for f in (sum, lambda x: len(list(x))))
    bucket = lambda n: min(int(math.log2(n + 1)), lm.BUCKETS - 1)
    for i, x in said.items():
        base = sum(math.log10((count[w,] + 0.5) / (total + 0.5 * (kinds + 1))) for w in x)
        score = 0.0
        for c3, n3, c2, n2, c1 in _parts(x, count):
            l3, l2, l1 = seen["w"][bucket(n3)][0], seen["w"][bucket(n2)][1], seen["w"][0][2]
            one = l1 * c1 / total + (1 - l1) / (kinds + 1)
            two = l2 * (c2 / n2 if n2 else 0) + (1 - l2) * one
            score += math.log10(l3 * (c3 / n3 if n3 else 0) + (1 - l3) * two)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (_fold(i) == 1, len(x), sum(count[w,] > 0 for w in x), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_held_out_counts_are_exact(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randint(1, 40)) for _ in range(50)]
    _, seen = _scores(texts, monkeypatch, spark, block_bytes=700, shard_bytes=500)
    said = {i: _tokens(t) for i, t in enumerate(texts)}
    count = _grams(said, lambda i: _fold(i) > 1)
    want = Counter(p for i, x in said.items() if _fold(i) == 0 for p in _parts(x, count))
    have = Counter()
    for r in seen["h"].collect():
        have[r.c3, r.n3, r.c2, r.n2, r.c1] += r.times
        assert (r.b3, r.b2) == (int(math.log2(r.n3 + 1)), int(math.log2(r.n2 + 1)))
    assert have == want


def _held(spark, rows):
    return spark.createDataFrame(rows, "b3 int, b2 int, c3 bigint, n3 bigint, c2 bigint, n2 bigint, c1 bigint, times bigint")


def test_em_equals_plain_rounds_and_raises_the_likelihood(spark):
    rnd = random.Random(0)
    rows = []
    for _ in range(200):
        c3, c2 = rnd.randint(0, 9), rnd.randint(0, 30)
        n3, n2 = (0, rnd.choice([0, 50])) if rnd.random() < 0.3 else (c3 + rnd.randint(1, 20), c2 + rnd.randint(1, 60))
        c3, c2 = c3 if n3 else 0, min(c2, n2)
        rows.append((int(math.log2(n3 + 1)), int(math.log2(n2 + 1)), c3, n3, c2, n2, rnd.randint(0, 90), rnd.randint(1, 40)))
    total, kinds = 5000, 300

    def parts(w, r):
        b3, b2, c3, n3, c2, n2, c1, _ = r
        l3, l2, l1 = w[b3][0], w[b2][1], w[0][2]
        return l3 * (c3 / n3 if n3 else 0), (1 - l3) * l2 * (c2 / n2 if n2 else 0), (1 - l3) * (1 - l2) * l1 * c1 / total, (1 - l3) * (1 - l2) * (1 - l1) / (kinds + 1)

    def likelihood(w):
        return sum(r[-1] * math.log(sum(parts(w, r))) for r in rows)

    w = lm.started().tolist()
    for _ in range(lm.ROUNDS):
        top3, base3, top2, base2, top1, base1 = *(defaultdict(float) for _ in range(4)), 0.0, 0.0
        for r in rows:
            p = parts(w, r)
            e3, e2, e1 = (r[-1] * x / sum(p) for x in p[:3])
            top3[r[0]] += e3
            base3[r[0]] += r[-1]
            top2[r[1]] += e2
            base2[r[1]] += r[-1] - e3
            top1 += e1
            base1 += r[-1] - e3 - e2
        before, w = w, [[(top3[b] / base3[b]) if b in base3 else x[0], (top2[b] / base2[b]) if b in base2 else x[1], top1 / base1] for b, x in enumerate(w)]
        assert likelihood(w) >= likelihood(before) - 1e-9
    got = lm.learn_weights(_held(spark, rows), total, kinds)
    for b in {r[0] for r in rows}:
        assert abs(got[b][0] - w[b][0]) < 5e-3
    for b in {r[1] for r in rows}:
        assert abs(got[b][1] - w[b][1]) < 5e-3
    assert abs(got[0][2] - w[0][2]) < 5e-3 and got[0][0] == got[0][1] == 0
    assert likelihood(got) > likelihood(lm.started())
    none = lm.learn_weights(_held(spark, []), 0, 0)
    assert np.allclose(none, lm.started())


def test_edges(spark):
    fold = crc_mod("doc_id", 5)
    assert lm.score(frame(spark, []), training=fold != 1, deleted=fold == 0).count() == 0
    alone = lm.score(frame(spark, ["a b"]), training=F.lit(False), deleted=F.lit(False)).collect()
    assert alone[0].train_tokens == 0 and alone[0].held_out and alone[0].n_known == 0 and alone[0].score <= 0
    twice = frame(spark, ["a b", "a c"])
    got = lm.score(twice.unionByName(twice), training=F.lit(True), deleted=F.lit(False)).collect()
    assert len(got) == 4 and {r.train_tokens for r in got} == {12}


def test_held_out_beats_the_unigram_base(spark):
    rnd = random.Random(9)
    after = defaultdict(lambda: rnd.sample(range(40), 3))

    def text():
        w, out = 0, []
        for _ in range(80):
            w = rnd.choice(after[w])
            out.append(f"w{w}")
        return " ".join(out)

    fold = crc_mod("doc_id", 5)
    rows = lm.score(frame(spark, [text() for _ in range(150)]), training=fold != 1, deleted=fold == 0).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.6 * sum(r.base_score for r in rows)


def test_columns_of_the_same_names(spark):
    docs = frame(spark, ["a b", "a c"]).selectExpr("*", "1 AS role", "2 AS block", "3 AS blob", "4 AS score", "5 AS kind")
    assert lm.score(docs, training=F.col("doc_id") == 0, deleted=F.lit(False)).count() == 2


def _peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_task_holds_one_block():
    batch = pa.RecordBatch.from_pylist([{"block": k, "blob": bytes(1 << 20)} for k in range(10)])
    assert _peak(lambda: [None for _ in grouped_rows(iter([batch]), "block")]) < 4 << 20  # not all rows of the batch
    texts = [" ".join(f"w{k * j % 997}" for j in range(20_000)) for k in range(1, 21)]
    assert _peak(lambda: lm.Block(texts)) < 110 * 20 * 20_001  # bytes a token
