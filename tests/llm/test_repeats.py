import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmark.llm import repeats as rp
from tests.llm.helpers import awkward, frame, prose


def _plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raws for i in range(len(x) - length + 1))
    out = []
    for x in raws:
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(x, mark) if not m)
        runs = sum(m and (p == 0 or not mark[p - 1]) for p, m in enumerate(mark))
        out.append((len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _got(spark, texts, **options):
    rows = rp.repeats(frame(spark, texts), **options).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_equal_to_brute_force(spark):
    rnd = random.Random(1)
    passage, long = prose(rnd, 60), prose(rnd, 400)
    texts = awkward(rnd)
    for _ in range(60):
        a = rnd.randrange(len(passage) - 150)
        texts.append(prose(rnd, rnd.randint(0, 60)) + passage[a : a + rnd.randint(150, 320)] + prose(rnd, rnd.randint(0, 60)))
    texts += [long, long[:1000] + "X" + long[1001:], "q" + long[300:900], long[77:277], long[77:276], "ab" * 400, "ba" * 130, long]
    assert _got(spark, texts) == _plain(texts, 200)


def test_blocks_and_shards_do_not_matter(spark, monkeypatch):
    rnd = random.Random(2)
    passage = prose(rnd, 80)
    texts = [prose(rnd, 20) + passage[rnd.randint(0, 40) :] + prose(rnd, 20) for _ in range(30)] + [passage] * 5
    monkeypatch.setattr(rp, "BLOCK_BYTES", 500)
    monkeypatch.setattr(rp, "SHARD_BYTES", 400)
    assert _got(spark, texts, length=60, seed=24) == _plain(texts, 60)


def test_repeated_rows_and_empty_table(spark):
    docs = frame(spark, ["z" + "".join(map(str, range(150)))])
    rows = rp.repeats(docs.unionByName(docs)).collect()
    assert [r.n_removed for r in rows] == [r.n_bytes for r in rows] and len(rows) == 2
    assert rp.repeats(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=60), st.binary(max_size=60), st.integers(12, 40))
def test_equal_windows_parse_alike(middle, a, b, length):
    seed = length // 2

    def windows(raw):
        first, last, at, trigger, _ = rp.parse(raw, length, seed)
        assert list(np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last)])) == list(range(len(raw) - length + 1)) if len(first) else len(raw) < length
        return {raw[i : i + length]: (int(t), int(p - i)) for x, y, p, t in zip(first, last, at, trigger) for i in range(x, y + 1)}

    one, two = windows(a + middle), windows(middle + b)
    for w in set(one) & set(two):
        assert one[w] == two[w]


def test_suffix_order_finds_repeats():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"ab") for _ in range(300))
    phrases = [(text[i : i + 60], 20) for i in (0, 3, 3 + 7)] + [(text[0:60], 20)]
    got = rp.repeated_windows(phrases, 30)
    assert got[0] == got[3] == list(range(0, 21))


def test_null_ids_are_documents_too(spark):
    from pyspark.sql import functions as F

    text = "".join(map(str, range(200)))
    docs = frame(spark, ["a" + text]).unionByName(frame(spark, [text + "b", "short"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = sorted((r.n_bytes, r.n_removed) for r in rp.repeats(docs).collect())
    assert got == [(5, 0), (len(text) + 1, len(text)), (len(text) + 1, len(text))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab\0", min_size=0, max_size=120).map(str.encode) | st.binary(max_size=120), min_size=1, max_size=8), st.integers(8, 24))
def test_order_of_dictionary_and_parse_is_the_order_of_texts(texts, length):
    phrases = [t for t in texts if len(t) >= length]
    if not phrases:
        return
    whole, starts, at = b"".join(phrases), {}, 0
    for p in phrases:
        starts |= {at + i: p[i:] for i in range(len(p) - length + 1)}
        at += len(p)
    order = rp.corpus_order(phrases, np.array([len(p) - length + 1 for p in phrases]))[0].tolist()
    assert sorted(order) == list(starts) and [starts[i] for i in order] == sorted(starts.values())
    count = Counter(t[:length] for t in starts.values())
    got = rp.repeated_windows([(p, len(p)) for p in phrases], length)
    assert got == [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] if len(phrases) > 1 else [] for p in phrases]
    assert whole


def test_hot_triggers_and_long_texts(spark, monkeypatch):
    rnd = random.Random(4)
    passage = prose(rnd, 30)
    texts = [prose(rnd, 12) + passage + prose(rnd, 12) for _ in range(40)] + [prose(rnd, 900) + passage + prose(rnd, 900)] * 2 + ["ab" * 3000 + passage, "c" * 5000]
    texts += awkward(rnd)
    monkeypatch.setattr(rp, "HOT", 3)
    monkeypatch.setattr(rp, "BLOCK_BYTES", 1000)
    assert _got(spark, texts, length=100, seed=40) == _plain(texts, 100)


def test_columns_of_the_same_names(spark):
    docs = frame(spark, ["x" * 300, "y" + "".join(map(str, range(150)))])
    for c in ("n_bytes", "n_removed", "key", "kept", "kind", "row_id", "sha256", "trigger"):
        docs = docs.withColumn(c, docs.doc_id)
    assert sorted((r.n_bytes, r.n_removed) for r in rp.repeats(docs).collect()) == [(300, 300), (341, 0)]
