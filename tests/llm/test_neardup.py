import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from leafmark.llm import neardup
from leafmark.llm.components import components
from tests.llm.helpers import awkward, frame, prose


def _sets(text):
    w = text.lower().encode().split() if text else []
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def _brute(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [_sets(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def _edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 10**6))
    return " ".join(w)


def test_classes_equal_brute_force(spark):
    rnd = random.Random(5)
    base = prose(rnd, 150)
    # a large group of near copies, some only near to others; a passage that many share; and what is unlike all
    texts = [_edited(rnd, base, rnd.randint(0, 5)) for _ in range(120)]
    passage = prose(rnd, 25)
    texts += [passage + " " + prose(rnd, rnd.randint(3, 30)) for _ in range(60)]
    texts += [prose(rnd, rnd.randint(1, 80)) for _ in range(40)] + awkward(rnd)
    order = list(range(len(texts)))
    rnd.shuffle(order)
    texts = [texts[i] for i in order]
    got = {r.doc_id: r for r in neardup.classes(frame(spark, texts)).collect()}
    want = _brute(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].class_size == want.count(want[i]) for i in got)


def test_one_of_each_class_stays(spark):
    rnd = random.Random(6)
    same = prose(rnd, 40)
    docs = frame(spark, [same, same, None, "", prose(rnd, 50)])
    kept = neardup.without_copies(docs.unionByName(docs.where("doc_id = 4")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_empty_table(spark):
    assert neardup.classes(frame(spark, [])).count() == 0


def test_weighted_classes(spark):
    line = "one two three four five six seven "
    texts = [line * 50 + "alpha beta", line * 50 + "gamma delta", "alpha beta gamma delta epsilon zeta"]
    by_count = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts), weight="count").collect()}
    by_set = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
    assert by_count == {0: 0, 1: 0, 2: 2} and by_set == {0: 0, 1: 1, 2: 2}


def test_signatures_estimate_probability_jaccard():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:200], rnd.integers(0, 2**63, 100).astype(np.uint64)]))
    x, y = rnd.integers(1, 9, len(a)), rnd.integers(1, 9, len(b))
    m = 4096
    agree = (neardup.signature(a, x, m) == neardup.signature(b, y, m)).mean()
    assert abs(agree - neardup.similarity(a, x, b, y)) < 0.03
    agree = (neardup.signature(a, None, m) == neardup.signature(b, None, m)).mean()
    assert abs(agree - neardup.similarity(a, None, b, None)) < 0.03


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1), st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1))
def test_similarity_equals_its_definition(a, b):
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b)) for d in set(a) & set(b))
    col = lambda x, t: np.array(x, t)
    ka, kb = sorted(a), sorted(b)
    got = neardup.similarity(col(ka, np.uint64), col([a[k] for k in ka], int), col(kb, np.uint64), col([b[k] for k in kb], int))
    assert abs(got - want) < 1e-9


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)] + [(500, 500 + k) for k in range(1, 30)]
    rnd = random.Random(2)
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 150, 200)} == {100} and {got[500 + k] for k in range(30)} == {500}
    assert 300 not in got


def test_null_ids_are_documents_too(spark):
    rnd = random.Random(8)
    same = prose(rnd, 50)
    near = _edited(rnd, same, 1)
    docs = frame(spark, [same, prose(rnd, 40)]).unionByName(frame(spark, [near, same]).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = sorted((r.doc_id is None, r.class_id, r.class_size) for r in neardup.classes(docs).collect())
    assert got == [(False, 0, 3), (False, 1, 1), (True, 0, 3), (True, 0, 3)]
    assert neardup.without_copies(docs).count() == 4


def test_null_ids_take_part_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(9)
    same, other, alone = prose(rnd, 50), prose(rnd, 60), prose(rnd, 40)
    nulls = [_edited(rnd, same, 1), same, other, other, _edited(rnd, other, 1), alone, None, None, ""]
    docs = frame(spark, [same, prose(rnd, 40), None]).unionByName(frame(spark, nulls).withColumn("doc_id", F.lit(None).cast("bigint")))
    kept = cp.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1, 2]
    left = [r.text for r in rows if r.doc_id is None]
    assert len(left) == 5 and left.count(None) == 2 and {"", alone} < set(left)  # and one of the three like `other`
    assert len({other, nulls[4]} & set(left)) == 1
    # an id beats none, whatever the texts; repeated rows with an id count once
    again = docs.unionByName(docs.where("doc_id = 0"))
    assert sorted(str(r.doc_id) for r in cp.near_duplicates(spark, again, str(tmp_path)).collect()) == ["0", "1", "2", *["None"] * 5]


def _weighted(text):
    w = text.lower().encode().split() if text else []
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def test_weighted_classes_equal_brute_force(spark):
    rnd = random.Random(11)
    base, line = prose(rnd, 90), prose(rnd, 8)
    texts = [_edited(rnd, base, rnd.randint(0, 4)) for _ in range(40)]
    texts += [" ".join([line] * rnd.randint(1, 30) + [prose(rnd, rnd.randint(0, 25))]) for _ in range(50)]
    texts += [" ".join([base] * rnd.randint(1, 3)) + " " + prose(rnd, rnd.randint(0, 30)) for _ in range(30)] + awkward(rnd)
    sets = [_weighted(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = set(a) & set(b)
            if shared and sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in set(a) | set(b)) for d in shared) >= 0.8 - 1e-12:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts), weight="count").collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.integers(1, 9), min_size=1), st.dictionaries(st.integers(0, 12), st.integers(1, 9), min_size=1))
def test_bound_of_the_similarity(a, b):
    p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (a, b))
    exact = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in set(p) | set(q)) for d in set(p) & set(q))
    u, v = sum(x for k, x in p.items() if k not in q), sum(x for k, x in q.items() if k not in p)
    assert exact <= ((1 - u) * (1 - v) / (1 - u * v) if u * v < 1 else 0) + 1e-9


def test_a_family_of_one_template_is_not_paired(spark):
    rnd = random.Random(12)
    template = prose(rnd, 90)
    texts = [template + " " + " ".join(f"own{i}x{k}" for k in range(14)) for i in range(60)]
    docs = frame(spark, texts)
    for weight in ("set", "count"):
        sets = neardup._sets(docs, docs.select(F.xxhash64("text").alias("node"), "doc_id"), "doc_id", "text", 5)
        open_ = docs.select(F.xxhash64("text").alias("node"), F.xxhash64("text").alias("component"))
        assert neardup._cross(neardup._prefixes(open_, sets, 0.8, weight), 0.8).count() == 0
    assert {r.class_size for r in neardup.classes(docs, weight="count").collect()} == {1}


def test_columns_of_the_same_names(spark):
    docs = frame(spark, ["a b c d e f g", "a b c d e f g", "x y z"])
    for c in ("kept", "node", "class_id", "class_size", "component", "keys", "key", "n_shingles", "row_key"):
        docs = docs.withColumn(c, docs.doc_id + 70)
    kept = neardup.without_copies(docs, weight="count")
    assert kept.columns == docs.columns and sorted((r.doc_id, r.kept, r.node) for r in kept.collect()) == [(0, 70, 70), (2, 72, 72)]
    assert neardup.without_copies(docs, null_ids_stay=False).count() == 2


def test_rows_that_repeat(spark):
    docs = frame(spark, ["a b c d e f g h"])
    for _ in range(4):
        docs = docs.unionByName(docs)
    docs = docs.unionByName(frame(spark, ["a b c d e f g h i"], first=5))
    assert {(r.class_id, r.class_size) for r in neardup.classes(docs, threshold=0.75, weight="count").collect()} == {(0, 17)}


def test_many_near_copies_cost_a_few_pairs_each(spark, monkeypatch):
    words, count, n = [f"w{k}" for k in range(200)], [], 300
    docs = frame(spark, [" ".join([*words[:20], f"own{k}", *words[20:]]) for k in range(n)])
    verified = neardup._verified

    def counted(pairs, *more):
        count.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(neardup, "_verified", counted)
    assert {(r.class_id, r.class_size) for r in neardup.classes(docs, weight="count").collect()} == {(0, n)}
    assert sum(count) < 15 * n, count
