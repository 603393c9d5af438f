import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from leafmark.llm import codes
from leafmark.llm.vectors import scaled

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def _plain(rows, parts=16, entries=64, rounds=2):
    """Full sums in each round, part by part."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) if kept else 0
    size = d // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(cut(v, p), b), e) for e, b in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v, _), code in zip(kept, assign()):
            for p in range(parts):
                groups[p, code[p][1]].append(cut(v, p))
        for (p, e), members in groups.items():
            books[p][e] = [sum(m[i] for m in members) // len(members) for i in range(size)]
    out, by_label = [], defaultdict(int)
    for (i, _, label), code in zip(kept, assign()):
        error = sum(f for f, _ in code)
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for _, e in code), error, label))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def _got(spark, rows, **options):
    coded, books = codes.compress(scaled(spark.createDataFrame(rows, SCHEMA).repartition(3), keep=("label",)), **options)
    found = codes.with_label_error(coded).collect()
    return sorted(((r.vec_id, r.code.hex(), r.far, r.label_error, codes.digest(books)) for r in found), key=str)


def _rows(kind, n=300, d=32):
    rnd = np.random.default_rng(len(kind))
    x = rnd.normal(size=(n, d)) / 4
    if kind == "ties":
        x = rnd.integers(-1, 2, size=(n, d)) / 16
    if kind == "copies":
        x[::3] = x[0]
    if kind == "clusters":
        x = x[rnd.integers(0, 12, n)] + 0.02 * x
    return [(int(i), v, None if i % 11 == 0 else int(i % 3 == 0)) for i, v in zip(rnd.permutation(n) * 3, x.tolist())]


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "clusters"])
def test_equals_full_sums(spark, kind):
    rows = _rows(kind)
    assert _got(spark, rows) == _plain(rows)


def test_rounds_entries_and_parts(spark):
    rows = _rows("clusters", 150)
    for options in ({"rounds": 0}, {"rounds": 1}, {"rounds": 6}, {"entries": 3}, {"entries": 256, "parts": 4}, {"parts": 32}):
        assert _got(spark, rows, **options) == _plain(rows, **options)


def test_only_moved_parts_are_shuffled(spark):
    """The second round's differences are those of the parts whose entry changed, and the totals equal full sums."""
    rows = _rows("clusters")
    kept = scaled(spark.createDataFrame(rows, SCHEMA))
    books = codes.first_entries(kept, 32)
    one = codes.assigned(kept, books, 32).cache()
    totals = np.zeros((16, 64, 3), np.int64)
    for r in codes.changes(one, 32, 16, 64).collect():
        totals.reshape(-1)[r.place] += r.change
    two = codes.assigned(one, codes.updated(books, totals), 32).cache()
    moved = {(p, c) for r in two.collect() for p in range(16) for c in (r.old[p], r.code[p]) if r.old[p] != r.code[p]}
    sent = codes.changes(two, 32, 16, 64).collect()
    assert {(r.place // 3 // 64, r.place // 3 % 64) for r in sent} <= moved and len(moved) < 16 * 64
    for r in sent:
        totals.reshape(-1)[r.place] += r.change
    full = np.zeros_like(totals)
    for r in two.collect():
        for p in range(16):
            full[p, r.code[p]] += [*r.v[2 * p : 2 * p + 2], 1]
    assert (full == totals).all()


def test_edge_rows(spark):
    nan = float("nan")
    some = [float(x) / 8 for x in range(16)]
    rows = [(1, some, 1), (1, some, 1), (1, some[::-1], None), (None, some, None), (None, [x + 0.1 for x in some], 1), (4, [nan, *some[1:]], 1), (5, None, 1), (6, [None, *some[1:]], 1), (-3, [-x for x in some], 2)]
    assert _got(spark, rows) == _plain(rows) and len(_got(spark, rows)) == 6
    assert _got(spark, []) == [] and _got(spark, [(1, None, 1)]) == []
    short = _got(spark, [(1, [1.0] * 20, 1), (2, [1.0] * 3, 1)])
    assert short == _plain([(1, [1.0] * 20 + [0.0] * 12, 1), (2, [1.0] * 3 + [0.0] * 29, 1)])


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 500_000.0 + 1000 * i] * 16, 0) for i in range(5)]
    assert _got(spark, rows, entries=2) == _plain(rows, entries=2)
    limited = lambda x: max(-(2.0**19), min(2.0**19, x))
    rows = [(i, [(-1) ** i * 10.0 ** (5 * i)] * 16, 0) for i in range(5)]
    assert _got(spark, rows, entries=2) == _plain([(i, [limited(x) for x in v], k) for i, v, k in rows], entries=2)


def test_columns_of_the_same_names(spark):
    rows = _rows("normal", 100)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS far", "3 AS old", "4 AS v", "5 AS _salt")
    coded, books = codes.compress(scaled(frame, keep=("label",)))
    found = codes.with_label_error(coded).collect()
    assert sorted(((r.vec_id, r.code.hex(), r.far, r.label_error, codes.digest(books)) for r in found), key=str) == _plain(rows)
