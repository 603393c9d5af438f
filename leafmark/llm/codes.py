"""Product-quantised vectors whose codebooks come from a Lloyd iteration that is maintained by changes.

Vectors are cut into equal consecutive parts; each position has a codebook of whole numbers. A round assigns all parts to the entries of
the last codebooks and keeps the assignment as a written table, which the next round reads as the previous one. Sums and counts of
the parts of each entry are kept between the rounds as exact running totals. A task compares new and previous assignment of its rows:
a part that stays gives nothing, a part that moved gives its components minus to the old entry and plus to the new one.
Only these differences, added up within the task, are shuffled and added to the totals. In the first round every part is new.
So the bytes that a round shuffles fall with the number of parts that move, and the result equals that of full sums.

The totals are positions x entries x components numbers, which the driver holds (64 x (d + 16) for 16 parts of 64 entries). A task
holds a batch of vectors. Rounds are written tables in the shared folder, so a lost executor costs its tasks only.

Edge cases: vectors that are null or hold null or non-finite components are dropped; components are limited to 2^27 after scaling;
shorter vectors end in zeros, and so do all if the longest does not divide into the parts; the first entries are the vectors of the least
ids, equal ids by their components, null ids last; with fewer vectors than entries the codebooks are smaller; equal entries
keep the lower index; an entry without parts stays; rows that repeat an id are coded each; null labels are a label of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, table, written
from leafmark.llm.vectors import extent, matrix, scaled

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose distances a task holds at a time.
BATCH = 8192
#: Ways to which the rows of a label are dealt for the join with its sum.
SALTS = 32


def first_entries(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks at the start: position, entry, component."""
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).toArrow()["v"]
    x = matrix(pa.concat_arrays(least.chunks) if least.num_chunks else pa.array([], pa.list_(pa.int32())), d)
    return np.ascontiguousarray(x.reshape(len(x), parts, d // parts).transpose(1, 0, 2))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector and position the nearest entry, ties to the lower index, and the squared distance; exact."""
    parts, n, size = books.shape
    code, far = np.empty((len(x), parts), np.uint8 if n <= 256 else np.int64), np.empty((len(x), parts), np.int64)
    pieces = x.reshape(len(x), parts, size)
    largest = int(max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * size * largest**2 < 1 << 53 else np.int64  # such whole numbers are exact as doubles, whose products are faster
    for p in range(parts):
        part, book = pieces[:, p], books[p]
        a, b = part.astype(kind), book.astype(kind)
        distance = (b * b).sum(axis=1) - 2 * (a @ b.T)
        at = distance.argmin(axis=1)
        code[:, p] = at
        far[:, p] = ((part - book[at]) ** 2).sum(axis=1)
    return code, far


def differences(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, totals: np.ndarray, moved: np.ndarray) -> int:
    """Adds what the moved parts change to totals (position, entry, components and, last, count); the number of parts that moved.
    moved marks the entries that got anything."""
    parts, _, size = totals.shape
    pieces, n = x.reshape(len(x), parts, size - 1), 0
    for p in range(parts):
        rows = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        n += len(rows)
        for codes, sign in ((new, 1),) if old is None else ((new, 1), (old, -1)):
            at = codes[rows, p].astype(np.int64)
            np.add.at(totals[p, :, :-1], at, sign * pieces[rows, p])
            np.add.at(totals[p, :, -1], at, sign)
            moved[p, at] = True
    return n


def _coded(batches: Iterator[pa.RecordBatch], d: int, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            x = matrix(column(part, "v"), d)
            yield part, x, *nearest(x, books)


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def assigned(rows: DataFrame, books: np.ndarray, d: int) -> DataFrame:
    """rows with code (a byte for each position) and far (the squared distances, summed); a code of before becomes old."""
    names = [c for c in rows.columns if c not in ("code", "far", "old")]

    def run(batches):
        for part, _, code, far in _coded(batches, d, books):
            before = column(part, "code") if "code" in part.schema.names else pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in names), before, _binary(code), pa.array(far.sum(axis=1))], names=[*names, "old", "code", "far"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{kinds}, old binary, code binary, far bigint")


def changes(coded: DataFrame, d: int, parts: int, entries: int) -> DataFrame:
    """place (position, entry, component or, last, count) and change: the sums of what the parts that moved add and take away."""
    size = d // parts + 1

    def run(batches):
        totals, moved = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                old, new = (column(part, c) for c in ("old", "code"))
                bytes_of = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, parts)
                x = matrix(column(part, "v"), d)
                differences(x, None if old.null_count else bytes_of(old), bytes_of(new), totals, moved)
        p, e = np.nonzero(moved)
        place = ((p * entries + e) * size)[:, None] + np.arange(size)
        change = totals[p, e]
        some = change != 0
        yield pa.RecordBatch.from_arrays([pa.array(place[some], pa.int64()), pa.array(change[some], pa.int64())], names=["place", "change"])

    return coded.select("v", "old", "code").mapInArrow(run, "place bigint, change bigint").groupBy("place").agg(F.sum("change").alias("change"))


def updated(books: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The codebooks of the totals: sums over counts, rounded down; entries without parts stay."""
    count = totals[:, :, -1:]
    return np.where(count > 0, totals[:, :, :-1] // np.maximum(count, 1), books)


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The rows of `vectors.scaled` with code and far under the last codebooks, and these codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    d = -(-max(1, extent(rows)[1]) // parts) * parts
    books = first_entries(rows, d, parts, entries)
    totals = np.zeros((parts, books.shape[1], d // parts + 1), np.int64)
    coded = rows
    for k in range(rounds if books.shape[1] else 0):
        coded = written(assigned(coded, books, d), f"codes-{k}")
        flat = totals.reshape(-1)
        for r in changes(coded, d, parts, books.shape[1]).collect():  # at most a row for each number of the totals
            flat[r.place] += r.change
        books = updated(books, totals)
    return assigned(coded, books, d), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """The rows with label_error, the sum of far over equal labels. A label's rows are dealt to SALTS ways, each with a copy of its sum."""
    sums = coded.groupBy(label).agg(F.sum("far").alias("label_error"))
    copies = sums.select(F.col(label).alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_way"))
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, dealt[label].eqNullSafe(copies["_label"]) & (dealt["_salt"] == copies["_way"])).drop("_label", "_way", "_salt")


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(scaled(table(spark, sf_dir, "embeddings"), keep=("label",)))
    coded = written(coded.select("vec_id", "label", "code", "far"), "codes-last")
    found = with_label_error(coded)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), F.col("far").alias("error"), "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_NEAREST = """{name} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(far := far, e := e)) AS best FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM x JOIN {books} AS b ON x.p = b.p
  ) GROUP BY r, p
)"""
_UPDATED = """{name} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM {books} AS b LEFT JOIN (
    SELECT p, e, list(whole ORDER BY i) AS v FROM (
      SELECT x.p, a.best.e AS e, i, CAST(CASE WHEN sum(x.v[i]) >= 0 THEN sum(x.v[i]) // count(*) ELSE -((count(*) - 1 - sum(x.v[i])) // count(*)) END AS BIGINT) AS whole
      FROM x JOIN {codes} AS a ON x.r = a.r AND x.p = a.p, (SELECT unnest(range(1, 5)) AS i) GROUP BY x.p, a.best.e, i
    ) GROUP BY p, e
  ) AS n ON b.p = n.p AND b.e = n.e
)"""
SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
),
x AS MATERIALIZED (SELECT r, p, v[4 * p + 1:4 * p + 4] AS v FROM k, (SELECT unnest(range(0, 16)) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 64),
{_NEAREST.format(name="a1", books="b0")}, {_UPDATED.format(name="b1", books="b0", codes="a1")},
{_NEAREST.format(name="a2", books="b1")}, {_UPDATED.format(name="b2", books="b1", codes="a2")},
{_NEAREST.format(name="a3", books="b2")},
d AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a3 GROUP BY r)
SELECT k.vec_id, d.code, d.error, CAST(sum(d.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM k JOIN d ON k.r = d.r
"""

QUERIES = {"op13_delta_lloyd": op13_delta_lloyd}
ORACLES = {"op13_delta_lloyd": SQL}
