"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Words are the maximal runs of 0-9, a-z and non-ASCII characters after A-Z were lower-cased. A benchmark
window is `width` consecutive words of an item; an item of fewer words, but not none, is one window of
its own length. The windows form a hash set that every task holds: sorted 64-bit hashes of word numbers, with the
place of a window and its items (about 20 bytes a window). The documents' word sequences are scanned once; where
`width` known words follow each other, their hash is looked up, and a hit is verified word by word.

The set is broadcast only up to `block_bytes` of benchmark text. A larger benchmark is dealt into blocks of at most that size by a running sum
of bytes, so that many rows of one item id fall into many blocks; a text of more than half a block is cut into pieces that share
width - 1 words, so that no window is lost (a single word is never cut). Then the documents are written once with a row number; each block's scan reads
their texts and returns the hits alone, which are united by row number, so no block carries or rewrites a text, and the result does
not depend on the number of blocks.

Edge cases: null and empty texts have no words and no hits; items with a null text have no windows; equal item ids are
counted once; items without an id hit as any other, are counted as one item together (null in hit_items, last) and
are not in items_sha256; an empty benchmark hits nothing; repeated rows repeat. hits() replaces columns of the names that it adds;
remove_documents() and remove_spans() leave all columns of the table as they are, whatever their names. A text is scanned as a whole:
its words and 4 bytes a word are held at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, slices, table, written

WIDTH = 13
BLOCK_BYTES = 16 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class WindowSet:
    """The benchmark windows: word numbers, and for each window length the sorted hashes with places and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        self.ids: dict[bytes, int] = {}
        self.names: list[str | None] = []
        known: dict[str | None, int] = {}
        said, found = {}, []
        for item, text in items:
            row = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], np.int32)
            if len(row):
                owner = known.setdefault(item, len(known))
                n = min(width, len(row))
                said.setdefault(n, []).append((sum(map(len, found)), len(row) - n + 1, owner))
                found.append(row)
        self.names = list(known)
        self.flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own in said.items():
            start = np.concatenate([a + np.arange(m) for a, m, _ in own])
            owner = np.repeat(np.array([o for _, _, o in own], np.int32), [m for _, m, _ in own])
            seed = 0
            while True:  # until hash and window are one to one
                key = self._hashes(self.flat, start, n, seed)
                order = np.lexsort((owner, key))
                key, first, items_ = key[order], start[order], owner[order]
                new = np.concatenate(([True], key[1:] != key[:-1]))
                head = np.flatnonzero(new)
                same = np.repeat(first[head], np.diff(np.append(head, len(key))))
                if all((self.flat[first + k] == self.flat[same + k]).all() for k in range(n)):
                    break
                seed += 1
            once = new | np.concatenate(([True], items_[1:] != items_[:-1]))  # an item once for each window
            at = np.cumsum(once)[head] - 1
            self.windows[n] = (key[head], first[head], np.append(at, once.sum()), items_[once], seed)

    @staticmethod
    def _hashes(row: np.ndarray, start: np.ndarray, n: int, seed: int) -> np.ndarray:
        out = np.full(len(start), 0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64, np.uint64)
        for k in range(n):
            out = (out ^ row[start + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str | None]]:
        """The number of words, the sorted positions of the hit words, the items found."""
        found = words(text)
        get = self.ids.get
        row = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
        known = np.concatenate(([0], np.cumsum(row > 0)))
        edges, items = None, set()
        for n, (keys, first, at, owners, seed) in self.windows.items():
            if len(row) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            own = self._hashes(row, starts, n, seed)
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == own)
            for k in range(n):  # verified word by word
                hit = hit[row[starts[hit] + k] == self.flat[first[place[hit]] + k]]
            if len(hit):
                edges = np.zeros(len(row) + 1, np.int64) if edges is None else edges
                np.add.at(edges, starts[hit], 1)
                np.add.at(edges, starts[hit] + n, -1)
                for p in np.unique(place[hit]).tolist():
                    items.update(owners[at[p] : at[p + 1]].tolist())
        marks = np.flatnonzero(np.cumsum(edges[:-1])) if edges is not None else np.zeros(0, np.int64)
        return len(row), marks, {self.names[i] for i in items}


def pieces(text: str, width: int, block_bytes: int) -> Iterator[str]:
    """The text, or, if it is longer than half a block, pieces of its words that share width - 1 words, so that each of its windows lies in
    one of them whole."""
    if len(text.encode()) * 2 <= block_bytes or len(found := words(text)) <= 2 * width:
        yield text
        return
    ends = np.cumsum([len(w) + 1 for w in found])
    start = 0
    while True:
        base = int(ends[start - 1]) if start else 0
        end = max(start + 2 * width, int(np.searchsorted(ends, base + block_bytes // 2, "right")))
        if end >= len(found):
            yield b" ".join(found[max(0, min(start, len(found) - width)) :]).decode()
            return
        yield b" ".join(found[start:end]).decode()
        start = end - width + 1


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int, width: int) -> list[DataFrame]:
    """The benchmark's item and text in blocks of at most block_bytes (or one piece of a text): rows are dealt by a running sum of their
    bytes, whatever their ids. The driver sees a row for each part of a block."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return [rows]

    def deal(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, "text"):
            out = []
            for item, whole in zip(column(batch, "item").to_pylist(), column(batch, "text").to_pylist()):
                for piece in pieces(whole, width, block_bytes):
                    size = len(piece.encode())
                    if held and held + size > block_bytes:
                        part, held = part + 1, 0
                    held += size
                    out.append((item, piece, part, size))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["item", "text", "part", "size"])

    dealt = written(rows.repartition(-(-total // block_bytes)).mapInArrow(deal, "item string, text string, part bigint, size bigint"), "decontaminate-benchmark")
    bins: list[list] = []  # bytes and parts
    for r in dealt.groupBy("part").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "part").collect():
        room = next((b for b in bins if b[0] + r["size"] <= block_bytes), None)
        if room is None:
            bins.append(room := [0, []])
        room[0] += r["size"]
        room[1].append(r.part)
    return [dealt.where(F.col("part").isin(parts)).select("item", "text") for _, parts in bins]


def _sorted_items(names) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


NAMES = ("n_words", "hit_words", "hit_items")
#: Names of our own beside a table's columns.
_OWN = ("_leafmark_n_words", "_leafmark_hit_words", "_leafmark_hit_items")
_ROW = "_leafmark_row"
_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))


def _scanned(docs: DataFrame, block: DataFrame, text: str, width: int, names: tuple[str, str, str], every: bool, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the block's hits; without `every`, only rows with hits."""
    held = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in block.collect()], width))  # a block's rows, see _blocks
    kinds = ("bigint", "array<int>", "array<string>")
    schema = docs.select(keep).withColumns({n: F.lit(None).cast(k) for n, k in zip(names, kinds)}).schema

    def scan(batches):
        found = held.value
        for batch in slices(batches, text):
            got = [found.scan(t) for t in column(batch, text).to_pylist()]
            new = [pa.array(x, t) for x, t in zip(([g[0] for g in got], [g[1].astype(np.int32) for g in got], [_sorted_items(g[2]) for g in got]), _TYPES)]
            out = pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), *new], names=[*keep, *names])
            yield out if every else out.filter(pa.array([len(g[1]) > 0 for g in got]))

    return docs.mapInArrow(scan, schema)


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with n_words long, hit_words array<int> (positions of hit words) and hit_items array<string>, or such columns of other names."""
    docs = docs.drop(*names)
    blocks = _blocks(benchmark, item_id, item_text, block_bytes, width)
    if len(blocks) == 1:
        return _scanned(docs, blocks[0], text, width, names, True, docs.columns)
    docs = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "decontaminate")
    some = None
    for k, block in enumerate(blocks):
        one = _scanned(docs.select(_ROW, text), block, text, width, names, k == 0, [_ROW])
        some = one if some is None else some.unionByName(one)
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in names[1:]]
    return docs.join(some.groupBy(_ROW).agg(F.max(names[0]).alias(names[0]), *united), _ROW).drop(_ROW)


def contaminated(names: tuple[str, str, str] = NAMES):
    """The rule: some hit, and a twentieth of the words or more are hit."""
    return (F.size(names[1]) > 0) & (F.size(names[1]).cast("bigint") * 20 >= F.col(names[0]))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that the rule does not hold against, with their columns."""
    return hits(docs, benchmark, names=_OWN, **options).where(~contaminated(_OWN)).drop(*_OWN)


def without_words(text: str, positions: list[int]) -> str:
    """The text without the words at these positions; what stands between two neighbours of them goes too."""
    drop, out, end, was = set(positions), [], 0, False
    for k, m in enumerate(_WORD.finditer(text)):
        hit = k in drop
        if not (hit and was):
            out.append(text[end : m.start()])
        if not hit:
            out.append(m[0])
        end, was = m.end(), hit
    return "".join([*out, text[end:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents with their columns, the hit words cut out of their texts."""
    found, names = hits(docs, benchmark, text=text, names=_OWN, **options), docs.columns

    def cut(batches):
        for batch in slices(batches, text):
            texts, hit = column(batch, text).to_pylist(), column(batch, _OWN[1]).to_pylist()
            new = pa.array([without_words(t, h) if t and h else t for t, h in zip(texts, hit)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else column(batch, c) for c in names], names=names)

    return found.mapInArrow(cut, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, CASE WHEN text IS NULL THEN [] ELSE {_SQL_WORDS.format("text")} END AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, len(w[i : i + 12]) AS n, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.rid, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""

QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES = {"op9_decontamination": SQL}
