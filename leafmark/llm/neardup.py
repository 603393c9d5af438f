"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text's words are what white space parts, in lower case; its shingles are `width` consecutive words (the whole
sequence if there are fewer), weighted by their counts in the text. ProbMinHash: every shingle sends points of a Poisson
process whose rate is its weight to random registers; a register keeps the shingle of its earliest point, and a shingle
stops as soon as its next point comes after the latest point that any register holds. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles, which does not depend on the texts' lengths. With weight "set" every
distinct shingle weighs 1, and that is the plain Jaccard similarity.

`bands` of `rows` registers give each text its bucket keys; at the threshold 0.8 a pair misses every bucket with
probability (1 - 0.8^7)^48, about 1 in 90,000, and less the more alike it is. Texts that are equal are one
node. Candidates are verified by the exact similarity:
1. in every bucket each text against the bucket's least node, which the buckets of many near copies share, so that these cost
   a few pairs each; the links give components;
2. in the buckets that still hold several components, each text against two of the bucket's nodes that its key draws, if of other components;
3. of the texts in buckets that then hold several components, every pair of different components that can
   reach the threshold, by prefix filtering. Let u be the share of one text's weight on shingles that the other lacks, v the
   same the other way; then the similarity is at most (1 - u)(1 - v) / (1 - uv) (for sets it is just that). In a common order
   of shingles, rarest first, what comes before the first shared one counts to u and v. So the pair shares a shingle with at
   most 1 - t of the one text's weight before it, at most (1 - t) / (1 + t) of the other's, and both within the bound. Shared are
   no more shingles than either text has from there on, with no more weight than these and the text's repetitions.
Pairs inside a component cannot change it. So every bucket pair is verified, excluded by a bound, or joined by links
already: no link between classes is lost, while many copies cost a few verifications each, not one a pair. Texts of one
template that differ in more than (1 - t) / (1 + t) of their weight, in parts of their own, are never paired by the template.

A node is 64 bits of the text's hash: n texts collide with probability n^2 / 2^65.

Edge cases: null texts and texts without words are each a class of their own; extra columns are ignored, whatever their names; an empty
table gives an empty one. The class id is the least document id of the class; repeated ids share a row's fate. Similarities within 1e-12
of the threshold reach it. A very long text is one task's work at a time: its words and shingle hashes are held at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, slices, table, written
from leafmark.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 48, 7
#: Counters by which shingles are ordered for the last step.
COUNTERS = 1 << 16
#: Names of our own beside a table's columns.
_KEPT, _ROW_KEY = "_leafmark_kept_id", "_leafmark_row_key"
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes in order, and their counts."""
    import xxhash

    words = text.lower().encode().split() if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + _mix(h[k : len(h) - n + 1 + k])
    return np.unique(_mix(out), return_counts=True)


def signature(ids: np.ndarray, weights: np.ndarray | None, m: int) -> np.ndarray:
    """The shingle that each of the m registers keeps."""
    first, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    w = None if weights is None else weights.astype(np.float64)
    time, sent = np.zeros(len(ids)), 0
    k = max(1, math.ceil(m * (math.log(m) + 1.5) / max(1, len(ids))))  # points at once, to reach all registers
    while len(ids):
        rnd = _mix(ids[:, None] + np.arange(sent + 1, sent + k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((rnd >> np.uint64(24)) + np.uint64(1)).astype(np.float64) * 2.0**-40)
        if w is not None:
            gap /= w[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        register = (((rnd & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)).astype(np.int64)
        flat, reg = at.ravel(), register.ravel()
        early = np.flatnonzero(flat < first[reg])
        np.minimum.at(first, reg[early], flat[early])
        won = early[flat[early] == first[reg[early]]]
        owner[reg[won]] = ids[won // k]
        latest = first.max()
        go = np.flatnonzero(at[:, -1] < latest)
        ids, time, w, sent = ids[go], at[go, -1], None if w is None else w[go], sent + k
        k = max(1, min(16, m // max(1, len(ids)))) if latest < np.inf else max(k, 2)
    return owner


def band_keys(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = owner.reshape(bands, rows)
    return _mix((part * _ODD[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def similarity(a: np.ndarray, x: np.ndarray | None, b: np.ndarray, y: np.ndarray | None) -> float:
    """The exact probability Jaccard similarity of two weighted sets (sorted ids); weights None: all 1."""
    ids = np.intersect1d(a, b, assume_unique=True)
    if x is None:
        union = len(a) + len(b) - len(ids)
        return len(ids) / union if union else 0.0
    # sum over shared d of 1 / sum over d' of max(x'/x, y'/y): sorted by x'/y', the first term is the larger one from d on
    i, j = np.searchsorted(a, ids), np.searchsorted(b, ids)
    xs, ys = x[i].astype(float), y[j].astype(float)
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    order = np.argsort(xs / ys, kind="stable")
    xs, ys = xs[order], ys[order]
    above = only_x + xs[::-1].cumsum()[::-1]
    below = only_y + np.concatenate(([0.0], ys.cumsum()[:-1]))
    return float((1 / (above / xs + below / ys)).sum())


def sketches(docs: DataFrame, id_col: str, text: str, width: int, bands: int, rows: int, weight: str) -> DataFrame:
    """doc_id, node (null without words), n_shingles and keys array<bigint>, of every row."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("node"))
    kind = out.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: dict[int, tuple[int, list]] = {}
        for batch in slices(batches, "text", 2 << 20):
            nodes, sizes, keys = [], [], []
            for t, node in zip(column(batch, "text").to_pylist(), column(batch, "node").to_pylist()):
                n = own = None
                if t and not t.isspace():
                    if node not in seen:
                        if len(seen) > 20_000:
                            seen.clear()
                        ids, counts = shingles(t, width)
                        seen[node] = (len(ids), band_keys(signature(ids, counts if weight == "count" else None, bands * rows), bands, rows)) if len(ids) else (0, None)
                    n, own = seen[node]
                nodes.append(node if n else None)
                sizes.append(n)
                keys.append(own)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n_shingles", "keys"])

    return out.mapInArrow(run, f"doc_id {kind}, node bigint, n_shingles int, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """node, ids binary, counts binary: the shingles of one document for each wanted node (wanted: doc_id, node).

    Joined by text hash and id together, so neither an id nor a text that many rows have brings more than one; where rows repeat
    in both, a task takes the first.
    """
    rows = docs.select(F.col(id_col).alias("text_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("own_node"))
    rows = rows.join(wanted, (F.col("own_node") == F.col("node")) & F.col("text_id").eqNullSafe(F.col("doc_id"))).select("node", "text")

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text", 2 << 20):
            nodes, ids, counts = [], [], []
            for node, t in zip(column(batch, "node").to_pylist(), column(batch, "text").to_pylist()):
                if node in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(node)
                a, n = shingles(t, width)
                nodes.append(node)
                ids.append(a.tobytes())
                counts.append(b"" if n.max() == 1 else n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["node", "ids", "counts"])

    return rows.mapInArrow(run, "node bigint, ids binary, counts binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, weight: str) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = sets.select(F.col("node").alias("na"), F.col("ids").alias("ia"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("nb"), F.col("ids").alias("ib"), F.col("counts").alias("cb"))
    rows = pairs.join(left, F.col("b") == F.col("na")).join(right, F.col("a") == F.col("nb")).select("a", "b", "ia", "ca", "ib", "cb")

    def run(batches):
        for batch in batches:
            a, b = column(batch, "a").to_pylist(), column(batch, "b").to_pylist()
            keep = []
            for k, (ia, ca, ib, cb) in enumerate(zip(*(column(batch, c) for c in ("ia", "ca", "ib", "cb")))):
                p, q = np.frombuffer(ia.as_py(), np.uint64), np.frombuffer(ib.as_py(), np.uint64)
                if weight == "count":
                    x, y = (np.frombuffer(c.as_py(), np.int32) if c.as_py() else np.ones(len(s), np.int32) for c, s in ((ca, p), (cb, q)))
                else:
                    x = y = None
                if similarity(p, x, q, y) >= threshold - 1e-12:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _sizes_allow(n: str, m: str, threshold: float, weight: str):
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9 if weight == "set" else F.lit(True)


def _firsts(buckets: DataFrame) -> DataFrame:
    """a, b, n_shingles: every node of a bucket with its least node, which buckets of much the same nodes have in common."""
    heads = buckets.groupBy("key").agg(F.min("node").alias("b")).select(F.col("key").alias("head_key"), "b")
    return buckets.join(heads, F.col("key") == F.col("head_key")).select(F.col("node").alias("a"), "b", "n_shingles").where("a != b").distinct()


def _stars(open_: DataFrame) -> DataFrame:
    """a, b, n_shingles: every node of a bucket with two heads that the bucket's key draws, where they are of other components."""
    drawn = F.struct(F.col("node").bitwiseXOR(F.col("key")).alias("at"), F.col("node").alias("b"), F.col("component").alias("c"))
    heads = open_.groupBy("key").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high"))
    heads = heads.select(F.col("key").alias("head_key"), F.explode(F.array("low", "high")).alias("head")).select("head_key", "head.b", "head.c")
    return open_.join(heads, (F.col("key") == F.col("head_key")) & (F.col("component") != F.col("c"))).select(F.col("node").alias("a"), "b", "n_shingles").distinct()


def _open(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """The buckets that hold more than one component."""
    held = buckets.join(joined, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    mixed = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select(F.col("key").alias("mixed"))
    return written(held.join(mixed, F.col("key") == F.col("mixed")).drop("mixed"), "open-buckets")


def _cross(rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes of different components that share a key where the bound allows the threshold."""
    p, q = (rows.select(*(F.col(c).alias(f"{c}_{s}") for c in rows.columns)) for s in "pq")
    shared = F.least("left_p", "left_q")
    x, y = (F.least(1 - F.col(f"before_{s}"), (shared + F.col(f"again_{s}")) / F.col(f"total_{s}")) for s in "pq")  # weight that can be shared
    on = (F.col("key_p") == F.col("key_q")) & (F.col("component_p") != F.col("component_q")) & (x * y >= threshold * (x + y - x * y) - 1e-9)
    on &= ~F.col("early_q") | (F.col("node_p") > F.col("node_q"))  # two early ones meet once
    return p.where("early_p").join(q, on).select(F.greatest("node_p", "node_q").alias("a"), F.least("node_p", "node_q").alias("b")).distinct()


def _prefixes(open_: DataFrame, sets: DataFrame, threshold: float, weight: str) -> DataFrame:
    """The rows (key, before, early, left, total, again, node, component) with the shingles of the nodes' prefixes as keys, where
    components share one.

    before is the share of the node's weight on the shingles before this one; early ones have at most (1 - t) / (1 + t)
    before them, all have at most 1 - t. left: the shingles from this one on; total: the node's weight; again: that beyond 1 a shingle. The order is by a counter of the shingle's hash class, then by the shingle.
    """
    nodes = open_.select("node", "component").distinct()
    rows = sets.select(F.col("node").alias("set_node"), "ids", "counts").join(nodes, F.col("set_node") == F.col("node")).select("node", "component", "ids", "counts")
    rows = written(rows, "open-sets")

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for ids in column(batch, "ids"):
                total += np.bincount((np.frombuffer(ids.as_py(), np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    counted = np.zeros(COUNTERS, np.int64)
    for at, n in rows.select("ids").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n")).collect():  # COUNTERS rows at most
        counted[at] = n
    held = open_.sparkSession.sparkContext.broadcast(counted)
    early, latest = (1 - threshold) / (1 + threshold) + 1e-9, 1 - threshold + 1e-9

    def prefix(batches):
        for batch in batches:
            ids, counts, firsts, befores, lefts, totals, agains = column(batch, "ids"), column(batch, "counts"), [], [], [], [], []
            for k in range(batch.num_rows):
                own, said = np.frombuffer(ids[k].as_py(), np.uint64), counts[k].as_py()
                w = np.frombuffer(said, np.int32).astype(float) if said and weight == "count" else np.ones(len(own))
                order = np.lexsort((own, held.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                before = (np.cumsum(w[order]) - w[order]) / w.sum()
                n = int(np.searchsorted(before, latest, side="right"))
                firsts.append(own[order[:n]])
                befores.append(before[:n])
                lefts.append(len(own) - np.arange(n, dtype=np.int32))
                totals.append(np.full(n, w.sum()))
                agains.append(np.full(n, w.sum() - len(own)))
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in firsts]))
            before, total, again = (np.concatenate(x or [np.zeros(0)]) for x in (befores, totals, agains))
            left = np.concatenate(lefts or [np.zeros(0, np.int32)])
            key = np.concatenate([x.view(np.int64) for x in firsts] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(before), pa.array(before <= early), pa.array(left), pa.array(total), pa.array(again), *(column(batch, c).take(at) for c in ("node", "component"))], names=["key", "before", "early", "left", "total", "again", "node", "component"])

    keyed = written(rows.mapInArrow(prefix, "key bigint, before double, early boolean, left int, total double, again double, node bigint, component bigint"), "prefixes")
    mixed = keyed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("early").alias("some")).where("low != high and some").select(F.col("key").alias("mixed"))
    return keyed.join(mixed, F.col("key") == F.col("mixed")).drop("mixed")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weight: str = "set") -> DataFrame:
    """doc_id, class_id (the least document id of the class) and class_size, for every row."""
    found = written(sketches(docs, id_col, text, width, bands, rows, weight), "sketches")
    keyed = found.where("node is not null").select("node", "n_shingles", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select(F.col("key").alias("shared"))
    buckets = written(keyed.join(shared, F.col("key") == F.col("shared")).select("key", "node", "n_shingles").distinct(), "buckets")
    wanted = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(buckets.select("node").distinct(), "node", "left_semi")
    sets = _sets(docs, wanted.select("node", "doc_id"), id_col, text, width)
    again = found.where("node is not null").groupBy("node", "doc_id").count().where("count > 1")
    sets = written(sets if again.isEmpty() else sets.dropDuplicates(["node"]), "sets")
    sizes = buckets.select(F.col("node").alias("sized"), F.col("n_shingles").alias("n_head")).distinct()

    def allowed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sizes, F.col("b") == F.col("sized")).where(_sizes_allow("n_shingles", "n_head", threshold, weight))
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
        return components(joined.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    firsts = written(allowed(_firsts(buckets)), "first-pairs")
    joined = components(written(_verified(firsts, sets, threshold, weight), "links"))

    open_ = _open(buckets, joined)
    stars = written(allowed(_stars(open_)).join(firsts, ["a", "b"], "left_anti"), "star-pairs")
    more = written(_verified(stars, sets, threshold, weight), "star-links")
    if not more.isEmpty():
        joined = merged(joined, more)
        open_ = _open(open_.drop("component"), joined)

    rest = _cross(_prefixes(open_, sets, threshold, weight), threshold)
    rest = written(rest.join(firsts.unionByName(stars), ["a", "b"], "left_anti"), "cross-pairs")
    more = written(_verified(rest, sets, threshold, weight), "cross-links")
    if not more.isEmpty():
        joined = merged(joined, more)

    placed = found.select("doc_id", "node").join(joined, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    named = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    # written, so that the join below reads two plain exchanges, of which adaptive execution can split the copies of a large class
    several = written(named.where("class_size > 1").select(F.col("component").alias("c"), "class_id", "class_size"), "classes")
    return placed.join(several, F.col("component") == F.col("c"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", null_ids_stay: bool = True, **options) -> DataFrame:
    """One document of each class (that with the least id), with its columns. Rows that repeat as a whole count once;
    rows without an id stay, or else (null_ids_stay=False) take part: they come after all ids, by text digest and row number."""
    if not null_ids_stay and not docs.where(F.col(id_col).isNull()).isEmpty():
        none = F.col(id_col).isNull()
        key = F.struct(none.alias("none"), F.col(id_col).alias("id"), F.when(none, F.xxhash64(options.get("text", "text"))).alias("digest"), F.when(none, F.monotonically_increasing_id()).alias("row"))
        numbered = written(docs.withColumn(_ROW_KEY, key), "numbered")  # written, so that the row numbers stay
        return without_copies(numbered, _ROW_KEY, **options).drop(_ROW_KEY)
    kept = classes(docs, id_col=id_col, **options).where("doc_id = class_id").select(F.col("doc_id").alias(_KEPT)).distinct()
    chosen = docs.join(kept, F.col(id_col) == F.col(_KEPT), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return chosen
    return chosen.distinct()


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), weight="count")


QUERIES = {"op2_near_duplicates": op2_near_duplicates}
ORACLES: dict[str, str] = {}
