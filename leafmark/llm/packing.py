"""Mixture-controlled packing by deficit round-robin over source queues.

Every document becomes its token ids plus one end id. A source's documents form a queue; in every window
(sequence) of `length` tokens each queue is served its quantum, target share x length, and what rounding leaves
over is its deficit, carried into the next window. With one token as the unit that can be cut off, the schedule has
a closed form: with the queues in order and cumulative target amounts C of a total P, the queues up to j
have received floor(u * C_j / P) of the first u tokens, so the deficit of a queue stays under one token in every
window. So deficits carry across windows and partitions without a walk over the windows: a task needs only where
its partition begins in each queue (a running sum over partitions). Every window but the last is full.

By default the targets are the sources' shares of all tokens, so that all queues end together. Sources that get
under two tokens a window carry their deficit over several: together they are one queue, which is served in every
window (first, so that what it has had never falls, however small it is), and the tokens of this queue are dealt
to them by the same closed form, over so many of its tokens that each gets two. Those of sizes within four times are a
tier; the smaller ones are again one queue inside it. So a source has had its share, to a few tokens, at any point.
Other weights give phases: when a queue runs dry, the rest share on by their weights, and sources without weight come
last, sharing by their sizes.

Token ids are written once as a table in the shared folder; its order (partition, position) is the queues' order.

The output is the pieces; padding has no rows. Every sequence is full but the last, which a user pads with any id up to `length`,
unless its tokens come to a power of two.

Edge cases: null and empty texts are one end id; a very long text is encoded as a whole; a null source is a queue of its own; repeated rows are packed each
as a document of its own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import column, slices, table, written

LENGTH = 2048
END_ID = 1
CLASSES = 4096
#: The tier of the queues that get two tokens a window.
OWN = 64
#: How byte-level tokenizers of this kind split a text.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes engines could differ; all others are plain Latin ones.
_OTHER = re.compile("[^\\t\\n\\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_ranks(said: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE whose ids are its merge ranks: bytes first, then one token for each merge, in order."""
    model, split = said["model"], said.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or said.get("normalizer"):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    special = {t["content"] for t in said["added_tokens"]}
    bytes_ = sorted(vocab.get(c, -1) for c in _byte_names())
    known = {*bytes_, *made}
    return bytes_[0] >= 0 and made == sorted(set(made)) and (not made or made[0] > bytes_[-1]) and all(i in known for t, i in vocab.items() if t not in special)


class Encoder:
    """Texts to little-endian token ids, the same as the tokenizer's own.

    Texts of plain Latin characters run on a faster engine over the same vocabulary, whose ids are its merge ranks.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in said["added_tokens"]) or r"(?!)")
        self.fast = None
        if plain_ranks(said):
            names, special = _byte_names(), {t["content"] for t in said["added_tokens"]}
            ranks = {bytes(names[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.fast is None or _OTHER.search(text) or self.special.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids).astype(self.dtype).tobytes() + self.end


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, end_id)


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The written table doc_id, queue, part, seq, start (in the partition's part of its queue), n, ids."""
    path = path or tokenizer_path()
    out = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("queue"), "text")
    kind = out.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        engine, part, seq, at = encoder(path, end_id), TaskContext.get().partitionId(), 0, {}
        width = engine.dtype.itemsize
        for batch in slices(batches, "text", 2 << 20):
            ids = [engine.encode(t) for t in column(batch, "text").to_pylist()]
            starts, sizes = [], [len(x) // width for x in ids]
            for q, n in zip(column(batch, "queue").to_pylist(), sizes):
                starts.append(at.get(q, 0))
                at[q] = starts[-1] + n
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "queue"), pa.array([part] * rows, pa.int32()), pa.array(range(seq, seq + rows), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "seq", "start", "n", "ids"])
            seq += rows

    return written(out.mapInArrow(run, f"doc_id {kind}, queue string, part int, seq bigint, start bigint, n bigint, ids binary"), "tokens")


def tiers(sizes: dict[int, tuple[int, int]], length: int) -> dict[int, tuple[int, int, int, list[tuple[int, int, int, int]]]]:
    """For each tier, of its tokens and its least queue's: (tokens of the tiers below, these and its own, window, steps outwards).

    A step (lower and upper cumulative amount, total, window) places a queue's tokens among the total's.
    """
    out, outer, total = {}, [], sum(n for n, _ in sizes.values())
    for tier in sorted({OWN, *sizes}, reverse=True):
        amount, least = sizes.get(tier, (0, 1))
        below = total - amount
        out[tier] = (below, total, length if tier == OWN else -(-2 * total // least), outer)
        if tier == OWN or amount:
            outer = [(0, below, total, out[tier][2]), *outer]
        total = below
    return out


def tier_of(n: int, total: int, length: int) -> int:
    return OWN if n * length >= 2 * total else (n.bit_length() + 1) // 2


def _shared(amount: dict[str, int], length: int) -> dict[str, list[tuple[int, int, int, int]]]:
    """The steps of each queue, from its own tier outwards."""
    total, sizes = sum(amount.values()), {}
    for n in amount.values():
        tier = tier_of(n, total, length)
        had, least = sizes.get(tier, (0, n))
        sizes[tier] = (had + n, min(least, n))
    found, out = tiers(sizes, length), {}
    low = {tier: x[0] for tier, x in found.items()}
    for q, n in amount.items():
        tier = tier_of(n, total, length)
        _, all_, window, outer = found[tier]
        out[q] = [(low[tier], low[tier] + n, all_, window), *outer]
        low[tier] += n
    return out


def phases(totals: list[tuple[str, int]], weights: dict[str, int], length: int) -> dict[str, list[tuple[int, int, list[tuple[int, int, int, int]]]]]:
    """For each queue its phases (first token in the queue, the phase's first global position, steps)."""
    left = {q: n for q, n in sorted(totals) if n}
    out: dict[str, list] = {q: [] for q in left}
    begun, at = dict.fromkeys(left, 0), 0
    while left:
        active = {q: weights.get(q, 0) for q in left if weights.get(q, 0) > 0} or dict(left)
        least = min(active, key=lambda q: (left[q] / active[q], q))
        amount = {q: left[q] if q == least else min(left[q], left[least] * w // active[least]) for q, w in active.items()}
        amount = {q: n for q, n in amount.items() if n}
        for q, steps in _shared(amount, length).items():
            out[q].append((begun[q], at, steps))
            begun[q] += amount[q]
            left[q] -= amount[q]
            if not left[q]:
                del left[q]
        at += sum(amount.values())
    return out


def _dealt(own: int, stop: int, low: int, high: int, total: int, window: int, base: int = 0) -> list[tuple[int, int, int]]:
    """The pieces (first token, size, position) of a queue's tokens own .. stop among the total's, cut where windows end."""
    out = []
    share = lambda u: u * high // total - u * low // total  # noqa: E731  what the queue has had of the first u tokens
    edge = lambda w: min(max(w * window - base, 0), total)
    # only a queue that comes first can get nothing for many windows; its tokens' windows are known
    find = lambda own: (base - 1 - (-(own + 1) * total // high) if not low else base + own * total // (high - low)) // window
    w = find(own)
    while share(edge(w)) > own:
        w -= 1
    while share(edge(w + 1)) <= own:
        w += 1
    while own < stop:
        u, v = edge(w), edge(w + 1)
        had, has = share(u), share(v)
        if has > had:
            to = min(stop, has)
            out.append((own, to - own, u + v * low // total - u * low // total + own - had))
            own = to
            w += 1
        else:
            w = w + 1 if low else find(own)
    return out


def cut(first: int, n: int, plan: list[tuple[int, int, list[tuple[int, int, int, int]]]], length: int) -> list[tuple[int, int, int, int]]:
    """The pieces (start, length, sequence, offset) of a document at tokens first .. first + n of its queue."""
    out, at, end = [], first, first + n
    k = bisect_right(plan, first, key=lambda p: p[0]) - 1
    while at < end:
        begun, base, steps = plan[k]
        stop = min(end, begun + steps[0][1] - steps[0][0])
        pieces = [(at - first, stop - at, at - begun)]
        for step in steps[:-1]:
            pieces = [(start + own - pos, size, to) for start, m, pos in pieces for own, size, to in _dealt(pos, pos + m, *step)]
        for start, m, pos in pieces:
            out.extend((start + own - pos, size, *divmod(base + to, length)) for own, size, to in _dealt(pos, pos + m, *steps[-1], base))
        at = stop
        k += 1
    return out


def pack(docs: DataFrame, length: int = LENGTH, weights: dict[str, int] | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, piece_ids array<int>.

    weights: target proportions of some sources; without it, the sources' shares of all tokens.
    """
    tokens = tokenized(docs, path, end_id)
    parts = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "parts")
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("queue", "part", F.coalesce(before, F.lit(0)).alias("before"))
    totals = parts.groupBy("queue").agg(F.sum("n").alias("total"))
    named = {f"s{k}": int(w) for k, w in (weights or {}).items() if int(w) > 0}
    # the queues that weights name are planned here, the others as one; inside it each by its tier
    theirs = F.col("queue").isin(list(named)) if named else F.lit(False)
    rest = totals.where(~theirs)
    every = rest.agg(F.sum("total")).first()[0] or 0
    planned = phases([*(tuple(r) for r in totals.where(theirs).collect()), ("", every)], named, length)
    base = planned.pop("")[0][1] if every else 0
    rest = rest.withColumn("tier", F.when(F.col("total") * length >= 2 * every, OWN).otherwise(F.floor((F.length(F.bin("total")) + 1) / 2)).cast("int"))
    sizes = {r.tier: (r.n, r.least) for r in rest.groupBy("tier").agg(F.sum("total").alias("n"), F.min("total").alias("least")).collect()}
    step = "struct<low:bigint,high:bigint,all:bigint,window:bigint>"
    plan = f"array<struct<begun:bigint,base:bigint,steps:array<{step}>>>"
    held = docs.sparkSession.createDataFrame([(tier, *x) for tier, x in tiers(sizes, length).items()], f"tier int, below bigint, all bigint, window bigint, outer array<{step}>")
    # a tier's queues in a row, in order of a hash class, so that no task sums up all of them
    rest = rest.withColumn("class", F.pmod(F.xxhash64("queue"), F.lit(CLASSES)))
    classes = rest.groupBy("tier", "class").agg(F.sum("total").alias("class_total"))
    up = Window.partitionBy("tier").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("tier", "class", F.coalesce(F.sum("class_total").over(up), F.lit(0)).alias("class_before"))
    own = Window.partitionBy("tier", "class").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("own_before", F.coalesce(F.sum("total").over(own), F.lit(0))).join(classes, ["tier", "class"]).join(F.broadcast(held), "tier")
    low = F.col("below") + F.col("class_before") + F.col("own_before")
    inner = F.struct(low.alias("low"), (low + F.col("total")).alias("high"), "all", "window")
    bounds = rest.select("queue", F.array(F.struct(F.lit(0), F.lit(base), F.concat(F.array(inner), "outer"))).cast(plan).alias("plan"))
    if planned:
        bounds = bounds.unionByName(docs.sparkSession.createDataFrame(list(planned.items()), f"queue string, plan {plan}"))
    offsets = offsets.join(bounds, "queue").select("queue", "part", "before", "plan")
    placed = written(offsets, "queues")
    ready = tokens.join(placed, ["queue", "part"])
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "ids", 1 << 20):
            rows = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_ids")}
            plans: dict[tuple, list] = {}
            queue = column(batch, "queue").to_pylist()
            plan_col = column(batch, "plan")
            for i, (doc, n, start, before_, ids) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("doc_id", "n", "start", "before", "ids")))):
                if queue[i] not in plans:
                    plans[queue[i]] = [(p["begun"], p["base"], [(x["low"], x["high"], x["all"], x["window"]) for x in p["steps"]]) for p in plan_col[i].as_py()]
                row = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for a, size, w, offset in cut(before_ + start, n, plans[queue[i]], length):
                    own = row[a : a + size]
                    for c, v in zip(rows.values(), (doc, a, size, zlib.crc32(own), n, w, offset, own)):
                        c.append(v)
            types = (batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.list_(pa.uint32()))
            flat = pa.array(np.concatenate(rows["piece_ids"]).astype(np.int32)) if rows["piece_ids"] else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rows["piece_ids"]]))).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(list(rows.values())[:-1], types)), lists], names=list(rows))

    return ready.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, piece_ids array<int>")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("piece_ids")


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
