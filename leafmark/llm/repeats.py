"""Exact repeat removal by prefix-free parsing.

Removed is every byte that some `length`-byte string (a window) covers which also starts anywhere else in the corpus.
Matches do not cross documents, and windows are judged on the input.

1. Dealing. A rolling hash of `seed` bytes runs over each text; a window's trigger is the leftmost least hash in it, so
   equal windows have equal triggers at equal places and can only meet inside a trigger's group. Neighbouring windows with one
   trigger are an interval, the bytes that they cover its phrase. A text is so parsed into (trigger, phrase) hashes.
2. The parse is counted by groupBy: a trigger that stands in one place cannot repeat; a phrase that stands in
   several places repeats as a whole. Open are the phrases that share their trigger with other phrases.
3. The open phrases, each distinct one once, meet with their bytes, trigger by trigger. There a prefix-free parse is
   built (corpus_order): triggers, 8 bytes whose hash is 0 modulo 16, cut the phrases into words that overlap by these 8
   bytes; the distinct words are the dictionary, the phrases' sequences of words the parse. The suffix array of
   the dictionary and that of the parse, both by prefix doubling, combine into the order of all window
   starts, in which equal windows are neighbours; neighbours are compared byte by byte.
4. The covered bytes of steps 2 and 3 are united for each text.

The order is built for sets of triggers of about `SHARD_BYTES`, as no window can equal one of another trigger; a
single order of the whole corpus is never needed. Whole phrases are compared by 64-bit hashes of trigger and of phrase together,
texts by a 128-bit digest.

Hot groups: texts that are equal are parsed once a task, and removed whole without a comparison. A phrase that stands very often
is one row for each block of texts, counted in partial sums and compared once. A trigger with more than `HOT` distinct phrases (the rim of a passage that very
many documents share) is taken apart: its phrases' windows are dealt by their 128-bit digests, one row each, so that no task
holds the group. Very long texts are parsed in blocks of `BLOCK_BYTES` that overlap by a window; a stretch of one repeated
character has an interval for each byte, of some 100 bytes of memory, so a text of tens of MB of it does not fit a small task.

Edge cases: null is the empty text; texts shorter than `length` keep every byte; repeated rows and rows without an id repeat
each other; ties of least hashes go to the left; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, slices, table, written

LENGTH = 200
SEED = 64
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 2 << 20
#: Distinct phrases of a trigger beyond which its windows are dealt one by one.
HOT = 2000
#: Bytes of a trigger of the prefix-free parse, and the modulus of its hash.
TRIGGER, MODULUS = 8, 16
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _parsed_block(raw: bytes, length: int, seed: int) -> tuple[np.ndarray, ...]:
    n = len(raw)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
    h = _mix((total[seed:] - total[:-seed]) * down[: n - seed + 1])
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - seed + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    phrase = _mix((total[last + length] - total[first]) * down[first]) ^ _mix((at - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64))
    # least hashes have low upper bits; mixed once more they can be dealt out by them
    return first, last, at, _mix(h[at] * np.uint64(_BASE)), phrase


def parse(raw: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of windows with one trigger: first and last window start, trigger place, trigger hash, phrase hash.

    An interval that a block of `BLOCK_BYTES` ends in goes on as another one; the windows and their triggers are the same.
    """
    starts = len(raw) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    if starts <= BLOCK_BYTES:
        return _parsed_block(raw, length, seed)
    found = []
    for a in range(0, starts, BLOCK_BYTES):
        first, last, at, trigger, phrase = _parsed_block(raw[a : min(a + BLOCK_BYTES, starts) + length - 1], length, seed)
        found.append((first + a, last + a, at + a, trigger, phrase))
    return tuple(np.concatenate(x) for x in zip(*found))


def _refined(rank: np.ndarray, after, size: int, active: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks (the numbers of smaller suffixes) by `size` symbols become ranks by twice as many, for the
    active suffixes, which are whole classes of equal ones. Returns those that still share a rank."""
    key = (rank[active].astype(np.uint64) << np.uint64(32)) | after(active, size).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, active = key[order], active[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    own = np.concatenate(([True], np.diff(key >> np.uint64(32)) != 0))  # where a class begins
    place = np.arange(len(key))
    rank[active] = rank[active] + (np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(own, place, 0)))
    alone = new & np.append(new[1:], True)
    return active[~alone]


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by key, and those that share one."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(key) else np.zeros(0, bool)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else 0
    return rank, order[~(new & np.append(new[1:], True))] if len(key) else order


def _sorted_dictionary(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the words as ranks of all their suffixes (equal ones share a rank), and where each word begins."""
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    symbol = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) + 1
    n = len(symbol)
    left = np.repeat(begin + sizes, sizes) - np.arange(n)  # symbols up to the word's end
    padded = np.concatenate((symbol, np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(7):  # 7 symbols of 9 bits; beyond the end 0
        key = (key << 9) | np.where(left > k, padded[k : k + n], 0)
    rank, active = _ranked(key)
    size = 7
    while True:
        active = active[left[active] >= size]  # others have met their word's end: equal suffixes
        if not len(active):
            return rank, begin

        def after(at, k):
            to = at + k
            return np.where(left[at] > k, rank[np.minimum(to, n - 1)] + 1, 0)

        active = _refined(rank, after, size, active)
        size *= 2


def _sorted_parse(word_rank: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of the parse as ranks; left: words up to the phrase's end."""
    rank, active = _ranked(word_rank)
    size, n = 1, len(rank)
    while True:
        active = active[left[active] >= size]
        if not len(active):
            return rank

        def after(at, k):
            return np.where(left[at] > k, rank[np.minimum(at + k, n - 1)] + 1, 0)

        active = _refined(rank, after, size, active)
        size *= 2


def corpus_order(phrases: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window starts of the phrases (the first ones of each, so many as `windows` says) in the order of the suffixes there:
    places in the concatenated phrases, with the concatenation (as 8-byte reads) and the phrases' beginnings.

    Each start is a suffix of a dictionary word, followed by a suffix of the parse. No proper suffix longer than a trigger is
    a prefix of another one, but at the phrases' ends, so the order by (rank of the word's suffix, rank of the rest) is the
    order of the texts, as far as a phrase goes.
    """
    text = b"".join(phrases)
    sizes = np.array([len(p) for p in phrases], np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    reads = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    hashed = _mix((reads ^ (reads >> np.uint64(33))) * np.uint64(_BASE)) >> np.uint64(40)
    trigger = np.flatnonzero(hashed % np.uint64(MODULUS) == 0)
    of = np.searchsorted(end, trigger, side="right")
    trigger = trigger[trigger + TRIGGER <= end[of]]
    start = np.union1d(begin, trigger)
    of = np.searchsorted(end, start, side="right")
    following = np.append(start[1:], len(text))
    stop = np.where(following < end[of], following + TRIGGER, end[of])
    known: dict[bytes, int] = {}
    word = np.fromiter((known.setdefault(text[a:b], len(known)) for a, b in zip(start.tolist(), stop.tolist())), np.int64, len(start))
    dictionary, at = _sorted_dictionary(list(known))
    last = np.searchsorted(of, of, side="right")  # the first word of the next phrase
    parsed = _sorted_parse(dictionary[at[word]], last - np.arange(len(start)))
    rest = np.where(np.arange(len(start)) + 1 < last, parsed[np.minimum(np.arange(len(start)) + 1, len(start) - 1)] + 1, 0)
    place = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    k = np.searchsorted(start, place, side="right") - 1
    key = (dictionary[at[word[k]] + place - start[k]].astype(np.uint64) << np.uint64(32)) | rest[k].astype(np.uint64)
    return place[np.argsort(key, kind="stable")], reads, begin


def repeated_windows(phrases: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[int]]:
    """For phrases (bytes, their trigger's place, up to which their windows start): the window starts whose strings stand in more
    than one place."""
    out: list[list[int]] = [[] for _ in phrases]
    if len(phrases) < 2:
        return out
    windows = np.array([min(len(p) - length, before) + 1 for p, before in phrases], np.int64)
    order, reads, begin = corpus_order([p for p, _ in phrases], windows)
    pair = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:  # neighbours that agree so far
        pair = pair[reads[order[pair] + k] == reads[order[pair + 1] + k]]
    hit = np.unique(np.concatenate((order[pair], order[pair + 1])))
    own = np.searchsorted(begin, hit, side="right") - 1
    cuts = np.searchsorted(own, np.arange(len(phrases) + 1))
    for i in np.unique(own).tolist():
        out[i] = (hit[cuts[i] : cuts[i + 1]] - begin[i]).tolist()
    return out


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _arrow(cols: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in types.items()], names=list(types))


def _parsed(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """One table of three kinds of rows: d documents (doc_id, n_bytes, sha256, key); t texts with windows, equal ones once a
    task (row_id, key, text); e the distinct entries of a block of texts (triggers, phrases, row_ids, places: where each stands
    first, times, more: where else)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs, ints, others = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.struct([("row_id", pa.int64()), ("place", pa.int32())])))
    types = {"n_bytes": pa.int64(), "sha256": pa.string(), "key": pa.binary(), "row_id": pa.int64(), "text": pa.string(), "triggers": longs, "phrases": longs, "row_ids": longs, "places": ints, "times": ints, "more": others}

    def batch_of(name: str, ids: pa.Array, **columns: list) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([name] * n), ids, *(pa.nulls(n, t) if c not in columns else columns[c].cast(t) if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in types.items())], names=["kind", "doc_id", *types])

    def run(batches):
        from pyspark import TaskContext

        row_id, seen = TaskContext.get().partitionId() << 33, set()
        for batch in slices(batches, "text", BLOCK_BYTES):
            ids, rows = column(batch, "doc_id"), batch.num_rows
            n_bytes, digests, keys = [], [], []
            own: dict[str, list] = {c: [] for c in ("row_id", "key", "text")}
            found = []
            for t in column(batch, "text").to_pylist():
                raw = (t or "").encode()
                key = _key(raw)
                n_bytes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                keys.append(key)
                if len(raw) >= length and key not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(key)
                    row_id += 1
                    for c, v in zip(own.values(), (row_id, key, t)):
                        c.append(v)
                    found.append(parse(raw, length, seed)[3:])
            yield batch_of("d", ids, n_bytes=n_bytes, sha256=digests, key=keys)
            if not found:
                continue
            yield batch_of("t", pa.nulls(len(found), ids.type), **own)
            sizes = [len(p[0]) for p in found]
            trigger, phrase = (np.concatenate([p[k] for p in found]).view(np.int64) for k in (0, 1))
            owner = np.repeat(np.array(own["row_id"], np.int64), sizes)
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            order = np.lexsort((phrase, trigger))
            trigger, phrase, owner, place = trigger[order], phrase[order], owner[order], place[order]
            head = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1]))))
            times = np.diff(np.append(head, len(trigger)))
            other = np.ones(len(trigger), bool)
            other[head] = False
            where = pa.StructArray.from_arrays([pa.array(owner[other], pa.int64()), pa.array(place[other], pa.int32())], names=["row_id", "place"])
            more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(times - 1))), pa.int32()), where)
            more = pa.ListArray.from_arrays(pa.array([0, len(head)], pa.int32()), more)
            yield batch_of("e", pa.nulls(1, ids.type), triggers=[trigger[head]], phrases=[phrase[head]], row_ids=[owner[head]], places=[place[head]], times=[times.astype(np.int32)], more=more)

    schema = f"kind string, doc_id {kind}, n_bytes bigint, sha256 string, key binary, row_id bigint, text string, triggers array<bigint>, phrases array<bigint>, row_ids array<bigint>, places array<int>, times array<int>, more array<array<struct<row_id:bigint,place:int>>>"
    return written(docs.mapInArrow(run, schema), "parsed")


WHOLE, SEND, ASKED, HOT_TRIGGER = 1, 2, 4, 8


def _decided(blocks: DataFrame) -> DataFrame:
    """row_id and said array<struct<place, code>>: what is known of the intervals of a text that may repeat.

    Codes add up WHOLE (repeats as a whole), SEND (its bytes are to be compared), ASKED (for its own windows), HOT_TRIGGER.
    A block counts as one row for an entry, however often it has it; its other places repeat as a whole without being asked.
    """
    names = {"triggers": "trigger", "phrases": "phrase", "row_ids": "row_id", "places": "place", "times": "times"}
    entries = blocks.select(F.explode(F.arrays_zip(*names)).alias("e")).select(*(F.col(f"e.{c}").alias(n) for c, n in names.items()))
    live = entries.groupBy("trigger").agg(F.sum("times").alias("n")).where("n > 1").select("trigger")
    entries = written(entries.join(live, "trigger", "left_semi"), "live-parse")
    here = F.xxhash64("row_id", "place")
    dictionary = entries.groupBy("trigger", "phrase").agg(F.sum("times").alias("stands"), F.min(here).alias("sender"))
    several = dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("kinds"))
    answers = dictionary.join(several, "trigger").where("stands > 1 or kinds > 1")
    whole, open_ = F.col("stands") > 1, F.col("kinds") > 1
    code = (
        F.when(whole, WHOLE).otherwise(0)
        + F.when(open_ & (here == F.col("sender")), SEND).otherwise(0)
        + F.when(open_ & ~whole, ASKED).otherwise(0)
        + F.when(F.col("kinds") > HOT, HOT_TRIGGER).otherwise(0)
    )
    each = entries.join(answers, ["trigger", "phrase"]).select("row_id", "place", code.cast("int").alias("code"))
    again = blocks.select(F.explode(F.flatten("more")).alias("x")).select("x.row_id", "x.place", F.lit(WHOLE).alias("code"))
    return each.unionByName(again).groupBy("row_id").agg(F.collect_list(F.struct("place", "code")).alias("said"))


def _phrases(texts: DataFrame, decided: DataFrame, length: int, seed: int) -> DataFrame:
    """One table of three kinds of rows: t texts with the spans that repeat whole; p phrases to be compared; h windows of a
    phrase of a hot trigger, as digests."""
    rows = texts.join(decided.withColumnRenamed("row_id", "said_of"), F.col("row_id") == F.col("said_of")).select("row_id", "key", "text", "said")
    ints = pa.list_(pa.int64())
    types = {"kind": pa.string(), "row_id": pa.int64(), "key": pa.binary(), "text": pa.string(), "starts": ints, "ends": ints, "trigger": pa.int64(), "phrase": pa.binary(), "start": pa.int64(), "asked": pa.bool_(), "high": ints, "low": ints}

    def run(batches):
        cols: dict[str, list] = {c: [] for c in types}
        held = 0

        def add(**values):
            for c in types:
                cols[c].append(values.get(c))

        for batch in slices(batches, "text", 2 << 20):
            for row in batch.to_pylist():
                raw = row["text"].encode()
                first, last, _, trigger, _ = parse(raw, length, seed)
                said = np.array([(x["place"], x["code"]) for x in row["said"]], np.int64).reshape(-1, 2)
                whole = np.sort(said[said[:, 1] & WHOLE > 0, 0])
                add(kind="t", row_id=row["row_id"], key=row["key"], text=row["text"], starts=first[whole], ends=last[whole] + length)
                held += len(raw)
                for i, code in said[said[:, 1] & SEND > 0].tolist():
                    a, phrase = int(first[i]), raw[first[i] : last[i] + length]
                    if code & HOT_TRIGGER:
                        digests = np.frombuffer(b"".join(_key(phrase[k : k + length]) for k in range(len(phrase) - length + 1)), "<i8").reshape(-1, 2)
                        add(kind="h", row_id=row["row_id"], start=a, asked=bool(code & ASKED), high=digests[:, 0], low=digests[:, 1])
                        held += 16 * len(digests)
                    else:
                        add(kind="p", row_id=row["row_id"], trigger=int(trigger[i].view(np.int64)), phrase=phrase, start=a, asked=bool(code & ASKED))
                        held += len(phrase)
                    if held >= 4 << 20:
                        yield _arrow(cols, types)
                        cols, held = {c: [] for c in types}, 0
        if cols["kind"]:
            yield _arrow(cols, types)

    return written(rows.mapInArrow(run, "kind string, row_id bigint, key binary, text string, starts array<bigint>, ends array<bigint>, trigger bigint, phrase binary, start bigint, asked boolean, high array<bigint>, low array<bigint>"), "phrases")


def _shards(batches):
    """Lists of rows of whole triggers, of about SHARD_BYTES of phrases, from batches that are sorted by trigger."""
    held: list[dict] = []
    size, mark, marked = 0, 0, 0  # where the last trigger's rows begin, and the bytes before them
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["trigger"] != held[-1]["trigger"]:
                if size >= SHARD_BYTES:
                    yield held
                    held, size = [], 0
                mark, marked = len(held), size
            held.append(row)
            size += len(row["phrase"])
            if size >= 2 * SHARD_BYTES and mark:
                yield held[:mark]
                held, size, mark, marked = held[mark:], size - marked, 0, 0
    if held:
        yield held


def _compared(phrases: DataFrame, length: int) -> DataFrame:
    """row_id, starts, ends: spans of the repeated windows of the phrases that were asked for."""
    types = {"row_id": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}

    def run(batches):
        for rows in _shards(batches):
            cols: dict[str, list] = {c: [] for c in types}
            for r, found in zip(rows, repeated_windows([(r["phrase"], len(r["phrase"])) for r in rows], length)):
                if r["asked"] and found:
                    at = np.array(found, np.int64) + r["start"]
                    cut = np.flatnonzero(np.diff(at) > 1)
                    for c, v in zip(cols.values(), (r["row_id"], at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)] + length)):
                        c.append(v)
            yield _arrow(cols, types)

    rows = phrases.where("kind = 'p'").select("trigger", "phrase", "row_id", "start", "asked").repartition("trigger").sortWithinPartitions("trigger")
    ordered = rows.mapInArrow(run, "row_id bigint, starts array<bigint>, ends array<bigint>")
    windows = phrases.where("kind = 'h'").select("row_id", "start", "asked", F.posexplode(F.arrays_zip("high", "low")).alias("k", "digest"))
    windows = windows.select("row_id", (F.col("start") + F.col("k")).alias("at"), "asked", F.col("digest.high").alias("high"), F.col("digest.low").alias("low"))
    again = windows.groupBy("high", "low").count().where("count > 1").select("high", "low")
    dealt = windows.where("asked").join(again, ["high", "low"], "left_semi").groupBy("row_id").agg(F.collect_list("at").alias("starts"))
    return ordered.unionByName(dealt.select("row_id", "starts", F.transform("starts", lambda a: a + length).alias("ends")))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs that the spans cover."""
    out, end, runs = [], -1, 0
    for a, b in sorted(spans):
        if a > end:
            out.append(raw[max(end, 0) : a])
            runs += 1
        end = max(end, b)
    return b"".join([*out, raw[max(end, 0) :]]), runs


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary; null where nothing was removed), for every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    parsed = _parsed(docs, length, seed)
    each = parsed.where("kind = 'd'")
    texts = parsed.where("kind = 't'").select("row_id", "key", "text")
    # of equal texts that several tasks parsed, one is asked; their phrases stand in several places, so they repeat as a whole
    copied = each.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n")).where("copies > 1")
    phrases = _phrases(texts, _decided(parsed.where("kind = 'e'")), length, seed)
    more = written(_compared(phrases, length), "compared").groupBy(F.col("row_id").alias("more_of")).agg(F.flatten(F.collect_list("starts")).alias("more_starts"), F.flatten(F.collect_list("ends")).alias("more_ends"))
    held = phrases.where("kind = 't'").select("row_id", "key", "text", "starts", "ends")
    held = held.join(copied.select(F.col("key").alias("copied_key")), F.col("key") == F.col("copied_key"), "left_anti")
    held = held.join(more, F.col("row_id") == F.col("more_of"), "left").select("key", "text", "starts", "ends", "more_starts", "more_ends")

    def run(batches):
        types = {"removed_key": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "new_sha256": pa.string(), "kept": pa.binary()}
        for batch in slices(batches, "text", 2 << 20):
            cols: dict[str, list] = {c: [] for c in types}
            for row in batch.to_pylist():
                raw = row["text"].encode()
                kept, runs = kept_bytes(raw, [*zip(row["starts"], row["ends"]), *zip(row["more_starts"] or [], row["more_ends"] or [])])
                if runs:
                    for c, v in zip(cols.values(), (row["key"], len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept)):
                        c.append(v)
            yield _arrow(cols, types)

    removed = held.mapInArrow(run, "removed_key binary, n_removed bigint, n_spans bigint, new_sha256 string, kept binary")
    none = F.lit("").cast("binary")
    removed = removed.unionByName(copied.select(F.col("key").alias("removed_key"), F.col("n").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(none, 256).alias("new_sha256"), none.alias("kept")))
    out = each.select("doc_id", "n_bytes", "sha256", "key").join(removed, F.col("key") == F.col("removed_key"), "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("new_sha256", "sha256").alias("kept_sha256"), "kept")


def op10_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op10_repeat_removal": op10_repeat_removal}
ORACLES: dict[str, str] = {}
