"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of three orders and the uniform one. With c the counts of the training documents,
P1(w) = l1 c(w) / N + (1 - l1) / (V + 1),
P2(w | v) = l2 c(v w) / c(v) + (1 - l2) P1(w),
P(w | u v) = l3 c(u v w) / c(u v) + (1 - l3) P2(w | v);
l3 depends on the bucket of the context's frequency c(u v) (the floor of log2(c + 1)), l2 on that of c(v); where a context has
not been seen, its weight is 0. The weights are learned by expectation-maximisation on a deleted part of the training
documents: the estimates there leave its counts out, and each round sums up the expectations over its exact counts.
The final estimates count all training documents. Tokens are the words between ASCII white space, A-Z lower-cased, and one
end after each document; two start marks come before the first token.

No count table is broadcast or joined row by row. Documents are dealt by a hash to blocks of about `BLOCK_BYTES`, which are
written once:
1. a block counts its distinct words, bigrams and trigrams and sends them, sorted, to shards by hash;
2. a shard adds up the counts of all blocks and answers each block, in the order asked;
3. the deleted blocks, with their answers, become a written table of distinct (counts of token and contexts, times), on
   which every round of EM is one aggregation by bucket pair;
4. all blocks, with their answers and the weights, are scored.
An n-gram is sent once for each block, so frequent ones load no shard. Words are 64-bit hashes; longer n-grams have hashes of as many
bits as keep the chance that one meets any other below 2^-20 at every size of the corpus (56 at most, from about 250 GB on).

Edge cases: null is the empty text (one token, the end); repeated rows count and score each; without training documents all
counts are 0 and both scores use N = V = 0; without deleted documents default weights hold; an empty table
gives an empty one; extra columns are ignored, whatever their names. A very long text is in one block, whose tokens and
distinct n-grams its task holds: hashes, 32-bit numbers and counts; of the words those of one text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, crc_mod, grouped_rows, slices, table, written

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
KEPT, DELETED, OTHER = 0, 1, 2
BUCKETS = 40
#: Tokens scored at once, so that the terms of the mixture stay small.
PART = 1 << 16
#: Weights of trigram, bigram and unigram before learning.
DEFAULT = (0.4, 0.5, 0.9)
#: EM stops after so many rounds, or when no weight moves by more than the step.
ROUNDS, STEP = 25, 1e-4
#: The kinds of n-grams: words, bigrams, trigrams.
KINDS = "ubt"
_END, _START = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def hash_bits(size: int) -> int:
    """Bits of n-gram hashes for a corpus of so many bytes, which has a quarter as many n-grams at most."""
    return min(56, max(44, 20 + (size // 4).bit_length()))


class Block:
    """The tokens of a block's documents: distinct words, bigrams and trigrams in order, and each token's number in them."""

    def __init__(self, texts: list[str | None], bits: int = 56):
        import xxhash

        said = []  # hashes: the words of one text are held at a time
        for t in texts:
            w = tokens(t)
            said.append(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))
        self.sizes = np.array([len(w) + 1 for w in said], np.int64)
        self.ends = np.cumsum(self.sizes)
        n = int(self.ends[-1]) if len(said) else 0
        word = np.empty(n, np.uint64)
        for end, w in zip(self.ends.tolist(), said):
            word[end - 1 - len(w) : end - 1] = w
        word[self.ends - 1] = _END
        del said
        self.first = np.zeros(n, bool)
        self.first[self.ends - self.sizes] = True
        own = _mix(word)
        self.keys, self.number, self.times = {}, {}, {}
        key, before = word, None
        del word
        for kind in KINDS:
            if before is not None:  # the n-gram that ends one token earlier, and this word
                earlier = np.empty_like(before)
                earlier[1:] = before[:-1]
                earlier[self.first] = _START
                key = _mix(earlier * np.uint64(0xD6E8FEB86659FD93) + own) >> np.uint64(64 - bits)
                del earlier, before
            self.keys[kind], number, self.times[kind] = np.unique(key, return_inverse=True, return_counts=True)
            self.number[kind] = number.astype(np.uint32)
            before = key
        self.end = int(np.searchsorted(self.keys["u"], _END))

    def counts(self, told: dict[str, np.ndarray]) -> list[np.ndarray]:
        """c(u v w), c(u v), c(v w), c(v) and c(w) of each token, from the counts of the distinct n-grams."""
        three, two, one = (told[k][self.number[k]] for k in "tbu")

        def context(own: np.ndarray) -> np.ndarray:
            out = np.empty_like(own)
            out[1:] = own[:-1]
            out[self.first] = told["u"][self.end]  # start marks are as frequent as the end
            return out

        return [three, context(two), two, context(one), one]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _squeeze(*parts: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _open(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _pack_request(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts; byte by byte in planes."""
    return _squeeze(_planes(np.diff(keys, prepend=np.uint64(0))), _planes(times.astype(np.uint32)))


def _unpack_request(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _open(blob)
    n = len(raw) // 12
    return np.cumsum(_from_planes(raw[: 8 * n], "<u8"), dtype=np.uint64), _from_planes(raw[8 * n :], "<u4")


def _shard_of(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(shards)) >> np.uint64(32)


def _dealt(docs: DataFrame, role: Column, blocks: int) -> DataFrame:
    """The written table block, kind "t", shard and blob: the documents of each block, as compressed record batches."""
    share = {KEPT: 0.6, DELETED: 0.2, OTHER: 0.2}
    rows = docs.withColumn("role", role.cast("bigint"))
    n = F.lit(max(1, round(blocks * share[OTHER]))).cast("bigint")
    n = F.when(F.col("role") == KEPT, F.lit(max(1, round(blocks * share[KEPT]))).cast("bigint")).otherwise(n)
    rows = rows.select("doc_id", "text", (F.pmod(F.xxhash64(F.monotonically_increasing_id()), n) * 3 + F.col("role")).alias("block"))  # by row, as equal rows may be many

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
        for batch in slices(batches, "text", BLOCK_BYTES):
            block = column(batch, "block").to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)] if len(order) else []
            held = pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text")], names=["doc_id", "text"])
            for a, b in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held.schema, options=options) as w:
                    w.write_batch(held.take(pa.array(order[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array([block[order[a]]], pa.int64()), pa.array(["d"]), pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "kind", "shard", "blob"])

    return written(rows.mapInArrow(run, "block bigint, kind string, shard int, blob binary"), "dealt")


def _by_block(rows: DataFrame, blocks: int) -> DataFrame:
    """A partition takes a block or a few, at any size of the input."""
    return rows.repartition(max(blocks, 8), "block").sortWithinPartitions("block")


def _documents(rows: list[dict]) -> tuple[list[pa.Array], list[str | None]]:
    ids, texts = [], []
    for r in rows:
        if r["kind"] == "d":
            with pa.ipc.open_stream(r["blob"]) as stream:
                for batch in stream:
                    ids.append(batch.column(0))
                    texts += batch.column(1).to_pylist()
    return ids, texts


def _requests(dealt: DataFrame, blocks: int, shards: int, bits: int) -> DataFrame:
    """block, kind (u: words, b: bigrams, t: trigrams), shard, blob."""

    def run(batches):
        for block, rows in grouped_rows(batches, "block"):
            own = Block(_documents(rows)[1], bits)
            out = []
            for kind in KINDS:
                keys, times = own.keys[kind], own.times[kind]
                cuts = np.searchsorted(_shard_of(keys, 64 if kind == "u" else bits, shards), np.arange(shards + 1))
                out += [(kind, s, _pack_request(keys[a:b], times[a:b])) for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["block", "kind", "shard", "blob"])

    return _by_block(dealt, blocks).mapInArrow(run, dealt.schema)


def _answers(requests: DataFrame, shards: int) -> DataFrame:
    """The blocks' requests answered (the counts of all training documents, and without the deleted ones), and for each shard
    a row of block -1 with its tokens and distinct words."""

    def run(batches):
        def held():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 1) for c in batch.columns], names=batch.schema.names)

        for (shard, kind), rows in _by_kind(grouped_rows(held(), "shard")):
            parts = [_unpack_request(r["blob"]) for r in rows]
            keys, times = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
            sizes = [len(p[0]) for p in parts]
            role = np.repeat(np.array([r["block"] % 3 for r in rows], np.int8), sizes)
            del parts
            order = np.argsort(keys, kind="stable")
            head = np.concatenate(([True], np.diff(keys[order]) != 0))
            at = np.flatnonzero(head)
            number = np.empty(len(keys), np.int64)
            number[order] = np.cumsum(head) - 1
            kept = np.add.reduceat(np.where(role == KEPT, times, 0)[order], at)
            every = kept + np.add.reduceat(np.where(role == DELETED, times, 0)[order], at)
            out, begun = [], 0
            for r, n in zip(rows, sizes):
                own = number[begun : begun + n]
                begun += n
                out.append((r["block"], kind, _squeeze(_planes(every[own].astype("<u4")), _planes(kept[own].astype("<u4")) if r["block"] % 3 == DELETED else b"")))
            if kind == "u":
                out.append((-1, "n", np.array([every.sum(), (every > 0).sum(), kept.sum(), (kept > 0).sum()], "<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([shard] * len(out), pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["block", "kind", "shard", "blob"])

    rows = requests.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    return written(rows.mapInArrow(run, requests.schema), "ngram-answers")


def _by_kind(groups):
    for shard, rows in groups:
        for kind in KINDS:
            own = [r for r in rows if r["kind"] == kind]
            if own:
                yield (shard, kind), own


def _told(rows: list[dict], deleted: bool) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The counts of a block's distinct n-grams, in order, by kind: of all training documents, and without the deleted ones."""
    every, kept = {}, {}
    for kind in KINDS:
        parts = [_open(r["blob"]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["shard"])]
        half = [len(x) // 2 if deleted else len(x) for x in parts]
        every[kind] = np.concatenate([_from_planes(x[:n], "<u4") for x, n in zip(parts, half)])
        kept[kind] = np.concatenate([_from_planes(x[n:], "<u4") for x, n in zip(parts, half)]) if deleted else every[kind]
    return every, kept


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


_COUNTS = ("c3", "n3", "c2", "n2", "c1")


def _held_out(dealt: DataFrame, answers: DataFrame, blocks: int, bits: int) -> DataFrame:
    """The written table b3, b2 (buckets), c3, n3, c2, n2, c1 (counts without the deleted documents) and times, over the
    tokens of the deleted blocks; equal ones of a block are one row."""

    def run(batches):
        for _, rows in grouped_rows(batches, "block"):
            own = Block(_documents(rows)[1], bits)
            told = _told(rows, True)[1]
            rows.clear()
            found = own.counts(told)
            del own, told
            order = np.lexsort(found)
            found = [x[order] for x in found]
            new = np.zeros(len(order), bool)
            new[:1] = True
            for x in found:
                new[1:] |= x[1:] != x[:-1]
            head = np.flatnonzero(new)
            found = [x[head].astype(np.int64) for x in found]
            columns = [_bucket(found[1]).astype(np.int32), _bucket(found[3]).astype(np.int32), *found, np.diff(np.append(head, len(order)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["b3", "b2", *_COUNTS, "times"])

    deleted = F.pmod("block", F.lit(3)) == DELETED
    rows = dealt.where(deleted).unionByName(answers.where(deleted & (F.col("block") >= 0)))
    return written(_by_block(rows, max(8, blocks // 4)).mapInArrow(run, "b3 int, b2 int, c3 bigint, n3 bigint, c2 bigint, n2 bigint, c1 bigint, times bigint"), "held-out")


def expectations(held: DataFrame, weights: np.ndarray, total: int, kinds: int) -> list[tuple[int, int, int, float, float, float]]:
    """(b3, b2, tokens, expected trigram, bigram and unigram uses), one row for each pair of buckets that occurs."""
    of = lambda k, b: F.element_at(F.array(*(F.lit(float(x)) for x in weights[:, k])), F.col(b) + 1)
    share = lambda c, n: F.when(n > 0, c / n).otherwise(0.0)
    l3, l2, l1 = of(0, "b3"), of(1, "b2"), float(weights[0, 2])
    rows = held.withColumns({"m3": share(F.col("c3"), F.col("n3")) * l3, "r3": 1 - l3, "l2": l2})
    rows = rows.withColumns({"m2": F.col("r3") * F.col("l2") * share(F.col("c2"), F.col("n2")), "r2": F.col("r3") * (1 - F.col("l2"))})
    rows = rows.withColumns({"m1": F.col("r2") * (l1 / max(total, 1)) * F.col("c1"), "m0": F.col("r2") * ((1 - l1) / (kinds + 1))})
    rows = rows.withColumn("per", F.col("times") / (F.col("m3") + F.col("m2") + F.col("m1") + F.col("m0")))
    found = rows.groupBy("b3", "b2").agg(F.sum("times").alias("n"), *(F.sum(F.col("per") * F.col(m)).alias(m) for m in ("m3", "m2", "m1")))
    return sorted(tuple(r) for r in found.collect())  # BUCKETS squared rows at most


def started() -> np.ndarray:
    """Default weights by bucket: of trigram, bigram, unigram; unseen contexts (bucket 0) have none."""
    out = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    out[0, :2] = 0.0
    return out


def learn_weights(held: DataFrame, total: int, kinds: int) -> np.ndarray:
    """The weights (trigram, bigram, unigram) of each bucket, by expectation-maximisation; buckets without held-out tokens
    take those of all tokens with a seen context."""
    weights = started()
    for _ in range(ROUNDS):
        found = np.array(expectations(held, weights, total, kinds)).reshape(-1, 6)
        if not len(found):
            break
        b3, b2 = found[:, 0].astype(int), found[:, 1].astype(int)
        n, e3, e2, e1 = found[:, 2:].T
        new = weights.copy()
        for k, b, used, of in ((0, b3, e3, n), (1, b2, e2, n - e3)):
            top, base = np.bincount(b, used, BUCKETS), np.bincount(b, of, BUCKETS)
            pooled = top[1:].sum() / base[1:].sum() if base[1:].sum() > 1e-9 else DEFAULT[k]
            new[:, k] = np.clip(np.where(base > 1e-9, top / np.maximum(base, 1e-9), pooled), 0, 1 - 1e-6)
            new[0, k] = 0.0
        rest = (n - e3 - e2).sum()
        new[:, 2] = np.clip(e1.sum() / rest, 0, 1 - 1e-6) if rest > 1e-9 else DEFAULT[2]
        moved = np.abs(new - weights).max()
        weights = new
        if moved < STEP:
            break
    return weights


def mixed(counts: list[np.ndarray], weights: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """The probability of each token."""
    c3, n3, c2, n2, c1 = counts
    l3, l2, l1 = weights[_bucket(n3), 0], weights[_bucket(n2), 1], weights[0, 2]
    one = l1 * (c1 / float(max(total, 1))) + (1 - l1) / (kinds + 1)
    two = l2 * (c2 / np.maximum(n2, 1)) + (1 - l2) * one
    return l3 * (c3 / np.maximum(n3, 1)) + (1 - l3) * two


def _scored(dealt: DataFrame, answers: DataFrame, blocks: int, bits: int, weights: np.ndarray, total: int, kinds: int, id_type: str) -> DataFrame:
    def run(batches):
        for block, rows in grouped_rows(batches, "block"):
            ids, texts = _documents(rows)
            if not texts:
                continue
            own, n = Block(texts, bits), len(texts)
            told = _told(rows, block % 3 == DELETED)[0]
            rows.clear()
            del texts
            found, sizes = own.counts(told), own.sizes
            starts = own.ends - sizes
            del own, told
            base, score_ = np.empty(len(found[4])), np.empty(len(found[4]))
            for at in range(0, len(base), PART):
                part = [x[at : at + PART] for x in found]
                base[at : at + PART] = np.log10((part[4] + 0.5) / (total + 0.5 * (kinds + 1)))
                score_[at : at + PART] = np.log10(mixed(part, weights, total, kinds))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array([block % 3 == OTHER] * n), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((found[4] > 0).astype(np.int64), starts), pa.int64()), pa.array([total] * n, pa.int64()), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score_, starts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = _by_block(dealt.unionByName(answers.where("block >= 0")), blocks)
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(docs: DataFrame, training: Column, deleted: Column, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: held_out (not a training one), counts and log10 scores.

    training: the rows to learn from; deleted: those of them whose counts are left out to learn the weights.
    """
    role = F.when(training, F.when(deleted, DELETED).otherwise(KEPT)).otherwise(OTHER)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), role.alias("role"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    dealt = _dealt(docs, F.col("role"), blocks)
    shards, bits = max(4, -(-size // shard_bytes)), hash_bits(size)
    answers = _answers(_requests(dealt, blocks, shards, bits), shards)
    stats = np.zeros(4, np.int64)
    for (blob,) in answers.where("kind = 'n'").select("blob").collect():  # 32 bytes a shard
        stats += np.frombuffer(blob, "<i8")
    total, kinds, kept_total, kept_kinds = stats.tolist()
    weights = learn_weights(_held_out(dealt, answers, blocks, bits), kept_total, kept_kinds)
    return _scored(dealt, answers, blocks, bits, weights, total, kinds, docs.schema["doc_id"].dataType.simpleString())


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 5)
    return score(table(spark, sf_dir, "documents"), training=fold != 1, deleted=fold == 0)


QUERIES = {"op4_deleted_interpolation": op4_deleted_interpolation}
ORACLES: dict[str, str] = {}
