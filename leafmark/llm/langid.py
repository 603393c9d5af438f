"""Language identification by prediction by partial matching.

For each language a context tree over bytes of orders 0 to 3 is counted on all labelled training texts: tasks count the sequences
of four bytes, which are added up by language, and the lower orders are their sums. The driver and each worker hold the distinct
sequences, not the texts. (With `sample_docs`, on that many distinct rows and about `sample_bytes` bytes a language, the smallest hashes of
id and text; a language with any training text has one at least.) A byte costs -log2(c / (n + q)) in the longest
context in which it was seen, plus -log2(q / (n + q)) for each longer known context that it escapes from (n: the
context's count, q: its distinct successors, method C); contexts never seen cost nothing, and below order 0 a byte
costs 8 bits. The statistics are frozen: the cost of a byte depends on it and the three bytes before it alone, so the trees
of all languages are flattened into tables from byte sequences to a row of costs, one for each language, and
whole texts are scored by table lookups, in pieces of `PIECE` bytes with the three before them. The predicted language has the
shortest exact code length (ties: the first in string order); the score is its posterior under equal priors. `rejected` names the
rows that are in none of the languages: their best code is far longer than that of training texts.

Edge cases: null texts and texts without a letter (Unicode category L) are `und` with score 0; without any training row
every text is `und`. Repeated rows repeat, and count as often (once in a sample); an empty table gives an empty one; extra columns
stay, but columns of the names that predict() adds are replaced. A very long text takes its bytes and a piece's costs at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, crc_mod, quantile, slices, table

ORDER = 3
SAMPLE_BYTES = 1_500_000
#: Bytes of a text that are scored at once, and costs (bytes times languages) that are held at once.
PIECE, COSTS = 1 << 14, 1 << 21
#: Bytes of texts that are counted at once, and sequences that a task holds before it hands their counts on.
COUNTED, HELD = 1 << 20, 1 << 22


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class HashIndex:
    """uint32 keys to row numbers: open addressing, looked up in arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.slot = np.zeros(1 << bits, np.int32)
        at, todo = self._home(self.keys), np.arange(len(keys))
        while len(todo):
            free = self.slot[at] == 0
            self.slot[at[free]] = todo[free] + 1  # of several for one slot the last stays
            left = self.slot[at] != todo + 1
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(codes), -1, np.int32)
        at = self._home(codes)
        row = self.slot[at] - 1
        todo = np.flatnonzero((row >= 0) & (self.keys[row] != codes))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            row[todo] = self.slot[at[todo]] - 1
            todo = todo[(row[todo] >= 0) & (self.keys[row[todo]] != codes[todo])]
        return row


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-cased texts with the three before each as uint32, and where each text's begin."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(parts), np.uint8).astype(np.uint32)
    code = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(np.concatenate(([0], sizes[:-1] + 3)))
    keep = np.ones(len(code), bool)
    for gap in (starts[1:] - 3, starts[1:] - 2, starts[1:] - 1):
        keep[gap] = False
    return code[keep], np.cumsum(np.concatenate(([0], sizes)))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces with the three before each as uint32, and how many are of each; a piece's first three bytes are context only."""
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    code = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    sizes = np.array([len(p) - 3 for p in parts], np.int64)
    begin = np.cumsum(sizes + 3) - (sizes + 3)
    keep = np.ones(len(code), bool)
    for gap in range(3):
        keep[begin[1:] - 3 + gap] = False
    return code[keep], sizes


def _folded(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    found, first = np.unique(codes[order], return_index=True)
    return found, np.add.reduceat(n[order], first) if len(n) else n


class Trees:
    """The languages' context trees, flattened to tables of costs in bits."""

    def __init__(self, samples: dict[str, list[str]]):
        self._count({k: np.unique(_codes(texts)[0], return_counts=True) for k, texts in samples.items()})

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
        """The trees of each language's sequences of four bytes (uint32, ascending) and how often they stand in its texts."""
        trees = cls.__new__(cls)
        trees._count(counts)
        return trees

    def _count(self, every: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(every)
        width = len(self.languages)
        seen = [every[x] for x in self.languages]
        cost = np.full((256, width), 8.0)
        self.dense: list[np.ndarray] = []
        self.keys: list[HashIndex] = []
        self.rows: list[np.ndarray] = []
        self.escape_keys: list[HashIndex] = []
        self.escape: list[np.ndarray] = []
        if not width:
            return
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            counts = [_folded(codes & mask, n) for codes, n in seen]
            contexts = []
            for codes, n in counts:
                ctx, first = np.unique(codes >> 8, return_index=True)
                total, kinds = np.add.reduceat(n, first) if len(n) else n, np.diff(np.append(first, len(codes)))
                contexts.append((ctx, total, kinds))
            if order < 2:
                size = 256 ** (order + 1)
                lower = cost[np.arange(size) & (size // 256 - 1 if order else 255)] if order else cost
                cost = lower.copy()
                for k, ((codes, n), (ctx, total, kinds)) in enumerate(zip(counts, contexts)):
                    own = np.arange(size) >> 8
                    at = np.minimum(np.searchsorted(ctx, own), max(len(ctx) - 1, 0))
                    if not len(ctx):
                        continue
                    known = ctx[at] == own
                    cost[known, k] += -np.log2(kinds[at[known]] / (total[at[known]] + kinds[at[known]]))
                    at = np.searchsorted(ctx, codes >> 8)
                    cost[codes, k] = -np.log2(n / (total[at] + kinds[at]))
                self.dense.append(cost)
                continue
            every = np.unique(np.concatenate([c for c, _ in counts]))
            above = np.unique(np.concatenate([c for c, _, _ in contexts]))
            escape = np.zeros((len(above), width))
            for k, (ctx, total, kinds) in enumerate(contexts):
                escape[np.searchsorted(above, ctx), k] = -np.log2(kinds / (total + kinds))
            rows = self._lower(order - 1, every) + (escape[np.searchsorted(above, every >> 8)] if len(every) else 0)
            for k, ((codes, n), (ctx, total, kinds)) in enumerate(zip(counts, contexts)):
                at = np.searchsorted(ctx, codes >> 8)
                rows[np.searchsorted(every, codes), k] = -np.log2(n / (total[at] + kinds[at]))
            self.keys.append(HashIndex(every))
            self.rows.append(rows)
            self.escape_keys.append(HashIndex(above))
            self.escape.append(escape)

    def _lower(self, order: int, codes: np.ndarray) -> np.ndarray:
        """Costs at this order and below; codes hold the byte and at least the bytes before it that count."""
        if order < 2:
            return self.dense[order][codes & np.uint32(256 ** (order + 1) - 1)]
        k = order - 2
        codes = codes & np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else codes
        row = self.keys[k](codes)
        miss = np.flatnonzero(row < 0)
        out = self.rows[k][row] if len(self.rows[k]) else np.zeros((len(codes), len(self.languages)))
        if len(miss):
            out[miss] = self._lower(order - 1, codes[miss])
            up = self.escape_keys[k](codes[miss] >> 8)
            known = up >= 0
            out[miss[known]] += self.escape[k][up[known]]
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        return self.measured([t.lower().encode("utf-8", "surrogatepass") for t in texts])

    def measured(self, raws: list[bytes]) -> np.ndarray:
        """Bits of each lower-cased text, piece by piece; a text's pieces are the same whatever stands beside it."""
        out = np.zeros((len(raws), len(self.languages)))
        limit = max(PIECE, COSTS // max(1, len(self.languages)))
        owner, parts, held = [], [], 0

        def score() -> None:
            code, sizes = _joined(parts)
            costs = self._lower(ORDER, code)
            np.add.at(out, owner, np.add.reduceat(costs, np.cumsum(sizes) - sizes, axis=0))

        for i, raw in enumerate(raws):
            for a in range(0, len(raw), PIECE):
                parts.append(raw[a - 3 : a + PIECE] if a else b"\0\0\0" + raw[:PIECE])
                owner.append(i)
                held += len(parts[-1])
                if held >= limit:
                    score()
                    owner, parts, held = [], [], 0
        if parts:
            score()
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits per byte) of each text."""
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if asked and self.languages:
            raws = [texts[i].lower().encode("utf-8", "surrogatepass") for i in asked]
            for i, raw, row in zip(asked, raws, self.measured(raws)):
                best = int(np.argmin(row))
                out[i] = (self.languages[best], float(1 / np.exp2(np.clip(row[best] - row, -1000, 0)).sum()), float(row[best] / len(raw)))
        return out


def _counted(rows: DataFrame) -> DataFrame:
    """k, code and n of rows (k, t): how often each sequence of four bytes stands in the texts of k, added up in each task."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for k, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["k", "code", "n"])
            held.clear()

        def count(k: str, parts: list[bytes]):
            codes, n = np.unique(_joined(parts)[0], return_counts=True)
            held[k] = _folded(np.concatenate([held[k][0], codes]), np.concatenate([held[k][1], n])) if k in held else (codes, n)
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield from out()

        parts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in slices(batches, "t", COUNTED):
            for k, text in zip(column(batch, "k").to_pylist(), column(batch, "t").to_pylist()):
                raw = text.lower().encode("utf-8", "surrogatepass")
                parts.setdefault(k, []), sizes.setdefault(k, 0)
                for at in range(0, max(1, len(raw)), COUNTED):
                    parts[k].append(raw[at - 3 : at + COUNTED] if at else b"\0\0\0" + raw[:COUNTED])
                    sizes[k] += len(parts[k][-1])
                    if sizes[k] >= COUNTED:
                        yield from count(k, parts[k])
                        parts[k], sizes[k] = [], 0
        for k in parts:
            if parts[k]:
                yield from count(k, parts[k])
        # a language whose texts are all empty has a row too
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), pa.array([0] * len(parts), pa.int64()), pa.array([0] * len(parts), pa.int64())], names=["k", "code", "n"])

    return rows.mapInArrow(run, "k string, code bigint, n bigint")


def fit(docs: DataFrame, training, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int | None = None, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """The trees of all rows for which the condition `training` holds, or of a bounded sample of them."""
    rows = docs.where(training).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(id_col).cast("string"), text).alias("dice"))
    if sample_docs is None:
        total = _counted(rows.select("k", "t")).groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()
        names = total.column("k").combine_chunks().dictionary_encode()
        which, codes, n = (x.to_numpy(zero_copy_only=False) for x in (names.indices, total.column("code").combine_chunks(), total.column("n").combine_chunks()))
        own = lambda i: (which == i) & (n > 0)
        return Trees.of({k: _folded(codes[own(i)].astype(np.uint32), n[own(i)]) for i, k in enumerate(names.dictionary.to_pylist())})
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("k").agg(F.approx_count_distinct("dice"), F.min("dice")).collect()}
    if not found:
        return Trees({})
    # the smallest hashes: about half as many again as wanted, and the least one in any case
    spread = lambda n: min(1.0, 1.5 * sample_docs / max(1, n))
    bound = F.create_map(*[x for k, (n, least) in sorted(found.items()) for x in (F.lit(k), F.lit(max(least, min(int(spread(n) * 2**64) - 2**63, 2**63 - 1))))])
    near = rows.where(F.col("dice") <= bound[F.col("k")])
    left, taken, chosen = dict.fromkeys(found, sample_docs), dict.fromkeys(found, 0), []
    for d, k, n in sorted(tuple(r) for r in near.select("dice", "k", F.octet_length("t")).distinct().collect()):
        if left[k] > 0 and (taken[k] + n <= sample_bytes or not taken[k]):
            left[k] -= 1
            taken[k] += n
            chosen.append(d)
    samples: dict[str, list[str]] = {}
    texts = near.where(F.col("dice").isin(chosen)).groupBy("k", "dice").agg(F.min("t").alias("t"))
    for k, t in sorted(tuple(r) for r in texts.select("k", "t").collect()):
        samples.setdefault(k, []).append(t)
    return Trees(samples)


def predict(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with lang_pred string, score double and bits_per_byte double."""
    held = docs.sparkSession.sparkContext.broadcast(trees)  # a row for each distinct sequence of bytes
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)}).schema

    def run(batches):
        model = held.value
        for batch in slices(batches, text, 1 << 19):
            found = model.predict(column(batch, text).to_pylist())
            new = [pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64()), pa.array([r[2] for r in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    return docs.mapInArrow(run, schema)


#: The share of training texts whose cost is usual, and bits that any text may need beyond its bound.
USUAL_SHARE, START_BITS = 0.99, 256


def usual_cost(found: DataFrame, training, text: str = "text", lang: str = "lang") -> float | None:
    """The bits a byte within which the best language codes nearly all labelled training texts of found, a table of predict(); None without any."""
    rows = found.where(training).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col("lang_pred") != "und"))
    return quantile(rows.select("bits_per_byte"), USUAL_SHARE)


def rejected(usual: float | None, text: str = "text"):
    """Whether a row of predict() has no language of the trees: no letter, or a code that is far longer than usual. The bound lies halfway
    between the usual cost and the 8 bits of a byte that says nothing; START_BITS keep short texts and single odd passages."""
    none = F.col("lang_pred") == "und"
    if usual is None:
        return none
    size = F.octet_length(text)
    return none | (F.col("bits_per_byte") * size > F.lit((usual + 8) / 2) * size + START_BITS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.select("doc_id", "text", "lang"), crc_mod("doc_id", 5) != 0)
    found = predict(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
