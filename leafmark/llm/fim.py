"""Fill-in-the-middle transformation with succinct boundary bitvectors.

`transform` takes the bytes of a slice of texts (about 4 MB, one text at least) as one string of bits: a bit is set where a unit
(line) ends. The bits are packed, with a directory of set bits before each block of 512. The directory's differences at a text's ends
give its number of units; `Bits.select` on two ranks gives the bytes at which prefix and middle end; `Bits.rank` over a second
bitvector, of bytes that begin a code point, turns these into numbers of characters. Where to cut and which form to take comes from the
sha256 of seed and id alone, so a lost task gives the same rows again. `restore` rebuilds the texts from output and form.

Edge cases: a null text is the empty one; empty texts and texts that contain a marker stay plain (counts of characters null); a null id
hashes as the empty string; rows that repeat an id are cut alike; a text without a line end is one unit; only `\\n` ends a line; a very
long text is a slice of its own (about four times its size in memory); an empty table gives an empty one; extra columns are carried
through unless they have the names of the results, which replace them. There is nothing that ties: equal cuts give an empty middle.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, slices, table

SEED = 7
#: Of 100 texts, how many are transformed, and how many of these have the suffix first.
RATE, SPM_RATE = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of packed bits in a block of the directory.
BLOCK = 64
_RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")


class Bits:
    """A packed bitvector with a directory: the number of set bits before each block."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.blocks = np.zeros((len(packed) // BLOCK + 1, BLOCK), np.uint8)
        self.blocks.reshape(-1)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        at = np.asarray(at, np.int64)
        block, inner = np.divmod(at, 8 * BLOCK)
        byte, bit = np.divmod(inner, 8)
        counts = np.bitwise_count(self.blocks[block]).astype(np.int64)
        whole = (counts * (np.arange(BLOCK) < byte[:, None])).sum(axis=1)
        last = self.blocks[block, byte].astype(np.int64) & ((1 << bit) - 1)
        return self.before[block] + whole + np.bitwise_count(last)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The places of the k-th set bits, k from 1."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, "left") - 1
        left = k - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.blocks[block]), axis=1, dtype=np.int64)
        byte = (upto < left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, upto[np.arange(len(k)), np.maximum(byte - 1, 0)], 0)
        bits = np.unpackbits(self.blocks[block, byte][:, None], axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) < left[:, None]).sum(axis=1)
        return (block * BLOCK + byte) * 8 + bit


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four groups of 8 hexadecimal digits of the id's digest, as numbers."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[i : i + 4]) for i in range(0, 16, 4)]


def _cut(ids: list, texts: pa.Array, seed: int, rate: int, spm_rate: int, markers: tuple[bytes, ...]) -> dict[str, list]:
    """The results' columns for texts that lie in one piece of memory."""
    raw = texts.fill_null("").cast(pa.large_binary())
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = b"".join(raw.to_pylist())
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(whole, np.uint8)
    stops = data == 10
    stops[ends[sizes > 0] - 1] = True
    lines, chars = Bits(stops), Bits((data & 0xC0) != 0x80)
    first = lines.rank(begins)
    n = lines.rank(ends) - first
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    ranks = np.sort(np.stack([h[:, 0] % (n + 1), h[:, 1] % (n + 1)]), axis=0)
    cuts = [begins.copy(), begins.copy()]
    for cut, rank in zip(cuts, ranks):
        some = rank > 0
        cut[some] = lines.select(first[some] + rank[some]) + 1
    at = [chars.rank(x) for x in (begins, *cuts)]
    bare = [s > 0 and not any(m in whole[a:b] for m in markers) for s, a, b in zip(sizes.tolist(), begins.tolist(), ends.tolist())]
    plain = ~np.array(bare, bool) | (h[:, 2] % 100 >= rate)
    spm = h[:, 3] % 100 < spm_rate
    p, s, m = markers
    form, output = [], []
    for is_plain, is_spm, a, b, c, d in zip(plain.tolist(), spm.tolist(), begins.tolist(), cuts[0].tolist(), cuts[1].tolist(), ends.tolist()):
        if is_plain:
            form.append("plain")
            output.append(whole[a:d])
        elif is_spm:
            form.append("spm")
            output.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
        else:
            form.append("psm")
            output.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
    return {
        "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(at[1] - at[0], pa.int64(), mask=plain), "middle_chars": pa.array(at[2] - at[1], pa.int64(), mask=plain),
        "output": pa.array(output, pa.binary()).cast(pa.string()),
    }


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), slice_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs with n, form, prefix_chars, middle_chars and output in place of the text."""
    for a in markers:
        if not a or any(a[k:] == b[: len(a) - k] for b in markers for k in range(1, len(a))) or any(a != b and a in b for b in markers):
            raise ValueError("markers must not be empty, overlap or contain each other")
    known = tuple(m.encode() for m in markers)
    kept = [c for c in docs.columns if c not in (*_RESULT, "text")]
    rows = docs.select(*kept, "text")

    def run(batches):
        for part in slices(batches, "text", slice_bytes):
            found = _cut(column(part, "doc_id").to_pylist(), column(part, "text"), seed, rate, spm_rate, known)
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in kept), *(found[c] for c in _RESULT)], names=[*kept, *_RESULT])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(done: DataFrame, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """The rows of transform with the text that output and form stand for: what lies between the markers, in the order of the text."""
    p, s, m = markers
    psm, spm = (F.split(F.expr(f"substring(output, {len(a) + 1})"), "|".join(_java(x) for x in rest), -1) for a, rest in ((p, (s, m)), (s, (p, m))))
    said = F.when(F.col("form") == "psm", F.concat(psm[0], psm[2], psm[1])).when(F.col("form") == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(F.col("output"))
    return done.withColumn("text", said)


def _java(marker: str) -> str:
    return re.sub(r"([^0-9A-Za-z<>])", r"\\\1", marker)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore(transform(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
),
h AS (SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": SQL}
