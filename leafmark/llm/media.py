"""Media columns: bytes kept as 8-bit WAV samples, and spectral-peak pair fingerprints.

`encode` takes a text as UTF-8 (null: empty), appends bytes 0 up to a positive multiple of 64 and stores the
payload as the samples of a mono 8-bit WAV file, one byte a sample, written by the wave module: column media.
`features` reads the files by the wave module and fingerprints the samples by a short-time Fourier transform
(Hann window of 512 samples, hop 256, the last frame padded with the middle value): in each of four frequency
bands of a frame the strongest bin is a peak if no neighbouring frame (two on either side) has a stronger one
in the band; each peak is paired with the next one of its frame and with the next three of later frames at most 63
frames on. A pair gives the code bin1 * 2**15 + bin2 * 2**6 + frames between, stored with its frame as a time-coded
array. Frames are transformed in blocks of a fixed number, so memory does not grow with a text, and equal files
have equal fingerprints wherever they stand.

Edge cases: null and empty texts give 64 bytes 0; a null media column gives nulls; of equally strong bins of a band the lowest is
taken, and equally strong peaks of neighbouring frames both stay; repeated rows repeat; an empty table gives an empty one; extra
columns are ignored, whatever their names. A very long text is held with its file, one text at a time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, slices, table

RATE = 8000
UNIT = 64
FRAME, HOP = 512, 256
BANDS = (2, 16, 48, 112, 257)
REACH, FAN = 63, 3
_BLOCK = 512
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float64)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.setnframes(len(samples))
        w.writeframesraw(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the spectral peaks, in order of frame, then band."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    bins, power = np.zeros((n, 4), np.int64), np.zeros((n, 4))
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        part = x[a * HOP : (b - 1) * HOP + FRAME]
        full = np.zeros((b - a - 1) * HOP + FRAME)
        full[: len(part)] = part.astype(np.float64) - 128
        frames = np.lib.stride_tricks.sliding_window_view(full, FRAME)[::HOP]
        spectrum = np.fft.rfft(frames * _WINDOW, axis=1)
        strength = spectrum.real**2 + spectrum.imag**2
        for k in range(4):
            own = strength[:, BANDS[k] : BANDS[k + 1]]
            at = own.argmax(axis=1)
            bins[a:b, k] = at + BANDS[k]
            power[a:b, k] = own[np.arange(b - a), at]
    edged = np.full((n + 4, 4), -1.0)
    edged[2:-2] = power
    top = np.maximum(np.maximum(edged[:-4], edged[1:-3]), np.maximum(edged[3:-1], edged[4:]))
    frame, band = np.nonzero((power >= top) & (power > 1e-6))
    return frame, bins[frame, band]


def pairs(frame: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The time-coded array of the peaks: frames and pair codes."""
    later = np.searchsorted(frame, frame, "right")
    times, codes = [], []
    for step in range(-1, FAN):
        to = later + step if step >= 0 else np.arange(1, len(frame) + 1)
        ok = np.flatnonzero(to < (len(frame) if step >= 0 else later))
        ok = ok[frame[to[ok]] - frame[ok] <= REACH]
        times.append(frame[ok])
        codes.append((freq[ok] << 15) | (freq[to[ok]] << 6) | (frame[to[ok]] - frame[ok]))
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order], code[order]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes long (unpadded) and media binary (the WAV file)."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            media, sizes = [], []
            for t in column(batch, "text").to_pylist():
                raw, n = payload(t)
                media.append(to_wav(raw))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return out.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def features(stored: DataFrame) -> DataFrame:
    """For each WAV file: digests of what is read back, the file's own, and the fingerprint (times and codes)."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "media"):
            out: list[list] = [[] for _ in range(7)]
            for file in column(batch, "media").to_pylist():
                if file is None:
                    row = (None,) * 7
                else:
                    raw = from_wav(file)
                    time, code = pairs(*peaks(raw))
                    row = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), time, code)
                for c, v in zip(out, row):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *(pa.array(v, t) for v, t in zip(out, types))], names=names)

    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, times array<int>, codes array<int>")


def op6_media_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features(encode(table(spark, sf_dir, "documents")))
    joined = "concat_ws(',', transform(arrays_zip(times, codes), x -> concat(hex(x.times), ':', hex(x.codes))))"
    return found.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", f"{joined} AS feature")


QUERIES = {"op6_media_fingerprint": op6_media_fingerprint}
ORACLES: dict[str, str] = {}
