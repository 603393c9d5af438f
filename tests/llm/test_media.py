import hashlib
import io
import math
import random
import wave
import zlib

import numpy as np

from leafmark.llm import media
from tests.llm.helpers import awkward, frame


def test_round_trip_and_digests(spark):
    rnd = random.Random(1)
    texts = awkward(rnd)
    got = {r.doc_id: r for r in media.features(media.encode(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        file = media.to_wav(padded)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        with wave.open(io.BytesIO(file)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, padded)
    assert got[4].codes == got[5].codes == got[6].codes
    assert got[0].codes == got[1].codes


def test_a_tone_is_found():
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8).tobytes()
    frames, bins = media.peaks(tone)
    assert (np.bincount(bins).argmax()) == 1000 * media.FRAME // 8000
    time, code = media.pairs(frames, bins)
    assert (np.diff(time) >= 0).all() and len(code) and ((code & 63) <= media.REACH).all()


def test_fingerprints_follow_a_shift():
    rnd = np.random.default_rng(0)
    sound = rnd.integers(0, 256, 40 * media.HOP).astype(np.uint8).tobytes()
    shifted = rnd.integers(0, 256, 8 * media.HOP).astype(np.uint8).tobytes() + sound
    a, b = (set(zip(*(x.tolist() for x in media.pairs(*media.peaks(s))))) for s in (sound, shifted))
    moved = {(t + 8, c) for t, c in a}
    assert len(moved & b) > 0.7 * len(a)


def test_blocks_do_not_change_peaks(monkeypatch):
    sound = np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    one = media.peaks(sound)
    monkeypatch.setattr(media, "_BLOCK", 7)
    assert all((x == y).all() for x, y in zip(one, media.peaks(sound)))


def test_empty_table(spark):
    assert media.features(media.encode(frame(spark, []))).count() == 0


def _plain_fingerprint(samples):
    """By the definition: a discrete Fourier sum for each frame and bin, peaks by looking around, pairs by walking on."""
    x = [b - 128 for b in samples]
    n = max(1, math.ceil((len(x) - 512) / 256) + 1)
    x += [0] * ((n - 1) * 256 + 512 - len(x))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / 512) for k in range(512)]
    bands = ((2, 16), (16, 48), (48, 112), (112, 257))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(512)) / 512)
    best = []
    for f in range(n):
        power = np.abs(turn @ np.array([a * b for a, b in zip(x[256 * f : 256 * f + 512], window)])) ** 2
        best.append([max((power[k], -k) for k in range(a, b)) for a, b in bands])
    found = [(f, -best[f][k][1]) for f in range(n) for k in range(4) if best[f][k][0] > 1e-6 and all(best[f][k][0] >= best[g][k][0] for g in range(max(0, f - 2), min(n, f + 3)))]
    out = []
    for i, (f, p) in enumerate(found):
        after = [found[i + 1]] if i + 1 < len(found) and found[i + 1][0] == f else []
        after += [x for x in found[i + 1 :] if x[0] > f][:3]
        out += [(f, p * 2**15 + q * 2**6 + g - f) for g, q in after if g - f <= 63]
    return sorted(out)


def test_fingerprint_equals_its_definition():
    rnd = np.random.default_rng(5)
    t = np.arange(6000)
    sounds = [rnd.integers(0, 256, n).astype(np.uint8).tobytes() for n in (64, 512, 513, 768, 5000)]
    sounds.append((128 + 50 * np.sin(t * t / 9000) + rnd.integers(-9, 9, 6000)).astype(np.uint8).tobytes())
    sounds.append(" ".join(random.Random(6).choice(["spectral", "peak", "pairs", "of", "text"]) for _ in range(900)).encode().ljust(6400, b"\0"))
    for s in sounds:
        assert [(int(a), int(b)) for a, b in zip(*media.pairs(*media.peaks(s)))] == _plain_fingerprint(s)


def test_columns_of_the_same_names(spark):
    docs = frame(spark, ["abc", None]).selectExpr("*", "7 AS n_bytes", "8 AS media", "9 AS times")
    assert sorted(r.n_bytes for r in media.features(media.encode(docs)).collect()) == [0, 3]
