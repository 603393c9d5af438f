import hashlib
import random
import re

import numpy as np
import pytest

from leafmark.llm import fim
from tests.llm.helpers import DOCS, awkward, frame, prose


def _plain(doc_id, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    """By the definition, over strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    x, y, z = marks
    return (n, "spm", len(p), len(m), y + s + x + p + z + m) if h4 % 100 < spm else (n, "psm", len(p), len(m), x + p + y + s + z + m)


def _texts():
    rnd = random.Random(3)
    lines = lambda n: "".join(prose(rnd, rnd.randint(0, 9)) + "\n" * rnd.randint(1, 2) for _ in range(n))
    return [*awkward(rnd), *(lines(rnd.randint(1, 40)) + rnd.choice(["", "end", "é字"]) for _ in range(60)), "a <P> b\nc", "<", "<S", "<\n<S\n>", "P>\n<\nS>\n", "\r\n\r", "字\n" * 3000, "x\x00y\n\x00"]


def test_equals_the_definition_and_restores(spark):
    texts = _texts()
    got = {r.doc_id: r for r in fim.restore(fim.transform(frame(spark, texts))).collect()}
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain(i, t), i
        assert r.text == (t or "")


@pytest.mark.parametrize("slice_bytes", [1, 700, 1 << 20])
def test_slices_do_not_change_rows(spark, slice_bytes):
    docs = frame(spark, _texts())
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "n", "form", "output").collect()))
    assert rows(fim.transform(docs, slice_bytes=slice_bytes)) == rows(fim.transform(docs))


def test_other_parameters(spark):
    texts = _texts()
    got = fim.restore(fim.transform(frame(spark, texts), seed=11, rate=60, spm_rate=20, markers=("[p|", "[s|", "[m|")), markers=("[p|", "[s|", "[m|")).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain(r.doc_id, texts[r.doc_id], 11, 60, 20, ("[p|", "[s|", "[m|"))
        assert r.text == (texts[r.doc_id] or "")
    with pytest.raises(ValueError):
        fim.transform(frame(spark, texts), markers=("<a<", "<b", "c"))


def test_bits_against_counting():
    rnd = np.random.default_rng(0)
    for size, share in ((1, 1.0), (7, 0.5), (512, 0.01), (513, 1.0), (5000, 0.3), (5000, 0.002), (1024, 0.0)):
        flags = rnd.random(size) < share
        bits, ones = fim.Bits(flags), np.flatnonzero(flags)
        assert bits.rank(np.arange(size + 1)).tolist() == np.concatenate(([0], np.cumsum(flags))).tolist()
        assert bits.select(np.arange(1, len(ones) + 1)).tolist() == ones.tolist()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a\nb\n", "en", "s", 4), (5, "a\nb\nc", "en", "s", 4), (5, "a\nb\nc", "en", "s", 4), (6, None, None, None, None)], DOCS).selectExpr("*", "1 AS n", "'x' AS output", "3 AS form", "array(n_chars) AS more")
    got = fim.restore(fim.transform(docs)).collect()
    assert len(got) == 4 and got[0].more is not None and [r.output for r in got if r.doc_id == 5][0] == [r.output for r in got if r.doc_id == 5][1]
    assert [(r.n, r.output) for r in got if r.doc_id is None] == [(_plain(None, "a\nb\n")[0], _plain(None, "a\nb\n")[-1])]
    assert fim.transform(frame(spark, [])).count() == 0


def test_a_very_long_text(spark):
    text = "word " * 1_200_000 + "\n" + "ü\n" * 200_000
    (r,) = fim.restore(fim.transform(frame(spark, [text], first=9))).collect()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain(9, text) and r.text == text
