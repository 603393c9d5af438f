import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import langid
from tests.llm.helpers import awkward

SYLLABLES = {"aa": ["ka", "to", "mi", "ré"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["the", "ing", "ou", "nd"]}


def _text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def _plain(samples, text):
    """Code length by walking the context tree byte by byte."""
    count = defaultdict(lambda: defaultdict(int))
    for t in samples:
        raw = b"\0\0\0" + t.lower().encode()
        for i in range(3, len(raw)):
            for o in range(4):
                count[raw[i - o : i]][raw[i]] += 1
    raw, bits = b"\0\0\0" + text.lower().encode(), 0.0
    for i in range(3, len(raw)):
        for o in (3, 2, 1, 0):
            seen = count.get(raw[i - o : i])
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    rnd = random.Random(1)
    samples = {x: [_text(rnd, x, 30) for _ in range(5)] for x in SYLLABLES}
    trees = langid.Trees(samples)
    texts = [_text(rnd, x, 20) for x in SYLLABLES] + ["zzz 123 ÿ字", "a", "", "ka ka"] + [t for t in awkward(rnd) if t and len(t) < 4000]
    got = trees.code_lengths(texts)
    for t, row in zip(texts, got):
        assert list(row) == pytest.approx([_plain(samples[x], t) for x in trees.languages], rel=1e-9, abs=1e-9)


def test_predictions(spark):
    rnd = random.Random(2)
    rows = [(i, _text(rnd, x, rnd.randint(5, 60)), x, "s") for i, x in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, None, "aa", "s"), (1001, "123 !!", "bb", "s"), (1002, "ka to mi", None, "s"), (1003, "", "cc", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    trees = langid.fit(docs, F.col("doc_id") % 5 != 0, sample_docs=20)
    got = {r.doc_id: r for r in langid.predict(docs, trees).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1003)] == ["und"] * 3 and got[1002].lang_pred == "aa"
    held = [(got[i].lang_pred, x) for i, _, x, _ in rows[:180] if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    trees = langid.fit(docs, F.lit(True))
    assert langid.predict(docs, trees).first().lang_pred == "und"
    assert langid.predict(docs.where("false"), trees).count() == 0


def test_ties_take_the_first_language():
    trees = langid.Trees({"b": ["xyz xyz"], "a": ["xyz xyz"]})
    (lang, score, _), = trees.predict(["xyz"])
    assert lang == "a" and score == pytest.approx(0.5)


def test_letters(spark):
    trees = langid.Trees({"de": ["ein text"]})
    texts = ["½ ²", "①Ⅷ", "", None, "1 2", "ª", "字", "٣", "_", "é", "ᾳ"]
    assert [r[0] for r in trees.predict(texts)] == ["und"] * 5 + ["de", "de", "und", "und", "de", "de"]


def test_no_language_is_lost(spark):
    for one in (12, 13, 14, 15):
        rows = [(one, f"ein text {k % 50}", "de") for k in range(2000)] + [(100 + k, f"some text {k}", "en") for k in range(20)] + [(7, None, "fr"), (one, "même", "it")]
        trees = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), sample_docs=10)
        assert trees.languages == ["de", "en", "it"]


def test_pieces_and_neighbours_do_not_matter(monkeypatch):
    rnd = random.Random(4)
    trees = langid.Trees({x: [_text(rnd, x, 40)] for x in SYLLABLES})
    texts = [_text(rnd, "aa", 700), "", "x", _text(rnd, "cc", 90)]
    want = [[_plain_bits(trees, t, x) for x in trees.languages] for t in texts]
    for piece, costs in ((1 << 14, 1 << 21), (7, 40), (64, 1)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "COSTS", costs)
        got = trees.code_lengths(texts)
        assert np.allclose(got, want, rtol=1e-9)
        assert [trees.code_lengths([t])[0].tolist() for t in texts] == got.tolist()


def _plain_bits(trees, text, language):
    codes = langid._codes([text])[0]
    return float(trees._lower(langid.ORDER, codes)[:, trees.languages.index(language)].sum()) if len(codes) else 0.0


def test_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "ka to mi", "aa", 5, "z", None)], "doc_id bigint, text string, lang string, score int, lang_pred string, bits_per_byte string")
    trees = langid.fit(docs, F.lit(True))
    row = langid.predict(docs, trees).first()
    assert row.lang_pred == "aa" and row.score == 1.0 and row.bits_per_byte > 0


def test_trees_count_every_training_text(spark, monkeypatch):
    """One rare word in each of many texts: all are in the trees, whatever is counted at once; a language of empty texts is kept."""
    monkeypatch.setattr(langid, "COUNTED", 40)
    monkeypatch.setattr(langid, "HELD", 60)
    rnd = random.Random(7)
    rows = [(i, f"{_text(rnd, x, 9)} q{i}x", x) for i, x in enumerate(list(SYLLABLES) * 300)] + [(5000, "", "zz"), (5001, None, "yy"), (5002, "none", None)]
    trees = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5), F.lit(True))
    whole = langid.Trees({x: [t for _, t, y in rows if y == x] for x in (*SYLLABLES, "zz")})
    assert trees.languages == whole.languages
    texts = [t for _, t, _ in rows if t][::7] + ["é ß 字", "qq"]
    assert np.array_equal(trees.code_lengths(texts), whole.code_lengths(texts))


def test_usual_cost_is_of_all_training_texts(spark):
    rows = [(i, "t", "en", "en", float(i)) for i in range(10_001)] + [(1, "t", None, "en", 1e9), (1, None, "en", "en", 1e9), (1, "t", "en", "und", 1e9), (-1, "t", "en", "en", 1e9)]
    found = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, bits_per_byte double").repartition(3)
    assert langid.usual_cost(found, F.col("doc_id") >= 0) == 9900.0
    assert langid.usual_cost(found.where("false"), F.lit(True)) is None
