import math
import random

import numpy as np
from pyspark.sql import functions as F

from leafmark.llm import quality
from leafmark.llm.common import quantile as quality_quantile
from tests.llm.helpers import awkward, frame, prose


def _labelled(spark, rnd, n=240):
    texts = [prose(rnd, rnd.randint(20, 80)) + ("." if i % 4 else " | !! *** $$$" * rnd.randint(3, 9)) for i in range(n)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)] + [(n + 5, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _labelled(spark, random.Random(1))
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[i] >= 0.5, i % 4 > 0) for i in got if i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_preferences_are_learned():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(400, quality.N_FEATURES))
    label = (x[:, 3] - 0.5 * x[:, 5] > 0.3).astype(int)
    model = quality.Ranking(x, label)
    good, bad = model.score(x[label == 1]), model.score(x[label == 0])
    assert (good[:, None] > bad).mean() > 0.98
    assert abs((model.score(x) >= 0.5).mean() - label.mean()) < 0.02  # the threshold is the quantile


def test_awkward_texts_and_few_labels(spark):
    rnd = random.Random(2)
    docs = frame(spark, awkward(rnd))
    for rows, want in (([], 0.5), ([(3, 1)], None)):
        model = quality.fit(docs, spark.createDataFrame(rows, "doc_id bigint, quality int"), F.lit(True))
        scores = [r.score for r in quality.score(docs, model).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
        assert want is None or set(scores) == {want}
    assert quality.score(frame(spark, []), model).count() == 0
    assert len(quality.text_features(None)) == len(quality.text_features("a\nb" * 9)) == quality.N_FEATURES


def test_weights_are_the_optimum_of_the_pairs():
    """Against plain gradient descent on the logistic loss of the same pairs, drawn anew."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(120, quality.N_FEATURES)) * 3 + 1
    label = (x[:, 1] + rnd.normal(size=120) > 1).astype(int)
    model = quality.Ranking(x, label, pairs_each=4, ridge=1e-2)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    draw = np.random.default_rng(7)
    pairs = [(i, None) for i in good for _ in range(4)], [(None, j) for j in bad for _ in range(4)]
    first = draw.choice(good, len(pairs[1])), draw.choice(bad, len(pairs[0]))
    pairs = [*zip([i for i, _ in pairs[0]], first[1]), *zip(first[0], [j for _, j in pairs[1]])]
    w = np.zeros(quality.N_FEATURES)
    for _ in range(6000):
        slope = 1e-2 * w
        d = np.array([z[i] - z[j] for i, j in pairs]) if _ == 0 else d  # noqa: F821
        slope -= (d / (1 + np.exp(d @ w))[:, None]).mean(0)
        w -= 0.5 * slope
    assert np.abs(w - model.w).max() < 1e-4
    assert model.threshold == np.quantile(z @ model.w, (label == 0).mean())
    assert np.allclose(model.score(x), [1 / (1 + math.exp(model.threshold - float(a @ model.w))) for a in z])


def test_features_equal_plain_counts():
    for text in ["", "Good text, with words. And words!\n\nAgain again $$ 42 é", "a a a\na a a\nb", "|| ||", *[t or "" for t in awkward(random.Random(1))]]:
        raw, words, lines = text.encode(), text.split(), text.split("\n")
        n, m, rate = max(1, len(raw)), max(1, len(words)), lambda v: math.log1p(200 * v)
        kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b"\t\r ", b".,;:?'\"-", b"!"]
        share = [sum(b in k for b in raw) / n for k in kinds]
        share += [sum(b < 128 for b in raw) / n - sum(share), sum(b >= 128 for b in raw) / n]
        marks = max([raw.count(c) for c in range(33, 127) if not chr(c).isalnum()]) / n
        entropy = -sum(raw.count(c) / n * math.log2(raw.count(c) / n) for c in set(raw))
        ends = sum(raw.count(c) for c in b".!?")
        want = [math.log1p(n), math.log1p(len(words)), *map(rate, share), rate(marks), entropy, share[1] / max(share[0] + share[1], 1e-9)]
        want += [rate(sum(a == b for a, b in zip(words, words[1:])) / m), len(set(words)) / m, math.log1p(len(set(words))) / math.log1p(m)]
        want += [1 - len(set(lines)) / len(lines), math.log1p(n / m), math.log1p(m / (ends + 1)), math.log1p(n / len(lines))]
        assert np.allclose(quality.text_features(text), want, atol=1e-9)


def test_repeated_ids_and_columns_of_the_same_names(spark):
    docs, labels = _labelled(spark, random.Random(4), 60)
    many = docs
    for _ in range(3):
        many = many.unionByName(many)
    model = quality.fit(many.selectExpr("*", "1 AS score", "2 AS features", "3 AS sample_id", "4 AS sample_label", "5 AS hash"), labels, F.lit(True))
    assert np.allclose(model.w, quality.fit(docs, labels, F.lit(True)).w)
    row = quality.score(docs.selectExpr("*", "'x' AS score", "3 AS features"), model).first()
    assert 0 <= row.score <= 1 and row.features == 3


def test_every_label_row_counts(spark, monkeypatch):
    """More label rows than the 4000 that were once sampled, the rare label in every group; the threshold is the quantile of all strengths."""
    rnd = random.Random(5)
    n = 9000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word', id % 97, CASE WHEN id % 300 = 0 THEN ' !!' ELSE ' and more' END) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 300 > 0 AS INT) AS quality").union(spark.createDataFrame([(300, 0)] * 5, "doc_id bigint, quality int"))
    seen = []
    monkeypatch.setattr(quality, "quantile", lambda values, share: seen.append((values.count(), share)) or quality_quantile(values, share))
    model = quality.fit(docs, labels, F.lit(True), group=1000)
    assert seen == [(n + 5, 35 / (n + 5))]
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 300 > 0) for i in rnd.sample(range(n), 500) + list(range(0, n, 300)))
    assert quality.fit(docs, labels.where("quality = 1"), F.lit(True)).threshold < 0


def test_groups_learn_what_one_matrix_does(spark):
    docs, labels = _labelled(spark, random.Random(6), 120)
    rows = sorted((r.doc_id, r.quality, quality.text_features(r.text)) for r in docs.join(labels.where("quality is not null"), "doc_id").collect())
    one = quality.Ranking(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]))
    model = quality.fit(docs, labels, F.lit(True))
    assert np.allclose(model.w, one.w, atol=1e-5) and abs(model.threshold - one.threshold) < 1e-4
    several = quality.fit(docs, labels, F.lit(True), group=30)  # other partners are drawn
    assert np.allclose(several.mean, one.mean) and np.corrcoef(several.w, one.w)[0, 1] > 0.9


def test_quantiles_by_refinement(spark):
    rnd = np.random.default_rng(1)
    for x in (rnd.normal(size=3000), np.repeat([1.0, 2.0, 1e300], [500, 1500, 7]), np.array([4.0]), np.array([-1e308, 0.0, 1e308] * 20), rnd.integers(0, 5, 900) * 1.0):
        frame = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        for share in (0.0, 0.37, 0.5, 0.99, 1.0):
            assert quality_quantile(frame, share, bins=8, few=10) == float(np.quantile(x, share)) or np.isclose(quality_quantile(frame, share, bins=8, few=10), np.quantile(x, share), rtol=1e-12)
    assert quality_quantile(frame.where("false"), 0.5) is None
