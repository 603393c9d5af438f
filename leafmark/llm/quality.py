"""Quality classifier: Bradley-Terry pairwise ranking.

Each document has a strength w.x, x being statistics of its whole text. A preference pair says that a
document of label 1 beats one of label 0, with probability sigmoid(w.(x1 - x0)); w minimises the logistic loss on
the feature differences of the pairs plus a small ridge, by Newton's method. The threshold is the quantile of
the training documents' strengths at their share of label 0; the score is sigmoid(strength - threshold), so 0.5
is the threshold.

The classifier is fitted on all label rows that may be learned from: their features are a table, dealt by hash into groups of about
`GROUP` rows, and each round of Newton's method adds up gradients and Hessians over the groups. A row's `pairs_each` partners are drawn from the rows of
the other label in its group; where one label is rare, its rows are partners in as many groups as it takes for `PARTNERS` of them (or all) in each, and
draw partners in the first one. Where an id stands on several texts, the one with the least hash counts.

Edge cases: null and empty texts have the features of the empty text and a score like any other; labels
that are null are left out, several labels of a document each count; without both labels among them every
score is the share of label 1 (0.5 without any). Texts with equal features tie: equal scores; a strength at the threshold scores 0.5,
which is label 1. Repeated rows repeat; extra columns stay, but columns of the names that score() and with_features() add are
replaced. A very long text is held with its words, one text at a time.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, crc_mod, quantile, slices, table, written

PAIRS_EACH = 8
#: Rows of a group, and the least number of rows of each label in it.
GROUP, PARTNERS = 4000, 500
RIDGE = 1e-3

_CLASSES = np.zeros((256, 9))
for _c in range(256):
    _CLASSES[_c, 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c == 10 else 4 if _c in (9, 13, 32) else 5 if _c in b".,;:?'\"-" else 6 if _c in b"!" else 7 if _c < 128 else 8] = 1
_SENTENCE = [ord(c) for c in ".!?"]
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]


def text_features(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    share = counts @ _CLASSES / n
    seen = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    kinds = len(set(words))
    lines = text.split("\n")
    again = sum(map(eq, words, words[1:])) / m
    marks = float(counts[_SENTENCE].sum())
    rate = lambda v: math.log1p(200 * v)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        *(rate(v) for v in share),
        rate(counts[_MARKS].max() / n),
        float(-(seen * np.log2(seen)).sum()),
        share[1] / max(share[0] + share[1], 1e-9),
        rate(again),
        kinds / m,
        math.log1p(kinds) / math.log1p(m),
        1 - len(set(lines)) / len(lines),
        math.log1p(n / m),
        math.log1p(m / (marks + 1)),
        math.log1p(n / len(lines)),
    ]


N_FEATURES = len(text_features(""))


def _differences(z: np.ndarray, label: np.ndarray, own: np.ndarray, pairs_each: int, seed: int = 7) -> np.ndarray:
    """z of the winner less z of the loser of each pair: those that own rows of label 1 draw, then those of own rows of label 0."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    of_good, of_bad = good[own[good]], bad[own[bad]]
    draw = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(of_good, pairs_each), draw.choice(good, len(of_bad) * pairs_each) if len(good) else good])
    b = np.concatenate([draw.choice(bad, len(of_good) * pairs_each) if len(bad) else bad, np.repeat(of_bad, pairs_each)])
    return z[a] - z[b] if len(good) and len(bad) else np.zeros((0, z.shape[1]))


def _slopes(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums that a round of Newton's method needs: Hessian, gradient and number of pairs, as one array."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the loser winning
    return np.concatenate([((d * (p * (1 - p))[:, None]).T @ d).ravel(), d.T @ p, [len(d)]])


def _newton(slopes, ridge: float) -> np.ndarray:
    w = np.zeros(N_FEATURES)
    for _ in range(30):
        found = slopes(w)
        curve, slope, n = found[: -N_FEATURES - 1].reshape(N_FEATURES, N_FEATURES), found[-N_FEATURES - 1 : -1], max(1, found[-1])
        step = np.linalg.solve(curve / n + ridge * np.eye(N_FEATURES), slope / n - ridge * w)
        w += step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Ranking:
    """The model, fitted on rows at hand; `fit` learns it from tables."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE):
        good, bad = int((label == 1).sum()), int((label == 0).sum())
        self._unlearned(good, bad)
        if not good or not bad:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        d = _differences(z, label, np.ones(len(z), bool), pairs_each)
        self.w = _newton(lambda w: _slopes(d, w), ridge)
        self.threshold = float(np.quantile(z @ self.w, bad / len(label)))

    def _unlearned(self, good: int, bad: int) -> None:
        share = good / (good + bad) if good + bad else 0.5
        self.w, self.mean, self.scale = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.threshold = -math.log(max(share, 1e-3) / max(1 - share, 1e-3))

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.w).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self.strength(x), -40, 40)))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with features array<double>."""
    docs = docs.drop("features")

    def run(batches):
        for batch in slices(batches, text):
            x = [text_features(t) for t in column(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], names=[*batch.schema.names, "features"])

    return docs.mapInArrow(run, docs.withColumn("features", F.array(F.lit(0.0))).schema)


def _matrix(features: pa.ListArray) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _summed(rows: DataFrame, of) -> np.ndarray | float:
    """The sum over all record batches of the array that `of` makes of one; tasks add up their own."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(batch)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return sum((np.array(r[0]) for r in rows.mapInArrow(run, "total array<double>").toLocalIterator()), 0.0)


def _applied(rows: DataFrame, name: str, of) -> DataFrame:
    """rows with a double column in the place of features: what `of` makes of their matrix."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("features")
            new = pa.array(of(_matrix(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), new], names=[*(n for i, n in enumerate(batch.schema.names) if i != at), name])

    return rows.mapInArrow(run, rows.drop("features").withColumn(name, F.lit(0.0)).schema)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of doc_id, text_hash and features of docs; texts are read once for all that follows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return written(with_features(rows).drop("text"), "quality-features")


def fit(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text: str = "text", label: str = "quality", **options) -> Ranking:
    """Learns from all label rows for which the condition `training` holds."""
    return fit_measured(measured(docs, id_col, text), labels, training, id_col, label, **options)


def fit_measured(features: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", label: str = "quality", pairs_each: int = PAIRS_EACH, ridge: float = RIDGE, group: int = GROUP) -> Ranking:
    """fit() over a table of `measured`."""
    rows = labels.where(training).where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("label_id"), F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("times"))
    found = features.join(rows.select(F.col("label_id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text_hash", "features")).alias("least"))
    found = found.join(rows, F.col("doc_id") == F.col("label_id")).select("doc_id", "label", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("time"), F.col("least.features").alias("features"))
    found = written(found, "quality-labelled")
    count = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in found.groupBy("label").count().collect()}
    model, n = Ranking(np.zeros((0, N_FEATURES)), np.zeros(0, int)), sum(count.values())
    model._unlearned(count[1], count[0])
    if not count[0] or not count[1]:
        return model
    x = found.select("features")
    mean = _summed(x, lambda b: _matrix(b.column(0)).sum(0)) / n
    scale = np.sqrt(_summed(x, lambda b: ((_matrix(b.column(0)) - mean) ** 2).sum(0)) / n) + 1e-9

    groups = -(-n // group)
    home = F.pmod(F.xxhash64(F.lit("group"), F.col("doc_id").cast("string"), "label", "time"), F.lit(groups))
    copies = F.create_map(*[F.lit(v) for k in (0, 1) for v in (k, min(groups, -(-PARTNERS * groups // count[k])))])
    dealt = found.withColumn("step", F.explode(F.sequence(F.lit(0), copies[F.col("label")] - 1))).withColumn("group", F.pmod(home + F.col("step"), F.lit(groups)))
    held = F.array_sort(F.collect_list(F.struct("doc_id", "label", "time", (F.col("step") == 0).alias("own"), "features")))
    dealt = dealt.groupBy("group").agg(held.alias("held")).select("group", "held.label", "held.own", F.flatten("held.features").alias("features"))
    dealt = written(dealt, "quality-groups")

    def slopes_of(w: np.ndarray):
        def of(batch: pa.RecordBatch) -> np.ndarray:
            total = 0.0
            for i in range(batch.num_rows):
                number, label_, own, flat = (batch.column(k)[i] for k in range(4))
                z = (flat.values.to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES) - mean) / scale
                d = _differences(z, label_.values.to_numpy(zero_copy_only=False), own.values.to_numpy(zero_copy_only=False).astype(bool), pairs_each, 7 + number.as_py())
                total = total + _slopes(d, w)
            return total

        return of

    model.mean, model.scale = mean, scale
    model.w = _newton(lambda w: _summed(dealt, slopes_of(w)), ridge)
    model.threshold = quantile(written(_applied(x, "strength", model.strength), "quality-strengths"), count[0] / n)
    return model


def score(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """docs with score double."""
    docs = docs.drop("score")

    def run(batches):
        for batch in slices(batches, text):
            x = np.array([text_features(t) for t in column(batch, text).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit_measured(features, table(spark, sf_dir, "labels").select("doc_id", "quality"), crc_mod("doc_id", 3) != 1)
    found = _applied(features.select("doc_id", "features"), "score", model.score)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
