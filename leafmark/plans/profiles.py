"""Queries of the profile operators: the profiles are the embeddings, one value a position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import profiles as P


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("i", "x")).select("key", F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


def profile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runs(_profile(spark, sf_dir), F.col("x") > 0)


def profile_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.smoothed(_profile(spark, sf_dir), 5).select("key", "i", F.round("smooth", 6).alias("smooth"))


def profile_local_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.local_mean(_profile(spark, sf_dir), 4).select("key", "i", F.round("mean", 6).alias("mean"))


def profile_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.differences(_profile(spark, sf_dir)).select("key", "i", F.round("diff", 6).alias("diff"))


def profile_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extent(_profile(spark, sf_dir), F.col("x") > 0.1)


def profile_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.percentiles(_profile(spark, sf_dir))


def profile_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.peak(_profile(spark, sf_dir)).select("key", "i", F.round("x", 6).alias("x"))


def profile_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.seam(_profile(spark, sf_dir), 3, 0.0)


def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _profile(spark, sf_dir).select("key", "i", F.col("x").alias("value"), (F.col("i") % 7 + 1).cast("double").alias("weight"))
    return P.weighted_median(rows).select("key", F.round("median", 6).alias("median"))


def skew_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _profile(spark, sf_dir).select("key", "i", (F.col("x") * 20).alias("value"), (F.col("i") % 7 + 1).cast("double").alias("weight"))
    return P.skew(rows, 6.0)


def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = P.runs(_profile(spark, sf_dir), F.col("x") > 0.05).where("end - start >= 2")
    return P.adjacent_pairs(bands, 7)


_P = "p AS (SELECT vec_id AS key, CAST(i - 1 AS BIGINT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _runs_sql(limit: str) -> str:
    return f"SELECT key, min(i) AS start, max(i) + 1 AS \"end\" FROM (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS g FROM p WHERE x > {limit}) GROUP BY key, g"


_WM = "SELECT key, i, {v} AS value, CAST(i % 7 + 1 AS DOUBLE) AS weight FROM p"
_MEDIAN = "SELECT key, value AS median FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value, i) AS k FROM (SELECT *, sum(weight) OVER (PARTITION BY key ORDER BY value, i ROWS UNBOUNDED PRECEDING) AS up, sum(weight) OVER (PARTITION BY key) AS total FROM {t}) WHERE up >= total / 2) WHERE k = 1"

QUERIES = {f.__name__: f for f in (profile_runs, profile_smooth, profile_local_mean, profile_differences, profile_extent, profile_percentiles, profile_argmax, profile_seam, weighted_median, skew_estimate, adjacent_pairs)}
ORACLES = {
    "profile_runs": f"WITH {_P} {_runs_sql('0')}",
    "profile_smooth": f"WITH {_P} SELECT key, i, round(sum(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM p",
    "profile_local_mean": f"WITH {_P} SELECT key, i, round(avg(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS mean FROM p",
    "profile_differences": f"WITH {_P} SELECT key, i, round(x - lag(x) OVER (PARTITION BY key ORDER BY i), 6) AS diff FROM p",
    "profile_extent": f"WITH {_P} SELECT key, min(i) FILTER (x > 0.1::DOUBLE) AS first, max(i) FILTER (x > 0.1::DOUBLE) AS last FROM p GROUP BY key",
    "profile_percentiles": f"WITH {_P} SELECT key, round(median(x), 6) AS median, round(quantile_cont(x, 0.99), 6) AS p99, round(stddev_pop(x), 6) AS std FROM p GROUP BY key",
    "profile_argmax": f"WITH {_P} SELECT key, i, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x DESC, i) AS k FROM p) WHERE k = 1",
    "profile_seam": f"WITH {_P}, m AS (SELECT key, i, avg(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mean FROM p) SELECT key, i, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY mean, i DESC) AS k FROM m WHERE mean <= 0) WHERE k = 1",
    "weighted_median": f"WITH {_P}, v AS ({_WM.format(v='x')}) SELECT key, round(median, 6) AS median FROM ({_MEDIAN.format(t='v')})",
    "skew_estimate": f"""WITH {_P}, v AS (SELECT * FROM ({_WM.format(v='x * 20')}) WHERE abs(value) <= 6), e AS ({_MEDIAN.format(t='v')}), o AS (SELECT v.key, v.i, abs(v.value - e.median) AS value, v.weight, e.median AS est FROM v JOIN e USING (key)), d AS ({_MEDIAN.format(t='o')}),
        r AS (SELECT o.key, max(est) AS est, max(d.median) AS disp, count(*) AS n, count(*) FILTER (o.value <= greatest(0.6::DOUBLE, d.median * 2.5::DOUBLE)) AS support FROM o JOIN d USING (key) GROUP BY o.key)
        SELECT key, round(CASE WHEN n < 3 THEN 0 ELSE est END, 6) AS estimate, round(CASE WHEN n < 3 THEN 0 ELSE least(1, support / 8) * greatest(0, 1 - disp / 1.5::DOUBLE) END, 6) AS confidence FROM r""",
    "adjacent_pairs": f"""WITH {_P}, b AS (SELECT * FROM ({_runs_sql('0.05::DOUBLE')}) WHERE "end" - start >= 2), n AS (SELECT *, lead(start) OVER w AS next_start, lead("end") OVER w AS next_end FROM b WINDOW w AS (PARTITION BY key ORDER BY start))
        SELECT key, start, "end", next_start, next_end FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) AS k FROM n WHERE next_start - "end" <= 7) WHERE k = 1""",
}
