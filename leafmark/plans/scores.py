"""Queries of scores and feature filters, over features made from documents and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import scores as S


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda k, m: F.pmod(F.col("doc_id") * k + F.col("n_chars"), F.lit(m)).cast("double")
    seen = F.col("doc_id") % 5 > 0
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", share(7, 101).alias("portrait"), share(3, 101).alias("mrz"), share(11, 101).alias("layout"), share(5, 101).alias("text"), F.when(F.col("doc_id") % 3 > 0, share(2, 101)).alias("rotation"),
        F.when(seen, share(13, 900)).alias("portrait_y"), F.when(seen, F.lit(100.0)).alias("portrait_h"), F.when(F.col("doc_id") % 4 > 0, share(17, 1000)).alias("first_band_y"), F.lit(1000.0).alias("height"),
    )


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(S.final_score(), 6).alias("final"), F.round(S.layout_score(), 6).alias("layout_score"))


def deskew_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _docs(spark, sf_dir).select("doc_id", ((F.col("portrait") - 50) / 8).alias("estimate"), (F.col("mrz") / 100).alias("confidence"), ((F.col("layout") - 50) / 16).alias("residual"))
    return S.deskewed(pages).select("doc_id", "applied", "left", "warning")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda a, m: F.pmod(F.col("l_partkey") * a + F.col("l_suppkey"), F.lit(m)) + 1
    return rows.select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("place"), side(3, 1000).alias("w"), side(7, 1000).alias("h"), side(11, 900).alias("y"), (side(3, 1000) * side(7, 1000) * (F.col("l_linenumber") % 5 + 4) / 8).alias("area"))


def document_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_box(_boxes(spark, sf_dir), "l_orderkey", "place", 1e6).select("l_orderkey", "w", "h", F.round("score", 9).alias("score"))


def horizontal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.horizontal_share(_boxes(spark, sf_dir), "l_orderkey", 1000.0).select("l_orderkey", F.round("share", 6).alias("share"))


def portrait_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.portrait_boxes(_boxes(spark, sf_dir), 1000, 1000).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("boxes"), F.max("w").alias("widest"))


def protected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    one = F.lit(1.0)
    pages = _docs(spark, sf_dir)
    rects = F.array(F.when(F.col("portrait_y").isNotNull(), rect(F.col("portrait") * 3, F.col("portrait_y"), one * 90, one * 100)), F.when(F.col("first_band_y").isNotNull(), rect(one * 40, F.col("first_band_y"), one * 500, one * 30)))
    return pages.select("doc_id", S.protected_near_edge(rects, rect(one * 10, one * 20, one * 700, one * 1000), rect(one * 0, one * 0, one * 720, one * 1040)).alias("near"))


def texture_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _docs(spark, sf_dir).select("doc_id", F.col("mrz").alias("start"), (F.col("mrz") + F.col("text")).alias("end"), (F.col("layout") / 1000).alias("ink"), (F.col("portrait") / 100).alias("coverage"))
    return S.texture_bands(bands, 1000).select("doc_id", "start", "end")


def chosen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page list and a limit, as asked for a run."""
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") % 40).alias("page"))
    return S.chosen_pages(pages, [3, 7, 11], 25, "page", "doc_id")


_D = """d AS (SELECT doc_id, CAST((doc_id * 7 + n_chars) % 101 AS DOUBLE) AS p, CAST((doc_id * 3 + n_chars) % 101 AS DOUBLE) AS m, CAST((doc_id * 11 + n_chars) % 101 AS DOUBLE) AS l, CAST((doc_id * 5 + n_chars) % 101 AS DOUBLE) AS t,
  CASE WHEN doc_id % 3 > 0 THEN CAST((doc_id * 2 + n_chars) % 101 AS DOUBLE) END AS r, CASE WHEN doc_id % 5 > 0 THEN CAST((doc_id * 13 + n_chars) % 900 AS DOUBLE) END AS py, CASE WHEN doc_id % 4 > 0 THEN CAST((doc_id * 17 + n_chars) % 1000 AS DOUBLE) END AS b FROM documents)"""
_B = "b AS (SELECT l_orderkey, l_linenumber AS k, l_partkey AS q, (l_partkey * 3 + l_suppkey) % 1000 + 1 AS w, (l_partkey * 7 + l_suppkey) % 1000 + 1 AS h, (l_partkey * 11 + l_suppkey) % 900 + 1 AS y, ((l_partkey * 3 + l_suppkey) % 1000 + 1) * ((l_partkey * 7 + l_suppkey) % 1000 + 1) * (l_linenumber % 5 + 4) / 8 AS area FROM lineitem)"

QUERIES = {f.__name__: f for f in (page_scores, deskew_decision, document_box, horizontal_share, portrait_boxes, protected_edges, texture_bands, chosen_pages)}
ORACLES = {
    "page_scores": f"""WITH {_D} SELECT doc_id, round(greatest(0, least(100, p * 0.38::DOUBLE + m * 0.14::DOUBLE + l * 0.24::DOUBLE + t * 0.19::DOUBLE + coalesce(r, 0) * 0.05::DOUBLE)), 6) AS final,
        round(least(100, ((0.45::DOUBLE * p + 0.3::DOUBLE * t + 0.25::DOUBLE * m) / 100 + CASE WHEN py < 820 THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN b > py + 100 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN p >= 65 AND t >= 50 THEN 0.12::DOUBLE ELSE 0 END) * 100), 6) AS layout_score FROM d""",
    "deskew_decision": f"""WITH {_D}, e AS (SELECT doc_id, (p - 50) / 8 AS e, m / 100 AS c, (l - 50) / 16 AS x FROM d), k AS (SELECT *, abs(e) BETWEEN 1 AND 6 AND c >= 0.65::DOUBLE AS tried, abs(e) - abs(x) >= abs(e) * 0.2::DOUBLE AS good FROM e)
        SELECT doc_id, CASE WHEN tried AND good THEN e ELSE 0 END AS applied, CASE WHEN tried AND good THEN x ELSE e END AS "left", CASE WHEN tried AND good THEN NULL WHEN tried THEN 'deskew_reverted_no_measured_improvement' WHEN abs(e) >= 1 THEN 'deskew_skipped_low_confidence' END AS warning FROM k""",
    "document_box": f"""WITH {_B}, s AS (SELECT *, w * h / 1e6 * 0.7::DOUBLE + area / (w * h) * 0.3::DOUBLE AS score FROM b WHERE area > 0 AND w * h / 1e6 BETWEEN 0.2::DOUBLE AND 0.995::DOUBLE AND area / (w * h) >= 0.58::DOUBLE)
        SELECT l_orderkey, w, h, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, k, q) AS n FROM s) WHERE n = 1""",
    "horizontal_share": f"WITH {_B} SELECT l_orderkey, round(coalesce(sum(area) FILTER (w >= h * 1.6::DOUBLE AND w >= 25), 0) / greatest(1, sum(area)), 6) AS share FROM b GROUP BY 1",
    "portrait_boxes": f"WITH {_B} SELECT l_orderkey, count(*) AS boxes, max(w) AS widest FROM b WHERE w * h / 1e6 BETWEEN 0.018::DOUBLE AND 0.34::DOUBLE AND w / h BETWEEN 0.45::DOUBLE AND 1.35::DOUBLE AND y <= 820 GROUP BY 1",
    "protected_edges": f"WITH {_D} SELECT doc_id, coalesce(least(10 + p * 3, 20 + py, 720 - 10 - p * 3 - 90, 1040 - 20 - py - 100) < 15 AND py IS NOT NULL, false) OR coalesce(least(50, 20 + b, 720 - 50 - 500, 1040 - 20 - b - 30) < 15 AND b IS NOT NULL, false) AS near FROM d",
    "texture_bands": f"WITH {_D} SELECT doc_id, m AS start, m + t AS \"end\" FROM d WHERE t BETWEEN 2 AND 75 AND l / 1000 >= 0.03::DOUBLE AND p / 100 >= 0.52::DOUBLE",
    "chosen_pages": "SELECT doc_id, doc_id % 40 AS page FROM documents WHERE doc_id % 40 IN (3, 7, 11) ORDER BY page, doc_id LIMIT 25",
}
