"""Queries of payloads, progress and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import ocr
from leafmark.operators import profiles as P
from leafmark.plans.images import _cut
from leafmark.sources import derived
from leafmark.streaming import progress


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine's payload for each text, its lines being the recognised ones: objects, texts of JSON and lists in turn, with the wrapper or
    without, polygons as recognised or as detected, and none for the last line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").repartition(derived.dealt_to(spark, sf_dir, "documents"), "doc_id")
    texts = F.split(F.replace("text", F.lit("ß"), F.lit("ss")), "\n")
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    polygon = lambda t, i: F.array(corner(i % 7 + 0.5, i * 40), corner(i % 7 + 0.5 + F.least(F.length(t) * 8, F.lit(900)), i * 40), corner(i % 7 + 0.5 + F.least(F.length(t) * 8, F.lit(900)), i * 40 + 24))
    held = docs.select("doc_id", texts.alias("t")).select(
        "doc_id", F.col("t").alias("rec_texts"), F.transform("t", lambda t: (F.length(t) % 100) / 100).alias("rec_scores"), F.transform(F.slice("t", 1, F.size("t") - 1), polygon).alias("polys")
    )
    even = F.col("doc_id") % 2 == 0
    body = F.struct("rec_texts", "rec_scores", F.when(even, F.col("polys")).otherwise(F.array().cast("array<array<array<double>>>")).alias("rec_polys"), F.when(~even, F.col("polys")).alias("dt_polys"))
    text = F.when(F.col("doc_id") % 5 < 3, F.to_json(F.struct(body.alias("res")))).otherwise(F.to_json(body))
    quoted = F.expr("element_at(transform(array(to_json(array(text))), q -> substring(q, 2, length(q) - 2)), 1)")
    said = held.select("doc_id", F.explode_outer(F.array(text)).alias("text"))
    said = said.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, quoted).otherwise(F.concat(F.lit("["), "text", F.lit("]"))).alias("payload"))
    return said.select("doc_id", F.explode_outer(F.array("payload")).alias("payload"))


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _payloads(spark, sf_dir).select("doc_id", ocr.payload_lines(F.col("payload")).alias("lines"))
    return ocr.extents(lines, "doc_id").select("doc_id", "idx", F.sha2("text", 256).alias("text_sha256"), F.round("confidence", 6).alias("confidence"), "x", "y", "x2", "y2")


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, errors and reused ones of a run, as they were counted while its results were written."""
    seen = derived.view(spark, sf_dir, "prediction")
    pages = seen.select("document", "page", F.when(~F.col("ocr_safe"), "not safe").alias("error"), (F.col("rotation") == 0).alias("reused"))
    counted, said = progress.watched(pages)
    _cut(spark)(counted)
    return spark.createDataFrame([tuple(said.get[k] for k in ("pages", "errors", "reused"))], "pages bigint, errors bigint, reused bigint")


def heavy_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower weighted median and 90th percentile of extended prices by quantity, of each return flag and of all rows under one key."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("value"), F.col("l_quantity").cast("double").alias("weight"))
    keyed = rows.select(F.explode(F.array("l_returnflag", F.lit("all"))).alias("key"), "value", "weight")
    of = lambda share, name: P.weighted_quantile(keyed, _cut(spark), share).withColumnRenamed("value", name)
    return of(0.5, "median").join(of(0.9, "p90"), "key")


_LINES = "SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, t[i] AS t, len(t) AS n FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, 'ß', 'ss'), chr(10)) AS t FROM documents WHERE text IS NOT NULL))"
_REACHED = "(SELECT key, min(value) AS {name} FROM (SELECT *, sum(w) OVER (PARTITION BY key ORDER BY value) AS upto, sum(w) OVER (PARTITION BY key) AS whole FROM v) WHERE upto >= whole * {share}::DOUBLE GROUP BY key)"
QUERIES = {f.__name__: f for f in (payload_rows, run_progress, heavy_quantile)}
ORACLES = {
    "payload_rows": f"""SELECT doc_id, idx, sha256(t) AS text_sha256, round((length(t) % 100) / 100.0::DOUBLE, 6) AS confidence, CASE WHEN idx < n - 1 THEN x END AS x, CASE WHEN idx < n - 1 THEN CAST(idx * 40 AS INT) END AS y,
        CASE WHEN idx < n - 1 THEN x2 END AS x2, CASE WHEN idx < n - 1 THEN CAST(idx * 40 + 24 AS INT) END AS y2
        FROM (SELECT *, CAST(round_even(idx % 7 + 0.5::DOUBLE, 0) AS INT) AS x, CAST(round_even(idx % 7 + 0.5::DOUBLE + least(length(t) * 8, 900), 0) AS INT) AS x2 FROM ({_LINES}))""",
    "run_progress": f"SELECT count(*) AS pages, count(*) FILTER (NOT ocr_safe) AS errors, count(*) FILTER (rotation = 0) AS reused FROM ({derived.oracle('prediction')})",
    "heavy_quantile": f"""WITH v AS (SELECT key, value, sum(w) AS w FROM (SELECT unnest([l_returnflag, 'all']) AS key, CAST(l_extendedprice AS DOUBLE) AS value, CAST(l_quantity AS DOUBLE) AS w FROM lineitem) GROUP BY key, value)
        SELECT a.key, median, p90 FROM {_REACHED.format(name="median", share=0.5)} AS a JOIN {_REACHED.format(name="p90", share=0.9)} AS b ON a.key = b.key""",
}
