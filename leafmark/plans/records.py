"""Queries over paths, pages, JSON and job events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import incremental as I
from leafmark.sources import derived
from leafmark.streaming import jobs, state


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    number = F.when(F.col("page_id") < 1000, F.lpad(F.col("page_id").cast("string"), 3, "0")).otherwise(F.col("page_id").cast("string"))
    name = F.concat(F.lit("C:/runs/output/Crew "), (F.col("page_id") % 9).cast("string"), F.lit("/DataPage_"), number, F.when(F.col("page_id") % 3 == 0, ".PNG").when(F.col("page_id") % 3 == 1, ".tif").otherwise(".json"))
    return pages.select("page_id", "url", F.replace("html", F.lit("ß"), F.lit("ss")).alias("html"), name.alias("path"))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", T.last_number(T.stem(F.col("path"))).alias("last_number"), T.tagged_number(F.col("path")).alias("tagged_number"), T.last_number(F.col("url")).alias("url_number"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("page_id", T.basename(p).alias("basename"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"), T.safe_name(F.element_at(F.split(p, "/"), -2)).alias("safe"), T.relocated(p, "/srv/project").alias("relocated"))


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files only, by suffix in either case, in order of path."""
    return _paths(spark, sf_dir).where(T.suffix(F.col("path")).isin(".png", ".jpg", ".jpeg", ".tif", ".tiff")).select("path").orderBy("path")


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", F.sha2(T.html_escape(F.col("html")), 256).alias("escaped_sha256"), T.url_quote(F.col("path")).alias("quoted"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate, ms = F.when(F.col("page_id") % 10 > 0, (F.col("page_id") % 8) / 8), F.when(F.col("page_id") % 7 > 0, F.col("page_id") * 4.0)
    return _paths(spark, sf_dir).select("page_id", T.format_rate(rate).alias("rate"), T.format_elapsed(ms).alias("elapsed"))


def config_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of a compact JSON text with its keys in order."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size")))
    return parts.select("p_partkey", F.substring(F.sha2(text, 256), 1, 16).alias("signature"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("p", F.from_json("props", "k INT"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("p.k", F.lit(0))).cast("bigint").alias("k_sum"), F.max("p.k").cast("bigint").alias("k_max"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, "job_event").groupBy("job_id", "type").agg(F.count(F.lit(1)).alias("n"))


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest(derived.view(spark, sf_dir, "job_event").where("type = 'status'"), ["job_id"], "seq").select("job_id", "seq", "item")


def artifact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.changes(derived.view(spark, sf_dir, "job_event"), ["job_id", "item"], "seq", "size", "stamp").select("job_id", "item", "seq")


def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.since(derived.view(spark, sf_dir, "job_event"), "seq", 5000).select("seq", "type")


def last_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight distinct artifacts of each job (a top-k report)."""
    seen = I.latest(derived.view(spark, sf_dir, "job_event").where("type = 'artifact'"), ["job_id", "item"], "seq")
    return seen.withColumn("k", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).where("k <= 8").select("job_id", "item", "seq")


def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job the pages by state, after the last event of each page."""
    last = I.latest(derived.view(spark, sf_dir, "job_event").where("type = 'mrz_page'"), ["job_id", "item"], "seq")
    return last.groupBy("job_id").agg(F.count_if(F.col("size") == 0).alias("valid"), F.count_if(F.col("size") != 0).alias("not_valid"))


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary joins at volume: orders by nation and region, with counts and sums."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event counts by type, as a stream over the events folder run to its end."""
    folder = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(_folder(spark, folder))
    counted = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return jobs.run_available(counted, _shared(spark), _shared(spark), "complete")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user's event type, by keyed streaming state."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(_folder(spark, f"{sf_dir}/events.parquet"))
    return jobs.run_available(jobs.changed(events, "user_id", "event_id", "event_type"), _shared(spark), _shared(spark))


def stream_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the last event of each type, as a stream run to its end, and their numbers."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(_folder(spark, f"{sf_dir}/events.parquet"))
    return jobs.run_available(jobs.page_states(events, ["user_id", "event_type"], "event_id", "value"), _shared(spark), _shared(spark), "complete")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(_folder(spark, f"{sf_dir}/events.parquet"))


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users as jobs: views and clicks set their status, a cheap purchase is an error, a dear one ends the job."""
    kind, status = F.col("event_type"), F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "recognising")
    kind = F.when(status.isNotNull(), "status").when((kind == "purchase") & (F.col("value") >= 40), "done").when((kind == "purchase") & (F.col("value") < 2), "error").otherwise("log")
    events = _stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("type"), status.alias("status"))
    with state.stores(spark):
        return jobs.run_available(state.job_states(events), _shared(spark), _shared(spark))


def stream_page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users as jobs and the numbers in their properties as pages, valid or not by value: the counters after each change."""
    page = F.concat(F.lit("page"), F.get_json_object("props", "$.k"))
    events = _stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), page.alias("page"), (F.col("value") < 10).alias("valid"))
    with state.stores(spark):
        return jobs.run_available(state.page_counters(events.where("page IS NOT NULL AND valid IS NOT NULL")), _shared(spark), _shared(spark))


def _folder(spark: SparkSession, path: str) -> str:
    """A stream reads folders: a table that is one file is named by a pattern."""
    return path.replace("events.parquet", "events.parque[t]")


def _shared(spark: SparkSession) -> str:
    """A folder of its own in the shared one, for a stream's checkpoint or table."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the executors share no folder")
        root = tempfile.mkdtemp(prefix="leafmark-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


_J = f"({derived.oracle('job_event')})"
_PATHS = "p AS (SELECT page_id, url, replace(html, 'ß', 'ss') AS html, 'C:/runs/output/Crew ' || CAST(page_id % 9 AS VARCHAR) || '/DataPage_' || CASE WHEN page_id < 1000 THEN lpad(CAST(page_id AS VARCHAR), 3, '0') ELSE CAST(page_id AS VARCHAR) END || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tif' ELSE '.json' END AS path FROM pages)"
_ESC = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

QUERIES = {f.__name__: f for f in (page_numbers, file_names, image_paths, html_escape, formats, config_signature, json_props, event_counts, job_state, artifact_changes, next_events, last_artifacts, page_state, orders_by_nation, stream_event_counts, stream_changes, stream_page_state, stream_job_states, stream_page_counters)}
ORACLES = {
    "page_numbers": f"""WITH {_PATHS} SELECT page_id, CAST(regexp_extract_all(regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), '[0-9]+')[-1] AS INT) AS last_number, CAST(regexp_extract_all(path, '(?i)(?:page|DataPage_)([0-9]+)', 1)[-1] AS INT) AS tagged_number,
        coalesce(CAST(regexp_extract_all(url, '[0-9]+')[-1] AS INT), 0) AS url_number FROM p""",
    "file_names": f"WITH {_PATHS} SELECT page_id, split_part(path, '/', -1) AS basename, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(path, '\\.[^.]*$')) AS suffix, replace(split_part(path, '/', -2), ' ', '_') AS safe, '/srv/project/output/' || split_part(path, '/output/', 2) AS relocated FROM p",
    "image_paths": f"WITH {_PATHS} SELECT path FROM p WHERE page_id % 3 < 2 ORDER BY path",
    "html_escape": f"WITH {_PATHS} SELECT page_id, sha256({_ESC}) AS escaped_sha256, replace(replace(path, ':', '%3A'), ' ', '%20') AS quoted FROM p",
    "formats": f"WITH {_PATHS} SELECT page_id, CASE WHEN page_id % 10 > 0 THEN printf('%.1f%%', (page_id % 8) / 8.0::DOUBLE * 100) ELSE 'N/A' END AS rate, CASE WHEN page_id % 7 > 0 THEN printf('%.2f s', page_id * 4.0::DOUBLE / 1000) ELSE 'N/A' END AS elapsed FROM p",
    "config_signature": """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || CAST(p_partkey AS VARCHAR) || ',"size":' || CAST(p_size AS VARCHAR) || '}')[1:16] AS signature FROM part""",
    "json_props": "SELECT event_type, count(*) AS events, CAST(sum(coalesce(CAST(props->>'k' AS INT), 0)) AS BIGINT) AS k_sum, CAST(max(CAST(props->>'k' AS INT)) AS BIGINT) AS k_max FROM events GROUP BY 1",
    "event_counts": f"SELECT job_id, type, count(*) AS n FROM {_J} GROUP BY 1, 2",
    "job_state": f"SELECT job_id, max(seq) AS seq, arg_max(item, seq) AS item FROM {_J} WHERE type = 'status' GROUP BY 1",
    "artifact_changes": f"SELECT job_id, item, seq FROM (SELECT *, lag(size * 10 + stamp) OVER (PARTITION BY job_id, item ORDER BY seq) AS b FROM {_J}) WHERE b IS NULL OR b <> size * 10 + stamp",
    "next_events": f"SELECT seq, type FROM {_J} WHERE seq > 5000 ORDER BY seq",
    "last_artifacts": f"SELECT job_id, item, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS k FROM (SELECT job_id, item, max(seq) AS seq FROM {_J} WHERE type = 'artifact' GROUP BY 1, 2)) WHERE k <= 8",
    "page_state": f"SELECT job_id, count(*) FILTER (s = 0) AS valid, count(*) FILTER (s <> 0) AS not_valid FROM (SELECT job_id, item, arg_max(size, seq) AS s FROM {_J} WHERE type = 'mrz_page' GROUP BY 1, 2) GROUP BY 1",
    "orders_by_nation": "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "stream_event_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_page_state": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) AS events FROM events GROUP BY 1, 2",
    "stream_job_states": """WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'recognising' ELSE CASE WHEN event_type = 'purchase' AND value < 2 THEN 'error' END END AS status,
          CASE WHEN event_type = 'purchase' AND value >= 40 THEN 'done' WHEN event_type = 'purchase' AND value < 2 THEN 'error' WHEN event_type IN ('view', 'click') THEN 'status' ELSE 'log' END AS type FROM events),
        k AS (SELECT *, min(seq) FILTER (type = 'done') OVER (PARTITION BY job_id) AS ended FROM e), l AS (SELECT * FROM k WHERE ended IS NULL OR seq <= ended),
        s AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS b FROM l WHERE status IS NOT NULL)
        SELECT job_id, seq, type, status FROM s WHERE b IS NULL OR b <> status
        UNION ALL SELECT job_id, seq, 'done' AS type, CASE WHEN (SELECT arg_max(status, o.seq) FROM l AS o WHERE o.job_id = l.job_id AND o.status IS NOT NULL) = 'error' THEN 'error' ELSE 'done' END AS status FROM l WHERE type = 'done'""",
    "stream_page_counters": """WITH e AS (SELECT user_id AS job_id, event_id AS seq, 'page' || (props->>'k') AS page, value < 10 AS valid FROM events WHERE props->>'k' IS NOT NULL AND value IS NOT NULL),
        c AS (SELECT *, lag(valid) OVER (PARTITION BY job_id, page ORDER BY seq) AS b FROM e),
        d AS (SELECT job_id, seq, page, CASE WHEN valid THEN 1 WHEN b THEN -1 ELSE 0 END AS v, CASE WHEN NOT valid THEN 1 WHEN NOT b THEN -1 ELSE 0 END AS n FROM c WHERE b IS NULL OR b <> valid)
        SELECT job_id, seq, page, CAST(sum(v) OVER w AS BIGINT) AS valid, CAST(sum(n) OVER w AS BIGINT) AS not_valid FROM d WINDOW w AS (PARTITION BY job_id ORDER BY seq)""",
    "stream_changes": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type",
}
