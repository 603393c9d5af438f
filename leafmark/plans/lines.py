"""Queries of the text-line operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import lines as L
from leafmark.sources import derived


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, "ocr_line")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("doc_id") % 29 == 0
    status = F.when(failed, "error").when(F.size("warnings") > 0, "warning").otherwise("ok")
    return L.page_metrics(_lines(spark, sf_dir)).withColumns({"status": status, "elapsed_ms": (F.col("doc_id") * 37 % 1000) / F.lit(10.0), "reused": F.col("doc_id") % 6 == 0})


def ocr_page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.page_metrics(_lines(spark, sf_dir))
    return out.withColumns({"mrz_line_indices": F.concat_ws(",", F.transform("mrz_line_indices", lambda i: i.cast("string"))), "warnings": F.concat_ws(",", "warnings")})


def ocr_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_summary(_pages(spark, sf_dir))


def ocr_candidate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidate_histogram(_pages(spark, sf_dir))


def incomplete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.for_second_pass(_pages(spark, sf_dir)).select("doc_id", "status")


def second_pass_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a second pass over all pages, with their number of candidates."""
    return L.for_second_pass(_pages(spark, sf_dir), all_pages=True).select("doc_id", "mrz_candidate_count")


def mrz_row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.row_clusters(_lines(spark, sf_dir))
    return rows.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), "x", "y", "w", "h", "text", F.round("confidence", 6).alias("confidence"), F.concat_ws(",", F.transform("line_indices", lambda i: i.cast("string"))).alias("line_indices"))


def mrz_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.regions(L.row_clusters(_lines(spark, sf_dir)))


def row_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    found = L.neighbours(L.last_rows(L.row_clusters(lines)), lines)
    return found.select("doc_id", "idx", "text", F.round("cost", 6).alias("cost"))


def direct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.direct_rows(_lines(spark, sf_dir))


def second_pass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return L.second_pass_metrics(lines, L.direct_rows(lines))


def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pieces = turns.select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), F.replace("text", F.lit("ß"), F.lit("ss")).alias("text"), ((F.col("turn") * 13 % 50 + 50) / F.lit(100.0)).alias("confidence"))
    return L.merged_fragments(pieces)


_IN = f"ocr AS ({derived.oracle('ocr_line')}), cl AS (SELECT *, upper(regexp_replace(text, '\\s+', '', 'g')) AS c FROM ocr), al AS (SELECT *, length(regexp_replace(c, '[^A-Z0-9<]', '', 'g')) / greatest(1, length(c)) AS ratio FROM cl)"
_CAND = f"""{_IN}, box AS (
  SELECT doc_id, max(page_height) AS ph, greatest(0, min(x) FILTER (confidence >= 0.5)) AS bx, greatest(0, min(y) FILTER (confidence >= 0.5)) AS by_, least(1000, max(x2) FILTER (confidence >= 0.5)) AS ex, least(max(page_height), max(y2) FILTER (confidence >= 0.5)) AS ey, count(*) FILTER (confidence >= 0.5) AS acc FROM al GROUP BY doc_id
), cand AS (
  SELECT al.*, acc, greatest(0, ex - bx) AS bw, greatest(0, ey - by_) AS bh, length(c) BETWEEN 28 AND 46 AND ratio >= 0.85 AND regexp_matches(c, '[<0-9]')
    AND (x2 - x) / greatest(1, CASE WHEN acc > 0 THEN greatest(0, ex - bx) ELSE 1000 END) >= 0.55 AND y2 >= CASE WHEN acc > 0 THEN by_ + greatest(0, ey - by_) * 0.55::DOUBLE ELSE page_height * 0.55::DOUBLE END AS candidate
  FROM al JOIN box USING (doc_id)
), metric AS (
  SELECT doc_id, count(*) AS line_count, count(*) FILTER (confidence >= 0.5) AS accepted_line_count, round(avg(confidence) FILTER (confidence >= 0.5), 6) AS mean_confidence, round(min(confidence) FILTER (confidence >= 0.5), 6) AS minimum_confidence,
    count(*) FILTER (confidence >= 0.5 AND confidence < 0.75) AS low_confidence_line_count, count(*) FILTER (candidate) AS mrz_candidate_count, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (candidate), '') AS mrz_line_indices,
    CASE WHEN max(acc) > 0 THEN round(max(bw) * max(bh) / (max(page_height) * 1000), 6) ELSE 0.0::DOUBLE END AS content_area_ratio
  FROM cand GROUP BY doc_id
), page AS (
  SELECT *, list_filter([CASE WHEN accepted_line_count = 0 THEN 'ocr_detection_no_text' WHEN mean_confidence < 0.8 THEN 'ocr_recognition_low_confidence' END, CASE mrz_candidate_count WHEN 0 THEN 'mrz_candidate_not_detected' WHEN 1 THEN 'mrz_candidate_incomplete' END], lambda w: w IS NOT NULL) AS warnings
  FROM metric
), run AS (SELECT *, CASE WHEN doc_id % 29 = 0 THEN 'error' WHEN len(warnings) > 0 THEN 'warning' ELSE 'ok' END AS status, (doc_id * 37 % 1000) / 10.0::DOUBLE AS elapsed_ms, doc_id % 6 = 0 AS reused FROM page)"""
_ROWS = f"""{_IN}, abox AS (SELECT doc_id, greatest(0, min(x)) AS bx, greatest(0, min(y)) AS by_, greatest(1, least(1000, max(x2)) - greatest(0, min(x))) AS bw, greatest(1, least(max(page_height), max(y2)) - greatest(0, min(y))) AS bh FROM ocr GROUP BY doc_id),
frag AS (
  SELECT al.*, bx, by_, bw, bh, (y + y2) / 2 AS cy FROM al JOIN abox USING (doc_id)
  WHERE confidence >= 0.35 AND length(c) >= 3 AND ratio >= 0.7 AND (instr(c, '<') > 0 OR (length(c) >= 20 AND regexp_matches(c, '[0-9]'))) AND y2 >= by_ + bh * 0.6::DOUBLE
), gap AS (
  SELECT *, CASE WHEN cy - lag(cy) OVER w > greatest(8, round_even(page_height * 0.015::DOUBLE, 0), round_even((y2 - y) * 1.1::DOUBLE, 0)) THEN 1 ELSE 0 END AS s FROM frag WINDOW w AS (PARTITION BY doc_id ORDER BY cy, idx)
), grp AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY cy, idx ROWS UNBOUNDED PRECEDING) AS g FROM gap
), wide AS (
  SELECT doc_id, g, min(x) AS x, min(y) AS y, greatest(1, max(x2) - min(x)) AS w, greatest(1, max(y2) - min(y)) AS h, string_agg(text, '' ORDER BY x, idx) AS text, avg(confidence) AS confidence, list(idx ORDER BY x, idx) AS line_indices, max(page_height) AS ph, max(bx) AS bx, max(bw) AS bw
  FROM grp GROUP BY doc_id, g
), rws AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS row_no, row_number() OVER (PARTITION BY doc_id ORDER BY g DESC) AS below FROM wide WHERE w / 1000 >= 0.18)"""
_DIRECT = "SELECT doc_id, idx + 1 AS row_index, text AS raw_text, c AS normalized_text, CAST(length(c) AS BIGINT) AS length, confidence FROM al WHERE length(c) BETWEEN 28 AND 46 AND ratio >= 0.65 AND (instr(c, '<') > 0 OR (length(c) = 44 AND regexp_matches(c, '^[A-Z0-9]') AND length(regexp_replace(c, '[^0-9]', '', 'g')) >= 8))"

QUERIES = {f.__name__: f for f in (ocr_page_metrics, ocr_run_summary, ocr_candidate_histogram, incomplete_pages, second_pass_pages, mrz_row_clusters, mrz_region, row_neighbor, direct_rows, second_pass_metrics, fragment_merge)}
ORACLES = {
    "ocr_page_metrics": f"WITH {_CAND} SELECT * REPLACE (array_to_string(warnings, ',') AS warnings) FROM page",
    "ocr_run_summary": f"""WITH {_CAND} SELECT count(*) AS pages, count(*) FILTER (status <> 'error') AS completed, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status <> 'error' AND len(warnings) > 0) AS warnings,
        count(*) FILTER (status <> 'error' AND mrz_candidate_count > 0) AS pages_with_mrz_candidates, count(*) FILTER (status <> 'error' AND mrz_candidate_count > 1) AS pages_with_complete_mrz_candidates,
        count(*) FILTER (status <> 'error' AND list_contains(warnings, 'ocr_detection_no_text')) AS pages_without_text, round(avg(mean_confidence) FILTER (status <> 'error'), 6) AS mean_page_confidence,
        round(coalesce(sum(elapsed_ms), 0), 2) AS total_elapsed_ms, round(coalesce(avg(elapsed_ms), 0), 2) AS mean_elapsed_ms, count(*) FILTER (reused) AS reused_pages FROM run""",
    "ocr_candidate_histogram": f"WITH {_CAND} SELECT mrz_candidate_count, count(*) AS pages FROM run WHERE status <> 'error' GROUP BY mrz_candidate_count",
    "second_pass_pages": f"WITH {_CAND} SELECT doc_id, mrz_candidate_count FROM run",
    "incomplete_pages": f"WITH {_CAND} SELECT doc_id, status FROM run WHERE list_contains(warnings, 'mrz_candidate_incomplete')",
    "mrz_row_clusters": f"WITH {_ROWS} SELECT doc_id, row_no, x, y, w, h, text, round(confidence, 6) AS confidence, array_to_string(line_indices, ',') AS line_indices FROM rws",
    "mrz_region": f"""WITH {_ROWS}, reg AS (
          SELECT doc_id, count(*) AS n_rows, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2, avg(confidence) AS confidence, max(h) AS h, bool_or(instr(text, '<') > 0) AS marked, max(bx) AS bx, max(bw) AS bw, max(ph) AS ph
          FROM rws WHERE below <= 3 GROUP BY doc_id
        ), crop AS (
          SELECT *, greatest(0, least(bx, x1) - 20) AS cx1, least(1000, greatest(bx + bw, x2) + 20) AS cx2, greatest(0, y1 - greatest(8, CAST(round_even(ph * 0.05::DOUBLE, 0) AS INT))) AS cy1,
            least(ph, y2 + greatest(8, CAST(round_even(ph * 0.05::DOUBLE, 0) AS INT))) AS cy2, CAST(round_even(ph * 0.1::DOUBLE, 0) AS INT) AS low
          FROM reg WHERE n_rows > 1 OR (marked AND h >= 16)
        ), top AS (SELECT *, greatest(0, (cy1 + cy2) // 2 - low // 2) AS t FROM crop
        ), edge AS (SELECT *, CASE WHEN cy2 - cy1 < low THEN greatest(0, least(ph, t + low) - low) ELSE cy1 END AS a, CASE WHEN cy2 - cy1 < low THEN least(ph, t + low) ELSE cy2 END AS b FROM top)
        SELECT doc_id, n_rows, round(confidence, 6) AS confidence, cx1 AS x, a AS y, greatest(1, cx2 - cx1) AS w, greatest(1, b - a) AS h FROM edge""",
    "row_neighbor": f"""WITH {_ROWS}, one AS (SELECT doc_id, max(x) AS rx, max(y) AS ry, max(w) AS rw, max(h) AS rh, max(line_indices) AS li, max(ph) AS rph FROM rws WHERE below <= 3 GROUP BY doc_id HAVING count(*) = 1),
        near AS (
          SELECT al.doc_id, idx, text, CASE WHEN y2 <= ry THEN ry - y2 WHEN ry + rh <= y THEN y - ry - rh END AS gap, greatest(24, round_even(rh * 2.25::DOUBLE, 0), round_even(rph * 0.06::DOUBLE, 0)) AS reach, abs((x2 - x) - rw) / 1000 AS off
          FROM al JOIN one USING (doc_id) WHERE rh < greatest(40, round_even(rph * 0.04::DOUBLE, 0)) AND NOT list_contains(li, idx) AND length(c) >= 15 AND confidence >= 0.35 AND ratio >= 0.7
            AND NOT (instr(c, '<') = 0 AND length(c) < 28 AND greatest(1, x2 - x) < rw * 0.75::DOUBLE) AND greatest(0, least(greatest(x + 1, x2), rx + rw) - greatest(x, rx)) / greatest(1, least(greatest(1, x2 - x), rw)) >= 0.55
        ), ranked AS (SELECT *, gap + off AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY gap + off, idx) AS k FROM near WHERE gap BETWEEN 0 AND reach)
        SELECT doc_id, idx, text, round(cost, 6) AS cost FROM ranked WHERE k = 1""",
    "direct_rows": f"WITH {_IN} {_DIRECT}",
    "second_pass_metrics": f"""WITH {_IN}, d AS ({_DIRECT}), p AS (
          SELECT doc_id, count(*) AS line_count, count(*) FILTER (length(c) BETWEEN 28 AND 46 AND ratio >= 0.85) AS mrz_like_line_count, round(avg(confidence), 6) AS mean_confidence, round(avg(confidence) FILTER (length(c) BETWEEN 28 AND 46 AND ratio >= 0.85), 6) AS mrz_like_confidence FROM al GROUP BY doc_id
        ), o AS (SELECT doc_id, count(*) AS row_count, count(*) FILTER (length > 0) AS rows_with_text, count(*) > 1 AND count(DISTINCT length) = 1 AS same, round(avg(confidence), 6) AS row_mean_confidence FROM d GROUP BY doc_id)
        SELECT doc_id, line_count, mrz_like_line_count, mean_confidence, mrz_like_confidence, coalesce(row_count, 0) AS row_count, coalesce(rows_with_text, 0) AS rows_with_text, coalesce(same, false) AS row_lengths_equal, row_mean_confidence FROM p LEFT JOIN o USING (doc_id)""",
    "fragment_merge": """WITH p AS (SELECT conv_id AS key, turn, regexp_replace(replace(text, 'ß', 'ss'), '\\s+', '', 'g') AS t, (turn * 13 % 50 + 50) / 100.0::DOUBLE AS confidence FROM conversations),
        m AS (SELECT key, string_agg(t, '' ORDER BY turn, t) AS raw_text, count(*) AS fragment_count, round(avg(confidence), 6) AS confidence FROM p GROUP BY key)
        SELECT key, raw_text, regexp_replace(upper(raw_text), '[^A-Z0-9<]', '', 'g') AS normalized_text, fragment_count, confidence FROM m""",
}
