"""Queries of validation, decisions and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import decide as D
from leafmark.operators import validate as V
from leafmark.sources import derived


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predictions, reviews = (derived.view(spark, sf_dir, n) for n in ("ground_truth", "prediction", "review_event"))
    return V.verdicts(V.matched(truth, predictions, reviews))


def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest_reviews(derived.view(spark, sf_dir, "review_event"))


def validate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("source_file", "source_page", "result", "reason", "note", F.concat_ws(",", "flags").alias("flags"), "detection_correct")


def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(_judged(spark, sf_dir))


def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.failures_by_reason(_judged(spark, sf_dir))


def failure_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.failure_archive(_judged(spark, sf_dir))


def promoted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.promotable(_judged(spark, sf_dir))


def elapsed_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean elapsed time over pages with a prediction, 0 without any."""
    return _judged(spark, sf_dir).agg(F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)), 6).alias("mean_ms"), F.count("elapsed_ms").alias("pages"))


def labels_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the source files that have a rejected review (semi join)."""
    bad = derived.view(spark, sf_dir, "review_event").where("review = 'incorrect'").select("source_file").distinct()
    return derived.view(spark, sf_dir, "ground_truth").join(bad, "source_file", "left_semi")


def unlabelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted pages without a label (anti join)."""
    labelled = derived.view(spark, sf_dir, "ground_truth").select(F.col("source_page").alias("page"))
    return derived.view(spark, sf_dir, "prediction").join(labelled, "page", "left_anti").select("document", "page")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    share = lambda k, m: (F.pmod(F.col("doc_id") * k + F.col("n_chars"), F.lit(m))).cast("double")
    return docs.select("doc_id", share(7, 101).alias("portrait"), share(3, 31).alias("mrz_texture"), share(11, 101).alias("layout"), (share(5, 41) + 35).alias("final"), (share(13, 11) / 10).alias("eye_quality"), share(2, 97).alias("line_count"))


def acceptance_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.acceptance(_scores(spark, sf_dir)).select("doc_id", "accepted", "path", F.round("selection_score", 6).alias("selection_score"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumn("place", F.struct("l_linenumber", "l_partkey"))
    return D.best(parts, "l_orderkey", "l_quantity", "place").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumn("place", F.struct("l_linenumber", "l_partkey"))
    return D.with_runner_up(parts, "l_orderkey", "l_quantity", "place").select("l_orderkey", F.col("l_quantity").alias("best"), "runner_up", "lead_score")


def page_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("angle"))
    return D.orientation(docs.withColumn("score", F.pmod(F.col("key") * 37 + F.col("angle") * 7, F.lit(101)) / F.lit(100.0)))


def safe_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("level"), (F.col("l_quantity") > 30).alias("safe"))
    return D.fallback_level(rows, "l_orderkey", "level", "safe")


def eye_pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.explode(F.array(*map(F.lit, range(5)))).alias("i"))
    share = lambda a, b: F.pmod(F.col("key") * a + F.col("i") * b, F.lit(100)) / F.lit(100.0)
    return D.eye_pairs(vectors.select("key", "i", share(17, 29).alias("x"), share(7, 3).alias("y")))


_T, _P, _R = (f"({derived.oracle(n)})" for n in ("ground_truth", "prediction", "review_event"))
_NAME = "regexp_replace(regexp_replace(split_part(t.source_file, '/', 2), '\\.[^.]*$', ''), '[^A-Za-z0-9_]+', '_', 'g')"
_JUDGED = f"""lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, source_page ORDER BY seq DESC) AS k FROM {_R}) WHERE k = 1),
m AS (
  SELECT t.*, {_NAME} AS document, p.selected, p.rotation AS pr, p.page, p.score_1, p.score_2, p.ocr_safe, p.elapsed_ms, r.review, r.failure_reason, r.has_quality, r.page_complete, r.portrait_complete, r.mrz_complete, r.ocr_ready
  FROM {_T} AS t LEFT JOIN {_P} AS p ON p.document = regexp_replace(regexp_replace(split_part(t.source_file, '/', 2), '\\.[^.]*$', ''), '[^A-Za-z0-9_]+', '_', 'g') AND p.page = t.source_page
  LEFT JOIN lr AS r ON r.source_file = t.source_file AND r.source_page = t.source_page
), j AS (
  SELECT *, CASE WHEN page IS NULL THEN ['automatic_fail', 'unknown', 'Missing pipeline output']
    WHEN review = 'correct' AND contains_data_page AND has_quality AND NOT (page_complete AND portrait_complete AND mrz_complete AND ocr_ready) THEN ['verified_fail', 'crop', 'Selection confirmed but output is not OCR ready']
    WHEN review = 'correct' THEN ['verified_pass', NULL, 'Confirmed by reviewer'] WHEN review IS NOT NULL THEN ['verified_fail', coalesce(failure_reason, 'unknown'), 'Rejected by reviewer']
    WHEN NOT contains_data_page AND selected THEN ['automatic_fail', 'classifier', 'False positive on a non-data page'] WHEN NOT contains_data_page THEN ['automatic_pass', NULL, 'Correctly rejected']
    WHEN NOT selected THEN ['automatic_fail', CASE WHEN pr <> rotation THEN 'rotation' ELSE 'classifier' END, 'Data page was not selected'] WHEN pr <> rotation THEN ['automatic_fail', 'rotation', 'Incorrect cardinal orientation']
    ELSE ['candidate', NULL, 'Detection and rotation pass; image crop requires Review confirmation'] END AS v, coalesce(selected = contains_data_page, false) AS ok,
    contains_data_page AND review IS NOT NULL AND coalesce(has_quality, false) AS rated
  FROM m
)"""
_SUMMARY = """SELECT count(*) AS pages, count(*) FILTER (ok) AS detection_correct, count(*) FILTER (v[1] = 'candidate') AS candidates_pending_review, count(*) FILTER (v[1] = 'automatic_pass') AS automatic_passes,
  count(*) FILTER (v[1] LIKE '%fail') AS failures, count(*) FILTER (review IS NOT NULL) AS reviews, count(*) FILTER (v[1] = 'verified_pass') AS verified_correct, count(*) FILTER (rated) AS quality_reviews,
  count(*) FILTER (rated AND page_complete AND portrait_complete AND mrz_complete) AS crop_complete, count(*) FILTER (rated AND mrz_complete) AS mrz_complete, count(*) FILTER (rated AND portrait_complete) AS portrait_complete,
  count(*) FILTER (rated AND page_complete AND portrait_complete AND mrz_complete AND ocr_ready) AS ocr_ready FROM j"""
_BEST = "SELECT *, row_number() OVER w AS k, lead(l_quantity) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey)"

QUERIES = {f.__name__: f for f in (latest_review, validate_pages, validate_summary, failure_taxonomy, failure_folders, promoted_pages, elapsed_per_page, labels_of_sources, unlabelled_runs, acceptance_decision, select_candidate, runner_up, page_orientation, safe_level, eye_pair_quality)}
ORACLES = {
    "latest_review": f"WITH {_JUDGED} SELECT * EXCLUDE (k) FROM lr",
    "validate_pages": f"WITH {_JUDGED} SELECT source_file, source_page, v[1] AS result, v[2] AS reason, v[3] AS note, CASE WHEN page IS NULL THEN '' ELSE concat_ws(',', CASE WHEN abs(score_1 - score_2) <= 5 THEN 'multiple_candidates' END, CASE WHEN NOT ocr_safe THEN 'normalization_warning' END) END AS flags, ok AS detection_correct FROM j",
    "validate_summary": f"""WITH {_JUDGED}, s AS ({_SUMMARY}) SELECT *, coalesce(round(detection_correct / nullif(pages, 0), 6), 0) AS detection_accuracy, round(verified_correct / nullif(reviews, 0), 6) AS verified_accuracy, round(crop_complete / nullif(quality_reviews, 0), 6) AS crop_completeness,
        round(mrz_complete / nullif(quality_reviews, 0), 6) AS mrz_completeness, round(portrait_complete / nullif(quality_reviews, 0), 6) AS portrait_completeness, round(ocr_ready / nullif(quality_reviews, 0), 6) AS ocr_ready_rate FROM s""",
    "failure_taxonomy": f"WITH {_JUDGED} SELECT CAST(list_position(['classifier', 'rotation', 'segmentation', 'crop', 'ocr', 'unknown'], v[2]) - 1 AS INT) AS place, v[2] AS reason, count(*) AS pages FROM j WHERE v[1] LIKE '%fail' GROUP BY ALL",
    "failure_folders": f"WITH {_JUDGED} SELECT source_file, source_page, 'failed/' || coalesce(v[2], 'unknown') || '/' || document || '/page' || CASE WHEN source_page < 1000 THEN lpad(CAST(source_page AS VARCHAR), 3, '0') ELSE CAST(source_page AS VARCHAR) END AS folder FROM j WHERE v[1] LIKE '%fail'",
    "promoted_pages": f"WITH {_JUDGED} SELECT source_file, source_page FROM j WHERE review = 'correct' AND contains_data_page AND (NOT has_quality OR (page_complete AND portrait_complete AND mrz_complete AND ocr_ready))",
    "elapsed_per_page": f"WITH {_JUDGED} SELECT round(coalesce(avg(elapsed_ms), 0), 6) AS mean_ms, count(elapsed_ms) AS pages FROM j",
    "labels_of_sources": f"SELECT * FROM {_T} WHERE source_file IN (SELECT source_file FROM {_R} WHERE review = 'incorrect')",
    "unlabelled_runs": f"SELECT document, page FROM {_P} WHERE page NOT IN (SELECT source_page FROM {_T})",
    "acceptance_decision": """WITH s AS (SELECT doc_id, (doc_id * 7 + n_chars) % 101 AS p, (doc_id * 3 + n_chars) % 31 AS m, (doc_id * 11 + n_chars) % 101 AS l, (doc_id * 5 + n_chars) % 41 + 35 AS f, ((doc_id * 13 + n_chars) % 11) / 10 AS e, (doc_id * 2 + n_chars) % 97 AS c FROM documents),
        d AS (SELECT *, CASE WHEN c >= 50 AND e <= 0.2::DOUBLE AND m <= 10 THEN 'narrative_page_rejection' WHEN f >= 58 THEN 'standard_threshold' WHEN f >= 55 AND p >= 90 AND l >= 65 THEN 'strong_portrait_layout_fallback' WHEN f >= 50 AND p >= 85 AND l >= 65 AND e >= 0.8::DOUBLE THEN 'verified_face_layout_fallback' ELSE 'low_confidence' END AS path FROM s)
        SELECT doc_id, path NOT IN ('narrative_page_rejection', 'low_confidence') AS accepted, path, round(f + 12 * e, 6) AS selection_score FROM d""",
    "select_candidate": f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM ({_BEST}) WHERE k = 1",
    "runner_up": f"SELECT l_orderkey, l_quantity AS best, nxt AS runner_up, l_quantity - nxt AS lead_score FROM ({_BEST}) WHERE k = 1",
    "page_orientation": """WITH s AS (SELECT doc_id AS key, angle, ((doc_id * 37 + angle * 7) % 101) / 100 AS score FROM documents, (VALUES (0), (90), (180), (270)) AS a(angle)),
        r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt, max(score) FILTER (angle = 0) OVER (PARTITION BY key) AS zero FROM s WINDOW w AS (PARTITION BY key ORDER BY score DESC, angle))
        SELECT key, CAST(CASE WHEN score - zero < 0.07::DOUBLE THEN 0 ELSE angle END AS INT) AS angle, round(greatest(0, least(1, (score - nxt + 0.05::DOUBLE) / 0.35::DOUBLE)), 6) AS confidence FROM r WHERE k = 1""",
    "safe_level": "SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (l_quantity > 30), max(l_linenumber)) AS level FROM lineitem GROUP BY 1",
    "eye_pair_quality": """WITH e AS (SELECT vec_id AS key, i, ((vec_id * 17 + i * 29) % 100) / 100 AS x, ((vec_id * 7 + i * 3) % 100) / 100 AS y FROM embeddings, range(5) AS n(i)), g AS (SELECT * FROM e WHERE x BETWEEN 0.12::DOUBLE AND 0.88::DOUBLE AND y BETWEEN 0.18::DOUBLE AND 0.58::DOUBLE),
        q AS (SELECT a.key, max(greatest(0, least(1, 0.65::DOUBLE * (1 - abs(a.y - b.y) / 0.16::DOUBLE) + 0.35::DOUBLE * (1 - least(1, abs((a.y + b.y) / 2 - 0.38::DOUBLE) / 0.2::DOUBLE))))) AS q FROM g AS a JOIN g AS b ON a.key = b.key AND a.i < b.i AND abs(a.x - b.x) BETWEEN 0.18::DOUBLE AND 0.62::DOUBLE AND abs(a.y - b.y) <= 0.16::DOUBLE GROUP BY 1)
        SELECT vec_id AS key, round(coalesce(q, 0), 6) AS quality FROM embeddings LEFT JOIN q ON vec_id = key""",
}
