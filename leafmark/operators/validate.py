"""Validation of a run against labels and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import safe_name, stem

#: Reasons of failures, in the order of reports (fixed values).
REASONS = ("classifier", "rotation", "segmentation", "crop", "ocr", "unknown")
QUALITY = ("page_complete", "portrait_complete", "mrz_complete", "ocr_ready")
#: The notes of verdicts (fixed values).
MISSING = "Missing pipeline output"
NOT_READY = "Selection confirmed but output is not OCR ready"
CONFIRMED = "Confirmed by reviewer"
REJECTED = "Rejected by reviewer"
FALSE_POSITIVE = "False positive on a non-data page"
CORRECTLY_REJECTED = "Correctly rejected"
NOT_SELECTED = "Data page was not selected"
TURNED = "Incorrect cardinal orientation"
CANDIDATE = "Detection and rotation pass; image crop requires Review confirmation"


def latest_reviews(events: DataFrame) -> DataFrame:
    """The last review event of each page (source_file, source_page, seq)."""
    last = F.row_number().over(Window.partitionBy("source_file", "source_page").orderBy(F.desc("seq")))
    return events.withColumn("last", last).where("last = 1").drop("last")


def matched(truth: DataFrame, predictions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels with their prediction (by the file-safe stem of the source and the page) and latest review, where there are any."""
    keyed = truth.withColumn("document", safe_name(stem(F.col("source_file"))))
    found = predictions.withColumnsRenamed({"rotation": "predicted_rotation"}).withColumn("predicted", F.lit(True))
    out = keyed.join(found, (keyed.document == found.document) & (keyed.source_page == found.page), "left").drop(found.document)
    return out.join(latest_reviews(reviews).drop("seq"), ["source_file", "source_page"], "left")


def flags(margin: float = 5.0) -> Column:
    close = F.abs(F.col("score_1") - F.col("score_2")) <= margin
    return F.array_compact(F.array(F.when(close, "multiple_candidates"), F.when(~F.col("ocr_safe"), "normalization_warning")))


def verdicts(pages: DataFrame) -> DataFrame:
    """matched() pages with result, reason, note, flags and detection_correct. Reviews outrank everything but a missing prediction."""
    whole = F.col(QUALITY[0])
    for q in QUALITY[1:]:
        whole = whole & F.col(q)
    data, selected = F.col("contains_data_page"), F.col("selected")
    turned = F.col("predicted_rotation") != F.col("rotation")
    say = lambda result, reason, note: F.struct(F.lit(result).alias("result"), (reason if isinstance(reason, Column) else F.lit(reason).cast("string")).alias("reason"), F.lit(note).alias("note"))
    verdict = (
        F.when(F.col("predicted").isNull(), say("automatic_fail", "unknown", MISSING))
        .when((F.col("review") == "correct") & data & F.col("has_quality") & ~whole, say("verified_fail", "crop", NOT_READY))
        .when(F.col("review") == "correct", say("verified_pass", None, CONFIRMED))
        .when(F.col("review").isNotNull(), say("verified_fail", F.coalesce("failure_reason", F.lit("unknown")), REJECTED))
        .when(~data & selected, say("automatic_fail", "classifier", FALSE_POSITIVE))
        .when(~data, say("automatic_pass", None, CORRECTLY_REJECTED))
        .when(~selected, say("automatic_fail", F.when(turned, "rotation").otherwise("classifier"), NOT_SELECTED))
        .when(turned, say("automatic_fail", "rotation", TURNED))
        .otherwise(say("candidate", None, CANDIDATE))
    )
    out = pages.withColumn("verdict", verdict)
    right = F.coalesce(selected == data, F.lit(False))
    return out.select(*pages.columns, "verdict.result", "verdict.reason", "verdict.note", F.when(F.col("predicted"), flags()).otherwise(F.array().cast("array<string>")).alias("flags"), right.alias("detection_correct"))


def summary(judged: DataFrame) -> DataFrame:
    """Counters and rates of a run; rates of nothing are null, but for detection, which is 0."""
    rated = F.col("contains_data_page") & F.col("review").isNotNull() & F.coalesce("has_quality", F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = judged.agg(
        F.count(F.lit(1)).alias("pages"),
        count(F.col("detection_correct")).alias("detection_correct"),
        count(F.col("result") == "candidate").alias("candidates_pending_review"),
        count(F.col("result") == "automatic_pass").alias("automatic_passes"),
        count(F.col("result").endswith("fail")).alias("failures"),
        count(F.col("review").isNotNull()).alias("reviews"),
        count(F.col("result") == "verified_pass").alias("verified_correct"),
        count(rated).alias("quality_reviews"),
        count(rated & F.col("page_complete") & F.col("portrait_complete") & F.col("mrz_complete")).alias("crop_complete"),
        count(rated & F.col("mrz_complete")).alias("mrz_complete"),
        count(rated & F.col("portrait_complete")).alias("portrait_complete"),
        count(rated & F.col("page_complete") & F.col("portrait_complete") & F.col("mrz_complete") & F.col("ocr_ready")).alias("ocr_ready"),
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return out.withColumns({
        "detection_accuracy": F.coalesce(rate("detection_correct", "pages"), F.lit(0.0)), "verified_accuracy": rate("verified_correct", "reviews"), "crop_completeness": rate("crop_complete", "quality_reviews"),
        "mrz_completeness": rate("mrz_complete", "quality_reviews"), "portrait_completeness": rate("portrait_complete", "quality_reviews"), "ocr_ready_rate": rate("ocr_ready", "quality_reviews"),
    })


def failures_by_reason(judged: DataFrame) -> DataFrame:
    """Failed pages of each reason that has any, in the order of the reasons."""
    spark = judged.sparkSession
    domain = F.broadcast(spark.createDataFrame(list(enumerate(REASONS)), "place int, reason string"))  # a fixed list
    return judged.where(F.col("result").endswith("fail")).groupBy("reason").agg(F.count(F.lit(1)).alias("pages")).join(domain, "reason").select("place", "reason", "pages")


def failure_archive(judged: DataFrame) -> DataFrame:
    """Where failed pages are kept: failed/<reason>/<data set>/page###."""
    dataset = safe_name(stem(F.col("source_file")))
    page = F.concat(F.lit("page"), F.when(F.col("source_page") < 1000, F.lpad(F.col("source_page").cast("string"), 3, "0")).otherwise(F.col("source_page").cast("string")))
    return judged.where(F.col("result").endswith("fail")).select("source_file", "source_page", F.concat_ws("/", F.lit("failed"), F.coalesce("reason", F.lit("unknown")), dataset, page).alias("folder"))


def promotable(judged: DataFrame) -> DataFrame:
    """Pages whose image becomes the expected one: confirmed, with a data page, and of full quality or without a quality review."""
    whole = F.col("page_complete") & F.col("portrait_complete") & F.col("mrz_complete") & F.col("ocr_ready")
    return judged.where((F.col("review") == "correct") & F.col("contains_data_page") & (~F.col("has_quality") | whole)).select("source_file", "source_page")


def seeded_labels(spec: DataFrame, excluded: DataFrame | None = None, rotations: DataFrame | None = None, remarks: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Labels of every page of a spec (dataset, pages): excluded ones (dataset, page) have no data page; rotations and remarks
    where given (dataset, page, value), else 0 and empty; labels that are known (dataset, page) stay as they are and are left out."""
    key = ["dataset", "page"]
    out = spec.where("pages >= 1").select("dataset", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    if excluded is not None:
        out = out.join(excluded.select(*key).distinct().withColumn("out", F.lit(True)), key, "left")
    for name, given in (("rotation", rotations), ("remarks", remarks)):
        if given is not None:
            out = out.join(given.select(*key, F.col("value").alias(name)), key, "left")
    if known is not None:
        out = out.join(known.select(*key), key, "left_anti")
    column = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in out.columns else F.lit(default)
    data = ~column("out", False)
    return out.select(*key, data.alias("contains_data_page"), data.cast("int").alias("expected_pages"), F.pmod(column("rotation", 0), F.lit(360)).alias("rotation"), column("remarks", "").alias("remarks"))


def first_label(pages: DataFrame, truth: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The pages with the first label, by order, of their keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return pages.join(truth.withColumn("rank", rank).where("rank = 1").drop("rank"), keys)


def with_runs(truth: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The labels whose page has a run."""
    return truth.join(runs.select(*keys).distinct(), keys, "left_semi")


def successful_pages(predictions: DataFrame, by: str = "document") -> DataFrame:
    """The pages of each document, and those with a selected data page."""
    return predictions.groupBy(by).agg(F.count(F.lit(1)).alias("pages"), F.count_if("selected").alias("successful"))
