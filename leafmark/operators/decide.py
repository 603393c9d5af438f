"""Ordered decisions and choices of the best."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Acceptance:
    """Fixed thresholds of the acceptance cascade."""

    threshold: float = 58.0
    layout_final: float = 55.0
    layout_portrait: float = 90.0
    layout_layout: float = 65.0
    face_final: float = 50.0
    face_portrait: float = 85.0
    face_layout: float = 65.0
    face_eye: float = 0.80
    narrative_lines: int = 50
    narrative_eye: float = 0.20
    narrative_mrz: float = 10.0
    face_bonus: float = 12.0


def acceptance(scores: DataFrame, config: Acceptance = Acceptance()) -> DataFrame:
    """The scores (final, portrait, layout, mrz_texture, eye_quality, line_count) with accepted and path. The order of the tests matters."""
    c = F.col
    eye, lines = F.coalesce("eye_quality", F.lit(0.0)), F.coalesce("line_count", F.lit(0.0))
    path = (
        F.when((lines >= config.narrative_lines) & (eye <= config.narrative_eye) & (c("mrz_texture") <= config.narrative_mrz), "narrative_page_rejection")
        .when(c("final") >= config.threshold, "standard_threshold")
        .when((c("final") >= config.layout_final) & (c("portrait") >= config.layout_portrait) & (c("layout") >= config.layout_layout), "strong_portrait_layout_fallback")
        .when((c("final") >= config.face_final) & (c("portrait") >= config.face_portrait) & (c("layout") >= config.face_layout) & (eye >= config.face_eye), "verified_face_layout_fallback")
        .otherwise("low_confidence")
    )
    out = scores.withColumns({"path": path, "selection_score": c("final") + config.face_bonus * eye})
    return out.withColumn("accepted", ~c("path").isin("narrative_page_rejection", "low_confidence"))


def best(rows: DataFrame, key: str, score: str, place: str) -> DataFrame:
    """The row of each key with the highest score, the first place of equals."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), place))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank")


def with_runner_up(rows: DataFrame, key: str, score: str, place: str) -> DataFrame:
    """best() with the second score and the lead over it (null for a single row)."""
    order = Window.partitionBy(key).orderBy(F.desc(score), place)
    out = rows.withColumns({"rank": F.row_number().over(order), "runner_up": F.lead(score).over(order)})
    return out.where("rank = 1").withColumn("lead_score", F.col(score) - F.col("runner_up")).drop("rank")


def orientation(scores: DataFrame, key: str = "key", angle: str = "angle", score: str = "score", gain: float = 0.07) -> DataFrame:
    """The angle of the best score, 0 unless it gains enough over 0; confidence from the lead over the best other angle."""
    order = Window.partitionBy(key).orderBy(F.desc(score), angle)
    out = scores.withColumns({"rank": F.row_number().over(order), "runner": F.lead(score).over(order), "zero": F.max(F.when(F.col(angle) == 0, F.col(score))).over(Window.partitionBy(key))})
    out = out.where("rank = 1").withColumn("chosen", F.when(F.col(score) - F.col("zero") < gain, F.lit(0)).otherwise(F.col(angle)))
    lead = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(score) - F.col("runner") + 0.05) / 0.35))
    return out.select(key, F.col("chosen").cast("int").alias("angle"), F.round(lead, 6).alias("confidence"))


def ranked_variant(rows: DataFrame, key: str) -> DataFrame:
    """The original row of each key unless its variant ranks strictly higher: exact length, marker plus confidence, allowed ratio."""
    rank = F.struct("exact", "marked", "ratio")
    return rows.withColumn("rank", rank).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rank"), "variant"))).where("k = 1").drop("rank", "k")


def fallback_level(levels: DataFrame, key: str, level: str, safe: str) -> DataFrame:
    """The first safe level of each key, else its last."""
    return levels.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(safe), F.col(level))), F.max(level)).alias(level))


def eye_pairs(eyes: DataFrame, key: str = "key", x_range: tuple = (0.12, 0.88), y_range: tuple = (0.18, 0.58), apart: tuple = (0.18, 0.62), level: float = 0.16) -> DataFrame:
    """The best quality over all pairs of eyes (key, i, x, y as shares of the face), 0 without a fitting pair."""
    inside = F.col("x").between(*x_range) & F.col("y").between(*y_range)
    good = eyes.where(inside)
    other = good.select(F.col(key).alias("key_b"), F.col("i").alias("i_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    gap, drop = F.abs(F.col("x") - F.col("x_b")), F.abs(F.col("y") - F.col("y_b"))
    pairs = good.join(other, (F.col(key) == F.col("key_b")) & (F.col("i") < F.col("i_b")) & gap.between(*apart) & (drop <= level))
    quality = 0.65 * (1 - drop / level) + 0.35 * (1 - F.least(F.lit(1.0), F.abs((F.col("y") + F.col("y_b")) / 2 - 0.38) / 0.20))
    found = pairs.groupBy(key).agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))).alias("quality"))
    return eyes.select(key).distinct().join(found, key, "left").select(key, F.round(F.coalesce("quality", F.lit(0.0)), 6).alias("quality"))
