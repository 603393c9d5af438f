"""Scores, filters and decisions over measured features: columns in, columns out."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Fixed weights of the page score."""

    portrait: float = 0.38
    mrz: float = 0.14
    layout: float = 0.24
    text: float = 0.19
    rotation: float = 0.05


def clamped(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def final_score(weights: Weights = Weights()) -> Column:
    """Weighted sum of the features portrait, mrz, layout, text and rotation (none: 0), from 0 to 100."""
    terms = {"portrait": weights.portrait, "mrz": weights.mrz, "layout": weights.layout, "text": weights.text}
    total = F.coalesce("rotation", F.lit(0.0)) * weights.rotation
    for name, w in terms.items():
        total = total + F.col(name) * w
    return clamped(total)


def layout_score(height: str = "height") -> Column:
    """What portrait, text and MRZ texture say together: a weighted base, and bonuses for their places (portrait_y, portrait_h and first_band_y may be null)."""
    base = (0.45 * F.col("portrait") + 0.30 * F.col("text") + 0.25 * F.col("mrz")) / 100
    bonus = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0.0)
    placed = bonus(F.col("portrait_y") < F.col(height) * 0.82, 0.22) + bonus(F.col("first_band_y") > F.col("portrait_y") + F.col("portrait_h"), 0.18) + bonus((F.col("portrait") >= 65) & (F.col("text") >= 50), 0.12)
    return F.least(F.lit(100.0), (base + placed) * 100)


def deskewed(pages: DataFrame, least: float = 1.0, most: float = 6.0, sure: float = 0.65, improvement: float = 0.20) -> DataFrame:
    """Pages (estimate, confidence, residual after turning) with the angle applied, the residual left and a warning."""
    size = F.abs("estimate")
    tried = size.between(least, most) & (F.col("confidence") >= sure)
    kept = tried & (size - F.abs("residual") >= size * improvement)
    warning = F.when(kept, None).when(tried, "deskew_reverted_no_measured_improvement").when(size >= least, "deskew_skipped_low_confidence")
    return pages.withColumns({"applied": F.when(kept, F.col("estimate")).otherwise(0.0), "left": F.when(kept, F.col("residual")).otherwise(F.col("estimate")), "warning": warning})


def document_box(contours: DataFrame, key: str, place: str, page_area: float, low: float = 0.20, high: float = 0.995, rectangular: float = 0.58) -> DataFrame:
    """The best contour (area, w, h) of each key by size and rectangularity, the first of equals."""
    box = F.col("w") * F.col("h")
    ratio, shape = box / page_area, F.col("area") / F.greatest(F.lit(1), box)
    fits = contours.where((F.col("area") > 0) & ratio.between(low, high) & (shape >= rectangular)).withColumn("score", ratio * 0.7 + shape * 0.3)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), place))
    return fits.withColumn("rank", rank).where("rank = 1").drop("rank")


def horizontal_share(components: DataFrame, key: str, page_width: float) -> DataFrame:
    """Share of the area that lies in components (area, w, h) much wider than high."""
    wide = (F.col("w") >= F.col("h") * 1.6) & (F.col("w") >= page_width * 0.025)
    return components.groupBy(key).agg((F.sum(F.when(wide, F.col("area")).otherwise(0)) / F.greatest(F.lit(1), F.sum("area"))).alias("share"))


def protected_near_edge(rects: Column, segment: Column, safe: Column) -> Column:
    """Whether a protected rectangle, placed in its segment, comes closer to the safe box's edge than the guard; false without any."""
    guard = F.greatest(F.lit(15), F.bround(F.least(safe["w"], safe["h"]) * 0.015))

    def close(r: Column) -> Column:
        x, y = segment["x"] + r["x"] - safe["x"], segment["y"] + r["y"] - safe["y"]
        return F.least(x, y, safe["w"] - x - r["w"], safe["h"] - y - r["h"]) < guard

    return F.exists(F.array_compact(rects), close)


def portrait_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles that can be portraits: by area, aspect and place."""
    area, aspect = F.col("w") * F.col("h") / (width * height), F.col("w") / F.greatest(F.lit(1), F.col("h"))
    return boxes.where(area.between(0.018, 0.34) & aspect.between(0.45, 1.35) & (F.col("y") <= 0.82 * height))


def texture_bands(bands: DataFrame, height: int) -> DataFrame:
    """Bands (start, end, ink, coverage) that look like machine-readable text."""
    tall = F.col("end") - F.col("start")
    return bands.where(tall.between(2, max(2, int(height * 0.075))) & (F.col("ink") >= 0.03) & (F.col("coverage") >= 0.52))


def chosen_pages(pages: DataFrame, numbers: list[int] | None, limit: int | None, *order: str) -> DataFrame:
    """The pages of these numbers (None: all), the first `limit` of them in order (negative: none)."""
    out = pages.where(F.col("page").isin(numbers)) if numbers is not None else pages
    return out.orderBy(*order) if limit is None else out.orderBy(*order).limit(max(0, limit))


def merged_config(known: dict, given: dict, path: str = "") -> dict:
    """The defaults with the values given; a key that the defaults do not have fails."""
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown configuration keys: {', '.join(path + k for k in unknown)}")
    return {k: merged_config(v, given[k] or {}, f"{path}{k}.") if isinstance(v, dict) and k in given else given.get(k, v) for k, v in known.items()}


def faces(boxes: DataFrame, width: int, height: int, most: float = 0.12, lowest: float = 0.83) -> DataFrame:
    """The boxes (x, y, w, h) that can be faces of a page: by their share of it, and not too low."""
    share = F.col("w") * F.col("h") / (width * height)
    return boxes.where(share.between(0.001, most) & (F.col("y") <= height * lowest))


def line_seam(segments: DataFrame, length: int, across: int, start: float = 0.28, end: float = 0.72, degrees: float = 5.0) -> DataFrame:
    """For each key the segment (x1, y1, x2, y2) that best parts the axis x: nearly upright, in the middle, long, near the
    centre; the first (least i) of equals. Half values round to even."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    seam = F.bround((F.col("x1") + F.col("x2")) / 2).cast("int")
    rows = segments.where(~(dx > dy * math.tan(math.radians(degrees)))).select("key", "i", seam.alias("seam"), (dy / across).alias("covered"))
    rows = rows.where((F.col("seam") >= int(length * start)) & (F.col("seam") < int(length * end)))
    rows = rows.withColumn("score", F.col("covered") - F.abs(F.col("seam") - length / 2) / (length / 2) * 0.08).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "i"))
    return rows.withColumn("rank", rank).where("rank = 1").select("key", "seam", F.round("score", 6).alias("score"))


def text_bands(boxes: DataFrame, width: int, height: int, long_line: float = 0.58) -> DataFrame:
    """For each key the number of boxes that can be lines, and the shares of long ones and of those of a field's length."""
    share = F.col("w") / width
    lines = boxes.where((F.col("h") >= max(2, height * 0.003)) & (F.col("w") >= width * 0.025))
    of = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return lines.groupBy("key").agg(F.count(F.lit(1)).alias("line_count"), of(share >= long_line).alias("long_line_ratio"), of((share >= 0.06) & (share < long_line)).alias("field_line_ratio"))
