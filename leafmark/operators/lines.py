"""Text-line geometry: page metrics, row clusters, regions and neighbouring rows.

Lines have doc_id, idx, text, confidence, the extents x, y, x2, y2 of their polygon (null without one) and page_height; pages are
`page_width` wide. Every operator keeps to one partitioning by page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import allowed_ratio, compact


@dataclass(frozen=True)
class LineConfig:
    """Fixed thresholds of recognition and location."""

    page_width: int = 1000
    accept: float = 0.50
    low: float = 0.75
    low_mean: float = 0.80
    shortest: int = 28
    longest: int = 46
    candidate_ratio: float = 0.85
    candidate_width: float = 0.55
    candidate_from: float = 0.55
    fragment_confidence: float = 0.35
    fragment_ratio: float = 0.70
    fragment_from: float = 0.60
    y_tolerance: float = 0.015
    row_width: float = 0.18
    row_height: int = 8
    rows: int = 3
    pad_x: float = 0.02
    pad_y: float = 0.05
    least_height: float = 0.10
    direct_ratio: float = 0.65


CONFIG = LineConfig()


def _content(lines: DataFrame, accepted, config: LineConfig, least: int) -> DataFrame:
    """The lines with bx, by, bw, bh: the box of the lines that count, clipped to the page; null without any."""
    page = Window.partitionBy("doc_id")
    box = lambda f, c: f(F.when(accepted, F.col(c))).over(page)
    out = lines.withColumns({"bx": F.greatest(F.lit(0), box(F.min, "x")), "by": F.greatest(F.lit(0), box(F.min, "y")), "ex": F.least(F.lit(config.page_width), box(F.max, "x2")), "ey": F.least("page_height", box(F.max, "y2")), "some": box(F.max, "x2").isNotNull()})
    return out.withColumns({"bw": F.greatest(F.lit(least), F.col("ex") - F.col("bx")), "bh": F.greatest(F.lit(least), F.col("ey") - F.col("by"))}).withColumns({c: F.when(F.col("some"), F.col(c)) for c in ("bx", "by", "bw", "bh")}).drop("ex", "ey", "some")


def candidates(lines: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    """The lines with accepted and candidate, and the content box of the accepted ones."""
    out = _content(lines.withColumn("accepted", F.col("confidence") >= config.accept), F.col("accepted"), config, 0)
    text = compact(F.col("text"))
    wide = (F.col("x2") - F.col("x")) / F.greatest(F.lit(1), F.coalesce("bw", F.lit(config.page_width))) >= config.candidate_width
    low = F.col("y2") >= F.coalesce("by", F.lit(0)) + F.coalesce("bh", "page_height") * config.candidate_from
    out = out.withColumn("compact", text)
    good = F.length("compact").between(config.shortest, config.longest) & (allowed_ratio(F.col("compact")) >= config.candidate_ratio) & F.col("compact").rlike("[<0-9]") & wide & low
    return out.withColumn("candidate", F.coalesce(good, F.lit(False)))


def page_metrics(lines: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    """One row per page: counts, confidences, candidates, content box and warnings."""
    accepted, confidence = F.col("accepted"), F.when(F.col("accepted"), F.col("confidence"))
    out = candidates(lines, config).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(accepted).alias("accepted_line_count"),
        F.round(F.avg(confidence), 6).alias("mean_confidence"),
        F.round(F.min(confidence), 6).alias("minimum_confidence"),
        F.count_if(accepted & (F.col("confidence") < config.low)).alias("low_confidence_line_count"),
        F.array_sort(F.collect_list(F.when(F.col("candidate"), F.col("idx")))).alias("mrz_line_indices"),
        F.coalesce(F.round(F.max(F.col("bw") * F.col("bh") / (F.col("page_height") * config.page_width)), 6), F.lit(0.0)).alias("content_area_ratio"),
    )
    n = F.size("mrz_line_indices")
    said = F.array_compact(F.array(
        F.when(F.col("accepted_line_count") == 0, "ocr_detection_no_text").when(F.col("mean_confidence") < config.low_mean, "ocr_recognition_low_confidence"),
        F.when(n == 0, "mrz_candidate_not_detected").when(n == 1, "mrz_candidate_incomplete"),
    ))
    return out.withColumns({"mrz_candidate_count": n.cast("bigint"), "warnings": said})


def run_summary(pages: DataFrame) -> DataFrame:
    """One row for a run. pages: status, warnings, mrz_candidate_count, mean_confidence, elapsed_ms, reused."""
    done = F.col("status") != "error"
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(done).alias("completed"),
        F.count_if(~done).alias("errors"),
        F.count_if(done & (F.size("warnings") > 0)).alias("warnings"),
        F.count_if(done & (F.col("mrz_candidate_count") > 0)).alias("pages_with_mrz_candidates"),
        F.count_if(done & (F.col("mrz_candidate_count") >= 2)).alias("pages_with_complete_mrz_candidates"),
        F.count_if(done & F.array_contains("warnings", "ocr_detection_no_text")).alias("pages_without_text"),
        F.round(F.avg(F.when(done, F.col("mean_confidence"))), 6).alias("mean_page_confidence"),
        F.round(F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)), 2).alias("total_elapsed_ms"),
        F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)), 2).alias("mean_elapsed_ms"),
        F.count_if("reused").alias("reused_pages"),
    )


def for_second_pass(pages: DataFrame, all_pages: bool = False) -> DataFrame:
    """The pages that are read a second time: those with a single candidate, or all."""
    return pages if all_pages else pages.where(F.array_contains("warnings", "mrz_candidate_incomplete"))


def candidate_histogram(pages: DataFrame) -> DataFrame:
    return pages.where("status != 'error'").groupBy("mrz_candidate_count").agg(F.count(F.lit(1)).alias("pages"))


def fragments(lines: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    """The lines that can be parts of MRZ rows, with the content box of all lines."""
    out = _content(lines, F.col("x").isNotNull(), config, 1)
    # what costs little comes first: neither upper case nor the loss of white space makes or takes a filler or a digit
    placed = (F.col("confidence") >= config.fragment_confidence) & (F.col("y2") >= F.col("by") + F.col("bh") * config.fragment_from)
    out = out.where(placed & (F.col("text").contains("<") | F.col("text").rlike("[0-9]")))

    def fits(text: Column) -> Column:
        marked = text.contains("<") | ((F.length(text) >= 20) & text.rlike("[0-9]"))
        return (F.length(text) >= 3) & marked & (allowed_ratio(text) >= config.fragment_ratio)

    # the compact text as an array's element: as a column it would be made anew for each use
    return out.where(F.exists(F.array(compact(F.col("text"))), fits)).withColumn("compact", compact(F.col("text")))


def row_clusters(lines: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    """The MRZ rows of each page from top to bottom (row_no from 1): a new row starts where the centre is further below the last one than the tolerance."""
    order = Window.partitionBy("doc_id").orderBy("cy", "idx")
    tolerance = F.greatest(F.lit(config.row_height), F.bround(F.col("page_height") * config.y_tolerance), F.bround((F.col("y2") - F.col("y")) * 1.1))
    out = fragments(lines, config).withColumn("cy", (F.col("y") + F.col("y2")) / 2)
    out = out.withColumn("starts", F.coalesce((F.col("cy") - F.lag("cy").over(order) > tolerance).cast("int"), F.lit(0)))
    out = out.withColumn("group", F.sum("starts").over(order))
    parts = F.array_sort(F.collect_list(F.struct("x", "idx", "text")))
    rows = out.groupBy("doc_id", "group").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), parts.alias("parts"), F.avg("confidence").alias("confidence"),
        F.first("page_height").alias("page_height"), *(F.first(c).alias(c) for c in ("bx", "by", "bw", "bh")),
    )
    rows = rows.withColumns({"w": F.greatest(F.lit(1), F.col("x2") - F.col("x")), "h": F.greatest(F.lit(1), F.col("y2") - F.col("y")), "text": F.array_join(F.transform("parts", lambda p: p["text"]), ""), "line_indices": F.transform("parts", lambda p: p["idx"])})
    rows = rows.where(F.col("w") / config.page_width >= config.row_width)
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("group"))).drop("parts", "group")


def last_rows(rows: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    from_below = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("row_no")))
    return rows.withColumn("from_below", from_below).where(F.col("from_below") <= config.rows).drop("from_below")


def neighbours(rows: DataFrame, lines: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    """For pages with a single row: the nearest line above or below that could be the other one (range join, then the least cost, first line of equals)."""
    alone = rows.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where("n_rows = 1")
    tall = F.greatest(F.lit(config.row_height * 5), F.bround(F.col("page_height") * 0.04))
    alone = alone.where(F.col("h") < tall).select("doc_id", *(F.col(c).alias(f"r_{c}") for c in ("x", "y", "w", "h", "line_indices")), F.greatest(F.lit(24), F.bround(F.col("h") * 2.25), F.bround(F.col("page_height") * 0.06)).alias("reach"))
    near = lines.withColumns({"w": F.greatest(F.lit(1), F.col("x2") - F.col("x")), "h": F.greatest(F.lit(1), F.col("y2") - F.col("y")), "compact": compact(F.col("text"))})
    joined = near.join(alone, "doc_id").where(~F.array_contains("r_line_indices", F.col("idx")))
    overlap = F.greatest(F.lit(0), F.least(F.col("x") + F.col("w"), F.col("r_x") + F.col("r_w")) - F.greatest("x", "r_x")) / F.greatest(F.lit(1), F.least("w", "r_w"))
    gap = F.when(F.col("y") + F.col("h") <= F.col("r_y"), F.col("r_y") - F.col("y") - F.col("h")).when(F.col("r_y") + F.col("r_h") <= F.col("y"), F.col("y") - F.col("r_y") - F.col("r_h"))
    short = ~F.col("compact").contains("<") & (F.length("compact") < 28) & (F.col("w") < F.col("r_w") * 0.75)
    fits = (F.length("compact") >= 15) & (F.col("confidence") >= config.fragment_confidence) & (allowed_ratio(F.col("compact")) >= config.fragment_ratio) & ~short & (overlap >= 0.55)
    found = joined.where(fits).withColumn("gap", gap).where("gap between 0 and reach").withColumn("cost", F.col("gap") + F.abs(F.col("w") - F.col("r_w")) / config.page_width)
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy("cost", "idx"))
    return found.withColumn("best", best).where("best = 1").drop("best")


def regions(rows: DataFrame, config: LineConfig = CONFIG, held: tuple[str, ...] = ()) -> DataFrame:
    """One crop rectangle per page around its last rows: padded, clipped, of a least height. A lone row needs a filler and some height.

    With `held`, these columns of the last rows stay with the region, as an array of structs in their order.
    """
    width = F.lit(config.page_width)
    kept = [F.array_sort(F.collect_list(F.struct(*held))).alias("held")] if held else []
    page = last_rows(rows, config).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"),
        F.avg("confidence").alias("confidence"), F.max("h").alias("h"), F.max(F.col("text").contains("<")).alias("marked"), *(F.first(c).alias(c) for c in ("bx", "bw", "page_height")), *kept,
    )
    page = page.where((F.col("n_rows") > 1) | (F.col("marked") & (F.col("h") >= 2 * config.row_height)))
    pad_x, pad_y = F.greatest(F.lit(8), F.bround(width * config.pad_x)).cast("int"), F.greatest(F.lit(8), F.bround(F.col("page_height") * config.pad_y)).cast("int")
    least = F.bround(F.col("page_height") * config.least_height).cast("int")
    page = page.withColumns({
        "cx1": F.greatest(F.lit(0), F.least("bx", "x1") - pad_x), "cx2": F.least(width, F.greatest(F.col("bx") + F.col("bw"), F.col("x2")) + pad_x),
        "cy1": F.greatest(F.lit(0), F.col("y1") - pad_y), "cy2": F.least("page_height", F.col("y2") + pad_y), "least": least,
    })
    small = F.col("cy2") - F.col("cy1") < F.col("least")
    top = F.greatest(F.lit(0), F.floor((F.col("cy1") + F.col("cy2")) / 2).cast("int") - F.floor(F.col("least") / 2).cast("int"))
    end = F.when(small, F.least("page_height", top + F.col("least"))).otherwise(F.col("cy2"))
    begin = F.when(small, F.greatest(F.lit(0), F.least("page_height", top + F.col("least")) - F.col("least"))).otherwise(F.col("cy1"))
    page = page.withColumns({"top": begin, "end": end})
    return page.select("doc_id", "n_rows", F.round("confidence", 6).alias("confidence"), F.col("cx1").alias("x"), F.col("top").alias("y"), F.greatest(F.lit(1), F.col("cx2") - F.col("cx1")).alias("w"), F.greatest(F.lit(1), F.col("end") - F.col("top")).alias("h"), *("held" for _ in kept))


def direct_rows(lines: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    """Whole lines that can go to the parser as rows: row_index from 1, compact text and its length."""
    text = F.col("compact")
    data = (F.length(text) == 44) & text.rlike("^[A-Z0-9]") & (F.regexp_count(text, F.lit("[0-9]")) >= 8)
    good = F.length(text).between(config.shortest, config.longest) & (text.contains("<") | data) & (allowed_ratio(text) >= config.direct_ratio)
    return lines.withColumn("compact", compact(F.col("text"))).where(good).select("doc_id", (F.col("idx") + 1).alias("row_index"), F.col("text").alias("raw_text"), text.alias("normalized_text"), F.length(text).cast("bigint").alias("length"), "confidence")


def second_pass_metrics(lines: DataFrame, rows: DataFrame, config: LineConfig = CONFIG) -> DataFrame:
    """Per page: its lines and those like MRZ rows, and the rows given to the parser with their lengths."""
    text = compact(F.col("text"))
    like = F.length(text).between(config.shortest, config.longest) & (allowed_ratio(text) >= config.candidate_ratio)
    page = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("line_count"), F.count_if(like).alias("mrz_like_line_count"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.when(like, F.col("confidence"))), 6).alias("mrz_like_confidence"))
    of = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("length") > 0).alias("rows_with_text"), (F.count_if(F.col("length") > 0) >= 2).alias("several"),
        F.min(F.when(F.col("length") > 0, F.col("length"))).alias("low"), F.max(F.when(F.col("length") > 0, F.col("length"))).alias("high"), F.round(F.avg("confidence"), 6).alias("row_mean_confidence"),
    )
    zero = F.lit(0).cast("bigint")
    return page.join(of, "doc_id", "left").select("doc_id", "line_count", "mrz_like_line_count", "mean_confidence", "mrz_like_confidence", F.coalesce("row_count", zero).alias("row_count"), F.coalesce("rows_with_text", zero).alias("rows_with_text"), F.coalesce(F.col("several") & (F.col("low") == F.col("high")), F.lit(False)).alias("row_lengths_equal"), "row_mean_confidence")


def merged_fragments(pieces: DataFrame) -> DataFrame:
    """Pieces (key, place, text, confidence) merged in order of place: raw text without blanks, MRZ text, count and mean confidence."""
    held = F.array_sort(F.collect_list(F.struct("place", "text")))
    out = pieces.groupBy("key").agg(held.alias("held"), F.count(F.lit(1)).alias("fragment_count"), F.round(F.avg("confidence"), 6).alias("confidence"))
    raw = F.array_join(F.transform("held", lambda p: F.regexp_replace(p["text"], r"\s+", "")), "")
    return out.select("key", raw.alias("raw_text"), F.regexp_replace(F.upper(raw), "[^A-Z0-9<]", "").alias("normalized_text"), "fragment_count", "confidence")
