"""What reports print: stage names, dates, error texts, HTML rows; and the run's head."""

from __future__ import annotations

import importlib.metadata
import json
import platform

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions.text import fixed, format_rate, html_escape, now_text, url_quote

#: Printed names of saved stages (fixed values); others are printed as they are.
STAGES = {
    "01_original": "原图",
    "02_rotated": "旋转",
    "03_trimmed": "去白边",
    "04_document": "文档区域",
    "05_segment_1": "页面分割",
    "08_safe_input": "安全输入",
    "09_normalized": "标准化",
    "fast_mrz_band": "MRZ快速区域",
    "fast_mrz_ocr_overlay": "MRZ快速定位",
    "fallback_mrz_crop": "MRZ回退裁剪",
    "fallback_mrz_ocr_overlay": "MRZ回退定位",
}
#: Printed names of sexes (fixed values).
SEXES = {"male": "男", "female": "女"}


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value), value)


def stage_name(stem: Column) -> Column:
    return _named(stem, STAGES)


def sex_name(sex: Column) -> Column:
    return F.coalesce(_named(sex, SEXES), F.lit(""))


def display_date(text: Column) -> Column:
    """yyMMdd as yyyy/MM/dd, whether or not there is such a day; two-digit years from 50 on are of the last century; other texts stay."""
    century = F.when(F.substring(text, 1, 2) >= "50", "19").otherwise("20")
    day = F.concat(century, F.substring(text, 1, 2), F.lit("/"), F.substring(text, 3, 2), F.lit("/"), F.substring(text, 5, 2))
    return F.when(text.rlike(r"\A[0-9]{6}\z"), day).otherwise(F.coalesce(text, F.lit("")))


def error_text(kind: Column, message: Column) -> Column:
    return F.concat(kind, F.lit(": "), F.coalesce(message, F.lit("")))


def tail(text: Column, n: int = 1000) -> Column:
    """The last n characters."""
    return F.right(text, F.lit(n))


def seconds(ms: Column) -> Column:
    return F.when(ms.isNull(), "N/A").otherwise(F.concat(fixed(ms / 1000, 1), F.lit("s")))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))


def _page(document: str, number: str) -> Column:
    padded = F.when(F.col(number) < 1000, F.lpad(F.col(number).cast("string"), 3, "0")).otherwise(F.col(number).cast("string"))
    return F.concat(F.lit("<b>"), html_escape(F.col(document)), F.lit("</b><br>"), padded)


def _badge(status: Column) -> Column:
    return F.concat(F.lit('<span class="'), html_escape(status), F.lit('">'), html_escape(F.upper(status)), F.lit("</span>"))


def _warnings(column: str) -> Column:
    return F.when(F.size(column) > 0, F.array_join(F.transform(column, html_escape), "<br>")).otherwise("-")


def _picture(path: Column) -> Column:
    return F.when(path.isNull(), "-").otherwise(F.concat(F.lit('<img loading="lazy" src="'), url_quote(path), F.lit('">')))


def ocr_report_rows(pages: DataFrame) -> DataFrame:
    """An HTML row for each page. pages: document, page_number, status, accepted_line_count, mrz_candidate_count, mean_confidence,
    elapsed_ms, warnings, overlay_path, text, error."""
    rate = format_rate(F.col("mean_confidence"))
    text = html_escape(F.coalesce(F.nullif("text", F.lit("")), "error", F.lit("-")))
    cells = (_page("document", "page_number"), _badge(F.col("status")), F.col("accepted_line_count").cast("string"), F.col("mrz_candidate_count").cast("string"), rate, seconds(F.col("elapsed_ms")), _warnings("warnings"), _picture(F.col("overlay_path")), text)
    return pages.select("document", "page_number", _row(*cells).alias("html"))


def mrz_report_rows(pages: DataFrame) -> DataFrame:
    """An HTML row for each page. pages: document, page_number, status, x, y, w, h (null without a region), warnings, line_count,
    mrz_like_line_count, parse_status, format, overlay_path."""
    box = F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in "xywh"))
    lines = F.concat(F.col("line_count").cast("string"), F.lit(" / "), F.col("mrz_like_line_count").cast("string"))
    parse = F.concat(F.coalesce("parse_status", F.lit("N/A")), F.lit(", "), F.coalesce("format", F.lit("N/A")))
    cells = (_page("document", "page_number"), _badge(F.col("status")), box, _warnings("warnings"), lines, parse, _picture(F.col("overlay_path")))
    return pages.select("document", "page_number", _row(*cells).alias("html"))


def page_of(title: str, rows: list[str]) -> str:
    """An HTML page around rows; for as many as a reader opens."""
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><table>{"".join(rows)}</table></body></html>'


def version(package: str) -> str | None:
    try:
        return importlib.metadata.version(package)
    except importlib.metadata.PackageNotFoundError:
        return None


def run_head(summary: DataFrame, config: dict, packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy"), document: str = "run") -> DataFrame:
    """One row: a JSON text of the run (time, configuration, Python and package versions; null if one is missing) and its summary."""
    runtime = {"python": platform.python_version(), **{p: version(p) for p in packages}}
    head = F.concat(F.lit('{"generated_at":"'), now_text(), F.lit(f'","config":{json.dumps(config, ensure_ascii=False, sort_keys=True)},"runtime":{json.dumps(runtime)}}}'))
    body = F.to_json(F.struct(*summary.columns), {"ignoreNullFields": "false"})
    return summary.select(F.concat(F.lit(f'{{"{document}":'), head, F.lit(',"summary":'), body, F.lit("}")).alias("report"))


def write_run(summary: DataFrame, pages: DataFrame, path: str, config: dict | None = None) -> None:
    """run/ with the head as one text line, pages/ with one JSON line a page; no row holds a run's pages."""
    run_head(summary, config or {}).coalesce(1).write.mode("overwrite").text(f"{path}/run")
    pages.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/pages")
