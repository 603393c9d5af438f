"""Writers of results: page tables, summaries, reports, failure folders."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions.text import format_elapsed, format_rate, html_escape
from leafmark.operators import kernels


def write_pages(pages: DataFrame, path: str, document: str = "document", form: str = "json") -> None:
    """One table of page results, in a folder for each document."""
    pages.write.mode("overwrite").partitionBy(document).format(form).save(path)


#: Pages that one report may hold; larger runs are written by operators.report.write_run, a line for each page.
MOST_PAGES = 20_000


def summary_json(summary: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """One row: a JSON text with the summary and its pages in order of the key. For runs whose report a reader can open: more pages fail."""
    if pages.limit(MOST_PAGES + 1).count() > MOST_PAGES:
        raise ValueError(f"more than {MOST_PAGES} pages: write_run writes a line for each")
    listed = pages.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*pages.columns).alias("page")))), lambda x: x["page"]).alias("pages"))
    return summary.select(F.struct(*summary.columns).alias("summary")).crossJoin(listed).select(F.to_json(F.struct("summary", "pages"), {"ignoreNullFields": "false"}).alias("report"))  # one row by one row


def html_row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), html_escape(c.cast("string")), F.lit("</td>")) for c in cells), F.lit("</tr>"))


def validation_rows(judged: DataFrame) -> DataFrame:
    """The rows of the validation page, by source and page."""
    cells = (F.col("source_file"), F.col("source_page"), F.col("result"), F.coalesce("reason", F.lit("")), F.col("note"))
    return judged.select("source_file", "source_page", html_row(*cells).alias("html"))


def rate_cells(summary: DataFrame) -> DataFrame:
    """The printed rates of a validation summary."""
    rates = ("detection_accuracy", "verified_accuracy", "crop_completeness", "mrz_completeness", "portrait_completeness", "ocr_ready_rate")
    return summary.select(*(format_rate(F.col(c)).alias(c) for c in rates))


def elapsed_cell(ms: Column) -> Column:
    return format_elapsed(ms)


def write_failures(judged: DataFrame, path: str) -> None:
    """Failed pages in folders by reason and data set."""
    failed = judged.where(F.col("result").endswith("fail")).withColumns({"failure_reason": F.coalesce("reason", F.lit("unknown")), "dataset": F.element_at(F.split("source_file", "/"), 1)})
    failed.write.mode("overwrite").partitionBy("failure_reason", "dataset").parquet(path)


def write_png(images: DataFrame, folder: str, name: str = "name", level: int = 3) -> DataFrame:
    """Writes image structs as PNG files named by a column, one after the other in their tasks, and returns the manifest (file, size), written
    once. A file appears by a rename, so an attempt that is lost leaves none half written, and a repeated one replaces what it wrote."""

    def run(batches):
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        hidden = f"{base}/_{TaskContext.get().taskAttemptId()}.png"
        for batch in batches:
            names, sizes = [], []
            for to, image in zip(batch.column(batch.schema.get_field_index(name)), batch.column(batch.schema.get_field_index("image"))):
                to, row = to.as_py(), image.as_py()
                if not to or row is None or "/" in to or to.startswith((".", "_")):
                    raise ValueError(f"no image or no file name: {to!r}")
                raw = kernels.png(kernels.pixels(row), level)
                with fs.open_output_stream(hidden, compression=None) as stream:
                    stream.write(raw)
                fs.move(hidden, f"{base}/{to}.png")
                names.append(f"{to}.png")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "size"])

    path = f"{folder.rstrip('/')}/_manifest"
    images.select(name, "image").mapInArrow(run, "file string, size bigint").write.mode("overwrite").parquet(path)
    return images.sparkSession.read.parquet(path)


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PARTS = "http://schemas.openxmlformats.org/package/2006"
#: Rows that a sheet can hold.
MOST_ROWS = 1_048_575


def write_xlsx(rows: DataFrame, path: str, header: list[str], widths: dict[int, float] | None = None, dates: tuple[int, ...] = (), sheet: str = "Sheet1") -> int:
    """A workbook with one sheet: the header in a frozen row with a filter, columns by number (from 0) of some width, and day
    numbers shown as dates. For lists that a reader opens; rows come to the driver one partition at a time. Returns their number."""
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    def name(i: int) -> str:
        return (name(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    def cell(row: int, i: int, v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{name(i)}{row}"{" s=\"1\"" if i in dates else ""}><v>{v}</v></c>'
        return f'<c r="{name(i)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    said = {
        "[Content_Types].xml": f'<Types xmlns="{_PARTS}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PARTS}/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PARTS}/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/styles.xml": f'<styleSheet xmlns="{_SHEET}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy/mm/dd"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in said.items():
            z.writestr(part, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            columns = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in sorted((widths or {}).items()))
            head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_SHEET}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
            f.write((head + (f"<cols>{columns}</cols>" if columns else "") + '<sheetData><row r="1">' + "".join(cell(1, i, h) for i, h in enumerate(header)) + "</row>").encode())
            for row in rows.toLocalIterator():
                n += 1
                if n > MOST_ROWS:
                    raise ValueError(f"more than {MOST_ROWS} rows")
                f.write((f'<row r="{n + 1}">' + "".join(cell(n + 1, i, v) for i, v in enumerate(row)) + "</row>").encode())
            f.write(f'</sheetData><autoFilter ref="A1:{name(len(header) - 1)}{n + 1}"/></worksheet>'.encode())
    return n
