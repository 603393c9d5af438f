"""The recognition engine as an exchangeable function from an image to lines, and the decoding of its payloads."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = "array<struct<polygon:array<array<int>>,text:string,confidence:double>>"


class Engine(Protocol):
    def recognize(self, image: bytes) -> list[dict]:
        """Lines of an image file: polygon, text, confidence."""


def not_configured() -> Engine:
    raise RuntimeError("no recognition engine is configured; pass a factory that makes one")


def recognized(pages: DataFrame, factory: Callable[[], Engine] = not_configured, content: str = "content") -> DataFrame:
    """The pages with lines and error: an engine is made once for each task, and a page that fails keeps its error's text."""
    schema = pages.schema.simpleString()[7:-1]

    def run(batches):
        engine = None
        for batch in batches:
            engine = engine or factory()
            lines, errors = [], []
            for image in batch.column(batch.schema.get_field_index(content)).to_pylist():
                try:
                    lines.append(engine.recognize(image))
                    errors.append(None)
                except Exception as e:  # the page's own failure
                    lines.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            kind = pa.list_(pa.struct([("polygon", pa.list_(pa.list_(pa.int32()))), ("text", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, kind), pa.array(errors, pa.string())], names=[*batch.schema.names, "lines", "error"])

    return pages.mapInArrow(run, f"{schema}, lines {LINES}, error string")


def payload_results(payload: Column) -> Column:
    """The results that a JSON payload of an engine holds, as VARIANTs: itself if it is an object, its elements if it is a list, and what
    it says if it is a text that holds JSON once more. Any other payload fails."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    inner = _once(F.parse_json(payload), lambda v: F.when(kind(v) == "STRING", F.parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v))
    known = lambda v: F.when(kind(v) == "OBJECT", F.array(v)).when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
    return _once(inner, lambda v: F.when(v.isNotNull(), F.coalesce(known(v), F.raise_error(F.concat(F.lit("unsupported payload: "), kind(v))))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being made once for each row however often it is used: an element of an array that is gone through."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def result_lines(result: Column) -> Column:
    """The lines of one result: texts of any kind become text, missing scores are 0, missing or empty polygons give way to the detected ones and then
    are empty, coordinates are rounded half to even."""
    pick = lambda name, kind: F.coalesce(*(F.try_variant_get(result, f"$.{at}{name}", kind) for at in ("res.", "")))
    some = lambda name: F.when(F.size(pick(name, "array<variant>")) > 0, pick(name, "array<array<array<double>>>"))
    texts, scores, polygons = pick("rec_texts", "array<variant>"), pick("rec_scores", "array<double>"), F.coalesce(some("rec_polys"), some("dt_polys"))
    whole = lambda polygon: F.transform(polygon, lambda point: F.transform(point, lambda v: F.bround(v).cast("int")))
    empty = F.array().cast("array<array<int>>")
    line = lambda r: lambda t, i: F.struct(F.coalesce(whole(F.get(r["polygons"], i)), empty).alias("polygon"), F.coalesce(t.cast("string"), F.lit("None")).alias("text"), F.coalesce(F.get(r["scores"], i), F.lit(0.0)).alias("confidence"))
    # the arrays are read out of the result once, not for each line
    held = F.struct(texts.alias("texts"), scores.alias("scores"), polygons.alias("polygons"))
    return _once(held, lambda r: F.coalesce(F.transform(r["texts"], line(r)), F.array().cast(LINES)))


def payload_lines(payload: Column) -> Column:
    """The lines of all results of an engine's JSON payload, one after the other; none for a null payload."""
    return F.coalesce(F.flatten(F.transform(payload_results(payload), result_lines)), F.array().cast(LINES))


def extents(lines: DataFrame, key: str, column: str = "lines") -> DataFrame:
    """One row per line: key, idx, text, confidence and the extents of its polygon (null without points)."""
    # an inner explode would make the lines once more, for a condition on their number
    out = lines.select(key, F.posexplode_outer(column).alias("idx", "line")).where("idx IS NOT NULL")
    x, y = F.transform("line.polygon", lambda p: p[0]), F.transform("line.polygon", lambda p: p[1])
    return out.select(key, F.col("idx").cast("bigint").alias("idx"), "line.text", "line.confidence", F.array_min(x).alias("x"), F.array_min(y).alias("y"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))
