"""Readers of run folders: images, recognition results, labels, reviews, page logs; with explicit schemas and keys from paths."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.text import suffix
from leafmark.operators import scores

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
DOCUMENT_SUFFIXES = (".pdf", *IMAGE_SUFFIXES)

LABEL = "schema_version int, source_file string, source_page int, contains_data_page boolean, expected_pages int, rotation int, remarks string, annotator string"
REQUIRED = ("source_file", "source_page", "contains_data_page", "expected_pages", "rotation")
_LINE = "struct<polygon:array<array<int>>,text:string,confidence:double>"
OCR_PAGE = f"source_image string, source_fingerprint struct<size:bigint,mtime_ns:bigint>, document string, page_number int, status string, elapsed_ms double, lines array<{_LINE}>, metrics struct<line_count:int,accepted_line_count:int,mean_confidence:double,minimum_confidence:double,low_confidence_line_count:int,mrz_candidate_count:int,mrz_line_indices:array<int>>, warnings array<string>, error string, inference_signature string, analysis_signature string"
MRZ_PAGE = "document string, page_number int, status string, mode string, row_results array<struct<row_index:int,raw_text:string,normalized_text:string,length:int,fragment_count:int,confidence:double>>, warnings array<string>, error string, elapsed_ms double, reused boolean"
_EVENT = "struct<reviewed_at:string,review:string,failure_reason:string,quality:struct<page_complete:boolean,portrait_complete:boolean,mrz_complete:boolean,ocr_ready:boolean>>"
REVIEW = f"schema_version int, latest {_EVENT}, history array<{_EVENT}>"
LOG = "status string, message string, source_page int, metrics struct<selected_segment:int,scores:struct<final:double>,orientation:struct<angle:int>,normalization:struct<ocr_safe:boolean,fallback_level:string>>, stages array<struct<name:string,file:string,elapsed_ms:double,metadata:struct<scores:struct<final:double>>>>"


def _json(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    found = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    # the file's address has its special characters encoded; a plus sign stands for itself
    return found.withColumn("path", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def _folder(path: Column, up: int) -> Column:
    """The name of the folder `up` levels above the file."""
    return F.element_at(F.split(path, "/"), -up - 1)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime and content of the image files below root, by suffix in either case, in order of path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).orderBy("path")


def images(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded images below root (BGR); a file that cannot be decoded fails, or is left out if that is asked for."""
    found = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).load(root)
    bad = F.raise_error(F.concat(F.lit("not an image: "), F.col("image.origin")))
    return found if drop_invalid else found.select(F.when(F.col("image.height") > 0, F.col("image")).otherwise(bad).alias("image"))


def pages_of(files: DataFrame, decode: Callable[[bytes], Iterable[np.ndarray]]) -> DataFrame:
    """path, page (from 1) and image of each frame or page of binaryFile rows; a file without any fails.

    decode turns a file's bytes into BGR or gray arrays (a TIFF's frames, a PDF's rendered pages); it is loaded in the workers,
    and its library is the caller's.
    """

    def run(batches):
        kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0
                for page in decode(content):
                    n += 1
                    channels = 1 if page.ndim == 2 else page.shape[2]
                    image = {"origin": path, "height": page.shape[0], "width": page.shape[1], "nChannels": channels, "mode": 8 * (channels - 1), "data": np.ascontiguousarray(page, np.uint8).tobytes()}
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int32()), pa.array([image], kind)], names=["path", "page", "image"])
                if not n:
                    raise ValueError(f"no pages in {path}")

    schema = "path string, page int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return files.select("path", "content").mapInArrow(run, schema)


def page_scale(width: float, height: float, dpi: int = 220, most: int = 2800) -> float:
    """The scale at which a page of points is rendered: by the resolution, but no side longer than most."""
    return min(dpi / 72, most / max(width, height, 1))


def merged_config(defaults: dict, text: str) -> dict:
    """A YAML text laid over typed defaults by `scores.merged_config`."""
    try:
        import yaml
    except ImportError as e:  # an optional reader
        raise RuntimeError("reading YAML needs PyYAML") from e
    return scores.merged_config(defaults, yaml.safe_load(text) or {})


def routed(paths: DataFrame, path: str = "path") -> DataFrame:
    """The paths with their reader: pdf, tiff or image; any other suffix fails."""
    s = suffix(F.col(path))
    said = F.concat(F.lit("unsupported format, supported: " + ", ".join(DOCUMENT_SUFFIXES) + ": "), F.col(path))
    reader = F.when(s == ".pdf", "pdf").when(s.isin(".tif", ".tiff"), "tiff").when(s.isin(*DOCUMENT_SUFFIXES), "image").otherwise(F.raise_error(said))
    return paths.withColumn("reader", reader)


def labels(spark: SparkSession, root: str) -> DataFrame:
    """Ground truth: expected.json files, with their data set (the folder above the page's); missing required fields fail."""
    found = _json(spark, root, "expected.json", LABEL).withColumn("dataset_name", _folder(F.col("path"), 2))
    absent = F.array_sort(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in REQUIRED))))
    checked = F.when(F.size(absent) == 0, F.col("source_file")).otherwise(F.raise_error(F.concat(F.lit("missing fields "), F.array_join(absent, ", "), F.lit(" in "), F.col("path"))))
    return found.withColumn("source_file", checked).withColumn("rotation", F.pmod("rotation", F.lit(360))).orderBy("path")


def reviews(spark: SparkSession, root: str) -> DataFrame:
    """The latest review of each page folder, and its number of events."""
    found = _json(spark, root, "review.json", REVIEW)
    return found.select(_folder(F.col("path"), 2).alias("dataset_name"), _folder(F.col("path"), 1).alias("page_folder"), "latest.*", F.size("history").alias("events"))


def ocr_pages(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, "ocr.json", OCR_PAGE).orderBy("path")


def mrz_pages(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, "mrz.json", MRZ_PAGE).orderBy("path")


def page_logs(spark: SparkSession, root: str) -> DataFrame:
    """Saved pages of a run: prediction columns; a page without a number takes its folder's."""
    found = _json(spark, root, "log.json", LOG)
    scored = F.filter("stages", lambda s: s["name"].startswith("scored_"))
    scores = F.sort_array(F.transform(scored, lambda s: F.coalesce(s["metadata"]["scores"]["final"], F.lit(0.0))), asc=False)
    return found.select(
        _folder(F.col("path"), 2).alias("document"),
        F.coalesce("source_page", F.regexp_extract(_folder(F.col("path"), 1), r"page(\d+)", 1).cast("int")).alias("page"),
        (F.col("status") == "selected").alias("selected"),
        F.coalesce("metrics.orientation.angle", F.lit(0)).alias("rotation"),
        F.get(scores, F.lit(0)).alias("score_1"),
        F.get(scores, F.lit(1)).alias("score_2"),
        F.coalesce("metrics.normalization.ocr_safe", F.lit(True)).alias("ocr_safe"),
        F.aggregate("stages", F.lit(0.0), lambda a, s: a + F.coalesce(s["elapsed_ms"], F.lit(0.0))).alias("elapsed_ms"),
    )


def fingerprints(files: DataFrame) -> DataFrame:
    """path, size and modification time of binaryFile rows: what resuming compares."""
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("stamp"))
