"""The row cascade as table functions: pieces of crops are merged to rows, doubtful rows are read a second time, the better reading stays.

    SELECT r.doc_id, r.row_index, s.* FROM merged_rows(TABLE(crops)) AS r, LATERAL second_look(r.doc_id, r.row_index, r.normalized_text, r.confidence) AS s

`register` makes both known to a session; the second reading is a function that the caller gives. merged_rows takes a row for each crop,
with its pieces from left to right as arrays; only these rows are dealt to the functions, in tasks of the size that they ask for.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from leafmark.operators.rows import CONFIG, RowConfig, row_pieces

MERGED = StructType().add("doc_id", LongType()).add("row_index", IntegerType()).add("raw_text", StringType()).add("normalized_text", StringType()).add("fragment_count", LongType()).add("confidence", DoubleType())
CHOSEN = "normalized_text string, confidence double, variant int"
_CROP = ("doc_id", "row_index", "texts", "confidences")


def _clean(text: str) -> str:
    return re.sub(r"[^A-Z0-9<]", "", text.upper())


def _share(text: str) -> float:
    return len(re.findall(r"[A-Z0-9<]", text)) / max(1, len(text))


class MergedRows:
    """The pieces of a crop as one text."""

    @staticmethod
    def analyze(crops: AnalyzeArgument) -> AnalyzeResult:
        if not crops.isTable:
            raise ValueError("merged_rows takes a table of crops")
        missing = [c for c in _CROP if c not in crops.dataType.fieldNames()]
        if missing:
            raise ValueError(f"merged_rows misses the columns {', '.join(missing)}")
        return AnalyzeResult(MERGED)

    def eval(self, row):
        raw = re.sub(r"\s+", "", "".join(row["texts"]), flags=re.ASCII)
        sure = [c for c in row["confidences"] if c is not None]
        yield row["doc_id"], row["row_index"], raw, _clean(raw), len(row["texts"]), round(sum(sure) / len(sure), 6) if sure else None


def _second_look(read: Callable[[int, int, str], tuple[str, float | None]], config: RowConfig):
    class SecondLook:
        """A sure row of the right length stays as it is; any other is read again and the higher rank stays, the first reading on ties."""

        def eval(self, doc_id: int, row_index: int, text: str, confidence: float):
            found = text, confidence, 0
            if len(text) != config.length or (confidence or 0.0) < config.sure:
                rank = lambda t, sure: (len(t) == config.length, int(row_index == 1 and t.startswith("P<")) + (sure or 0.0), _share(t))
                again = read(doc_id, row_index, text)
                if rank(*again) > rank(text, confidence):
                    found = *again, 1
            yield found

    return SecondLook


def register(spark: SparkSession, read: Callable[[int, int, str], tuple[str, float | None]], config: RowConfig = CONFIG) -> None:
    """Makes merged_rows and second_look known to the session; read gives text and confidence of a row's second reading."""
    spark.udtf.register("merged_rows", udtf(MergedRows))
    spark.udtf.register("second_look", udtf(_second_look(read, config), returnType=CHOSEN))


def cascade(pieces: DataFrame, read: Callable[[int, int, str], tuple[str, float | None]], config: RowConfig = CONFIG) -> DataFrame:
    """doc_id, row_index and the chosen reading of the rows that the pieces (of `rows.into_crops`) make."""
    spark = pieces.sparkSession
    register(spark, read, config)
    held = F.sort_array(F.collect_list(F.struct("left", "idx", "text", "confidence")))
    crops = row_pieces(pieces, config).groupBy("doc_id", "row_index").agg(held.alias("held")).select("doc_id", "row_index", F.col("held.text").alias("texts"), F.col("held.confidence").alias("confidences"))
    # crops are small against their pages: in the pages' own tasks the start of the functions would take longer than their rows
    crops = crops.repartition("doc_id", "row_index")
    text = "SELECT r.doc_id, r.row_index, s.* FROM merged_rows(TABLE({crops})) AS r, LATERAL second_look(r.doc_id, r.row_index, r.normalized_text, r.confidence) AS s"
    return spark.sql(text, crops=crops)
