"""The crew-list projection of parsed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.nations import ALPHA2, NAMES

#: Printed values of the list (fixed values).
SEX = {"M": "1-男", "F": "0-女"}
KIND = {"P<": "14-普通护照", "PM": "17-海员证"}
REVIEW = "MRZ校验需复核"


def _choice(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def birth_serial(text: Column) -> Column:
    """Days from 1899-12-30 to a yyMMdd date; two-digit years from 50 on are of the last century; null if there is no such day."""
    year = F.when(F.substring(text, 1, 2) >= "50", "19").otherwise("20")
    day = F.to_date(F.try_to_timestamp(F.when(text.rlike(r"\A[0-9]{6}\z"), F.concat(year, text)), F.lit("yyyyMMdd")))
    return F.datediff(day, F.lit("1899-12-30").cast("date"))


#: Documents whose names part the list into ranges (the least hashes; a bounded sample).
RANGES = 256


def _zh(name: str) -> Column:
    return F.collate(F.col(name), "zh")


def numbered_documents(pages: DataFrame) -> DataFrame:
    """document and before: the pages of the documents before it, in the order of Chinese collation.

    No window runs over all documents: the names of a sample part them into ranges, whose sums are added up.
    """
    counts = pages.groupBy("document").agg(F.count(F.lit(1)).alias("pages"))
    names = sorted(r[0] for r in counts.where("document is not null").orderBy(F.xxhash64("document")).limit(RANGES).select("document").collect())
    bounds = F.array(*map(F.lit, names)).cast("array<string>")
    counts = counts.withColumn("range", F.size(F.filter(bounds, lambda n: F.collate(n, "zh") <= F.collate(F.col("document"), "zh"))))
    ranges = counts.groupBy("range").agg(F.sum("pages").alias("all"))  # RANGES + 1 rows at most
    ranges = ranges.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.sum("pages").over(Window.partitionBy("range").orderBy(_zh("document"), "document").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(ranges), "range").select("document", (F.col("base") + F.col("own")).alias("before"))


def crew_list(parsed: DataFrame, pages: DataFrame | None = None, alpha2: dict[str, str] = ALPHA2, names: dict[str, str] = NAMES) -> DataFrame:
    """One row per page, numbered by document and page; fields only of valid and partial pages. parsed: document, page_number, status, fields.

    pages: the documents of the same pages, where they can be had without parsing them.
    """
    spark = parsed.sparkSession
    codes = F.broadcast(spark.createDataFrame(list(alpha2.items()), "alpha3 string, alpha2 string"))  # fixed lists
    printed = F.broadcast(spark.createDataFrame(list(names.items()), "named string, printed string"))
    good = F.col("status").isin("valid", "partial")
    field = lambda c: F.when(good, F.col(f"fields.{c}"))
    code = F.translate(F.upper(field("nationality")), "01", "OI")
    rows = parsed.withColumn("code", code).join(codes, F.col("code") == F.col("alpha3"), "left").withColumn("short", F.coalesce("alpha2", "code"))
    rows = rows.join(printed, F.col("short") == F.col("named"), "left")
    rows = rows.join(numbered_documents(parsed if pages is None else pages), "document")
    number = F.col("before") + F.row_number().over(Window.partitionBy("document").orderBy("page_number"))
    blank = lambda c: F.nullif(c, F.lit(""))
    empty = F.lit(None).cast("string")
    return rows.select(
        number.cast("bigint").alias("seq"),
        F.concat_ws(" ", blank(field("surname")), blank(field("given_names"))).alias("name"),
        _choice(F.upper(field("sex_code")), SEX).alias("sex"),
        F.coalesce(F.concat("short", F.lit("-"), "printed"), blank(F.col("short"))).alias("nationality"),
        empty.alias("duty"),
        birth_serial(field("date_of_birth")).alias("birth_serial"),
        empty.alias("birth_place"),
        _choice(F.upper(field("document_code")), KIND).alias("document_kind"),
        blank(field("passport_number")).alias("document_number"),
        F.when(F.col("status") == "partial", REVIEW).alias("remark"),
        empty.alias("landing"),
        empty.alias("boarding_date"),
        empty.alias("boarding_port"),
    )
