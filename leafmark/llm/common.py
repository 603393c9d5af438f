"""Helpers shared by the corpus operators: table access, scratch tables, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session without that setting (tests, one machine) gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the executors share no folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Names this driver's folder inside the shared one.
RUN = uuid.uuid4().hex


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafmark-scratch/{RUN}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this driver's operators have written to the shared folder; for when their results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/leafmark-scratch/{RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n).cast("bigint"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about limit bytes of the text column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes.astype(np.int64)) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def quantile(values: DataFrame, share: float, bins: int = 4096, few: int = 10_000) -> float | None:
    """The exact quantile of a column of doubles, between two values in proportion; None without any. Each round counts the values by bins of the
    range that is open and goes on in the bin that holds the place, until it has few values or one; no task or driver sees more of them."""
    (name,) = values.columns
    values, v = values.where(F.col(name).isNotNull()), F.col(name)
    n, least, most = values.agg(F.count(v), F.min(v), F.max(v)).first()

    def at(place: int) -> float:
        lo, hi, before, held = least, most, 0, n
        while lo < hi:
            own = values.where(v.between(lo, hi))
            if held <= few:
                return sorted(r[0] for r in own.collect())[place - before]
            # both ends have bins of their own, so each round leaves less; by halves, so that no width overflows
            part = F.when(v == lo, -1).when(v == hi, bins).otherwise(F.least(F.lit(bins - 1), F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * bins)))
            for _, held, lo, hi in sorted(tuple(r) for r in own.groupBy(part.alias("part")).agg(F.count(v), F.min(v), F.max(v)).collect()):
                if place < before + held:
                    break
                before += held
        return lo

    if not n:
        return None
    place = share * (n - 1)
    low = at(int(place))
    return low if place == int(place) else low + (at(int(place) + 1) - low) * (place - int(place))


def grouped_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[object, list[dict]]]:
    """Lists of rows that share the value of a column, from batches that are sorted by it; a batch's rows are taken out one at a time."""
    held: list[dict] = []
    value = None
    for batch in batches:
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()
            if held and row[name] != value:
                yield value, held
                held = []
            value = row[name]
            held.append(row)
    if held:
        yield value, held
