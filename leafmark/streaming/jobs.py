"""Structured Streaming twins of the incremental operators.

Events are read from a Parquet folder as a stream. Change detection and page counters are keyed state (applyInPandasWithState); event
counts by time carry a watermark, so that state of closed windows is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def changed(events: DataFrame, key: str, seq: str, mark: str) -> DataFrame:
    """The events at which the key's mark differs from the one before; state is the last mark of each key.

    A key's events of one micro-batch are sorted at once: files_per_batch of the source bounds them."""
    spec = events.select(key, seq, mark).schema

    def step(_, frames: Iterable, state: GroupState) -> Iterator:
        import pandas as pd

        last = state.getOption
        rows = pd.concat(list(frames)).sort_values(seq)
        known, value, keep = last is not None, last[0] if last else None, []
        for x in rows[mark]:
            keep.append(not known or x != value)
            known, value = True, x
        state.update((value,))
        yield rows[keep]

    state_type = f"last {spec[mark].dataType.simpleString()}"
    return events.select(key, seq, mark).groupBy(key).applyInPandasWithState(step, spec, state_type, "append", GroupStateTimeout.NoTimeout)


def counts_by_type(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows, with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("span"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("span.start").alias("start"), kind, "n")


def page_states(events: DataFrame, keys: list[str], seq: str, *values: str) -> DataFrame:
    """The last values of each key, kept as state of the built-in aggregation; for the update or complete mode."""
    last = F.max_by(F.struct(seq, *values), seq).alias("last")
    return events.groupBy(*keys).agg(last, F.count(F.lit(1)).alias("events")).select(*keys, "last.*", "events")


def follow(events: DataFrame, path: str, checkpoint: str) -> int:
    """Appends what has come since the last call to a table: the checkpoint is the subscriber's cursor, so a new call goes on
    after the last event and a lost checkpoint starts again from the first. Returns the rows of this call."""
    query = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def reported(events: DataFrame, path: str, report: Callable[[DataFrame], None], checkpoint: str, every: int = 10) -> None:
    """Keeps each micro-batch in a folder of its own (a repeated one replaces it) and calls the report with all kept so far
    after every so many micro-batches and after the last."""
    spark = events.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % every == 0:
            report(spark.read.parquet(path).drop("batch"))

    query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    report(spark.read.schema(events.schema).parquet(path))


def reported_sums(events: DataFrame, sums: dict[str, Column], path: str, report: Callable[[DataFrame], None], checkpoint: str, every: int = 10) -> None:
    """As `reported`, for reports of sums and counts: a micro-batch leaves one row of them (a repeated one replaces it), and the report gets
    their totals in one row. No event is read twice."""
    spark = events.sparkSession
    totals = lambda: spark.read.parquet(path).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))

    def batch(rows: DataFrame, number: int) -> None:
        rows.agg(*(v.alias(k) for k, v in sums.items())).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % every == 0:
            report(totals())

    query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    report(totals())


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, into a table in the shared folder; returns the table. Complete results replace it."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
