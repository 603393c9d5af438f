"""Incremental results in batch form: change detection, keyed state, reuse of saved results, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(events: DataFrame, keys: list[str], seq: str, *marks: str) -> DataFrame:
    """The events at which the marks of a key differ from its event before (its first event too): a change back counts."""
    order = Window.partitionBy(*keys).orderBy(seq)
    now = F.struct(*marks)
    out = events.withColumns({"before": F.lag(now).over(order), "nth": F.row_number().over(order)})
    return out.where((F.col("nth") == 1) | ~now.eqNullSafe(F.col("before"))).drop("before", "nth")


def latest(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last event of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return events.withColumn("rank", rank).where("rank = 1").drop("rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a new one of their keys, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def reusable(inputs: DataFrame, saved: DataFrame, path: str, signature: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs to be done, inputs whose saved result of the same signature can stay); saved errors are done again."""
    good = saved.where("status <> 'error'").select(path, *signature).distinct()
    same = inputs[path] == good[path]
    for c in signature:
        same = same & inputs[c].eqNullSafe(good[c])
    return inputs.join(good, same, "left_anti"), inputs.join(good, same, "left_semi")


def saved_in_buckets(saved: DataFrame, name: str, path: str, folder: str, buckets: int) -> DataFrame:
    """The saved results as a table in a shared folder, dealt to buckets of the path once and for all."""
    saved.write.bucketBy(buckets, path).sortBy(path).option("path", f"{folder.rstrip('/')}/{name}").mode("overwrite").saveAsTable(name)
    return saved.sparkSession.table(name)


def todo_of_buckets(inputs: DataFrame, saved: DataFrame, path: str, signature: list[str], buckets: int) -> DataFrame:
    """The inputs without a saved result of their signature. The saved table stays in its buckets: the join is on the path alone, and
    the signatures of a path (few) are compared within its row."""
    marks = lambda: F.struct(*(F.col(c).alias(f"m{i}") for i, c in enumerate(signature)))
    good = saved.where("status <> 'error'").groupBy(path).agg(F.collect_set(marks()).alias("known"))
    held = inputs.repartition(buckets, path).join(good, path, "left")
    same = F.exists(F.coalesce("known", F.array()), lambda k: k.eqNullSafe(marks()))
    return held.where(~same).select(*inputs.columns)


def since(events: DataFrame, seq: str, cursor: int) -> DataFrame:
    """A subscriber's next events, in order."""
    return events.where(F.col(seq) > cursor).orderBy(seq)


def resumed(inputs: DataFrame, saved: DataFrame, path: str, signature: list[str]) -> DataFrame:
    """The saved results that stay, marked as reused."""
    _, done = reusable(inputs, saved, path, signature)
    return saved.join(done.select(path), path, "left_semi").withColumn("reused", F.lit(True))


def resume_levels(inputs: DataFrame, saved: DataFrame, path: str, first: list[str], second: list[str]) -> DataFrame:
    """inputs with level: reuse (both signatures are those of a saved result), analyse (only the first, so recognition can
    stay and the analysis runs anew), or run."""
    good = saved.where("status <> 'error'").select(path, *(F.col(c).alias(f"saved_{c}") for c in (*first, *second))).dropDuplicates([path])
    held = inputs.join(good.withColumn("known", F.lit(True)), path, "left")

    def same(columns: list[str]):
        out = F.coalesce("known", F.lit(False))
        for c in columns:
            out = out & F.col(c).eqNullSafe(F.col(f"saved_{c}"))
        return out

    level = F.when(same([*first, *second]), "reuse").when(same(first), "analyse").otherwise("run")
    return held.withColumn("level", level).select(*inputs.columns, "level")


def append_reviews(events: DataFrame, reviews: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The event table with new reviews (keys, review, failure_reason, ...) behind each key's last event; a column `latest`
    points to the last event. Reviews of another outcome than correct or incorrect fail; only rejections keep a reason."""
    outcome = F.when(F.col("review").isin("correct", "incorrect"), F.col("review")).otherwise(F.raise_error(F.concat(F.lit("unsupported review outcome: "), F.coalesce("review", F.lit("null")))))
    last = events.groupBy(*keys).agg(F.max(seq).alias("last"))
    placed = reviews.withColumn("review", outcome).withColumn("failure_reason", F.when(F.col("review") == "incorrect", F.col("failure_reason")))
    order = Window.partitionBy(*keys).orderBy(*(c for c in placed.columns if c not in keys))
    placed = placed.join(last, keys, "left").withColumn(seq, F.coalesce("last", F.lit(0)) + F.row_number().over(order)).drop("last")
    both = events.unionByName(placed, allowMissingColumns=True)
    return both.withColumn("latest", F.col(seq) == F.max(seq).over(Window.partitionBy(*keys)))


def review_files(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """For each key what its review file holds: the number of events, the latest one, and all in order."""
    event = F.struct(seq, *(c for c in events.columns if c not in (*keys, seq, "latest")))
    return events.groupBy(*keys).agg(F.lit(2).alias("schema_version"), F.max_by(event, seq).alias("latest"), F.array_sort(F.collect_list(event)).alias("history"))


def write_reviews(events: DataFrame, path: str, keys: list[str], seq: str = "seq") -> None:
    review_files(events, keys, seq).write.mode("overwrite").json(path)


def completion(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """How many of a key's events are done with each, in the order of completion."""
    return events.withColumn("done", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def found_jobs(asked: DataFrame, running: DataFrame, saved: DataFrame, key: str = "job_id") -> DataFrame:
    """The asked jobs with status and workers: of a running job its own, of one that only its results are left of done and 1;
    a job of neither fails."""
    held = asked.join(running.select(key, "status", "workers"), key, "left").join(saved.select(key).distinct().withColumn("saved", F.lit(True)), key, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown job: "), F.col(key).cast("string")))
    status = F.when(F.col("status").isNotNull(), F.col("status")).when(F.col("saved"), "done").otherwise(unknown)
    return held.select(*asked.columns, status.alias("status"), F.coalesce("workers", F.lit(1)).alias("workers"))
