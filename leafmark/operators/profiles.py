"""One-dimensional profiles as rows (key, i, x): runs, moving means, percentiles, medians, adjacent pairs.

Windows are partitioned by the profile's key, and rows of a profile are few; profiles of many keys spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(key: str = "key") -> Window:
    return Window.partitionBy(key).orderBy("i")


def runs(profile: DataFrame, active: Column) -> DataFrame:
    """The maximal runs of active positions: start and end (exclusive)."""
    on = profile.where(active)
    island = F.col("i") - F.row_number().over(_along())
    return on.withColumn("island", island).groupBy("key", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end")).drop("island")


def smoothed(profile: DataFrame, k: int) -> DataFrame:
    """Moving mean of k values, zeros beyond the ends."""
    around = _along().rowsBetween(-(k // 2), (k - 1) // 2)
    return profile.withColumn("smooth", F.sum("x").over(around) / k)


def local_mean(profile: DataFrame, radius: int) -> DataFrame:
    """Mean of the values at most radius away, fewer at the ends."""
    return profile.withColumn("mean", F.avg("x").over(_along().rowsBetween(-radius, radius)))


def differences(profile: DataFrame) -> DataFrame:
    return profile.withColumn("diff", F.col("x") - F.lag("x").over(_along()))


def extent(profile: DataFrame, active: Column) -> DataFrame:
    """First and last active position of each profile, null without one."""
    return profile.groupBy("key").agg(F.min(F.when(active, F.col("i"))).alias("first"), F.max(F.when(active, F.col("i"))).alias("last"))


def percentiles(profile: DataFrame) -> DataFrame:
    """Median and 99th percentile (interpolated) and population deviation."""
    return profile.groupBy("key").agg(F.round(F.median("x"), 6).alias("median"), F.round(F.percentile("x", F.lit(0.99)), 6).alias("p99"), F.round(F.stddev_pop("x"), 6).alias("std"))


def peak(profile: DataFrame) -> DataFrame:
    """Position of the highest value, the first of equals."""
    return profile.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("x"), "i"))).where("k = 1").drop("k")


def weighted_median(values: DataFrame) -> DataFrame:
    """Lower weighted median of each key (value, weight): the first value where half the weight is reached."""
    up = Window.partitionBy("key").orderBy("value", "i")
    out = values.withColumns({"reached": F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("weight").over(Window.partitionBy("key"))})
    out = out.where(F.col("reached") >= F.col("all") / 2)
    return out.withColumn("k", F.row_number().over(up)).where("k = 1").select("key", F.col("value").alias("median"))


def _with_median(values: DataFrame, value: str, name: str) -> DataFrame:
    """The rows (key, i, weight) with the weighted median of a column of theirs; no join, which would make the rows anew for each side."""
    whole, up = Window.partitionBy("key"), Window.partitionBy("key").orderBy(value, "i").rowsBetween(Window.unboundedPreceding, 0)
    out = values.withColumns({"reached": F.sum("weight").over(up), "all": F.sum("weight").over(whole)})
    half = F.when(F.col("reached") >= F.col("all") / 2, F.col(value))
    return out.withColumn(name, F.min(half).over(whole)).where(F.col(name).isNotNull()).drop("reached", "all")


def weighted_quantile(values: DataFrame, cut, share: float = 0.5, buckets: int = 1024) -> DataFrame:
    """key and the first value at which `share` of the key's weight (key, value, weight) is reached, without the rows of a key in one place.

    Each round cuts the range of values that is still open for a key into buckets of equal width and adds up their weights, first within each
    task; the bucket in which the share is reached is the next round's range, until its least and greatest value are one. Keys with
    a value or weight missing leave those rows out. `cut` writes a table and reads it back, for a row of state a key.
    """
    rows = values.where("value IS NOT NULL AND NOT isnan(value) AND weight IS NOT NULL").select("key", F.col("value").cast("double").alias("value"), "weight")
    state = cut(rows.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), (F.sum("weight") * share).alias("want"), F.lit(0.0).alias("before")))
    done = state.where("lo = hi").select("key", F.col("lo").alias("value"))
    state = state.where("lo < hi")
    along = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    while not state.isEmpty():
        own = rows.join(state, "key").where("value BETWEEN lo AND hi")
        # by halves, so that the width of no range overflows; both ends have buckets of their own, so each round leaves less
        place = F.when(F.col("value") == F.col("lo"), -1).when(F.col("value") == F.col("hi"), buckets).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets)))
        parts = own.withColumn("bucket", place).groupBy("key", "want", "before", "bucket").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("weight").alias("w"))
        upto = parts.withColumn("upto", F.col("before") + F.sum("w").over(along))
        last = F.max("bucket").over(Window.partitionBy("key"))
        hit = upto.withColumn("last", last).where((F.col("upto") >= F.col("want")) | (F.col("bucket") == F.col("last")))
        first = hit.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("bucket"))).where("k = 1")
        state = cut(first.select("key", "lo", "hi", "want", (F.col("upto") - F.col("w")).alias("before")))
        done = done.unionByName(state.where("lo = hi").select("key", F.col("lo").alias("value")))
        state = state.where("lo < hi")
    return done


def skew(angles: DataFrame, most: float) -> DataFrame:
    """Estimate and confidence of a page's skew from line angles (key, i, value, weight): weighted median, agreement and support."""
    near = angles.where(F.abs("value") <= most)
    spread = _with_median(near, "value", "estimate").withColumn("off", F.abs(F.col("value") - F.col("estimate")))
    out = _with_median(spread, "off", "dispersion").groupBy("key", "estimate", "dispersion").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("off") <= F.greatest(F.lit(0.6), F.col("dispersion") * 2.5)).alias("support"))
    sure = F.least(F.lit(1.0), F.col("support") / 8) * F.greatest(F.lit(0.0), 1 - F.col("dispersion") / 1.5)
    few = F.col("n") < 3
    return out.select("key", F.round(F.when(few, 0.0).otherwise(F.col("estimate")), 6).alias("estimate"), F.round(F.when(few, 0.0).otherwise(sure), 6).alias("confidence"))


def adjacent_pairs(bands: DataFrame, most: int) -> DataFrame:
    """The first two neighbouring bands (key, start, end) with at most `most` between them."""
    order = Window.partitionBy("key").orderBy("start")
    out = bands.withColumns({"next_start": F.lead("start").over(order), "next_end": F.lead("end").over(order)}).where(F.col("next_start") - F.col("end") <= most)
    return out.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def seam(profile: DataFrame, radius: int, ink: float) -> DataFrame:
    """Of the positions whose local mean is at most ink, the one with the highest (1 - mean, position)."""
    low = local_mean(profile, radius).where(F.col("mean") <= ink)
    return low.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("mean", F.desc("i")))).where("k = 1").select("key", "i", F.round("mean", 6).alias("mean"))
