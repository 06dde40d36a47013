"""Statistics with the tie and rank rules of the document tools; all of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_percentile(value: Column | str, p: float) -> Column:
    """The element at place min(n - 1, floor(p * n)), counted from 0; null without values.

    For groups that fit in a row; ``floor_percentile_of`` has no such bound."""
    xs = F.array_sort(F.collect_list(value))
    return F.when(F.size(xs) > 0, F.element_at(xs, F.least(F.size(xs), F.floor(F.size(xs) * F.lit(p)).cast("int") + 1)))


def floor_percentile_of(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The same through counts per value: a group may be of any size, its distinct values are windowed."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(w)
    place = F.least(total - 1, F.floor(total * F.lit(p)))
    hit = counts.withColumn("_upto", upto).withColumn("_at", place).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    return hit.select(*keys, F.col(value).alias("percentile"))


def bucket_mode(df: DataFrame, keys: list[str], value: str, step: float, order: str) -> DataFrame:
    """The most frequent multiple of ``step``; of equals the one seen first in the order of ``order``."""
    bucket = F.floor(F.col(value) / step + 0.5) * step
    n = df.groupBy(*keys, bucket.alias("_b")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return n.groupBy(*keys).agg(F.max_by("_b", F.struct("_n", (-F.col("_first")).alias("f"))).alias("mode"))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, step: float) -> DataFrame:
    """The multiple of ``step`` with the largest weight; of equals the smaller one."""
    bucket = F.floor(F.col(value) / step + 0.5) * step
    n = df.groupBy(*keys, bucket.alias("_b")).agg(F.sum(weight).alias("_n"))
    return n.groupBy(*keys).agg(F.max_by("_b", F.struct("_n", (-F.col("_b")).alias("f"))).alias("mode"))


def histogram(df: DataFrame, keys: list[str], level: Column) -> DataFrame:
    return df.groupBy(*keys, level.cast("long").alias("level")).agg(F.count("*").alias("n"))


def otsu(levels: DataFrame, keys: list[str], default: int = 128) -> DataFrame:
    """The level that parts a histogram (level, n) best by variance between classes; the first of equals."""
    w = Window.partitionBy(*keys)
    run = w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    d = levels.withColumn("_w", F.sum("n").over(run)).withColumn("_s", F.sum(F.col("n") * F.col("level")).over(run))
    d = d.withColumn("_tw", F.sum("n").over(w)).withColumn("_ts", F.sum(F.col("n") * F.col("level")).over(w))
    left = F.col("_s") / F.col("_w")
    right = F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tw") - F.col("_w"))
    between = F.col("_w") * (F.col("_tw") - F.col("_w")) * (left - right) * (left - right)
    d = d.withColumn("_v", F.round(F.coalesce(between, F.lit(0.0)), 3))
    best = F.max_by("level", F.struct("_v", (-F.col("level")).alias("f")))
    return d.groupBy(*keys).agg(F.when(F.max("_v") > 0, best).otherwise(F.lit(default)).cast("long").alias("threshold"))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """0..255 between the two bounds, clamped."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((value - low) * 255, high - low), F.lit(0.0))))
