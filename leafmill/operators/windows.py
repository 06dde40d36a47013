"""Window-shaped operators: gaps and islands, as-of, sweeps, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def island_ids(df: DataFrame, keys: list[str], order: list[str | Column], starts: Column, out: str = "island") -> DataFrame:
    """Numbers runs: a row where ``starts`` (which may look at lag()) holds begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(df: DataFrame, keys: list[str], at: str, tie: str, gap_seconds: float, out: str = "session") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at, tie)
    d = df.withColumn("_s", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    d = d.withColumn("_gap", F.col("_s") - F.lag("_s").over(w))
    return island_ids(d, keys, [at, tie], F.col("_gap") > gap_seconds, out).drop("_gap", "_s")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row of its key at or before it.

    Both sides in one ordered pass: a union and a running last value, one shuffle on the key."""
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*keys, at, *values).withColumn("_side", F.lit(0))
    both = a.unionByName(b.withColumn("_v", F.struct(*values)).drop(*values), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def peak_overlap(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Most intervals open at once, by a sweep over starts and ends; touching ends do not overlap."""
    events = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.*")
    sums = events.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("open", F.sum("d").over(w)).groupBy(*keys).agg(F.max("open").alias("peak"))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals as one; an open end (null) comes after the others of its start."""
    order = [F.asc_nulls_last(start), F.asc_nulls_last(end)]
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_far", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = island_ids(d, keys, order, F.col(start) > F.col("_far"))
    return d.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bin_: float, l0: str, l1: str, r0: str, r1: str) -> DataFrame:
    """Pairs of intervals that overlap: an equi-join on the bins they touch, each pair once (in the bin where
    the later one of the two begins)."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_), F.floor(F.col(b) / bin_)))
    a, b = left.withColumn("_bin", cut(l0, l1)), right.withColumn("_bin", cut(r0, r1))
    both = a.join(b, [*keys, "_bin"]).where((F.col(l0) < F.col(r1)) & (F.col(r0) < F.col(l1)))
    return both.where(F.col("_bin") == F.floor(F.greatest(l0, r0) / bin_)).drop("_bin")


def contained(df: DataFrame, keys: list[str], id_: str, start: str, end: str) -> DataFrame:
    """Rows whose interval lies inside another one of their key (of equal ones, all but the smallest id).

    Sorted by start, longest first, a row is inside if an earlier end reaches as far as its own."""
    w = Window.partitionBy(*keys).orderBy(F.col(start), F.col(end).desc(), F.col(id_))
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_in", F.coalesce(far >= F.col(end), F.lit(False))).where("_in").drop("_in")
