"""Page sets: ranges as text, selection, removal, permutation, splitting, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_pairs(text: Column, total: Column) -> Column:
    """``1-3, 5 8- -2`` to an array of (first, last), counted from 1; an open end is the first or last page.

    Null where the text is empty or holds junk, a page 0 or above the total, or a reversed range."""
    parts = F.filter(F.split(F.regexp_replace(F.trim(text), r"\s*-\s*(?=\d|$|[,;\s])", "-"), r"[,;\s]+"), lambda s: s != "")
    one = r"^(\d{0,9})(-?)(\d{0,9})$"

    def pair(s: Column) -> Column:
        a, dash, b = (F.regexp_extract(s, one, i) for i in (1, 2, 3))
        first = F.when(a == "", F.lit(1)).otherwise(F.try_to_number(a, F.lit("999999999")).cast("int"))
        last = F.when(dash == "", first).otherwise(F.when(b == "", total.cast("int")).otherwise(F.try_to_number(b, F.lit("999999999")).cast("int")))
        ok = s.rlike(one) & (s != "-") & (first >= 1) & (last <= total) & (first <= last)
        return F.when(ok, F.struct(first.alias("first"), last.alias("last")))

    pairs = F.transform(parts, pair)
    return F.when((F.size(pairs) > 0) & F.forall(pairs, lambda p: p.isNotNull()), pairs)


def range_pages(text: Column, total: Column) -> Column:
    """The distinct pages of the ranges, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(range_pairs(text, total), lambda p: F.sequence(p["first"], p["last"])))))


def islands(df: DataFrame, keys: list[str], n: str, stretch: int = 4096) -> DataFrame:
    """Runs of consecutive numbers: first, last, size.

    Numbers are windowed by key and stretch, so that one key may hold most rows; only runs that reach the border of a
    stretch, two of each at most, are then joined by key."""
    d = df.select(*keys, F.col(n).cast("long").alias("_n")).distinct().withColumn("_s", F.floor(F.col("_n") / stretch))
    w = Window.partitionBy(*keys, "_s").orderBy("_n")
    d = d.withColumn("_i", F.col("_n") - F.row_number().over(w))
    runs = d.groupBy(*keys, "_s", "_i").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count("*").alias("size"))
    border = (F.col("first") == F.col("_s") * stretch) | (F.col("last") == (F.col("_s") + 1) * stretch - 1)
    inner = runs.where(~border).select(*keys, "first", "last", "size")
    k = Window.partitionBy(*keys).orderBy("first")
    edge = runs.where(border).withColumn("_new", (F.coalesce(F.lag("last").over(k), F.col("first")) + 1 != F.col("first")).cast("int"))
    edge = edge.withColumn("_r", F.sum("_new").over(k.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "_r").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"))
    return inner.unionByName(edge.drop("_r"))


def range_text(df: DataFrame, keys: list[str], n: str, stretch: int = 10_000) -> DataFrame:
    """The pages of each key as one text: ``1-3, 5``; null for a key without numbers.

    Runs are written and sorted by key and ``stretch`` of numbers in which they begin; only these texts meet by key, in order."""
    runs = islands(df, keys, n).withColumn("_s", F.floor(F.col("first") / stretch))
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))

    def joined(order: str, text: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x.t), ", ")

    texts = runs.groupBy(*keys, "_s").agg(joined("first", one).alias("_t"))
    bare = df.where(F.col(n).isNull()).select(*keys).distinct().select(*keys, F.lit(None).cast("long").alias("_s"), F.lit(None).cast("string").alias("_t"))
    return texts.unionByName(bare).groupBy(*keys).agg(F.when(F.count("_t") > 0, joined("_s", F.col("_t"))).alias("ranges"))


def select_pages(pages: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Pages as the plan (keys, pos) lists them, repeats included; a permutation, a pick or a mix of sources."""
    return plan.join(pages, keys)


def drop_pages(pages: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    return pages.join(dropped.select(*keys).distinct(), keys, "left_anti")


def split_every(df: DataFrame, keys: list[str], page: str, n: int) -> DataFrame:
    """Parts of ``n`` pages (the last may be short): part, first and last page from 1, label."""
    d = df.groupBy(*keys, F.floor(F.col(page) / n).alias("part")).agg((F.min(page) + 1).alias("first"), (F.max(page) + 1).alias("last"))
    return d.withColumn("label", F.when(F.col("first") == F.col("last"), F.concat(F.lit("p"), F.col("first").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))))


def numbered(df: DataFrame, keys: list[str], order: str, start: int = 1) -> DataFrame:
    """``number`` from ``start`` and ``label`` "n / total", where the total is pages + start - 1."""
    w = Window.partitionBy(*keys)
    n = F.row_number().over(w.orderBy(order)) + (start - 1)
    total = F.count("*").over(w) + (start - 1)
    return df.withColumn("number", n.cast("long")).withColumn("label", F.concat(n.cast("string"), F.lit(" / "), total.cast("string")))


def rotated(rotation: Column, degrees: int) -> Column:
    return F.pmod(rotation + degrees, F.lit(360))


def concatenated(sources: list[DataFrame], order: str) -> DataFrame:
    """All pages of the first source, then of the second, ...: source_no and the pages in their own order."""
    if len(sources) < 2:
        raise ValueError("two sources at least")
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_no", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
