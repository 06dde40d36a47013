"""Style inheritance, property precedence, list counters, outlines, bands and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(*levels: str) -> Column:
    """A property from the most specific level that sets it, most specific first."""
    return F.coalesce(*levels)


def inherited(styles: DataFrame, props: DataFrame, depth: int = 20) -> DataFrame:
    """style, prop, value from styles (id, based_on) and props (style, prop, value): the nearest ancestor that sets
    a property wins.  Cycles end at ``depth`` steps; each step doubles the reach, so few joins do."""
    reach = styles.select(F.col("id"), F.col("id").alias("at"), F.lit(0).alias("d")).unionByName(styles.where("based_on is not null").select("id", F.col("based_on").alias("at"), F.lit(1).alias("d")))
    steps = 1
    while steps < depth:
        nxt = reach.select(F.col("id").alias("at"), F.col("at").alias("_to"), F.col("d").alias("_d"))
        reach = reach.join(nxt, "at").groupBy("id", F.col("_to").alias("at")).agg(F.min(F.col("d") + F.col("_d")).alias("d"))
        steps *= 2
    return reach.join(props, reach["at"] == props["style"]).groupBy("id", "prop").agg(F.min_by("value", "d").alias("value"))


def level_counters(items: DataFrame, keys: list[str], order: str, level: str, most: int = 9) -> DataFrame:
    """``label`` such as 2.1.3: a level counts up and sets deeper ones back.

    The number at a level is how many items of that level stand since the last item above it: windows, no fold."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d, parts = items, []
    for i in range(most):
        d = d.withColumn(f"_r{i}", F.sum((F.col(level) < i).cast("int")).over(w))
        own = Window.partitionBy(*keys, f"_r{i}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn(f"_c{i}", F.sum((F.col(level) == i).cast("int")).over(own))
        parts.append(F.when(F.col(level) >= i, F.greatest(F.col(f"_c{i}"), F.lit(1)).cast("string")))
    return d.withColumn("label", F.concat_ws(".", *parts)).drop(*[f"_{c}{i}" for c in "rc" for i in range(most)])


def outline_parents(items: DataFrame, keys: list[str], order: str, level: str, levels: int = 6) -> DataFrame:
    """``parent``: the order of the last item of a lower level; null at the top."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.max(F.when(F.col(level) == i, F.col(order))).over(w) for i in range(levels)]
    below = [F.when(F.col(level) > i, last) for i, last in enumerate(lasts)]
    return items.withColumn("parent", F.greatest(*below) if levels > 1 else below[0])


def spacing(pars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``gap`` above each paragraph: its space before and the space after the one above, none between two of the same
    style that ask for that."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.coalesce(F.col("contextual") & (F.lag("style").over(w) == F.col("style")), F.lit(False))
    return pars.withColumn("gap", F.when(same, 0.0).otherwise(F.col("before") + F.coalesce(F.lag("after").over(w), F.lit(0.0))))


def banded(cells: DataFrame, table: list[str], header: bool = True) -> DataFrame:
    """Which part of a table style a cell takes: corners of the first and last rows and columns before bands."""
    size = Window.partitionBy(*table)
    last_row, last_col = F.max("row").over(size), F.max("col").over(size)
    band = F.when((F.col("row") - int(header)) % 2 == 0, "odd row").otherwise("even row")
    part = F.when(F.col("row") == 0, "first row") if header else F.when(F.lit(False), "")
    return cells.withColumn("part", part.when(F.col("row") == last_row, "last row").when(F.col("col") == 0, "first column").when(F.col("col") == last_col, "last column").otherwise(band))


def column_bands(columns: DataFrame, keys: list[str], order: str, width: str, limit: float) -> DataFrame:
    """``band``: columns from left to right as long as they fit in ``limit``; one that is wider stands alone.

    A sum that starts again has to be walked; a sheet's columns are few, so it is a fold over one row."""
    xs = F.sort_array(F.collect_list(F.struct(order, width)))
    step = lambda a, x: F.struct(
        F.when((a.used > 0) & (a.used + x[width] > limit), x[width]).otherwise(a.used + x[width]).cast("double").alias("used"),
        F.when((a.used > 0) & (a.used + x[width] > limit), a.band + 1).otherwise(a.band).alias("band"),
        F.concat(a.out, F.array(F.struct(x[order].alias(order), F.when((a.used > 0) & (a.used + x[width] > limit), a.band + 1).otherwise(a.band).alias("band")))).alias("out"),
    )
    kind = dict(columns.dtypes)[order]
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("band"), F.array().cast(f"array<struct<{order}:{kind},band:int>>").alias("out"))
    d = columns.groupBy(*keys).agg(F.aggregate(xs, start, step).out.alias("out"))
    return d.select(*keys, F.explode("out").alias("o")).select(*keys, "o.*")


def compacted(spans: DataFrame, keys: list[str], order: str, style: str, text: str) -> DataFrame:
    """Neighbouring spans of one style as one."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((~F.col(style).eqNullSafe(F.lag(style).over(w))).cast("int"), F.lit(1))
    d = spans.withColumn("_n", new).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    xs = F.sort_array(F.collect_list(F.struct(order, text)))
    return d.groupBy(*keys, "run", style).agg(F.array_join(F.transform(xs, lambda x: x[text]), "").alias(text))


def html_blocks(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One HTML text per key from rows (kind: p, h1..h6, ul, ol; text): list items that follow each other share a list."""
    from leafmill.sources.sinks import escaped

    w = Window.partitionBy(*keys).orderBy(order)
    item = F.col("kind").isin("ul", "ol")
    opens = item & ~F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    closes = item & ~F.coalesce(F.lead("kind").over(w) == F.col("kind"), F.lit(False))
    tag = F.when(item, "li").otherwise(F.col("kind"))
    wrap = lambda c, a, b: F.when(c, F.concat(F.lit(a), F.col("kind"), F.lit(b))).otherwise("")
    body = F.concat(wrap(opens, "<", ">"), F.lit("<"), tag, F.lit(">"), escaped(F.col("text")), F.lit("</"), tag, F.lit(">"), wrap(closes, "</", ">"))
    d = blocks.withColumn("_b", body)
    return d.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_b"))), lambda x: x["_b"]), "").alias("html"))


def tab_stops(stops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, kind: the tab stops in effect, from those that each level (0 the most general) and place in it (ord) sets.

    Levels add up; the last that names a position decides, and ``clear`` takes away what earlier ones set there."""
    last = F.max_by("kind", F.struct("level", "ord"))
    return stops.groupBy(*keys, "pos").agg(last.alias("kind")).where("kind <> 'clear'")
