"""Chart series: densify, stack, share, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import sheet


def densify(points: DataFrame, keys: list[str], idx: str, value: str, count: str) -> DataFrame:
    """A row for each index from 0 to ``count`` - 1 of every series; missing points have a null value.

    The indices are joined in, so only sparse points move."""
    frame = points.groupBy(*keys).agg(F.max(count).alias("_n"))
    frame = frame.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_n").cast("long") - 1, F.lit(0)))).alias(idx)).join(frame, keys).where(F.col(idx) < F.col("_n")).drop("_n")
    return frame.join(points.select(*keys, F.col(idx).cast("long").alias(idx), value), [*keys, idx], "left")


def filled(series: DataFrame, cells: DataFrame, book: list[str], keys: list[str], sheets: DataFrame | None = None) -> DataFrame:
    """``keys``, idx, text, value: the points of series, from their caches or else from the cells that they point to.

    ``series`` has ``book``, ``keys`` (both together name a series), kind (number or text), formula, n (points of its cache, null: no cache) and
    points (array of idx, text).  A cached series has n points; one without a cache has a point for each cell of its range,
    row by row.  A missing point is empty text or a null value, as text that isn't a finite number is a null value.  A series
    whose reference can't be read or whose sheet isn't in the book (``sheets``: book, sheet; left out: those with ``cells``) gives
    one row of nulls, an empty cache none.  Cells (book, sheet, row, col, text) meet positions by equal keys, so a long range
    spreads over tasks."""
    s, own = series.select(*book, *keys, "kind", "formula", "n", "points"), [*book, *keys]
    cached = s.where(F.col("n").isNotNull()).select(*own, "kind", "n", F.explode_outer("points").alias("p")).select(*own, "kind", "n", F.col("p.idx").alias("idx"), F.col("p.text").alias("text"))
    cached = densify(cached, [*own, "kind"], "idx", "text", "n").withColumn("_there", F.lit(True))
    sheets = (cells if sheets is None else sheets).select(*book, "sheet").distinct().withColumn("_there", F.lit(True))
    r = s.where(F.col("n").isNull()).select(*own, "kind", sheet.cell_range(F.col("formula")).alias("_r")).withColumn("sheet", F.col("_r.sheet"))
    r = r.join(sheets, [*book, "sheet"], "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    span = lambda side: F.when(there, F.sequence(F.col(f"_r.{side}_a"), F.col(f"_r.{side}_b")))
    r = r.withColumn("row", F.explode_outer(span("row"))).withColumn("col", F.explode_outer(span("col")))
    place = (F.col("row") - F.col("_r.row_a")) * (F.col("_r.col_b") - F.col("_r.col_a") + 1) + F.col("col") - F.col("_r.col_a")
    c = cells.select(*book, "sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")
    given = r.withColumn("idx", place).join(c, [*book, "sheet", "row", "col"], "left").select(*own, "kind", "idx", "text", there.alias("_there"))
    number = F.trim("text").rlike(r"\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z")
    value = F.when((F.col("kind") == "number") & number, F.trim("text").try_cast("double"))
    text = F.when((F.col("kind") == "text") & F.col("_there"), F.coalesce("text", F.lit("")))
    return cached.select(*given.columns).unionByName(given).select(*own, "idx", text.alias("text"), F.when(F.abs(value) != float("inf"), value).alias("value"))


def stacked(series: DataFrame, category: list[str], order: list[str], value: str) -> DataFrame:
    """``base`` and ``top`` of each bar: running sums over the series of a category, positive and negative apart."""
    sign = F.when(F.col(value) >= 0, 1).otherwise(-1)
    w = Window.partitionBy(*category, sign).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)
    return series.withColumn("top", top).withColumn("base", top - F.coalesce(F.col(value), F.lit(0.0)))


def share(series: DataFrame, category: list[str], value: str) -> DataFrame:
    """``share`` of the total of its category, negatives counted as 0; 0 where the total is."""
    v = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    total = F.sum(v).over(Window.partitionBy(*category))
    return series.withColumn("share", F.coalesce(F.try_divide(v, F.nullif(total, F.lit(0.0))), F.lit(0.0)))


def pie_angles(series: DataFrame, category: list[str], order: list[str], value: str) -> DataFrame:
    """``start`` and ``sweep`` in degrees, clockwise from the top."""
    d = share(series, category, value)
    w = Window.partitionBy(*category).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("sweep", F.col("share") * 360).withColumn("start", F.sum("sweep").over(w) - F.col("sweep"))


def nice_step(low, high, steps: int = 6):
    """The step of an axis of about ``steps`` steps: 1, 2, 5 or 10 times a power of ten.  A single value
    gets half of it as range, zero gets one."""
    span = F.when(low == high, F.when(low == 0, F.lit(1.0)).otherwise(F.abs(low) * 0.5)).otherwise(high - low)
    raw = span / F.lit(float(steps))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    return F.when(part < 1.5, 1.0).when(part < 3, 2.0).when(part < 7, 5.0).otherwise(10.0) * power


def axis(low, high, steps: int = 6):
    """Struct of ``step``, ``low`` and ``high``: whole steps around the values."""
    step = nice_step(low, high, steps)
    top = F.when(low == high, low + F.when(low == 0, F.lit(1.0)).otherwise(F.abs(low) * 0.5)).otherwise(high)
    return F.struct(step.alias("step"), (F.floor(low / step + 1e-9) * step).alias("low"), (F.ceil(top / step - 1e-9) * step).alias("high"))
