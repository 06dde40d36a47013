"""Outlines of any depth as rows, and gutters handed on from page to page."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read back; a folder of our own only in local runs."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="spark-leafmill-"))
    return df.checkpoint()


def flattened(nodes: DataFrame, doc: list[str]) -> DataFrame:
    """Outline nodes (id, parent, ord: place among siblings) with ``level`` (0 at the top) and ``place`` in the order in which
    they are read, each before its children.

    Ancestors' paths are joined by doubling, so a tree of depth n takes about log2 n joins.  A node whose parent isn't there is at
    the top; nodes in a cycle, and below one, are left out, as a walk from the top never meets them.  Equal ``ord`` go by id."""
    ids = nodes.select(*doc, F.col("id").alias("_up")).distinct()
    d = nodes.select(*doc, "id", "ord", F.col("parent").alias("_up")).join(ids.withColumn("_there", F.lit(True)), [*doc, "_up"], "left")
    step = F.struct("ord", "id")
    d = _cut(d.select(*doc, "id", F.when(F.col("_there"), F.col("_up")).alias("up"), F.array(step).alias("path")))
    left = d.where("up is not null").count()
    while left:
        above = d.select(*doc, F.col("id").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_above"))
        d = d.join(above, [*doc, "up"], "left")
        d = _cut(d.select(*doc, "id", F.col("_next").alias("up"), F.when(F.col("_above").isNotNull(), F.concat("_above", "path")).otherwise(F.col("path")).alias("path")))
        before, left = left, d.where("up is not null").count()
        if left == before:  # each round sets some nodes of a tree free; what is left goes round
            break
    w = Window.partitionBy(*doc).orderBy("path")
    d = d.where("up is null").select(*doc, "id", (F.size("path") - 1).alias("level"), (F.row_number().over(w) - 1).alias("place"))
    return nodes.join(d, [*doc, "id"])


def inherited_gutters(pages: DataFrame, boxes: DataFrame, few: int = 8) -> DataFrame:
    """doc_id, page, g0, g1, inherited: the gutter of each page, its own or else the last one before it that still holds.

    ``pages`` has lines (their number) and own g0, g1 (null without); ``boxes`` (doc_id, page, x0, x1) are the lines' extents.  A page
    of fewer than ``few`` lines takes the gutter of the page before if no line of its own crosses it; a page that has lines
    enough and no gutter, or whose lines cross it, ends it.  Pages without lines hand it on."""
    w = Window.partitionBy("doc_id").orderBy("page")
    own = F.col("g0").isNotNull()
    d = pages.withColumn("_run", F.sum((own | (F.col("lines") >= few)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.struct("g0", "g1")).over(Window.partitionBy("doc_id", "_run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_g", F.when(F.col("_run") > 0, first))
    cross = boxes.alias("b").join(d.where("_g.g0 is not null and g0 is null").select("doc_id", "page", "_g").alias("p"), ["doc_id", "page"])
    cross = cross.where((F.col("x0") < F.col("_g.g1")) & (F.col("x1") > F.col("_g.g0"))).select("doc_id", "page").distinct().withColumn("_cross", F.lit(1))
    d = d.join(cross, ["doc_id", "page"], "left")
    over = F.sum(F.coalesce("_cross", F.lit(0))).over(Window.partitionBy("doc_id", "_run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_ok", over == 0).where(F.col("_ok") & F.col("_g.g0").isNotNull())
    return d.select("doc_id", "page", F.col("_g.g0").alias("g0"), F.col("_g.g1").alias("g1"), F.col("g0").isNull().alias("inherited"))
