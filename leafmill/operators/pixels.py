"""Pages as pixels: what changes between two renderings, and which text it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import drawing

#: A contrast that counts: below 90 at its largest a region has no colour, and only pixels with four fifths of the largest count.
LEAST = 72


def changed(drawn: DataFrame, bare: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (x, y, r, g, b) that a page has in both renderings and that differ by LEAST or more; r0, g0, b0 are those of ``bare``."""
    b = bare.select(*keys, "x", "y", *[F.col(c).alias(f"{c}0") for c in "rgb"])
    return drawn.select(*keys, "x", "y", *"rgb").join(b, [*keys, "x", "y"]).where(drawing.contrast() >= LEAST)


def coloured(fragments: DataFrame, pages: DataFrame, drawn: DataFrame, bare: DataFrame, keys: list[str], own: list[str], tile: int = 64, default: str = "000000") -> DataFrame:
    """Fragments with ``colour``, from the page drawn with its texts and without them.

    ``fragments``: ``keys`` of the page, ``own`` (with the keys it names a fragment), x, y, width, size in points, y the baseline from the
    bottom; ``pages``: keys, width, height in points, across and down in pixels.  A fragment's box goes from a quarter of its size below the
    baseline to four fifths above, in whole pixels outwards, within the page.  Boxes are dealt to the tiles of ``tile`` pixels that
    they touch and meet the pixels of the same tile alone.  Boxes without a colour, on unknown pages or of null sides have ``default``."""
    ex, ey = F.col("across") / F.col("width_"), F.col("down") / F.col("height")
    at = pages.select(*keys, F.col("width").alias("width_"), "height", "across", "down")
    low = lambda v: F.greatest(F.lit(0).cast("long"), F.floor(v))
    # sides that are null would be passed over by least and greatest
    f = fragments.select(*keys, *own, "x", "y", "width", "size").dropna(subset=["x", "y", "width", "size"]).join(at.dropna(), keys).select(
        *keys, *own,
        low(F.col("x") * ex).alias("_x0"), F.least("across", F.ceil((F.col("x") + F.col("width")) * ex)).alias("_x1"),
        low((F.col("height") - (F.col("y") + F.col("size") * 0.8)) * ey).alias("_y0"), F.least("down", F.ceil((F.col("height") - (F.col("y") - F.col("size") * 0.25)) * ey)).alias("_y1"),
    )
    f = f.where((F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0")))
    cell = lambda c: F.floor(c / tile)
    f = f.withColumn("_tx", F.explode(F.sequence(cell(F.col("_x0")), cell(F.col("_x1") - 1)))).withColumn("_ty", F.explode(F.sequence(cell(F.col("_y0")), cell(F.col("_y1") - 1))))
    p = changed(drawn, bare, keys).withColumns({"_tx": cell(F.col("x")), "_ty": cell(F.col("y"))})
    inside = f.join(p, [*keys, "_tx", "_ty"]).where((F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x1")) & (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y1")))
    found = drawing.text_colour(inside, [*keys, *own]).withColumnRenamed("colour", "_colour")
    d = fragments.join(found, [*keys, *own], "left")
    return d.select(*[fragments[c] for c in fragments.columns], F.coalesce("_colour", F.lit(default)).alias("colour"))
