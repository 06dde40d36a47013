"""Rectangles on pages: what lies inside what, which pictures count, how lines of a box are set.

All by page (``keys``): equi-joins on the page with a condition on the sides, so pages spread over tasks and no pair
leaves its page.  y points upwards; a box is (x, y, w, h) with its lower left corner.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text


def outside(rows: DataFrame, areas: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Rows that no area of their page holds; rows are aliased a and areas b.  Null sides hold nothing."""
    return rows.join(areas, [*[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], inside], "left_anti")


def fragments_outside_tables(fragments: DataFrame, tables: DataFrame, keys: list[str], slack: float = 3.0) -> DataFrame:
    """Fragments (x, y, width) that don't touch a table (x0, x1, top, bottom), ``slack`` around it included."""
    f, t = fragments.alias("a"), tables.select(*keys, "x0", "x1", "top", "bottom").alias("b")
    level = (F.col("a.y") <= F.col("b.top") + slack) & (F.col("a.y") >= F.col("b.bottom") - slack)
    across = (F.col("a.x") + F.col("a.width") >= F.col("b.x0") - slack) & (F.col("a.x") <= F.col("b.x1") + slack)
    return outside(f, t, keys, level & across)


def lines_outside_figures(lines: DataFrame, figures: DataFrame, keys: list[str], slack: float = 4.0) -> DataFrame:
    """Lines (x0, x1, y, size) that aren't inside a figure (x, y, w, h): one that sticks out at a side stays."""
    a, f = lines.alias("a"), figures.select(*keys, "x", "y", "w", "h").alias("b")
    middle = F.col("a.y") + F.col("a.size") * 0.3
    across = (F.col("a.x0") >= F.col("b.x") - slack) & (F.col("a.x1") <= F.col("b.x") + F.col("b.w") + slack)
    return outside(a, f, keys, across & (middle >= F.col("b.y")) & (middle <= F.col("b.y") + F.col("b.h")))


def not_inside_larger(boxes: DataFrame, keys: list[str], order: str, share: float = 0.9, like: float = 0.02) -> DataFrame:
    """Boxes of which less than ``share`` lies in a larger box of the page; of two of like area the first by ``order`` stays."""
    a, b = boxes.alias("a"), boxes.select(*keys, order, "x", "y", "w", "h").alias("b")
    side = lambda x, w: F.greatest(F.lit(0.0), F.least(F.col(f"a.{x}") + F.col(f"a.{w}"), F.col(f"b.{x}") + F.col(f"b.{w}")) - F.greatest(f"a.{x}", f"b.{x}"))
    area_a, area_b = F.col("a.w") * F.col("a.h"), F.col("b.w") * F.col("b.h")
    larger = (area_b > area_a * (1 + like)) | ((F.abs(area_b - area_a) <= area_a * like) & (F.col(f"b.{order}") < F.col(f"a.{order}")))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, [*same, F.col(f"a.{order}") != F.col(f"b.{order}"), (side("x", "w") * side("y", "h") >= area_a * share) & larger], "left_anti")


def repeated(rows: DataFrame, pages: DataFrame, doc: list[str], page: str, key: str) -> DataFrame:
    """Keys (``doc``, ``key``) that are on a quarter of a document's pages, on three at least; of four pages or more."""
    n = pages.groupBy(*doc).agg(F.countDistinct(page).alias("_pages")).where("_pages >= 4")
    on = rows.select(*doc, page, key).distinct().groupBy(*doc, key).agg(F.count("*").alias("_on"))
    return on.join(n, doc).where(F.col("_on") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.25))).select(*doc, key)


def own_characters(pages: DataFrame, doc: list[str], page: str) -> DataFrame:
    """``own`` and ``total`` characters of each page (height, fragments: array of text, y): own ones are neither repeated over
    the pages, nor a page number, nor in the outer tenth of the page.  A page without fragments has 0.

    Pages are dealt out once, whole and by document; its texts are counted and summed where they then are."""
    inner = lambda f: F.coalesce(f.y.between(F.col("height") * 0.1, F.col("height") * 0.9), F.lit(False))
    texts = lambda test: F.filter(F.transform(F.filter("fragments", test), lambda f: F.trim(f.text)), lambda t: t != "")
    d = pages.select(*doc, page, texts(inner).alias("_in"), texts(lambda f: ~inner(f)).alias("_out")).repartition(*doc)
    d = d.withColumn("_pages", F.size(F.collect_set(page).over(Window.partitionBy(*doc))))
    side = lambda c, at: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(t.alias("text"), F.lit(at).alias("at")))
    n = F.length("text").cast("long")
    d = d.select(*doc, page, "_pages", F.inline_outer(F.concat(side("_in", True), side("_out", False))))
    d = d.groupBy(*doc, page, "_pages", "text").agg(F.sum(F.when(F.col("at"), n)).alias("_in"), F.sum(n).alias("_n"))
    on = F.count("*").over(Window.partitionBy(*doc, "text"))
    often = (F.col("_pages") >= 4) & (F.col("_on") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.25)))
    for k in doc:
        often &= F.col(k).isNotNull()
    # by its first and last letter most text can't be a page number; the whole test is dear
    number = F.when(F.col("text").rlike(r"(?si)^(?=[-–—\s0-9ivxlcdmp]).*[0-9ivxlcdm][-–—\s]*$"), text.page_number(F.col("text"))).otherwise(False)
    own = F.when((F.col("_in") > 0) & ~often & ~number, F.col("_in")).otherwise(0)
    return d.withColumn("_on", on).groupBy(*doc, page).agg(F.sum(own).alias("own"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))


def worth_showing(boxes: DataFrame, pages: DataFrame, doc: list[str], page: str, key: str, whole: float = 0.6, most_text: int = 300) -> DataFrame:
    """Pictures that stand for something: not repeated, 24 points each way, 1.2 percent of the page, 5 percent near its
    upper or lower edge, and no page background under text.

    ``pages`` has width, height, own and total (see ``own_characters``).  Where 40 percent of a document's pages, three
    at least, are a large picture under 300 own characters or more in the median, any text makes it a background."""
    p = pages.select(*doc, page, "width", "height", "own", "total").withColumn("_all", F.count("*").over(Window.partitionBy(*doc)))
    b = boxes.join(repeated(boxes, pages, doc, page, key), [*doc, key], "left_anti").join(p, [*doc, page])
    area, box = F.col("width") * F.col("height"), F.col("w") * F.col("h")
    large = b.where(box >= area * whole).select(*doc, page, "own", "_all").distinct()
    scans = large.groupBy(*doc).agg(((F.count("*") >= F.greatest(F.lit(3.0), F.first("_all") * 0.4)) & (F.median("own") >= most_text)).alias("_scan"))
    b = b.join(scans, doc, "left")
    middle = F.col("y") + F.col("h") / 2
    edge = (box < area * 0.05) & ((middle > F.col("height") * 0.92) | (middle < F.col("height") * 0.08))
    covered = F.when(F.coalesce("_scan", F.lit(False)), F.col("total") > 0).otherwise(F.col("own") > most_text)
    return b.where((F.col("w") >= 24) & (F.col("h") >= 24) & (box >= area * 0.012) & ~edge & ~((box >= area * whole) & covered)).select(*boxes.columns)


def upright(items: DataFrame) -> DataFrame:
    """Text items (text, a, b, c, d: their matrix) as set on the page: adds ``size`` and ``slanted``; empty ones, those
    under 1 and turned ones go."""
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    d = items.where(F.length("text") > 0).withColumn("size", size).withColumn("slanted", F.abs("c") > F.abs("d") * 0.12)
    return d.where((F.col("size") >= 1) & (F.abs("b") <= F.abs("a") * 0.3))


def recognised(lines: DataFrame, least: float = 25.0) -> DataFrame:
    """Recognised lines (text, confidence, x0, y0, x1, y1 in pixels downwards, base (null: unknown), scale, page_height)
    as fragments: text, x, y, width, size added; below ``least`` confidence or without text they go."""
    tall = F.col("y1") - F.col("y0")
    base = F.coalesce(F.col("base"), F.col("y1") - tall * 0.2)
    d = lines.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where((F.col("text") != "") & (F.col("confidence") >= least))
    return d.withColumns({"x": F.col("x0") / F.col("scale"), "y": F.col("page_height") - base / F.col("scale"), "width": (F.col("x1") - F.col("x0")) / F.col("scale"), "size": F.greatest(F.lit(4.0), tall / F.col("scale") * 0.78)})


def alignment(segments: DataFrame, keys: list[str], order: list[Column], near: float = 3.0) -> DataFrame:
    """``align`` of each box (l, ctr, r) from its segments (x0, x1): centred or right if all agree with the first one within
    ``near`` and the left edges don't; a single segment is left."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ends = {"l": F.col("x0"), "ctr": (F.col("x0") + F.col("x1")) / 2, "r": F.col("x1")}
    d = segments.select(*keys, *[F.abs(e - F.first(e).over(w)).alias(f"_{k}") for k, e in ends.items()])
    far = d.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.max(f"_{k}") < near).alias(f"_{k}") for k in ends])
    return far.select(*keys, F.when((F.col("n") < 2) | F.col("_l"), "l").when(F.col("_ctr"), "ctr").when(F.col("_r"), "r").otherwise("l").alias("align"))


def placed_among(blocks: DataFrame, tables: DataFrame, doc: list[str]) -> DataFrame:
    """``place`` of tables among blocks, both (page, y, item): from the top of each page, blocks before tables at one height."""
    both = blocks.select(*doc, "page", "y", "item", F.lit(0).alias("kind")).unionByName(tables.select(*doc, "page", "y", "item", F.lit(1).alias("kind")))
    w = Window.partitionBy(*doc).orderBy("page", F.col("y").desc(), "kind", "item")
    return both.withColumn("place", F.row_number().over(w).cast("long"))


def picture_boxes(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, op_no, key, x, y, w, h: where pictures stand, from drawing operators in their order.

    ``ops``: doc_id, page, op_no, op (save, restore, concat, begin_form, end_form, image, inline, mask), key, matrix (six numbers,
    for concat and begin_form).  ``pages``: doc_id, page, width, height, view (the page's own matrix, y downwards).  A picture is the
    unit square under the current matrix; its box is cut to the page (y upwards) and goes below one point.  A restore or end
    without a beginning leaves the matrix as it is.  Inline pictures and masks are numbered over the page.  The matrices are a
    stack that grows as it is walked, so a page is a group."""

    times = lambda m, n: [m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5]]

    def walk(ops: list[dict], wide: float, tall: float, view: list[float]) -> Iterator[tuple]:
        now, stack, unnamed = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [], 0
        for o in ops:
            op, key, matrix = o["op"], o["key"], o["matrix"]
            if op in ("save", "begin_form"):
                stack.append(now)
            if op in ("restore", "end_form") and stack:
                now = stack.pop()
            if op in ("concat", "begin_form") and matrix is not None and len(matrix) == 6:
                now = times(now, matrix)
            if op in ("image", "inline", "mask"):
                m = times(view, now)
                xs, ys = ([m[i] * u + m[i + 2] * v + m[i + 4] for u in (0, 1) for v in (0, 1)] for i in (0, 1))
                if op != "image":
                    key, unnamed = f"{op}:{unnamed}", unnamed + 1
                x, y = max(0.0, min(xs)), max(0.0, tall - max(ys))
                w, h = min(wide, max(xs)) - x, min(tall, tall - min(ys)) - y
                if w >= 1 and h >= 1:
                    yield o["op_no"], key, x, y, w, h

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, *box) for d, p, ops, w, h, v in b.itertuples(index=False) for box in walk(ops, w, h, v)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "op_no", "key", "x", "y", "w", "h"])

    kinds = dict(ops.dtypes)
    schema = f"doc_id {kinds['doc_id']}, page {kinds['page']}, op_no {kinds['op_no']}, key string, x double, y double, w double, h double"
    page = ops.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("op_no", "op", "key", "matrix"))).alias("ops"))
    return page.join(pages.select("doc_id", "page", "width", "height", "view"), ["doc_id", "page"]).mapInPandas(run, schema)
