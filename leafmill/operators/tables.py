"""Tables and reading order from positioned text fragments.

Rows (doc_id, page, frag_no, text, x, y, width, size, bold), y upwards, are grouped by window functions per page;
only the walk along baselines, whose reference moves with the largest fragment, is a Python function over sorted pages.
A page is the unit of work everywhere, so documents of any length spread over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

PAGE = ["doc_id", "page"]


def baselines(fragments: DataFrame, like: float = 0.3, unlike: float = 0.55) -> DataFrame:
    """Adds ``line``: fragments of like size share a line within ``like`` of it, those that differ by more than 15 percent
    (raised or lowered ones) within ``unlike`` of the larger one.  A line's height is that of its largest fragment;
    the last eight lines are looked at, not beyond 2.5 sizes.  Fragments without text have none.  Exact: pages are walked one
    after the other in sorted partitions, so that neither a small page costs a call nor a large one memory."""

    names = fragments.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, n = deque(maxlen=8), 0  # y, size of the largest
        for b in batches:
            first, ys, sizes = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_first", "_y", "_size"))
            out = []
            for new, y, size in zip(first, ys, sizes, strict=True):
                if new:
                    lines.clear()
                    n = 0
                found = None
                for i in range(1, len(lines) + 1):
                    other, height = lines[-i]
                    large, small = max(size, height), min(size, height)
                    if abs(other - y) <= large * (unlike if small < 0.85 * large else like):
                        found = i
                        break
                    if other - y > 2.5 * large:
                        break
                if found is None:
                    lines.append((y, size))
                    n, found = n + 1, 1
                elif size > lines[-found][1]:
                    lines[-found] = (y, size)
                out.append(n - found)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int32())], [*names, "line"])

    place = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("y", "x")]
    order = [place[0].desc_nulls_last(), place[1].asc_nulls_last(), F.asc_nulls_last("frag_no")]
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) == 1
    d = fragments.where("text <> ''").withColumns({"_y": place[0], "_size": F.col("size").cast("double"), "_first": first})
    schema = StructType([*fragments.schema.fields, StructField("line", IntegerType())])
    # sorted as by the window already; said again, as the walk relies on it
    return d.sortWithinPartitions(*PAGE, *order).mapInArrow(walk, schema)


def raw_cells(lined: DataFrame, gap: float = 0.6, space: float = 0.12) -> DataFrame:
    """Cells of each line: a gap above ``gap`` of the smaller size begins one, a gap above ``space`` is a blank."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "frag_no")
    before = F.lag(F.struct((F.col("x") + F.col("width")).alias("end"), "size")).over(w)
    d = lined.withColumn("_p", before)
    off = F.col("x") - F.col("_p.end")
    small = F.least("size", F.col("_p.size"))
    d = d.withColumn("_new", F.coalesce((off > small * gap).cast("int"), F.lit(1))).withColumn("_sep", F.when(off > small * space, " ").otherwise(""))
    d = d.withColumn("cell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.sort_array(F.collect_list(F.struct("x", "frag_no", F.when(F.col("_new") == 1, "").otherwise(F.col("_sep")).alias("sep"), "text")))
    return d.groupBy(*PAGE, "line", "cell").agg(
        F.trim(F.array_join(F.transform(pieces, lambda p: F.concat(p.sep, p.text)), "")).alias("text"),
        F.min("x").alias("x0"),
        F.max(F.col("x") + F.col("width")).alias("x1"),
        F.max("y").alias("y"),
        F.max("size").alias("size"),
        F.bool_and("bold").alias("bold"),
    )


def _block_lines(cells: DataFrame, reach: float = 3.2, bridge: float = 4.5) -> DataFrame:
    """The lines that make tables: PAGE, line, block, n and ``_cells``, the line's cells from left to right.  One row a line, so that nothing
    is joined back."""
    rest = ["x0", "cell", *(c for c in cells.columns if c not in (*PAGE, "line", "x0", "cell"))]
    lines = cells.groupBy(*PAGE, "line").agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct(*rest))).alias("_cells"))
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "line")
    d = lines.withColumn("_prev", F.lag(F.struct("n", "y", "size")).over(w)).withColumn("_next", F.lead(F.struct("n", "y")).over(w))
    large = F.greatest("size", "_prev.size")
    near = F.col("_prev.y") - F.col("y") <= large * reach
    bridged = (F.col("n") == 1) & (F.col("_prev.n") > 1) & (F.col("_next.n") > 1) & near & (F.col("_prev.y") - F.col("_next.y") <= large * bridge)
    d = d.withColumn("_in", (F.col("n") > 1) | F.coalesce(bridged, F.lit(False)))
    d = d.withColumn("_far", F.coalesce(~near, F.lit(True)))
    d = d.withColumn("_start", (F.col("_in") & (F.col("_far") | ~F.coalesce(F.lag("_in").over(w), F.lit(False)))).cast("int"))
    d = d.withColumn("block", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    rows = F.count_if(F.col("n") > 1).over(Window.partitionBy(*PAGE, "block"))
    return d.withColumn("_rows", rows).where("_rows >= 2").select(*PAGE, "line", "block", "n", "_cells")


def table_blocks(cells: DataFrame, reach: float = 3.2, bridge: float = 4.5) -> DataFrame:
    """Adds ``block`` to the lines that make tables: runs of lines with two cells or more, close to each other
    (``reach`` sizes); one line of a single cell between two such lines stays in, if these are at most ``bridge`` sizes apart."""
    return _block_lines(cells, reach, bridge).select(*PAGE, "line", "block", F.inline("_cells")).select(*cells.columns, "block")


def table_columns(lines: DataFrame) -> DataFrame:
    """The cells of table lines (n, _cells) with ``cols``, the column ranges (c0, c1) of their block from left to right: taken from
    the lines with its most frequent number of cells (the larger of equals); ranges that overlap are fused."""
    key = [*PAGE, "block"]
    block = Window.partitionBy(*key)
    d = lines.withColumn("_c", F.count("*").over(Window.partitionBy(*key, "n"))).withColumn("_usual", F.max(F.struct("_c", "n")).over(block)["n"] == F.col("n"))
    d = d.select(*key, "line", "_usual", F.posexplode("_cells").alias("_k", "_cell")).select(*key, "line", "_usual", "_k", "_cell.*")
    at = Window.partitionBy(*key, "_usual", "_k")
    edges = F.when(F.col("_usual"), F.struct(F.min("x0").over(at).alias("c0"), F.max("x1").over(at).alias("c1")))
    d = d.withColumn("_range", edges).withColumn("row_no", F.dense_rank().over(block.orderBy(F.col("y").desc())) - 1)
    d = d.withColumn("_ranges", F.collect_set("_range").over(block)).withColumn("_at", F.row_number().over(block.orderBy(F.col("y").desc())))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    fused = F.aggregate(
        F.sort_array("_ranges"),
        F.slice("_ranges", 1, 0),
        lambda a, r: F.when((F.size(a) == 0) | (r.c0 >= F.array_max(F.transform(a, lambda c: c.c1))), F.concat(a, F.array(r))).otherwise(
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a).c0.alias("c0"), F.greatest(last(a).c1, r.c1).alias("c1"))))
        ),
    )
    # fused at a block's first row alone
    d = d.withColumn("cols", F.max(F.when(F.col("_at") == 1, fused)).over(block))
    return d.drop("_usual", "_k", "_range", "_ranges", "_at")


def assigned_cells(cells: DataFrame) -> DataFrame:
    """Each cell with its first column and span: columns (``cols``) it overlaps by half of itself or 60 % of them, else the
    one with the nearest centre."""
    x0, x1 = F.col("x0"), F.col("x1")
    shared = lambda c: F.least(x1, c.c1) - F.greatest(x0, c.c0)
    hit = F.transform("cols", lambda c: (shared(c) > 0.5 * (x1 - x0)) | (shared(c) > 0.6 * (c.c1 - c.c0)))
    away = F.transform("cols", lambda c: F.abs((x0 + x1 - c.c0 - c.c1) / 2))
    d = cells.withColumn("_hit", hit)
    first, nearest = F.array_position("_hit", True) - 1, F.array_position(away, F.array_min(away)) - 1
    d = d.withColumns({"col": F.when(first >= 0, first).otherwise(nearest), "span": F.greatest(F.size(F.filter("_hit", lambda h: h)), F.lit(1)).cast("long")})
    return d.drop("_hit", "cols")


def tables(fragments: DataFrame) -> DataFrame:
    """doc_id, page, block, row_no, col, span, text, bold: the tables of positioned text; text set in columns (long
    cells, or many that start in lower case) is left out.

    After the walk rows are dealt out once, by page; all that follows are windows inside a page, without a join."""
    key = [*PAGE, "block"]
    lined = baselines(fragments.select(*PAGE, "frag_no", "text", "x", "y", "width", "size", "bold"))
    lines = _block_lines(raw_cells(lined.repartition(*PAGE)))
    share = lambda test: F.sum(F.size(F.filter("_cells", test))).over(Window.partitionBy(*key)) / F.sum("n").over(Window.partitionBy(*key))
    lines = lines.withColumn("_low", share(lambda c: c.text.rlike("^[a-zß-öø-ÿ]"))).withColumn("_long", share(lambda c: F.length(c.text) > 35))
    out = assigned_cells(table_columns(lines.where("_low < 0.4 and _long < 0.6")))
    return out.select(*key, "row_no", "col", "span", "text", "bold")


def continued(blocks: DataFrame) -> DataFrame:
    """Joins a page's first table to the last one of the page before where all column edges agree within 6 (left) and
    12 (right): rows (doc_id, page, block, first, last, cols array of (c0, c1)) get ``table_no``."""
    w = Window.partitionBy("doc_id").orderBy("page", "block")
    d = blocks.withColumn("_p", F.lag(F.struct("page", "last", "cols")).over(w))
    near = F.forall(F.zip_with("cols", F.col("_p.cols"), lambda a, b: F.coalesce((F.abs(a.c0 - b.c0) <= 6) & (F.abs(a.c1 - b.c1) <= 12), F.lit(False))), lambda x: x)
    goes_on = (F.col("page") == F.col("_p.page") + 1) & F.col("first") & F.col("_p.last") & (F.size("cols") == F.size("_p.cols")) & near
    return d.withColumn("table_no", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_p")


def joined_lines(xs: Column) -> Column:
    """Lines as one text: a hyphen before a small letter goes, anything else meets with a space."""
    small = "^[a-zß-öø-ÿ]"
    return F.aggregate(
        xs,
        F.lit(""),
        lambda a, x: F.when(a == "", x).when(a.endswith("-") & x.rlike(small), F.concat(F.left(a, F.length(a) - 1), x)).otherwise(F.concat(a, F.lit(" "), x)),
    )


def headings(pars: DataFrame) -> DataFrame:
    """Adds ``level`` (1 to 3, else null): up to 160 characters set a tenth or more above the body, which is the size
    with the most characters of the document; sizes rank downwards."""
    size = F.floor(F.col("size") * 2 + 0.5) / 2
    weights = pars.groupBy("doc_id", size.alias("b")).agg(F.sum(F.length("text")).alias("n"))
    body = weights.groupBy("doc_id").agg(F.max_by("b", F.struct("n", (-F.col("b")).alias("s"))).alias("body"))
    d = pars.join(body, "doc_id").withColumn("_h", (F.col("size") >= F.col("body") * 1.12) & (F.length("text") <= 160))
    sizes = d.where("_h").select("doc_id", size.alias("b")).distinct()
    level = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("b").desc()))
    d = d.withColumn("b", F.when(F.col("_h"), size)).join(sizes.withColumn("level", F.least(level, F.lit(3))), ["doc_id", "b"], "left")
    return d.drop("_h", "b", "body")


def shared_boxes(boxes: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Components of boxes (doc_id, page, key, x, y, w, h) that touch: union-find inside a page."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        root = list(range(len(g)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        b = g[["x", "y", "w", "h"]].to_numpy(float)
        for i in range(len(g)):
            near = (b[:, 0] <= b[i, 0] + b[i, 2] + tolerance) & (b[:, 0] + b[:, 2] >= b[i, 0] - tolerance) & (b[:, 1] <= b[i, 1] + b[i, 3] + tolerance) & (b[:, 1] + b[:, 3] >= b[i, 1] - tolerance)
            for j in near.nonzero()[0]:
                if j < i:
                    root[max(top(i), top(int(j)))] = min(top(i), top(int(j)))
        return g.assign(component=[top(i) for i in range(len(g))])

    return boxes.groupBy(*PAGE).applyInPandas(merge, ", ".join(f"{n} {t}" for n, t in boxes.dtypes) + ", component int")


def reading_order(lines: DataFrame) -> DataFrame:
    """``place`` of each line (doc_id, page, line, x0, x1, y, column: I left, D right, C across, U single): lines across
    both columns part a page into bands; in a band the left column comes before the right one."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "x0", "line").rowsBetween(Window.unboundedPreceding, 0)
    across = F.col("column").isin("C", "U")
    d = lines.withColumn("_band", F.sum(across.cast("int")).over(w))
    side = F.when(across, 0).when(F.col("column") == "I", 1).otherwise(2)
    order = Window.partitionBy(*PAGE).orderBy("_band", side, F.col("y").desc(), "x0", "line")
    return d.withColumn("place", F.row_number().over(order) - 1).drop("_band")


def segments(fragments: DataFrame, gap: float = 1.5) -> DataFrame:
    """Adds ``segment`` to the fragments of a line: a new one after a gap above ``gap`` of the larger size of the open
    segment and the fragment.  The open segment's size grows as it is walked, so a page is a group."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        out, line, end, size, n = [], None, 0.0, 0.0, 0
        g = g.sort_values(["line", "x", "frag_no"])
        for ln, x, w, s in g[["line", "x", "width", "size"]].itertuples(index=False):
            if ln != line or x - end > gap * max(size, s):
                n, size, end = (n + 1 if ln == line else 0), s, x + w
            line, size, end = ln, max(size, s), max(end, x + w)
            out.append(n)
        return g.assign(segment=out)

    return fragments.groupBy(*PAGE).applyInPandas(walk, ", ".join(f"{n} {t}" for n, t in fragments.dtypes) + ", segment int")


def text_boxes(segs: DataFrame, last: int = 40) -> DataFrame:
    """Adds ``box`` to segments (doc_id, page, seg_no, x0, x1, y, size): each joins the nearest open box above it among the
    ``last`` ones - 0.5 to 2.2 lines off, of a like size, and aligned left, in the centre or right - or opens one."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "x0", "seg_no"], ascending=[False, True, True])
        boxes: list[list[float]] = []  # x0, x1, y, size of the lowest segment
        out = []
        for x0, x1, y, size in g[["x0", "x1", "y", "size"]].itertuples(index=False):
            best = None
            for i in range(len(boxes) - 1, max(-1, len(boxes) - 1 - last), -1):
                b0, b1, by, bs = boxes[i]
                tol = 0.6 * size
                aligned = abs(x0 - b0) <= tol or abs(x1 - b1) <= tol or abs((x0 + x1) - (b0 + b1)) <= 2 * tol
                if 0.5 <= (by - y) / size <= 2.2 and 0.75 <= size / bs <= 1.3 and aligned and (best is None or by < boxes[best][2]):
                    best = i
            if best is None:
                best = len(boxes)
                boxes.append([x0, x1, y, size])
            else:
                boxes[best] = [x0, x1, y, size]
            out.append(best)
        return g.assign(box=out)

    return segs.groupBy(*PAGE).applyInPandas(walk, ", ".join(f"{n} {t}" for n, t in segs.dtypes) + ", box int")


def gutter(lines: DataFrame, most: float = 0.8) -> DataFrame:
    """doc_id, page, g0, g1: the widest stretch inside a page's text that at most a fifth of the lines cover, found by a
    sweep over where fragments (x0, x1) begin and end; no row where there is none."""
    n = lines.groupBy(*PAGE).agg(F.count_distinct("line").alias("_n"), F.min("x0").alias("_l"), F.max("x1").alias("_r"))
    e = lines.select(*PAGE, F.explode(F.array(F.struct(F.col("x0").alias("at"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(*PAGE, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*PAGE).orderBy("at")
    d = e.withColumn("_open", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_to", F.lead("at").over(w)).join(n, PAGE)
    d = d.withColumn("_free", (F.col("_open") <= (1 - most) * F.col("_n")) & F.col("_to").isNotNull())
    d = d.withColumn("_run", F.sum((~F.col("_free")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_free")
    runs = d.groupBy(*PAGE, "_run").agg(F.min("at").alias("g0"), F.max("_to").alias("g1"), F.first("_l").alias("_l"), F.first("_r").alias("_r"))
    runs = runs.where((F.col("g0") > F.col("_l")) & (F.col("g1") < F.col("_r")))
    return runs.groupBy(*PAGE).agg(F.max_by(F.struct("g0", "g1"), F.struct(F.col("g1") - F.col("g0"), -F.col("g0"))).alias("g")).select(*PAGE, "g.g0", "g.g1")


def chapter_labels(heads: DataFrame) -> DataFrame:
    """Headings (doc_id, page, pos, text) where a bare "Chapter 3" and the heading after it on its page are one."""
    label = r"(?i)^\s*(chapter|part|cap[ií]tulo|parte|chapitre|kapitel|teil)\s+([0-9]+|[ivxlc]+)\.?\s*$"
    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    d = heads.withColumn("_bare", F.col("text").rlike(label)).withColumn("_next", F.lead(F.struct("text", "_bare")).over(w)).withColumn("_prev", F.lag("_bare").over(w))
    merged = F.col("_bare") & F.col("_next").isNotNull() & ~F.col("_next._bare")
    gone = F.coalesce(F.col("_prev") & ~F.col("_bare"), F.lit(False))
    return d.withColumn("text", F.when(merged, F.concat(F.trim("text"), F.lit(": "), F.col("_next.text"))).otherwise(F.col("text"))).where(~gone).drop("_bare", "_next", "_prev")


def vertical_spans(cells: DataFrame, table: list[str]) -> DataFrame:
    """Cells (row, col, merge: restart, continue or null) that begin something, with ``rows``: how many rows they cover."""
    w = Window.partitionBy(*table, "col").orderBy("row")
    d = cells.withColumn("_new", F.coalesce(F.col("merge") != "continue", F.lit(True)).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("rows", F.count("*").over(Window.partitionBy(*table, "col", "_run"))).where("_new = 1").drop("_new", "_run")
