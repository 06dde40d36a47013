"""Lines, headings and numbered items of documents: sizes, pitch, contents pages, outlines, counters, notes, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import sheet, text


def line_sizes(fragments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``size`` of each line: the half point that most characters have; of equals the one that comes first."""
    half = F.floor(F.col("size") * 2 + 0.5) / 2
    sums = fragments.groupBy(*keys, half.alias("size")).agg(F.sum(F.length(F.trim("text"))).alias("n"), F.min(order).alias("at"))
    return sums.groupBy(*keys).agg(F.max_by("size", F.struct("n", -F.col("at"))).alias("size"))


def line_pitch(lines: DataFrame, doc: list[str], body: str = "body") -> DataFrame:
    """``pitch`` of each document: the median of the small steps between lines of body size, in body sizes; 1.25 without any.

    ``lines`` has page, line, y, size, side (its column) and ``body``.  Small is a step less than 0.25 above the median of all."""
    w = Window.partitionBy(*doc, "page").orderBy("line")
    b = F.col(body)
    d = lines.withColumn("_p", F.lag(F.struct("y", "size", "side")).over(w)).withColumn("_dy", F.col("_p.y") - F.col("y"))
    near = (F.abs(F.col("size") - b) <= 0.6) & (F.abs(F.col("_p.size") - b) <= 0.6) & (F.col("_p.side") == F.col("side"))
    steps = d.where(near & (F.col("_dy") > b * 0.9) & (F.col("_dy") < b * 2.2)).select(*doc, (F.col("_dy") / b).alias("step"))
    middle = steps.groupBy(*doc).agg(F.median("step").alias("_m"))
    small = steps.join(middle, doc).where(F.col("step") < F.col("_m") + 0.25).groupBy(*doc).agg(F.median("step").alias("pitch"))
    return lines.select(*doc).distinct().join(small, doc, "left").withColumn("pitch", F.coalesce("pitch", F.lit(1.25)))


def contents_pages(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of which five lines at least, and 40 percent, end in a page number; with ``entries`` and ``lines``."""
    n = lines.groupBy(*keys).agg(F.sum(text.ends_in_page(F.col("text")).cast("long")).alias("entries"), F.count("*").alias("lines"))
    return n.where((F.col("entries") >= 5) & (F.col("entries") * 10 >= F.col("lines") * 4))


def main_entries(outline: DataFrame, doc: list[str], near: float = 6.0) -> DataFrame:
    """Outline entries (page, y, level, title) that begin chapters: those of level 0 if there are two, else of 0 and 1; none
    if these aren't two.  From top to bottom (no y: first), an entry within ``near`` of the last one kept goes, as does
    one beside an entry without y.  A page's entries are folded as one array."""
    n = outline.groupBy(*doc).agg(F.sum((F.col("level") == 0).cast("int")).alias("_0"), F.sum((F.col("level") <= 1).cast("int")).alias("_1"))
    top = F.when(F.col("_0") >= 2, 0).when(F.col("_1") >= 2, 1)
    d = outline.join(n, doc).where(F.col("level") <= top)
    entry = F.struct((-F.coalesce("y", F.lit(1e9))).alias("o"), "level", "title", "y")
    page = d.groupBy(*doc, "page").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    none = F.slice(F.col("_e"), 1, 0)
    again = lambda a, e: (F.size(a) > 0) & F.coalesce(F.abs(F.try_element_at(a, F.lit(-1))["y"] - e["y"]) < near, F.lit(True))
    kept = F.aggregate("_e", none, lambda a, e: F.when(again(a, e), a).otherwise(F.concat(a, F.array(e))))
    return page.select(*doc, "page", F.explode(kept).alias("e")).select(*doc, "page", "e.y", "e.level", "e.title")


def with_outline(headings: DataFrame, outline: DataFrame, doc: list[str]) -> DataFrame:
    """Adds ``entry``: the first outline entry (title, entry) of the document with the heading's title, case, accents and
    signs aside; null without one, and for headings without letters and digits."""
    o = outline.select(*doc, text.fold_key(F.col("title")).alias("_k"), "entry").where("_k <> ''").groupBy(*doc, "_k").agg(F.min("entry").alias("entry"))
    return headings.withColumn("_k", text.fold_key(F.col("title"))).join(o, [*doc, "_k"], "left").drop("_k")


def slide_counters(items: DataFrame, keys: list[str], order: str, levels: int = 9) -> DataFrame:
    """``number`` of each item (level, bullet: number, char or none; start, text): a level counts on until an item of a lower
    one, or one of its own without a number, comes; items without text neither count nor, with a number or sign, set back.
    Null for what has no number."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kind, full = F.coalesce("bullet", F.lit("none")), F.coalesce(F.trim("text"), F.lit("")) != ""
    ends = (kind == "none") | ((kind == "char") & full)
    runs = [F.sum(((F.col("level") < n) | ((F.col("level") == n) & ends)).cast("int")).over(w) for n in range(levels)]
    d = items.withColumn("_run", F.get(F.array(*runs), F.col("level"))).withColumn("_counts", (kind == "number") & full)
    own = Window.partitionBy(*keys, "level", "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("_counts"), F.coalesce("start", F.lit(1))), ignorenulls=True).over(own)
    n = first - 1 + F.sum(F.col("_counts").cast("int")).over(own)
    return d.withColumn("number", F.when(F.col("_counts"), n).cast("long")).drop("_run", "_counts")


def note_numbers(references: DataFrame, notes: DataFrame, doc: list[str], order: str) -> DataFrame:
    """``number`` of each reference (note) in the order of use, every use anew; references to notes that aren't there go."""
    w = Window.partitionBy(*doc).orderBy(order)
    known = references.join(notes.select(*doc, "note").distinct(), [*doc, "note"], "left_semi")
    return known.withColumn("number", F.row_number().over(w).cast("long"))


def clipped(cells: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, col) within the print area (area: ``A1:C10``) of their sheet; sheets without one stay whole."""
    corner = lambda i: F.get(F.split(F.replace(F.upper("area"), F.lit("$"), F.lit("")), ":"), F.lit(i))
    col = lambda c: sheet.column_number(F.regexp_extract(c, "^[A-Z]+", 0))
    row = lambda c: F.regexp_extract(c, "[0-9]+$", 0).cast("long")
    second = F.coalesce(corner(1), corner(0))
    a = areas.select(*keys, col(corner(0)).alias("_c1"), row(corner(0)).alias("_r1"), col(second).alias("_c2"), row(second).alias("_r2"))
    inside = F.col("row").between(F.col("_r1"), F.col("_r2")) & F.col("col").between(F.col("_c1"), F.col("_c2"))
    return cells.join(a, keys, "left").where(F.col("_c1").isNull() | inside).select(*cells.columns)


def referenced(references: DataFrame, cells: DataFrame, book: list[str]) -> DataFrame:
    """Adds ``value`` of references (sheet, row, col) to other sheets, names of sheets without case: null for an empty cell,
    ``#REF!`` for a sheet that isn't there.  ``cells`` has sheet, row, col and value."""
    names = cells.select(*book, F.lower("sheet").alias("_s")).distinct().withColumn("_there", F.lit(True))
    at = cells.select(*book, F.lower("sheet").alias("_s"), "row", "col", F.col("value").cast("string").alias("value"))
    d = references.withColumn("_s", F.lower("sheet")).join(names, [*book, "_s"], "left").join(at, [*book, "_s", "row", "col"], "left")
    return d.withColumn("value", F.when(F.col("_there").isNull(), "#REF!").otherwise(F.col("value"))).drop("_s", "_there")


def heading_levels(headings: DataFrame, doc: list[str], near: float = 0.75) -> DataFrame:
    """``level`` 1 to 3 of headings (at: their order; page, size, large, text, and pages, how many the document has).

    Sizes of large headings less than ``near`` apart are one group, that of the first of them; groups rank by size.  Of 20
    pages or more, a group of one or two headings in the first tenth is the cover's: it takes no rank unless all are
    such, and the level of the next smaller group, never 1.  Headings of body size come below all ranks, but chapters
    are level 1 where there are none.  Only a document's distinct sizes are folded."""
    sizes = headings.where("large").groupBy(*doc, "size").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.max("page").alias("last"), F.max("pages").alias("pages"))
    kind = "array<struct<size:double,n:bigint,last:bigint,pages:bigint>>"
    seen = F.sort_array(F.collect_list(F.struct("at", F.col("size").cast("double").alias("size"), "n", F.col("last").cast("bigint").alias("last"), F.col("pages").cast("bigint").alias("pages"))))

    def put(groups, s):
        new = F.struct(s["size"], s["n"], s["last"], s["pages"])
        place = F.array_position(F.transform(groups, lambda g: F.abs(g["size"] - s["size"]) < near), True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == place, F.struct(g["size"].alias("size"), (g["n"] + s["n"]).alias("n"), F.greatest(g["last"], s["last"]).alias("last"), g["pages"].alias("pages"))).otherwise(g))
        return F.when(place > 0, joined).otherwise(F.concat(groups, F.array(new).cast(kind)))

    cover = lambda g: (g["pages"] >= 20) & (g["n"] <= 2) & (g["last"] < g["pages"] * 0.1)
    groups = sizes.groupBy(*doc).agg(seen.alias("_s")).select(*doc, F.aggregate("_s", F.array().cast(kind), put).alias("_g"))
    real = F.filter("_g", lambda g: ~cover(g))
    ranks = groups.select(*doc, F.sort_array(F.transform(F.when(F.size(real) > 0, real).otherwise(F.col("_g")), lambda g: g["size"]), asc=False).alias("_r"))
    d = headings.join(ranks, doc, "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<double>")))
    place = F.array_position(F.transform("_r", lambda x: F.abs(x - F.col("size")) < near), True)
    above = F.size(F.filter("_r", lambda x: x > F.col("size")))
    large = F.when(place > 0, place).otherwise(F.greatest(F.lit(2), above + 1))
    plain = F.when(text.chapter_word(F.col("text")) & (F.size("_r") == 0), 1).otherwise(F.size("_r") + 1)
    return d.withColumn("level", F.least(F.lit(3), F.when(F.col("large"), large).otherwise(plain)).cast("int")).drop("_r")


def chapter_starts(documents: DataFrame, outline: DataFrame, headings: DataFrame, doc: list[str], every: int = 15) -> DataFrame:
    """Where chapters begin: strategy, page, y, title.

    From the outline (``main_entries``) if two entries are left; else the headings of the first level of which there are
    two at least and a third of the pages (four) at most; else every so many pages.  ``documents`` has pages, from 0 on."""
    entries = main_entries(outline, doc)
    two = entries.groupBy(*doc).agg(F.count("*").alias("_n")).where("_n >= 2").select(*doc)
    h = headings.groupBy(*doc, "level").agg(F.count("*").alias("_n")).join(documents.select(*doc, "pages"), doc)
    fits = h.where((F.col("_n") >= 2) & (F.col("_n") <= F.greatest(F.lit(4), F.ceil(F.col("pages") / 3)))).groupBy(*doc).agg(F.min("level").alias("level"))
    fits = fits.join(two, doc, "left_anti")
    rest = documents.join(two, doc, "left_anti").join(fits, doc, "left_anti").where("pages > 0")
    row = lambda df, strategy, y, title: df.select(*doc, F.lit(strategy).alias("strategy"), F.col("page").cast("long").alias("page"), y.cast("double").alias("y"), title.cast("string").alias("title"))
    pages = rest.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages").cast("long") - 1, F.lit(every).cast("long"))))
    a = row(entries.join(two, doc, "left_semi"), "outline", F.col("y"), F.col("title"))
    b = row(headings.join(fits, [*doc, "level"], "left_semi"), "headings", F.col("y"), F.col("title"))
    return a.unionByName(b).unionByName(row(pages, "pages", F.lit(None), F.lit(None)))
