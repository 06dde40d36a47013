"""Cells of workbooks with what is kept apart from them: shared formulas and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import formula as _formula

#: The formats that a workbook may name without giving them.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "dd/mm/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "dd/mm/yyyy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* (#,##0);_("$"* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_);_("$"* (#,##0.00);_("$"* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}


def with_shared_formulas(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """Cells (row, col, formula, shared: number of a group or null) whose dependents have their master's formula, moved.

    The master is the group's first cell with a formula of its own, by row and column; a dependent without a master keeps
    none.  Masters are a table joined to dependents by sheet and group, so a long group is split like any join."""
    own = F.coalesce(F.length("formula") > 1, F.lit(False))
    first = F.min(F.struct("row", "col", "formula")).alias("_m")
    masters = cells.where(F.col("shared").isNotNull() & own).groupBy(*sheet, "shared").agg(first)
    d = cells.join(masters, [*sheet, "shared"], "left")
    moved = _formula.shifted_column(F.col("_m.formula"), F.col("row") - F.col("_m.row"), F.col("col") - F.col("_m.col"))
    formula = F.when(F.col("shared").isNull() | own, F.col("formula")).otherwise(moved)
    return d.select(*[formula.alias(c) if c == "formula" else F.col(c) for c in cells.columns])


def styled(cells: DataFrame, styles: DataFrame, book: list[str]) -> DataFrame:
    """Cells (style) with ``look``: format, font (name, size, bold, italic, underline, strike, color), fill, borders,
    horizontal and vertical, found along the chain of a workbook's tables.

    ``styles`` is ``office.workbook_styles``: rows of (part, idx) with their fields.  Each step has its default: a style or format
    that isn't there is General, a font the first one or 11 points plain, a fill none, borders none, alignment general and bottom."""
    table = lambda kind, *cols: styles.where(F.col("part") == kind).select(*book, F.col("idx").alias(f"_{kind}"), *[F.col(c).alias(f"_{kind}_{c}") for c in cols])
    xf = table("xf", "format_id", "font_id", "fill_id", "border_id", "horizontal", "vertical", "wrap", "indent").withColumnRenamed("_xf", "style")
    code, font, fill, border = table("format", "code"), table("font", "font"), table("fill", "color"), table("border", "borders")
    first = font.where("_font = 0").select(*book, F.col("_font_font").alias("_first"))
    d = cells.join(xf, [*book, "style"], "left")
    for t, key, to in ((code, "_format", "_xf_format_id"), (font, "_font", "_xf_font_id"), (fill, "_fill", "_xf_fill_id"), (border, "_border", "_xf_border_id")):
        d = d.join(t.withColumnRenamed(key, to), [*book, to], "left")
    d = d.join(first, book, "left")
    given = F.map_from_arrays(F.array(*map(F.lit, BUILT_IN)), F.array(*map(F.lit, BUILT_IN.values())))
    plain = F.struct(F.lit(None).cast("string").alias("name"), F.lit(11.0).alias("size"), *[F.lit(False).alias(c) for c in ("bold", "italic", "underline", "strike")], F.lit(None).cast("string").alias("color"))
    look = F.struct(
        F.coalesce("_format_code", F.try_element_at(given, F.coalesce("_xf_format_id", F.lit(0))), F.lit("General")).alias("format"), F.coalesce("_font_font", "_first", plain).alias("font"), F.col("_fill_color").alias("fill"),
        F.coalesce("_border_borders", F.array().cast("array<string>")).alias("borders"), F.coalesce("_xf_horizontal", F.lit("general")).alias("horizontal"), F.coalesce("_xf_vertical", F.lit("bottom")).alias("vertical"), F.coalesce("_xf_wrap", F.lit(False)).alias("wrap"), F.coalesce("_xf_indent", F.lit(0)).alias("indent"),
    )
    return d.select(*cells.columns, look.alias("look"))


def with_overflow(cells: DataFrame, columns: DataFrame, covered: DataFrame, sheet: list[str]) -> DataFrame:
    """Cells (row, col, text, is_text, size, wrap, horizontal, merged) with ``span``: over how many columns their text runs.

    Text that is set general or left, unwrapped and unmerged, needs 0.62 of its size per character, in pixels, and takes
    columns to its right until it has room, but stops before the next cell that is filled, merged or ``covered`` (row, col) by a
    merged one, and at the last of ``columns`` (col, width).  A sheet's columns go along as one array.  Empty cells span one."""
    wide = columns.groupBy(*sheet).agg(F.sort_array(F.collect_list(F.struct("col", "width"))).alias("_cols"))
    stops = cells.where((F.coalesce("text", F.lit("")) != "") | F.col("merged")).select(*sheet, "row", "col").unionByName(covered.select(*sheet, "row", "col")).distinct()
    stops = stops.withColumn("_next", F.lead("col").over(Window.partitionBy(*sheet, "row").orderBy("col")))
    d = cells.join(stops, [*sheet, "row", "col"], "left").join(wide, sheet, "left")
    runs_on = F.col("is_text") & (F.coalesce("text", F.lit("")) != "") & ~F.col("wrap") & ~F.col("merged") & F.col("horizontal").isin("general", "left")
    needed = F.length("text") * F.col("size") * 0.62 * (96 / 72) + 6
    free = F.filter("_cols", lambda c: (c["col"] >= F.col("col")) & (F.col("_next").isNull() | (c["col"] < F.col("_next"))))
    start = F.struct(F.lit(0.0).alias("room"), F.lit(0).alias("n"))
    taken = F.aggregate(free, start, lambda a, c: F.when((a["n"] > 0) & (a["room"] >= needed), a).otherwise(F.struct((a["room"] + c["width"]).alias("room"), (a["n"] + 1).alias("n"))))["n"]
    return d.select(*[d[c] for c in cells.columns], F.when(F.coalesce(runs_on, F.lit(False)), F.greatest(F.coalesce(taken, F.lit(1)), F.lit(1))).otherwise(1).alias("span"))
