"""Runs of word documents: which tokens are text once fields are resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def with_fields(tokens: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``depth`` (open fields) and ``shown``: whether a token lies in no field's code, only in results.

    ``kind`` is begin, separate or end for the marks of fields, which nest; anything else is content.  The automaton's
    stack is kept as counts: a mark's level says which field it belongs to.  An end without a begin is
    ignored, as is a separate outside a field or a second one in it; a field that never ends has its effect to the end."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("kind")
    d = tokens.withColumn("_s", F.sum(F.when(k == "begin", 1).when(k == "end", -1).otherwise(0)).over(w))
    # reflected at zero: ends beyond the begins don't count
    d = d.withColumn("_low", F.least(F.lit(0), F.min("_s").over(w))).withColumn("depth", (F.col("_s") - F.col("_low")).cast("int"))
    before = Window.partitionBy(*keys).orderBy(order)
    d = d.withColumn("_was", F.coalesce(F.lag("depth").over(before), F.lit(0)))
    level = F.when(k == "begin", F.col("depth")).when((k == "separate") | ((k == "end") & (F.col("_was") > F.col("depth"))), F.col("_was"))
    d = d.withColumn("_level", F.when(level > 0, level))
    own = Window.partitionBy(*keys, "_level").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_field", F.when(F.col("_level").isNotNull(), F.sum((k == "begin").cast("int")).over(own)))
    field = Window.partitionBy(*keys, "_level", "_field").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    split = F.sum((k == "separate").cast("int")).over(field)
    closes = F.col("_level").isNotNull() & (((k == "separate") & (split == 1)) | ((k == "end") & (split == 0)))
    d = d.withColumn("_code", F.when(F.col("_level").isNotNull() & (k == "begin"), 1).when(closes, -1).otherwise(0))
    code = F.sum("_code").over(w)
    return d.withColumn("shown", (code == 0) & ~k.isin("begin", "separate", "end")).drop("_s", "_low", "_was", "_level", "_field", "_code")


def paragraph_texts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, par_no, text, notes from tokens (seq, par_no, kind, text): text, tabs and breaks as read, results of fields
    only, nothing hidden or deleted; ``notes`` are the ids of foot- and endnotes in order.  Fields may reach over paragraphs;
    a paragraph without content has empty text."""
    d = with_fields(tokens, keys, "seq")
    piece = F.when(F.col("kind") == "text", F.col("text")).when(F.col("kind") == "tab", "\t").when(F.col("kind") == "break", "\n")
    shown = F.col("shown") & piece.isNotNull()
    ordered = lambda c, v: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("seq", v.alias("v"))))), lambda x: x.v)
    note = F.col("shown") & (F.col("kind") == "note")
    return d.groupBy(*keys, "par_no").agg(F.array_join(ordered(shown, piece), "").alias("text"), ordered(note, F.col("text")).alias("notes"))
