"""Delimited text: the delimiter from the first line, the encoding by trying, ragged rows kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Windows-1252 is ISO-8859-1 but for these bytes
_CP1252 = tuple(zip(*[(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]))
_CP1252 = ("".join(_CP1252[0]), "".join(_CP1252[1]))


def delimiter(first_line: Column) -> Column:
    """``;`` if it outnumbers ``,`` and tabs don't outnumber it, else a tab if there are more of them than commas."""
    n = lambda c: F.length(first_line) - F.length(F.replace(first_line, F.lit(c), F.lit("")))
    semi, comma, tab = n(";"), n(","), n("\t")
    return F.when((semi > comma) & (semi >= tab), ";").when(tab > comma, "\t").otherwise(",")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Windows-1252; a byte-order mark is dropped."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), *_CP1252))
    return F.regexp_replace(text, "^﻿", "")


def records(text: Column, sep: Column) -> Column:
    """Array of arrays of cells: quotes open at the start of a cell, ``""`` is a quote, any line end counts."""
    one = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", "")
    quoted = F.when(sep == ";", ";").when(sep == "\t", "\\t").otherwise(",")
    cell = F.concat(F.lit('(?:^|(?<=[\n'), quoted, F.lit(']))("(?:[^"]|"")*"|[^\n'), quoted, F.lit("]*)(\\z|[\n"), quoted, F.lit("])"))
    cells, ends = F.regexp_extract_all(one, cell, F.lit(1)), F.regexp_extract_all(one, cell, F.lit(2))
    stops = F.filter(F.transform(ends, lambda e, i: F.when((e == "\n") | (e == ""), i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.transform(stops, lambda i: i + 1))
    value = lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(stops, lambda stop, i: F.transform(F.slice(cells, F.get(starts, i) + 1, stop - F.get(starts, i) + 1), value))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """path, row_no, cells of every file; rows whose cells are all blank are left out."""
    d = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))
    d = d.withColumn("sep", delimiter(F.substring_index("text", "\n", 1)))
    d = d.select("path", F.posexplode(records(F.col("text"), F.col("sep"))).alias("row_no", "cells"))
    return d.where(F.exists("cells", lambda c: F.trim(c) != ""))


def column_profile(rows: DataFrame, first: int = 200, page: int = 90) -> DataFrame:
    """path, col, width (longest of the ``first`` rows, 4 to 60) and wide: whether the file's widths together exceed ``page``.

    A file has few columns, so a window over them is small."""
    d = rows.where(F.col("row_no") < first).select("path", F.posexplode("cells").alias("col", "cell"))
    d = d.groupBy("path", "col").agg(F.least(F.lit(60), F.greatest(F.lit(4), F.max(F.length("cell")))).alias("width"))
    return d.withColumn("wide", F.sum("width").over(Window.partitionBy("path")) > page)
