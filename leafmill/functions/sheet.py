"""Spreadsheet functions as columns: null counts as 0 or as empty text, errors are null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Text to number, a decimal comma included; null for anything else."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("."))).try_cast("double"))


def _scaled(x: Column, digits: int, f) -> Column:
    power = F.lit(float(10**digits) if digits >= 0 else 1.0)
    back = F.lit(1.0 if digits >= 0 else float(10**-digits))
    return F.signum(x) * f(F.abs(x) * power / back).cast("double") / power * back


def round_half_away(x: Column, digits: int) -> Column:
    return _scaled(x, digits, lambda v: F.floor(v + 0.5 + 1e-12))


def round_up(x: Column, digits: int) -> Column:
    """Away from zero."""
    return _scaled(x, digits, lambda v: F.ceil(v - 1e-12))


def round_down(x: Column, digits: int) -> Column:
    """Toward zero."""
    return _scaled(x, digits, lambda v: F.floor(v + 1e-12))


def mod(x: Column, y: Column) -> Column:
    """With the sign of the divisor; null for 0."""
    return F.when(y != 0, x - y * F.floor(x / F.nullif(y, F.lit(0.0))))


def divide(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def square_root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(F.abs(x)))


def left(s: Column, n: int = 1) -> Column:
    return F.substring(F.coalesce(s, F.lit("")), 1, max(n, 0))


def right(s: Column, n: int = 1) -> Column:
    return F.right(F.coalesce(s, F.lit("")), F.lit(max(n, 0)))


def middle(s: Column, start: int, n: int) -> Column:
    return F.substring(F.coalesce(s, F.lit("")), max(start, 1), max(n, 0))


def trim_inside(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))


def concat(*xs: Column) -> Column:
    return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])


def column_number(letters: Column) -> Column:
    """A to 1, Z to 26, AA to 27; no letters give 0."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)


def column_letters(n: Column) -> Column:
    """1 to A, 27 to AA; up to six letters."""
    step = lambda a: F.struct(F.floor((a.rest - 1) / 26).cast("long").alias("rest"), F.concat(F.char(F.pmod(a.rest - 1, F.lit(26)) + 65), a.text).alias("text"))
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, lambda a, _: F.when(a.rest > 0, step(a)).otherwise(a)).text


def cell_range(ref: Column) -> Column:
    """Sheet, row_a, col_a, row_b, col_b (from 1, a before b) of a reference such as ``'My sheet'!$B$2:$B$9``.

    A quote in a quoted name is written twice.  Null without a sheet, or where the rest isn't a cell or two corners."""
    whole = F.trim(ref)
    cut = F.length(whole) - F.instr(F.reverse(whole), "!")  # what stands before the last mark
    name = F.left(whole, cut)
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    sheet = F.when(name.startswith("'") & name.endswith("'") & (F.length(name) > 2), F.replace(inner, F.lit("''"), F.lit("'"))).when(~name.contains("'") & (name != ""), name)
    corners = F.split(F.replace(F.substring(whole, cut + 2, F.length(whole)), F.lit("$"), F.lit("")), ":")
    fits = whole.contains("!") & sheet.isNotNull() & (F.size(corners) <= 2) & F.forall(corners, lambda c: c.rlike(r"\A[A-Za-z]{1,3}[0-9]{1,7}\z"))
    cols = F.transform(corners, lambda c: column_number(F.regexp_extract(c, "[A-Za-z]+", 0)))
    rows = F.transform(corners, lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long"))
    return F.when(fits, F.struct(sheet.alias("sheet"), F.array_min(rows).alias("row_a"), F.array_min(cols).alias("col_a"), F.array_max(rows).alias("row_b"), F.array_max(cols).alias("col_b")))


#: Types whose cells are numbers.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def criterion(c: str | float, x: Column) -> Column:
    """``>=10``, ``<>a``, ``ab*``, ``?x``: numbers compare with numbers alone, text (and anything else with text)
    without case and with wildcards; an order on text never holds.  An empty cell is an empty text."""
    c = str(c)
    for op in ("<=", ">=", "<>", "<", ">", "="):
        if c.startswith(op):
            break
    else:
        op = ""
    value = c[len(op) :]
    kind = F.typeof(x)
    number = kind.isin(*_NUMBERS) | kind.startswith("decimal")  # known when the plan is made
    shown = F.regexp_replace(F.coalesce(F.lower(x.cast("string")), F.lit("")), r"\.0$", "")
    shown = F.when(number, shown).otherwise(F.coalesce(F.lower(x.cast("string")), F.lit("")))
    if "*" in value or "?" in value:
        pattern = "".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if not ch.isalnum() and ch != " " and ord(ch) < 128 else ch) for ch in value.lower())
        same = shown.rlike(f"^{pattern}$")
    else:
        same = shown == value.lower()
    as_text = ~same if op == "<>" else same if op in ("", "=") else F.lit(False)
    if not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*", value, re.I):
        return as_text
    limit, n = float(value), x.try_cast("double")
    compare = {"<=": n <= limit, ">=": n >= limit, "<": n < limit, ">": n > limit, "<>": n != limit, "=": n == limit, "": n == limit}[op]
    return F.when(number & n.isNotNull(), compare).otherwise(as_text)


def sum_if(test: Column, target: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.coalesce(target.try_cast("double"), F.lit(0.0)))), F.lit(0.0))


def count_if(test: Column) -> Column:
    return F.count_if(test)


def average_if(test: Column, target: Column) -> Column:
    """Over the matches, non-numeric targets included as 0; null without a match."""
    return F.try_divide(sum_if(test, target), F.count_if(test).cast("double"))
