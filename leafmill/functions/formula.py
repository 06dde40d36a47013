"""Spreadsheet formulas as columns.

``column("=ROUND(price*(1-discount),2)", df)`` gives one column expression, so a formula costs what the same
expression written by hand does.  Names are columns of the frame, blanks count as 0 or as empty text by the
type of the column, and an error is null from there on (IFERROR looks at that).  The power binds to the left
and the sign before it; ``%`` follows a value; arguments are parted by ``,`` or ``;``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import sheet

# The function names of the two languages that sheets come in.
ALIASES = {
    "SUMA": "SUM", "PRODUCTO": "PRODUCT", "PROMEDIO": "AVERAGE", "MEDIANA": "MEDIAN", "CONTAR": "COUNT", "CONTARA": "COUNTA",
    "REDONDEAR": "ROUND", "REDONDEAR.MAS": "ROUNDUP", "REDONDEAR.MENOS": "ROUNDDOWN", "RAIZ": "SQRT", "ENTERO": "INT", "RESIDUO": "MOD", "POTENCIA": "POWER",
    "SI": "IF", "SI.ERROR": "IFERROR", "Y": "AND", "O": "OR", "NO": "NOT", "CONCATENAR": "CONCAT", "CONCATENATE": "CONCAT", "LARGO": "LEN", "MAYUSC": "UPPER", "MINUSC": "LOWER",
    "ESPACIOS": "TRIM", "IZQUIERDA": "LEFT", "DERECHA": "RIGHT", "EXTRAE": "MID",
}
_TOKEN = re.compile(r'\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|("(?:[^"]|"")*")|(\[[^\]]+\]|[A-Za-z_][A-Za-z0-9_.]*)|(<=|>=|<>|[-+*/^&=<>()%,;])|$)')


class Typed:
    """A column and whether it is a number (n), text (s) or truth value (b); ``value`` if written as a number."""

    def __init__(self, c: Column, kind: str, value: float | None = None):
        self.c, self.kind, self.value = c, kind, value

    def number(self) -> Column:
        return {"n": lambda: self.c, "s": lambda: sheet.number(self.c), "b": lambda: self.c.cast("double")}[self.kind]()

    def text(self) -> Column:
        if self.kind == "n":  # whole numbers without a point, others with fifteen significant digits
            whole = (F.floor(self.c) == self.c) & (F.abs(self.c) < 1e15)
            return F.when(whole, self.c.cast("long").cast("string")).otherwise(F.format_string("%.14E", self.c.cast("double")).cast("double").cast("string"))
        return self.c if self.kind == "s" else F.upper(self.c.cast("string"))

    def truth(self) -> Column:
        if self.kind == "s":
            return F.when(F.upper(self.c).isin("TRUE", "VERDADERO"), True).when(F.upper(self.c).isin("FALSE", "FALSO"), False)
        return self.c if self.kind == "b" else self.c != 0


class _Parser:
    def __init__(self, formula: str, names: dict[str, Typed]):
        self.names, self.tokens, at = names, [], 0
        body = formula[1:] if formula.startswith("=") else formula
        while at < len(body.rstrip()):
            m = _TOKEN.match(body, at)
            if not m or m.end() == at:
                raise ValueError(f"not a formula: {formula!r} at {at}")
            at = m.end()
            self.tokens.append(next(((k, v) for k, v in zip("nsw.", m.groups()) if v is not None), None))
        self.tokens = [t for t in self.tokens if t]

    def peek(self) -> str:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] == "." else ""

    def take(self, *ops: str) -> str:
        return self.tokens.pop(0)[1] if self.peek() in ops and self.peek() else ""

    def expect(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"{op} expected")

    def left(self, ops: tuple[str, ...], inner, combine) -> Typed:
        x = inner()
        while op := self.take(*ops):
            x = combine(op, x, inner())
        return x

    def comparison(self) -> Typed:
        return self.left(("=", "<>", "<", ">", "<=", ">="), self.joined, compared)

    def joined(self) -> Typed:
        return self.left(("&",), self.sum, lambda _, a, b: Typed(F.concat(a.text(), b.text()), "s"))

    def sum(self) -> Typed:
        return self.left(("+", "-"), self.product, lambda op, a, b: Typed(a.number() + b.number() if op == "+" else a.number() - b.number(), "n"))

    def product(self) -> Typed:
        return self.left(("*", "/"), self.power, lambda op, a, b: Typed(a.number() * b.number() if op == "*" else sheet.divide(a.number(), b.number()), "n"))

    def power(self) -> Typed:
        return self.left(("^",), self.signed, lambda _, a, b: Typed(F.pow(a.number(), b.number()), "n"))

    def signed(self) -> Typed:
        if op := self.take("+", "-"):
            x = self.signed()
            return Typed(-x.number() if op == "-" else x.number(), "n", x.value and (-x.value if op == "-" else x.value))
        x = self.atom()
        while self.take("%"):
            x = Typed(x.number() / 100, "n")
        return x

    def atom(self) -> Typed:
        if self.take("("):
            x = self.comparison()
            self.expect(")")
            return x
        if not self.tokens or self.tokens[0][0] == ".":
            raise ValueError("a value is missing")
        kind, value = self.tokens.pop(0)
        if kind == "n":
            return Typed(F.lit(float(value)), "n", float(value))
        if kind == "s":
            return Typed(F.lit(value[1:-1].replace('""', '"')), "s")
        if self.take("("):
            args: list[Typed | None] = []
            while not self.take(")"):
                args.append(None if self.peek() in (",", ";") else self.comparison())
                if not self.take(",", ";") and self.peek() != ")":
                    raise ValueError("an argument doesn't end")
            return called(value.upper(), args)
        if value.upper() in ("TRUE", "FALSE", "VERDADERO", "FALSO"):
            return Typed(F.lit(value.upper() in ("TRUE", "VERDADERO")), "b")
        name = value.strip("[]")
        if name.lower() not in self.names:
            raise ValueError(f"#NAME? {name}")
        return self.names[name.lower()]


def compared(op: str, a: Typed, b: Typed) -> Typed:
    """Numbers come before text, text before truth values; text compares without case."""
    if a.kind != b.kind:
        ranks = "nsb"
        order = F.lit(ranks.index(a.kind)), F.lit(ranks.index(b.kind))
        x, y = (F.when(c.isNotNull(), r) for c, r in zip((a.c, b.c), order))
    else:
        x, y = (F.lower(t.c) if t.kind == "s" else t.c for t in (a, b))
    return Typed({"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "b")


def called(name: str, args: list[Typed | None]) -> Typed:
    name = ALIASES.get(name, name)
    given = [a for a in args if a is not None]
    n = lambda i: given[i].number()
    s = lambda i: given[i].text()
    k = lambda i, default=1: n(i).cast("int") if len(given) > i else F.lit(default)
    numbers = [a.number() for a in given]
    if name in ("SUM", "PRODUCT", "AVERAGE"):
        total = reduce(lambda x, y: x * y if name == "PRODUCT" else x + y, numbers, F.lit(1.0 if name == "PRODUCT" else 0.0))
        return Typed(total / len(given) if name == "AVERAGE" and given else F.lit(None).cast("double") if name == "AVERAGE" else total, "n")
    if name in ("MIN", "MAX"):
        some = F.array(*numbers) if numbers else F.array(F.lit(0.0))
        ok = F.forall(some, lambda x: x.isNotNull())
        return Typed(F.when(ok, F.array_min(some) if name == "MIN" else F.array_max(some)), "n")
    if name == "MEDIAN":
        xs, half = F.array_sort(F.array(*numbers)), len(numbers) // 2
        mid = F.get(xs, F.lit(half)) if len(numbers) % 2 else (F.get(xs, F.lit(half - 1)) + F.get(xs, F.lit(half))) / 2
        return Typed(mid if numbers else F.lit(None).cast("double"), "n")
    if name in ("COUNT", "COUNTA"):
        hit = [a.c.isNotNull() if a.kind != "s" else a.c != "" if name == "COUNTA" else F.lit(False) for a in given]
        return Typed(reduce(lambda x, y: x + y, [h.cast("int") for h in hit], F.lit(0)).cast("double"), "n")
    if name == "IF":
        test, yes = given[0].truth(), args[1] if len(args) > 1 and args[1] is not None else Typed(F.lit(0.0), "n")
        no = args[2] if len(args) > 2 and args[2] is not None else Typed(F.lit(False) if len(args) < 3 else F.lit(0.0), "b" if len(args) < 3 else "n")
        if yes.kind != no.kind:
            yes, no = Typed(yes.text(), "s"), Typed(no.text(), "s")
        return Typed(F.when(test, yes.c).when(~test, no.c), yes.kind)
    if name == "IFERROR":
        a, b = given
        return Typed(F.coalesce(a.c, b.c), a.kind) if a.kind == b.kind else Typed(F.coalesce(a.text(), b.text()), "s")
    if name in ("AND", "OR"):
        return Typed(reduce(lambda x, y: x & y if name == "AND" else x | y, [a.truth() for a in given]), "b")
    if name == "CONCAT":
        return Typed(F.concat(*[a.text() for a in given]), "s")

    def digits() -> int:
        if len(given) > 1 and given[1].value is None:
            raise ValueError("digits have to be written as a number")
        return int(given[1].value) if len(given) > 1 else 0

    one = {
        "ROUND": lambda: Typed(sheet.round_half_away(n(0), digits()), "n"),
        "ROUNDUP": lambda: Typed(sheet.round_up(n(0), digits()), "n"),
        "ROUNDDOWN": lambda: Typed(sheet.round_down(n(0), digits()), "n"),
        "ABS": lambda: Typed(F.abs(n(0)), "n"),
        "SQRT": lambda: Typed(sheet.square_root(n(0)), "n"),
        "POWER": lambda: Typed(F.pow(n(0), n(1)), "n"),
        "PI": lambda: Typed(F.pi(), "n"),
        "INT": lambda: Typed(F.floor(n(0)).cast("double"), "n"),
        "MOD": lambda: Typed(sheet.mod(n(0), n(1)), "n"),
        "NOT": lambda: Typed(~given[0].truth(), "b"),
        "LEN": lambda: Typed(F.length(s(0)).cast("double"), "n"),
        "UPPER": lambda: Typed(F.upper(s(0)), "s"),
        "LOWER": lambda: Typed(F.lower(s(0)), "s"),
        "TRIM": lambda: Typed(sheet.trim_inside(s(0)), "s"),
        "LEFT": lambda: Typed(F.substring(s(0), F.lit(1), F.greatest(k(1), F.lit(0))), "s"),
        "RIGHT": lambda: Typed(F.right(s(0), F.greatest(k(1), F.lit(0))), "s"),
        "MID": lambda: Typed(F.substring(s(0), F.greatest(k(1), F.lit(1)), F.greatest(k(2), F.lit(0))), "s"),
    }
    if name not in one:
        raise ValueError(f"#NAME? {name}")
    return one[name]()


def column(formula: str, df: DataFrame, names: dict[str, str] | None = None) -> Column:
    """The column that a formula stands for.  ``names`` maps names in formulas to columns (as A to price);
    left out, columns go by their own names.  What can't be understood is a ValueError at once."""
    kinds = dict(df.dtypes)
    known = {}
    for name, c in (names or {c: c for c in df.columns}).items():
        kind = "s" if kinds[c] == "string" else "b" if kinds[c] == "boolean" else "n"
        x = F.col(f"`{c}`")
        known[name.lower()] = Typed(F.coalesce(x, F.lit("")) if kind == "s" else x if kind == "b" else F.coalesce(x.cast("double"), F.lit(0.0)), kind)
    p = _Parser(formula, known)
    out = p.comparison()
    if p.tokens:
        raise ValueError(f"not a formula: {formula!r}")
    return out.c


def shifted(formula: str, rows: int, columns: int) -> str:
    """A shared formula moved: relative references follow, ``$`` ones, quoted text and sheet names stay."""

    def moved(m: re.Match) -> str:
        if m[1] is not None:
            return m[0]
        letters, row = m[3], int(m[5])
        number = reduce(lambda a, c: a * 26 + ord(c) - 64, letters.upper(), 0)
        number, row = number + (0 if m[2] else columns), row + (0 if m[4] else rows)
        if number < 1 or row < 1:
            return "#REF!"
        out = ""
        while number:
            number, r = divmod(number - 1, 26)
            out = chr(65 + r) + out
        return f"{m[2]}{out}{m[4]}{row}"

    return re.sub(r"""("(?:[^"]|"")*"|'[^']*'!?|[A-Za-z_][A-Za-z0-9_.]*[!(])|(?<![A-Za-z0-9_$])(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(])""", moved, formula)


#: A reference such as ``$B12``, or what must stay as it is: quoted text and names, sheets and functions.
_REFERENCE = r"""("(?:[^"]|"")*"|'[^']*'!?|[A-Za-z_][A-Za-z0-9_.]*[!(])|(?<![A-Za-z0-9_$])([$]?[A-Za-z]{1,3}[$]?[0-9]+)(?![A-Za-z0-9_(])"""


def shifted_column(formula: Column, rows: Column, columns: Column) -> Column:
    """``shifted`` as a column, with an offset of each row's own."""
    between = F.split(formula, _REFERENCE, -1)
    found = F.regexp_extract_all(formula, F.lit(_REFERENCE), F.lit(0))

    def moved(ref: Column) -> Column:
        fixed_row = F.contains(F.substr(ref, F.lit(2)), F.lit("$"))
        fixed_col = F.left(ref, F.lit(1)) == "$"
        col = sheet.column_number(F.regexp_extract(ref, "[A-Za-z]+", 0)) + F.when(fixed_col, 0).otherwise(columns)
        row = F.regexp_extract(ref, "[0-9]+$", 0).cast("long") + F.when(fixed_row, 0).otherwise(rows)
        dollar = lambda c: F.when(c, "$").otherwise("")
        out = F.concat(dollar(fixed_col), sheet.column_letters(col), dollar(fixed_row), row.cast("string"))
        return F.when(ref.rlike("^[$]?[A-Za-z]{1,3}[$]?[0-9]+$"), F.when((col < 1) | (row < 1), "#REF!").otherwise(out)).otherwise(ref)

    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(moved(F.get(found, i)), F.lit("")))), "")
