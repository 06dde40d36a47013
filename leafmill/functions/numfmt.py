"""Number and date formats as columns: one format code gives one expression."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal and thousands separator.
LOCALES = {"en": (".", ","), "es": (",", "."), "fr": (",", " "), "de": (",", ".")}
# Names of months and days.
MONTHS = {"en": "January February March April May June July August September October November December".split(), "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()}
DAYS = {"en": "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split(), "es": "domingo lunes martes miércoles jueves viernes sábado".split()}
_PARTS = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[([^\]]*)\]|(AM/PM|am/pm|A/P|General)|([yYmMdDhHsS]+)|(E[+-]0+)|([0#?.,/%@])|(.)')


def is_date_format(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]|_.|\*.', "", code.split(";")[0], flags=re.I)
    return bool(re.search("[ymdhs]", bare, re.I)) and "general" not in bare.lower()


def serial_date(serial: Column, from_1904: bool = False) -> Column:
    """Date of a day number; in the 1900 system day 60 doesn't exist and gives the first of March (its text is 29 February)."""
    day = F.floor(serial).cast("int")
    if from_1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), day)
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(day < 60, day + 1).when(day == 60, F.lit(61)).otherwise(day))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def general(v: Column, locale: str = "en") -> Column:
    """Eleven significant digits, trailing zeros off; ten decimals below 1e-6; an exponent outside 1e-9 to 1e11."""
    a = F.abs(v)
    usual = F.when((a >= 1e-6) & (a < 1e11), v).otherwise(0.0)
    digits = F.format_string("%.20f", F.format_string("%.10E", usual.cast("double")).cast("double"))
    plain = F.regexp_replace(F.when(a < 1e-6, F.format_string("%.10f", v.cast("double"))).otherwise(digits), r"\.?0+$", "")
    exp = F.regexp_replace(F.regexp_replace(F.format_string("%.5E", v.cast("double")), r"\.?0+E", "E"), r"E([+-])(\d)$", "E$10$2")
    return F.replace(F.when(v == 0, "0").when((a >= 1e11) | (a < 1e-9), exp).otherwise(plain), F.lit("."), F.lit(LOCALES[locale][0]))


_FRACTION = re.compile(r"([#0?]*)(\s*)([#0?]+)/([#0?]+|\d+)")


def _fraction(v: Column, section: str) -> Column:
    """``# ?/?``: whole part and the nearest fraction with a denominator of so many digits, or with the one given."""
    m = _FRACTION.search(section)
    x, whole = F.abs(v), F.floor(F.abs(v))
    rest = x - whole
    near = lambda d: F.floor(rest * d + 0.5)
    if m[4].isdigit() and m[4].strip("0"):
        best = F.struct(near(F.lit(int(m[4]))).alias("n"), F.lit(int(m[4])).cast("long").alias("d"))
    else:
        start = F.struct(near(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("d"), F.abs(rest - near(F.lit(1))).alias("err"))
        tried = F.sequence(F.lit(2).cast("long"), F.lit(10 ** len(m[4]) - 1).cast("long"))
        off = lambda d: F.abs(rest - near(d) / d)
        best = F.aggregate(tried, start, lambda s, d: F.when(off(d) < s.err - 1e-12, F.struct(near(d).alias("n"), d.alias("d"), off(d).alias("err"))).otherwise(s))

    def text(f: Column) -> Column:
        both = F.concat(f.n.cast("string"), F.lit("/"), f.d.cast("string"))
        if not m[1] and not m[2]:
            return F.concat(F.floor(x * f.d + 0.5).cast("string"), F.lit("/"), f.d.cast("string"))
        return F.when(f.n == 0, whole.cast("string")).when(whole == 0, both).otherwise(F.concat(whole.cast("string"), F.lit(" "), both))

    bare = lambda t: t.replace('"', "")
    return F.concat(F.lit(bare(section[: m.start()])), let(best, text), F.lit(bare(section[m.end() :])))


def _fixed(v: Column, section: str, locale: str) -> Column:
    """A section of digits: ``#,##0.00 "kg"``, percent, thousands scaling, an exponent."""
    point, comma = LOCALES[locale]
    tokens = [m for m in _PARTS.finditer(section)]
    marks = [(i, m[7]) for i, m in enumerate(tokens) if m[7] and m[7] in "0#?.,"]
    text = lambda m: m[1] if m[1] is not None else m[2] if m[2] is not None else "" if m[0][0] in "_*[" else m[0]
    if not marks:
        return F.lit("".join(text(m) for m in tokens))
    if "/" in section and not any(m[6] for m in tokens) and _FRACTION.search(re.sub(r'"[^"]*"', "", section)):
        return _fraction(v, section)
    first, last = marks[0][0], marks[-1][0]
    body = "".join(m for _, m in marks)
    whole, _, part = body.partition(".")
    scale = 3 * (len(body) - len(body.rstrip(",")))
    whole, part = whole.rstrip(","), part.rstrip(",")
    grouped = "," in whole
    least_whole, least_part, most_part = whole.count("0"), part.count("0"), len(part)
    exponent = next((m[6] for m in tokens if m[6]), None)
    percent = sum(m[7] == "%" for m in tokens)
    x = F.abs(v) * float(100**percent) / float(10**scale)
    p = 10.0**most_part

    def digits(units: Column) -> Column:
        """The digits of so many units of the last place."""

        def placed(all_: Column) -> Column:
            left = F.left(all_, F.length(all_) - most_part)
            left = F.lpad(F.when(left == "0", F.lit("")).otherwise(left), F.greatest(F.length(left) - (left == "0").cast("int"), F.lit(least_whole)), F.lit("0"))
            if grouped:
                left = F.regexp_replace(left, r"(?<=\d)(?=(?:\d{3})+$)", comma)
            if not most_part:
                return left
            right = F.right(all_, F.lit(most_part))
            if most_part > least_part:
                right = F.concat(F.left(right, F.lit(least_part)), F.regexp_replace(F.substring(right, least_part + 1, most_part), "0+$", ""))
            if least_part:
                return F.concat(left, F.lit(point), right)
            return F.concat(left, F.when(right != "", F.concat(F.lit(point), right)).otherwise(""))

        return let(F.lpad(units, F.greatest(F.length(units), F.lit(most_part + 1)), F.lit("0")), placed)

    rounded = lambda y: let(F.floor(y * p + 0.5 + 1e-9 * F.least(F.lit(1.0), y)).cast("decimal(38,0)").cast("string"), digits)
    if exponent:
        e = F.when(x > 0, F.floor(F.log10(F.when(x > 0, x).otherwise(1.0)))).otherwise(0).cast("int")

        def scientific(e: Column) -> Column:
            sign = F.when(e < 0, "-").otherwise("+" if exponent[1] == "+" else "")
            shown = F.abs(e).cast("string")
            return F.concat(rounded(x / F.pow(F.lit(10.0), e)), F.lit("E"), sign, F.lpad(shown, F.greatest(F.length(shown), F.lit(len(exponent) - 2)), F.lit("0")))

        number = let(e, scientific)
    else:
        number = let(x, rounded)
    before = "".join(text(m) for m in tokens[:first] if not m[6])
    after = "".join(text(m) for m in tokens[last + 1 :] if not m[6])
    return F.concat(F.lit(before), number, F.lit(after))


def _dated(v: Column, section: str, locale: str, from_1904: bool) -> Column:
    lang = locale if locale in MONTHS else "en"
    seconds = F.floor(v * 86400 + 0.5).cast("long")
    day = serial_date(F.floor(seconds / 86400), from_1904)
    leap = F.lit(False) if from_1904 else F.floor(seconds / 86400) == 60  # the day that never was: 29 February 1900
    month, of_month = F.when(leap, 2).otherwise(F.month(day)), F.when(leap, 29).otherwise(F.dayofmonth(day))
    rest = F.pmod(seconds, F.lit(86400))
    hour, minute, second = F.floor(rest / 3600), F.pmod(F.floor(rest / 60), F.lit(60)), F.pmod(rest, F.lit(60))
    half = bool(re.search("AM/PM|A/P", section, re.I))
    tokens = list(_PARTS.finditer(section))
    runs = [(i, m[5].lower()) for i, m in enumerate(tokens) if m[5]]
    two = lambda c, n: F.lpad(c.cast("string"), F.lit(2), F.lit("0")) if n > 1 else c.cast("string")
    names = lambda table, c: F.get(F.array(*map(F.lit, table)), c)
    out = []
    for i, m in enumerate(tokens):
        if m[5]:
            t, n = m[5].lower()[0], len(m[5])
            nth = [r[0] for r in runs].index(i)
            near_hour = t == "m" and n < 3 and ((nth and runs[nth - 1][1][0] == "h") or (nth + 1 < len(runs) and runs[nth + 1][1][0] == "s") or "[h" in section[: m.start()].lower()[-4:])
            if t == "y":
                out.append(F.year(day).cast("string") if n > 2 else two(F.pmod(F.year(day), F.lit(100)), 2))
            elif near_hour:
                out.append(two(minute, n))
            elif t == "m":
                full = names(MONTHS[lang], month - 1)
                out.append(two(month, n) if n < 3 else F.left(full, F.lit(3)) if n == 3 else full if n == 4 else F.left(full, F.lit(1)))
            elif t == "d":
                full = names(DAYS[lang], F.dayofweek(day) - 1)
                out.append(two(of_month, n) if n < 3 else F.left(full, F.lit(3)) if n == 3 else full)
            elif t == "h":
                out.append(two(F.when(F.pmod(hour, F.lit(12)) == 0, 12).otherwise(F.pmod(hour, F.lit(12))) if half else hour, n))
            else:
                out.append(two(second, n))
        elif m[3] is not None and re.fullmatch("h+|m+|s+", m[3], re.I):
            out.append(F.floor(seconds / {"h": 3600, "m": 60, "s": 1}[m[3][0].lower()]).cast("string"))
        elif m[4] and "/" in m[4]:
            am, pm = m[4].split("/")
            out.append(F.when(hour < 12, am).otherwise(pm))
        elif m[0][0] not in "_*[":
            out.append(F.lit(m[1] if m[1] is not None else m[2] if m[2] is not None else m[0]))
    return F.concat(*out)


_CONDITION = re.compile(r"\[([<>=]+)\s*(-?[\d.]+)\]")


def formatted(v: Column, code: str, locale: str = "en", from_1904: bool = False) -> Column:
    """The text of a number under a format code: up to three sections (positive, negative, zero) or sections with
    conditions (``[>100]``), each a pattern of digits, fractions, dates and text.  Colours and fill marks have no
    effect; null stays null."""
    sections = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)

    def one(section: str, minus: bool) -> Column:
        if section.strip().lower() in ("", "general", "@"):
            return general(v, locale) if section.strip() else F.lit("")
        if is_date_format(section):
            return _dated(v, section, locale, from_1904)
        return F.concat(F.when((v < 0), "-").otherwise(""), _fixed(v, section, locale)) if minus else _fixed(v, section, locale)

    tests = [_CONDITION.search(s) for s in sections]
    if any(tests):
        rest = next((s for s, t in zip(sections, tests, strict=True) if not t), None)
        out = None
        for section, t in zip(sections, tests, strict=True):
            if t:
                n = float(t[2])
                hit = {">": v > n, ">=": v >= n, "<": v < n, "<=": v <= n, "<>": v != n}.get(t[1], v == n)
                own = one(_CONDITION.sub("", section), True)
                out = F.when(hit, own) if out is None else out.when(hit, own)
        return out if rest is None else F.when(v.isNotNull(), out.otherwise(one(rest, True)))
    if len(sections) == 1:
        return one(sections[0], True)
    zero = one(sections[2], False) if len(sections) > 2 else one(sections[0], False)
    return F.when(v > 0, one(sections[0], False)).when(v < 0, one(sections[1], False)).when(v == 0, zero)


def formatted_text(t: Column, code: str) -> Column:
    """A text cell under a format code: its ``@`` section, or the fourth, with the text in the place of ``@``; as it
    is without one."""
    sections = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)
    bare = lambda s: re.sub(r'"[^"]*"', "", s)
    section = next((s for s in sections if "@" in bare(s)), sections[3] if len(sections) > 3 else None)
    if section is None:
        return t
    parts = [t if m[7] == "@" else F.lit(m[1] if m[1] is not None else m[2] if m[2] is not None else " " if m[0][0] == "_" else "" if m[0][0] in "*[" else m[0]) for m in _PARTS.finditer(section)]
    return F.concat(*parts) if parts else F.lit("")
