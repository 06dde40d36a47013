import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.functions import formula, numfmt, sheet, text
from leafmill.operators import charts, pages
from leafmill.sources import delimited


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize("f, want", [
    ("=2^3^2", 64.0), ("=-2^2", 4.0), ("=50%", 0.5), ('="a"&1', "a1"), ("=1+2*3", 7.0), ('="A"="a"', True), ("=1/0", None), ('="x"+1', None), ("=SQRT(-1)", None),
    ("=IFERROR(1/0,7)", 7.0), ("=SI.ERROR(1/0;7)", 7.0), ("=ROUND(2.345,2)", 2.35), ("=ROUND(-2.5,0)", -3.0), ("=ROUNDUP(1.01,1)", 1.1), ("=ROUNDDOWN(-1.19,1)", -1.1), ("=ROUND(1234,-2)", 1200.0),
    ("=INT(-1.5)", -2.0), ("=MOD(7,-3)", -2.0), ("=IF(1>2,1)", "FALSE"), ("=IF(TRUE,,5)", 0.0), ('=LEN("hello")', 5.0), ('=TRIM("  a   b ")', "a b"), ('=MID("hello",2,3)', "ell"), ('=RIGHT("abc")', "c"),
    ("=SUM(1,2,3)", 6.0), ("=PRODUCT()", 1.0), ("=MEDIAN(3,1,2,10)", 2.5), ("=AND(TRUE,1)", True), ('="1,5"+1', 2.5), ('=1<"a"', True), ('="say ""hi"""', 'say "hi"'),
])
def test_formula(spark, f, want):
    got = value(spark, formula.column(f, spark.range(1)))
    assert got == want or (isinstance(want, float) and abs(got - want) < 1e-9)


def test_formula_blanks_and_errors(spark):
    d = spark.createDataFrame([(None, None, 2.0)], "a double, b string, c double")
    assert d.select(formula.column("=A1n+C*3", d, {"A1n": "a", "C": "c"})).first()[0] == 6.0
    assert d.select(formula.column('=b&"x"', d)).first()[0] == "x"
    for bad in ("=nothere+1", "=1+", "=FOO(1)", "=(1", "=1 2"):
        with pytest.raises(ValueError):
            formula.column(bad, d)


def test_shifted():
    assert formula.shifted('=A1+$B$2&"A1"', 1, 1) == '=B2+$B$2&"A1"'
    assert formula.shifted("=SUM(A1:B2)", 1, 0) == "=SUM(A2:B3)"
    assert formula.shifted("=A1", -1, 0) == "=#REF!"


@pytest.mark.parametrize("v, code, locale, want", [
    (1234.5, "#,##0.00", "es", "1.234,50"), (0.256, "0.0%", "en", "25.6%"), (7.0, "000", "en", "007"), (-3.0, "0;(0)", "en", "(3)"), (0.0, '0;0;"nil"', "en", "nil"), (1234567.0, "0.0,,", "en", "1.2"),
    (12345.0, "0.00E+00", "en", "1.23E+04"), (5.0, '0 "kg"', "en", "5 kg"), (1.5, "0.##", "en", "1.5"), (0.5, "#.0", "en", ".5"), (45000.0, "dd/mm/yyyy", "en", "15/03/2023"), (45000.0, "mmmm", "es", "marzo"),
    (60.0, "dd/mm", "en", "29/02"), (45000.75, "h:mm AM/PM", "en", "6:00 PM"), (1.5, "[h]:mm", "en", "36:00"), (1.25, "General", "es", "1,25"),
    (0.1 + 0.2, "General", "es", "0,3"), (42.0, "General", "en", "42"), (-7.25, "General", "en", "-7.25"), (1e12, "General", "en", "1E+12"), (0.0, "General", "en", "0"), (100.0, "General", "en", "100"),
    (12345.678901234, "General", "en", "12345.678901"), (0.000123456789123, "General", "en", "0.00012345678912"), (3.14159, "0.00", "es", "3,14"), (2.675, "0.00", "es", "2,68"), (2.567, "0.0#", "es", "2,57"), (0.5, "0", "es", "1"),
    (1.5, "# ?/?", "en", "1 1/2"), (0.25, "?/?", "en", "1/4"), (3.0, "# ?/?", "en", "3"), (0.333, "# ??/??", "en", "1/3"), (2.75, "# ?/8", "en", "2 6/8"), (150.0, '[>100]"big";0.0', "en", "big"), (50.0, '[>100]"big";0.0', "en", "50.0"),
    (61.0, "dd/mm/yyyy", "en", "01/03/1900"), (60.0, "dd/mm/yyyy", "es", "29/02/1900"), (1234567.0, '0.0,,"M"', "es", "1,2M"), (-1234.0, "#,##0;(#,##0)", "es", "(1.234)"),
])
def test_formats(spark, v, code, locale, want):
    assert value(spark, numfmt.formatted(F.lit(v), code, locale)) == want


@pytest.mark.parametrize("t, code, want", [("hola", "@", "hola"), ("hola", '"Cliente: "@', "Cliente: hola"), ("hola", "General", "hola"), ("x", '0;0;0;"<"@">"', "<x>"), (None, "@", None)])
def test_text_formats(spark, t, code, want):
    assert value(spark, numfmt.formatted_text(F.lit(t).cast("string"), code)) == want


def test_criteria_compare_like_with_like(spark):
    """Numbers with numbers, text with text; an order on text never holds."""
    d = spark.createDataFrame([(15.0, "15", "Apple"), (5.0, "5", "apricot"), (None, None, None)], "n double, t string, w string")
    hits = lambda c, x: [r[0] for r in d.select(sheet.criterion(c, F.col(x))).collect()]
    assert hits(">10", "n") == [True, False, False] and hits(">10", "t") == [False] * 3
    assert hits("15", "n") == [True, False, False] and hits("15", "t") == [True, False, False] and hits("<>15", "t") == [False, True, True]
    assert hits("ap*", "w") == [True, True, False] and hits("APPLE", "w") == [True, False, False] and hits("<>a?ple", "w") == [False, True, True]
    assert hits("1_5", "n") == hits("nan", "n") == hits("1,5", "n") == [False] * 3 and hits("1*", "n") == [True, False, False]


def test_axis(spark):
    got = lambda low, high: tuple(value(spark, charts.axis(F.lit(low), F.lit(high))))
    assert got(0.0, 12.0) == (2.0, 0.0, 12.0) and got(0.0, 8.0) == (1.0, 0.0, 8.0) and got(0.0, 40.0) == (5.0, 0.0, 40.0)
    assert got(3.0, 3.0)[0] == 0.2 and got(0.0, 0.0) == (0.2, 0.0, 1.0)


def test_serial_dates(spark):
    assert value(spark, numfmt.serial_date(F.lit(45000))) == datetime.date(2023, 3, 15)
    assert value(spark, numfmt.serial_date(F.lit(1))) == datetime.date(1900, 1, 1)
    assert value(spark, numfmt.serial_date(F.lit(0), True)) == datetime.date(1904, 1, 1)


@pytest.mark.parametrize("s, decimal, want", [
    ("1.234,5", ",", 1234.5), ("(12)", ",", -12.0), ("7 %", ",", 0.07), ("€ 3,50", ",", 3.5), ("1,234.5", ",", 1234.5), ("12.5", ",", 12.5), ("-3", ",", -3.0), ("1,234", ".", 1234.0),
    ("007", ",", None), ("12345678901", ",", None), ("abc", ",", None), ("12,", ",", None), ("", ",", None), (None, ",", None),
])
def test_numbers_in_text(spark, s, decimal, want):
    got = value(spark, text.parsed_number(F.lit(s).cast("string"), decimal))
    assert (got and got["value"]) == want


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.cleaned(F.lit("ﬁn­e x​"))) == "fine x"
    assert v(text.joined_letters(F.lit("a T I T L E here"))) == "a TITLE here" or v(text.joined_letters(F.lit("T I T L E"))) == "TITLE"
    assert v(text.fold_key(F.lit("  Él, Ñandú! 2"))) == "el nandu 2"
    assert v(text.list_mark(F.lit("1. one")))["ordered"] and not v(text.list_mark(F.lit("• one")))["ordered"] and v(text.list_mark(F.lit("one"))) is None
    assert [v(text.page_number(F.lit(x))) for x in ("12", "- 3 -", "xiv", "Page 4", "3 / 10", "mcmx", "Página 12", "Page 3 of 10", "- 7 -", "iv", "3 / 20", "pág. 5")] == [True] * 12
    assert [v(text.page_number(F.lit(x))) for x in ("iiii", "word", "12345", "(3)", "2020 fue un año", "Capítulo 1", "civil", "hola", "")] == [False] * 9
    assert v(text.roman(F.lit(1994))) == "mcmxciv" and v(text.letters(F.lit(28))) == "bb"
    assert v(sheet.column_number(F.lit("AA"))) == 27 and v(sheet.column_letters(F.lit(703))) == "AAA"


@pytest.mark.parametrize("s, want", [("1-3, 5", [1, 2, 3, 5]), ("8-", [8, 9, 10]), ("-2", [1, 2]), ("3;1", [1, 3]), ("0", None), ("11", None), ("5-2", None), ("x", None), ("", None)])
def test_ranges(spark, s, want):
    assert value(spark, pages.range_pages(F.lit(s), F.lit(10))) == want


@pytest.mark.parametrize("t, want", [
    ('a"b,c"d,e\nx,y,z', [['a"b', 'c"d', "e"], ["x", "y", "z"]]), ('"a,1","b ""q"""\n"two\nlines",', [["a,1", 'b "q"'], ["two\nlines", ""]]), ("a,b\r\n\r\nc\r\n", [["a", "b"], [""], ["c"]]), ('"x"y,z', [['"x"y', "z"]]), ("", [[""]]), (",", [["", ""]]),
])
def test_records(spark, t, want):
    assert value(spark, delimited.records(F.lit(t), F.lit(","))) == want


def test_text_of_numbers_has_fifteen_digits(spark):
    d = spark.createDataFrame([(0.1, 0.2)], "a double, b double")
    assert d.select(formula.column('=a+b&""', d)).first()[0] == "0.3"
