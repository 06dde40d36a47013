"""Tables and number rules that the queries share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text

#: lineitem's other keys repeat, these four together don't.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, digits: int = 4) -> Column:
    """Half away from zero by arithmetic, which both engines do alike."""
    p = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5 + 1e-12).cast("double") / p


def rounded_sql(x: str, digits: int = 4) -> str:
    p = float(10**digits)
    return f"(sign({x}) * floor(abs({x}) * {p} + 0.5 + 1e-12)::DOUBLE / {p})"


#: SQL of the roman numerals up to 3999, and of whether ``t`` (lower case, single spaces, trimmed) is a page number and nothing else.
ROMANS = """(SELECT repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1]
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS roman FROM range(1, 4000) r(n))"""


def page_parts_sql(rel: str, t: str) -> str:
    """``rel`` with ``p``, the parts of the line ``t`` that PAGE_NUMBER judges."""
    w = f"trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))"
    bare = f"trim(regexp_replace(trim(regexp_replace({w}, '^[-–—]', '')), '[-–—]$', ''))"
    word = "".join(f" WHEN starts_with(w, '{x}') THEN w[{len(x) + 1}:]" for x in text.PAGE_WORDS)
    return f"(SELECT * EXCLUDE (w), list_transform(string_split_regex(CASE{word} ELSE w END, '/|of|de'), lambda y: trim(y)) AS p FROM (SELECT *, {bare} AS w FROM {rel}))"


PAGE_NUMBER = f"((regexp_full_match(p[1], '[0-9]{{1,4}}') OR (length(p[1]) <= 7 AND p[1] IN {ROMANS})) AND (len(p) = 1 OR (len(p) = 2 AND regexp_full_match(p[2], '[0-9]{{1,4}}'))))"
