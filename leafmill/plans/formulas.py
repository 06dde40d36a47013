"""Formulas and formats over the tables."""

from pyspark.sql import functions as F

from leafmill.functions import formula, numfmt, text
from leafmill.plans.common import LINE_KEY, read, rounded_sql
from leafmill.plans.series import query

_R = "l_extendedprice * (1 - l_discount)"


@query("formula_price", f"""
SELECT {', '.join(LINE_KEY)}, {rounded_sql(_R, 2)} AS net, CASE WHEN l_quantity > 25 THEN 'LARGE' ELSE lower(l_returnflag) END AS size,
  coalesce(l_quantity / nullif(l_discount, 0), -1.0) AS ratio, l_returnflag || '-' || l_linenumber AS code, (l_quantity > 10 AND l_tax < 0.05) AS chosen FROM lineitem""")
def formula_price(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    f = lambda s: formula.column(s, d)
    return d.select(
        *LINE_KEY,
        f("=ROUND(l_extendedprice*(1-l_discount),2)").alias("net"),
        f('=IF(l_quantity>25,"LARGE",LOWER(l_returnflag))').alias("size"),
        f("=SI.ERROR(l_quantity/l_discount;-1)").alias("ratio"),
        f('=l_returnflag&"-"&l_linenumber').alias("code"),
        f("=AND(l_quantity>10,l_tax<5%)").alias("chosen"),
    )


@query("formula_mixed", """
SELECT p_partkey, pow(pow(2.0, 1.0 + p_size % 3), 2.0) + pow(-2.0, 2.0) AS powers, upper(left(p_name, 2)) || length(p_name) AS tag, lower(p_brand) = 'brand#11' AS same,
  p_size - -4.0 * floor(p_size / -4.0) AS mod_, (least(p_size, 7.0) + greatest(p_size, 7.0)) / 2 AS mean, floor(-p_retailprice / 100)::DOUBLE AS whole FROM part""")
def formula_mixed(spark, sf_dir):
    d = read(spark, sf_dir, "part")
    f = lambda s: formula.column(s, d)
    return d.select("p_partkey", f("=2^(1+MOD(p_size,3))^2+-2^2").alias("powers"), f("=UPPER(LEFT(p_name,2))&LEN(p_name)").alias("tag"), f('=p_brand="BRAND#11"').alias("same"), f("=RESIDUO(p_size;-4)").alias("mod_"), f("=AVERAGE(MIN(p_size,7),MAX(p_size,7))").alias("mean"), f("=INT(-p_retailprice/100)").alias("whole"))


@query("serial_dates", """
SELECT o_orderkey, (CASE WHEN n < 60 THEN DATE '1899-12-31' + n ELSE DATE '1899-12-30' + greatest(n, 61) END)::VARCHAR AS day FROM (SELECT o_orderkey, (o_orderkey % 50000)::INT AS n FROM orders)""")
def serial_dates(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", numfmt.serial_date(F.col("o_orderkey") % 50000).cast("string").alias("day"))


@query("date_formats", """
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS short, strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS long_, strftime(o_orderdate, '%a %d-%b-%y') AS named FROM orders""")
def date_formats(spark, sf_dir):
    serial = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("double")
    f = lambda c: numfmt.formatted(serial, c)
    return read(spark, sf_dir, "orders").select("o_orderkey", f("dd/mm/yyyy").alias("short"), f("mmmm d, yyyy").alias("long_"), f("ddd dd-mmm-yy").alias("named"))


@query("number_formats", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 10)::BIGINT AS t, l_linenumber AS k, round(l_discount * 100)::BIGINT AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, format('{:,}', t // 10) || '.' || (t % 10) || '0' AS money, d || '%' AS percent, lpad(k::VARCHAR, 4, '0') AS padded,
  CASE WHEN d > 5 THEN 'up ' || (d - 5) WHEN d < 5 THEN 'down ' || (5 - d) ELSE 'none' END AS signed FROM v""")
def number_formats(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 10) / 10
    return d.select(*LINE_KEY, numfmt.formatted(cents, "#,##0.00").alias("money"), numfmt.formatted(F.col("l_discount"), "0%").alias("percent"), numfmt.formatted(F.col("l_linenumber").cast("double"), "0000").alias("padded"), numfmt.formatted(F.round(F.col("l_discount") * 100) - 5, '"up "0;"down "0;"none"').alias("signed"))


@query("clock_formats", """
SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, (hour(ts) + 11) % 12 + 1 || strftime(ts, ':%M ') || CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS half FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def clock_formats(spark, sf_dir):
    t = F.date_trunc("second", F.col("ts"))
    serial = 45000 + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400.0
    return read(spark, sf_dir, "events").select("event_id", numfmt.formatted(serial, "hh:mm:ss").alias("clock"), numfmt.formatted(serial, "h:mm AM/PM").alias("half"))


@query("number_parse", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT AS n, floor(l_tax * 100)::BIGINT AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -(n + 0.5)::DOUBLE AS money, p / 100.0 AS share, NULL::DOUBLE AS code FROM t""")
def number_parse(spark, sf_dir):
    """Amounts written as text, back to numbers: (1.234,5 €), 7 %, and a code with a leading zero."""
    d = read(spark, sf_dir, "lineitem").select(*LINE_KEY, F.floor("l_extendedprice").alias("n"), F.floor(F.col("l_tax") * 100).alias("p"))
    money = F.concat(F.lit("("), F.translate(F.format_number("n", 0), ",", "."), F.lit(",5 €)"))
    v = lambda c: text.parsed_number(c)["value"]
    return d.select(*LINE_KEY, v(money).alias("money"), v(F.concat(F.col("p").cast("string"), F.lit(" %"))).alias("share"), v(F.concat(F.lit("0"), (F.col("n") + 10).cast("string"))).alias("code"))


@query("decimal_vote", """
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) AS w FROM documents)
SELECT doc_id, CASE WHEN count(*) FILTER (WHERE regexp_matches(w, '^[-+(]?[0-9,]*\\.[0-9]{1,2}[)%]?$')) > count(*) FILTER (WHERE regexp_matches(w, '^[-+(]?[0-9.]*,[0-9]{1,2}[)%]?$')) THEN '.' ELSE ',' END AS decimal_ FROM l GROUP BY 1""")
def decimal_vote(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    return read(spark, sf_dir, "documents").where(F.size(words) > 0).select("doc_id", text.decimal_vote(words).alias("decimal_"))


@query("list_marks", r"""
SELECT doc_id, count(*) AS marks, count(*) FILTER (WHERE regexp_matches(line, '^\s*(\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])\s+\S')) AS ordered
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^\s*(?:[•◦▪‣·*–-]|(\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]))\s+\S') GROUP BY 1""")
def list_marks(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    m = lines.select("doc_id", text.list_mark(F.col("line")).alias("m")).where("m is not null")
    return m.groupBy("doc_id").agg(F.count("*").alias("marks"), F.count_if(F.col("m.ordered")).alias("ordered"))


@query("list_numerals", """
SELECT p_partkey, repeat(chr((97 + (p_size - 1) % 26)::INT), (1 + (p_size - 1) // 26)::INT) AS letter, [('')] [1] || CASE WHEN p_size >= 50 THEN 'l' ELSE '' END || CASE WHEN p_size % 50 >= 40 THEN 'xl' ELSE repeat('x', (p_size % 50 // 10)::INT) END
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(p_size % 10 + 1)::INT] AS roman FROM part""")
def list_numerals(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.letters(F.col("p_size")).alias("letter"), text.roman(F.col("p_size")).alias("roman"))
