"""Charts, statistics and sheet functions over the tables."""

from pyspark.sql import functions as F

from leafmill.functions import sheet
from leafmill.operators import charts, stats
from leafmill.plans.common import LINE_KEY, read, rounded, rounded_sql

Q, O = {}, {}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


@query("stacked_quantity", """
SELECT l_returnflag, l_linestatus, qty, sum(qty) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus ROWS UNBOUNDED PRECEDING) - qty AS base,
  sum(qty) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus ROWS UNBOUNDED PRECEDING) AS top
FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)""")
def stacked_quantity(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return charts.stacked(d, ["l_returnflag"], ["l_linestatus"], "qty").select("l_returnflag", "l_linestatus", "qty", "base", "top")


@query("percent_stack", f"""
SELECT l_returnflag, l_linestatus, {rounded_sql('qty / sum(qty) OVER (PARTITION BY l_returnflag)', 9)} AS share
FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)""")
def percent_stack(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return charts.share(d, ["l_returnflag"], "qty").select("l_returnflag", "l_linestatus", rounded(F.col("share"), 9).alias("share"))


@query("pie_angles", f"""
WITH s AS (SELECT p_brand, sum(p_size)::DOUBLE AS v FROM part GROUP BY 1), t AS (SELECT *, v / sum(v) OVER () * 360 AS sweep FROM s)
SELECT p_brand, {rounded_sql('sweep', 6)} AS sweep, {rounded_sql('sum(sweep) OVER (ORDER BY p_brand ROWS UNBOUNDED PRECEDING) - sweep', 6)} AS start FROM t""")
def pie_angles(spark, sf_dir):
    d = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("v"))
    d = charts.pie_angles(d.withColumn("all", F.lit(0)), ["all"], ["p_brand"], "v")
    return d.select("p_brand", rounded(F.col("sweep"), 6).alias("sweep"), rounded(F.col("start"), 6).alias("start"))


@query("densified_months", """
WITH p AS (SELECT o_orderpriority, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS idx, count(*) AS n FROM orders
           WHERE o_orderdate IS NOT NULL GROUP BY 1, 2),
f AS (SELECT o_orderpriority, unnest(range(max(idx) + 1)) AS idx FROM p GROUP BY 1)
SELECT f.o_orderpriority, f.idx::BIGINT AS idx, p.n FROM f LEFT JOIN p USING (o_orderpriority, idx)""")
def densified_months(spark, sf_dir):
    """Orders of each priority per month, months without any included."""
    idx = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("long")
    d = read(spark, sf_dir, "orders").where("o_orderdate is not null")
    d = d.groupBy("o_orderpriority", idx.alias("idx")).agg(F.count("*").alias("n"))
    top = d.groupBy("o_orderpriority").agg((F.max("idx") + 1).alias("count"))
    return charts.densify(d.join(top, "o_orderpriority"), ["o_orderpriority"], "idx", "n", "count")


@query("axis_scale", """
WITH r AS (SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1),
e AS (SELECT p_brand, low, CASE WHEN low <> high THEN high WHEN low = 0 THEN 1 ELSE low + abs(low) / 2 END AS high FROM r),
s AS (SELECT *, (high - low) / 6.0::DOUBLE AS raw FROM e), t AS (SELECT *, pow(10.0, floor(log10(raw))) AS p FROM s),
u AS (SELECT *, (CASE WHEN raw / p < 1.5 THEN 1.0 WHEN raw / p < 3 THEN 2.0 WHEN raw / p < 7 THEN 5.0 ELSE 10.0 END)::DOUBLE * p AS step FROM t)
SELECT p_brand, step, floor(low / step + 1e-9) * step AS axis_low, ceil(high / step - 1e-9) * step AS axis_high FROM u""")
def axis_scale(spark, sf_dir):
    d = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    d = d.select("p_brand", charts.axis(F.col("low"), F.col("high")).alias("a"))
    return d.select("p_brand", "a.step", F.col("a.low").alias("axis_low"), F.col("a.high").alias("axis_high"))


@query("floor_percentile", """
SELECT event_type, list(value ORDER BY value)[least(count(*), floor(0.9 * count(*)) + 1)::INT] AS percentile FROM events WHERE value IS NOT NULL GROUP BY 1""")
def floor_percentile(spark, sf_dir):
    return stats.floor_percentile_of(read(spark, sf_dir, "events"), ["event_type"], "value", 0.9)


@query("median_by_type", "SELECT event_type, coalesce(median(value), 0) AS median FROM events GROUP BY 1")
def median_by_type(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("median"))


@query("mode_bucket", """
WITH b AS (SELECT event_type, floor(value / 5.0 + 0.5) * 5.0 AS b, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT event_type, arg_max(b, struct_pack(n := n, f := -f)) AS mode FROM b GROUP BY 1""")
def mode_bucket(spark, sf_dir):
    return stats.bucket_mode(read(spark, sf_dir, "events"), ["event_type"], "value", 5.0, "event_id")


@query("weighted_size_mode", """
WITH b AS (SELECT p_brand, floor(p_size / 4.0 + 0.5) * 4.0 AS b, sum(length(p_name)) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, arg_max(b, struct_pack(n := n, f := -b))::DOUBLE AS mode FROM b GROUP BY 1""")
def weighted_size_mode(spark, sf_dir):
    return stats.weighted_mode(read(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_brand"], "p_size", F.length("p_name"), 4.0)


LEVEL = "least(255, greatest(0, floor(value)))"


@query("value_histogram", f"SELECT event_type, ({LEVEL})::BIGINT AS level, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def value_histogram(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "events").where("value is not null"), ["event_type"], F.expr(LEVEL))


@query("otsu_threshold", f"""
WITH h AS (SELECT event_type, ({LEVEL})::BIGINT AS level, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY level)::DOUBLE AS w, sum(n * level) OVER (PARTITION BY event_type ORDER BY level)::DOUBLE AS s,
  sum(n) OVER (PARTITION BY event_type)::DOUBLE AS tw, sum(n * level) OVER (PARTITION BY event_type)::DOUBLE AS ts FROM h),
v AS (SELECT event_type, level, CASE WHEN tw > w THEN w * (tw - w) * (s / w - (ts - s) / (tw - w)) * (s / w - (ts - s) / (tw - w)) ELSE 0 END AS v FROM r)
SELECT event_type, CASE WHEN max(v) > 0 THEN arg_max(level, struct_pack(v := round(v, 3), f := -level)) ELSE 128 END AS threshold FROM v GROUP BY 1""")
def otsu_threshold(spark, sf_dir):
    return stats.otsu(value_histogram(spark, sf_dir), ["event_type"])


@query("contrast_stretch", f"""
WITH b AS (SELECT event_type, list(value ORDER BY value)[floor(0.02 * count(*))::INT + 1] AS lo, list(value ORDER BY value)[least(count(*), floor(0.98 * count(*)) + 1)::INT] AS hi
           FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_id, {rounded_sql('least(255.0, greatest(0.0, coalesce((value - lo) * 255 / nullif(hi - lo, 0), 0.0)))', 6)} AS stretched FROM events JOIN b USING (event_type) WHERE value IS NOT NULL""")
def contrast_stretch(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null")
    lo = stats.floor_percentile_of(e, ["event_type"], "value", 0.02).withColumnRenamed("percentile", "lo")
    hi = stats.floor_percentile_of(e, ["event_type"], "value", 0.98).withColumnRenamed("percentile", "hi")
    d = e.join(lo, "event_type").join(hi, "event_type")
    return d.select("event_id", rounded(stats.stretched(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("stretched"))


@query("sheet_aggregates", f"""
SELECT event_type, coalesce(sum(floor(value)), 0)::DOUBLE AS total, {rounded_sql('coalesce(product(1 + value / 1e9), 1.0)', 6)} AS product_, min(value) AS low, max(value) AS high,
  median(value) AS middle, count(value) AS numbers, count(*) FILTER (WHERE props <> '') AS filled, sum(floor(value)) / count(value) AS mean FROM events GROUP BY 1""")
def sheet_aggregates(spark, sf_dir):
    """Sum, product, min, max, median, count, counta and average of a column of numbers, by sheet."""
    whole = F.floor("value").cast("double")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.coalesce(F.sum(whole), F.lit(0.0)).alias("total"),
        rounded(F.coalesce(F.product(1 + F.col("value") / 1e9), F.lit(1.0)), 6).alias("product_"),
        F.coalesce(F.min("value"), F.lit(0.0)).alias("low"),
        F.coalesce(F.max("value"), F.lit(0.0)).alias("high"),
        F.median("value").alias("middle"),
        F.count("value").alias("numbers"),
        F.count_if(F.col("props") != "").alias("filled"),
        F.try_divide(F.sum(whole), F.count("value")).alias("mean"),
    )


@query("sumif_returnflag", """
SELECT l_shipmode_, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, count(*) FILTER (WHERE l_quantity >= 25) AS large,
  sum(CASE WHEN l_quantity <> 10 THEN l_quantity ELSE 0 END) AS not_ten FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1""")
def sumif_returnflag(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    return d.groupBy(F.col("l_linestatus").alias("l_shipmode_")).agg(
        sheet.sum_if(sheet.criterion("r", F.col("l_returnflag")), F.col("l_quantity")).alias("returned"),
        sheet.count_if(sheet.criterion(">=25", F.col("l_quantity"))).alias("large"),
        sheet.sum_if(sheet.criterion("<>10", F.col("l_quantity")), F.col("l_quantity")).alias("not_ten"),
    )


@query("countif_wildcard", "SELECT p_brand, count(*) FILTER (WHERE lower(p_name) LIKE '%e%') AS with_e, count(*) FILTER (WHERE lower(p_type) LIKE '_r%') AS second_r, count(*) FILTER (WHERE NOT lower(p_name) LIKE 'a%') AS not_a FROM part GROUP BY 1")
def countif_wildcard(spark, sf_dir):
    c = lambda k, x: sheet.count_if(sheet.criterion(k, F.col(x)))
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(c("*E*", "p_name").alias("with_e"), c("?r*", "p_type").alias("second_r"), c("<>a*", "p_name").alias("not_a"))


@query("averageif_priority", f"SELECT o_orderstatus, {rounded_sql('''sum(CASE WHEN lower(o_orderpriority) LIKE '1%' THEN floor(o_totalprice) ELSE 0 END) / nullif(count(*) FILTER (WHERE lower(o_orderpriority) LIKE '1%'), 0)''', 6)} AS mean FROM orders GROUP BY 1")
def averageif_priority(spark, sf_dir):
    mean = sheet.average_if(sheet.criterion("1*", F.col("o_orderpriority")), F.floor("o_totalprice"))
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(rounded(mean, 6).alias("mean"))


@query("logic_and_or", "SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_large, bool_or(o_orderstatus = 'P') AS any_pending, NOT bool_or(o_orderpriority = '1-URGENT') AS none_urgent FROM orders GROUP BY 1")
def logic_and_or(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 50000).alias("all_large"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), (~F.bool_or(F.col("o_orderpriority") == "1-URGENT")).alias("none_urgent"))


_R = "l_extendedprice * (1 - l_discount)"


@query("round_family", f"""
SELECT {', '.join(LINE_KEY)}, {rounded_sql(_R, 2)} AS nearest, sign({_R}) * ceil(abs({_R}) * 10.0 - 1e-12) / 10.0 AS up, floor(abs({_R}) * 10.0 + 1e-12) / 10.0 AS down,
  floor({_R} / 100.0 + 0.5 + 1e-12) * 100.0 AS hundreds, floor(-l_tax * 10)::BIGINT AS whole FROM lineitem""")
def round_family(spark, sf_dir):
    x = F.expr(_R)
    return read(spark, sf_dir, "lineitem").select(*LINE_KEY, sheet.round_half_away(x, 2).alias("nearest"), sheet.round_up(x, 1).alias("up"), sheet.round_down(x, 1).alias("down"), sheet.round_half_away(x, -2).alias("hundreds"), F.floor(-F.col("l_tax") * 10).alias("whole"))


@query("mod_power", f"""
SELECT {', '.join(LINE_KEY)}, l_quantity - -3.0 * floor(l_quantity / -3.0) AS mod_negative, pow(pow(2.0, l_linenumber), 2.0) AS left_power, pow(-l_linenumber::DOUBLE, 2.0) AS minus_first,
  l_quantity / nullif(l_discount, 0) AS ratio, CASE WHEN l_quantity - 10 >= 0 THEN sqrt(l_quantity - 10) END AS root FROM lineitem""")
def mod_power(spark, sf_dir):
    """The power binds to the left, the sign before it, and errors are null."""
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(*LINE_KEY, sheet.mod(q, F.lit(-3.0)).alias("mod_negative"), F.pow(F.pow(F.lit(2.0), "l_linenumber"), F.lit(2.0)).alias("left_power"), F.pow(-F.col("l_linenumber").cast("double"), F.lit(2.0)).alias("minus_first"), sheet.divide(q, F.col("l_discount")).alias("ratio"), sheet.square_root(q - 10).alias("root"))


@query("text_functions", r"""
SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   x ', '\s+', ' ', 'g')) AS trimmed, left(p_name, 3) AS l, right(p_name, 4) AS r, substr(p_name, 2, 5) AS m,
  p_brand || '-' || p_size AS joined, length(p_name) AS n, upper(p_type) AS up, lower(p_type) AS low FROM part""")
def text_functions(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", sheet.trim_inside(F.concat(F.lit("  "), name, F.lit("   x "))).alias("trimmed"), sheet.left(name, 3).alias("l"), sheet.right(name, 4).alias("r"), sheet.middle(name, 2, 5).alias("m"), sheet.concat(F.col("p_brand"), F.lit("-"), F.col("p_size")).alias("joined"), F.length(name).cast("long").alias("n"), F.upper("p_type").alias("up"), F.lower("p_type").alias("low"))


@query("column_letters", """
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey <= 0 THEN 0 WHEN p_partkey <= 26 THEN 1 WHEN p_partkey <= 702 THEN 2 WHEN p_partkey <= 18278 THEN 3 WHEN p_partkey <= 475254 THEN 4 WHEN p_partkey <= 12356630 THEN 5 ELSE 6 END AS len FROM part),
s AS (SELECT *, p_partkey - [1, 27, 703, 18279, 475255, 12356631][len] AS off FROM n)
SELECT p_partkey, array_to_string(list_transform(range(len), lambda i: chr((65 + (off // (26 ** (len - 1 - i))::BIGINT) % 26)::INT)), '') AS letters, p_partkey AS number FROM s""")
def column_letters(spark, sf_dir):
    """Numbers to column letters and back."""
    d = read(spark, sf_dir, "part").select("p_partkey", sheet.column_letters(F.col("p_partkey")).alias("letters"))
    return d.withColumn("number", sheet.column_number(F.col("letters")))
