"""Boxes, lines, outlines and references on pages set from the tables' rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import drawing, text
from leafmill.operators import boxes, lines
from leafmill.plans.common import PAGE_NUMBER, page_parts_sql, read, rounded, rounded_sql
from leafmill.plans.series import query

_B = """b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS box_no, l_partkey AS key,
  (l_partkey % 40 * 10)::DOUBLE AS x, (l_suppkey % 60 * 10)::DOUBLE AS y, 20.0::DOUBLE + l_quantity::DOUBLE * 8 AS w, 10.0::DOUBLE + l_quantity::DOUBLE * l_linenumber * 2 AS h FROM lineitem)"""


def _boxes(spark, sf_dir):
    """A page per order with a box per line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q = F.col("l_quantity").cast("double")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("box_no"), F.col("l_partkey").alias("key"), (F.col("l_partkey") % 40 * 10).cast("double").alias("x"),
        (F.col("l_suppkey") % 60 * 10).cast("double").alias("y"), (20 + q * 8).alias("w"), (10 + q * F.col("l_linenumber") * 2).alias("h"),
    )


@query("fragments_outside_tables", f"""
WITH {_B}, t AS (SELECT o_orderkey AS page, (o_custkey % 30 * 10)::DOUBLE AS x0, (o_custkey % 50 * 10)::DOUBLE AS bottom FROM orders)
SELECT page, box_no FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.y <= bottom + 200 + 3 AND b.y >= bottom - 3 AND b.x + b.w >= x0 - 3 AND b.x <= x0 + 100 + 3)""")
def fragments_outside_tables(spark, sf_dir):
    f = _boxes(spark, sf_dir).withColumnRenamed("w", "width")
    x0, bottom = (F.col("o_custkey") % 30 * 10).cast("double"), (F.col("o_custkey") % 50 * 10).cast("double")
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), x0.alias("x0"), (x0 + 100).alias("x1"), (bottom + 200).alias("top"), bottom.alias("bottom"))
    return boxes.fragments_outside_tables(f, t, ["page"]).select("page", "box_no")


@query("lines_outside_figures", f"""
WITH {_B}
SELECT page, box_no FROM b l WHERE box_no % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b f WHERE f.box_no % 2 = 1 AND f.page = l.page AND l.x >= f.x - 4 AND l.x + 40 <= f.x + f.w + 4 AND l.y + 3 >= f.y AND l.y + 3 <= f.y + f.h)""")
def lines_outside_figures(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    a = b.where("box_no % 2 = 0").select("page", "box_no", F.col("x").alias("x0"), (F.col("x") + 40).alias("x1"), "y", F.lit(10.0).alias("size"))
    return boxes.lines_outside_figures(a, b.where("box_no % 2 = 1"), ["page"]).select("page", "box_no")


@query("boxes_not_inside", f"""
WITH {_B}
SELECT page, box_no FROM b a WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page = a.page AND o.box_no <> a.box_no
  AND greatest(0, least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * greatest(0, least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) >= a.w * a.h * 0.9
  AND (o.w * o.h > a.w * a.h * 1.02 OR (abs(o.w * o.h - a.w * a.h) <= a.w * a.h * 0.02 AND o.box_no < a.box_no)))""")
def boxes_not_inside(spark, sf_dir):
    return boxes.not_inside_larger(_boxes(spark, sf_dir), ["page"], "box_no").select("page", "box_no")


@query("worth_showing", f"""
WITH {_B}, p AS (SELECT o_custkey AS doc, o_orderkey AS page, (o_orderkey % 7 * 100)::BIGINT AS own, (o_orderkey % 7 * 100 + o_orderkey % 2)::BIGINT AS total FROM orders),
n AS (SELECT doc, count(*) AS n FROM p GROUP BY 1),
i AS (SELECT doc, b.page, box_no, x, y, w, h, own, total, key % 25 AS key FROM b JOIN p USING (page)),
r AS (SELECT doc, key FROM i JOIN n USING (doc) GROUP BY doc, key, n HAVING n >= 4 AND count(DISTINCT page) >= greatest(3, ceil(n * 0.25))),
c AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = i.doc AND r.key = i.key)),
g AS (SELECT DISTINCT doc, page, own FROM c WHERE w * h >= 600.0 * 800 * 0.6),
s AS (SELECT doc, count(*) >= greatest(3, n * 0.4) AND median(own) >= 300 AS scan FROM g JOIN n USING (doc) GROUP BY doc, n)
SELECT doc, page, box_no FROM c LEFT JOIN s USING (doc) WHERE w >= 24 AND h >= 24 AND w * h >= 600.0 * 800 * 0.012 AND NOT (w * h < 600.0 * 800 * 0.05 AND (y + h / 2 > 800 * 0.92 OR y + h / 2 < 800 * 0.08))
  AND NOT (w * h >= 600.0 * 800 * 0.6 AND CASE WHEN coalesce(scan, false) THEN total > 0 ELSE own > 300 END)""")
def worth_showing(spark, sf_dir):
    """A document per customer with a page per order."""
    own = (F.col("o_orderkey") % 7 * 100).cast("long")
    p = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), own.alias("own"), (own + F.col("o_orderkey") % 2).alias("total"))
    b = _boxes(spark, sf_dir).join(p.select("doc", "page"), "page").withColumn("key", F.col("key") % 25)
    return boxes.worth_showing(b, p, ["doc"], "page", "key").select("doc", "page", "box_no")


_F = """f AS (SELECT doc_id AS doc, i // 10 AS page, trim(t) AS t, (i * 37 % 100)::DOUBLE AS y FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, ' ') AS ts FROM documents)))"""


@query("own_characters", f"""
WITH {_F}, p AS (SELECT DISTINCT doc, page FROM f), n AS (SELECT doc, count(*) AS n FROM p GROUP BY 1),
c AS (SELECT doc, t FROM f JOIN n USING (doc) WHERE t <> '' GROUP BY doc, t, n HAVING n >= 4 AND count(DISTINCT page) >= greatest(3, ceil(n * 0.25)))
SELECT doc, page, sum(CASE WHEN t <> '' AND c.doc IS NULL AND y BETWEEN 10 AND 90 AND NOT {PAGE_NUMBER} THEN length(t) ELSE 0 END)::BIGINT AS own, sum(length(t))::BIGINT AS total
FROM {page_parts_sql("f", "t")} LEFT JOIN c USING (doc, t) GROUP BY 1, 2""")
def own_characters(spark, sf_dir):
    """Ten words of a document to a page, strewn over its height."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.split("text", " ").alias("ws"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 10).cast("int")), lambda p: F.slice("ws", p * 10 + 1, F.lit(10)))
    d = d.select("doc", F.posexplode(pages).alias("page", "ws"))
    fragment = lambda t, i: F.struct(t.alias("text"), ((F.col("page") * 10 + i) * 37 % 100).cast("double").alias("y"))
    p = d.select("doc", F.col("page").cast("long").alias("page"), F.lit(100.0).alias("height"), F.transform("ws", fragment).alias("fragments"))
    return boxes.own_characters(p, ["doc"], "page").select("doc", "page", F.col("own").cast("long").alias("own"), F.col("total").cast("long").alias("total"))


@query("upright_items", """
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS t, (l_quantity % 13)::DOUBLE AS a, (l_suppkey % 5)::DOUBLE AS b, (l_partkey % 3)::DOUBLE AS c, (l_quantity % 13)::DOUBLE AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(c) > abs(d) * 0.12 AS slanted FROM i WHERE length(t) > 0 AND sqrt(a * a + b * b) >= 1 AND abs(b) <= abs(a) * 0.3""")
def upright_items(spark, sf_dir):
    a = (F.col("l_quantity") % 13).cast("double")
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("text"), a.alias("a"), (F.col("l_suppkey") % 5).cast("double").alias("b"), (F.col("l_partkey") % 3).cast("double").alias("c"), a.alias("d"))
    return boxes.upright(d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "slanted")


@query("recognised_lines", f"""
WITH i AS (SELECT o_orderkey, trim(o_orderpriority) AS t, (o_custkey % 101)::DOUBLE AS confidence, (o_orderkey % 500)::DOUBLE AS x0, (o_custkey % 700)::DOUBLE AS y0, (o_orderkey % 31)::DOUBLE AS tall, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 700 + o_orderkey % 31)::DOUBLE END AS base FROM orders)
SELECT o_orderkey, t AS text, x0 / 2 AS x, {rounded_sql("800 - coalesce(base, y0 + tall - tall * 0.2) / 2")} AS y, {rounded_sql("greatest(4, tall / 2 * 0.78)")} AS size FROM i WHERE t <> '' AND confidence >= 25""")
def recognised_lines(spark, sf_dir):
    y0, tall = (F.col("o_custkey") % 700).cast("double"), (F.col("o_orderkey") % 31).cast("double")
    d = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("text"), (F.col("o_custkey") % 101).cast("double").alias("confidence"), (F.col("o_orderkey") % 500).cast("double").alias("x0"), y0.alias("y0"),
        (F.col("o_orderkey") % 500 + 90).cast("double").alias("x1"), (y0 + tall).alias("y1"), F.when(F.col("o_orderkey") % 3 == 0, y0 + tall).alias("base"), F.lit(2.0).alias("scale"), F.lit(800.0).alias("page_height"),
    )
    return boxes.recognised(d).select("o_orderkey", "text", "x", rounded(F.col("y")).alias("y"), rounded(F.col("size")).alias("size"))


@query("box_alignment", """
WITH s AS (SELECT o_custkey, (o_orderkey % 2)::INT AS box, o_orderkey, (o_orderkey % 4)::DOUBLE AS x0, (o_orderkey % 4 + 100 + o_orderkey % 3)::DOUBLE AS x1 FROM orders),
f AS (SELECT *, first(x0) OVER w AS f0, first(x1) OVER w AS f1 FROM s WINDOW w AS (PARTITION BY o_custkey, box ORDER BY o_orderkey)),
g AS (SELECT o_custkey, box, count(*) AS n, max(abs(x0 - f0)) < 3 AS l, max(abs((x0 + x1) / 2 - (f0 + f1) / 2)) < 3 AS c, max(abs(x1 - f1)) < 3 AS r FROM f GROUP BY 1, 2)
SELECT o_custkey, box, CASE WHEN n < 2 OR l THEN 'l' WHEN c THEN 'ctr' WHEN r THEN 'r' ELSE 'l' END AS align FROM g""")
def box_alignment(spark, sf_dir):
    k = F.col("o_orderkey")
    s = read(spark, sf_dir, "orders").select("o_custkey", (k % 2).cast("int").alias("box"), "o_orderkey", (k % 4).cast("double").alias("x0"), (k % 4 + 100 + k % 3).cast("double").alias("x1"))
    return boxes.alignment(s, ["o_custkey", "box"], [k])


@query("tables_among_blocks", """
WITH u AS (SELECT o_custkey AS doc, o_orderkey % 3 AS page, (o_orderkey % 5)::DOUBLE AS y, o_orderkey AS item, (o_orderstatus = 'O')::INT AS kind FROM orders)
SELECT doc, item, kind, row_number() OVER (PARTITION BY doc ORDER BY page, y DESC, kind, item) AS place FROM u""")
def tables_among_blocks(spark, sf_dir):
    k = F.col("o_orderkey")
    d = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (k % 3).alias("page"), (k % 5).cast("double").alias("y"), k.alias("item"), "o_orderstatus")
    return boxes.placed_among(d.where("o_orderstatus <> 'O'"), d.where("o_orderstatus = 'O'"), ["doc"]).select("doc", "item", "kind", "place")


@query("line_sizes", """
WITH f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS at_, floor((l_quantity / 4)::DOUBLE * 2 + 0.5) / 2 AS size, length(l_returnflag || l_linenumber * l_partkey) AS n FROM lineitem),
g AS (SELECT l_orderkey, size, sum(n) AS n, min(at_) AS at_ FROM f GROUP BY 1, 2)
SELECT l_orderkey, size FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, at_) = 1""")
def line_sizes(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    f = read(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("at"), (F.col("l_quantity") / 4).cast("double").alias("size"), F.concat("l_returnflag", F.col("l_linenumber") * F.col("l_partkey")).alias("text"))
    return lines.line_sizes(f, ["l_orderkey"], "at")


@query("line_pitch", f"""
WITH l AS (SELECT o_custkey AS doc, o_orderkey % 2 AS page, o_orderkey AS line, -(o_orderkey * 3)::DOUBLE AS y, 10.0::DOUBLE + (o_orderkey % 5 = 0)::INT AS size FROM orders),
s AS (SELECT doc, lag(y) OVER w - y AS dy FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY line) QUALIFY size = 10 AND lag(size) OVER w = 10),
k AS (SELECT doc, dy / 10 AS r FROM s WHERE dy > 9 AND dy < 22), m AS (SELECT doc, median(r) AS m FROM k GROUP BY 1),
p AS (SELECT doc, median(r) AS pitch FROM k JOIN m USING (doc) WHERE r < m + 0.25 GROUP BY 1)
SELECT doc, {rounded_sql("coalesce(pitch, 1.25)")} AS pitch FROM (SELECT DISTINCT doc FROM l) LEFT JOIN p USING (doc)""")
def line_pitch(spark, sf_dir):
    k = F.col("o_orderkey")
    d = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (k % 2).alias("page"), k.alias("line"), (-(k * 3)).cast("double").alias("y"), (10.0 + (k % 5 == 0).cast("int")).alias("size"), F.lit("C").alias("side"), F.lit(10.0).alias("body"))
    return lines.line_pitch(d, ["doc"]).select("doc", rounded(F.col("pitch")).alias("pitch"))


@query("contents_pages", """
WITH l AS (SELECT o_custkey AS doc, o_orderkey % 3 = 0 OR o_custkey % 2 = 0 AND o_orderkey % 4 > 0 AS entry FROM orders)
SELECT doc, sum(entry::INT)::BIGINT AS entries, count(*) AS lines FROM l GROUP BY 1 HAVING entries >= 5 AND entries * 10 >= lines * 4""")
def contents_pages(spark, sf_dir):
    """A page per customer with a line per order; some end in a number, arabic or roman, or in a word."""
    k = F.col("o_orderkey")
    end = F.when(k % 3 == 0, F.concat(F.lit(" "), (k % 1000).cast("string"))).when((F.col("o_custkey") % 2 == 0) & (k % 4 > 0), " xiv ").otherwise("")
    d = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.concat("o_orderpriority", end).alias("text"))
    return lines.contents_pages(d, ["doc"])


@query("main_entries")
def main_entries(spark, sf_dir):
    """Orders as outline entries of their customers; tested against a plain walk."""
    k = F.col("o_orderkey")
    d = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (k % 3).alias("page"), F.when(k % 11 != 0, (k % 40).cast("double")).alias("y"), (k % 4).cast("int").alias("level"), k.cast("string").alias("title"))
    return lines.main_entries(d, ["doc"])


@query("headings_in_outline", """
WITH h AS (SELECT p_partkey, p_size AS doc, p_type AS title FROM part), o AS (SELECT p_size AS doc, lower(p_type) AS k, min(p_partkey) AS entry FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2)
SELECT p_partkey, entry FROM h LEFT JOIN o ON o.doc = h.doc AND o.k = lower(h.title)""")
def headings_in_outline(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("doc"), F.col("p_type").alias("title"))
    o = p.where("p_partkey % 2 = 0").select("doc", F.upper("title").alias("title"), F.col("p_partkey").alias("entry"))
    return lines.with_outline(p, o, ["doc"]).select("p_partkey", "entry")


@query("slide_counters")
def slide_counters(spark, sf_dir):
    """Turns as numbered items; tested against a plain walk."""
    c, n = read(spark, sf_dir, "conversations"), F.length(F.coalesce("text", F.lit("")))
    bullet = F.when(n % 7 == 0, "char").when(n % 11 == 0, "none").otherwise("number")
    return lines.slide_counters(c.select("conv_id", "turn", (n % 3).cast("int").alias("level"), bullet.alias("bullet"), (n % 2 + 1).alias("start"), "text"), ["conv_id"], "turn").select("conv_id", "turn", "number")


@query("note_numbers", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS number
FROM lineitem SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p ON p_partkey = l_partkey""")
def note_numbers(spark, sf_dir):
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    r = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", at.alias("at"), F.col("l_partkey").alias("note"), F.lit(0).alias("book"))
    n = read(spark, sf_dir, "part").where("p_size > 10").select(F.lit(0).alias("book"), F.col("p_partkey").alias("note"))
    found = lines.note_numbers(r.withColumn("book", F.col("l_orderkey")), r.select(F.col("l_orderkey").alias("book"), "note").join(n.select("note"), "note", "left_semi"), ["book"], "at")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "number")


@query("print_areas", """
WITH c AS (SELECT l_orderkey AS sheet, l_linenumber AS row, l_partkey % 30 + 1 AS col, l_partkey, l_suppkey FROM lineitem)
SELECT sheet, row, col, l_partkey, l_suppkey FROM c JOIN orders ON o_orderkey = sheet WHERE o_orderstatus = 'F' OR (row BETWEEN 2 AND 4 AND col BETWEEN 3 AND 28)""")
def print_areas(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 30 + 1).alias("col"), "l_partkey", "l_suppkey")
    a = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("sheet"), F.lit("$C$2:AB4").alias("area"))
    return lines.clipped(c, a, ["sheet"])


@query("sheet_references", """
WITH c AS (SELECT p_brand AS sheet, p_size AS row, p_partkey % 5 AS col, max(p_partkey) AS value FROM part WHERE p_partkey % 3 > 0 GROUP BY 1, 2, 3)
SELECT p.p_partkey, CASE WHEN upper(p.p_brand) NOT IN (SELECT upper(sheet) FROM c) OR p.p_partkey % 17 = 0 THEN '#REF!' ELSE c.value::VARCHAR END AS value
FROM part p LEFT JOIN c ON c.sheet = p.p_brand AND c.row = p.p_size AND c.col = p.p_partkey % 5""")
def sheet_references(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("book"), F.col("p_brand").alias("sheet"), F.col("p_size").alias("row"), (F.col("p_partkey") % 5).alias("col"))
    c = p.where("p_partkey % 3 > 0").groupBy("book", "sheet", "row", "col").agg(F.max("p_partkey").alias("value"))
    r = p.withColumn("sheet", F.when(F.col("p_partkey") % 17 == 0, F.concat("sheet", F.lit(" gone"))).otherwise(F.upper("sheet")))
    return lines.referenced(r, c, ["book"]).select("p_partkey", "value")


@query("language_codes", """
SELECT doc_id, CASE WHEN lang IS NOT NULL AND regexp_full_match(trim(lang || '-' || source), '[A-Za-z]{2,3}([-_][A-Za-z0-9]+)*') THEN lower(regexp_extract(lang, '^[A-Za-z]{2,3}')) END AS code FROM documents""")
def language_codes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.language_code(F.concat("lang", F.lit("-"), "source")).alias("code"))


@query("similar_titles", """
SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') LIKE '%' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') || '%'
  OR regexp_replace(lower(p_type || p_brand), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(p_type || ' - ' || p_brand), '[^a-z0-9]+', '', 'g') AND p_size % 2 = 0 AS similar FROM part""")
def similar_titles(spark, sf_dir):
    whole = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(" - "), "p_brand")).otherwise(F.upper("p_type"))
    other = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", "p_brand")).otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", text.similar_titles(whole, other).alias("similar"))


_RGB = "(c_custkey * 37 % 256)::DOUBLE AS r, (c_custkey * 91 % 256)::DOUBLE AS g, (c_custkey * 13 % 256)::DOUBLE AS b"


@query("tinted_colours", f"""
WITH c AS (SELECT c_custkey, {_RGB}, ((c_custkey % 9) - 4) / 5.0::DOUBLE AS tint FROM customer),
h AS (SELECT *, greatest(r, g, b) / 255 AS hi, least(r, g, b) / 255 AS lo FROM c), l AS (SELECT *, (hi + lo) / 2 AS l0, hi - lo AS d FROM h),
s AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN l0 > 0.5 THEN d / (2 - hi - lo) ELSE d / (hi + lo) END AS sat, CASE WHEN tint < 0 THEN l0 * (1 + tint) ELSE l0 * (1 - tint) + tint END AS l1 FROM l),
q AS (SELECT *, CASE WHEN l1 < 0.5 THEN l1 * (1 + sat) ELSE l1 + sat - l1 * sat END AS q FROM s)
SELECT c_custkey, {rounded_sql("q * 255", 3)} AS highest, {rounded_sql("(2 * l1 - q) * 255", 3)} AS lowest FROM q""")
def tinted_colours(spark, sf_dir):
    k = F.col("c_custkey")
    c = F.struct((k * 37 % 256).cast("double").alias("r"), (k * 91 % 256).cast("double").alias("g"), (k * 13 % 256).cast("double").alias("b"))
    d = read(spark, sf_dir, "customer").select("c_custkey", drawing.tinted(c, ((k % 9) - 4) / F.lit(5.0)).alias("t"))
    return d.select("c_custkey", rounded(F.greatest("t.r", "t.g", "t.b"), 3).alias("highest"), rounded(F.least("t.r", "t.g", "t.b"), 3).alias("lowest"))


@query("theme_colours", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '000000' WHEN 1 THEN 'ffffff' WHEN 2 THEN '44546a' WHEN 3 THEN 'ed7d31' WHEN 4 THEN '954f72' ELSE '000000' END AS colour FROM part""")
def theme_colours(spark, sf_dir):
    name = F.get(F.array(*[F.lit(x) for x in ("tx1", "bg1", "dk2", "accent2", "folHlink", "accent9")]), F.col("p_size") % 6)
    return read(spark, sf_dir, "part").select("p_partkey", drawing.theme_colour(name).alias("colour"))


@query("group_boxes", f"""
WITH {_B} SELECT page, box_no, x * 2 + 5 AS x, y * 0.5 - 3 AS y, w * 2 AS w, h * 0.5 AS h FROM b""")
def group_boxes(spark, sf_dir):
    box = drawing.moved(F.struct("x", "y", "w", "h"), F.lit(2.0), F.lit(0.5), F.lit(5.0), F.lit(-3.0))
    return _boxes(spark, sf_dir).select("page", "box_no", box.alias("m")).select("page", "box_no", "m.*")


def _headings(spark, sf_dir):
    """Orders as headings of their customers' documents of 30 pages."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), k.alias("at"), (k % 30).alias("page"), F.lit(30).alias("pages"), (11 + k * 7 % 23 / 2).cast("double").alias("size"), (k % 4 > 0).alias("large"),
        F.when(k % 5 == 0, F.concat(F.lit("Chapter "), k.cast("string"))).otherwise(F.col("o_orderpriority")).alias("text"),
    )


@query("heading_levels")
def heading_levels(spark, sf_dir):
    """Tested against a plain walk."""
    return lines.heading_levels(_headings(spark, sf_dir), ["doc"]).select("doc", "at", "level")


@query("chapter_starts", """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderkey % 30 AS page, o_orderkey // 30 AS n FROM orders), d AS (SELECT c_custkey AS doc, 31 + c_custkey % 3 AS pages FROM customer),
e AS (SELECT doc, min(k)::VARCHAR AS title, page FROM o WHERE doc % 3 = 1 GROUP BY doc, page), two AS (SELECT doc FROM e GROUP BY 1 HAVING count(*) >= 2),
h AS (SELECT doc, (k % 3 + 1)::INT AS level, page, k FROM o WHERE doc % 3 < 2), l AS (SELECT doc, level, count(*) AS n FROM h GROUP BY 1, 2),
f AS (SELECT doc, min(level) AS level FROM l JOIN d USING (doc) WHERE n >= 2 AND n <= greatest(4, ceil(pages / 3)) AND doc NOT IN (SELECT doc FROM two) GROUP BY 1)
SELECT doc, 'outline' AS strategy, page, NULL::DOUBLE AS y, title FROM e WHERE doc IN (SELECT doc FROM two)
UNION ALL SELECT doc, 'headings', page, k::DOUBLE, k::VARCHAR FROM h JOIN f USING (doc, level)
UNION ALL SELECT doc, 'pages', p, NULL, NULL FROM (SELECT doc, unnest(range(0, pages, 15)) AS p FROM d WHERE doc NOT IN (SELECT doc FROM two) AND doc NOT IN (SELECT doc FROM f))""")
def chapter_starts(spark, sf_dir):
    """Customers as documents: a third has an outline, two thirds headings."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (k % 30).alias("page"), k.alias("k"))
    first = o.where("doc % 3 = 1").groupBy("doc", "page").agg(F.min("k").cast("string").alias("title"))
    outline = first.select("doc", "page", F.lit(None).cast("double").alias("y"), F.lit(0).alias("level"), "title")
    heads = o.where("doc % 3 < 2").select("doc", (F.col("k") % 3 + 1).cast("int").alias("level"), "page", F.col("k").cast("double").alias("y"), F.col("k").cast("string").alias("title"))
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (31 + F.col("c_custkey") % 3).alias("pages"))
    return lines.chapter_starts(d, outline, heads, ["doc"])
