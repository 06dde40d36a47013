"""Styles, lists, colours and file names over the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import drawing, text
from leafmill.operators import styles
from leafmill.plans.common import PAGE_NUMBER, page_parts_sql, read, rounded, rounded_sql
from leafmill.plans.series import query
from leafmill.sources import sinks


@query("style_inheritance", """
WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS based_on FROM part),
r(id, at_, d) AS (SELECT id, id, 0 FROM s UNION ALL SELECT r.id, s.based_on, d + 1 FROM r JOIN s ON s.id = r.at_ WHERE s.based_on IS NOT NULL AND d < 30),
p AS (SELECT p_partkey AS style, p_brand AS prop, p_type AS value FROM part WHERE p_size < 10)
SELECT r.id, prop, arg_min(value, d) AS value FROM r JOIN p ON p.style = r.at_ GROUP BY 1, 2""")
def style_inheritance(spark, sf_dir):
    """Parts as a tree of styles: the nearest ancestor that sets a property."""
    p = read(spark, sf_dir, "part")
    tree = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("based_on"))
    props = p.where("p_size < 10").select(F.col("p_partkey").alias("style"), F.col("p_brand").alias("prop"), F.col("p_type").alias("value"))
    return styles.inherited(tree, props, 32)


_LEVEL = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END"


@query("list_counters", f"""
WITH c AS (SELECT conv_id, turn, {_LEVEL} AS lv FROM conversations),
r AS (SELECT *, sum((lv < 1)::INT) OVER w AS r1, sum((lv < 2)::INT) OVER w AS r2, sum((lv = 0)::INT) OVER w AS c0 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum((lv = 1)::INT) OVER (PARTITION BY conv_id, r1 ORDER BY turn) AS c1, sum((lv = 2)::INT) OVER (PARTITION BY conv_id, r2 ORDER BY turn) AS c2 FROM r)
SELECT conv_id, turn, concat_ws('.', greatest(c0, 1)::VARCHAR, CASE WHEN lv >= 1 THEN greatest(c1, 1)::VARCHAR END, CASE WHEN lv >= 2 THEN greatest(c2, 1)::VARCHAR END) AS label FROM n""")
def list_counters(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_LEVEL).alias("lv"))
    return styles.level_counters(c, ["conv_id"], "turn", "lv", 3).select("conv_id", "turn", "label")


@query("outline_parents", f"""
WITH c AS (SELECT conv_id, turn, {_LEVEL} AS lv FROM conversations)
SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.lv < a.lv GROUP BY 1, 2""")
def outline_parents(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_LEVEL).alias("lv"))
    return styles.outline_parents(c, ["conv_id"], "turn", "lv", 3).select("conv_id", "turn", "parent")


@query("paragraph_spacing", """
SELECT conv_id, turn, CASE WHEN coalesce(lag(role) OVER w = role, false) THEN 0.0 ELSE (length(text) % 13)::DOUBLE + coalesce(lag((length(text) % 7)::DOUBLE) OVER w, 0) END AS gap
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def paragraph_spacing(spark, sf_dir):
    n = F.length("text")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("style"), (n % 13).cast("double").alias("before"), (n % 7).cast("double").alias("after"), F.lit(True).alias("contextual"))
    return styles.spacing(c, ["conv_id"], "turn").select("conv_id", "turn", "gap")


@query("table_bands", """
WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r, (l_partkey % 4) AS k FROM lineitem),
m AS (SELECT *, max(r) OVER (PARTITION BY l_orderkey) AS lr, max(k) OVER (PARTITION BY l_orderkey) AS lk FROM c)
SELECT l_orderkey, r AS row, CASE WHEN r = 0 THEN 'first row' WHEN r = lr THEN 'last row' WHEN k = 0 THEN 'first column' WHEN k = lk THEN 'last column' WHEN (r - 1) % 2 = 0 THEN 'odd row' ELSE 'even row' END AS part FROM m""")
def table_bands(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).cast("long").alias("row"), (F.col("l_partkey") % 4).alias("col"))
    return styles.banded(c, ["l_orderkey"]).select("l_orderkey", "row", "part")


@query("column_bands")
def column_bands(spark, sf_dir):
    """Widths packed from left to right into bands of 150; tested against a plain loop."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    c = read(spark, sf_dir, "lineitem").select("l_suppkey", F.row_number().over(w).cast("long").alias("i"), F.col("l_quantity").alias("w"))
    return styles.column_bands(c, ["l_suppkey"], "i", "w", 150.0)


@query("span_compaction", """
WITH s AS (SELECT conv_id, turn, role = 'assistant' AS bold, text AS t FROM conversations),
n AS (SELECT *, CASE WHEN coalesce(lag(bold) OVER w <> bold, true) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT conv_id, run::BIGINT AS run, bold, string_agg(t, '' ORDER BY turn) AS t FROM r GROUP BY ALL""")
def span_compaction(spark, sf_dir):
    s = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("bold"), F.col("text").alias("t"))
    return styles.compacted(s, ["conv_id"], "turn", "bold", "t")


@query("html_blocks", """
WITH b AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'h1' WHEN 'user' THEN 'p' ELSE 'ul' END AS kind, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS t FROM conversations),
n AS (SELECT *, kind = 'ul' AND coalesce(lag(kind) OVER w <> kind, true) AS o, kind = 'ul' AND coalesce(lead(kind) OVER w <> kind, true) AS c FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, string_agg(CASE WHEN o THEN '<ul>' ELSE '' END || CASE WHEN kind = 'ul' THEN '<li>' || t || '</li>' ELSE '<' || kind || '>' || t || '</' || kind || '>' END || CASE WHEN c THEN '</ul>' ELSE '' END, '' ORDER BY turn) AS html FROM n GROUP BY 1""")
def html_blocks(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "h1").when(F.col("role") == "user", "p").otherwise("ul")
    return styles.html_blocks(read(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), "text"), ["conv_id"], "turn")


@query("sheet_names", """
WITH b AS (SELECT p_partkey, left(p_type, 31) AS base FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY p_partkey) AS k FROM b)
SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE left(base, (31 - length(' (' || k || ')'))::INT) || ' (' || k || ')' END AS sheet_name FROM k""")
def sheet_names(spark, sf_dir):
    return sinks.sheet_names(read(spark, sf_dir, "part"), "p_type", "p_partkey").select("p_partkey", "sheet_name")


@query("colour_mix", """
WITH c AS (SELECT p_partkey, (p_partkey * 37 % 256)::INT AS r, (p_partkey * 91 % 256)::INT AS g, (p_size * 5 % 256)::INT AS b FROM part)
SELECT p_partkey, printf('%02X%02X%02X', floor(r * 0.75 + 63.75 + 0.5)::INT, floor(g * 0.75 + 63.75 + 0.5)::INT, floor(b * 0.75 + 63.75 + 0.5)::INT) AS lighter, (greatest(r, g, b) + least(r, g, b)) / 510.0::DOUBLE AS lightness FROM c""")
def colour_mix(spark, sf_dir):
    """A quarter of white over each part's colour."""
    c = drawing.rgb(drawing.hex_of(F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 91 % 256, F.col("p_size") * 5 % 256))
    d = read(spark, sf_dir, "part").withColumn("c", c)
    return d.select("p_partkey", drawing.mixed(F.col("c"), drawing.rgb(F.lit("#FFFFFF")), 0.25).alias("lighter"), drawing.lightness(F.col("c")).alias("lightness"))


@query("page_fit", f"""
WITH f AS (SELECT p_partkey, p_retailprice AS w, p_size::DOUBLE AS h, least(960.0 / p_retailprice, 540.0 / p_size) AS s FROM part)
SELECT p_partkey, {rounded_sql('s', 6)} AS scale, {rounded_sql('(960.0 - w * s) / 2', 6)} AS dx, {rounded_sql('(540.0 - h * s) / 2', 6)} AS dy, {rounded_sql('w / 12700.0', 6)} AS pt FROM f""")
def page_fit(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", drawing.fit(F.col("p_retailprice"), F.col("p_size").cast("double"), 960.0, 540.0).alias("f"))
    return d.select("p_partkey", *[rounded(F.col(f"f.{c}"), 6).alias(c) for c in ("scale", "dx", "dy")], rounded(drawing.points(F.col("p_retailprice"), "emu"), 6).alias("pt"))


@query("file_names", r"""
WITH u AS (SELECT page_id, strlen(html) AS n, regexp_replace(url, '^https?://', '') AS p FROM pages)
SELECT page_id, regexp_replace(string_split(p, '/')[-1], '\.[^.]*$', '') AS base, CASE WHEN n < 1024 THEN n || ' B' WHEN n >= 1048576 THEN (n * 10 // 1048576) // 10 || '.' || (n * 10 // 1048576) % 10 || ' MB' ELSE (n * 10 // 1024) // 10 || '.' || (n * 10 // 1024) % 10 || ' KB' END AS size FROM u""")
def file_names(spark, sf_dir):
    n, p = F.octet_length("html"), F.regexp_replace("url", "^https?://", "")
    return read(spark, sf_dir, "pages").select("page_id", drawing.base_name(p).alias("base"), drawing.byte_size(n).alias("size"))


@query("text_colour", """
WITH p AS (SELECT user_id % 50 AS k, (event_id * 13 % 256)::INT AS r, (event_id * 29 % 256)::INT AS g, (event_id * 53 % 256)::INT AS b FROM events),
d AS (SELECT *, (255 - r) + (255 - g) + (255 - b) AS d FROM p), t AS (SELECT *, max(d) OVER (PARTITION BY k) AS t FROM d), m AS (SELECT k, avg(r) AS r, avg(g) AS g, avg(b) AS b, count(*) AS n, max(t) AS t FROM t WHERE d >= t * 0.8 GROUP BY 1)
SELECT k, CASE WHEN t >= 90 AND n >= 2 THEN printf('%02X%02X%02X', CASE WHEN floor(r + 0.5) <= 10 THEN 0 WHEN floor(r + 0.5) >= 245 THEN 255 ELSE floor(r + 0.5) END::INT, CASE WHEN floor(g + 0.5) <= 10 THEN 0 WHEN floor(g + 0.5) >= 245 THEN 255 ELSE floor(g + 0.5) END::INT, CASE WHEN floor(b + 0.5) <= 10 THEN 0 WHEN floor(b + 0.5) >= 245 THEN 255 ELSE floor(b + 0.5) END::INT) END AS colour FROM m""")
def text_colour(spark, sf_dir):
    """Pixels made from events, on white."""
    e = read(spark, sf_dir, "events")
    p = e.select((F.col("user_id") % 50).alias("k"), *[(F.col("event_id") * f % 256).alias(c) for c, f in (("r", 13), ("g", 29), ("b", 53))], *[F.lit(255).alias(c) for c in ("r0", "g0", "b0")])
    return drawing.text_colour(p, ["k"])


@query("property_precedence", """
SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 200000 THEN 'direct' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'paragraph' END, n_name, 'default') AS value
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000 LEFT JOIN nation ON n_nationkey = c_nationkey""")
def property_precedence(spark, sf_dir):
    """Direct value, paragraph, table style, default: the first that is set."""
    o, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", "c_nationkey")
    d = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, n.n_nationkey == F.col("c_nationkey"), "left")
    direct, par = F.when(F.col("o_totalprice") > 200000, "direct"), F.when(F.col("o_orderpriority").startswith("1"), "paragraph")
    return d.select("o_orderkey", styles.first_of(direct, par, F.col("n_name"), F.lit("default")).alias("value"))


@query("scanned_documents", "SELECT conv_id, sum(length(text)) < 20 * count(*) AS scanned, avg((regexp_matches(text, '^[a-zß-öø-ÿ]'))::INT) >= 0.4 AS set_in_columns FROM conversations GROUP BY 1")
def scanned_documents(spark, sf_dir):
    """Fewer than twenty characters a page; many cells that start small."""
    low = F.avg(F.col("text").rlike("^[a-zß-öø-ÿ]").cast("int")) >= 0.4
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) < 20 * F.count("*")).alias("scanned"), low.alias("set_in_columns"))


@query("page_number_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n FROM {page_parts_sql("l", "line")} WHERE {PAGE_NUMBER} GROUP BY 1""")
def page_number_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(text.page_number(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("line_joins", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT *, lead(line) OVER w AS next, bool_and(line = '') OVER w AS ahead FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, md5(string_agg(CASE WHEN ahead THEN '' WHEN next IS NULL THEN line WHEN line LIKE '%-' AND regexp_matches(next, '^[a-zß-öø-ÿ]') THEN left(line, (length(line) - 1)::INT) ELSE line || ' ' END, '' ORDER BY i)) AS joined_md5
FROM n GROUP BY 1""")
def line_joins(spark, sf_dir):
    """Lines to running text, hyphens joined; blank lines before the first other one are dropped."""
    from leafmill.operators.tables import joined_lines

    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(joined_lines(F.split("text", "\n"))).alias("joined_md5"))
