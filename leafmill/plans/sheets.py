"""Shared formulas, cell styles, fields and outlines over cells, tokens and nodes made of the tables' rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import boxes, cells, charts, outlines, pixels, runs, styles
from leafmill.plans.common import read
from leafmill.plans.series import query

_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
_CELLS = f"""c AS (SELECT l_orderkey AS sheet, {_PLACE} + 9 AS "row", {_PLACE} % 3 + 1 AS col, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 2 END AS shared FROM lineitem)"""


def _ranked(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("k"))


@query("shared_formulas", f"""
WITH {_CELLS}
SELECT sheet, "row", col, CASE WHEN shared IS NOT NULL THEN '=' || chr((65 + col)::INT) || "row" || '*$B' || "row" || '+"A1"&' || chr((67 + col)::INT) || '$2&SUM(' || chr((64 + col)::INT) || ("row" - 1) || ':$Z$9)' END AS formula FROM c""")
def shared_formulas(spark, sf_dir):
    """A sheet per order with up to two groups; only the first cell of a group has its formula."""
    d = _ranked(spark, sf_dir).select(F.col("l_orderkey").alias("sheet"), (F.col("k") + 9).alias("row"), (F.col("k") % 3 + 1).alias("col"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 2).alias("shared"))
    first = F.row_number().over(Window.partitionBy("sheet", "shared").orderBy("row", "col")) == 1
    own = F.concat(F.lit("="), F.char(F.col("col") + 65), "row", F.lit("*$B"), "row", F.lit('+"A1"&'), F.char(F.col("col") + 67), F.lit("$2&SUM("), F.char(F.col("col") + 64), F.col("row") - 1, F.lit(":$Z$9)"))
    d = d.withColumn("formula", F.when(F.col("shared").isNull(), F.lit(None).cast("string")).when(first, own).otherwise("="))
    return cells.with_shared_formulas(d, ["sheet"]).select("sheet", "row", "col", "formula")


_BUILT_IN = ", ".join(f"({k}, '{v.replace(chr(39), chr(39) * 2)}')" for k, v in cells.BUILT_IN.items())


@query("cell_styles", f"""
WITH x AS (SELECT n_nationkey AS style, n_nationkey % 9 * 6 AS f, n_regionkey AS fo, n_nationkey % 4 AS fi FROM nation), g(id, code) AS (VALUES {_BUILT_IN})
SELECT o_orderkey, coalesce(r.r_name, g.code, 'General') AS format, coalesce(n.r_name, CASE WHEN f0.r_name IS NOT NULL THEN f0.r_name END) AS font, CASE WHEN fi > 0 AND fi < 3 THEN '#00000' || fi END AS fill
FROM orders LEFT JOIN x ON style = o_custkey % 30 LEFT JOIN region r ON x.f = 48 + r.r_regionkey * 6 LEFT JOIN g ON g.id = coalesce(x.f, 0) LEFT JOIN region n ON n.r_regionkey = x.fo AND n.r_regionkey < 4 LEFT JOIN region f0 ON f0.r_regionkey = 0""")
def cell_styles(spark, sf_dir):
    """A cell per order; the style tables come of nations and regions, with styles, fonts and fills that aren't there."""
    none = {"code": "string", "font": "struct<name:string,size:double,bold:boolean,italic:boolean,underline:boolean,strike:boolean,color:string>", "color": "string", "borders": "array<string>", "horizontal": "string", "vertical": "string", "wrap": "boolean", "indent": "int", **dict.fromkeys(("format_id", "font_id", "fill_id", "border_id"), "int")}

    def part(df, kind, idx, **given):
        return df.select(F.lit("b").alias("book"), F.lit(kind).alias("part"), idx.cast("int").alias("idx"), *[given[c].cast(t).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    font = F.struct(F.col("r_name").alias("name"), F.lit(9.0).alias("size"), *[F.lit(False).alias(c) for c in ("bold", "italic", "underline", "strike")], F.lit(None).cast("string").alias("color"))
    styles = part(nation, "xf", n, format_id=n % 9 * 6, font_id=F.col("n_regionkey"), fill_id=n % 4, border_id=F.lit(0))
    styles = styles.unionByName(part(region, "format", 48 + r * 6, code=F.col("r_name"))).unionByName(part(region.where(r < 4), "font", r, font=font))
    styles = styles.unionByName(part(region.where(r < 3), "fill", r, color=F.when(r > 0, F.concat(F.lit("#00000"), r))))
    c = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("b").alias("book"), (F.col("o_custkey") % 30).cast("int").alias("style"))
    return cells.styled(c, styles, ["book"]).select("o_orderkey", F.col("look.format").alias("format"), F.col("look.font.name").alias("font"), F.col("look.fill").alias("fill"))


@query("field_runs", f"""
WITH RECURSIVE t AS (SELECT l_orderkey, {_PLACE} AS k, ['begin', 'separate', 'end', 'text', 'begin', 'text'][l_partkey % 6 + 1] AS kind FROM lineitem),
s AS (SELECT l_orderkey, 0::BIGINT AS k, ''::VARCHAR AS kind, []::BOOLEAN[] AS stack FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL
  SELECT t.l_orderkey, t.k, t.kind, CASE t.kind WHEN 'begin' THEN list_append(stack, false) WHEN 'separate' THEN CASE WHEN len(stack) > 0 THEN list_append(stack[:-2], true) ELSE stack END WHEN 'end' THEN stack[:-2] ELSE stack END
  FROM s JOIN t ON t.l_orderkey = s.l_orderkey AND t.k = s.k + 1)
SELECT l_orderkey, k, len(stack)::INT AS depth, kind = 'text' AND NOT list_contains(stack, false) AS shown FROM s WHERE k > 0""")
def field_runs(spark, sf_dir):
    """An order's lines as marks of nested fields and text."""
    kinds = F.array(*map(F.lit, ("begin", "separate", "end", "text", "begin", "text")))
    d = _ranked(spark, sf_dir).withColumn("kind", F.get(kinds, (F.col("l_partkey") % 6).cast("int")))
    return runs.with_fields(d, ["l_orderkey"], "k").select("l_orderkey", F.col("k").cast("long").alias("k"), "depth", "shown")


@query("outline_rows", """
WITH RECURSIVE n AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, o_orderkey % 5 AS ord FROM orders),
p AS (SELECT doc, id, ord, CASE WHEN id = 1 THEN NULL WHEN id % 7 = 6 THEN -1 WHEN id % 11 = 10 THEN id WHEN id % 5 = 0 THEN id - 1 ELSE id // 2 END AS parent FROM n),
w AS (SELECT doc, id, 0 AS level, [{'o': ord, 'i': id}] AS path FROM p WHERE parent IS NULL OR parent = -1 UNION ALL SELECT p.doc, p.id, level + 1, list_append(path, {'o': p.ord, 'i': p.id}) FROM w JOIN p ON p.doc = w.doc AND p.parent = w.id AND p.id <> p.parent)
SELECT doc, id, level, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS place FROM w""")
def outline_rows(spark, sf_dir):
    """A customer's orders as an outline, with orphans and entries that lie in themselves."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    d = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(w).cast("long").alias("id"), (F.col("o_orderkey") % 5).alias("ord"))
    i = F.col("id")
    parent = F.when(i == 1, None).when(i % 7 == 6, -1).when(i % 11 == 10, i).when(i % 5 == 0, i - 1).otherwise(F.floor(i / 2))
    return outlines.flattened(d.withColumn("parent", parent), ["doc"]).select("doc", "id", F.col("level").cast("int").alias("level"), F.col("place").cast("long").alias("place"))


_OPS = f"""o AS (SELECT l_orderkey AS doc_id, 1 AS page, {_PLACE} AS op_no, ['save', 'restore', 'concat', 'image', 'inline', 'concat', 'begin_form', 'end_form'][l_partkey % 8 + 1] AS op, 'k' || l_suppkey AS key,
  [1.0 + l_quantity % 5, l_suppkey % 2, 0.0, 1.0 + l_suppkey % 3, l_quantity * 4, l_suppkey % 30 * 10]::DOUBLE[] AS m FROM lineitem)"""
_TIMES = "[{0}[1]*{1}[1]+{0}[3]*{1}[2], {0}[2]*{1}[1]+{0}[4]*{1}[2], {0}[1]*{1}[3]+{0}[3]*{1}[4], {0}[2]*{1}[3]+{0}[4]*{1}[4], {0}[1]*{1}[5]+{0}[3]*{1}[6]+{0}[5], {0}[2]*{1}[5]+{0}[4]*{1}[6]+{0}[6]]"


@query("picture_boxes", f"""
WITH RECURSIVE {_OPS},
s AS (SELECT DISTINCT doc_id, 0::BIGINT AS op_no, '' AS op, '' AS key, [1, 0, 0, 1, 0, 0]::DOUBLE[] AS now, []::DOUBLE[][] AS stack, 0 AS n FROM o UNION ALL
  SELECT o.doc_id, o.op_no, o.op, o.key, CASE WHEN o.op IN ('concat', 'begin_form') THEN {_TIMES.format("now", "o.m")} WHEN o.op IN ('restore', 'end_form') AND len(stack) > 0 THEN stack[-1] ELSE now END,
    CASE WHEN o.op IN ('save', 'begin_form') THEN list_append(stack, now) WHEN o.op IN ('restore', 'end_form') THEN stack[:-2] ELSE stack END, n + (o.op = 'inline')::INT FROM s JOIN o ON o.doc_id = s.doc_id AND o.op_no = s.op_no + 1),
b AS (SELECT doc_id, op_no, CASE op WHEN 'image' THEN key ELSE 'inline:' || (n - 1) END AS key, now[5] + least(0, now[1]) + least(0, now[3]) AS xa, now[5] + greatest(0, now[1]) + greatest(0, now[3]) AS xb, now[6] + least(0, now[2]) + least(0, now[4]) AS ya, now[6] + greatest(0, now[2]) + greatest(0, now[4]) AS yb FROM s WHERE op IN ('image', 'inline'))
SELECT doc_id, op_no, key, greatest(0, xa) AS x, greatest(0, ya) AS y, least(400, xb) - greatest(0, xa) AS w, least(600, yb) - greatest(0, ya) AS h FROM b WHERE least(400, xb) - greatest(0, xa) >= 1 AND least(600, yb) - greatest(0, ya) >= 1""")
def picture_boxes(spark, sf_dir):
    """An order's lines as drawing operators of a page; the page's own matrix turns y upside down."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kinds = F.array(*map(F.lit, ("save", "restore", "concat", "image", "inline", "concat", "begin_form", "end_form")))
    q, s = F.col("l_quantity"), F.col("l_suppkey")
    m = F.array(*[c.cast("double") for c in (1 + q % 5, s % 2, F.lit(0), 1 + s % 3, q * 4, s % 30 * 10)])
    ops = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.row_number().over(w).cast("long").alias("op_no"), F.get(kinds, (F.col("l_partkey") % 8).cast("int")).alias("op"), F.concat(F.lit("k"), s).alias("key"), m.alias("matrix"))
    pages = ops.select("doc_id", "page").distinct().withColumns({"width": F.lit(400.0), "height": F.lit(600.0), "view": F.array(*map(F.lit, (1.0, 0.0, 0.0, -1.0, 0.0, 600.0)))})
    return boxes.picture_boxes(ops, pages).select("doc_id", "op_no", "key", "x", "y", "w", "h")


@query("tab_stops", """
WITH t AS (SELECT o_custkey, o_orderkey % 4 * 36 AS pos, o_orderkey % 3 AS level, o_orderkey AS ord, ['left', 'clear', 'right'][o_orderkey % 7 % 3 + 1] AS kind FROM orders)
SELECT o_custkey, pos, kind FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey, pos ORDER BY level DESC, ord DESC) = 1 AND kind <> 'clear'""")
def tab_stops(spark, sf_dir):
    """A customer's orders as the tab stops of three levels."""
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("left", "clear", "right")))
    d = read(spark, sf_dir, "orders").select("o_custkey", (k % 4 * 36).alias("pos"), (k % 3).alias("level"), k.alias("ord"), F.get(kinds, (k % 7 % 3).cast("int")).alias("kind"))
    return styles.tab_stops(d, ["o_custkey"])


@query("text_overflow", f"""
WITH p AS (SELECT l_orderkey AS sheet, {_PLACE} AS k, l_partkey, l_suppkey, l_quantity FROM lineitem),
c AS (SELECT sheet, k % 2 AS "row", k * 2 AS col, l_partkey % 60 AS n, l_suppkey % 5 = 0 AS wrap, l_suppkey % 3 AS h, l_quantity = 1 AS merged FROM p),
w AS (SELECT col, 20.0::DOUBLE + col % 3 * 15 AS width FROM range(1, 17) t(col)),
s AS (SELECT sheet, "row", col, lead(col) OVER (PARTITION BY sheet, "row" ORDER BY col) AS nxt FROM (SELECT sheet, "row", col FROM c WHERE n > 0 OR merged UNION SELECT sheet, "row", col + 3 FROM c WHERE merged))
SELECT c.sheet, c."row", c.col, CASE WHEN n = 0 OR wrap OR merged OR h = 2 THEN 1 ELSE greatest(1, (SELECT count(*) FROM w WHERE w.col >= c.col AND (nxt IS NULL OR w.col < nxt) AND (w.col = c.col OR (SELECT sum(width) FROM w v WHERE v.col >= c.col AND v.col < w.col) < n * 11 * 0.62 * (96.0::DOUBLE / 72) + 6))) END::INT AS span
FROM c LEFT JOIN s USING (sheet, "row", col)""")
def text_overflow(spark, sf_dir):
    """A sheet per order, cells two columns apart; a merged cell covers the one three columns on."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    d = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.row_number().over(w).cast("long").alias("k"), "l_partkey", "l_suppkey", "l_quantity")
    c = d.select(
        "sheet", (F.col("k") % 2).alias("row"), (F.col("k") * 2).alias("col"), F.repeat(F.lit("x"), (F.col("l_partkey") % 60).cast("int")).alias("text"), F.lit(True).alias("is_text"), F.lit(11.0).alias("size"),
        (F.col("l_suppkey") % 5 == 0).alias("wrap"), F.get(F.array(*map(F.lit, ("general", "left", "center"))), (F.col("l_suppkey") % 3).cast("int")).alias("horizontal"), (F.col("l_quantity") == 1).alias("merged"),
    )
    columns = c.select("sheet").distinct().withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(16)))).withColumns({"col": F.col("col").cast("long"), "width": 20.0 + F.col("col") % 3 * 15})
    covered = c.where("merged").select("sheet", "row", (F.col("col") + 3).alias("col"))
    return cells.with_overflow(c, columns, covered, ["sheet"]).select("sheet", "row", "col", "span")


_SHEETS = ["Data", "It's", "A b", "X!y"]
_NAMES = ["Data", "'It''s'", "'A b'", "'X!y'"]


@query("series_caches", f"""
WITH c AS (SELECT l_orderkey AS book, ['Data', 'It''s', 'A b', 'X!y'][l_orderkey % 4 + 1] AS sheet, {_PLACE} AS "row", l_partkey % 3 + 1 AS col, CASE l_suppkey % 3 WHEN 0 THEN 'n' || l_suppkey ELSE l_partkey::VARCHAR END AS text FROM lineitem),
o AS (SELECT o_orderkey AS book, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_totalprice) AS series, o_custkey % 2 = 0 AS num, CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 5 END AS n, o_custkey % 3 + 1 AS a, o_custkey % 7 AS h, o_custkey % 9 = 5 AS lost FROM orders),
f AS (SELECT book, series, num, unnest(range(n)) AS idx, true AS there FROM o WHERE n > 0),
w AS (SELECT f.*, CASE WHEN idx % 2 = 0 THEN 'p' || idx END AS text FROM f UNION ALL
  SELECT o.book, series, num, (r - 1) * a + k - 1, true, text FROM o, range(1, 9) r(r), range(1, 4) k(k) LEFT JOIN c ON c.book = o.book AND c."row" = r AND c.col = k WHERE n IS NULL AND NOT lost AND r <= h + 1 AND k <= a AND o.book IN (SELECT book FROM c) UNION ALL
  SELECT book, series, num, NULL, false, NULL FROM o WHERE n IS NULL AND (lost OR book NOT IN (SELECT book FROM c)))
SELECT book, series, idx, CASE WHEN NOT num AND there THEN coalesce(text, '') END AS text, CASE WHEN num THEN try_cast(text AS DOUBLE) END AS value FROM w""")
def series_caches(spark, sf_dir):
    """A chart series per order over the cells of its lines; a quarter has caches, some point to a sheet that isn't there."""
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    c = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book"), pick(_SHEETS, F.col("l_orderkey") % 4).alias("sheet"), F.row_number().over(w).alias("row"), (F.col("l_partkey") % 3 + 1).alias("col"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("n"), "l_suppkey")).otherwise(F.col("l_partkey").cast("string")).alias("text"),
    )
    k, w = F.col("o_custkey"), Window.partitionBy("o_orderkey").orderBy("o_custkey", "o_totalprice")
    last = F.concat(F.lit("$"), F.char(F.lit(65) + k % 3), F.lit("$"), k % 7 + 1)
    name = F.when(k % 9 == 5, "Nowhere").otherwise(pick(_NAMES, F.col("o_orderkey") % 4))
    cached = F.when(k % 4 == 0, k % 5)
    points = F.when(cached > 0, F.transform(F.filter(F.sequence(F.lit(0).cast("long"), cached - 1), lambda i: i % 2 == 0), lambda i: F.struct(i.alias("idx"), F.concat(F.lit("p"), i).alias("text"))))
    s = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("book"), F.row_number().over(w).cast("long").alias("series"), F.when(k % 2 == 0, "number").otherwise("text").alias("kind"),
        F.when(k % 5 == 0, F.concat(name, F.lit("!"), last, F.lit(":A1"))).otherwise(F.concat(name, F.lit("!$A$1:"), last)).alias("formula"), cached.alias("n"), points.alias("points"),
    )
    return charts.filled(s, c, ["book"], ["series"])


_RASTER = "SELECT l_suppkey % 20 AS page, l_partkey % 60 AS x, l_orderkey % 80 AS y, max((l_quantity * 5)::INT) AS r, max(l_linenumber % 7 * 36) AS g, max(l_suppkey * 7 % 256) AS b FROM lineitem WHERE {} GROUP BY ALL"


@query("text_colours", f"""
WITH a AS ({_RASTER.format("true")}), b AS ({_RASTER.format("l_linenumber <> 2")}),
f AS (SELECT doc_id, doc_id % 20 AS page, doc_id * 7 % 110 - 4.0 AS x, doc_id * 11 % 170 - 5.0 AS y, length(text) % 40 + 5.0 AS width, 8.0 + doc_id % 9 AS size FROM documents),
d AS (SELECT f.doc_id, a.*, abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) AS d FROM f JOIN a ON a.page = f.page JOIN b ON b.page = a.page AND b.x = a.x AND b.y = a.y
  WHERE a.x >= greatest(0, floor(f.x * 0.5)) AND a.x < least(60, ceil((f.x + width) * 0.5)) AND a.y >= greatest(0, floor((160 - (f.y + size * 0.8)) * 0.5)) AND a.y < least(80, ceil((160 - (f.y - size * 0.25)) * 0.5))),
t AS (SELECT *, max(d) OVER (PARTITION BY doc_id) AS t FROM d), m AS (SELECT doc_id, floor(avg(r) + 0.5)::INT AS r, floor(avg(g) + 0.5)::INT AS g, floor(avg(b) + 0.5)::INT AS b, count(*) AS n, max(t) AS t FROM t WHERE d >= t * 0.8 GROUP BY 1)
SELECT doc_id, coalesce(CASE WHEN t >= 90 AND n >= 2 THEN printf('%02X%02X%02X', {", ".join(f"CASE WHEN {c} <= 10 THEN 0 WHEN {c} >= 245 THEN 255 ELSE {c} END" for c in "rgb")}) END, '000000') AS colour FROM f LEFT JOIN m USING (doc_id)""")
def text_colours(spark, sf_dir):
    """A fragment per document on twenty pages whose pixels are made of lines; without one kind of line they are bare."""
    d = read(spark, sf_dir, "lineitem")

    def raster(rows):
        rows = rows.select((F.col("l_suppkey") % 20).alias("page"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 80).alias("y"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_linenumber") % 7 * 36).alias("g"), (F.col("l_suppkey") * 7 % 256).alias("b"))
        return rows.groupBy("page", "x", "y").agg(*[F.max(c).alias(c) for c in "rgb"])

    i = F.col("doc_id")
    f = read(spark, sf_dir, "documents").select("doc_id", (i % 20).alias("page"), (i * 7 % 110 - 4.0).alias("x"), (i * 11 % 170 - 5.0).alias("y"), (F.length("text") % 40 + 5.0).alias("width"), (8.0 + i % 9).alias("size"))
    pages = f.select("page").distinct().withColumns({"width": F.lit(120.0), "height": F.lit(160.0), "across": F.lit(60).cast("long"), "down": F.lit(80).cast("long")})
    return pixels.coloured(f, pages, raster(d), raster(d.where("l_linenumber <> 2")), ["page"], ["doc_id"], tile=32).select("doc_id", "colour")
