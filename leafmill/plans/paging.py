"""Paragraphs and running lines of pages made of the documents' texts."""

from pyspark.sql import functions as F

from leafmill.operators import paragraphs
from leafmill.plans.common import PAGE_NUMBER, page_parts_sql, read
from leafmill.plans.series import query

# Nine words to a line and forty lines to a page; how a document sets paragraphs apart goes by its id, and every fourth page has
# two columns.
_LINES = """ws AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda w: w <> '') AS ws FROM documents),
k AS (SELECT doc_id, unnest(range((len(ws) + 8) // 9)) AS k, ws FROM ws),
i AS (SELECT doc_id, k // 40 AS page, k % 40 AS i, k, array_to_string(ws[k * 9 + 1 : k * 9 + 9], ' ') AS text, CASE WHEN k // 40 % 4 = 3 THEN CASE WHEN k % 40 < 20 THEN 'I' ELSE 'D' END WHEN k % 40 = 0 AND doc_id % 2 = 0 THEN 'C' ELSE 'U' END AS side FROM k),
l AS (SELECT doc_id, page::INT AS page, i::INT AS line, text, side, CASE side WHEN 'D' THEN 210.0 ELSE 50.0 END::DOUBLE + CASE WHEN doc_id % 3 = 0 AND k % 7 = 3 THEN 12 ELSE 0 END AS x0,
  CASE side WHEN 'I' THEN 190.0 ELSE 350.0 END::DOUBLE - CASE WHEN doc_id % 5 < 3 AND k % 7 = 2 OR doc_id % 5 = 4 AND k % 2 = 0 THEN 90 ELSE 0 END AS x1,
  580.0::DOUBLE - CASE WHEN side IN ('I', 'D') THEN i % 20 ELSE i END * 13 - CASE WHEN doc_id % 4 = 1 THEN i // 9 * 8 ELSE 0 END AS y,
  CASE WHEN k % 29 = 0 THEN 16.0 ELSE 11.0 END::DOUBLE AS size, k % 17 = 0 AS bold, k % 47 = 9 AS italic, k % 31 IN (5, 6, 7) AS mono, k % 37 = 20 AS picture FROM i)"""


def _lines(spark, sf_dir):
    ws = F.filter(F.split("text", "[ \n\t\r]+"), lambda w: w != "")
    d = read(spark, sf_dir, "documents").select("doc_id", ws.alias("ws")).where("size(ws) > 0")
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 9).cast("int")), lambda k: F.array_join(F.slice("ws", k * 9 + 1, F.lit(9)), " "))
    d = d.select("doc_id", F.posexplode(rows).alias("k", "text")).withColumns({"page": F.floor(F.col("k") / 40).cast("int"), "line": F.col("k") % 40})
    k, i, doc = F.col("k"), F.col("line"), F.col("doc_id")
    d = d.withColumn("side", F.when(F.col("page") % 4 == 3, F.when(i < 20, "I").otherwise("D")).when((i == 0) & (doc % 2 == 0), "C").otherwise("U"))
    two = F.col("side").isin("I", "D")
    short = ((doc % 5 < 3) & (k % 7 == 2)) | ((doc % 5 == 4) & (k % 2 == 0))
    return d.select(
        "doc_id", "page", "line", "text", "side", (F.when(F.col("side") == "D", 210.0).otherwise(50.0) + F.when((doc % 3 == 0) & (k % 7 == 3), 12.0).otherwise(0.0)).alias("x0"),
        (F.when(F.col("side") == "I", 190.0).otherwise(350.0) - F.when(short, 90.0).otherwise(0.0)).alias("x1"),
        (F.lit(580.0) - F.when(two, i % 20).otherwise(i) * 13 - F.when(doc % 4 == 1, F.floor(i / 9) * 8).otherwise(0)).alias("y"),
        F.when(k % 29 == 0, 16.0).otherwise(11.0).alias("size"), (k % 17 == 0).alias("bold"), (k % 47 == 9).alias("italic"), (k % 31).isin(5, 6, 7).alias("mono"), (k % 37 == 20).alias("picture"),
    )


_BODY = """b AS (SELECT doc_id, arg_max(s, (n, -s)) AS body FROM (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS s, sum(length(text)) AS n FROM l WHERE NOT picture GROUP BY 1, 2) GROUP BY 1),
lb AS (SELECT l.*, coalesce(body, 11.0) AS body FROM l LEFT JOIN b USING (doc_id))"""


def _margins(name: str, keys: str) -> str:
    """Left and right of groups of lines."""
    return f"""{name}_u AS (SELECT {keys}, arg_max(bx, (n, -f)) AS usual FROM (SELECT {keys}, floor(x0 / 2.0 + 0.5) * 2.0 AS bx, count(*) AS n, min(line) AS f FROM lb WHERE NOT picture AND abs(size - body) <= 1 GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT {keys}, n, CASE WHEN nl >= 3 THEN usual ELSE coalesce(mn, 0) END AS ml, CASE WHEN nl >= 3 THEN xs[least(nl - 1, floor(nl * 0.9)::BIGINT) + 1] ELSE coalesce(mx, 0) END AS mr
  FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (NOT picture AND abs(size - body) <= 1) AS nl, list(x1 ORDER BY x1) FILTER (NOT picture AND abs(size - body) <= 1) AS xs, min(x0) FILTER (NOT picture) AS mn, max(x1) FILTER (NOT picture) AS mx FROM lb GROUP BY ALL) LEFT JOIN {name}_u USING ({keys}))"""


_MARK = paragraphs.text.MARK.replace("'", "''")
_CONTEXT = f"""{_LINES}, {_BODY}, {_margins("mp", "doc_id, page")}, {_margins("ms", "doc_id, page, side")},
m AS (SELECT lb.*, mp.ml AS pl, mp.mr AS pr, coalesce(ms.ml, mp.ml) AS ml, coalesce(ms.mr, mp.mr) AS mr, regexp_matches(text, '{_MARK}') AS marked FROM lb JOIN mp USING (doc_id, page) LEFT JOIN (SELECT * FROM ms WHERE n >= 3) ms USING (doc_id, page, side)),
p AS (SELECT *, lag(y) OVER w AS py, lag(size) OVER w AS ps, lag(side) OVER w AS pside, lag(picture) OVER w AS pp, lag(text) OVER w AS pt, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(mono) OVER w AS pmono FROM m WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
st AS (SELECT doc_id, (py - y) / body AS step FROM p WHERE NOT picture AND NOT pp AND abs(size - body) <= 0.6 AND abs(ps - body) <= 0.6 AND side = pside AND py - y > body * 0.9 AND py - y < body * 2.2),
sm AS (SELECT doc_id, median(step) AS md FROM st GROUP BY 1), pt AS (SELECT doc_id, median(step) AS pitch FROM st JOIN sm USING (doc_id) WHERE step < md + 0.25 GROUP BY 1),
q AS (SELECT p.*, coalesce(pitch, 1.25) AS pitch FROM p LEFT JOIN pt USING (doc_id)),
g AS (SELECT *, CASE WHEN side IN ('I', 'D') THEN ml ELSE pl END AS gl, CASE WHEN side IN ('I', 'D') THEN mr ELSE pr END AS gr, coalesce(NOT pp AND pside = side AND abs(ps - body) <= 0.6, false) AS pair FROM q WHERE NOT picture AND abs(size - body) <= 0.6),
sg AS (SELECT doc_id, count(*) FILTER (pair AND py - y > body * (pitch + 0.5)) AS gaps, count(*) FILTER (pair) AS pairs, count(*) FILTER (side <> 'C' AND x0 - pl > size * 0.75 AND NOT marked) AS indents,
  count(*) FILTER (side <> 'C') AS total, count(*) FILTER (side <> 'C' AND x1 >= gr - (gr - gl) * 0.03) AS filled FROM g GROUP BY 1)"""


@query("paragraph_signals", f"WITH {_CONTEXT} SELECT doc_id, gaps >= 3 AND gaps >= pairs * 0.02 AS spaced, indents >= 3 AS indented, total > 0 AND filled * 2 >= total AS justified FROM sg")
def paragraph_signals(spark, sf_dir):
    return paragraphs.in_context(_lines(spark, sf_dir)).groupBy("doc_id", "spaced", "indented", "justified").agg(F.max((~F.col("picture") & (F.abs(F.col("size") - F.col("body")) <= 0.6)).cast("int")).alias("any")).where("any = 1").drop("any")


_ENDS, _UPPER = """regexp_matches(trim({}), '[.!?…:;]["''”’»)\\]]*$')""", """regexp_matches(trim({}), '^["''“‘«(\\[¿¡]*[A-ZÀ-ÖØ-Þ]')"""
_LEADER = """(length(rtrim({0})) - length(rtrim(rtrim({0}), '0123456789')) BETWEEN 1 AND 4 AND (ends_with(replace(rtrim(rtrim(rtrim({0}), '0123456789')), ' ', ''), '...') OR ends_with(rtrim(rtrim(rtrim({0}), '0123456789')), '…')))"""


@query("paragraph_starts", f"""
WITH {_CONTEXT}
SELECT doc_id, page, line, CASE WHEN pt IS NULL OR pp OR picture THEN true WHEN (mono AND trim(text) <> '') <> (pmono AND trim(pt) <> '') THEN true WHEN mono AND trim(text) <> '' THEN pside <> side OR py - y > greatest(size, ps) * 2.2
  WHEN pside <> side AND NOT (pside = 'C' AND side = 'I' AND abs(size - ps) < 0.5 AND size >= body * 1.12 AND py - y > 0 AND py - y <= size * 1.7) THEN true
  WHEN abs(size - ps) > 0.7 AND greatest(size, ps) >= body * 1.1 THEN true WHEN py - y > greatest(size, ps) * (pitch + 0.5) THEN true WHEN marked THEN true WHEN {_LEADER.format("pt")} OR {_LEADER.format("text")} THEN true
  WHEN x0 - ml > size * 0.75 AND NOT px0 - ml > ps * 0.75 THEN true WHEN total > 0 AND filled * 2 >= total AND mr > ml AND px1 < mr - (mr - ml) * 0.12 AND abs(ps - body) <= 1 THEN true
  WHEN NOT coalesce(gaps >= 3 AND gaps >= pairs * 0.02, false) AND NOT coalesce(indents >= 3, false) AND mr > ml AND px1 < mr - (mr - ml) * 0.25 AND {_ENDS.format("pt")} AND {_UPPER.format("text")} THEN true ELSE false END AS starts
FROM q LEFT JOIN sg USING (doc_id)""")
def paragraph_starts(spark, sf_dir):
    return paragraphs.paragraph_starts(paragraphs.in_context(_lines(spark, sf_dir))).select("doc_id", "page", "line", "starts")


# Pages with a header that names the document's chapter, a body line near the upper edge, and a number; every page of a document with
# an odd id has a two-line folio instead.
_EDGES = f"""{_LINES.replace("l AS (", "l0 AS (")}, pg AS (SELECT doc_id, page, 2 + max(line) AS last FROM l0 GROUP BY 1, 2),
l AS (SELECT doc_id, page, line, text, side, y - 30 AS y, size, bold, italic, mono, picture, 600.0::DOUBLE AS height FROM l0 UNION ALL
  SELECT doc_id, page, -2, CASE WHEN doc_id % 2 = 0 THEN 'Report ' || doc_id ELSE 'On the matter x' || chr(97 + page::INT % 26) END, 'U', 592.0, 9.0, false, false, false, false, 600.0 FROM pg UNION ALL
  SELECT doc_id, page, -1, CASE WHEN doc_id % 2 = 0 THEN 'body again' ELSE '| ' || page END, 'U', CASE WHEN doc_id % 2 = 0 THEN 563.0 ELSE 582.0 END, CASE WHEN doc_id % 2 = 0 THEN 11.0 ELSE 9.0 END, false, false, false, false, 600.0 FROM pg UNION ALL
  SELECT doc_id, page, last, CASE WHEN doc_id % 3 = 0 THEN '- ' || (page + 1) || ' -' ELSE 'end ' || (page + 1) END, 'U', 12.0, 11.0, false, false, false, false, 600.0 FROM pg)"""
_NUM = "(regexp_full_match({0}, '[0-9]{{1,4}}|[ivxlcdm]{{1,7}}'))"
_KEY = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))"


@query("running_headers", f"""
WITH {_EDGES}, {_BODY}, d AS MATERIALIZED (SELECT *, CASE WHEN y > height * 0.9 THEN 1 WHEN y < height * 0.1 THEN -1 END AS z FROM lb WHERE NOT picture),
gp AS (SELECT doc_id, lag(y) OVER w - y AS gap, side = lag(side) OVER w AND abs(size - body) <= 1 AND abs(lag(size) OVER w - body) <= 1 AS ok FROM d WHERE z IS NULL WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
us AS (SELECT doc_id, list(gap ORDER BY gap)[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS usual FROM gp WHERE ok GROUP BY 1),
np AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
e0 AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws, {_KEY.format("text")} AS k FROM d WHERE z IS NOT NULL),
e1 AS (SELECT *, CASE WHEN len(ws) > 1 AND {_NUM.format("ws[1]")} THEN array_to_string(ws[2:], ' ') WHEN len(ws) > 1 AND {_NUM.format("ws[-1]")} THEN array_to_string(ws[:-2], ' ') END AS bare FROM e0),
e2 AS MATERIALIZED (SELECT *, {_KEY.format("coalesce(bare, text)")} AS kb FROM e1),
kn AS (SELECT doc_id, z, k, count(DISTINCT page) AS n FROM e2 GROUP BY ALL), kbn AS (SELECT doc_id, z, kb, count(DISTINCT page) AS nb FROM e2 GROUP BY ALL),
e AS (SELECT e2.*, pages, coalesce(usual, 0) AS usual, pages >= 2 AND n >= greatest(2, ceil(pages * 0.25)) AS often, string_split_regex(text, '[|•·]') AS bars, nb FROM e2 JOIN kn USING (doc_id, z, k) JOIN kbn USING (doc_id, z, kb) JOIN np USING (doc_id) LEFT JOIN us USING (doc_id)),
ef AS MATERIALIZED (SELECT *, pages >= 2 AND size <= body + 0.5 AND ((len(bars) > 1 AND ({_NUM.format("trim(bars[1])")} OR trim(bars[-1]) = '' OR {_NUM.format("trim(bars[-1])")}) AND NOT mono) OR (bare IS NOT NULL AND nb >= 3)) AS form FROM e),
gr AS (SELECT doc_id, page, line AS f, z, [line] AS grp, false AS folio FROM ef UNION ALL
  SELECT a.doc_id, a.page, a.line, a.z, list_append(list(b.line) FILTER (b.line IS NOT NULL), a.line), true FROM ef a LEFT JOIN ef b ON a.doc_id = b.doc_id AND a.page = b.page AND a.z = b.z AND a.line <> b.line AND abs(a.size - b.size) <= 0.5 AND a.bold = b.bold AND abs(a.y - b.y) <= a.size * 1.8 WHERE a.form GROUP BY 1, 2, 3, 4),
mb AS (SELECT gr.doc_id, gr.page, gr.f, gr.z, gr.grp, gr.folio, u.line FROM gr, unnest(gr.grp) u(line)),
me AS MATERIALIZED (SELECT mb.*, ef.y, ef.size, ef.body, ef.bold, ef.italic, ef.usual FROM mb JOIN ef USING (doc_id, page, line)),
nx AS (SELECT me.doc_id, me.page, f, folio, me.line, arg_min(d.bold, (abs(me.y - d.y), d.line)) AS nb, min(abs(me.y - d.y)) AS dy FROM me JOIN d ON d.doc_id = me.doc_id AND d.page = me.page AND NOT list_contains(grp, d.line) AND (d.y - me.y) * me.z < 0 GROUP BY ALL),
ap AS MATERIALIZED (SELECT doc_id, page, f, folio, bool_and(size < body - 0.5 OR italic OR dy IS NULL OR (bold AND NOT nb AND dy > greatest(size, body) * 1.4) OR dy > greatest(greatest(size, body) * 1.9, usual * 1.15)) AS apart, any_value(grp) AS grp FROM me LEFT JOIN nx USING (doc_id, page, f, folio, line) GROUP BY ALL),
o AS (SELECT doc_id, page, line, 0 AS w FROM {page_parts_sql("ef", "text")} WHERE {PAGE_NUMBER} UNION ALL
  SELECT doc_id, page, f, 1 FROM ap JOIN ef ON ef.doc_id = ap.doc_id AND ef.page = ap.page AND ef.line = ap.f WHERE apart AND NOT folio AND often UNION ALL
  SELECT doc_id, page, u.line, CASE WHEN u.line = f THEN 2 ELSE 3 END FROM ap, unnest(ap.grp) u(line) WHERE apart AND folio)
SELECT doc_id, page, line, ['number', 'repeated', 'folio', 'companion'][min(w) + 1] AS why FROM o GROUP BY 1, 2, 3""".replace("SELECT doc_id, page, f, 1 FROM ap JOIN ef", "SELECT ap.doc_id, ap.page, f, 1 FROM ap JOIN ef"))
def running_headers(spark, sf_dir):
    own = _lines(spark, sf_dir).drop("x0", "x1").withColumn("y", F.col("y") - 30)
    even = F.col("doc_id") % 2 == 0
    line = lambda no, words, y, size: F.struct(no.cast("int").alias("line"), words.alias("text"), F.lit("U").alias("side"), y.cast("double").alias("y"), size.cast("double").alias("size"), *[F.lit(False).alias(c) for c in ("bold", "italic", "mono", "picture")])
    page = own.groupBy("doc_id", "page").agg((F.max("line") + 2).alias("last"))
    more = F.array(
        line(F.lit(-2), F.when(even, F.concat(F.lit("Report "), F.col("doc_id"))).otherwise(F.concat(F.lit("On the matter x"), F.char(F.col("page") % 26 + 97))), F.lit(592), F.lit(9)),
        line(F.lit(-1), F.when(even, F.lit("body again")).otherwise(F.concat(F.lit("| "), F.col("page"))), F.when(even, 563).otherwise(582), F.when(even, 11).otherwise(9)),
        line(F.col("last"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("- "), F.col("page") + 1, F.lit(" -"))).otherwise(F.concat(F.lit("end "), F.col("page") + 1)), F.lit(12), F.lit(11)),
    )
    d = own.unionByName(page.select("doc_id", "page", F.explode(more).alias("m")).select("doc_id", "page", "m.*"))
    return paragraphs.running_lines(d.withColumn("height", F.lit(600.0))).select("doc_id", "page", "line", "why")
