"""Page sets, windows, joins and text over the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import pages, windows
from leafmill.plans.common import LINE_KEY, read
from leafmill.plans.series import query


@query("label_islands", "SELECT toxic, min(doc_id) AS first, max(doc_id) AS last, count(*) AS size FROM (SELECT toxic, doc_id, doc_id - row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS i FROM labels) GROUP BY toxic, i")
def label_islands(spark, sf_dir):
    return pages.islands(read(spark, sf_dir, "labels"), ["toxic"], "doc_id")


@query("page_range_text", """
WITH i AS (SELECT quality, toxic, min(doc_id) AS a, max(doc_id) AS b FROM (SELECT quality, toxic, doc_id, doc_id - row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) AS i FROM labels) GROUP BY quality, toxic, i)
SELECT quality, toxic, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM i GROUP BY 1, 2""")
def page_range_text(spark, sf_dir):
    return pages.range_text(read(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id")


@query("page_ranges", """
WITH t AS (SELECT conv_id, count(*) AS total FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN total < 3 THEN NULL ELSE list_sort(list_distinct(list_concat(range(1, 3), range(3, total + 1)))) END::VARCHAR AS pages FROM t""")
def page_ranges(spark, sf_dir):
    """The pages that the text "1-2, 3-" stands for in each conversation; null where it has no third."""
    d = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("total"))
    got = pages.range_pages(F.lit("1-2, 3-"), F.col("total"))
    return d.select("conv_id", F.when(got.isNotNull(), F.concat(F.lit("["), F.array_join(got, ", "), F.lit("]"))).alias("pages"))


@query("select_pages", "SELECT c.conv_id, p.pos, c.turn, c.role FROM conversations c JOIN (VALUES (0, 1), (1, 0), (2, 1)) p(pos, turn) ON c.turn = p.turn")
def select_pages(spark, sf_dir):
    """Pages 2, 1, 2 of every document: order and repeats as the plan gives them."""
    plan = spark.sql("select * from values (0, 1L), (1, 0L), (2, 1L) as p(pos, turn)")
    return pages.select_pages(read(spark, sf_dir, "conversations"), F.broadcast(plan), ["turn"]).select("conv_id", "pos", "turn", "role")


@query("drop_pages", "SELECT conv_id, turn, role FROM conversations WHERE turn NOT IN (0, 2)")
def drop_pages(spark, sf_dir):
    gone = spark.sql("select * from values (0L), (2L) as p(turn)")
    return pages.drop_pages(read(spark, sf_dir, "conversations"), gone, ["turn"]).select("conv_id", "turn", "role")


@query("permute_pages", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS pos, turn, (turn * 90 + 90) % 360 AS rotation FROM conversations")
def permute_pages(spark, sf_dir):
    """Every document backwards, a quarter turn on."""
    c = read(spark, sf_dir, "conversations")
    plan = c.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())) - 1).cast("long").alias("pos"))
    return pages.select_pages(c.select("conv_id", "turn"), plan, ["conv_id", "turn"]).select("conv_id", "pos", "turn", pages.rotated(F.col("turn") * 90, 90).alias("rotation"))


@query("split_every_n", "SELECT conv_id, turn // 3 AS part, min(turn) + 1 AS first, max(turn) + 1 AS last, CASE WHEN min(turn) = max(turn) THEN 'p' || (min(turn) + 1) ELSE 'p' || (min(turn) + 1) || '-' || (max(turn) + 1) END AS label FROM conversations GROUP BY 1, 2")
def split_every_n(spark, sf_dir):
    return pages.split_every(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3)


@query("number_pages", "SELECT conv_id, turn, row_number() OVER p + 4 AS number, (row_number() OVER p + 4) || ' / ' || (count(*) OVER (PARTITION BY conv_id) + 4) AS label FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn)")
def number_pages(spark, sf_dir):
    return pages.numbered(read(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 5)


@query("concat_sources", "SELECT 0 AS source_no, page_id AS page, length(html) AS size FROM pages UNION ALL SELECT 1, item_id, length(text) FROM benchmark")
def concat_sources(spark, sf_dir):
    a = read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.length("html").alias("size"))
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.length("text").alias("size"))
    return pages.concatenated([a, b], "page").select("source_no", "page", "size")


@query("session_gaps", """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600e6, true) THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g""")
def session_gaps(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 3600.0).select("event_id", "user_id", "session")


@query("chapter_asof", """
SELECT c.conv_id, c.turn, max(h.turn) AS chapter FROM conversations c LEFT JOIN conversations h ON h.conv_id = c.conv_id AND h.role = 'user' AND h.turn <= c.turn GROUP BY 1, 2""")
def chapter_asof(spark, sf_dir):
    """Each turn with the last user turn at or before it."""
    c = read(spark, sf_dir, "conversations")
    heads = c.where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("chapter"))
    return windows.as_of(c.select("conv_id", "turn"), heads, ["conv_id"], "turn", ["chapter"])


@query("nearest_event", """
SELECT a.event_id, b.value AS purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def nearest_event(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("purchase"))
    return windows.as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["purchase"]).select("event_id", "purchase")


_SPAN = "SELECT l_returnflag, (epoch(l_shipdate) // 86400)::BIGINT AS a, (epoch(l_shipdate) // 86400)::BIGINT + l_linenumber AS b FROM lineitem"


def _spans(spark, sf_dir):
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    return read(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag", day.cast("long").alias("a"), (day + F.col("l_linenumber")).cast("long").alias("b"))


@query("interval_sweep_peak", f"""
WITH s AS ({_SPAN}), e AS (SELECT l_returnflag, a AS at_, 1 AS d FROM s UNION ALL SELECT l_returnflag, b, -1 FROM s), g AS (SELECT l_returnflag, at_, sum(d) AS d FROM e GROUP BY 1, 2)
SELECT l_returnflag, max(o)::BIGINT AS peak FROM (SELECT l_returnflag, sum(d) OVER (PARTITION BY l_returnflag ORDER BY at_) AS o FROM g) GROUP BY 1""")
def interval_sweep_peak(spark, sf_dir):
    return windows.peak_overlap(_spans(spark, sf_dir), ["l_returnflag"], "a", "b")


@query("interval_merge", """
WITH s AS (SELECT l_suppkey, (epoch(l_shipdate) // 86400)::BIGINT AS a, (epoch(l_shipdate) // 86400)::BIGINT + l_linenumber AS b FROM lineitem),
f AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
i AS (SELECT *, sum(CASE WHEN coalesce(a > far, true) THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT l_suppkey, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY l_suppkey, i""")
def interval_merge(spark, sf_dir):
    return windows.merged_intervals(_spans(spark, sf_dir), ["l_suppkey"], "a", "b")


@query("overlap_join", """
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (epoch(l_shipdate) // 86400)::BIGINT AS a, (epoch(l_shipdate) // 86400)::BIGINT + l_linenumber AS b FROM lineitem),
o AS (SELECT o_orderkey AS l_orderkey, (epoch(o_orderdate) // 86400)::BIGINT AS c, (epoch(o_orderdate) // 86400)::BIGINT + 60 AS d FROM orders)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a, b, c, d FROM s JOIN o USING (l_orderkey) WHERE a < d AND c < b""")
def overlap_join(spark, sf_dir):
    """Shipments under way within sixty days of their order."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day.alias("c"), (day + 60).alias("d"))
    return windows.overlap_join(_spans(spark, sf_dir).drop("l_returnflag"), o, ["l_orderkey"], 30, "a", "b", "c", "d").select(*LINE_KEY, "a", "b", "c", "d")


@query("containment_anti", """
WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, (epoch(l_shipdate) // 86400)::BIGINT AS a, (epoch(l_shipdate) // 86400)::BIGINT + l_linenumber AS b FROM lineitem)
SELECT l_suppkey, count(*) AS inside FROM (SELECT l_suppkey, b, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s) WHERE far >= b GROUP BY 1""")
def containment_anti(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return windows.contained(s, ["l_suppkey"], "id", "a", "b").groupBy("l_suppkey").agg(F.count("*").alias("inside"))


@query("dictionary_lookup", "SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dictionary_lookup(spark, sf_dir):
    """Cells to their dictionary entry, missing ones empty."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


@query("fallback_chain", """
SELECT n_nationkey, coalesce(c.v, s.v, r_name) AS value FROM nation LEFT JOIN (SELECT c_nationkey AS k, max(c_name) AS v FROM customer WHERE c_acctbal > 9900 GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def fallback_chain(spark, sf_dir):
    """The most specific level that has a value."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    c = read(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("ck")).agg(F.max("c_name").alias("cv"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("sk")).agg(F.min("s_name").alias("sv"))
    d = n.join(c, n.n_nationkey == c.ck, "left").join(s, n.n_nationkey == s.sk, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return d.select("n_nationkey", F.coalesce("cv", "sv", "r_name").alias("value"))


@query("semi_membership", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_membership(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    p = read(spark, sf_dir, "part")
    return p.join(li, p.p_partkey == li.l_partkey, "left_semi").select("p_partkey")


@query("turn_depth", """
WITH RECURSIVE t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1 WHERE t.depth < 20)
SELECT conv_id, max(depth)::BIGINT AS depth FROM t GROUP BY 1""")
def turn_depth(spark, sf_dir):
    """How deep the chain from the first turn goes, at most 20 links: the inheritance walk, as a recursive query."""
    read(spark, sf_dir, "conversations").createOrReplaceTempView("_turns")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql("""
        WITH RECURSIVE t(conv_id, turn, depth) AS (
          SELECT conv_id, turn, 0 FROM _turns WHERE turn = 0
          UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN _turns c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1 WHERE t.depth < 20)
        SELECT conv_id, CAST(max(depth) AS BIGINT) AS depth FROM t GROUP BY conv_id""")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("repeated_lines", f"SELECT line, count(DISTINCT doc_id) AS docs FROM ({_LINES}) WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10")
def repeated_lines(spark, sf_dir):
    return boilerplate(_lines(spark, sf_dir).where("trim(line) <> ''"), "doc_id", F.col("line"), 10).select(F.col("key").alias("line"), F.col("pages").alias("docs"))


def boilerplate(lines, page: str, key, least: int):
    """Keys that stand on at least ``least`` pages: header and footer candidates."""
    return lines.select(page, key.alias("key")).distinct().groupBy("key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


@query("digit_masked_keys", f"""SELECT regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') AS line, count(DISTINCT doc_id) AS docs FROM ({_LINES}) WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""")
def digit_masked_keys(spark, sf_dir):
    return boilerplate(_lines(spark, sf_dir).where("trim(line) <> ''"), "doc_id", text.masked(F.col("line")), 5).select(F.col("key").alias("line"), F.col("pages").alias("docs"))


@query("strip_repeated_lines", f"""
WITH l AS ({_LINES}), r AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE line NOT IN (SELECT line FROM r)) AS kept FROM l GROUP BY 1""")
def strip_repeated_lines(spark, sf_dir):
    # lines are counted per document first; blank ones, the most frequent key of all, take no part in the join
    lines = _lines(spark, sf_dir).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    filled = lines.where("trim(line) <> ''")
    often = filled.groupBy("line").agg(F.count("*").alias("pages")).where("pages >= 10").select("line", F.lit(True).alias("often"))
    blank = lines.where("trim(line) = ''").withColumn("often", F.lit(None).cast("boolean"))
    every = filled.join(often, "line", "left").unionByName(blank)
    return every.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.coalesce(F.sum(F.when(F.col("often").isNull(), F.col("n"))), F.lit(0)).alias("kept"))


def _list(v: str) -> str:
    return ", ".join(f"'{w}'" for w in v.split())


_VOTE = f"""
WITH w AS (SELECT doc_id, lang, list_slice(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+'), 1, 4000) AS w FROM documents),
h AS (SELECT doc_id, lang, len(w) AS n, [{', '.join(f'len(list_filter(w, lambda x: x IN ({_list(v)})))' for v in text.STOP_WORDS.values())}] AS h FROM w),
v AS (SELECT doc_id, lang, CASE WHEN n >= 40 AND list_max(h) > n * 0.12 THEN [{', '.join(f"'{k}'" for k in text.STOP_WORDS)}][list_position(h, list_max(h))] END AS language FROM h)"""


@query("language_vote", _VOTE + " SELECT doc_id, language FROM v")
def language_vote(spark, sf_dir):
    return text.with_language(read(spark, sf_dir, "documents"), "text").select("doc_id", "language")


@query("language_confusion", _VOTE + " SELECT lang, language, count(*) AS n FROM v GROUP BY 1, 2")
def language_confusion(spark, sf_dir):
    return text.with_language(read(spark, sf_dir, "documents"), "text").groupBy("lang", "language").agg(F.count("*").alias("n"))


@query("fold_key", "SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def fold_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.fold_key(F.col("text")).alias("key"))


@query("sentence_flags", f"""SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(trim(line), '[.!?…:;]["''”’»)\\]]*$')) AS ended,
  count(*) FILTER (WHERE regexp_matches(trim(line), '^["''“‘«(\\[¿¡]*[A-ZÀ-ÖØ-Þ]')) AS upper, count(*) FILTER (WHERE regexp_matches(trim(line), '^["''“‘«(\\[¿¡]*[a-zß-öø-ÿ]')) AS lower FROM ({_LINES}) GROUP BY 1""")
def sentence_flags(spark, sf_dir):
    n = lambda c: F.count_if(c)
    line = F.col("line")
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), n(text.ends_sentence(line)).alias("ended"), n(text.starts_upper(line)).alias("upper"), n(text.starts_lower(line)).alias("lower"))


@query("size_report", "SELECT source, sum(strlen(text)) AS before, sum(strlen(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS after FROM documents GROUP BY 1")
def size_report(spark, sf_dir):
    """Bytes before and after white space is collapsed."""
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("before"), F.sum(F.octet_length(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("after"))


@query("search_parts", "SELECT p_partkey FROM part WHERE contains(strip_accents(lower(p_name || ' ' || p_type)), 'an')")
def search_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").where(text.contains_folded(F.concat_ws(" ", "p_name", "p_type"), "Án")).select("p_partkey")


_STRIP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


@query("html_text", rf"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '{_STRIP}', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_text(spark, sf_dir):
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", _STRIP, " "), r"\s+", " "))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(plain).alias("text_md5"))


@query("html_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def html_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("html_headings", """SELECT page_id, heading, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS heading FROM pages) GROUP BY 1, 2""")
def html_headings(spark, sf_dir):
    heads = F.regexp_extract_all("html", F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(heads).alias("heading")).groupBy("page_id", "heading").agg(F.count("*").alias("n"))
