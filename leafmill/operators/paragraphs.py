"""Paragraphs, headings and running lines of pages, judged by what the whole document does.

Rows are lines (doc_id, page, line: place on the page, text, x0, x1, y, size, side: I left, D right, C across, U single column,
bold, italic, mono, picture), y upwards.  A first pass takes counts and percentiles of each document (body size, pitch, margins,
how paragraphs are set apart); a second judges every line beside the one before it.  Windows are by page, so a document of any
length spreads over tasks; what concerns a whole document is combined from counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import lines as _lines
from leafmill.operators import stats
from leafmill.operators.tables import joined_lines

DOC, PAGE = ["doc_id"], ["doc_id", "page"]


def _order() -> WindowSpec:
    return Window.partitionBy(*PAGE).orderBy("line")


def by_page(lines: DataFrame, of: DataFrame, how: str = "left") -> DataFrame:
    """``lines`` with what ``of`` says of their document, joined by way of its pages: lines are dealt out by page, once, and
    stay there."""
    return lines.join(lines.select(*PAGE).distinct().join(of, "doc_id"), PAGE, how)


def with_signs(lines: DataFrame) -> DataFrame:
    """Adds ``signs``: what the rules ask of a line's text (blank, marked, entry, ends, upper), so that they don't move the text itself."""
    t = F.col("text")
    return lines.withColumn("signs", F.struct((F.trim(t) == "").alias("blank"), text.list_mark(t).isNotNull().alias("marked"), text.contents_line(t).alias("entry"), text.ends_sentence(t).alias("ends"), text.starts_upper(t).alias("upper")))


def with_body(lines: DataFrame) -> DataFrame:
    """Adds ``body``: the half point that most characters of the document have (pictures aside); 11 without any."""
    size = stats.weighted_mode(lines.where("not picture"), DOC, "size", F.length("text"), 0.5).withColumnRenamed("mode", "_body")
    return by_page(lines, size).withColumn("body", F.coalesce("_body", F.lit(11.0))).drop("_body")


def margins(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``left``, ``right`` and ``n`` (lines) of each group: of lines about the body's size, if there are three, the most frequent
    beginning (in steps of 2; of equals the first) and the 90th percentile of ends; else the extremes of all lines of text."""
    like = ~F.col("picture") & (F.abs(F.col("size") - F.col("body")) <= 1)
    usual = stats.bucket_mode(lines.where(like), keys, "x0", 2.0, "_at").withColumnRenamed("mode", "_usual")
    own = lines.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(like).alias("_like"), stats.floor_percentile(F.when(like, F.col("x1")), 0.9).alias("_p90"),
        F.min(F.when(~F.col("picture"), F.col("x0"))).alias("_min"), F.max(F.when(~F.col("picture"), F.col("x1"))).alias("_max"),
    )
    many = F.col("_like") >= 3
    left, right = F.when(many, F.col("_usual")).otherwise(F.coalesce("_min", F.lit(0.0))), F.when(many, F.col("_p90")).otherwise(F.coalesce("_max", F.lit(0.0)))
    return own.join(usual, keys, "left").select(*keys, "n", left.alias("left"), right.alias("right"))


def with_margins(lines: DataFrame) -> DataFrame:
    """Adds ``page_left``, ``page_right`` and ``left``, ``right`` (of the line's side if that has three lines, else the page's)."""
    d = lines.withColumn("_at", F.col("line"))
    page = margins(d, PAGE).select(*PAGE, F.col("left").alias("page_left"), F.col("right").alias("page_right"))
    side = margins(d, [*PAGE, "side"]).where("n >= 3").groupBy(*PAGE).agg(F.collect_list(F.struct("side", F.col("left").alias("l"), F.col("right").alias("r"))).alias("_sides"))
    d = d.join(page, PAGE, "left").join(side, PAGE, "left")
    own = F.get(F.filter("_sides", lambda s: s.side == F.col("side")), F.lit(0))
    d = d.withColumns({"_l": own["l"], "_r": own["r"]}).drop("_sides")
    return d.withColumn("left", F.coalesce("_l", "page_left")).withColumn("right", F.coalesce("_r", "page_right")).drop("_l", "_r", "_at")





def paragraph_signals(lines: DataFrame) -> DataFrame:
    """doc_id, spaced, indented, justified: how a document sets paragraphs apart, from lines of body size.

    Spaced: three gaps above half a body size more than the pitch, and one in fifty pairs; indented: three indents that
    no list mark explains; justified: half the lines reach the right margin.  ``lines`` has body, pitch and the margins."""
    d = lines.withColumn("_p", F.lag(F.struct("y", "size", "side", "picture")).over(_order()))
    d = d.where(~F.col("picture") & (F.abs(F.col("size") - F.col("body")) <= 0.6))
    single = F.col("side") != "C"
    # only the two columns have margins of their own here
    two = F.col("side").isin("I", "D")
    left, right = F.when(two, F.col("left")).otherwise(F.col("page_left")), F.when(two, F.col("right")).otherwise(F.col("page_right"))
    indent = single & (F.col("x0") - F.col("page_left") > F.col("size") * 0.75) & ~F.col("signs.marked")
    pair = F.coalesce(~F.col("_p.picture") & (F.col("_p.side") == F.col("side")) & (F.abs(F.col("_p.size") - F.col("body")) <= 0.6), F.lit(False))
    gap = pair & (F.col("_p.y") - F.col("y") > F.col("body") * (F.col("pitch") + 0.5))
    n = d.groupBy("doc_id").agg(*[F.count_if(c).alias(k) for k, c in (("total", single), ("full", single & (F.col("x1") >= right - (right - left) * 0.03)), ("indents", indent), ("pairs", pair), ("gaps", gap))])
    return n.select("doc_id", ((F.col("gaps") >= 3) & (F.col("gaps") >= F.col("pairs") * 0.02)).alias("spaced"), (F.col("indents") >= 3).alias("indented"), ((F.col("total") > 0) & (F.col("full") * 2 >= F.col("total"))).alias("justified"))


def in_context(lines: DataFrame) -> DataFrame:
    """Lines with signs, body, pitch, margins and the document's signals."""
    d = with_margins(with_body(with_signs(lines)))
    pitch = _lines.line_pitch(d.withColumn("size", F.when(~F.col("picture"), F.col("size"))), DOC)
    d = by_page(d, pitch, "inner")
    flags = paragraph_signals(d)
    d = by_page(d, flags)
    return d.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("spaced", "indented", "justified")})


def paragraph_starts(lines: DataFrame) -> DataFrame:
    """Lines ``in_context`` with ``starts``: whether each begins a paragraph.  The first rule that applies decides."""
    d = lines.withColumn("_p", F.lag(F.struct("signs", "x0", "x1", "y", "size", "side", "mono", "picture")).over(_order()))
    p = lambda c: F.col(f"_p.{c}")
    dy, large, wide = p("y") - F.col("y"), F.greatest("size", p("size")), F.col("right") - F.col("left")
    code, was_code = F.col("mono") & ~F.col("signs.blank"), p("mono") & ~p("signs.blank")
    indent, was_indent = F.col("x0") - F.col("left") > F.col("size") * 0.75, p("x0") - F.col("left") > p("size") * 0.75
    other = p("side") != F.col("side")
    # a heading over both columns whose second, shorter line falls into the left one
    goes_on = (p("side") == "C") & (F.col("side") == "I") & (F.abs(F.col("size") - p("size")) < 0.5) & (F.col("size") >= F.col("body") * 1.12) & (dy > 0) & (dy <= F.col("size") * 1.7)
    rules = [
        (F.col("_p").isNull() | p("picture") | F.col("picture"), True),
        (code != was_code, True),
        (code, other | (dy > large * 2.2)),
        (other & ~goes_on, True),
        ((F.abs(F.col("size") - p("size")) > 0.7) & (large >= F.col("body") * 1.1), True),
        (dy > large * (F.col("pitch") + 0.5), True),
        (F.col("signs.marked"), True),
        (p("signs.entry") | F.col("signs.entry"), True),
        (indent & ~was_indent, True),
        (F.col("justified") & (wide > 0) & (p("x1") < F.col("right") - wide * 0.12) & (F.abs(p("size") - F.col("body")) <= 1), True),
        (~F.col("spaced") & ~F.col("indented") & (wide > 0) & (p("x1") < F.col("right") - wide * 0.25) & p("signs.ends") & F.col("signs.upper"), True),
    ]
    return d.withColumn("starts", F.coalesce(*[F.when(c, v) for c, v in rules], F.lit(False))).drop("_p")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page, par_no, text, kind (text, code, list, heading or picture), ordered, indent, size, n_lines, side, y from
    lines.  Hyphens at line ends join; code keeps its lines; a list item loses its mark.

    A heading has at most four lines and 160 characters, and is set larger than the body, begins with a word of chapters, or is all
    bold and ends open; no number alone, entry of a contents page, or label in capitals."""
    d = paragraph_starts(in_context(lines))
    d = d.withColumn("par_no", F.sum(F.col("starts").cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    contents = _lines.contents_pages(lines.where("not picture"), PAGE).select(*PAGE, F.lit(True).alias("_contents"))
    all_ = F.sort_array(F.collect_list(F.struct("line", "text")))
    xs = F.transform(all_, lambda x: x.text)
    first = F.min(F.struct("line", "x0", "y", "size", "side", "left", "bold"))
    g = d.groupBy(*PAGE, "par_no").agg(
        xs.alias("_xs"), first.alias("_f"), F.max("size").alias("size"), F.count("*").cast("int").alias("n_lines"), F.bool_and("bold").alias("_bold"),
        F.bool_and(F.col("mono") & (F.trim("text") != "")).alias("_code"), F.bool_or("picture").alias("_picture"), F.max("body").alias("body"),
    ).join(contents, PAGE, "left")
    plain = F.array_join("_xs", " ")
    n, ends_marked = F.length(plain), F.trim(plain).rlike("[.:;,]$")
    big = (F.col("size") >= F.col("body") * 1.12) & (F.col("size") - F.col("body") >= 1)
    mark = text.list_mark(F.get("_xs", F.lit(0)))
    numbered = mark["ordered"] & (F.col("n_lines") == 1) & (n <= 100) & ~ends_marked & (big | (F.col("_bold") & (F.col("size") >= F.col("body") - 0.5) & (n <= 80)))
    item = mark.isNotNull() & ~F.coalesce(numbered, F.lit(False))
    chapter = text.chapter_word(plain) & (n <= 80) & ~text.ends_sentence(F.regexp_replace(plain, "[.]$", ""))
    bold = F.col("_bold") & (F.col("size") >= F.col("body") - 0.5) & (n <= 100) & ~ends_marked
    never = F.trim(plain).rlike("^[0-9]{1,4}$") | (F.coalesce("_contents", F.lit(False)) & text.ends_in_page(plain)) | (~big & F.trim(plain).rlike(r"^\p{Lu}{2,14}:?$"))
    heading = (F.col("n_lines") <= 4) & (n <= 160) & ~never & (big | chapter | bold)
    kind = F.when(F.col("_picture"), "picture").when(F.col("_code"), "code").when(item, "list").when(heading, "heading").otherwise("text")
    body = F.when(kind == "code", F.array_join("_xs", "\n")).when(item, F.ltrim(F.substr(joined_lines(F.col("_xs")), mark["length"] + 1))).otherwise(joined_lines(F.col("_xs")))
    indent = F.col("_f.x0") - F.col("_f.left") > F.col("_f.size") * 0.75
    return g.select(*PAGE, "par_no", body.alias("text"), kind.alias("kind"), F.when(item, mark["ordered"]).alias("ordered"), indent.alias("indent"), "size", "n_lines", F.col("_f.side").alias("side"), F.col("_f.y").alias("y"))


def _number(c: Column) -> Column:
    """Up to four digits, or up to seven small letters of roman numerals."""
    only = lambda signs, most: F.length(c).between(1, most) & (F.translate(c, signs, "") == "")
    return only("0123456789", 4) | only("ivxlcdm", 7)


def folio_shape(s: Column) -> Column:
    """A number parted from a title by a bar or dot, at the beginning or the end: ``8 | Chapter 1``, ``Preface | xiii``."""
    parts = F.transform(F.split(s, "[|•·]"), lambda x: F.trim(x))
    last = F.element_at(parts, -1)
    return (F.size(parts) > 1) & (_number(F.get(parts, F.lit(0))) | (last == "") | _number(last))


def without_number(s: Column) -> Column:
    """The text without the number it begins or ends with; null if there is none."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    n = F.size(words)
    first, last = _number(F.get(words, F.lit(0))), _number(F.try_element_at(words, F.lit(-1)))
    return F.when((n > 1) & first, F.array_join(F.slice(words, F.lit(2), n), " ")).when((n > 1) & last, F.array_join(F.slice(words, F.lit(1), n - 1), " "))


def _key(s: Column) -> Column:
    return F.trim(F.regexp_replace(text.masked(s), r"\s+", " "))


def running_lines(lines: DataFrame, zone: float = 0.1, share: float = 0.25) -> DataFrame:
    """The headers, footers and page numbers among lines (which also have ``height``, of the page), with ``why``: number,
    repeated, folio or companion.

    Lines of the outermost tenths count.  Repeated: the same text, digits aside, on two pages at least and a quarter of all,
    set apart from the rest.  Folio: a number with a title that changes, by its shape or because its text comes back with
    other numbers on three pages; its second line, close by and set alike, goes with it, if both are set apart.  Apart
    means smaller or italic, nothing beyond it, or further from the nearest line than body lines are (95th percentile of
    the document's gaps).  Pages without lines don't count."""
    d = with_body(lines).where("not picture")
    z = F.when(F.col("y") > F.col("height") * (1 - zone), 1).when(F.col("y") < F.col("height") * zone, -1)
    d = d.withColumn("_z", z)
    body_gap = F.col("_z").isNull() & F.col("_p._z").isNull() & (F.col("_p.side") == F.col("side")) & (F.abs(F.col("size") - F.col("body")) <= 1) & (F.abs(F.col("_p.size") - F.col("body")) <= 1)
    inner = d.where("_z is null").withColumn("_p", F.lag(F.struct("y", "size", "side", "_z")).over(_order())).where(body_gap)
    usual = stats.floor_percentile_of(inner.withColumn("_gap", F.col("_p.y") - F.col("y")), DOC, "_gap", 0.95).withColumnRenamed("percentile", "_usual")
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    d = d.withColumn("_bare", without_number(F.col("text"))).withColumn("_k", _key(F.col("text"))).withColumn("_kb", _key(F.coalesce("_bare", "text")))
    count = lambda k, n: d.where("_z is not null").groupBy("doc_id", "_z", k).agg(F.count_distinct("page").alias(n))
    d = d.join(pages, "doc_id").join(usual, "doc_id", "left").join(count("_k", "_n"), ["doc_id", "_z", "_k"], "left").join(count("_kb", "_nb"), ["doc_id", "_z", "_kb"], "left")
    many = F.col("_z").isNotNull() & (F.col("_pages") >= 2)
    form = many & (F.col("size") <= F.col("body") + 0.5) & ((folio_shape(F.col("text")) & ~F.col("mono")) | (F.col("_bare").isNotNull() & (F.col("_nb") >= 3)))
    often = many & (F.col("_n") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * share)))
    number = F.col("_z").isNotNull() & text.page_number(F.col("text"))
    entry = F.struct("line", "y", "size", "bold", "italic", F.col("_z").alias("z"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in (("often", often), ("form", form), ("number", number))])
    # the rest concerns one page, whose lines fit in a row
    page = d.groupBy(*PAGE, "body", F.coalesce("_usual", F.lit(0.0)).alias("usual")).agg(F.collect_list(entry).alias("_ls"))
    ls, body, gap = F.col("_ls"), F.col("body"), F.col("usual")

    def apart(o: Column, group: Column) -> Column:
        beyond = F.filter(ls, lambda x: ~F.array_contains(group, x["line"]) & ((x["y"] - o["y"]) * o["z"] < 0))
        n = F.array_min(F.transform(beyond, lambda x: F.struct(F.abs(x["y"] - o["y"]).alias("dy"), x["line"].alias("line"), x["bold"].alias("bold"))))
        large = F.greatest(o["size"], body)
        far = (o["bold"] & ~n["bold"] & (n["dy"] > large * 1.4)) | (n["dy"] > F.greatest(large * 1.9, gap * 1.15))
        return (o["size"] < body - 0.5) | o["italic"] | F.coalesce(far, F.lit(True))

    x = F.col("_x")
    near = lambda o: (o["line"] != x["line"]) & (o["z"] == x["z"]) & (F.abs(o["size"] - x["size"]) <= 0.5) & (o["bold"] == x["bold"]) & (F.abs(o["y"] - x["y"]) <= x["size"] * 1.8)
    e = page.select(*PAGE, "body", "usual", "_ls", F.explode(F.filter(ls, lambda o: o["z"].isNotNull())).alias("_x")).where("_x.number or _x.often or _x.form")
    e = e.withColumn("_o", F.when(x["form"], F.filter(ls, near))).withColumn("_group", F.array_append(F.transform("_o", lambda o: o["line"]), x["line"]))
    e = e.withColumn("_whole", x["form"] & apart(x, F.col("_group")) & F.forall("_o", lambda o: apart(o, F.col("_group"))))
    e = e.withColumn("_why", F.when(x["number"], 0).when(x["often"] & apart(x, F.array(x["line"])), 1).when(F.col("_whole"), 2))
    own, rest = F.array(F.struct(x["line"].alias("line"), F.col("_why").alias("why"))), F.transform("_o", lambda o: F.struct(o["line"].alias("line"), F.lit(3).alias("why")))
    out = e.select(*PAGE, F.explode(F.when(F.col("_whole"), F.concat(own, rest)).otherwise(own)).alias("e")).where("e.why is not null")
    why = out.groupBy(*PAGE, F.col("e.line").alias("line")).agg(F.min("e.why").alias("_why"))
    names = F.array(*map(F.lit, ("number", "repeated", "folio", "companion")))
    return lines.join(why.withColumn("why", F.get(names, F.col("_why"))).drop("_why"), [*PAGE, "line"])


def without_running_lines(lines: DataFrame) -> DataFrame:
    """The lines that are no header, footer or page number."""
    return lines.join(running_lines(lines).select(*PAGE, "line"), [*PAGE, "line"], "left_anti")


def joined_across_pages(pars: DataFrame) -> DataFrame:
    """doc_id, page, par_no, text, ... of ``paragraphs`` with those parted by a page or column break joined.

    A text goes on the one before it (the left column's on the same page, or the page before's last) if it has no indent and a like
    size, and the one before ends in a hyphen, or ends open while this one begins small.  A joined paragraph keeps its
    first page, so it never reaches a third."""
    w = Window.partitionBy("doc_id").orderBy("page", "par_no")
    d = pars.withColumn("_p", F.lag(F.struct("page", "text", "size", "kind", "side")).over(w))
    step = (F.col("page") == F.col("_p.page") + 1) | ((F.col("page") == F.col("_p.page")) & (F.col("_p.side") == "I") & (F.col("side") == "D"))
    open_ = F.col("_p.text").rlike("[A-Za-zÀ-ÿ]-$") | (~text.ends_sentence(F.col("_p.text")) & text.starts_lower(F.col("text")))
    fits = step & ~F.col("indent") & (F.col("kind") == "text") & (F.col("_p.kind") == "text") & (F.abs(F.col("size") - F.col("_p.size")) <= 0.7) & open_
    d = d.withColumn("_j", F.coalesce(fits, F.lit(False))).withColumn("_over", F.col("_j") & (F.col("page") > F.col("_p.page")))
    d = d.withColumn("_run", F.sum((~F.col("_j")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # in a run, every second page break parts again
    breaks = F.sum(F.col("_over").cast("int")).over(Window.partitionBy("doc_id", "_run").orderBy("page", "par_no").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_block", F.floor(breaks / 2))
    xs = F.transform(F.sort_array(F.collect_list(F.struct("page", "par_no", "text"))), lambda x: x.text)
    first = F.min(F.struct("page", "par_no", "kind", "ordered", "indent", "size", "side", "y"))
    g = d.groupBy("doc_id", "_run", "_block").agg(first.alias("f"), joined_lines(xs).alias("_t"), F.first("text").alias("_own"), F.count("*").alias("_n"))
    return g.select("doc_id", "f.page", "f.par_no", F.when(F.col("_n") > 1, F.col("_t")).otherwise(F.col("_own")).alias("text"), "f.kind", "f.ordered", "f.indent", "f.size", "f.side", "f.y")
