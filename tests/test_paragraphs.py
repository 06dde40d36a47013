"""Paragraphs, headings, breaks over pages and running lines on small pages with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import paragraphs

SCHEMA = "doc_id long, page int, line int, text string, x0 double, x1 double, y double, size double, side string, bold boolean, italic boolean, mono boolean, picture boolean"


def line(text, y, x0=50.0, x1=350.0, size=11.0, page=0, side="U", bold=False, italic=False, mono=False, picture=False, doc=1):
    return (doc, page, text, float(x0), float(x1), float(y), float(size), side, bold, italic, mono, picture)


def frame(spark, rows):
    """Lines are numbered in the order given, page by page."""
    place, out = {}, []
    for doc, page, *rest in rows:
        n = place[doc, page] = place.get((doc, page), -1) + 1
        out.append((doc, page, n, *rest))
    return spark.createDataFrame(out, SCHEMA)


def pars(spark, rows):
    return paragraphs.paragraphs(frame(spark, rows)).orderBy("doc_id", "page", "par_no").collect()


def test_space_parts_paragraphs(spark):
    rows = [line("First line of the first paragraph that goes on", 500), line("second line of the same paragraph", 486), line("end of the first.", 472, x1=170)]
    rows += [line("Another paragraph with a long text of its own", 444), line("and its second line of text", 430), line("and it ends here.", 416, x1=140)]
    got = pars(spark, rows)
    assert [p.text for p in got] == ["First line of the first paragraph that goes on second line of the same paragraph end of the first.", "Another paragraph with a long text of its own and its second line of text and it ends here."]
    assert {p.kind for p in got} == {"text"}


def test_hyphens_join(spark):
    (p,) = pars(spark, [line("This is an exam-", 500), line("ple of text with a hyphen at the end", 486), line("and a third line to fix the pitch.", 472)])
    assert p.text == "This is an example of text with a hyphen at the end and a third line to fix the pitch."


def test_indents_part_paragraphs(spark):
    ys = [500 - 14 * i for i in range(6)]
    got = pars(spark, [line(f"line {i} with words enough to fill", y, x0=62 if i == 3 else 50) for i, y in enumerate(ys)])
    assert len(got) == 2 and [p.indent for p in got] == [False, True]


def test_kinds(spark):
    rows = [line("Chapter one", 580, size=20, x1=200)]
    rows += [line(f"body text number {i} that fills its line well", 540 - 14 * i) for i in range(4)]
    rows += [line("A bold heading", 470, bold=True, x1=150), line("NOTE", 440, bold=True, x1=90), line("body text again that fills its line.", 426)]
    rows += [line("• first item of a list", 400), line("2. second item", 386), line("3. Numbered heading", 360, size=14)]
    rows += [line("x = 1", 330, mono=True, x1=90), line("y = 2", 316, mono=True, x1=90), line("a figure", 300, picture=True), line("42", 200, bold=True)]
    got = [(p.kind, p.text, p.ordered) for p in pars(spark, rows)]
    assert got == [
        ("heading", "Chapter one", None), ("text", " ".join(f"body text number {i} that fills its line well" for i in range(4)), None), ("heading", "A bold heading", None),
        ("text", "NOTE", None), ("text", "body text again that fills its line.", None), ("list", "first item of a list", False), ("list", "second item", True), ("heading", "3. Numbered heading", None), ("code", "x = 1\ny = 2", None), ("picture", "a figure", None), ("text", "42", None),
    ]


def test_contents_entries_are_no_headings(spark):
    rows = [line(f"Part {'abcdef'[i]} ...... {i + 3}", 500 - 14 * i, bold=True) for i in range(6)]
    assert [p.kind for p in pars(spark, rows)] == ["text"] * 6


def test_signals(spark):
    def doc(n, gap=0, indent=0, short=False):
        y, out = 580.0, []
        for i in range(36):
            y -= 14 + (gap if i % 4 == 0 else 0)
            out.append(line(f"line {i}", y, x0=50 + (indent if i % 4 == 0 else 0), x1=350 - (30 + i % 7 * 20 if short else 0), doc=n))
        return out

    d = frame(spark, doc(1) + doc(2, gap=9) + doc(3, indent=12) + doc(4, short=True))
    got = {r.doc_id: (r.spaced, r.indented, r.justified) for r in paragraphs.in_context(d).select("doc_id", "spaced", "indented", "justified").distinct().collect()}
    assert got == {1: (False, False, True), 2: (True, False, True), 3: (False, True, True), 4: (False, False, False)}


def test_short_line_closes_only_without_other_signs(spark):
    """Neither spaced nor indented nor justified: a short line that ends a sentence, before a capital."""
    ends = [200, 330, 310, 350, 340, 300, 320, 350, 330, 310]
    texts = ["It ends here.", "A new one begins", "and goes on", "further. Then", "more of it", "and more", "again more", "with words", "and words", "at last."]
    got = pars(spark, [line(t, 500 - 14 * i, x1=x) for i, (t, x) in enumerate(zip(texts, ends, strict=True))])
    assert [p.text[:12] for p in got] == ["It ends here", "A new one be"]


def test_empty(spark):
    d = frame(spark, [])
    assert paragraphs.paragraphs(d).count() == 0
    assert paragraphs.running_lines(d.withColumn("height", F.lit(600.0))).count() == 0


def across(spark, rows):
    return paragraphs.joined_across_pages(paragraphs.paragraphs(frame(spark, rows))).orderBy("doc_id", "page", "par_no").collect()


def test_sentence_over_a_page_break(spark):
    rows = [line("First line of page one with text.", 300), line("Second line of page one with text.", 286), line("This sentence is cut at the end of the page and", 272)]
    rows += [line("goes on upon the next page without an indent.", 540, page=1), line("And more text for the second part.", 526, page=1), line("Last line of what crosses both pages.", 512, page=1)]
    (p,) = across(spark, rows)
    assert p.page == 0 and "the end of the page and goes on upon the next page" in p.text


def test_breaks_that_do_not_join(spark):
    lines = lambda page, *ts, **k: [line(t, 540 - 14 * i, page=page, **k) for i, t in enumerate(ts)]
    assert len(across(spark, lines(0, "ends here.") + lines(1, "goes on"))) == 2
    assert len(across(spark, lines(0, "ends open") + lines(1, "Begins large"))) == 2
    assert len(across(spark, lines(0, "ends open") + lines(2, "goes on"))) == 2
    assert len(across(spark, lines(0, "ends open") + lines(1, "goes on", size=13))) == 2
    assert [(p.page, p.text) for p in across(spark, lines(0, "a hy-") + lines(1, "phen and") + lines(2, "a third page"))] == [(0, "a hyphen and"), (2, "a third page")]
    left, right = [line("left column", 500 - 14 * i, side="I", x1=180) for i in range(3)], [line("and right", 500 - 14 * i, side="D", x0=210) for i in range(3)]
    assert len(across(spark, left + right)) == 1


# ---- running lines


def removed(spark, rows):
    d = frame(spark, rows).withColumn("height", F.lit(600.0))
    out = [(r.page, r.text, r.why) for r in paragraphs.running_lines(d).orderBy("page", "line").collect()]
    assert paragraphs.without_running_lines(d).count() == d.count() - len(out)
    return out


def body(page, n=3, top=500):
    return [line(f"text {i} of page {page + 1} with words enough", top - 14 * i, page=page) for i in range(n)]


def test_headers_and_numbers_go(spark):
    rows = [r for p in range(4) for r in [line("My book - Author", 580, size=9, page=p), *body(p), line(str(p + 1), 20, size=9, page=p)]]
    out = removed(spark, rows)
    assert len(out) == 8 and {w for _, t, w in out if t == "My book - Author"} == {"repeated"} and sum(w == "number" for *_, w in out) == 4


def test_a_repeated_body_line_near_the_edge_stays(spark):
    rows = [r for p in range(4) for r in [line("The same sentence again", 556, page=p), *body(p, 30, top=542)]]
    assert removed(spark, rows) == []
    apart = [r for p in range(4) for r in [line("The same sentence again", 580, page=p), *body(p, 30, top=542)]]
    assert len(removed(spark, apart)) == 4
    italic = [r for p in range(4) for r in [line("The same sentence again", 556, italic=True, page=p), *body(p, 30, top=542)]]
    assert len(removed(spark, italic)) == 4


def test_a_folio_of_two_lines_goes_or_stays_together(spark):
    titles = ["What is a base", "How to begin", "On tables", "Of keys", "At the end"]
    rows = [r for p, t in enumerate(titles) for r in [line(t, 585, size=9, page=p), line(f"| {p + 5}", 573, size=9, page=p), *body(p, 5)]]
    out = removed(spark, rows)
    assert len(out) == 10 and {w for _, t, w in out if t in titles} == {"companion"}
    # set like the body and close to it: neither line is apart
    close = [r for p, t in enumerate(titles) for r in [line(t, 568, page=p), line(f"{p + 5} | {t}", 554, page=p), *body(p, 5, top=540)]]
    assert removed(spark, close) == []


def test_numbers_at_an_end(spark):
    rows = [r for p in range(4) for r in [line(f"Preface {('x', 'xi', 'xii', 'xiii')[p]}", 585, size=9, page=p), *body(p, 5)]]
    assert {w for *_, w in removed(spark, rows)} == {"folio"}
    assert removed(spark, rows[:6]) == []  # a document of one page has no headers


@pytest.mark.parametrize("text, folio, bare", [("8 | Chapter 1", True, "| Chapter 1"), ("Preface | xiii", True, "Preface |"), ("a | b", False, None), ("XIII | a", False, None), ("12 Chapter 2", False, "Chapter 2"), ("Preface xiii", False, "Preface"), ("12", False, None), ("title |", True, None), ("12345 a", False, None)])
def test_shapes(spark, text, folio, bare):
    r = spark.range(1).select(paragraphs.folio_shape(F.lit(text)).alias("f"), paragraphs.without_number(F.lit(text)).alias("b")).first()
    assert (r.f, r.b) == (folio, bare)


def test_texts_stay_where_they_are(spark):
    """The rules ask for signs of a text; no shuffle of starts moves the text."""
    rows = [line(f"line {i} of the page", 580 - 14 * i, page=p, doc=n) for n in (1, 2) for p in (0, 1) for i in range(6)]
    d = paragraphs.paragraph_starts(paragraphs.in_context(frame(spark, rows))).select("doc_id", "page", "line", "starts")
    plan = spark._jvm.PythonSQLUtils.explainString(d._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any("text#" in x for x in moved)
    assert {(r.doc_id, r.page) for r in d.where("starts").collect()} == {(n, p) for n in (1, 2) for p in (0, 1)}
