"""Layout operators against plain walks and cases worked out by hand."""

import colorsys

from pyspark.sql import functions as F

from leafmill import plans
from leafmill.functions import drawing, text
from leafmill.operators import boxes, lines
from tests.helpers import SMALL, duck


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_outline_entries_equal_a_walk(spark):
    got = {tuple(r) for r in plans.QUERIES["main_entries"](spark, SMALL).select("doc", "page", "y", "level", "title").collect()}
    docs = {}
    for key, doc in duck().sql("select o_orderkey, o_custkey from orders").fetchall():
        docs.setdefault(doc, []).append((key % 3, float(key % 40) if key % 11 else None, key % 4, str(key)))
    want = set()
    for doc, all_ in docs.items():
        top = next((n for n in (0, 1) if sum(e[2] <= n for e in all_) >= 2), -1)
        kept = []
        for e in sorted((e for e in all_ if e[2] <= top), key=lambda e: (e[0], -(1e9 if e[1] is None else e[1]), e[2], e[3])):
            last = kept[-1] if kept else None
            if last and last[0] == e[0] and (last[1] is None or e[1] is None or abs(last[1] - e[1]) < 6):
                continue
            kept.append(e)
        want |= {(doc, *e) for e in kept}
    assert got == want and want


def test_slide_counters_equal_a_walk(spark):
    got = {(r.conv_id, r.turn): r.number for r in plans.QUERIES["slide_counters"](spark, SMALL).collect()}
    want, convs = {}, {}
    for conv, turn, t in duck().sql("select conv_id, turn, text from conversations order by 1, 2").fetchall():
        n, counters = len(t or ""), convs.setdefault(conv, {})
        level, kind = n % 3, "char" if n % 7 == 0 else "none" if n % 11 == 0 else "number"
        for deeper in [x for x in counters if x > level]:
            del counters[deeper]
        want[conv, turn] = None
        if kind == "none" or (kind == "char" and (t or "").strip()):
            counters.pop(level, None)
        elif kind == "number" and (t or "").strip():
            want[conv, turn] = counters[level] = counters.get(level, n % 2) + 1
    assert got == want and len(set(want.values())) > 2


def test_fonts(spark):
    assert tuple(one(spark, text.font(F.lit("ABCDEF+GillSansMT-BoldItalic")))) == ("Gill Sans", True, True, False)
    assert tuple(one(spark, text.font(F.lit("Courier-Oblique")))) == ("Courier", False, True, True)
    assert tuple(one(spark, text.font(F.lit("Bold")))) == (None, True, False, False)
    assert tuple(one(spark, text.font(F.lit(None).cast("string")))) == (None, False, False, False)


def test_contents_lines_and_codes(spark):
    contents = {"Chapter one ..... 12": True, "A . . . 7": True, "Three… 4": True, "It cost 12": False, "And so ...": False}
    assert {t: one(spark, text.contents_line(F.lit(t))) for t in contents} == contents
    assert [one(spark, text.font(F.lit(n)))["family"] for n in ("TimesNewRomanPSMT", "Open Sans Light", "DejaVuSansMono,Bold", "HelveticaNeueLTStd-Md")] == ["Times New", "Open Sans", "Deja Vu Sans Mono", "Helvetica Neue"]
    assert [one(spark, text.ends_in_page(F.lit(t))) for t in ("Preface xii", "Chapter 12 ", "12", "a 12345")] == [True, True, False, False]
    assert [one(spark, text.language_code(F.lit(t))) for t in ("es-ES", " EN_us ", "pt", "x", "español", "")] == ["es", "en", "pt", None, None, None]
    assert [one(spark, text.similar_titles(F.lit(a), F.lit(b))) for a, b in (("La Canción", "lacancion"), ("Part 1: The sea", "The Sea"), ("One", "Two"), ("!", "?"))] == [True, True, False, False]


def test_colours(spark):
    mix = lambda c, t: one(spark, drawing.hex_of(*[drawing.tinted(drawing.rgb(F.lit(c)), F.lit(t))[n] for n in "rgb"]))
    for t in (0.4, 0.8, -0.25, 0.0):
        h, l, s = colorsys.rgb_to_hls(0x44 / 255, 0x72 / 255, 0xC4 / 255)
        want = colorsys.hls_to_rgb(h, l * (1 + t) if t < 0 else l * (1 - t) + t, s)
        assert mix("4472C4", t) == "".join(f"{int(v * 255 + 0.5):02X}" for v in want)
    assert mix("000000", 0.5) == "808080" and mix("FFFFFF", -1.0) == "000000"
    lum = drawing.modulated(drawing.rgb(drawing.theme_colour(F.lit("tx1"))), F.lit(0.5), F.lit(0.5))
    assert one(spark, drawing.hex_of(lum["r"], lum["g"], lum["b"])) == "808080"
    assert one(spark, drawing.theme_colour(F.lit("bg2"))) == "e7e6e6" and one(spark, drawing.theme_colour(F.lit("none"))) == "000000"


def test_rectangles(spark):
    f = spark.createDataFrame([(1, 1, 10.0, 50.0, 20.0), (1, 2, 10.0, 96.5, 20.0), (1, 3, 200.0, 50.0, 5.0), (2, 4, 10.0, 50.0, 20.0), (None, 5, 10.0, 50.0, 20.0)], "page long, n long, x double, y double, width double")
    t = spark.createDataFrame([(1, 25.0, 100.0, 90.0, 10.0), (None, None, None, None, None)], "page long, x0 double, x1 double, top double, bottom double")
    assert {r.n for r in boxes.fragments_outside_tables(f, t, ["page"]).collect()} == {2, 3, 4, 5}
    assert boxes.fragments_outside_tables(f, t.limit(0), ["page"]).count() == 5
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 5.0, 5.0, 50.0, 50.0), (1, 3, 0.0, 0.0, 100.0, 100.0), (1, 4, 80.0, 80.0, 60.0, 60.0)], "page long, n long, x double, y double, w double, h double")
    assert {r.n for r in boxes.not_inside_larger(b, ["page"], "n").collect()} == {1, 4}


def test_recognised_and_upright(spark):
    d = spark.createDataFrame([(" a \n b ", 25.0, 10.0, 20.0, 50.0, 40.0, None, 2.0, 100.0), ("low", 24.9, 0.0, 0.0, 1.0, 1.0, None, 1.0, 1.0), (" ", 90.0, 0.0, 0.0, 1.0, 1.0, None, 1.0, 1.0)], "text string, confidence double, x0 double, y0 double, x1 double, y1 double, base double, scale double, page_height double")
    (r,) = boxes.recognised(d).collect()
    assert (r.text, r.x, r.y, r.width) == ("a b", 5.0, 82.0, 20.0) and abs(r["size"] - 7.8) < 1e-9
    m = spark.createDataFrame([("ok", 10.0, 0.0, 0.0, 10.0), ("slant", 10.0, 0.0, 2.0, 10.0), ("turned", 0.0, 10.0, -10.0, 0.0), ("tiny", 0.5, 0.0, 0.0, 0.5), ("", 10.0, 0.0, 0.0, 10.0)], "text string, a double, b double, c double, d double")
    assert {(r.text, r.slanted) for r in boxes.upright(m).collect()} == {("ok", False), ("slant", True)}


def test_areas_references_and_pitch(spark):
    c = spark.createDataFrame([("S", 1, 1, "a"), ("S", 2, 2, "b"), ("T", 9, 9, "c")], "sheet string, row long, col long, value string")
    a = spark.createDataFrame([("S", "b2:$C$4")], "sheet string, area string")
    assert {r.value for r in lines.clipped(c, a, ["sheet"]).collect()} == {"b", "c"}
    r = spark.createDataFrame([(1, "s", 1, 1), (2, "S", 5, 5), (3, "U", 1, 1)], "n long, sheet string, row long, col long")
    assert {x.n: x.value for x in lines.referenced(r, c, []).collect()} == {1: "a", 2: None, 3: "#REF!"}
    p = spark.createDataFrame([(1, 1, i, 100.0 - y, 10.0, "C", 10.0) for i, y in enumerate((0, 12, 24, 36, 56))] + [(2, 1, 0, 5.0, 10.0, "C", 10.0)], "doc long, page long, line long, y double, size double, side string, body double")
    assert {x.doc: round(x.pitch, 6) for x in lines.line_pitch(p, ["doc"]).collect()} == {1: 1.2, 2: 1.25}


def test_heading_levels_equal_a_walk(spark):
    got = {(r.doc, r.at): r.level for r in plans.QUERIES["heading_levels"](spark, SMALL).collect()}
    docs, want = {}, {}
    for k, doc in duck().sql("select o_orderkey, o_custkey from orders order by 1").fetchall():
        docs.setdefault(doc, []).append((k, k % 30, 11 + k * 7 % 23 / 2, k % 4 > 0, k % 5 == 0))
    for doc, all_ in docs.items():
        groups = []
        for _, page, size, large, _ in all_:
            if large:
                if not (g := next((g for g in groups if abs(g[0] - size) < 0.75), None)):
                    groups.append([size, 1, page])
                else:
                    g[1], g[2] = g[1] + 1, max(g[2], page)
        ranks = sorted((g[0] for g in ([g for g in groups if not (g[1] <= 2 and g[2] < 3)] or groups)), reverse=True)
        for k, _, size, large, chapter in all_:
            place = next((i + 1 for i, x in enumerate(ranks) if abs(x - size) < 0.75), max(2, sum(x > size for x in ranks) + 1))
            want[doc, k] = min(3, place if large else 1 if chapter and not ranks else len(ranks) + 1)
    assert got == want and set(want.values()) == {1, 2, 3}


def test_chapter_words(spark):
    words = {"Chapter 1": True, " PARTE II": True, "Particle": False, "Índice": True, "A chapter": False, "": False}
    assert {t: one(spark, text.chapter_word(F.lit(t))) for t in words} == words


def test_own_characters_of_whole_pages(spark):
    """Against a loop; pages go through one shuffle, with nothing joined."""
    words = ["the", "12", "page 3", "iv", "Iv of 9", "- 7 -", "5", "head", "", "  ", "civil", "dm!", "a b", None]
    rows = [(doc, p, 100.0, [(words[((doc or 6) * 7 + p * k + k) % len(words)], float((p + k) * 23 % 100)) for k in range(((doc or 6) + p) % 6)]) for doc in (1, 2, 3, 4, 5, None) for p in range((doc or 4) * 2 - 1)]
    d = spark.createDataFrame(rows, "doc long, page long, height double, fragments array<struct<text:string,y:double>>")
    kept = [(doc, p, (t or "").strip(" "), y) for doc, p, _, fs in rows for t, y in fs if (t or "").strip(" ")]
    pages, on, want = {}, {}, {}
    for doc, p, _, _ in rows:
        pages.setdefault(doc, set()).add(p)
        want[doc, p] = [0, 0]
    for doc, p, t, _ in kept:
        on.setdefault((doc, t), set()).add(p)
    for doc, p, t, y in kept:
        often = doc is not None and len(pages[doc]) >= 4 and len(on[doc, t]) >= max(3, -(-len(pages[doc]) // 4))
        want[doc, p][0] += len(t) if 10 <= y <= 90 and not often and t not in ("12", "page 3", "iv", "Iv of 9", "- 7 -", "5") else 0
        want[doc, p][1] += len(t)
    out = boxes.own_characters(d, ["doc"], "page")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {(r.doc, r.page): [r.own, r.total] for r in out.collect()} == want and any(0 < a < b for a, b in want.values())
