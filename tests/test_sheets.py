"""Shared formulas, cell styles and fields, from packages and from small tables."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import formula, numfmt, sheet
from leafmill.operators import cells, charts, pixels, runs
from leafmill.sources import office

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, body, styles=None):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")


@pytest.mark.parametrize("source", ["=A1+$B2*C$3&\"A1\"", "='My A1'!B2+Data!C3", "=SUM(A1:B2,LOG10(AA10))", "=A1", "=ZZ99+a1", "=1.5E3+X1", "=$A$1", "=\"say \"\"B2\"\"\"&B2"])
def test_shift_as_column(spark, source):
    offsets = [(0, 0), (3, 2), (-1, 0), (0, -1), (100, 30), (-2, -2)]
    d = spark.createDataFrame([(source, r, c) for r, c in offsets], "f string, r int, c int")
    got = d.select("r", "c", formula.shifted_column(F.col("f"), F.col("r"), F.col("c")).alias("o")).collect()
    assert [(x.r, x.c, x.o) for x in got] == [(r, c, formula.shifted(source, r, c)) for r, c in offsets]


def test_shared_formulas(spark):
    rows = [("s", 1, 2, 0, "=A1*2"), ("s", 2, 2, 0, "="), ("s", 3, 3, 0, "="), ("s", 5, 1, 1, "="), ("s", 6, 1, None, "=A1"), ("s", 7, 1, None, None), ("t", 9, 9, 0, "="), ("s", 4, 2, 0, "=A9")]
    d = spark.createDataFrame(rows, "sheet string, row int, col int, shared int, formula string")
    got = {(r.sheet, r.row, r.col): r.formula for r in cells.with_shared_formulas(d, ["sheet"]).collect()}
    assert got == {("s", 1, 2): "=A1*2", ("s", 2, 2): "=A2*2", ("s", 3, 3): "=B3*2", ("s", 5, 1): None, ("s", 6, 1): "=A1", ("s", 7, 1): None, ("t", 9, 9): None, ("s", 4, 2): "=A9"}
    assert cells.with_shared_formulas(d.limit(0), ["sheet"]).count() == 0


def test_shared_formulas_of_a_workbook(spark, tmp_path):
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}"><f t="shared" si="0"{" ref=&quot;B1:B3&quot;".replace("&quot;", chr(34)) if i == 1 else ""}>{"A1+$A$1" if i == 1 else ""}</f><v>{i + 1}</v></c></row>' for i in (1, 2, 3))
    book(tmp_path / "b.xlsx", rows)
    got = {(r.row, r.col): (r.formula, r.n) for r in office.workbook_cells(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): (None, 1.0), (2, 1): (None, 2.0), (3, 1): (None, 3.0), (1, 2): ("=A1+$A$1", 2.0), (2, 2): ("=A2+$A$1", 3.0), (3, 2): ("=A3+$A$1", 4.0)}


def test_styles_of_a_workbook(spark, tmp_path):
    styles = (
        '<numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts>'
        '<fonts><font><sz val="10"/><name val="Arial"/></font><font><b/><i val="0"/><u val="none"/><strike/><color rgb="FF00AA11"/></font></fonts>'
        '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFEE00"/></patternFill></fill></fills>'
        '<borders><border><left/><right/></border><border><left style="thin"/><end style="medium"/><top style="none"/></border></borders>'
        '<cellXfs><xf numFmtId="0" fontId="0"/><xf numFmtId="164" fontId="1" fillId="1" borderId="1"><alignment horizontal="right" wrapText="1" indent="2"/></xf><xf numFmtId="14" fontId="7" fillId="9"/><xf numFmtId="99"/></cellXfs>'
    )
    book(tmp_path / "b.xlsx", '<row r="1">' + "".join(f'<c r="{c}1" s="{s}"><v>45000</v></c>' for c, s in zip("ABCDE", (0, 1, 2, 3, 50), strict=True)) + "</row>", styles)
    d = cells.styled(office.workbook_cells(spark, str(tmp_path)), office.workbook_styles(spark, str(tmp_path)), ["path"])
    got = {r.col: r.look for r in d.collect()}
    assert [got[i].format for i in range(1, 6)] == ["General", "yyyy-mm-dd", "dd/mm/yyyy", "General", "General"]
    assert (got[1].font.name, got[1].font.size, got[1].font.bold, got[1].fill, got[1].borders, got[1].horizontal, got[1].vertical) == ("Arial", 10.0, False, None, [], "general", "bottom")
    assert tuple(got[2].font) == (None, 11.0, True, False, False, True, "#00aa11") and (got[2].fill, got[2].borders, got[2].horizontal, got[2].wrap, got[2].indent) == ("#ffee00", ["left", "right"], "right", True, 2)
    assert got[3].font.name == got[5].font.name == "Arial"  # what isn't there: the first font
    dates = d.where(F.col("look.format") == "yyyy-mm-dd").select(numfmt.formatted(F.col("n"), "yyyy-mm-dd")).first()[0]
    assert dates == "2023-03-15" and [numfmt.is_date_format(got[i].format) for i in range(1, 6)] == [False, True, True, False, False]
    # a book without style tables: defaults all along
    (plain,) = cells.styled(spark.createDataFrame([("x", 3)], "path string, style int"), office.workbook_styles(spark, str(tmp_path)), ["path"]).collect()
    assert (plain.look.format, plain.look.font.size, plain.look.fill) == ("General", 11.0, None)


def walked(kinds):
    stack, out = [], []
    for k in kinds:
        if k == "begin":
            stack.append(False)
        elif k == "separate" and stack:
            stack[-1] = True
        elif k == "end" and stack:
            stack.pop()
        out.append((len(stack), k == "text" and all(stack)))
    return out


def test_fields_equal_a_walk(spark):
    rng = random.Random(8)
    docs = {i: [rng.choice(["begin", "separate", "end", "text", "text"]) for _ in range(rng.randint(1, 40))] for i in range(150)}
    d = spark.createDataFrame([(i, n, k) for i, ks in docs.items() for n, k in enumerate(ks)], "doc int, seq int, kind string")
    got = {}
    for r in runs.with_fields(d, ["doc"], "seq").orderBy("doc", "seq").collect():
        got.setdefault(r.doc, []).append((r.depth, r.shown))
    assert got == {i: walked(ks) for i, ks in docs.items()}


def test_document_runs(spark, tmp_path):
    t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    mark = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    code = lambda x: f"<w:r><w:instrText>{x}</w:instrText></w:r>"
    paras = [
        t("See ") + mark("begin") + code("REF ") + mark("begin") + code("PAGE") + mark("separate") + t("inner in code") + mark("end") + mark("separate") + t("result ") + mark("begin") + code("X") + mark("end") + t("more") + mark("end") + t("."),
        t("a") + '<w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink>' + t("link") + '</w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:endnoteReference w:id="7"/></w:r>',
        "",
        mark("begin") + code("TOC") + mark("separate") + t("over"),
        t("paragraphs") + mark("end") + mark("end") + t(" out"),
    ]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body>' + "".join(f"<w:p>{p}</w:p>" for p in paras) + "</w:body></w:document>")
    got = runs.paragraph_texts(office.document_tokens(spark, str(tmp_path)), ["path"]).orderBy("par_no").collect()
    assert [r.text for r in got] == ["See result more.", "a\tb\nlink", "", "over", "paragraphs out"]
    assert [r.notes for r in got] == [[], ["2", "7"], [], [], []]


def test_overflow(spark):
    cell = lambda row, col, n, is_text=True, wrap=False, h="general", merged=False: ("s", row, col, "x" * n, is_text, 12.0, wrap, h, merged)
    rows = [cell(1, 1, 3), cell(2, 1, 20), cell(3, 1, 20), cell(3, 3, 5), cell(4, 1, 20), cell(4, 4, 0), cell(5, 1, 20, wrap=True), cell(6, 1, 20, h="right"), cell(7, 1, 20, is_text=False), cell(8, 1, 20, merged=True), cell(9, 1, 20, h="left"), cell(10, 4, 99), cell(11, 1, 0), cell(12, 9, 20)]
    d = spark.createDataFrame(rows, "sheet string, row int, col int, text string, is_text boolean, size double, wrap boolean, horizontal string, merged boolean")
    columns = spark.createDataFrame([("s", c, 50.0) for c in range(1, 6)], "sheet string, col int, width double")
    covered = spark.createDataFrame([("s", 9, 2)], "sheet string, row int, col int")
    got = {(r.row, r.col): r.span for r in cells.with_overflow(d, columns, covered, ["sheet"]).collect()}
    # 20 characters need 204.4 pixels, five columns; a filled cell, a covered one and the last column stop them
    assert got == {(1, 1): 1, (2, 1): 5, (3, 1): 2, (3, 3): 1 + (5 * 12 * 0.62 * 96 / 72 + 6 > 50), (4, 1): 5, (4, 4): 1, (5, 1): 1, (6, 1): 1, (7, 1): 1, (8, 1): 1, (9, 1): 1, (10, 4): 2, (11, 1): 1, (12, 9): 1}


def test_cell_ranges(spark):
    cases = {
        "Data!$B$2:$B$4": ("Data", 2, 2, 4, 2), "'It''s'!A1": ("It's", 1, 1, 1, 1), "'a!b'!C9:aa3": ("a!b", 3, 3, 9, 27), " S1!A1 ": ("S1", 1, 1, 1, 1),
        "A1:B2": None, "!A1": None, "S!A": None, "S!A1:B2:C3": None, "S!1:2": None, "''!A1": None, "": None, None: None, "S!ABCD1": None,
    }
    d = spark.createDataFrame([(k,) for k in cases], "ref string").select("ref", sheet.cell_range(F.col("ref")).alias("r"))
    assert {x.ref: None if x.r is None else tuple(x.r) for x in d.collect()} == cases


def test_series_of_a_workbook(spark, tmp_path):
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="str"><v>k{i}</v></c>' + (f'<c r="B{i}"><v>{i * 1.5}</v></c>' if i != 2 else "") + f'<c r="C{i}" t="str"><v>x</v></c></row>' for i in (1, 2, 3))
    book(tmp_path / "b.xlsx", rows)
    ref = lambda part, tag, f, held="": f"<c:{part}><c:{tag}><c:f>{f}</c:f>{held}</c:{tag}></c:{part}>"
    points = lambda n, **at: f'<c:ptCount val="{n}"/>' + "".join(f'<c:pt idx="{k[1:]}"><c:v>{v}</c:v></c:pt>' for k, v in at.items())
    chart = (
        "<c:barChart><c:ser>" + ref("tx", "strRef", "One!$A$1") + ref("cat", "strRef", "One!$A$1:$A$4") + ref("val", "numRef", "One!$C$3:$B$1") + "</c:ser>"
        "<c:ser>" + ref("cat", "multiLvlStrRef", "f", f"<c:multiLvlStrCache><c:ptCount val='3'/><c:lvl>{points(3, i0='in', i2='er').partition('/>')[2]}</c:lvl><c:lvl/></c:multiLvlStrCache>") + ref("val", "numRef", "One!B1:B3", f"<c:numCache>{points(4, i1='7', i3='no')}</c:numCache>") + "</c:ser></c:barChart>"
        "<c:scatterChart><c:ser>" + ref("xVal", "numRef", "Gone!A1") + "<c:yVal><c:numLit><c:pt idx='1'><c:v>2e1</c:v></c:pt></c:numLit></c:yVal>" + ref("bubbleSize", "numRef", "broken") + "</c:ser></c:scatterChart>"
    )
    with zipfile.ZipFile(tmp_path / "b.xlsx", "a") as z:
        z.writestr("xl/charts/chart1.xml", f'<c:chartSpace xmlns:c="c"><c:chart><c:plotArea>{chart}</c:plotArea></c:chart></c:chartSpace>')
    c = office.workbook_cells(spark, str(tmp_path)).withColumn("text", F.coalesce("s", F.col("n").cast("string")))
    got = {}
    for r in charts.filled(office.chart_series(spark, str(tmp_path)), c, ["path"], ["part", "series", "chart", "role"]).orderBy("series", "role", "idx").collect():
        got.setdefault((r.series, r.chart, r.role), []).append(r.text if r.text is not None else r.value)
    assert got == {
        (0, "bar", "name"): ["k1"], (0, "bar", "category"): ["k1", "k2", "k3", ""], (0, "bar", "value"): [1.5, None, None, None, 4.5, None],
        (1, "bar", "category"): ["in", "", "er"], (1, "bar", "value"): [None, 7.0, None, None],
        (2, "scatter", "category"): [None], (2, "scatter", "value"): [None, 20.0], (2, "scatter", "size"): [None],
    }


def test_colours_by_place(spark):
    rng = random.Random(3)
    raster = {(p, x, y): tuple(rng.choice((0, 4, 60, 250)) for _ in range(3)) for p in (0, 1) for x in range(30) for y in range(40)}
    bare = {k: (255, 255, 255) if rng.random() < 0.5 else v for k, v in raster.items()}
    boxes = [(rng.choice((0, 1, 9)), i, rng.uniform(-20, 80), rng.uniform(-20, 90), rng.uniform(0, 30), rng.uniform(1, 14)) for i in range(120)] + [(0, 500, None, 1.0, 1.0, 1.0)]

    def walked(p, x, y, w, s):
        if x is None or p == 9:
            return "000000"
        own = [k for k in raster if k[0] == p and max(0, math.floor(x / 2)) <= k[1] < math.ceil((x + w) / 2) and max(0, math.floor((80 - (y + s * 0.8)) / 2)) <= k[2] < math.ceil((80 - (y - s * 0.25)) / 2)]
        diff = {k: sum(abs(a - b) for a, b in zip(raster[k], bare[k], strict=True)) for k in own}
        best = [raster[k] for k in own if diff[k] >= max(diff.values()) * 0.8]
        if not own or max(diff.values()) < 90 or len(best) < 2:
            return "000000"
        means = [math.floor(sum(c) / len(best) + 0.5) for c in zip(*best, strict=True)]
        return "".join(f"{0 if m <= 10 else 255 if m >= 245 else m:02X}" for m in means)

    pix = lambda d: spark.createDataFrame([(*k, *v) for k, v in d.items()], "page int, x int, y int, r int, g int, b int")
    f = spark.createDataFrame(boxes, "page int, id int, x double, y double, width double, size double")
    pages = spark.createDataFrame([(p, 60.0, 80.0, 30, 40) for p in (0, 1)], "page int, width double, height double, across long, down long")
    for tile in (7, 64):
        got = {r.id: r.colour for r in pixels.coloured(f, pages, pix(raster), pix(bare), ["page"], ["id"], tile).collect()}
        assert got == {b[1]: walked(b[0], *b[2:]) for b in boxes}
    assert len(set(got.values())) > 5
    assert pixels.coloured(f.limit(0), pages, pix(raster), pix(bare), ["page"], ["id"]).count() == 0
