import zipfile

from pyspark.sql import functions as F

from leafmill.operators import charts, tables, windows
from leafmill.sources import delimited, office, sinks

FRAGMENT = "doc_id long, page int, frag_no int, text string, x double, y double, width double, size double, bold boolean"


def fragments(spark, rows, page=1):
    return spark.createDataFrame([(1, page, i, t, float(x), float(y), len(t) * 5.2, float(s), b) for i, (t, x, y, s, b) in enumerate(rows)], FRAGMENT)


def test_table_between_lines(spark):
    rows = [("A line of text above all of it", 50, 500, 10, False)]
    for r in range(4):
        rows += [(f"R{r}C{c}", 50 + 100 * c, 450 - 16 * r, 10, r == 0) for c in range(3)]
    rows += [("A line of text below the table", 50, 300, 10, False)]
    got = tables.tables(fragments(spark, rows)).collect()
    assert len(got) == 12 and {(r.row_no, r.col, r.text) for r in got} == {(r, c, f"R{r}C{c}") for r in range(4) for c in range(3)}
    assert all(r.bold == (r.row_no == 0) for r in got)


def test_running_text_is_no_table(spark):
    rows = [("some words that make a long line", 50, 500 - 14 * i, 10, False) for i in range(8)]
    assert tables.tables(fragments(spark, rows)).count() == 0


def test_headings(spark):
    pars = [(1, 1, 1, "Title", 24.0), (1, 1, 2, "first line goes on and on to here, the third line of it.", 11.0), (1, 1, 3, "Part", 16.0)]
    got = tables.headings(spark.createDataFrame(pars, "doc_id long, page int, par_no int, text string, size double")).orderBy("par_no").collect()
    assert [r.level for r in got] == [1, None, 2]


def test_continued_tables(spark):
    cols = [(50.0, 90.0), (150.0, 190.0)]
    d = spark.createDataFrame([(1, 1, 0, True, True, cols), (1, 2, 0, True, True, [(53.0, 95.0), (148.0, 200.0)]), (1, 3, 0, True, True, [(90.0, 95.0), (148.0, 200.0)])], "doc_id long, page int, block int, first boolean, last boolean, cols array<struct<c0:double,c1:double>>")
    assert [r.table_no for r in tables.continued(d).orderBy("page").collect()] == [0, 0, 1]


def test_touching_boxes(spark):
    d = spark.createDataFrame([(1, 1, k, float(x), 0.0, 10.0, 10.0) for k, x in (("a", 0), ("b", 11), ("c", 40))], "doc_id long, page int, key string, x double, y double, w double, h double")
    got = {r.key: r.component for r in tables.shared_boxes(d).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_charts(spark):
    d = spark.createDataFrame([("x", 0, 2.0), ("x", 1, -1.0), ("x", 2, 3.0)], "cat string, s int, v double")
    assert [(r.base, r.top) for r in charts.stacked(d, ["cat"], ["s"], "v").orderBy("s").collect()] == [(0, 2), (0, -1), (2, 5)]
    assert [round(r.share, 3) for r in charts.share(d, ["cat"], "v").orderBy("s").collect()] == [0.4, 0, 0.6]
    p = spark.createDataFrame([(1, 0, 5.0, 3), (1, 2, 6.0, 3)], "k int, idx int, v double, n int")
    assert [r.v for r in charts.densify(p, ["k"], "idx", "v", "n").orderBy("idx").collect()] == [5.0, None, 6.0]


def test_as_of_takes_equal_times(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 2, "a")], "k int, t int, v string")
    assert {(r.k, r.t, r.v) for r in windows.as_of(left, right, ["k"], "t", ["v"]).collect()} == {(1, 5, "b"), (1, 1, None), (2, 3, None)}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿a;b;"c;""q"""\r\n1;2;3\r\n;;\r\nx;"two\nlines"\n'.encode())
    (tmp_path / "b.csv").write_bytes("n,é\n1,2".encode("windows-1252"))
    got = {(r.path.rsplit("/")[-1], r.row_no): r.cells for r in delimited.read_delimited(spark, str(tmp_path)).collect()}
    assert got[("a.csv", 0)] == ["a", "b", 'c;"q"'] and got[("a.csv", 1)] == ["1", "2", "3"] and ("a.csv", 2) not in got
    assert got[("b.csv", 0)] == ["n", "é"]


def test_workbook_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("b1", "S", 1, "x", 2.5), ("b1", "S", 2, "y & z", 3.0), ("b1", "T", 1, None, 1.0)], "book string, sheet string, o int, name string, v double")
    for r in sinks.workbooks(d, "book", "sheet", "o", ["name", "v"]).collect():
        (tmp_path / f"{r.book}.xlsx").write_bytes(r.content)
    got = {(r.sheet, r.row, r.col): r.s if r.t == "s" else r.n for r in office.workbook_cells(spark, str(tmp_path)).collect()}
    assert got[("S", 1, 1)] == "name" and got[("S", 2, 2)] == 2.5 and got[("S", 3, 1)] == "y & z" and got[("T", 2, 2)] == 1.0
    names = spark.createDataFrame([(1, "a/b"), (2, "A b"), (3, "x" * 40)], "o int, n string")
    assert [r.sheet_name for r in sinks.sheet_names(names, "n", "o").orderBy("o").collect()] == ["a b", "A b (2)", "x" * 31]


def test_shared_strings_and_documents(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="H" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>hey</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        body = '<row r="3"><c r="B3" t="s"><v>1</v></c><c t="b"><v>1</v></c><c r="E3"><f>A1+1</f><v>4</v></c><c r="F3" t="e"><v>#N/A</v></c><c t="s"><v>9</v></c></row>'
        for i in (1, 2):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    got = {(r.sheet, r.col): r for r in office.workbook_cells(spark, str(tmp_path)).collect()}
    assert {k[0] for k in got} == {"One"} and got["One", 2].s == "ab" and got["One", 3].b and got["One", 5].formula == "=A1+1" and got["One", 5].n == 4 and got["One", 6].e == "#N/A" and got["One", 7].s == ""
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>He</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>no</w:t></w:r><w:r><w:t>y</w:t><w:tab/></w:r></w:p></w:body></w:document>')
    (p,) = office.document_paragraphs(spark, str(tmp_path)).collect()
    assert (p.style, p.text) == ("H1", "Hey\t")
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select(office.kind_of(F.col("content"), F.col("path")).alias("k")).collect()
    assert {r.k for r in kinds} == {"xlsx", "docx"}


def test_two_columns(spark):
    rows = [(1, 1, i, 50.0, 190.0, 600.0 - 14 * i, "I") for i in range(1, 5)] + [(1, 1, 10 + i, 210.0, 350.0, 600.0 - 14 * i, "D") for i in range(1, 5)] + [(1, 1, 0, 50.0, 350.0, 610.0, "C")]
    d = spark.createDataFrame(rows, "doc_id long, page int, line int, x0 double, x1 double, y double, column string")
    assert [r.line for r in tables.reading_order(d).orderBy("place").collect()] == [0, 1, 2, 3, 4, 11, 12, 13, 14]
    (g,) = tables.gutter(d).collect()
    assert (g.g0, g.g1) == (190.0, 210.0)


def test_segments_and_boxes(spark):
    d = spark.createDataFrame([(1, 1, i, 0, x, 20.0, 10.0) for i, x in enumerate((0.0, 22.0, 80.0))], "doc_id long, page int, frag_no int, line int, x double, width double, size double")
    assert [r.segment for r in tables.segments(d).orderBy("frag_no").collect()] == [0, 0, 1]
    s = spark.createDataFrame([(1, 1, 0, 50.0, 150.0, 500.0, 10.0), (1, 1, 1, 50.0, 140.0, 488.0, 10.0), (1, 1, 2, 300.0, 390.0, 488.0, 10.0), (1, 1, 3, 50.0, 150.0, 400.0, 10.0)], "doc_id long, page int, seg_no int, x0 double, x1 double, y double, size double")
    assert [r.box for r in tables.text_boxes(s).orderBy("seg_no").collect()] == [0, 0, 1, 2]


def test_styles(spark):
    from leafmill.operators import styles

    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, based_on string")
    props = spark.createDataFrame([("a", "size", "10"), ("b", "size", "12"), ("a", "bold", "1"), ("x", "size", "9")], "style string, prop string, value string")
    got = {(r.id, r.prop): r.value for r in styles.inherited(tree, props).collect()}
    assert got == {("a", "size"): "10", ("b", "size"): "12", ("c", "size"): "12", ("a", "bold"): "1", ("b", "bold"): "1", ("c", "bold"): "1", ("x", "size"): "9", ("y", "size"): "9"}
    items = spark.createDataFrame([(1, i, lv) for i, lv in enumerate((0, 1, 1, 0, 1, 2))], "k int, o int, lv int")
    assert [r.label for r in styles.level_counters(items, ["k"], "o", "lv", 3).orderBy("o").collect()] == ["1", "1.1", "1.2", "2", "2.1", "2.1.1"]


def test_entities_and_paths(spark):
    from leafmill.functions import drawing

    row = spark.range(1).select(drawing.unescaped(F.lit("a &amp; b &#233;&#x1F600; &lt;")).alias("a"), drawing.joined_path(F.lit("ppt/slides"), F.lit("../media/./i.png")).alias("b")).first()
    assert (row.a, row.b) == ("a & b é😀 <", "ppt/media/i.png")


def test_archives_documents_and_bytes(spark, tmp_path):
    import io
    import struct

    d = spark.createDataFrame([("z", 1, "a.txt", b"1"), ("z", 2, "a.txt", b"2"), ("z", 3, "b", b"3")], "arc string, o int, name string, data binary")
    (r,) = sinks.archives(d, "arc", "name", "o", "data").collect()
    with zipfile.ZipFile(io.BytesIO(r.content)) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a.txt": b"1", "a (2).txt": b"2", "b": b"3"}
    blocks = spark.createDataFrame([("b", 1, "h1", "Title"), ("b", 2, "p", "x < y & z")], "book string, o int, kind string, text string")
    (r,) = sinks.documents(blocks, "book", "o").collect()
    (tmp_path / "w.docx").write_bytes(r.content)
    assert [(p.style, p.text) for p in office.document_paragraphs(spark, str(tmp_path)).orderBy("par_no").collect()] == [("Heading1", "Title"), ("", "x < y & z")]
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xda\0\0"
    files = spark.createDataFrame([("j", jpeg), ("n", b"\xff\xd8\xff\xda\0\0")], "path string, content binary")
    assert {r.path: r.orientation for r in office.exif_orientation(files).collect()} == {"j": 6, "n": 1}
    pdfs = spark.createDataFrame([(b"%PDF-1.4 x",), (b"%PDF-1.7 /Encrypt 5 0 R",), (b"hello",)], "c binary")
    assert [r[0] for r in pdfs.select(office.protection(F.col("c"))).collect()] == ["open", "protected", "invalid"]



def page(spark, *frags):
    rows = [("d", 0, i, t, float(x), float(y), w, size, False) for i, (t, x, y, w, size) in enumerate(frags)]
    return spark.createDataFrame(rows, "doc_id string, page int, frag_no int, text string, x double, y double, width double, size double, bold boolean")


def test_baselines_by_size(spark):
    f = page(spark, ("a", 0, 100, 10.0, 10.0), ("b", 20, 95.5, 10.0, 10.0), ("sup", 32, 104.0, 5.0, 6.0), ("c", 0, 97.5, 5.0, 10.0), ("", 0, 50, 0.0, 10.0))
    got = {r.text: r.line for r in tables.baselines(f).collect()}
    # 4.5 apart at one size are two lines; a small raised one joins; 2.5 apart is within 0.3 of the size
    assert got["a"] == got["sup"] == got["c"] != got["b"] and "" not in got


def test_pages_are_walked_without_a_call_each(spark):
    """Pages that Arrow batches cut give the lines of a loop over each page; tables take one Python step and no join."""
    rows = [(doc, pg, i, "t", float(i % 3 * 100), 500.0 - (i // 3) * 14 + (doc * i % 4), 5.0, 10.0 + doc % 3 * (i % 2), False) for doc in range(40) for pg in (1, 2) for i in range(doc % 9 + 1)]
    f = spark.createDataFrame(rows, FRAGMENT)
    want = {}
    for doc, pg in {r[:2] for r in rows}:
        lines = []
        for _, _, i, _, _, y, _, size, _ in sorted((r for r in rows if r[:2] == (doc, pg)), key=lambda r: (-r[5], r[4], r[2])):
            fits = lambda k: abs(lines[k][0] - y) <= max(size, lines[k][1]) * (0.55 if min(size, lines[k][1]) < 0.85 * max(size, lines[k][1]) else 0.3)  # noqa: B023, E731
            k = next((k for k in range(len(lines) - 1, max(-1, len(lines) - 9), -1) if fits(k)), None)
            if k is None:
                lines.append((y, size))
            elif size > lines[k][1]:
                lines[k] = (y, size)
            want[doc, pg, i] = len(lines) - 1 if k is None else k
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.doc_id, r.page, r.frag_no): r.line for r in tables.baselines(f).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = tables.tables(f)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan and "Join" not in plan


def test_far_rows_do_not_bridge(spark):
    row = lambda y: [(f"l{y}", 0, y, 20.0, 10.0), (f"r{y}", 100, y, 20.0, 10.0)]
    near = page(spark, *row(500), *row(484), ("one", 0, 468, 20.0, 10.0), *row(452), *row(436))
    far = page(spark, *row(500), *row(484), ("one", 0, 454, 20.0, 10.0), *row(424), *row(408))
    blocks = lambda f: {r.block for r in tables.table_blocks(tables.raw_cells(tables.baselines(f))).collect()}
    assert len(blocks(near)) == 1 and len(blocks(far)) == 2


def test_column_bands_against_a_loop(spark):
    from leafmill import plans
    from tests.helpers import SMALL

    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").collect()
    got = {(r.l_suppkey, r.i): r.band for r in plans.QUERIES["column_bands"](spark, SMALL).collect()}
    by = {}
    for r in sorted(li, key=lambda r: (r.l_suppkey, r.l_orderkey, r.l_linenumber, r.l_partkey)):
        by.setdefault(r.l_suppkey, []).append(r.l_quantity)
    want = {}
    for k, widths in by.items():
        used = band = 0
        for i, w in enumerate(widths, 1):
            if i > 1 and used + w > 150:
                used, band = 0, band + 1
            used += w
            want[k, i] = band
    assert got == want


def test_labels_and_spans(spark):
    heads = spark.createDataFrame([(1, 1, 0, "CHAPTER IV"), (1, 1, 1, "The Sea"), (1, 2, 0, "Chapter 5"), (1, 3, 0, "Alone")], "doc_id long, page int, pos int, text string")
    assert [r.text for r in tables.chapter_labels(heads).orderBy("page", "pos").collect()] == ["CHAPTER IV: The Sea", "Chapter 5", "Alone"]
    cells = spark.createDataFrame([(1, 0, 0, "restart"), (1, 1, 0, "continue"), (1, 2, 0, None), (1, 0, 1, None)], "t int, row int, col int, merge string")
    assert {(r.row, r.col): r.rows for r in tables.vertical_spans(cells, ["t"]).collect()} == {(0, 0): 2, (2, 0): 1, (0, 1): 1}


def test_column_profile(spark):
    rows = spark.createDataFrame([("a", 0, ["x", "y" * 70]), ("a", 1, ["x" * 40, "", "z"]), ("b", 0, ["1", "2"]), ("b", 300, ["w" * 50])], "path string, row_no int, cells array<string>")
    got = {(r.path, r.col): (r.width, r.wide) for r in delimited.column_profile(rows).collect()}
    assert got == {("a", 0): (40, True), ("a", 1): (60, True), ("a", 2): (4, True), ("b", 0): (4, False), ("b", 1): (4, False)}
