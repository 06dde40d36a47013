"""Office packages: parts of zip files as rows, workbook cells, document text."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.cells import with_shared_formulas


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def resolved(folder: str, target: str) -> str:
    """A relationship's target as a part name."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))


def parts(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """path, part, content of every zip member whose name matches; files that aren't zip give no rows.

    One file is opened in one task and its members leave one by one."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, data in zip(b["path"], b["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name in z.namelist():
                            if re.fullmatch(pattern, name) and not name.endswith("/"):
                                yield pd.DataFrame({"path": [where], "part": [name], "content": [z.read(name)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(opened, "path string, part string, content binary")


def kind_of(content, name):
    """What a file is by its first bytes and its name."""
    head = F.hex(F.substring(content, 1, 8))
    low = F.lower(name)
    return (
        F.when(head.startswith("D0CF11E0"), "old office")
        .when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304") & low.endswith(".xlsx"), "xlsx")
        .when(head.startswith("504B0304") & low.endswith(".docx"), "docx")
        .when(head.startswith("504B0304") & low.endswith(".pptx"), "pptx")
        .when(head.startswith("504B0304") & low.endswith(".epub"), "epub")
        .when(head.startswith("504B0304"), "zip")
        .when(low.rlike(r"\.(csv|tsv|txt)$"), "delimited")
        .otherwise("unknown")
    )


def _strings(xml: bytes) -> Iterator[str]:
    for si in ElementTree.fromstring(xml):
        yield "".join(t.text or "" for t in si.iter() if _local(t.tag) == "t")


def _cells(xml: bytes) -> Iterator[tuple]:
    row_no = 0
    for row in (e for e in ElementTree.fromstring(xml).iter() if _local(e.tag) == "row"):
        row_no = int(row.get("r", row_no + 1))
        col = 0
        for c in row:
            ref = re.match("[A-Z]+", c.get("r", ""))
            col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) if ref else col + 1
            got = {_local(x.tag): x for x in c}
            raw = got["v"].text if "v" in got else "".join(t.text or "" for t in got["is"].iter() if _local(t.tag) == "t") if "is" in got else None
            f = got.get("f")
            shared = int(f.get("si")) if f is not None and f.get("t") == "shared" and (f.get("si") or "").isdigit() else None
            yield row_no, col, c.get("t", "n"), raw, None if f is None else "=" + (f.text or ""), int(c.get("s", 0)), shared


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, t (n, s, b, e), n, s, b, e, formula, style of every cell of visible sheets.

    Shared strings are a table of their own, joined by index; a missing one is empty text.  Cells that share a formula
    have it moved to their place."""
    all_ = parts(spark, path, r"xl/(?:workbook\.xml|_rels/workbook\.xml\.rels|sharedStrings\.xml|worksheets/.*\.xml)")

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, xml in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(where, i, s) for i, s in enumerate(_strings(xml))], columns=["path", "idx", "text"])

    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, own in b.groupby("path"):
                names = {e.get(next(k for k in e.keys() if _local(k) == "id" and k != "id")): e for x in own.loc[own["part"] == "xl/workbook.xml", "content"] for e in ElementTree.fromstring(x).iter() if _local(e.tag) == "sheet"}
                for x in own.loc[own["part"] != "xl/workbook.xml", "content"]:
                    rows = [(where, resolved("xl", r.get("Target")), names[r.get("Id")].get("name"), i) for i, r in enumerate(ElementTree.fromstring(x)) if r.get("Id") in names and names[r.get("Id")].get("state", "visible") == "visible"]
                    yield pd.DataFrame(rows, columns=["path", "part", "sheet", "sheet_no"])

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, part, xml in zip(b["path"], b["part"], b["content"], strict=True):
                yield pd.DataFrame([(where, part, *c) for c in _cells(xml)], columns=["path", "part", "row", "col", "kind", "raw", "formula", "style", "shared"]).astype({"shared": "Int32"})

    shared = all_.where("part = 'xl/sharedStrings.xml'").mapInPandas(strings, "path string, idx long, text string")
    heads = all_.where("part in ('xl/workbook.xml', 'xl/_rels/workbook.xml.rels')").groupBy("path").applyInPandas(lambda g: next(sheets(iter([g])), pd.DataFrame(columns=["path", "part", "sheet", "sheet_no"])), "path string, part string, sheet string, sheet_no int")
    raw = all_.where("part like 'xl/worksheets/%'").mapInPandas(cells, "path string, part string, row int, col int, kind string, raw string, formula string, style int, shared int")
    raw = with_shared_formulas(raw, ["path", "part"])
    d = raw.join(heads, ["path", "part"]).withColumn("idx", F.when(F.col("kind") == "s", F.col("raw").try_cast("long")))
    d = d.join(shared, ["path", "idx"], "left")
    t = F.when(F.col("kind").isin("s", "str", "inlineStr"), "s").when(F.col("kind") == "b", "b").when(F.col("kind") == "e", "e").otherwise("n")
    s = F.when(F.col("kind") == "s", F.coalesce("text", F.lit(""))).when(F.col("kind").isin("str", "inlineStr"), F.col("raw"))
    d = d.withColumn("t", t)
    return d.select("path", "sheet", "sheet_no", "row", "col", "t", F.when(F.col("t") == "n", F.col("raw").try_cast("double")).alias("n"), s.alias("s"), F.when(F.col("t") == "b", F.col("raw") == "1").alias("b"), F.when(F.col("t") == "e", F.col("raw")).alias("e"), "formula", "style")


def workbook_styles(spark: SparkSession, path: str) -> DataFrame:
    """path, part (format, font, fill, border or xf), idx and the fields of that part: the style tables of workbooks.

    Colours are those given outright; a border is the sides that have a line."""
    fields = "code string, font struct<name:string,size:double,bold:boolean,italic:boolean,underline:boolean,strike:boolean,color:string>, color string, borders array<string>, format_id int, font_id int, fill_id int, border_id int, horizontal string, vertical string, wrap boolean, indent int"
    names = [x.split(" ")[0] for x in re.split(", (?![^<]*>)", fields)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for where, xml in zip(b["path"], b["content"], strict=True):
                for kind, idx, own in _styles(xml):
                    rows.append((where, kind, idx, *[own.get(n) for n in names]))
            out = pd.DataFrame(rows, columns=["path", "part", "idx", *names])
            yield out.astype({n: "Int32" for n in ("format_id", "font_id", "fill_id", "border_id", "indent")} | {"wrap": "boolean"})

    return parts(spark, path, r"xl/styles\.xml").mapInPandas(read, f"path string, part string, idx int, {fields}")


def _styles(xml: bytes) -> Iterator[tuple[str, int, dict]]:
    root = {_local(e.tag): e for e in ElementTree.fromstring(xml)}
    children = lambda name: list(root[name]) if name in root else []
    on = lambda e, off=("0", "false", "none"): e is not None and e.get("val") not in off
    rgb = lambda e: "#" + e.get("rgb")[-6:].lower() if e is not None and e.get("rgb") else None
    for e in children("numFmts"):
        yield "format", int(e.get("numFmtId")), {"code": e.get("formatCode", "General")}
    for i, e in enumerate(children("fonts")):
        f = {_local(x.tag): x for x in e}
        name, size = f.get("name"), f.get("sz")
        own = {"name": None if name is None else name.get("val"), "size": float(size.get("val", 11)) if size is not None else 11.0, "color": rgb(f.get("color"))}
        yield "font", i, {"font": own | {k: on(f.get(tag)) for k, tag in (("bold", "b"), ("italic", "i"), ("underline", "u"), ("strike", "strike"))}}
    for i, e in enumerate(children("fills")):
        p = next((x for x in e if _local(x.tag) == "patternFill" and x.get("patternType", "none") != "none"), None)
        c = {} if p is None else {_local(x.tag): x for x in p}
        yield "fill", i, {"color": rgb(c.get("fgColor")) or (rgb(c.get("bgColor")) if p is not None and p.get("patternType") == "solid" else None)}
    for i, e in enumerate(children("borders")):
        sides = {{"start": "left", "end": "right"}.get(_local(x.tag), _local(x.tag)) for x in e if x.get("style", "none") != "none"}
        yield "border", i, {"borders": [s for s in ("left", "right", "top", "bottom") if s in sides]}
    for i, e in enumerate(children("cellXfs")):
        a = next((x for x in e if _local(x.tag) == "alignment"), None)
        at = {} if a is None else a.attrib
        ids = {f"{k}_id": int(e.get(tag, 0)) for k, tag in (("format", "numFmtId"), ("font", "fontId"), ("fill", "fillId"), ("border", "borderId"))}
        yield "xf", i, ids | {"horizontal": at.get("horizontal"), "vertical": at.get("vertical"), "wrap": at.get("wrapText") in ("1", "true"), "indent": int(at.get("indent", 0))}


#: Parts of a chart's series, and by what a part may give its points.
SERIES_PARTS = {"tx": "name", "cat": "category", "xVal": "category", "val": "value", "yVal": "value", "bubbleSize": "size"}
POINT_LISTS = {"numRef": "number", "numLit": "number", "strRef": "text", "strLit": "text", "multiLvlStrRef": "text"}


def _series(xml: bytes) -> Iterator[tuple]:
    first = lambda e, *tags: next((x for x in e if _local(x.tag) in tags), None)
    number = 0
    for area in (e for e in ElementTree.fromstring(xml).iter() if _local(e.tag) == "plotArea"):
        for group in (e for e in area if _local(e.tag).endswith("Chart")):
            for ser in (e for e in group if _local(e.tag) == "ser"):
                for part in (e for e in ser if _local(e.tag) in SERIES_PARTS):
                    given = first(part, *POINT_LISTS)
                    if given is None:
                        continue
                    tag = _local(given.tag)
                    held = given if tag.endswith("Lit") else first(given, "numCache", "strCache", "multiLvlStrCache")
                    if held is not None and _local(held.tag) == "multiLvlStrCache":
                        count, held = first(held, "ptCount"), first(held, "lvl")  # the innermost level
                    else:
                        count = None if held is None else first(held, "ptCount")
                    points = [] if held is None else [(int(p.get("idx", 0)), (first(p, "v").text or "") if first(p, "v") is not None else "") for p in held if _local(p.tag) == "pt"]
                    n = None if held is None else int(count.get("val", 0)) if count is not None else max((i for i, _ in points), default=-1) + 1
                    f = first(given, "f")
                    yield number, _local(group.tag)[:-5], SERIES_PARTS[_local(part.tag)], POINT_LISTS[tag], None if f is None else f.text, n, [{"idx": i, "text": t} for i, t in points]
                number += 1


def chart_series(spark: SparkSession, path: str) -> DataFrame:
    """path, part, series, chart, role (name, category, value, size), kind (number or text), formula, n (points of its cache, null: no
    cache) and points (idx, text) of the chart parts of workbooks, as ``charts.filled`` takes them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(where, part, *s) for where, part, xml in zip(b["path"], b["part"], b["content"], strict=True) for s in _series(xml)]
            yield pd.DataFrame(rows, columns=["path", "part", "series", "chart", "role", "kind", "formula", "n", "points"]).astype({"n": "Int64"})

    schema = "path string, part string, series int, chart string, role string, kind string, formula string, n long, points array<struct<idx:long,text:string>>"
    return parts(spark, path, r"xl/charts/chart[^/]*\.xml").mapInPandas(read, schema)


def document_tokens(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, par_no, kind, text of the body of word documents: text, tab, break, code (of a field), begin, separate,
    end, note (text is its id).  Hidden and deleted runs give none, but the marks of fields in them."""
    marks = {"t": "text", "tab": "tab", "br": "break", "cr": "break", "instrText": "code", "footnoteReference": "note", "endnoteReference": "note"}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for where, xml in zip(b["path"], b["content"], strict=True):
                for i, p in enumerate(e for e in ElementTree.fromstring(xml).iter() if _local(e.tag) == "p"):
                    for r in (e for e in p.iter() if _local(e.tag) == "r"):
                        hidden = any(_local(x.tag) == "vanish" for x in r.iter())
                        for x in r:
                            tag, val = _local(x.tag), {_local(k): v for k, v in x.attrib.items()}
                            if tag == "fldChar":
                                rows.append((where, len(rows), i, val.get("fldCharType"), None))
                            elif tag in marks and not hidden:
                                rows.append((where, len(rows), i, marks[tag], val.get("id") if marks[tag] == "note" else x.text or ""))
                    rows.append((where, len(rows), i, "paragraph", None))
            yield pd.DataFrame(rows, columns=["path", "seq", "par_no", "kind", "text"])

    return parts(spark, path, r"word/document\.xml").mapInPandas(read, "path string, seq long, par_no int, kind string, text string")


def document_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, par_no, style, text of the body of word documents; hidden and deleted runs are skipped."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, xml in zip(b["path"], b["content"], strict=True):
                rows = []
                for i, p in enumerate(e for e in ElementTree.fromstring(xml).iter() if _local(e.tag) == "p"):
                    text, style = [], ""
                    for r in p.iter():
                        tag = _local(r.tag)
                        if tag == "pStyle":
                            style = next(iter(r.attrib.values()), "")
                        elif tag == "r" and not any(_local(x.tag) == "vanish" for x in r.iter()):
                            text += [x.text or "" if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else "" for x in r]
                    rows.append((where, i, style, "".join(text)))
                yield pd.DataFrame(rows, columns=["path", "par_no", "style", "text"])

    return parts(spark, path, r"word/document\.xml").mapInPandas(read, "path string, par_no int, style string, text string")


def slide_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, part, box_no, text of the text boxes of visible slides."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, part, xml in zip(b["path"], b["part"], b["content"], strict=True):
                root = ElementTree.fromstring(xml)
                boxes = [] if root.get("show") == "0" else [e for e in root.iter() if _local(e.tag) == "txBody"]
                rows = [(where, part, i, "\n".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in e if _local(p.tag) == "p")) for i, e in enumerate(boxes)]
                yield pd.DataFrame(rows, columns=["path", "part", "box_no", "text"])

    return parts(spark, path, r"ppt/slides/slide\d+\.xml").mapInPandas(read, "path string, part string, box_no int, text string")


def protection(content):
    """What a PDF file lets one do, by the names in its bytes: open, restricted or password, or invalid."""
    text = F.decode(content, "ISO-8859-1")
    encrypted = text.contains("/Encrypt")
    return F.when(~F.left(text, F.lit(1024)).contains("%PDF-"), "invalid").when(~encrypted, "open").otherwise("protected")


def exif_orientation(files: DataFrame) -> DataFrame:
    """path, orientation (1 to 8) of JPEG files (path, content); 1 where none is given."""
    import struct

    def read(data: bytes) -> int:
        at = 2
        while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            if kind == 0xE1 and body[:6] == b"Exif\0\0" and len(body) >= 14:
                order = "<" if body[6:8] == b"II" else ">"
                first = 6 + struct.unpack(order + "I", body[10:14])[0]
                for i in range(struct.unpack(order + "H", body[first : first + 2])[0] if first + 2 <= len(body) else 0):
                    entry = body[first + 2 + 12 * i : first + 14 + 12 * i]
                    if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                        return struct.unpack(order + "H", entry[8:10])[0]
            if kind == 0xDA:
                break
            at += 2 + size
        return 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "orientation": [read(c) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, orientation int")
