"""Writers: workbooks and zip archives, one file per group, each written by the task that holds it."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values here and below: the names, namespaces and content types of the file formats.
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``sheet_name``: forbidden characters to spaces, 31 characters, repeats (whatever their case) numbered."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[\[\]:*?/\\\x00-\x1f]", " "))
    base = F.left(F.when(clean == "", "Sheet").otherwise(clean), F.lit(31))
    d = df.withColumn("_base", base)
    k = F.row_number().over(Window.partitionBy(F.lower("_base")).orderBy(order))
    tail = F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise("")
    return d.withColumn("sheet_name", F.concat(F.left("_base", 31 - F.length(tail)), tail)).drop("_base")


def escaped(s: Column) -> Column:
    """Text for XML: control characters gone, the five entities."""
    s = F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook; numbers as numbers, anything else as inline text, None as no cell."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rels = lambda xs: '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/{t}" Target="{p}"/>' for i, t, p in xs) + "</Relationships>"
        z.writestr("_rels/.rels", rels([(1, "officeDocument", "xl/workbook.xml")]))
        z.writestr("xl/_rels/workbook.xml.rels", rels([(i, "worksheet", f"worksheets/sheet{i}.xml") for i in ids]))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {_NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, sheets, strict=True)) + "</sheets></workbook>")
        for i, rows in zip(ids, sheets.values(), strict=True):
            body = []
            for r, row in enumerate(rows, 1):
                cells = []
                for v in row:
                    if v is None:
                        cells.append("<c/>")
                    elif isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f"<c><v>{v!r}</v></c>")
                    else:
                        cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            widths = [min(60, max(8, 1.15 * max(len(str(x)) for x in c) + 2)) for c in zip(*rows)] if rows else []
            cols = "".join(f'<col min="{j}" max="{j}" width="{w:.2f}" customWidth="1"/>' for j, w in enumerate(widths, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet {_NS}>' + (f"<cols>{cols}</cols>" if cols else "") + f"<sheetData>{''.join(body)}</sheetData></worksheet>")
    return out.getvalue()


def workbooks(df: DataFrame, book: str, sheet: str, order: str, values: list[str]) -> DataFrame:
    """(book, content): a workbook per value of ``book``, with a sheet per value of ``sheet``; a book has to
    fit in a task.  Save the bytes with any binary sink."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        sheets = {str(n): [values, *[[None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r] for r in own.sort_values(order)[values].itertuples(index=False)]] for n, own in g.groupby(sheet)}
        return pd.DataFrame({"book": [str(g[book].iloc[0])], "content": [workbook(sheets)]})

    return df.groupBy(book).applyInPandas(one, "book string, content binary")


def archives(df: DataFrame, archive: str, name: str, order: str, content: str) -> DataFrame:
    """(archive, content): a zip per value of ``archive`` with its rows as members, stored as they are; a repeated name
    gets `` (n)`` before its ending.  An archive has to fit in a task."""
    k = F.row_number().over(Window.partitionBy(archive, name).orderBy(order))
    stem, end = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    d = df.withColumn("_name", F.when(k > 1, F.concat(stem, F.lit(" ("), k.cast("string"), F.lit(")"), end)).otherwise(F.col(name)))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for n, data in g.sort_values(order)[["_name", content]].itertuples(index=False):
                z.writestr(n, data)
        return pd.DataFrame({"archive": [str(g[archive].iloc[0])], "content": [out.getvalue()]})

    return d.groupBy(archive).applyInPandas(one, "archive string, content binary")


def document(blocks: list[tuple[str, str]]) -> bytes:
    """A word document of (kind, text): p, h1 to h3, ul, ol."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    styles = {"h1": "Heading1", "h2": "Heading2", "h3": "Heading3", "ul": "ListBullet", "ol": "ListNumber"}
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={quoteattr(styles[k])}/></w:pPr>" if k in styles else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for k, t in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def documents(df: DataFrame, book: str, order: str) -> DataFrame:
    """(book, content): a word document per value of ``book`` from rows (kind, text)."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"book": [str(g[book].iloc[0])], "content": [document(list(g.sort_values(order)[["kind", "text"]].itertuples(index=False)))]})

    return df.groupBy(book).applyInPandas(one, "book string, content binary")
