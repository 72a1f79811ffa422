"""Workbooks (XLSX): the rows of their first sheets (SRC-11).

A workbook is one row (path, content) and is read by one task, which streams the sheet; only the shared strings are
held, up to a stated size. Dates are told by the style of their cells.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from .decoding import UnreadableStatement, row_batches

MAX_STRINGS, MAX_COLUMNS = 256 * 1024 * 1024, 16_384
# The numbers of the built-in formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _related(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """By id: kind and path of the parts that ``part`` refers to."""
    folder, name = posixpath.split(part)
    try:
        root = ElementTree.fromstring(book.read(posixpath.join(folder, "_rels", f"{name}.rels")))
    except KeyError:
        return {}
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, r.get("Target", ""))).lstrip("/")) for r in root}


def _streamed(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of that name one by one; each is forgotten when the next is asked for."""
    parents: list[ElementTree.Element] = []
    with book.open(part) as stream:
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if _plain(element.tag) == tag:
                yield element
                if parents:
                    parents[-1].remove(element)


def _text(element: ElementTree.Element) -> str:
    """All runs of a text, without its phonetic reading."""
    return "".join(_text(e) if _plain(e.tag) == "r" else e.text or "" for e in element if _plain(e.tag) in ("t", "r"))


def _date_styles(book: zipfile.ZipFile, part: str | None) -> list[bool]:
    """Of each cell style, whether it shows a date."""
    if part is None:
        return []
    root = ElementTree.fromstring(book.read(part))
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(f"{{{MAIN}}}numFmt")}
    dated = {k for k, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\[(?![hms]+\])[^\]]*\]', "", code.lower()))}
    styles = root.find(f"{{{MAIN}}}cellXfs")
    ids = [x.get("numFmtId", "0") for x in styles] if styles is not None else []
    return [i in dated or (i not in own and int(i) in DATE_FORMATS) for i in ids]


def _column(reference: str) -> int:
    """Place of a column by its letters, from 0."""
    k = 0
    for c in re.match("[A-Z]*", reference).group():
        k = 26 * k + ord(c) - 64
    return k - 1


def _shown(cell: ElementTree.Element, strings: list[str], dates: list[bool], first_day: dt.datetime) -> str:
    """A cell's text: a shared one, an inline one, a date by its style, a plain number, or what stands there."""
    kind, style = cell.get("t", "n"), int(cell.get("s", 0))
    if kind == "inlineStr":
        return "".join(_text(e) for e in cell if _plain(e.tag) == "is")
    raw = next((e.text or "" for e in cell if _plain(e.tag) == "v"), "")
    if kind == "s":
        return strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else raw
    if kind != "n" or not raw:
        return raw
    try:
        number = Decimal(raw)
        if style < len(dates) and dates[style]:
            return (first_day + dt.timedelta(days=float(number))).date().isoformat()
        return format(number, "f")
    except (InvalidOperation, OverflowError, ValueError):
        return raw


def first_sheet(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(number from 0, cells by column) of each row of the first sheet; null where a row has no such cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        start = next((p for kind, p in _related(book, "").values() if kind == "officeDocument"), "xl/workbook.xml")
        workbook, parts = ElementTree.fromstring(book.read(start)), _related(book, start)
        sheet = workbook.find(f"{{{MAIN}}}sheets/{{{MAIN}}}sheet")
        if sheet is None:
            raise UnreadableStatement("the workbook has no sheet")
        kinds = {kind: p for kind, p in parts.values()}
        old = workbook.find(f"{{{MAIN}}}workbookPr")
        # Day 60 of the common calendar is a 29 February 1900 that never was; statements are of later days.
        first_day = dt.datetime(1904, 1, 1) if old is not None and old.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        shared, strings = kinds.get("sharedStrings"), []
        if shared:
            if book.getinfo(shared).file_size > MAX_STRINGS:
                raise UnreadableStatement(f"shared strings of over {MAX_STRINGS} bytes")
            strings = [_text(e) for e in _streamed(book, shared, "si")]
        dates, at = _date_styles(book, kinds.get("styles")), -1
        for row in _streamed(book, parts[sheet.get(f"{{{OFFICE}}}id")][1], "row"):
            at = int(row.get("r", at + 2)) - 1
            cells: list[str | None] = []
            for cell in (e for e in row if _plain(e.tag) == "c"):
                k = _column(cell.get("r", ""))
                k = len(cells) if k < 0 else min(k, MAX_COLUMNS - 1)
                cells.extend([None] * (k + 1 - len(cells)))
                cells[k] = _shown(cell, strings, dates, first_day)
            yield at, cells


def sheet_rows(found: DataFrame) -> DataFrame:
    """path, row (from 0) and cells (by column) of the first sheet of workbooks (path, content); a null content has none.

    What is no workbook fails with UnreadableStatement and its path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if content.is_valid:
                    try:
                        yield from row_batches(path, first_sheet(content.as_py()))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                        raise UnreadableStatement(f"{path}: no workbook ({error})") from error

    return found.select("path", "content").mapInArrow(run, "path string, row int, cells array<string>")


def workbook(rows: list[list[str | int | float | Decimal | dt.date | None]], shared: bool = True) -> bytes:
    """A workbook of one sheet; texts are shared or inline, and dates have a style of their own."""
    texts: dict[str, int] = {}

    def cell(k: int, r: int, value) -> str:
        letters, k = "", k + 1
        while k:
            letters, k = chr(65 + (k - 1) % 26) + letters, (k - 1) // 26
        at = f'<c r="{letters}{r}"'
        if isinstance(value, str) and shared:
            return f'{at} t="s"><v>{texts.setdefault(value, len(texts))}</v></c>'
        if isinstance(value, str):
            return f'{at} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        if isinstance(value, dt.date):
            return f'{at} s="1"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
        return f"{at}><v>{value}</v></c>"

    body = "".join(f'<row r="{r}">' + "".join(cell(k, r, v) for k, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    relations = lambda *each: f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Type="{OFFICE}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(each)) + "</Relationships>"
    types = "".join(f'<Override PartName="/{part}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>' for part, kind in {"xl/workbook.xml": "sheet.main", "xl/worksheets/sheet1.xml": "worksheet", "xl/styles.xml": "styles", "xl/sharedStrings.xml": "sharedStrings"}.items())
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": relations(("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r0"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("worksheet", "worksheets/sheet1.xml"), ("styles", "styles.xml"), ("sharedStrings", "sharedStrings.xml")),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">' + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, xml in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + xml)
    return out.getvalue()
