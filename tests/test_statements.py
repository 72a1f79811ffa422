import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coffer.sources import decoding, statements, workbooks


def rows(df):
    return [(r["date"], r["amount"], r["merchant_raw"], r["account"], r["memo"]) for r in df.orderBy("date", "amount").collect()]


def test_csv_with_preamble_days_first_and_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'My bank;;;\n\nBooking date;Payee;Amount;Memo\n03/05/2025;"Acme; ""Inc""";-1.234,50;first\n31/05/2025;Bolt;(9,99);"two\nlines"\nnonsense;Bolt;1;x\n04/05/2025;;3;no payee\n',
        encoding="utf-8",
    )
    assert rows(statements.read_statement(spark, str(path))) == [
        (dt.date(2025, 5, 3), Decimal("-1234.5000"), 'Acme; "Inc"', None, "first"),
        (dt.date(2025, 5, 31), Decimal("-9.9900"), "Bolt", None, "two\nlines"),
    ]


def test_csv_positive_debits_and_bom(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes("\ufeffDate,Description,Amount,Account\n2025-01-02,Café,5.00,Card\n2025-01-03,Bolt,6,Card\n".encode())
    got = rows(statements.read_statement(spark, str(path)))
    assert got == [(dt.date(2025, 1, 2), Decimal("-5.0000"), "Café", "Card", None), (dt.date(2025, 1, 3), Decimal("-6.0000"), "Bolt", "Card", None)]


def test_csv_without_header_is_refused(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("a,b\nc,d\n")
    with pytest.raises(statements.UnreadableStatement):
        statements.read_statement(spark, str(path))
    with pytest.raises(statements.UnreadableStatement):
        statements.read_statement(spark, str(tmp_path / "d.xls"))


@pytest.mark.parametrize("close", ["</STMTTRN>", ""])
def test_ofx(spark, tmp_path, close):
    one = f"<STMTTRN><DTPOSTED>20250102120000[-5:EST]\n<TRNAMT>-5.00\n<FITID>1\n<MEMO>bill\n{close}"
    two = f"<STMTTRN><DTPOSTED>20250103<TRNAMT>7<FITID>2{close}<STMTTRN><DTPOSTED>x<TRNAMT>1{close}"
    path = tmp_path / "a.qfx"
    path.write_text(f"OFXHEADER:100\n<OFX><STMTRS><CURDEF>USD<ACCTID>9\n<BANKTRANLIST>{one}{two}</BANKTRANLIST><BALAMT>3</STMTRS></OFX>")
    assert rows(statements.read_statement(spark, str(path))) == [
        (dt.date(2025, 1, 2), Decimal("-5.0000"), "bill", "9", "bill"),
        (dt.date(2025, 1, 3), Decimal("7.0000"), "Unknown merchant", "9", None),
    ]


def test_json(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(
        '{"accounts": [{"id": "1", "name": " ", "transactions": [{"id": "a", "posted": 0, "transacted_at": 1735776000, "amount": "-5.5", "payee": "Bolt"},'
        ' {"id": "b", "posted": "2025-01-03T00:00:00Z", "amount": "2", "memo": "m"}, {"id": "c", "posted": 0, "amount": "1"}]}, {"id": "2", "name": "n", "transactions": []}]}'
    )
    assert rows(statements.read_statement(spark, str(path))) == [
        (dt.date(2025, 1, 2), Decimal("-5.5000"), "Bolt", "1", None),
        (dt.date(2025, 1, 3), Decimal("2.0000"), "m", "1", "m"),
    ]
    assert statements.json_transactions(spark.createDataFrame([("no json",), (None,)], "value string")).count() == 0


@pytest.mark.parametrize(
    ("content", "name", "garbled"),
    [
        ("a,b\né,1\n".encode(), "UTF-8", False),
        (b"\xef\xbb\xbfa,b\nc,1\n", "UTF-8", False),
        (b"a,b\n\xe9\x80,1\n", "windows-1252", False),
        (b"a,b\n\x8f,1\n", "macOSRoman", False),
        (b"a,b\n\xc3(,1\n", "windows-1252", True),
        ("a,b\né,1\n".encode("utf-16"), "UTF-16", False),
        ("a,b\né,1\n".encode("utf-16-le"), "UTF-16", False),
        ("a,b\né,1\n".encode("utf-16-be"), "UTF-16BE", False),
        (b"no table", "UTF-8", False),
        (b"", "UTF-8", False),
        (b"a,b\n" + 20_000 * b"x,y\n" + b"\xe9,1\n", "windows-1252", False),
    ],
)
def test_encodings(spark, content, name, garbled):
    got = decoding.decoded(spark.createDataFrame([("p", content), ("q", None)], "path string, content binary")).orderBy("path").collect()
    assert (got[0]["encoding"], got[0]["garbled"]) == (name, garbled)
    assert got[1]["text"] is None and got[1]["encoding"] is None


def test_feeds_need_a_tag(spark):
    feed = "<OFX>\né</OFX>"
    rows = [("a", feed.encode("utf-16-be")), ("b", b"no feed"), ("c", feed.encode("latin-1"))]
    got = decoding.decoded(spark.createDataFrame(rows, "path string, content binary"), feed=True).orderBy("path").collect()
    assert [(r["text"], r["encoding"]) for r in got] == [(feed, "UTF-16BE"), (None, None), (feed, "windows-1252")]


@pytest.mark.parametrize("codec", ["utf-8", "cp1252", "utf-16", "utf-16-be"])
def test_csv_in_other_encodings(spark, tmp_path, codec):
    path = tmp_path / "e.csv"
    end = "\n" if codec == "cp1252" else "\u2028"
    path.write_bytes(f"Date,Payee,Amount,Memo\r\n2025-01-02,Café,-5,a\r2025-01-03,Bolt,-6,b{end}".encode(codec))
    mapping = statements.infer(spark, str(path))
    assert dict(mapping.columns)["merchant"] == 1 and not mapping.garbled
    assert rows(statements.read_statement(spark, str(path))) == [
        (dt.date(2025, 1, 2), Decimal("-5.0000"), "Café", None, "a"),
        (dt.date(2025, 1, 3), Decimal("-6.0000"), "Bolt", None, "b"),
    ]


def test_every_file_is_sized(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Payee,Amount\n2025-01-02,Bolt,-5\n")
    (tmp_path / "b.csv").write_text("Date,Payee,Amount\n2025-01-02,Bolt,-5\n" * 9)
    assert decoding.files(spark, f"{tmp_path}/*.csv").count() == 2
    with pytest.raises(statements.UnreadableStatement):
        decoding.files(spark, f"{tmp_path}/*.csv", max_bytes=200)


@pytest.mark.parametrize("shared", [True, False])
def test_workbook(spark, tmp_path, shared):
    path = tmp_path / "a.xlsx"
    table = [["My bank"], [], ["Date", None, "Merchant", "Amount"], [dt.date(2025, 1, 2), "aside", "A & <B>", Decimal("-5.50")], [dt.date(2025, 1, 3), None, "Bolt", -6e-1], [None, None, "no date", 1]]
    path.write_bytes(workbooks.workbook(table, shared))
    assert rows(statements.read_statement(spark, str(path))) == [
        (dt.date(2025, 1, 2), Decimal("-5.5000"), "A & <B>", None, None),
        (dt.date(2025, 1, 3), Decimal("-0.6000"), "Bolt", None, None),
    ]


def _book(sheet, styles="", strings="", properties=""):
    """A workbook as other programs write it: two sheets out of order, absolute targets, prefixed names."""
    main, office, package = workbooks.MAIN, workbooks.OFFICE, workbooks.PACKAGE
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="a" Type="{office}/officeDocument" Target="/book/main.xml"/></Relationships>')
        book.writestr("book/main.xml", f'<x:workbook xmlns:x="{main}" xmlns:r="{office}">{properties}<x:sheets><x:sheet name="B" sheetId="2" r:id="q"/><x:sheet name="A" sheetId="1" r:id="p"/></x:sheets></x:workbook>')
        links = {"p": ("worksheet", "other.xml"), "q": ("worksheet", "/book/first.xml"), "s": ("sharedStrings", "s.xml"), "t": ("styles", "t.xml")}
        book.writestr("book/_rels/main.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="{i}" Type="{office}/{k}" Target="{to}"/>' for i, (k, to) in links.items()) + "</Relationships>")
        book.writestr("book/first.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        book.writestr("book/other.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        book.writestr("book/s.xml", f'<sst xmlns="{main}">{strings}</sst>')
        book.writestr("book/t.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')
    return out.getvalue()


def test_cells_of_workbooks(spark):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    strings = "<si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>reading</t></rPh></si>"
    sheet = (
        '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>9</v></c></row>'
        '<row r="5"><c r="C5" s="1"><v>45659.75</v></c><c r="E5" s="2"><v>1.5E2</v></c><c r="AA5" t="b"><v>1</v></c><c t="str"><f>x</f><v>made</v></c></row>'
        '<row><c t="e"><v>#N/A</v></c><c/><c t="inlineStr"><is><t>in</t></is></c><c s="1"><v>x</v></c></row><row/>'
    )
    books = spark.createDataFrame([("a", _book(sheet, styles, strings)), ("b", None), ("c", _book(""))], "path string, content binary")
    got = [(r["row"], r["cells"]) for r in workbooks.sheet_rows(books).orderBy("row").collect()]
    assert got == [
        (0, ["plain", "two runs", "9"]),
        (4, [None, None, "2025-01-02", None, "150", *[None] * 21, "1", "made"]),
        (5, ["#N/A", "", "in", "x"]),
        (6, []),
    ]
    old = _book('<row><c s="1"><v>0</v></c></row>', styles, "", f'<x:workbookPr xmlns:x="{workbooks.MAIN}" date1904="1"/>')
    assert list(workbooks.first_sheet(old)) == [(0, ["1904-01-01"])]


def test_no_workbook_is_refused(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    path.write_bytes(b"no zip")
    with pytest.raises(Exception, match="no workbook"):
        statements.read_statement(spark, str(path))


def test_long_sheets_come_in_batches(spark):
    content = workbooks.workbook([[k, f"row {k}"] for k in range(9_000)])
    got = workbooks.sheet_rows(spark.createDataFrame([("a", content)], "path string, content binary"))
    assert got.agg(F.count("*"), F.sum("row"), F.count_distinct("cells")).first() == (9_000, sum(range(9_000)), 9_000)
