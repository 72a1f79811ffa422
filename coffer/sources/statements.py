"""Statement files as transactions: delimited text, workbooks, OFX and account JSON (SRC-01..11, SRC-14..19, INF-01..10, FN-08).

Every reader returns date, amount (decimal(18,4), debits below zero), merchant_raw, category, account, memo,
currency, external_id and pending. Rows without a date or an amount are left out, as are rows without a merchant
in delimited text and workbooks. Only a sample of bounded length is read in the driver, to find out how a file is written.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import parsed_amount, parsed_date
from ..functions.text import nil_if_blank
from .decoding import MAX_BYTES, UnreadableStatement, decoded, delimited_rows, files, normalized, split_rows
from .workbooks import sheet_rows

COLUMNS = ["date", "amount", "merchant_raw", "category", "account", "memo", "currency", "external_id", "pending"]
SAMPLE_CHARS, HEADER_ROWS, SAMPLE_ROWS = 20_000, 10, 12
SEPARATORS = [",", ";", "\t", "|"]
UNKNOWN = "Unknown merchant"

# Words of column labels, by what the column holds.
KEYWORDS = {
    "date": ["date", "posted date", "transaction date", "post date", "effective date", "booking date", "when", "booked"],
    "amount": ["amount", "transaction amount", "net amount", "debit", "credit", "charge", "payment", "withdrawal", "deposit", "total", "value", "spent", "cost"],
    "merchant": ["merchant", "vendor", "payee", "counterparty", "seller", "name", "who", "store"],
    "memo": ["description", "memo", "details", "statement", "note"],
    "category": ["category", "service category", "type", "classification", "group"],
    "account": ["account", "card", "wallet", "source", "payment method"],
    "currency": ["currency", "curr", "fx currency"],
}


@dataclass(frozen=True)
class Mapping:
    """How a table is written; columns are places in a row, None where there is none.

    The separator of a workbook is empty. The encoding is that of the first file; each file is decoded by its own.
    """

    separator: str
    encoding: str
    labels: tuple[str, ...]
    columns: tuple[tuple[str, int | None], ...]
    day_first: bool
    positive_debits: bool
    confidence: float
    garbled: bool = False

    def place(self, role: str) -> int | None:
        return dict(self.columns)[role]


def label_score(label: str, words: list[str]) -> float:
    """1 for a keyword, 0.9 for a label that holds one, 0.7 for one with all its tokens, else 0."""
    plain = " ".join(re.findall(r"[a-z0-9]+", label.lower()))
    if plain in words:
        return 1.0
    if any(w in plain for w in words):
        return 0.9
    return 0.7 if any(set(w.split()) <= set(plain.split()) for w in words) else 0.0


def _separator(sample: str) -> str:
    """The separator whose commonest row width above one holds for most rows."""

    def fit(s: str) -> tuple[int, int]:
        widths = Counter(len(r) for r in csv.reader(io.StringIO(sample), delimiter=s) if len(r) > 1)
        width, rows = max(widths.items(), key=lambda x: (x[1], x[0])) if widths else (0, 0)
        return rows, width

    return max(SEPARATORS, key=fit)


def _header(rows: list[list[str]]) -> int:
    """The earliest of the first rows in which most roles are named once; a date and an amount are needed."""

    def named(row: list[str]) -> int:
        filled = [c for c in row if c.strip()]
        if len(filled) < 2 or len(set(filled)) < 0.75 * len(filled):
            return 0
        roles = {role for role, words in KEYWORDS.items() for c in filled if len(c) <= 40 and label_score(c, words)}
        return len(roles) if {"date", "amount"} <= roles else 0

    scores = [named(r) for r in rows[:HEADER_ROWS]]
    if not scores or not max(scores):
        raise UnreadableStatement("no row names a date and an amount")
    return scores.index(max(scores))


def infer(spark: SparkSession, path: str) -> Mapping:
    """How the tables at ``path`` are written, from the first 20,000 characters (of workbooks: 22 rows) of the first of them.

    Whether days come before months is settled by the whole date column of all files, and so is whether a text looks garbled.
    """
    found = files(spark, path)
    if _is_workbook(path):
        grid = sheet_rows(found)
        first = grid.agg(F.min("path").alias("p")).first()["p"]
        head = grid.where(F.col("path") == first).orderBy("row").limit(HEADER_ROWS + SAMPLE_ROWS).collect()
        rows = [[c or "" for c in r["cells"]] for r in head]
        return _inferred(spark, rows, grid, "", "", False)
    texts = decoded(found)
    head = texts.select("path", "encoding", F.substring("text", 1, SAMPLE_CHARS).alias("head")).agg(F.min_by(F.struct("head", "encoding"), "path").alias("f")).first()["f"]
    garbled = texts.agg(F.max("garbled").alias("g")).first()["g"]
    sample = normalized(head["head"] or "")
    separator = _separator(sample)
    return _inferred(spark, list(split_rows(sample, separator)), delimited_rows(texts, separator), separator, head["encoding"], bool(garbled))


def _is_workbook(path: str) -> bool:
    return path.lower().endswith(".xlsx")


def _inferred(spark: SparkSession, rows: list[list[str]], grid: DataFrame, separator: str, encoding: str, garbled: bool) -> Mapping:
    """The mapping of a table whose first rows are ``rows`` and all of whose rows are ``grid``."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    at = _header(rows)
    labels = tuple(c.strip() for c in rows[at])
    sample = [[(r[k].strip() if k < len(r) else "") for k in range(len(labels))] for r in rows[at + 1 : at + 1 + SAMPLE_ROWS]]
    fits = _fits(spark, sample, len(labels))
    columns: dict[str, int | None] = {}
    for role in ("date", "amount"):
        # Columns of a workbook without a label are none of the table's.
        best = max((k for k in range(len(labels)) if labels[k] or separator), key=lambda k: (2 * label_score(labels[k], KEYWORDS[role]) + fits[k][role], -k))
        columns[role] = best if fits[best][role] or label_score(labels[best], KEYWORDS[role]) else None
    for role in ("merchant", "memo", "category", "account", "currency"):
        free = [k for k in range(len(labels)) if k not in columns.values()]
        best = max(free, key=lambda k: (label_score(labels[k], KEYWORDS[role]), -k), default=None)
        columns[role] = best if best is not None and label_score(labels[best], KEYWORDS[role]) else None
    if columns["merchant"] is None:
        columns["merchant"], columns["memo"] = columns["memo"], None
    found = sum(columns[r] is not None for r in ("date", "amount", "merchant"))
    amount = fits[columns["amount"]] if columns["amount"] is not None else {"up": 0, "down": 0}
    mapping = Mapping(separator, encoding, labels, tuple(columns.items()), False, amount["up"] > amount["down"], found / 3, garbled)
    if columns["date"] is None:
        return mapping
    first = F.regexp_extract(f"c{columns['date']}", r"^\s*(\d{1,2})[-/.]\d{1,2}[-/.]", 1).try_cast("int")
    days = _cells(grid, mapping).agg(F.max(F.coalesce(first.between(13, 31), F.lit(False))).alias("d")).first()["d"]
    return Mapping(**{**mapping.__dict__, "day_first": bool(days)})


def _fits(spark: SparkSession, sample: list[list[str]], width: int) -> list[dict]:
    """Of each column of the sample, the share of dates and amounts, and how many amounts lie above and below zero."""
    if not sample:
        return [{"date": 0.0, "amount": 0.0, "up": 0, "down": 0} for _ in range(width)]
    df = spark.createDataFrame(sample, ", ".join(f"c{k} string" for k in range(width)))
    aggs = []
    for k in range(width):
        amount = parsed_amount(F.col(f"c{k}"))
        aggs += [
            F.avg(parsed_date(F.col(f"c{k}")).isNotNull().cast("int")).alias(f"date{k}"),
            F.avg(amount.isNotNull().cast("int")).alias(f"amount{k}"),
            F.count_if(amount > 0).alias(f"up{k}"),
            F.count_if(amount < 0).alias(f"down{k}"),
        ]
    row = df.agg(*aggs).first()
    return [{name: row[f"{name}{k}"] or 0 for name in ("date", "amount", "up", "down")} for k in range(width)]


def _grid(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """path, row and cells of every table at ``path``, each text decoded by its own encoding."""
    found = files(spark, path)
    return delimited_rows(decoded(found), separator) if separator else sheet_rows(found)


def _cells(grid: DataFrame, mapping: Mapping) -> DataFrame:
    """All rows as trimmed texts c0, c1, ..., without blank rows and the header."""
    names = [f"c{k}" for k in range(len(mapping.labels))]
    clean = grid.select(*[nil_if_blank(F.get("cells", F.lit(k))).alias(c) for k, c in enumerate(names)])
    header = F.lit(True)
    for c, label in zip(names, mapping.labels):
        header = header & F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.lit(label))
    return clean.where(F.coalesce(*names).isNotNull() & ~header)


def read_table(spark: SparkSession, path: str, mapping: Mapping | None = None) -> DataFrame:
    """Transactions of the delimited files or workbooks at ``path``, which are all written as ``mapping`` says (or as inferred)."""
    mapping = mapping or infer(spark, path)
    return table_transactions(_grid(spark, path, mapping.separator), mapping)


def table_transactions(grid: DataFrame, mapping: Mapping) -> DataFrame:
    """Transactions of rows of cells."""

    def cell(role: str) -> Column:
        k = mapping.place(role)
        return F.lit(None).cast("string") if k is None else F.col(f"c{k}")

    amount = parsed_amount(cell("amount"))
    rows = _cells(grid, mapping).select(
        parsed_date(cell("date"), mapping.day_first).alias("date"),
        (-amount if mapping.positive_debits else amount).cast("decimal(18,4)").alias("amount"),
        cell("merchant").alias("merchant_raw"),
        *[cell(r).alias(r) for r in ("category", "account", "memo", "currency")],
        F.lit(None).cast("string").alias("external_id"),
        F.lit(False).alias("pending"),
    )
    return rows.where("date IS NOT NULL AND amount IS NOT NULL AND merchant_raw IS NOT NULL")


def _tag(block: Column, name: str) -> Column:
    return nil_if_blank(F.regexp_extract(block, rf"(?i)<{name}>([^<\r\n]*)", 1))


def ofx_transactions(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Transactions of OFX texts, one row a text; tags need not be closed. Texts without transactions give none."""
    sections = F.split(F.col(text_col), r"(?i)<(?:CC)?STMTRS>")
    named = F.when(F.size(sections) > 1, F.slice(sections, 2, F.size(sections))).otherwise(sections)
    section = texts.select(F.explode(named).alias("s"))
    closed = F.regexp_extract_all("s", F.lit(r"(?is)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))
    pieces = F.split(F.regexp_replace("s", r"(?is)</BANKTRANLIST>.*", ""), r"(?i)<STMTTRN>")
    opened = F.slice(pieces, 2, F.size(pieces))
    blocks = F.when(F.size(closed) > 0, closed).otherwise(opened)
    drafts = section.select(_tag(F.col("s"), "ACCTID").alias("account"), _tag(F.col("s"), "CURDEF").alias("currency"), F.explode(blocks).alias("b"))
    tags = {"day": "DTPOSTED", "amount": "TRNAMT", "name": "NAME", "payee": "PAYEE", "memo": "MEMO", "own_currency": "CURRENCY", "external_id": "FITID"}
    raw = drafts.select("account", "currency", *[_tag(F.col("b"), tag).alias(c) for c, tag in tags.items()])
    return raw.select(
        F.try_to_timestamp(F.substring(F.regexp_extract("day", r"^\d{8,}", 0), 1, 8), F.lit("yyyyMMdd")).cast("date").alias("date"),
        parsed_amount(F.col("amount")).alias("amount"),
        F.coalesce("name", "payee", "memo", F.lit(UNKNOWN)).alias("merchant_raw"),
        F.lit(None).cast("string").alias("category"),
        "account",
        "memo",
        F.coalesce("own_currency", "currency").alias("currency"),
        "external_id",
        F.lit(False).alias("pending"),
    ).where("date IS NOT NULL AND amount IS NOT NULL")


ACCOUNTS = (
    "accounts array<struct<id string, name string, currency string, transactions array<struct<id string, posted string, transacted_at string, "
    "amount string, description string, payee string, memo string, pending boolean>>>>"
)


def _posted(c: Column) -> Column:
    """A number of seconds above zero, or an ISO time, as a date."""
    seconds = c.try_cast("double")
    stamp = F.when(seconds > 0, F.timestamp_seconds(seconds)).when(seconds.isNull(), F.try_to_timestamp(c))
    return stamp.cast("date")


def json_transactions(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Transactions of account JSON, one document a text; what is no such JSON gives no rows."""
    account = texts.select(F.explode(F.from_json(F.col(text_col), ACCOUNTS)["accounts"]).alias("a"))
    each = account.select("a", F.explode("a.transactions").alias("t"))
    amount = F.col("t.amount").try_cast("decimal(18,4)")
    return each.select(
        F.coalesce(_posted(F.col("t.posted")), _posted(F.col("t.transacted_at"))).alias("date"),
        amount.alias("amount"),
        F.coalesce(*[nil_if_blank(F.col(f"t.{c}")) for c in ("payee", "description", "memo")], F.lit(UNKNOWN)).alias("merchant_raw"),
        F.lit(None).cast("string").alias("category"),
        F.coalesce(nil_if_blank(F.col("a.name")), F.col("a.id")).alias("account"),
        nil_if_blank(F.col("t.memo")).alias("memo"),
        nil_if_blank(F.col("a.currency")).alias("currency"),
        F.col("t.id").alias("external_id"),
        F.coalesce(F.col("t.pending"), F.lit(False)).alias("pending"),
    ).where("date IS NOT NULL AND amount IS NOT NULL")


def read_statement(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of the file at ``path``, read by its extension."""
    kind = path.lower().rpartition(".")[2]
    if kind in ("csv", "xlsx"):
        return read_table(spark, path)
    if kind in ("ofx", "qfx"):
        return ofx_transactions(decoded(files(spark, path), feed=True), "text")
    if kind == "json":
        return json_transactions(spark.read.text(path, wholetext=True))
    raise UnreadableStatement(f"{path}: no reader for .{kind}")
