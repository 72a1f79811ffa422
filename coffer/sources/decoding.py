"""Texts of files in an unknown encoding, and the rows of delimited texts (SRC-03..08, SRC-18).

A file is one row (path, content) and goes to one task, which its size bounds (``files`` refuses larger ones); any number
of files are read side by side.
"""

from __future__ import annotations

import csv
import io
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
JUDGED_CHARS, JUDGED_LINES, BATCH_ROWS = 20_000, 10, 4_096

# Encodings in the order in which they are tried, with Python's names; those that fit nearly any bytes.
ENCODINGS = {"UTF-8": "utf-8", "windows-1252": "cp1252", "macOSRoman": "mac_roman", "ISO-8859-1": "latin-1", "UTF-16": "utf-16", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}
SINGLE_BYTE = {"windows-1252", "macOSRoman", "ISO-8859-1"}
# What UTF-8 looks like when it is read as single bytes, and the tags of bank feeds.
MARKERS = ["Ã", "Â", "â€"]
FEED_TAGS = ["<OFX", "<STMTTRN", "<BANKMSGSRSV", "<CREDITCARDMSGSRSV"]


class UnreadableStatement(ValueError):
    """The file is too large, of an unknown kind, or has no header with a date and an amount."""


def files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content) of every file at ``path``; refused if one of them is too large, before any is read."""
    found = spark.read.format("binaryFile").load(path)
    sizes = found.agg(F.count("*").alias("n"), F.max("length").alias("most")).first()
    if not sizes["n"] or sizes["most"] > max_bytes:
        raise UnreadableStatement(f"{path}: no file, or one of over {max_bytes} bytes")
    return found.where(F.col("length") <= max_bytes).select("path", "content")


def looks_tabular(text: str) -> bool:
    """Two lines or more among the first ones, a separator, and hardly a NUL."""
    sample = text[:JUDGED_CHARS]
    lines = [line for line in re.split("[\r\n]+", sample) if line][:JUDGED_LINES]
    return len(lines) > 1 and re.search("[,;\t|]", sample) is not None and sample.count("\0") < 0.01 * len(sample)


def looks_fed(text: str) -> bool:
    """Holds a tag of a bank feed."""
    upper = text.upper()
    return any(tag in upper for tag in FEED_TAGS)


def looks_garbled(text: str) -> bool:
    """Replacement characters, control characters or marks of UTF-8 that was read as single bytes."""
    sample = text[:JUDGED_CHARS]
    strange = sum(unicodedata.category(c) in ("Cc", "Cf") for c in re.sub("[\r\n\t]", "", sample))
    return sample.count("\ufffd") > 0.002 * len(sample) or strange > 0.01 * len(sample) or any(m in sample for m in MARKERS)


def decode(content: bytes, fits: Callable[[str], bool], must_fit: bool = False) -> tuple[str, str] | None:
    """The text and the encoding: the first one whose text fits, else the first that decodes at all (none, if it must fit)."""
    fallback = None
    for name, codec in ENCODINGS.items():
        try:
            text = content.decode(codec)
        except UnicodeDecodeError:
            continue
        if fits(text):
            return text, name
        fallback = fallback or (text, name)
    return None if must_fit else fallback


def decoded(found: DataFrame, feed: bool = False) -> DataFrame:
    """path, text, encoding and garbled of files (path, content), as tables or, with ``feed``, as bank feeds.

    Whole files are tried, not their beginnings; whether a text fits is judged by its first 20,000 characters in tables
    and by all of it in feeds. ``garbled`` warns of single-byte texts that look like another encoding. A feed without
    a tag in any encoding has a null text, and so has a null content; an empty file has the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                got = None if content is None else decode(content, looks_fed if feed else looks_tabular, must_fit=feed)
                text, name = got or (None, None)
                garbled = None if got is None else name in SINGLE_BYTE and looks_garbled(text)
                columns = [batch.column(0).slice(i, 1), pa.array([text], pa.string()), pa.array([name], pa.string()), pa.array([garbled], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "text", "encoding", "garbled"])

    return found.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, text string, encoding string, garbled boolean")


def normalized(text: str) -> str:
    """Line ends of all kinds as one character, without NULs and byte order marks."""
    return re.sub("\r\n|[\r\u2028\u2029]", "\n", text).replace("\0", "").replace("\ufeff", "")


def split_rows(text: str, separator: str) -> Iterator[list[str]]:
    csv.field_size_limit(max(csv.field_size_limit(), MAX_BYTES))
    return csv.reader(io.StringIO(normalized(text)), delimiter=separator)


def delimited_rows(texts: DataFrame, separator: str) -> DataFrame:
    """path, row (from 0) and cells of decoded texts; a null text has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from row_batches(path, enumerate(split_rows(text.as_py() or "", separator)))

    return texts.select("path", "text").mapInArrow(run, "path string, row int, cells array<string>")


def row_batches(path: str | None, rows: Iterator[tuple[int, list[str | None]]]) -> Iterator[pa.RecordBatch]:
    """Batches of numbered rows, never more than BATCH_ROWS at a time."""
    places, held = [], []
    for k, cells in rows:
        places.append(k)
        held.append(cells)
        if len(held) == BATCH_ROWS:
            yield _batch(path, places, held)
            places, held = [], []
    if held:
        yield _batch(path, places, held)


def _batch(path: str | None, places: list[int], held: list[list[str | None]]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(held), pa.string()), pa.array(places, pa.int32()), pa.array(held, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["path", "row", "cells"])
