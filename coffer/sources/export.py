"""Tables written as one JSON document with sorted keys (SNK-01, SNK-02)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _scalar(c: Column, kind: T.DataType) -> Column:
    """A value as JSON text: dates as ISO 8601 in UTC, whole floats without a fraction; null for null."""
    if isinstance(kind, T.TimestampType):
        c = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.to_json(F.struct(c.alias("v")))
    text = F.when(c.isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.regexp_replace(text, r"\.0$", "")
    return text


def _object(df: DataFrame) -> Column:
    """A row as an indented JSON object; fields in order of their names, nulls left out."""
    fields = sorted(df.schema, key=lambda f: f.name)
    lines = [F.concat(F.lit(f'      "{f.name}" : '), _scalar(df[f"`{f.name}`"], f.dataType)) for f in fields]
    return F.concat(F.lit("    {\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n    }"))


def export(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str, **values: str) -> None:
    """Writes {name: [rows]} for every table, and texts beside them, as one document at ``path``.

    Each table is a frame of the columns to export (numbers, texts, booleans, dates, or arrays of them, in one line) and the
    columns that order its rows. Rows become text and are sorted in parallel; the driver then joins the sorted
    parts by copying their bytes through a buffer, so it holds no rows, whatever the size. The
    file appears by a rename when it is whole, in place of an older one. Names of tables and values are
    sorted too. An array of a table without rows is empty.
    """
    hadoop, io = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    files = target.getFileSystem(conf)
    scratch = f"{path}-{uuid.uuid4().hex}"
    whole = hadoop.Path(f"{scratch}/document")
    try:
        for name, (df, order) in tables.items():
            lines = df.orderBy(*order).select(_object(df).alias("value"))
            lines.write.option("lineSep", ",\n").text(f"{scratch}/{name}")
        files.mkdirs(hadoop.Path(scratch))
        out = files.create(whole, True)
        try:
            texts = {n: F.lit(v) for n, v in values.items()}
            known = spark.range(1).select(*[_scalar(c, T.StringType()).alias(n) for n, c in texts.items()]).first() if texts else {}
            for i, name in enumerate(sorted({*tables, *values})):
                out.write((("{\n" if i == 0 else ",\n") + f'  "{name}" : ').encode())
                if name in values:
                    out.write(known[name].encode())
                    continue
                out.write(b"[\n")
                parts = sorted((s for s in files.listStatus(hadoop.Path(f"{scratch}/{name}")) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
                for j, part in enumerate(parts):
                    stream = files.open(part.getPath())
                    io.copyLarge(stream, out, 0, part.getLen() - (2 if j == len(parts) - 1 else 0))  # the last row has no comma
                    stream.close()
                out.write(b"\n  ]")
            out.write(b"\n}" if tables or values else b"{\n\n}")
        finally:
            out.close()
        context = hadoop.FileContext.getFileContext(files.getUri(), conf)
        replace = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        replace[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        context.rename(whole, target, replace)
    finally:
        files.delete(hadoop.Path(scratch), True)
