"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, in_fold

#: Labelled rows that a classifier learns from at most (chosen by a hash of the id).
SAMPLE_ROWS = 12_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (doc_id, text, label) outside the held-out fold, in a fixed order, ``rows`` at most.

    The sample is drawn from the ids that ``docs`` holds with a text. Rows with a null id, text or
    label are left out, and so are ids whose labels disagree.
    """
    texts = docs.select(column(docs, "doc_id").alias("t_id"), column(docs, "text").cast("string").alias("text"))
    held = texts.where("text IS NOT NULL").select(F.col("t_id").alias("h_id")).distinct()
    chosen = (
        labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~in_fold(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
        .join(held, F.col("doc_id") == F.col("h_id"), "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return (
        texts.join(F.broadcast(chosen), F.col("t_id") == F.col("doc_id"))  # at most ``rows`` ids
        .where("text IS NOT NULL")
        .select("doc_id", "text", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(rows)
    )
