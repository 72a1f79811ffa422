"""Shared helpers of the corpus operators: words, folds, scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set, a session on one machine gets a temporary folder, and a
    cluster uses its warehouse, which executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        base = "file://" + tempfile.mkdtemp(prefix="coffer-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_written: dict[str, SparkSession] = {}


def _drop(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before the driver's Python
        pass


@atexit.register
def _drop_all() -> None:
    for path in list(_written):
        _drop(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    Cuts the lineage so that a lost executor costs the reread of a file and not
    the stages before it. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/coffer-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts, at that place among the columns, have about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        offsets, at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, int(offsets[at]) + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # what the batches took goes back before the next task


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        _drop(path.rsplit("/", 1)[0])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
