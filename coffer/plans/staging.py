"""Frames whose lineage is cut, for work that goes on in steps."""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, which executors share.

    A session on one machine without that setting gets a temporary folder; a
    cluster without it is refused, as its executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="coffer-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows of one task where a table is dealt by a key; more rows mean more tasks, not larger ones.
PART_ROWS = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt by its keys into parts of about PART_ROWS of ``rows``; as it is where Spark's own parts are no larger."""
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def staged(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_stored: dict[str, SparkSession] = {}


@atexit.register
def _drop_stored() -> None:
    for path, spark in _stored.items():
        if spark.sparkContext._jsc is not None:
            try:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # the JVM may have ended before the driver's Python
                pass


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which goes when the driver ends.

    A checkpoint keeps the size that Spark estimated for its plan, and a join's estimate is the product of its
    sides. Where a frame is joined in each round with what became of it in the round before, the digits of that number
    multiply with every round until the driver has no memory for them; a table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/coffer-stored-{uuid4().hex}"
    df.write.parquet(path)
    _stored[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)
