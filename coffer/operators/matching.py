"""Identities that are kept from one run to the next (RUL-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged


#: How many of a left side's first rows are tried at once, and by how much that grows where they don't do.
FIRST, GROWTH = 16, 8


def largest_overlaps(overlaps: DataFrame, left: str, right: str, order: list) -> DataFrame:
    """Rows of ``overlaps`` (left, right, ...) that a greedy choice takes: in that order, each left and each right at most once.

    ``order`` are columns by which rows are tried, smallest first; rows that tie go by left and right.
    As both sides go by one order, the greedy choice is their only stable one, so it is found by proposals: every
    left asks by its first row, a right keeps the first row that it is asked by, and all rows of that right
    which come later leave. Rows are ranked once for each left; the rounds work on the first ones of each, and on more for
    the lefts that lost all of theirs. What such a left gets may take the last rows of another, which then gets more in its turn.
    The rounds end when no row leaves and no left without rows has any that a right would keep. Null sides match nothing.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    rows = overlaps.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("_key", key).dropDuplicates([left, right])
    ranked = staged(rows.withColumn("_rank", F.row_number().over(Window.partitionBy(left).orderBy("_key"))))
    most, upto = ranked.agg(F.max("_rank")).first()[0] or 0, FIRST
    pool = staged(ranked.where(F.col("_rank") <= upto))
    size = pool.count()
    while True:
        firsts = pool.groupBy(left).agg(F.min("_key").alias("_first"))
        asking = pool.join(firsts, left).where("_key = _first").drop("_first")
        best = asking.groupBy(right).agg(F.min("_key").alias("_best"))
        kept = staged(pool.join(best, right, "left").where("_best IS NULL OR _key <= _best").select(*pool.columns))
        left_over = kept.count()
        if left_over < size:
            pool, size = kept, left_over
            continue
        last, upto = upto >= most, min(most, upto * GROWTH)
        more = ranked.where(F.col("_rank") <= upto).join(pool.select(left).distinct(), left, "left_anti")
        more = staged(more.join(best, right, "left").where("_best IS NULL OR _key < _best").select(*pool.columns))
        added = more.count()
        if last and not added:
            return asking.select(*overlaps.columns)
        pool, size = staged(pool.unionByName(more)), size + added
