"""Grouped statistics of charges (AGG-01..25) and sequence operators (WIN-01..08).

Inputs are frames with ``date`` and ``amount``; ``by`` names the grouping columns.
Every function returns a new frame and reads each input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import NON_SUBSCRIPTION_KINDS, flags

TOTAL = "decimal(28,4)"


def spend_by_period(debits: DataFrame, period: str) -> DataFrame:
    """Rows (period start, spent) of the debits per calendar month or year (AGG-02, AGG-03)."""
    return (
        debits.where(F.col("amount") < 0)
        .groupBy(F.trunc("date", period).alias("period"))
        .agg(F.sum(F.abs("amount")).cast(TOTAL).alias("spent"))
    )


def spend_by(debits: DataFrame, *by: str) -> DataFrame:
    """Spent amount and count of charges by the columns (AGG-06)."""
    return debits.where(F.col("amount") < 0).groupBy(*by).agg(F.sum(F.abs("amount")).cast(TOTAL).alias("spent"), F.count("*").alias("n"))


def overlap_groups(subscriptions: DataFrame, monthly: Column) -> DataFrame:
    """Categories with two or more subscriptions and what they cost in a month (AGG-05)."""
    category = F.lower(F.coalesce("category", F.lit("uncategorized")))
    return (
        subscriptions.withColumn("category", category)
        .where("category <> 'uncategorized'")
        .groupBy("category")
        .agg(F.count("*").alias("n"), F.round(F.sum(monthly.cast("double")), 2).alias("exposure"))
        .where("n > 1")
    )


def mode(df: DataFrame, by: str, value: str) -> DataFrame:
    """The commonest value of each group; of equals the greatest (AGG-08). Pre-aggregated, so a hot group is counted in parts."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max(F.struct("n", value)).alias("m")).select(by, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def interval_days(charges: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``gap``, the days since the charge before in the group; null for the first (WIN-01)."""
    window = Window.partitionBy(*by).orderBy(*order)
    return charges.withColumn("gap", F.date_diff("date", F.lag("date").over(window)))


def price_steps(charges: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``step``, the change from the charge before relative to the larger one (WIN-02)."""
    before = F.lag("amount").over(Window.partitionBy(*by).orderBy(*order))
    larger = F.greatest(F.abs("amount"), F.abs(before)).cast("double")
    step = F.abs(F.col("amount") - before).cast("double") / larger
    return charges.withColumn("step", F.when(larger > 0, step))


def ordinals(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``ordinal``, how many rows of the same key come before (WIN-05, FN-11)."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def latest_against_rest(charges: DataFrame, by: str, order: list[str], least: float) -> DataFrame:
    """Groups whose latest price is ``least`` or more above the mean of the others (AGG-22)."""
    grouped = charges.groupBy(by).agg(
        F.max(F.struct(*order, "amount"))["amount"].alias("latest"), F.sum("amount").alias("total"), F.count("*").alias("n")
    )
    rest = (F.col("total") - F.col("latest")).cast("double") / (F.col("n") - 1)
    rise = (F.col("latest").cast("double") - rest) / rest
    return grouped.where("n > 1").select(by, "latest", F.round(rest, 6).alias("mean_before"), F.round(rise, 6).alias("rise")).where(F.col("rise") >= least)


def first_last_change(charges: DataFrame, by: str, order: list[str], least: float) -> DataFrame:
    """Groups whose last price differs from the first by ``least`` or more (AGG-23)."""
    grouped = charges.groupBy(by).agg(
        F.min(F.struct(*order, "amount"))["amount"].alias("first"), F.max(F.struct(*order, "amount"))["amount"].alias("last")
    )
    change = (F.col("last") - F.col("first")).cast("double") / F.col("first").cast("double")
    return grouped.where("first <> 0").select(by, "first", "last", F.round(change, 6).alias("change")).where(F.abs("change") >= least)


def period_change(spend: DataFrame) -> DataFrame:
    """Each period's spend beside the one before and the relative change (AGG-25). The input has one row per period."""
    before = F.lag("spent").over(Window.orderBy("period"))
    change = (F.col("spent") - before).cast("double") / before.cast("double")
    return spend.select("period", "spent", before.alias("before"), F.round(change, 6).alias("change"))


def distinct_share(df: DataFrame, by: str, shape: Column) -> DataFrame:
    """Distinct shapes over rows of a group (AGG-13)."""
    return df.groupBy(by).agg(F.count_distinct(shape).alias("shapes"), F.count("*").alias("n")).withColumn("diversity", F.round(F.col("shapes") / F.col("n"), 6))


def distinct_sample(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The n least distinct values of a group (AGG-18, AGG-19); values are made distinct before they are gathered."""
    ranked = df.select(by, value).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(value)))
    kept = ranked.where(F.col("rank") <= n).groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("sample"))
    return kept.select(by, F.array_join("sample", ",").alias("sample"))


def nth_smallest(df: DataFrame, by: list[str], value: str, index: Column, alias: str) -> DataFrame:
    """The value at a place (from 0) of each group's sorted values; ``index`` reads the group's size ``n``.

    Counts per value are taken before a window runs over them, so no group is held as a list.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy(value)
    ranked = counts.select(*by, value, F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    return ranked.where(F.col("_upto") > index).groupBy(*by).agg(F.min(value).alias(alias))


def carried(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``carried``: the last value before a row that was not null; the first rows of a group have none (WIN-03)."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("carried", F.last(value, ignorenulls=True).over(before))


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group (WIN-04)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def import_report(rows: DataFrame) -> DataFrame:
    """Per import: rows, debits, rows without a sure class, charges of a note, and merchants to review (AGG-17, AGG-20)."""
    unsure = F.col("confidence") < 0.5
    return rows.groupBy("import").agg(
        F.count("*").alias("n"), F.count_if(F.col("amount") < 0).alias("debits"), F.count_if(unsure).alias("unsure"),
        F.count_if(F.length("memo") > 0).alias("noted"), F.count_distinct(F.when(unsure, F.col("cluster"))).alias("to_review"),
    )


# Words that do not name a merchant when charges are grouped anew.
RECOVERY_STOP_WORDS = ["subscription", "subscriptions", "membership", "member", "monthly", "annual", "plan", "charge", "payment", "inc", "llc", "corp", "co", "com"]


def recovery_keys(charges: DataFrame) -> DataFrame:
    """Charges with the looser key of their group: two or more charges that do not all only move money (REC-17)."""
    free = _keyed(charges).where("_free").withColumn("_key", F.coalesce(F.concat(F.lit("="), "key"), F.lit("")))
    grouped = free.groupBy("_key").agg(F.count("key").alias("_n"), F.bool_and("movement").alias("_moved"), F.bool_or("strong").alias("_worded"))
    return free.join(grouped.where("_n >= 2 AND (NOT _moved OR _worded)").select("_key"), "_key").select(*charges.columns, "key")


def _keyed(charges: DataFrame) -> DataFrame:
    """Charges with their flags, the looser key, and whether they may stand in its group (``_free``)."""
    marked = flags(charges)
    words = F.split(F.lower(F.concat_ws(" ", "merchant", "merchant_raw", "memo", "descriptor")), r"[^\p{L}\p{M}\p{N}]+")
    loose = F.array_join(F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(RECOVERY_STOP_WORDS)), 1, 2), " ")
    key = F.when(F.col("confidence") >= 0.75, F.lower("merchant")).otherwise(F.coalesce(F.nullif(loose, F.lit("")), F.lower("merchant")))
    return marked.withColumns({"key": key, "_free": ~F.col("kind").isin(NON_SUBSCRIPTION_KINDS) | F.col("keyword")})


def recovery_groups(charges: DataFrame) -> DataFrame:
    """The looser groups (key, n) of charges (REC-17). Charges whose words and class agree are counted before the words are looked through."""
    alike = [c for c in ("cluster", "memo", "category", "merchant_raw", "merchant", "kind", "confidence") if c in charges.columns]
    keyed = _keyed(charges.groupBy(*alike).agg(F.count("*").alias("_c")))
    # Conditions on aggregates: a filter of rows would be evaluated again, words and all, on every charge that is read.
    free = F.col("_free") & F.col("key").isNotNull()
    grouped = keyed.groupBy("key").agg(F.sum(F.when(free, F.col("_c"))).alias("n"), F.bool_and(F.when(free, F.col("movement"))).alias("_moved"), F.bool_or(F.when(free, F.col("strong"))).alias("_worded"))
    return grouped.where("n >= 2 AND (NOT _moved OR _worded)").select("key", "n")
