"""Coverage, missed payments and the state of a subscription (OCC-01..08, QRY-01).

``ref`` is the reference date; the engine never reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schedule import advanced, of_cadence


def coverage(charges: DataFrame, ref: str) -> DataFrame:
    """Days on which an account was seen, none after the reference date (OCC-01)."""
    return charges.where(F.col("date") <= F.lit(ref).cast("date")).select("account", F.col("date").alias("seen")).distinct()


def observed_missing(subscriptions: DataFrame, seen: DataFrame, ref: str, cycles: int = 2) -> DataFrame:
    """Rows (account, cycle, expected): payments that did not come although the account was seen (OCC-02..04).

    A payment is missing if the account was seen between the end of its grace and
    the next expected date. The join is an equality on the account; only accounts
    with a window that is over before ``ref`` take part.
    """
    at = F.lit(ref).cast("date")
    known = subscriptions.where("cadence <> 'unknown'").select("account", "cadence", "last_date", F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("cycle"))
    windows = known.select(
        "account",
        "cycle",
        advanced(F.col("last_date"), F.col("cadence"), F.col("cycle")).alias("expected"),
        F.date_add(advanced(F.col("last_date"), F.col("cadence"), F.col("cycle")), of_cadence(F.col("cadence"), "grace")).alias("opens"),
        advanced(F.col("last_date"), F.col("cadence"), F.col("cycle") + 1).alias("closes"),
    ).where(F.col("opens") < at)
    inside = (windows["account"] == seen["account"]) & seen["seen"].between(windows["opens"], windows["closes"])
    return windows.join(seen, inside, "left_semi").select("account", "cycle", "expected")


def lifecycle(subscriptions: DataFrame, missing: DataFrame, ref: str) -> DataFrame:
    """Adds ``state`` and ``renews``: active, waiting for review, or former (OCC-05).

    Former needs an observed missing payment, two of them for short cadences.
    """
    at = F.lit(ref).cast("date")
    missed = missing.groupBy("account").agg(F.bool_or(F.col("cycle") == 1).alias("first_missing"), F.bool_or(F.col("cycle") == 2).alias("second_missing"))
    out = subscriptions.join(missed, "account", "left")
    first, second = F.coalesce("first_missing", F.lit(False)), F.coalesce("second_missing", F.lit(False))
    grace, tolerates = of_cadence(F.col("cadence"), "grace"), of_cadence(F.col("cadence"), "second_miss")
    following = advanced(F.col("last_date"), F.col("cadence"), F.lit(2))
    in_time = F.date_add("next_date", grace) >= at
    state = (
        F.when(F.col("cadence") == "unknown", "needsReview")
        .when(in_time, "active")
        .when(first & (~tolerates | second), "former")
        .when(first & (F.date_add(following, grace) >= at), "active")
        .otherwise("needsReview")
    )
    out = out.withColumn("state", state)
    renews = F.when((F.col("state") == "active") & in_time, F.col("next_date")).when(F.col("state") == "active", following)
    return out.withColumn("renews", renews).drop("first_missing", "second_missing")


def occurrence_status(expected: Column, observed: Column, confidence: Column, is_due: Column) -> Column:
    """matched, priceChanged, missed or pending (OCC-08); observed is null where no charge came."""
    change = F.abs((observed - expected).cast("double") / expected.cast("double"))
    allowed = F.when(confidence < 0.7, 0.20).otherwise(0.12)
    return F.when(observed.isNotNull(), F.when(change > allowed, "priceChanged").otherwise("matched")).when(is_due, "missed").otherwise("pending")


def match_occurrences(expected: DataFrame, charges: DataFrame) -> DataFrame:
    """The earliest charge in each expected window (OCC-06, OCC-07).

    expected: account, cycle, opens, closes (windows of an account do not
    overlap, so no charge is matched twice); charges: account, id, date, amount.
    """
    came = charges.select(F.col("account").alias("m_account"), F.struct("date", "id", "amount").alias("m"), F.col("date").alias("m_date"))
    inside = (F.col("account") == F.col("m_account")) & F.col("m_date").between(F.col("opens"), F.col("closes"))
    found = expected.select("account", "cycle", "opens", "closes").join(came, inside).groupBy("account", "cycle").agg(F.min("m").alias("m"))
    return expected.join(found, ["account", "cycle"], "left").select(*expected.columns, F.col("m.id").alias("id"), F.col("m.date").alias("date"), F.col("m.amount").alias("amount"))
