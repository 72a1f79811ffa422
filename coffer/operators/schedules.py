"""Billing schedules of groups of charges, and the occurrences that they expect (SCH-01, SCH-04, AGG-15, AGG-16, OCC-04, OCC-06, OCC-09..12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schedule import cycle_date, is_month_end, nearest_cycle, of_cadence

#: Share of charges on the last day of a month that makes it a schedule's day, least charges for that.
END_SHARE, END_LEAST = 0.7, 2
#: Confidence that each newly missed payment costs, and the most that they cost together.
DECAY, MOST_DECAY = 0.08, 0.3


def schedules(charges: DataFrame) -> DataFrame:
    """Per account: anchor (the first date), anchor_day (the commonest day, of equals the greatest) and month_end (SCH-01)."""
    days = charges.groupBy("account", F.dayofmonth("date").alias("day")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.count_if(is_month_end(F.col("date"))).alias("ends"))
    grouped = days.groupBy("account").agg(F.min("first").alias("anchor"), F.max(F.struct("n", "day")).alias("m"), F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    return grouped.select("account", "anchor", F.col("m.day").alias("anchor_day"), ((F.col("n") >= END_LEAST) & (F.col("ends") / F.col("n") >= END_SHARE)).alias("month_end"))


def at_cycle(cycle: Column) -> Column:
    """The date of a cycle, by the columns of a schedule and its cadence."""
    return cycle_date(F.col("anchor"), F.col("anchor_day"), F.col("month_end"), F.col("cadence"), cycle)


def near(date: Column) -> Column:
    return nearest_cycle(date, F.col("anchor"), F.col("anchor_day"), F.col("month_end"), F.col("cadence"))["cycle"]


def dates_between(known: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows (account, cycle, date): the expected dates of schedules with a cadence within two dates (SCH-04)."""
    from_, to = F.greatest(near(low) - 1, F.lit(0)), near(high) + 1
    cycles = known.where("cadence <> 'unknown'").withColumn("cycle", F.explode(F.when(to >= from_, F.sequence(from_, to)).otherwise(F.array().cast("array<int>"))))
    return cycles.withColumn("date", at_cycle(F.col("cycle"))).where(F.col("date").between(low, high)).select("account", "cycle", "date")


def missing_cycles(known: DataFrame, seen: DataFrame, ref: str) -> DataFrame:
    """Rows (account, cycle, expected): cycles, gaps between charges included, whose payment did not come although the account was seen (OCC-04).

    A day on which the account was seen lies in the window of the cycle next to it, or of one beside that:
    from the end of its grace to the next expected date.
    """
    at = known.where("cadence <> 'unknown'").join(seen, "account")
    at = at.withColumn("_near", near(F.col("seen"))).withColumn("cycle", F.explode(F.array(*[F.col("_near") + k for k in (-1, 0, 1)]))).where("cycle >= 0")
    at = at.withColumns({"expected": at_cycle(F.col("cycle")), "_next": at_cycle(F.col("cycle") + 1)})
    opens = F.date_add("expected", of_cadence(F.col("cadence"), "grace"))
    return at.where((opens < F.lit(ref).cast("date")) & F.col("seen").between(opens, F.col("_next"))).select("account", "cycle", "expected").distinct()


def expected_cycles(known: DataFrame, charges: DataFrame, missing: DataFrame) -> DataFrame:
    """Rows (account, cycle, expected): those near charges, the missing ones up to the end, and the predicted next one (OCC-06).

    ``known`` holds next_date, null where the subscription has ended: then missing cycles count up to one after the last
    charge, or two where the cadence tolerates a second miss.
    """
    k = known.where("cadence <> 'unknown'")
    charged = k.join(charges.select("account", "date"), "account").select("account", F.greatest(near(F.col("date")), F.lit(0)).alias("cycle")).distinct()
    last = charged.groupBy("account").agg(F.max("cycle").alias("_last"))
    ends = k.join(last, "account").select("account", "next_date", (F.col("_last") + F.when(of_cadence(F.col("cadence"), "second_miss"), 2).otherwise(1)).alias("_end"))
    missed = missing.join(ends, "account").where("next_date IS NOT NULL OR cycle <= _end").select("account", "cycle")
    following = k.where("next_date IS NOT NULL").select("account", F.greatest(near(F.col("next_date")), F.lit(0)).alias("cycle"))
    every = charged.unionByName(missed).unionByName(following).distinct()
    return every.join(k, "account").select("account", "cycle", at_cycle(F.col("cycle")).alias("expected"))


def expectations(known: DataFrame, charges: DataFrame) -> DataFrame:
    """Per account: anchor policy, day and weekday, tolerance and grace (OCC-10)."""
    last = charges.groupBy("account").agg(F.max("date").alias("_last"), F.count("*").alias("_n"))
    c = F.col("cadence")
    policy = (
        F.when(c.isin("monthly", "quarterly", "semiannual"), F.when((F.col("_n") >= 2) & F.col("month_end"), "endOfMonth").otherwise("exactDayOfMonth"))
        .when(c == "annual", "sameCalendarDate")
        .when(c.isin("weekly", "biweekly"), "rollingInterval")
        .otherwise("unknown")
    )
    value = lambda field: F.coalesce(of_cadence(c, field), F.lit(0)).alias(field)
    return known.join(last, "account").select("account", "cadence", policy.alias("policy"), "anchor_day", F.dayofweek("_last").alias("weekday"), value("tolerance"), value("grace"))


def decayed(subscriptions: DataFrame, occurrences: DataFrame, before: DataFrame) -> DataFrame:
    """Rows (account, newly_missed, confidence): what missed payments that were not missed before cost (OCC-11)."""
    missed = occurrences.where("status = 'missed'").select("account", "expected").join(before.select("account", "expected"), ["account", "expected"], "left_anti")
    counted = missed.groupBy("account").agg(F.count("*").alias("newly_missed"))
    n = F.coalesce("newly_missed", F.lit(0))
    lost = F.least(F.lit(MOST_DECAY), n * DECAY)
    return subscriptions.join(counted, "account", "left").select("account", n.alias("newly_missed"), F.greatest(F.lit(0.0), F.col("confidence") - lost).alias("confidence"))


def amount_delta(expected: Column, actual: Column) -> Column:
    """The change of a price as a share; null where nothing was expected (OCC-12)."""
    e = F.abs(expected.cast("double"))
    return F.when(e > 0, (F.abs(actual.cast("double")) - e) / e)
