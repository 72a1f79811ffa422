"""Billing calendars as columns (FN-16..18, FN-25, SCH-01..04); dates are DATE columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cadence:
    """Fixed values of one cadence, in days unless named otherwise."""

    name: str
    months: int
    days: int
    cycle: int
    grace: int
    second_miss: bool
    tolerance: int
    interval_tolerance: int
    median: tuple[int, int]
    pair: tuple[int, int]
    least: int


#: In the order that breaks ties. Fixed values.
CADENCES = (
    Cadence("monthly", 1, 0, 30, 5, True, 3, 7, (25, 36), (24, 38), 3),
    Cadence("annual", 12, 0, 365, 21, False, 14, 30, (330, 395), (330, 395), 2),
    Cadence("quarterly", 3, 0, 91, 10, False, 7, 10, (80, 100), (75, 105), 3),
    Cadence("semiannual", 6, 0, 182, 10, False, 7, 14, (165, 200), (165, 200), 2),
    Cadence("biweekly", 0, 14, 14, 3, True, 2, 3, (12, 17), (12, 17), 4),
    Cadence("weekly", 0, 7, 7, 2, True, 1, 2, (5, 9), (5, 9), 4),
)
BY_NAME = {c.name: c for c in CADENCES}


def of_cadence(cadence: Column, field: str) -> Column:
    """A fixed value of the cadence in a column; null for unknown ones (FN-18)."""
    return F.create_map(*[x for c in CADENCES for x in (F.lit(c.name), F.lit(getattr(c, field)))])[cadence]


def advanced(date: Column, cadence: Column, n: Column) -> Column:
    """The date n periods on; months clamp to their last day (FN-16). Null for unknown cadences."""
    months, days = of_cadence(cadence, "months"), of_cadence(cadence, "days")
    return F.when(months > 0, F.add_months(date, (months * n).cast("int"))).when(days > 0, F.date_add(date, (days * n).cast("int")))


def is_month_end(date: Column) -> Column:
    return date == F.last_day(date)


def clamped_day(date: Column, day: Column) -> Column:
    """That day of the date's month, or its last day (FN-17)."""
    return F.make_date(F.year(date), F.month(date), F.least(day, F.dayofmonth(F.last_day(date))))


def cycle_date(anchor: Column, anchor_day: Column, month_end: Column, cadence: Column, n: Column) -> Column:
    """Date of cycle n, always counted from the anchor (SCH-02)."""
    at = advanced(anchor, cadence, n)
    monthly = of_cadence(cadence, "months") > 0
    return F.when(monthly & month_end, F.last_day(at)).when(monthly, clamped_day(at, anchor_day)).otherwise(at)


def nearest_cycle(date: Column, anchor: Column, anchor_day: Column, month_end: Column, cadence: Column) -> Column:
    """struct(distance in days, cycle) of the cycle next to a date; the earlier of equals (SCH-03)."""
    months = (F.year(date) - F.year(anchor)) * 12 + F.month(date) - F.month(anchor)
    per_months, per_days = of_cadence(cadence, "months"), of_cadence(cadence, "days")
    whole = lambda a, b: (F.signum(a) * F.floor(F.abs(a) / b)).cast("int")  # noqa: E731  toward zero
    estimate = F.when(per_months > 0, whole(months, per_months)).otherwise(whole(F.date_diff(date, anchor), per_days))
    tried = [
        F.struct(F.abs(F.date_diff(date, cycle_date(anchor, anchor_day, month_end, cadence, estimate + k))).alias("distance"), (estimate + k).alias("cycle"))
        for k in (-1, 0, 1)
    ]
    return F.array_min(F.array(*tried))


def cadence_of_median(median: Column, n: Column) -> Column:
    """The first cadence whose range holds the median interval of n charges (REC-10)."""
    out = F.lit("unknown")
    for c in reversed(CADENCES):
        out = F.when(median.between(*c.median) & (n >= c.least), F.lit(c.name)).otherwise(out)
    return out


def consistency(intervals: Column, cadence: Column) -> Column:
    """How well day intervals fit a cadence, from 0 to 1 (REC-13); whole multiples up to three count as missed charges."""
    cycle = of_cadence(cadence, "cycle").cast("double")
    tol = of_cadence(cadence, "interval_tolerance").cast("double")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    times = lambda i: F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.round(i / cycle)))
    fits = F.forall(intervals, lambda i: F.abs(i - times(i) * cycle) <= tol * times(i))
    direct = F.exists(intervals, lambda i: F.abs(i - cycle) <= tol)
    each = F.transform(intervals, lambda i: F.greatest(F.lit(0.0), 1 - F.abs(i - times(i) * cycle) / times(i) / tol - 0.1 * (times(i) - 1)))
    plain = F.greatest(F.lit(0.0), 1 - mean(F.transform(intervals, lambda i: F.abs(i - cycle))) / tol)
    return F.when((cadence == "unknown") | (F.size(intervals) == 0), 0.0).when(fits & direct, mean(each)).otherwise(plain)


def cycle_progress(last: Column, following: Column, ref: Column) -> dict[str, Column]:
    """Days elapsed, left and overdue, and the fraction of the cycle that is over (FN-25)."""
    total = F.greatest(F.date_diff(following, last), F.lit(1))
    gone = F.date_diff(ref, last)
    return {
        "elapsed": F.greatest(gone, F.lit(0)),
        "remaining": F.greatest(F.date_diff(following, ref), F.lit(0)),
        "overdue": F.greatest(F.date_diff(ref, following), F.lit(0)),
        "fraction": F.least(F.greatest(gone / total, F.lit(0.0)), F.lit(1.0)),
    }
