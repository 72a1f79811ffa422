"""Billing histories among the charges of one merchant and account (REC-02..07).

A bucket of charges is taken apart greedily: every cadence and phase proposes a
calendar, the best fitting one takes its charges, and the rest is tried again.
That is order-dependent, so it runs in tasks that hold whole buckets, many of them
as arrays at once; a bucket is one account's charges at one merchant
(``history_key``), which bounds its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import flags
from ..functions.schedule import CADENCES, Cadence

#: What makes a candidate.
LEAST_CONTINUITY, LEAST_PURITY, CONTINUITY_WEIGHT = 0.75, 0.8, 0.1
#: Rows worked on together, and pairs of a seed and a charge that are compared at once.
ROWS, PAIRS = 20_000, 1_000_000


def _day_numbers(months: np.ndarray) -> np.ndarray:
    """Day number of the first of a month; both count from 1970."""
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)


class _Charges:
    """Charges sorted by group, day and id, as arrays."""

    def __init__(self, group: np.ndarray, day: np.ndarray, amount: np.ndarray):
        self.group, self.day, self.amount = group, day, amount
        self.month = day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
        self.least = int(self.month.min()) - 40
        self.starts = _day_numbers(np.arange(self.least, int(self.month.max()) + 42))
        self.date = day - self.start(self.month) + 1
        self.at_end = self.start(self.month + 1) - 1 == day

    def start(self, month: np.ndarray) -> np.ndarray:
        return self.starts[month - self.least]

    def phase(self, rows: np.ndarray, cadence: Cadence) -> np.ndarray:
        """A number for each charge, equal where a calendar from one is one from the other."""
        if cadence.days:
            return self.day[rows] % cadence.days
        if cadence.months > 1:
            return self.month[rows] % 12 * 32 + self.date[rows]
        return np.where(self.at_end[rows], 0, self.date[rows])

    def nearest(self, seed: np.ndarray, row: np.ndarray, cadence: Cadence) -> tuple[np.ndarray, np.ndarray]:
        """(days to the next cycle of the seed's calendar, its number) of each charge; the earlier of equals."""
        if cadence.days:
            gone = self.day[row] - self.day[seed]
            guess = np.sign(gone) * (np.abs(gone) // cadence.days)
        else:
            gone = self.month[row] - self.month[seed]
            guess = np.sign(gone) * (np.abs(gone) // cadence.months)
            day = np.where(self.at_end[seed], 31, self.date[seed])
        best = cycle = None
        for k in (guess - 1, guess, guess + 1):
            if cadence.days:
                away = np.abs(k * cadence.days - gone)
            else:
                month = self.month[seed] + cadence.months * k
                away = np.abs(np.minimum(self.start(month) + day - 1, self.start(month + 1) - 1) - self.day[row])
            if best is None:
                best, cycle = away, k
            else:
                cycle, best = np.where(away < best, k, cycle), np.minimum(away, best)
        return best, cycle

    def calendars(self, left: np.ndarray, seeds: np.ndarray, lows: np.ndarray, sizes: np.ndarray, cadence: Cadence) -> Iterator[tuple]:
        """(seeds' places, their scores or 0, seed of each chosen charge, the charge, its distance), some seeds at a time.

        A seed is a row; the charges of its group are ``left[low : low + size]``. Of the charges
        near a cycle the nearest is chosen, then the one nearest in amount, then the first.
        """
        upto, at = np.cumsum(sizes), 0
        while at < len(seeds):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            n = sizes[at:to]
            who = np.repeat(np.arange(to - at), n)
            row = left[np.arange(n.sum()) + np.repeat(lows[at:to] - (np.cumsum(n) - n), n)]
            away, cycle = self.nearest(seeds[at:to][who], row, cadence)
            ok = np.flatnonzero((cycle >= 0) & (away <= cadence.tolerance))
            who, row, away, cycle = who[ok], row[ok], away[ok], cycle[ok]
            order = np.lexsort((row, np.abs(self.amount[row] - self.amount[seeds[at:to][who]]), away, cycle, who))
            who, row, away, cycle = who[order], row[order], away[order], cycle[order]
            first = np.concatenate(([True], (who[1:] != who[:-1]) | (cycle[1:] != cycle[:-1])))[: len(who)]
            who, row, away, cycle = who[first], row[first], away[first], cycle[first]
            direct = np.zeros(len(who), bool)
            direct[1:] = (who[1:] == who[:-1]) & (cycle[1:] - cycle[:-1] == 1)
            count = np.bincount(who, minlength=to - at)
            directs = np.bincount(who, direct, to - at)
            fit = np.bincount(who, cadence.tolerance + 1 - away, to - at) / (cadence.tolerance + 1)
            continuity = directs / np.maximum(count - 1, 1)
            weak = ((count < 3) | (continuity < LEAST_CONTINUITY)) & (count / n < LEAST_PURITY)
            good = (count >= 2) & (directs > 0) & ~weak
            yield np.arange(at, to), np.where(good, fit + CONTINUITY_WEIGHT * continuity, 0.0), who + at, row, away
            at = to


def decompose(group: np.ndarray, day: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, history in its group from 0, cadence's place, consistency) of each charge that is part of a history.

    Rows are sorted by group, day and id. Each round takes the best calendar of every group, ties to the first
    tried. A cadence is not tried where the charges that are left span too few of its cycles to beat the best score so far.
    """
    out: list[tuple] = []
    charges = _Charges(group, day, amount) if len(group) else None
    left, history = np.arange(len(group)), 0
    while True:
        own = group[left]
        lows = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
        sizes = np.diff(np.append(lows, len(left)))
        left = left[np.repeat(sizes >= 2, sizes)]
        if not len(left):
            break
        sizes = sizes[sizes >= 2]
        lows = np.cumsum(sizes) - sizes
        span = day[left[lows + sizes - 1]] - day[left[lows]]
        top, best, kind = np.zeros(len(lows)), np.zeros(len(lows), np.int64), np.full(len(lows), -1)
        for c, cadence in enumerate(CADENCES):
            possible = (span + 2 * cadence.tolerance) // (cadence.days or 28 * cadence.months) + 2
            tried = (kind < 0) | (np.minimum(sizes, possible) + CONTINUITY_WEIGHT > top)
            of = np.repeat(np.arange(len(lows)), sizes)
            place = np.flatnonzero(tried[of])
            _, first = np.unique(of[place] * 512 + charges.phase(left[place], cadence), return_index=True)
            first = place[np.sort(first)]
            seeds, of = left[first], of[first]
            score = np.zeros(len(seeds))
            for at, some, *_ in charges.calendars(left, seeds, lows[of], sizes[of], cadence):
                score[at] = some
            order = np.lexsort((np.arange(len(of)), -score, of))
            order = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))[: len(order)]]
            order = order[score[order] > top[of[order]]]
            top[of[order]], best[of[order]], kind[of[order]] = score[order], seeds[order], c
        used = np.zeros(len(group), bool)
        for c, cadence in enumerate(CADENCES):
            of = np.flatnonzero(kind == c)
            for at, _, who, row, away in charges.calendars(left, best[of], lows[of], sizes[of], cadence):
                used[row] = True
                fit = np.bincount(who - at[0], cadence.tolerance + 1 - away, len(at)) / (cadence.tolerance + 1)
                consistency = fit / np.maximum(np.bincount(who - at[0], minlength=len(at)), 1)
                out.append((row, np.full(len(row), history), np.full(len(row), c), consistency[who - at[0]]))
        left = left[np.repeat(kind >= 0, sizes)]
        left, history = left[~used[left]], history + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))


def history_key(charges: DataFrame) -> DataFrame:
    """Adds the bucket in which histories are looked for (REC-01): currency, account, descriptor, and the merchant or, where that is unsure, its raw name.

    Reads currency, account, confidence, merchant, merchant_raw, memo, category and kind.
    """
    marked = flags(charges)
    sure = (F.col("confidence") >= 0.9) | F.col("keyword")
    name = F.when(sure, F.lower("merchant")).otherwise(F.lower("merchant_raw"))
    key = F.concat_ws("|", F.coalesce(F.upper("currency"), F.lit("USD")), F.coalesce(F.col("account").cast("string"), F.lit("")), F.coalesce("descriptor", F.lit("")), name)
    return marked.select(*charges.columns, key.alias("bucket"))


def _group_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """True at each row whose key differs from that of the row before."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        a, b = table.column(c).slice(1), table.column(c).slice(0, max(table.num_rows - 1, 0))
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy().astype(bool)
    return new


def in_whole_groups(rows: DataFrame, by: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work`` on tables of whole groups, many at once, sorted by group, date and id, with the group's number of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            table = pa.Table.from_batches(held)
            new = _group_starts(table, by)
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            if last:
                yield from work(table.slice(0, last), np.cumsum(new[:last]) - 1).to_batches()
                held, n = table.slice(last).to_batches(), n - last
        if n:
            table = pa.Table.from_batches(held)
            yield from work(table, np.cumsum(_group_starts(table, by)) - 1).to_batches()

    return rows.repartition(*by).sortWithinPartitions(*by, "date", "id").mapInArrow(run, schema)


def day_numbers(table: pa.Table) -> np.ndarray:
    return table.column("date").cast(pa.int32()).to_numpy().astype(np.int64)


def billing_histories(charges: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., history, cadence, consistency, id) of every charge that is part of a history.

    Reads columns id, date, amount; null dates take no part. A group lies in one task and is held whole.
    """
    rows = charges.where(F.col("date").isNotNull()).select(*by, "id", "date", F.col("amount").cast("double").alias("amount"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["history int", "cadence string", "consistency double", f"id {kinds['id']}"])
    names = pa.array([c.name for c in CADENCES])

    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        row, history, cadence, consistency = decompose(group, day_numbers(table), table.column("amount").to_numpy())
        found = [pa.array(history, pa.int32()), names.take(pa.array(cadence)), pa.array(consistency)]
        columns = [*[table.column(c).take(pa.array(row)) for c in by], *found, table.column("id").take(pa.array(row))]
        return pa.Table.from_arrays(columns, names=[*by, "history", "cadence", "consistency", "id"])

    return in_whole_groups(rows, by, work, schema)


def amount_clusters(charges: DataFrame, by: str, absolute: float = 2.5, share: float = 0.12) -> DataFrame:
    """Rows (by, cluster, mean, n): amounts in rising order join the first cluster whose mean is near (REC-07)."""
    amounts = charges.groupBy(by).agg(F.sort_array(F.collect_list(F.abs("amount").cast("double"))).alias("a"))
    kind = "array<struct<mean:double,n:bigint>>"

    def add(acc, a):
        near = F.transform(acc, lambda c: F.abs(c["mean"] - a) <= F.greatest(F.lit(absolute), c["mean"] * share))
        at = F.array_position(near, F.lit(True))
        grown = F.transform(
            acc,
            lambda c, i: F.when(
                i + 1 == at, F.struct(((c["mean"] * c["n"] + a) / (c["n"] + 1)).alias("mean"), (c["n"] + 1).alias("n"))
            ).otherwise(c),
        )
        fresh = F.array(F.struct(a.alias("mean"), F.lit(1).cast("bigint").alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(acc, fresh)).cast(kind)

    folded = amounts.select(by, F.aggregate("a", F.array().cast(kind), add).alias("c"))
    return folded.select(by, F.posexplode("c").alias("cluster", "c")).select(by, "cluster", F.round("c.mean", 4).alias("mean"), "c.n")
