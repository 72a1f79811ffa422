"""Candidate clusters of a bucket of charges: histories, and fragments of like amounts (REC-07..09)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import signal_text
from ..functions.schedule import CADENCES
from ..functions.text import contains_any
from .histories import day_numbers, decompose, in_whole_groups

# Least distance of an amount from a cluster's mean, and its share of the mean; of amounts that vary with use, more.
TOLERANCE = {"primary": (2.5, 0.12), "fallback": (5.0, 0.20)}
TOLERANCE_OF_USE = {"primary": (10.0, 0.24), "fallback": (10.0, 0.28)}
USE_WORDS = ["usage", "metered", "compute", "storage", "hosting", "infrastructure", "seat", "workspace"]
USE_AFFINITY = 0.88


def tells_use() -> Column:
    """True where a charge's text says that its price goes by use."""
    return contains_any(signal_text("memo", "category", "merchant_raw", "merchant"), USE_WORDS)


def tolerance(kinds: list[str], affinities: list[float], uses: list[bool], mode: str) -> tuple[float, float]:
    """The profile of some charges by their commonest kind (the greatest of equals), mean affinity and wording (REC-08)."""
    kind = max(set(kinds), key=lambda k: (kinds.count(k), k)) if kinds else ""
    vary = kind == "softwareOrSaaS" or (kind == "subscriptionService" and sum(affinities) / max(1, len(affinities)) >= USE_AFFINITY)
    return TOLERANCE_OF_USE[mode] if vary or any(uses) else TOLERANCE[mode]


def fragments(amounts: list[float], absolute: float, share: float) -> list[list[int]]:
    """Places of amounts in rising order; each joins the first cluster whose mean is near. Clusters of two or more (REC-07)."""
    out: list[tuple[float, list[int]]] = []
    for i in sorted(range(len(amounts)), key=lambda i: (amounts[i], i)):
        for k, (mean, members) in enumerate(out):
            if abs(mean - amounts[i]) <= max(absolute, mean * share):
                out[k] = ((mean * len(members) + amounts[i]) / (len(members) + 1), [*members, i])
                break
        else:
            out.append((amounts[i], [i]))
    return [members for _, members in out if len(members) > 1]


def candidate_clusters(charges: DataFrame, by: list[str], mode: str = "primary") -> DataFrame:
    """Rows (by..., part, cadence, id): the histories of each bucket, then fragments of what they leave (REC-09).

    Reads id, date, amount, kind, affinity, memo, category, merchant_raw and merchant. A fragment
    has no cadence. Charges without a date take no part, nor do buckets of one charge. A bucket goes to one task, as its
    histories depend on each other; it holds one merchant's charges to one account (``history_key``).
    """
    rows = charges.where(F.col("date").isNotNull()).select(
        *by, "id", "date", F.abs("amount").cast("double").alias("amount"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("affinity", F.lit(0.0)).alias("affinity"), F.coalesce(tells_use(), F.lit(False)).alias("use")
    )
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["part int", "cadence string", f"id {kinds['id']}"])

    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        row, part, cadence, _ = decompose(group, day_numbers(table), table.column("amount").to_numpy())
        histories = np.zeros(group[-1] + 1, np.int64)  # of each group
        np.maximum.at(histories, group[row], part + 1)
        names = [CADENCES[k].name for k in cadence.tolist()]
        left = np.delete(np.arange(len(group)), row)
        columns = {c: table.column(c).to_pylist() for c in ("amount", "kind", "affinity", "use")}
        more: list[tuple[int, int]] = []
        for places in np.split(left, np.flatnonzero(np.diff(group[left])) + 1):
            if len(places) > 1:
                own, k = places.tolist(), int(histories[group[places[0]]])
                profile = tolerance(*([columns[c][i] for i in own] for c in ("kind", "affinity", "use")), mode)
                for part_of, members in enumerate(fragments([columns["amount"][i] for i in own], *profile), k):
                    more += [(own[i], part_of) for i in members]
        at = pa.array([*row.tolist(), *[i for i, _ in more]], pa.int64())
        out = [table.column(c).take(at) for c in by] + [pa.array([*part.tolist(), *[k for _, k in more]], pa.int32()), pa.array([*names, *[None] * len(more)], pa.string())]
        return pa.Table.from_arrays([*out, table.column("id").take(at)], names=[*by, "part", "cadence", "id"])

    return in_whole_groups(rows, by, work, schema)
