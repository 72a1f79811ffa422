"""Ledger operators on small fixtures with the boundary values that matter."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from coffer.functions import money, predicates, schedule, text
from coffer.operators import aggregates, histories, identity, lifecycle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("1.234,56", "1234.56"), ("1.234", "1.234"), ("€1.234", "1234"), ("1234,56", "1234.56"), ("1,234.56", "1234.56"),
        ("€1.234,56", "1234.56"), ("$1,234.56", "1234.56"), ("12.50 USD", "12.50"), ("CAD 12.50", "12.50"),
        ("-£12.00", "-12"), ("(45,00)", "-45"), ("USD (12.34)", "-12.34"), ("$ (12.34)", "-12.34"),
        ("ACH 123456", None), ("May 2026", None), ("fee 9.99", None), ("", None), (None, None),
    ],
)
def test_amounts(spark, raw, value):
    got = one(spark, money.parsed_amount(F.lit(raw).cast("string")))
    assert got == (Decimal(value) if value else None)


@pytest.mark.parametrize(
    ("raw", "day_first", "value"),
    [
        ("03/05/2025", False, date(2025, 3, 5)), ("2025/03/05", False, date(2025, 3, 5)), ("05.03.2025", True, date(2025, 3, 5)),
        ("2025-03-05 13:45:00", False, date(2025, 3, 5)), ("2025-03-05T13:45:00", False, date(2025, 3, 5)),
        ("3/5/25", False, date(2025, 3, 5)), ("13/02/2025", True, date(2025, 2, 13)), ("nonsense", False, None), (None, False, None),
    ],
)
def test_dates(spark, raw, day_first, value):
    assert one(spark, money.parsed_date(F.lit(raw).cast("string"), day_first)) == value


def test_prices_per_month(spark):
    price = F.lit("20").cast("decimal(18,4)")
    assert float(one(spark, money.per_month(F.lit("biweekly"), price))) == pytest.approx(20 * 26 / 12)
    assert float(one(spark, money.per_month(F.lit("annual"), price))) == pytest.approx(20 / 12)


def test_text(spark):
    assert one(spark, text.identity_token(F.lit(" Café-Noir #12 "))) == "cafe noir 12"
    assert one(spark, text.normalized_merchant(F.lit("POS AMZN*DIGITAL SVCS 123456"))) == "Amazon Digital Services"
    assert one(spark, text.nil_if_blank(F.lit("  "))) is None
    assert one(spark, text.jaccard(text.tokens(F.lit("a b c")), text.tokens(F.lit("b c d")))) == 0.5


def test_predicates(spark):
    row = spark.createDataFrame([("current plan", None, "NETFLIX", "Netflix")], "memo string, category string, merchant_raw string, merchant string")
    got = row.select(predicates.is_movement().alias("m"), predicates.has_keyword().alias("k"), predicates.is_noise().alias("n"), predicates.is_excluded_category().alias("e")).first()
    assert (got.m, got.k, got.n, got.e) == (True, True, False, False)  # "rent" is in "current"


def test_calendar_keeps_the_anchor_day(spark):
    at = lambda n: one(spark, schedule.cycle_date(F.lit("2024-01-31").cast("date"), F.lit(31), F.lit(True), F.lit("monthly"), F.lit(n)))
    assert [at(1), at(2), at(3)] == [date(2024, 2, 29), date(2024, 3, 31), date(2024, 4, 30)]
    near = one(spark, schedule.nearest_cycle(F.lit("2024-03-14").cast("date"), F.lit("2024-01-15").cast("date"), F.lit(15), F.lit(False), F.lit("monthly")))
    assert (near.distance, near.cycle) == (1, 2)


@pytest.mark.parametrize(("gaps", "cadence", "least"), [([30, 31, 30], "monthly", 0.9), ([30, 61, 30], "monthly", 0.8), ([7, 7, 7], "weekly", 1.0)])
def test_consistency(spark, gaps, cadence, least):
    assert one(spark, schedule.consistency(F.array(*[F.lit(float(g)) for g in gaps]), F.lit(cadence))) >= least


def test_histories(spark):
    monthly = [(i, "a", date(2024, i, 15), 9.99) for i in range(1, 8)]
    weekly = [(100 + i, "a", date.fromordinal(date(2024, 1, 2).toordinal() + 7 * i), 5.0) for i in range(30)]  # as long as the other
    rows = spark.createDataFrame([*monthly, *weekly, (999, "b", date(2024, 1, 1), 1.0)], "id long, account string, date date, amount double")
    got = histories.billing_histories(rows, ["account"]).groupBy("account", "cadence").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {(r.account, r.cadence): r.ids for r in got} == {("a", "monthly"): list(range(1, 8)), ("a", "weekly"): list(range(100, 130))}
    assert histories.billing_histories(rows.where("false"), ["account"]).count() == 0


def test_histories_of_many_groups_meet_in_one_task(spark):
    """Groups that lie in one batch are taken apart as if alone, and the result is the same however the rows lie."""
    rows = [(g * 100 + i, None if g == 7 else g, date.fromordinal(date(2024, 1, 1).toordinal() + (7 * i if g % 2 else 30 * i) + g % 5), 5.0 + g) for g in range(40) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, account int, date date, amount double")
    got = histories.billing_histories(df.repartition(3), ["account"]).groupBy("account").agg(F.count("*").alias("n"), F.min("cadence").alias("a"), F.max("cadence").alias("b"), F.max("history").alias("h")).collect()
    assert {r.account: (r.n, r.a, r.b, r.h) for r in got} == {None if g == 7 else g: (6, "weekly" if g % 2 else "monthly", "weekly" if g % 2 else "monthly", 0) for g in range(40)}
    days = np.array([9_000, 9_031, 9_060, 9_000, 9_007, 9_014, 9_021])
    row, history, cadence, _ = histories.decompose(np.array([0, 0, 0, 1, 1, 1, 1]), days, np.ones(7))
    assert sorted(zip(row.tolist(), history.tolist())) == [(i, 0) for i in range(7)]


def test_amount_clusters_match_a_plain_loop(spark):
    amounts = [1.0, 2.0, 9.0, 9.5, 30.0, 31.0, 33.0, 60.0]
    rows = spark.createDataFrame([(1, a) for a in amounts], "account int, amount double")
    clusters: list[list[float]] = []
    for a in sorted(amounts):
        for c in clusters:
            mean = sum(c) / len(c)
            if abs(mean - a) <= max(2.5, mean * 0.12):
                c.append(a)
                break
        else:
            clusters.append([a])
    got = [(r["mean"], r["n"]) for r in histories.amount_clusters(rows, "account").orderBy("cluster").collect()]
    assert got == [(round(sum(c) / len(c), 4), len(c)) for c in clusters]


def test_upsert_outcomes(spark):
    stored = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    incoming = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "id int, v string")
    got = {r.id: (r.v, r.outcome) for r in identity.upsert(stored, incoming, ["id"], ["v"]).collect()}
    assert got == {1: ("x", "kept"), 2: ("z", "updated"), 3: (None, "unchanged"), 4: ("n", "inserted")}


def test_fuzzy_duplicates_meet_across_blocks(spark):
    rows = spark.createDataFrame([(i, 1, 5, date(2024, 1, i), "acme pro") for i in range(1, 11)], "id int, account int, amount int, date date, merchant string")
    got = {(r.left_id, r.right_id) for r in identity.fuzzy_duplicates(rows, rows).collect()}
    assert got == {(a, b) for a in range(1, 11) for b in range(1, 11) if abs(a - b) <= 2}


def test_lifecycle_needs_an_observed_miss(spark):
    subs = spark.createDataFrame([(1, "annual", date(2023, 1, 1), date(2024, 1, 1)), (2, "annual", date(2023, 1, 1), date(2024, 1, 1))], "account int, cadence string, last_date date, next_date date")
    charges = spark.createDataFrame([(1, date(2024, 3, 1))], "account int, date date")
    missing = lifecycle.observed_missing(subs, lifecycle.coverage(charges, "2024-06-01"), "2024-06-01")
    got = {r.account: r.state for r in lifecycle.lifecycle(subs, missing, "2024-06-01").collect()}
    assert got == {1: "former", 2: "needsReview"}


def test_mode_takes_the_greatest_of_equals(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], "g int, v string")
    assert {r.g: r.v for r in aggregates.mode(rows, "g", "v").collect()} == {1: "b", 2: "a"}


def test_entry_without_the_corpus_operators(spark):
    """A process of its own in which neither the package nor the pipeline can be imported still has every ledger query."""
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__
    from coffer import registry

    hidden = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("coffer.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__
print(len(__spark_entry__.queries()), len(__spark_entry__.oracle_sql()))
"""
    out = subprocess.run([sys.executable, "-c", hidden], cwd=Path(__spark_entry__.__file__).parent, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["period", "spent"]
