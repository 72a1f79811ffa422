"""Detection operators on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from coffer.functions import processors, text
from coffer.functions.money import parsed_date
from coffer.operators import scoring

SCHEMA = "cluster string, id long, date date, amount double, memo string, category string, merchant_raw string, merchant string, kind string, affinity double, confidence double"


def _charges(spark, name, days, amount=-9.99, memo="monthly subscription", category="software", kind="softwareOrSaaS", affinity=0.9, confidence=0.9):
    rows = [(name, i, None, amount, memo, category, name.upper(), name, kind, affinity, confidence) for i, _ in enumerate(days)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("date", F.date_add(F.lit("2024-01-05").cast("date"), F.element_at(F.array(*[F.lit(d) for d in days]), (F.col("id") + 1).cast("int"))))


def _decided(spark, charges):
    return scoring.decisions(scoring.snapshots(charges), F.lit(False)).collect()


def test_a_steady_service_is_detected(spark):
    (row,) = _decided(spark, _charges(spark, "cloudy", [0, 30, 60, 91, 121]))
    assert (row.cadence, row.disposition, row.status) == ("monthly", "detected", "active") and row.score > 0.9


def test_transfers_and_shops_are_suppressed(spark):
    moved = _decided(spark, _charges(spark, "bank", [0, 30, 60, 91], memo="transfer to savings", category="", kind="unknown", affinity=0.2))
    shops = _decided(spark, _charges(spark, "grocer", [0, 7, 14, 21, 28], memo="", category="groceries", kind="groceryRetailer", affinity=0.1))
    assert [r.disposition for r in moved + shops] == ["suppressed"] * 2 and moved[0].reason == "bank movement"


def test_cadence_across_missing_charges(spark):
    (row,) = scoring.snapshots(_charges(spark, "gappy", [0, 30, 91, 152])).collect()
    assert row.cadence == "monthly" and row.consistency > 0.65


def test_two_charges_need_strong_signals(spark):
    assert scoring.snapshots(_charges(spark, "pair", [0, 31])).first().cadence == "monthly"
    assert scoring.snapshots(_charges(spark, "weak", [0, 31], amount=-1.0, memo="order", category="retail", kind="unknown", affinity=0.1)).count() == 0


def test_nulls_refunds_and_empty_tables(spark):
    charges = _charges(spark, "odd", [0, 30, 60]).withColumns({"memo": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "kind": F.lit(None).cast("string")})
    assert scoring.snapshots(charges).first().kind == "unknown"
    assert scoring.snapshots(_charges(spark, "back", [0, 30, 60], memo="refund")).count() == 0
    assert scoring.snapshots(charges.where("false")).count() == 0 and scoring.single_charges(charges.where("false"), "2024-06-01").count() == 0


def test_merchants_behind_processors(spark):
    cases = {"STRIPE*": (None, False), "PAYPAL *GITHUB": ("GitHub", False), "apple.com/bill": ("Apple", True), "SP *acme_ai-api": ("Acme AI API", True), "Shop": (None, False)}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    out = df.select("raw", processors.unmasked(F.col("raw"), F.lit("annual plan"), F.lit(None).cast("string")).alias("u")).collect()
    assert {r.raw: (r.u.merchant, r.u.boost) for r in out} == cases


def test_marks_and_years(spark):
    row = spark.range(1).select(text.folded(F.lit("Škoda Žáček ệ")).alias("t"), parsed_date(F.lit("3/5/95")).alias("a"), parsed_date(F.lit("3/5/25")).alias("b"), parsed_date(F.lit("Mar 5 2025")).alias("c")).first()
    assert row.t == "skoda zacek e" and (str(row.a), str(row.b), str(row.c)) == ("1995-03-05", "2025-03-05", "2025-03-05")


def test_larger_tables_are_dealt_into_more_parts(spark, monkeypatch):
    """A task holds about PART_ROWS rows of the ledger however many there are; the snapshots keep to those parts."""
    from coffer.plans import staging
    from coffer.plans.views import ledger, subscriptions

    monkeypatch.setattr(staging, "PART_ROWS", 100)
    charges = ledger(spark, "/root/testdata/sf0.001")
    parts = -(-charges.count() // 100)
    assert parts > 4 and charges.rdd.getNumPartitions() == parts == scoring.snapshots(charges).rdd.getNumPartitions()
    assert subscriptions(spark, "/root/testdata/sf0.001").count() > 0


def test_recovery_groups_look_through_words_after_counting(spark):
    """No filter holds the words' expressions, so that they are not evaluated again where charges are read; the groups are those of the keys."""
    from coffer.operators import aggregates
    from coffer.plans.views import ledger

    charges = ledger(spark, "/root/testdata/sf0.001").withColumn("merchant", F.when(F.col("cluster") % 7 > 0, F.col("merchant")))
    groups = aggregates.recovery_groups(charges)
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "translate(" in line]
    keyed = aggregates.recovery_keys(charges).groupBy("key").count().collect()
    assert keyed and sorted(map(tuple, groups.collect())) == sorted(map(tuple, keyed))
