"""Queries of the detection operators over the ledger view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates
from .operators import scoring
from .plans.views import ledger
from .queries import query

#: The date that stands for today, and what a user confirmed, in these queries.
REF = "1998-08-01"
CONFIRMED = "cluster % 11 = 0"
_NUMBERS = ("consistency", "variation", "stability", "keyword", "affinity", "classification", "diversity", "descriptor", "penalty")


def _rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query
def prd_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-02..12 on every charge, counted."""
    names = ["refund", "movement", "bill", "noise", "strong", "keyword", "appointment", "order", "excluded", "known", "descriptor"]
    return predicates.flags(ledger(spark, sf_dir)).groupBy("memo", "category", *names).agg(F.count("*").alias("n"))


@query
def prd_group_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-14."""
    return scoring.analysable(ledger(spark, sf_dir))


@query
def scr_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-01..03 with REC-10..15 and AGG-10..14."""
    out = scoring.snapshots(ledger(spark, sf_dir))
    counts = ["n_movement", "n_bill", "n_noise", "n_excluded", "n_known", "n_appointment", "n_order"]
    return out.select("cluster", "n", "kind", "cadence", "explicit", "wording", *counts, *_rounded(*_NUMBERS, "mean_price", "min_price", "max_price"))


@query
def scr_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-04, SCR-05."""
    return scoring.snapshots(ledger(spark, sf_dir)).select("cluster", F.round(scoring.base_score(), 6).alias("base"), scoring.hard_reject().alias("rejected"))


@query
def scr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-06..10, SCR-12, SCR-14."""
    out = scoring.decisions(scoring.snapshots(ledger(spark, sf_dir)), F.expr(CONFIRMED))
    return out.select("cluster", *_rounded("score"), "sparse_auto", "pair_auto", "known_auto", "variable", "negative", "auto_confirm", "surface", "status", "disposition", "recurring", "reason")


@query
def scr_decision_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-08, SCR-09 as the fallback pass takes them: for review only."""
    out = scoring.decisions(scoring.snapshots(ledger(spark, sf_dir)), F.lit(False), fallback=True, review_only=True)
    return out.select("cluster", *_rounded("score"), "surface", "disposition")


@query
def scr_single_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-15, REC-18, REC-19, SCR-11: every order as a cluster of its own."""
    out = scoring.single_charges(ledger(spark, sf_dir).withColumn("cluster", F.col("id")), REF)
    return out.select("cluster", "cadence", *_rounded("score"), "disposition")
