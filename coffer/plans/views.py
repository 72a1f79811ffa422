"""Ledger views of the given tables: transactions, purchases, billed customers.

Money is cast to decimals before any arithmetic. Joins carry no hints: the
optimizer broadcasts a side if its size allows and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schedule import advanced, cadence_of_median
from ..operators.aggregates import nth_smallest
from .staging import dealt

MONEY = "decimal(18,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: date, amount (debit < 0), account, merchant_raw, category, memo, currency."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    n = items.count()
    described = dealt(items, n, "l_partkey").join(parts, items["l_partkey"] == parts["p_partkey"]).join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])
    joined = dealt(described, n, "l_orderkey").join(orders, F.col("l_orderkey") == orders["o_orderkey"])
    return joined.select(
        F.col("l_shipdate").cast("date").alias("date"),
        (-(F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast(MONEY)))).cast(MONEY).alias("amount"),
        F.col("o_custkey").alias("account"),
        F.col("s_name").alias("merchant_raw"),
        F.lower("s_name").alias("merchant"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("memo"),
        F.lit("USD").alias("currency"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of the event stream: id, ts, account, merchant, amount."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return events.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("account"),
        F.get_json_object("props", "$.k").alias("merchant"),
        (-F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"),
    )


def billed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order as a charge: account, date, amount (positive)."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
    )


def by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charges of ``billed``, dealt by their account."""
    return dealt(billed(spark, sf_dir), table(spark, sf_dir, "orders").count(), "account")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subscriptions: name, category, cadence of the median interval, last price and date, next date."""
    charges = by_account(spark, sf_dir)
    order = Window.partitionBy("account").orderBy("date", "id")
    steps = charges.withColumn("gap", F.date_diff("date", F.lag("date").over(order)))
    grouped = steps.groupBy("account").agg(
        F.count("*").alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max(F.struct("date", "id", "amount"))["amount"].alias("price"),
    )
    median = nth_smallest(steps, ["account"], "gap", F.floor(F.col("n") / 2), "median_gap")
    grouped = grouped.join(median, "account", "left")
    grouped = grouped.withColumn("cadence", F.coalesce(cadence_of_median(F.col("median_gap"), F.col("n")), F.lit("unknown")))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    return grouped.join(customers, "account").withColumn("next_date", advanced(F.col("last_date"), F.col("cadence"), F.lit(1)))


KINDS = ["subscriptionService", "membershipRetailer", "marketplace", "groceryRetailer", "restaurant", "medicalOrWellnessProvider", "transportOrTravel", "utilityOrBiller", "generalRetail", "softwareOrSaaS", "mediaStreaming", "unknown"]
#: Memos and categories that orders are given in turn, so that every signal occurs.
MEMOS = ["monthly subscription plan", "transfer to savings", "electric utility bill", "refund of a charge", "visit with the doctor", "premium membership renewal", "order 12 shipped", "icloud storage", "annual plan", "thank you"]
CATEGORIES = ["software", "groceries", "streaming", "travel", "", "restaurants"]
CYCLES = [30, 7, 14, 91, 182, 365]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as classified charges of one merchant each: id, cluster, date, amount, texts, kind, affinity, confidence.

    Half of the merchants (customers) bill in a regular cycle, a third at one price.
    """
    orders = table(spark, sf_dir, "orders")
    o = dealt(orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), orders.count(), "o_custkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = o.select("*", (F.row_number().over(order) - 1).alias("i"), F.min("o_orderdate").over(Window.partitionBy("o_custkey")).cast("date").alias("first"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    pick = lambda of, at: F.get(F.array(*[F.lit(v) for v in of]), at.cast("int"))
    own = c % 3 < 2
    return o.select(
        k.alias("id"),
        c.alias("cluster"),
        F.when(c % 2 == 0, F.date_add("first", (F.col("i") * pick(CYCLES, F.floor(c / 2) % 6)).cast("int"))).otherwise(F.col("o_orderdate").cast("date")).alias("date"),
        (-F.when(c % 3 == 0, 100 + c % 50).otherwise(F.col("o_totalprice"))).cast(MONEY).alias("amount"),
        pick(MEMOS, F.when(own, c % 10).otherwise(k % 10)).alias("memo"),
        pick(CATEGORIES, F.when(own, F.floor(c / 10) % 6).otherwise(F.floor(k / 4) % 6)).alias("category"),
        F.concat(F.lit("MERCHANT "), c.cast("string")).alias("merchant_raw"),
        F.concat(F.lit("Merchant "), c.cast("string")).alias("merchant"),
        pick(KINDS, F.when(c % 12 == k % 12, F.lit(11)).otherwise(F.floor(c / 3) % 12)).alias("kind"),
        ((c * 7 % 10) / 10).cast("double").alias("affinity"),
        ((c % 10) / 10 + 0.05).cast("double").alias("confidence"),
    )
