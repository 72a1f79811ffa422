"""What to do about subscriptions: audit, decisions before renewal, review queue, lists (QRY-05, QRY-08, QRY-09, QRY-11, QRY-12).

A subscription holds account, name, category, cadence, state (active, former or
needsReview), monthly, confidence, change (of its price, or null), months (of
tenure) and renews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import nth_smallest

LOW_CONFIDENCE, RISE = 0.75, 0.05


def audit(subscriptions: DataFrame) -> DataFrame:
    """Adds points (0 to 100) and action: keep, review from 25 or cancel from 50 (QRY-09).

    Peers are counted per category, and the quartile is a place in counted prices: neither joins subscriptions with each other.
    """
    named = F.when(F.coalesce("category", F.lit("")).isin("", "Uncategorized"), None).otherwise(F.col("category"))
    peers = subscriptions.where(named.isNotNull()).groupBy(F.col("category").alias("p_category")).agg(F.count("*").alias("_peers"))
    top = nth_smallest(subscriptions.withColumn("_all", F.lit(1)), ["_all"], "monthly", F.least(F.col("n") - 1, F.floor(F.col("n") * 3 / 4)), "p75")
    out = subscriptions.join(peers, F.col("category") == F.col("p_category"), "left").crossJoin(F.broadcast(top.select("p75")))  # one row
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    total = (
        points(F.col("_peers") > 1, 25) + points(F.col("change") > RISE, 20) + points(F.col("confidence") < LOW_CONFIDENCE, 15)
        + points((F.col("monthly") >= F.col("p75")) & (F.col("p75") > 0), 15) + points(F.col("state") == "needsReview", 15)
    )
    total = F.when(F.coalesce(F.col("months") < 6, F.lit(False)), F.greatest(total - 10, F.lit(0))).otherwise(total)
    out = out.withColumn("points", F.least(F.lit(100), total))
    return out.withColumn("action", F.when(F.col("points") >= 50, "cancel").when(F.col("points") >= 25, "review").otherwise("keep")).drop("_peers", "p_category", "p75")


def act_now(subscriptions: DataFrame, overlaps: DataFrame, ref: str, days: int = 30) -> DataFrame:
    """Renewals within ``days`` with keep or review, and why (QRY-05); ``overlaps`` holds categories."""
    soon = subscriptions.where(F.col("renews") <= F.date_add(F.lit(ref).cast("date"), days))
    out = soon.join(overlaps.select(F.col("category").alias("o_category")), F.lower("category") == F.col("o_category"), "left")
    overlap, rise, low = F.col("o_category").isNotNull(), F.coalesce(F.col("rise") >= RISE, F.lit(False)), F.col("confidence") < LOW_CONFIDENCE
    reasons = F.array_compact(F.array(F.when(overlap, "category overlap"), F.when(rise, "price increase"), F.when(low, "low confidence")))
    action = F.when((F.col("state") == "needsReview") | low | overlap | rise, "review").otherwise("keep")
    n = F.size(reasons)
    joined = F.when(n <= 2, F.array_join(reasons, " and ")).otherwise(F.concat(F.array_join(F.slice(reasons, 1, 2), ", "), F.lit(", and "), F.element_at(reasons, -1)))
    why = F.when(action == "keep", "No risk signals detected.").when(n == 0, "Check this before the next renewal posts.").otherwise(F.concat(F.lit("Review because "), joined, F.lit(".")))
    return out.select("account", "renews", action.alias("action"), why.alias("detail"))


def review_queue(subscriptions: DataFrame, most: int = 5) -> DataFrame:
    """What needs a review, the surest first, with the number of all (QRY-08)."""
    waiting = subscriptions.where("state = 'needsReview'")
    head = waiting.orderBy(F.desc("confidence"), "name").limit(most)
    return head.crossJoin(F.broadcast(waiting.agg(F.count("*").alias("total")))).select("account", "name", "confidence", "total")  # one row


def list_counts(subscriptions: DataFrame) -> DataFrame:
    """How many each filter of the list shows, and the active ones' cost in a month (QRY-11)."""
    state = F.col("state")
    return subscriptions.agg(
        F.count_if(state == "needsReview").alias("review"), F.count_if(state != "needsReview").alias("all"), F.count_if(state == "active").alias("active"), F.count_if(state == "former").alias("ended"),
        F.count_if((state == "active") & (F.col("cadence") == "annual")).alias("yearly"), F.round(F.sum(F.when(state == "active", F.col("monthly"))), 2).alias("monthly_total"),
    )


def annual_list(subscriptions: DataFrame) -> DataFrame:
    """Active yearly subscriptions by renewal, with what the price was, is, and the difference (QRY-12)."""
    yearly = subscriptions.where("state = 'active' AND cadence = 'annual'")
    return yearly.select("account", "renews", F.col("first_price").alias("was"), F.col("price").alias("now"), (F.col("price") - F.col("first_price")).alias("delta")).orderBy("renews", "account")
