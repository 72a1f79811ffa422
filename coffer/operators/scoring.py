"""Scores and decisions on clusters of charges (SCR-01..12, SCR-14, REC-11, REC-12, REC-14, REC-18, REC-19, PRD-14, PRD-15).

A frame of charges holds cluster, id, date, amount (debit < 0), memo, category,
merchant_raw, merchant, kind, affinity and confidence. All group values are sums,
counts and order statistics of counted values; no cluster is held as a list. Means and
scores are rounded to nine places, so that no threshold hangs on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import NON_SUBSCRIPTION_KINDS, contains_any, flags, signal_text
from ..functions.schedule import CADENCES, cadence_of_median, of_cadence
from .aggregates import mode, nth_smallest

# Affinity and category of a kind.
AFFINITY = {
    "subscriptionService": 0.95, "mediaStreaming": 0.95, "softwareOrSaaS": 0.88, "utilityOrBiller": 0.6, "membershipRetailer": 0.35, "marketplace": 0.12,
    "groceryRetailer": 0.08, "restaurant": 0.05, "medicalOrWellnessProvider": 0.1, "transportOrTravel": 0.15, "generalRetail": 0.12, "unknown": 0.4,
}
DEFAULT_CATEGORY = {
    "subscriptionService": "Subscription", "membershipRetailer": "Membership", "marketplace": "Marketplace", "groceryRetailer": "Groceries", "restaurant": "Dining",
    "medicalOrWellnessProvider": "Health", "transportOrTravel": "Travel", "utilityOrBiller": "Utilities", "generalRetail": "Retail", "softwareOrSaaS": "Software",
    "mediaStreaming": "Streaming", "unknown": "Uncategorized",
}
SERVICES = ["subscriptionService", "softwareOrSaaS", "mediaStreaming"]
#: The order in which cadences with missing charges are tried.
GAP_ORDER = ["weekly", "biweekly", "monthly", "quarterly", "semiannual", "annual"]
LOOKBACK_DAYS, BOOST, FLOOR = 75, 0.30, 0.38


def by_kind(values: dict, kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.coalesce(kind, F.lit("unknown"))]


def memo_variant(memo: Column) -> Column:
    """A memo without numbers, references and months, for its diversity; null if nothing is left (SCR-02)."""
    out = F.lower(memo)
    # What is taken out, in this order.
    for pattern in (
        r"\d+", r"inv[a-z\-]*", r"ref[a-z\-]*", r"conf[a-z\-]*", r"order[a-z\-]*",
        r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\b", r"[a-f0-9\-]{8,}",
    ):
        out = F.regexp_replace(out, pattern, "")
    return F.nullif(F.trim(F.regexp_replace(out, r"[\s\-_*#]+", " ")), F.lit(""))


def _fit(gap: Column, cadence: Column) -> tuple[Column, Column, Column]:
    """(how well an interval fits whole cycles, whether it does, whether it is one cycle) for REC-13."""
    cycle, tol = of_cadence(cadence, "cycle").cast("double"), of_cadence(cadence, "interval_tolerance").cast("double")
    times = F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.round(gap / cycle)))
    away = F.abs(gap - times * cycle)
    return F.greatest(F.lit(0.0), 1 - away / times / tol - 0.1 * (times - 1)), away <= tol * times, F.abs(gap - cycle) <= tol


def consistencies(gaps: DataFrame, cadence: Column) -> DataFrame:
    """cluster, cadence, consistency, all_fit, some_direct from counted gaps (cluster, gap, c) and a cadence for each row."""
    fit, fits, direct = _fit(F.col("gap"), cadence)
    away = F.abs(F.col("gap") - of_cadence(cadence, "cycle"))
    tol = F.first(of_cadence(cadence, "interval_tolerance"))
    grouped = gaps.withColumn("_cadence", cadence).groupBy("cluster", F.col("_cadence").alias("cadence")).agg(
        (F.sum(fit * F.col("c")) / F.sum("c")).alias("_fit"), F.bool_and(fits).alias("all_fit"), F.bool_or(direct).alias("some_direct"),
        F.greatest(F.lit(0.0), 1 - F.sum(away * F.col("c")) / F.sum("c") / tol).alias("_plain"),
    )
    return grouped.select("cluster", "cadence", "all_fit", "some_direct", F.round(F.when(F.col("all_fit") & F.col("some_direct"), F.col("_fit")).otherwise(F.col("_plain")), 9).alias("consistency"))


def _every_fit() -> list[Column]:
    """What the counted gaps of a cluster say of each cadence, as aggregates for ``_consistency_of``."""
    gap, c, out = F.col("gap"), F.col("c"), [F.sum("c").alias("_gaps")]
    for name in GAP_ORDER:
        fit, fits, direct = _fit(gap, F.lit(name))
        away = F.abs(gap - of_cadence(F.lit(name), "cycle"))
        out += [F.sum(fit * c).alias(f"_fit_{name}"), (F.bool_and(fits) & F.bool_or(direct)).alias(f"_whole_{name}"), F.sum(away * c).alias(f"_away_{name}")]
    return out


def _consistency_of(name: str) -> Column:
    plain = F.greatest(F.lit(0.0), 1 - F.col(f"_away_{name}") / F.col("_gaps") / of_cadence(F.lit(name), "interval_tolerance"))
    return F.round(F.when(F.col(f"_whole_{name}"), F.col(f"_fit_{name}") / F.col("_gaps")).otherwise(plain), 9)


def snapshots(charges: DataFrame) -> DataFrame:
    """One row of features per cluster with a cadence (SCR-01, SCR-02, SCR-03); clusters of refunds alone or of one charge have none."""
    priced = charges.withColumn("_price", F.abs("amount").cast("double"))
    order = Window.partitionBy("cluster").orderBy("date", "id")
    before = F.lag("_price").over(order)
    steps = priced.select("cluster", F.date_diff("date", F.lag("date").over(order)).alias("gap"), (F.abs(F.col("_price") - before) / F.greatest("_price", before)).alias("step"))
    # Charges of a cluster whose words and class agree are one row before the words are looked through.
    alike = priced.groupBy("cluster", "memo", "category", "merchant_raw", "merchant", "kind", "affinity", "confidence").agg(
        F.count("*").alias("_c"), F.sum("_price").alias("_sum"), F.count("_price").alias("_priced"), F.min("_price").alias("_min"), F.max("_price").alias("_max"), F.max(F.struct("date", "id", "_price")).alias("_last"),
    )
    marked = flags(alike).withColumns({"_affinity": F.greatest("affinity", by_kind(AFFINITY, F.col("kind"))), "_variant": memo_variant(F.col("memo"))})
    count = lambda name: F.sum(F.when(F.col(name), F.col("_c")).otherwise(0)).alias(f"n_{name}")
    mean = lambda name: F.sum(F.col(name) * F.col("_c")) / F.sum(F.when(F.col(name).isNotNull(), F.col("_c")))
    grouped = marked.groupBy("cluster").agg(
        F.sum("_c").alias("n"), *[count(x) for x in ("refund", "movement", "bill", "noise", "keyword", "appointment", "order", "excluded", "known")],
        F.bool_or("keyword").alias("explicit"), F.bool_or("strong").alias("wording"), F.bool_or("planned").alias("planned"), F.sum(F.when(F.col("descriptor").isNotNull(), F.col("_c")).otherwise(0)).alias("n_descriptor"),
        F.round(mean("_affinity"), 9).alias("affinity"), F.round(mean("confidence"), 9).alias("classification"), F.count_distinct("_variant").alias("n_variants"),
        (F.sum("_sum") / F.sum("_priced")).alias("mean_price"), F.min("_min").alias("min_price"), F.max("_max").alias("max_price"),
        F.max(F.struct(F.col("_last.date").alias("date"), F.col("_last.id").alias("id"), F.col("_last._price").alias("_price"), "category")).alias("_latest"),
    )
    grouped = grouped.withColumn("last", F.struct(F.col("_latest._price").alias("_price"), F.col("_latest.date").alias("date"), F.col("_latest.category").alias("category"))).drop("_latest")
    grouped = grouped.where((F.col("n") >= 2) & (F.col("n_refund") < F.col("n")))
    dominant = mode(charges.withColumn("kind", F.coalesce("kind", F.lit("unknown"))), "cluster", "kind").select("cluster", "kind")
    half = F.floor(F.col("n") / 2)
    # The median gap, and what the gaps say of every cadence: of the one that is chosen, and of those that missing charges may hide.
    gaps = steps.where("gap IS NOT NULL").groupBy("cluster", "gap").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("cluster").orderBy("gap"))
    placed = gaps.select("*", upto.alias("_upto"), F.sum("c").over(Window.partitionBy("cluster")).alias("_all"))
    fits = placed.groupBy("cluster").agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("gap"))).alias("median_gap"), *_every_fit())
    out = grouped.join(dominant, "cluster").join(fits, "cluster").join(nth_smallest(steps, ["cluster"], "step", half, "variation"), "cluster", "left")
    n = F.col("n")
    out = out.withColumn("variation", F.round(F.coalesce("variation", F.lit(0.0)), 9)).withColumns(
        {
            "descriptor": F.col("n_descriptor") / n,
            "keyword": F.least(F.lit(1.0), F.greatest(F.col("n_keyword"), F.col("n_descriptor")) / n),
            "diversity": F.col("n_variants") / n,
            "stability": F.greatest(F.lit(0.0), 1 - F.least(F.col("variation") / 0.6, F.lit(1.0))),
            "non_subscription": F.col("kind").isin(NON_SUBSCRIPTION_KINDS),
        }
    )
    flat = (F.col("max_price") - F.col("min_price")) <= F.greatest(F.lit(0.01), 0.01 * F.col("max_price"))
    quiet = (F.col("n_movement") + F.col("n_bill") + F.col("n_noise") + F.col("n_order")) == 0
    strong = ((F.col("n_excluded") == 0) & ((F.col("affinity") >= 0.85) | ((F.col("keyword") >= 0.7) & (F.col("affinity") >= 0.65)))) | (quiet & (F.col("min_price") >= 2.99) & flat)
    pair = F.coalesce(*[F.when(F.col("median_gap").between(*c.pair), F.lit(c.name)) for c in CADENCES])
    out = out.withColumn("strong", strong).withColumn("cadence", F.nullif(cadence_of_median(F.col("median_gap"), n), F.lit("unknown")))
    out = out.withColumn("cadence", F.coalesce("cadence", F.when((n == 2) & F.col("strong"), pair)))
    hidden = [F.when(F.col(f"_whole_{c}") & (_consistency_of(c) >= 0.65) & (n >= of_cadence(F.lit(c), "least")), F.lit(c)) for c in GAP_ORDER]
    out = out.withColumn("cadence", F.coalesce("cadence", F.when(F.col("strong") & (n >= 3), F.coalesce(*hidden)))).where("cadence IS NOT NULL")
    out = out.withColumn("consistency", F.coalesce(*[F.when(F.col("cadence") == c, _consistency_of(c)) for c in GAP_ORDER]))
    out = out.drop("_gaps", *[f"_{x}_{c}" for x in ("fit", "whole", "away") for c in GAP_ORDER])
    return out.withColumn("penalty", F.round(F.least(F.lit(1.0), penalty()), 9)).drop("strong", "n_variants", "n_keyword")


def penalty() -> Column:
    """What speaks against a cluster, by columns of its snapshot (SCR-03)."""
    n, keyword = F.col("n"), F.col("keyword")
    share = lambda name, most, by: F.least(F.lit(most), by * F.col(name) / n)
    category = F.when(F.col("non_subscription"), F.when(keyword >= 0.5, 0.18).otherwise(0.35)).otherwise(share("n_excluded", 0.35, 0.35) * F.when(keyword >= 0.5, 0.5).otherwise(1.0))
    memos = F.when(F.col("diversity") > 0.65, F.least(F.lit(0.15), F.col("diversity") * F.greatest(F.lit(0.1), 1 - F.col("descriptor")) * 0.2)).otherwise(0.0)
    amounts = F.when(F.col("variation") > 0.3, F.least(F.lit(0.15), F.col("variation") * 0.2)).otherwise(0.0)
    visits = F.when(F.col("planned"), 0.0).otherwise(share("n_appointment", 0.2, 0.25))
    orders = F.when(F.col("n_descriptor") > 0, 0.0).otherwise(share("n_order", 0.2, 0.25))
    moved = F.when(F.col("wording"), share("n_movement", 0.12, 0.16)).otherwise(share("n_movement", 0.45, 0.5))
    return category + memos + amounts + visits + orders + moved


def hard_reject() -> Column:
    """The seven rules (SCR-04)."""
    n, keyword, affinity = F.col("n"), F.col("keyword"), F.col("affinity")
    most = F.greatest(F.lit(1), n - 1)
    return (
        ((F.col("n_movement") >= most) & ~F.col("wording"))
        | ((F.col("n_bill") >= most) & ~F.col("explicit"))
        | ((F.col("n_noise") >= most) & ~F.col("explicit"))
        | (F.col("non_subscription") & (keyword == 0))
        | ((F.col("n_excluded") >= F.greatest(F.lit(2), n - 1)) & (keyword == 0))
        | ((F.col("diversity") > 0.8) & (F.col("descriptor") < 0.2) & (keyword < 0.5) & (affinity < 0.6))
        | ((F.col("variation") > 0.65) & (keyword == 0) & (affinity < 0.6))
    )


def base_score() -> Column:
    """SCR-05."""
    rare = F.col("cadence").isin("annual", "semiannual")
    w = lambda a, b: F.when(rare, a).otherwise(b)
    total = (
        F.col("consistency") * w(0.22, 0.32) + F.col("stability") * w(0.16, 0.18) + F.col("keyword") * w(0.18, 0.14)
        + F.col("affinity") * w(0.20, 0.14) + F.greatest(F.lit(0.0), 1 - F.col("penalty")) * 0.12 + F.col("classification") * w(0.12, 0.10)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), total)), 9)


def with_evidence(snapshot: DataFrame) -> DataFrame:
    """Adds the evidence flags (SCR-06)."""
    n, keyword, cadence = F.col("n"), F.col("keyword"), F.col("cadence")
    most, low = F.greatest(F.lit(1), n - 1), F.greatest(F.lit(0.0), 1 - F.col("penalty"))
    out = snapshot.withColumns(
        {
            "low": low, "strong_cadence": F.col("consistency") >= 0.78, "strong_merchant": (F.col("affinity") >= 0.78) | (keyword >= 0.45), "strong_class": F.col("classification") >= 0.72,
            "variable": (F.col("variation") <= 0.45) & (F.col("consistency") >= 0.72) & (F.col("affinity") >= 0.82) & (F.col("kind") == "softwareOrSaaS"),
        }
    )
    return out.withColumns(
        {
            "sparse_auto": (n == 2) & cadence.isin("annual", "semiannual") & F.col("strong_cadence") & F.col("strong_merchant") & F.col("strong_class") & (F.col("low") >= 0.72),
            "pair_auto": (n == 2) & (cadence == "monthly") & (F.col("consistency") >= 0.25) & F.col("strong_merchant") & (F.col("strong_class") | (F.col("explicit") & (keyword >= 0.5)))
            & (F.col("stability") >= 0.85) & (F.col("low") >= 0.82) & (keyword >= 0.35) & F.col("kind").isin(SERVICES),
            "known_auto": (F.col("n_known") >= most) & (F.col("n_bill") + F.col("n_noise") + F.col("n_movement") == 0) & F.col("strong_merchant")
            & (F.col("classification") >= 0.55) & (F.col("low") >= 0.52) & (F.col("stability") >= 0.65),
            "negative": (F.col("non_subscription") & (keyword < 0.35) & (F.col("descriptor") < 0.3)) | ((F.col("n_movement") == n) & ~F.col("wording"))
            | ((F.col("n_bill") >= most) & ~F.col("explicit")) | ((F.col("n_noise") >= most) & ~F.col("explicit")),
        }
    )


def decisions(snapshot: DataFrame, boosted: Column, fallback: bool = False, review_only: bool = False) -> DataFrame:
    """Adds confidence, auto_confirm, surface, disposition, status and reason (SCR-04..SCR-10, SCR-12, SCR-14).

    disposition is detected, needsReview or suppressed; ``boosted`` marks clusters that a user confirmed.
    """
    out = with_evidence(snapshot).withColumn("rejected", hard_reject()).withColumn("base", base_score())
    c, n = F.col("score"), F.col("n")
    out = out.withColumn("score", F.when(F.col("rejected"), 0.0).otherwise(F.least(F.lit(0.99), F.col("base") + F.when(boosted, BOOST).otherwise(0.0))))
    least = of_cadence(F.col("cadence"), "least")
    routine = (n >= least) & F.col("strong_cadence") & F.col("strong_merchant") & (F.col("low") >= 0.7) & ((F.col("stability") >= 0.45) | F.col("variable")) & (c >= 0.68) & (F.col("strong_class") | F.col("variable"))
    auto = ~F.col("negative") & ((F.col("sparse_auto") & (c >= 0.72)) | ((F.col("pair_auto") | F.col("known_auto")) & (c >= 0.62)) | routine)
    out = out.withColumn("auto_confirm", auto)
    doubtful = (F.col("classification") < 0.76) | ((F.col("stability") < 0.5) & ~F.col("variable")) | (c < 0.72) | F.lit(fallback)
    surface = (
        ~F.col("auto_confirm") & (c >= (0.42 if fallback else 0.48)) & (F.col("n_movement") < n) & ((F.col("n_bill") < n) | F.col("explicit"))
        & ((F.col("n_noise") < n) | F.col("explicit")) & (F.col("penalty") < 0.6) & F.col("strong_cadence") & F.col("strong_merchant") & doubtful
    )
    kinds = {**dict.fromkeys(AFFINITY, 0.86), **dict.fromkeys(SERVICES, 0.72), "membershipRetailer": 0.76, "utilityOrBiller": 0.90, "unknown": 0.82}
    library = (
        (F.col("consistency") >= 0.8) & ((F.col("stability") >= 0.7) | F.col("variable")) & (F.col("affinity") >= 0.88) & (F.col("classification") >= 0.82)
        & (F.col("penalty") < 0.25) & F.col("kind").isin(SERVICES)
    )
    by_score = (c >= by_kind(kinds, F.col("kind"))) & (F.col("classification") >= F.when(F.col("kind") == "unknown", 0.45).otherwise(0.35))
    confirm = ((F.col("pair_auto") | F.col("known_auto")) & (c >= 0.62)) | F.col("auto_confirm") | library | by_score
    enough = (n >= least) | F.col("sparse_auto") | F.col("pair_auto") | F.col("known_auto")
    out = out.withColumn("surface", surface).withColumn("status", F.when(confirm & enough & ~F.lit(review_only), "active").otherwise("needsReview"))
    kept = ~F.col("rejected") & ((c >= FLOOR) | F.col("surface"))
    out = out.withColumn("disposition", F.when(~kept, "suppressed").when(F.col("status") == "active", "detected").otherwise("needsReview"))
    return out.withColumn("recurring", F.col("rejected") | (F.greatest("consistency", "keyword", "affinity") >= 0.7)).withColumn("reason", F.when(F.col("rejected"), _why_rejected()).otherwise(_why_kept()))


def _why_rejected() -> Column:
    """A code for each reason of a hard reject (SCR-12)."""
    most = F.greatest(F.lit(1), F.col("n") - 1)
    return (
        F.when(F.col("non_subscription") & (F.col("keyword") == 0), "non-subscription merchant")
        .when((F.col("n_movement") >= most) & ~F.col("wording"), "bank movement")
        .when((F.col("n_bill") >= most) & ~F.col("explicit"), "bill or purchase stream")
        .when((F.col("n_noise") >= most) & ~F.col("explicit"), "repeated commerce")
        .when((F.col("n_excluded") >= F.greatest(F.lit(2), F.col("n") - 1)) & (F.col("keyword") == 0), "excluded categories")
        .otherwise("too noisy")
    )


def _why_kept() -> Column:
    return (
        F.when(F.col("non_subscription") & (F.col("keyword") == 0), "recurring, unlikely kind")
        .when(F.col("classification") < 0.65, "uncertain classification")
        .when((F.col("diversity") > 0.65) & (F.col("descriptor") < 0.3), "details vary")
        .when(F.col("penalty") > 0.25, "conflicting signals")
        .otherwise("stable timing")
    )


def analysable(charges: DataFrame) -> DataFrame:
    """Clusters that are not bills or of unlikely kinds through and through, or have an explicit keyword (PRD-14)."""
    unlikely = F.col("bill") | F.coalesce(F.col("kind").isin(NON_SUBSCRIPTION_KINDS), F.lit(False))
    return flags(charges).groupBy("cluster").agg((~F.bool_and(unlikely) | F.bool_or("keyword")).alias("ok")).where("ok").select("cluster")


def single_cadence() -> Column:
    """The cadence that one charge's wording or kind suggests (REC-19)."""
    text = signal_text("memo", "category", "merchant_raw", "merchant")
    # Wordings in the order that they are tried.
    wordings = [
        ("annual", ["annual", "yearly", "per year", "12 month", "12-month"]), ("quarterly", ["quarterly", "quarter", "qtr"]),
        ("semiannual", ["semiannual", "semi-annual", "biannual", "6 month", "6-month"]),
        ("biweekly", ["biweekly", "bi-weekly", "every two weeks", "every 2 weeks", "fortnightly"]), ("weekly", ["weekly", "per week"]),
        ("monthly", ["monthly", "trial", "renew", "renewal", "subscription", "membership", "plan", "premium", "plus", "pro"]),
    ]
    said = F.coalesce(*[F.when(contains_any(text, words), F.lit(c)) for c, words in wordings])
    monthly = F.col("kind").isin(*SERVICES, "membershipRetailer", "unknown") | ((F.col("kind") == "utilityOrBiller") & F.col("keyword"))
    return F.coalesce(said, F.when(monthly, F.lit("monthly")), F.lit("unknown"))


def single_charges(charges: DataFrame, ref: str) -> DataFrame:
    """Clusters of one charge that the gate lets pass, with cadence, score and disposition (REC-18, REC-19, PRD-15, SCR-11)."""
    alone = charges.withColumn("_n", F.count("*").over(Window.partitionBy("cluster"))).where("_n = 1").drop("_n")
    out = flags(alone).withColumn("_affinity", F.greatest("affinity", by_kind(AFFINITY, F.col("kind")))).withColumn("_described", F.col("descriptor").isNotNull())
    told = F.col("keyword") | F.col("_described")
    gate = (
        (F.col("amount") < 0) & ~F.col("refund") & (F.col("date") >= F.date_sub(F.lit(ref).cast("date"), LOOKBACK_DAYS))
        & (~F.col("kind").isin(NON_SUBSCRIPTION_KINDS) | told) & (~F.col("excluded") | told) & (~F.col("movement") | F.col("strong"))
        & (~F.col("bill") | F.col("keyword")) & (~F.col("noise") | F.col("keyword")) & (~F.col("order") | told)
        & (((F.col("_affinity") >= 0.92) & (F.col("confidence") >= 0.84)) | (F.col("keyword") & (F.col("_affinity") >= 0.72)) | (F.col("_described") & (F.col("_affinity") >= 0.78)))
    )
    kinds = {**dict.fromkeys(AFFINITY, 0.08), **dict.fromkeys(SERVICES, 1.0), "membershipRetailer": 0.75, "unknown": 0.45}
    kind_score = F.when((F.col("kind") == "utilityOrBiller") & F.col("keyword"), 0.55).otherwise(by_kind(kinds, F.col("kind")))
    flag = lambda name: F.col(name).cast("double")
    score = F.col("_affinity") * 0.42 + F.col("confidence") * 0.20 + flag("keyword") * 0.18 + flag("_described") * 0.10 + kind_score * 0.10
    out = out.where(gate).withColumn("cadence", single_cadence()).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)))
    return out.withColumn("disposition", F.when((F.col("cadence") == "unknown") | (F.col("score") < 0.62), "suppressed").otherwise("needsReview")).select("cluster", "id", "cadence", "score", "disposition")
