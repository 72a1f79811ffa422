"""Match rules made of what the user decided: corrections, reviews, confirmed and hidden subscriptions (RUL-01, RUL-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import nth_smallest
from .rules import BAND, BAND_SHARE, token_hints

#: Priorities of the kinds of rules, and the confidence of each.
CORRECTED, REVIEWED_NOT, REVIEWED, CONFIRMED, MANUAL, HIDDEN = 1_100, 1_000, 900, 850, 700, 1_050
REVIEW_CONFIDENCE, MANUAL_CONFIDENCE, HIDDEN_CONFIDENCE = 0.86, 0.78, 0.96
#: Room around the amounts of a hidden subscription, least and as a share of the highest.
HIDDEN_BAND, HIDDEN_SHARE = 0.05, 0.02

#: What a derived rule holds; ``_key`` is its identity: folded name, kind and origin.
RULE = ["canonical", "negative", "origin", "subscription", "price", "currency", "confidence", "priority"]


def _keyed(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("negative"), "negative").otherwise("positive")
    return df.withColumn("_key", F.concat_ws("|", F.lower("canonical"), kind, "origin"))


def _last(df: DataFrame, by: Column) -> DataFrame:
    """One row of each name, ignoring case: the one with the greatest id."""
    order = Window.partitionBy(by).orderBy(F.desc("id"))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _decided() -> Column:
    overridden = F.col("price").isNotNull() | F.col("cadence").isNotNull() | F.col("status").isNotNull()
    return F.col("confirmed") | overridden


def derived_rules(existing: DataFrame, corrections: DataFrame, reviews: DataFrame, subscriptions: DataFrame, charges: DataFrame) -> DataFrame:
    """The rules after another look at the decisions: ``_key``, the columns of a rule, raw_merchants, required, low, high and outcome.

    existing: rules as returned here (without the outcome); corrections: id, canonical, is_subscription; reviews: id,
    canonical, false_positive, confirmed, and price, currency, cadence and status (the overrides, or null);
    subscriptions: id, canonical, confirmed, manual, price, currency, score; charges: merchant, merchant_raw.
    A correction makes a negative rule, unless a review that is no false positive decides for the name: then
    that rule goes. A review makes a rule of its kind and removes the opposite one. Confirmed and manual
    subscriptions make positive ones. Rules that nothing speaks of stay. A rule's raw names are all distinct spellings of its name.
    Names are compared without case where they identify a rule, and exactly where they are looked up; rows without a name make none.
    Outcomes: inserted, updated and kept; removed rules are not returned.
    """
    decided = reviews.where(_decided() & ~F.col("false_positive")).select("canonical").distinct()
    wrong = corrections.where(~F.col("is_subscription") & F.col("canonical").isNotNull())
    owner = _last(subscriptions.where("canonical IS NOT NULL"), F.col("canonical")).select("canonical", F.col("id").alias("subscription"), F.col("price").alias("own_price"), F.col("currency").alias("own_currency"))
    rule = lambda df, **c: df.select("id", *[c.get(n, F.col(n)).alias(n) for n in RULE])
    none = F.lit(None)
    by_correction = rule(wrong.join(decided, "canonical", "left_anti"), negative=F.lit(True), origin=F.lit("userCorrection"), subscription=none, price=none, currency=none, confidence=F.lit(1.0), priority=F.lit(CORRECTED))
    said = reviews.where((F.col("false_positive") | _decided()) & F.col("canonical").isNotNull())
    said = _last(said, F.lower("canonical")).join(owner, "canonical", "left")
    by_review = rule(
        said, negative=F.col("false_positive"), origin=F.lit("reviewRule"), price=F.coalesce("price", "own_price"), currency=F.coalesce("currency", "own_currency"),
        confidence=F.when(F.col("confirmed"), 1.0).otherwise(REVIEW_CONFIDENCE), priority=F.when(F.col("false_positive"), REVIEWED_NOT).otherwise(REVIEWED),
    )
    sure = subscriptions.where((F.col("confirmed") | F.col("manual")) & F.col("canonical").isNotNull())
    by_subscription = rule(
        sure, negative=F.lit(False), origin=F.lit("confirmedSubscription"), subscription=F.col("id"),
        confidence=F.when(F.col("confirmed"), 1.0).otherwise(F.greatest("score", F.lit(MANUAL_CONFIDENCE))), priority=F.when(F.col("confirmed"), CONFIRMED).otherwise(MANUAL),
    )
    made = _last(_keyed(by_correction.unionByName(by_review).unionByName(by_subscription)), F.col("_key")).drop("id")

    spellings = charges.select(F.col("merchant").alias("canonical"), "merchant_raw").where("merchant_raw IS NOT NULL").distinct()
    spellings = spellings.join(made.select("canonical").distinct(), "canonical", "left_semi").groupBy("canonical").agg(F.sort_array(F.collect_list("merchant_raw")).alias("raw_merchants"))
    price = F.when(~F.col("negative"), F.abs(F.col("price").cast("double")))
    room = F.greatest(F.lit(BAND), price * BAND_SHARE)
    made = made.join(spellings, "canonical", "left").withColumns(
        {
            "raw_merchants": F.coalesce("raw_merchants", F.array().cast("array<string>")), "required": token_hints(F.col("canonical")), "currency": F.nullif(F.trim("currency"), F.lit("")),
            "low": price - room, "high": price + room, "price": F.when(~F.col("negative"), F.col("price")),
        }
    )

    overruled = wrong.join(decided, "canonical", "left_semi").select(F.concat(F.lower("canonical"), F.lit("|negative|userCorrection")).alias("_key"))
    opposite = F.when(F.col("false_positive"), "|positive|reviewRule").otherwise("|negative|reviewRule")
    gone = overruled.unionByName(said.select(F.concat(F.lower("canonical"), opposite).alias("_key")))
    values = [*RULE, "raw_merchants", "required", "low", "high"]
    old = existing.join(gone, "_key", "left_anti").select("_key", F.struct(*values).alias("_old"))
    both = old.join(made.select("_key", F.struct(*values).alias("_new")), "_key", "full_outer")
    value = lambda c: F.coalesce("_new.subscription", "_old.subscription") if c == "subscription" else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").otherwise("updated")
    return both.select("_key", *[value(c).alias(c) for c in values], outcome.alias("outcome"))


def _flat(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "|,", "//")


def _digest(df: DataFrame, by: list[str], value: Column, alias: str) -> DataFrame:
    """(by, alias, n_alias): a number that equal sets of a group's texts share, and the size of the set; no set is held anywhere."""
    number = F.conv(F.substring(F.md5(_flat(F.col("_v")).cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    distinct = df.select(*by, value.alias("_v")).where("trim(_v) <> ''").distinct()
    return distinct.groupBy(*by).agg(F.sum(number).cast("string").alias(alias), F.count("*").alias(f"n_{alias}"))


def hidden_rules(hidden: DataFrame, charges: DataFrame) -> DataFrame:
    """A negative rule for every scope of every hidden subscription (RUL-15).

    hidden: subscription, canonical; charges: subscription, merchant_raw, account, currency, source, import, amount.
    A scope is the charges of one account, currency, source and import, blanks counting as none. The
    rule takes what lies within 2 % of the scope's amounts (0.05 at least). ``scope_key`` is equal for equal names,
    spellings, amounts and scopes, so a subscription hidden again finds its rule; it digests the sets instead of
    listing them. Spellings are rows of their own (``hidden_spellings``). Rules of subscriptions without charges don't exist.
    """
    by = ["subscription", "account", "currency", "source", "import"]
    own = _scoped(hidden, charges)
    amount = F.abs(F.col("amount")).cast("decimal(20,2)").cast("string")
    stats = own.groupBy(*by, "canonical").agg(F.count("*").alias("n"), F.min("_amount").alias("least"), F.max("_amount").alias("most"))
    middle = nth_smallest(own, by, "_amount", F.floor(F.col("n") / 2), "price")
    out = stats.join(middle, by, "left")
    out = out.join(_digest(own, by, F.col("merchant_raw"), "spellings"), by, "left").join(_digest(own, by, amount, "amounts"), by, "left")
    room = F.greatest(F.lit(HIDDEN_BAND), F.col("most") * HIDDEN_SHARE)
    parts = [_flat(F.col(c)) for c in ("canonical", "account", "currency", "source", "import")]
    key = F.concat_ws("|", *parts, F.coalesce("spellings", F.lit("")), F.coalesce("amounts", F.lit("")))
    given = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return out.select(
        "subscription", "canonical", key.alias("scope_key"), *[given(c) for c in by[1:]], F.when(F.col("import") == "", None).otherwise(F.array("import")).alias("scope"),
        token_hints(F.col("canonical")).alias("required"), "n", F.coalesce("n_spellings", F.lit(0)).alias("n_spellings"), "n_amounts", "price",
        F.greatest(F.lit(0.0), F.col("least") - room).alias("low"), (F.col("most") + room).alias("high"), F.lit(True).alias("negative"), F.lit(HIDDEN).alias("priority"), F.lit(HIDDEN_CONFIDENCE).alias("confidence"),
    )


def _scoped(hidden: DataFrame, charges: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(""))
    own = charges.select("subscription", "merchant_raw", blank("account").alias("account"), F.upper(blank("currency")).alias("currency"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("import", F.lit("")).alias("import"), "amount")
    return own.join(hidden.select("subscription", "canonical"), "subscription").withColumn("_amount", F.abs("amount").cast("double"))


def hidden_spellings(hidden: DataFrame, charges: DataFrame) -> DataFrame:
    """Rows (subscription, account, currency, source, import, merchant_raw): the raw names that a hidden scope's rule takes; blanks for none."""
    return _scoped(hidden, charges).where("merchant_raw <> ''").select("subscription", "account", "currency", "source", "import", "merchant_raw").distinct()
