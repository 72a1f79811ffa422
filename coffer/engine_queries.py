"""Queries of rules, identities, schedules, occurrences, classification and audit over the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detection_queries import REF as LEDGER_REF
from .functions import processors, schedule, text
from .functions.money import per_month
from .operators import aggregates, audit, classification, derived, histories, identity, imports, lifecycle, matching, passes, replay, rules, schedules, scoring, services
from .plans.staging import shared_folder, staged
from .plans.stores import Store
from .plans.views import MEMOS, billed, by_account, ledger, purchases, subscriptions, table
from .queries import REF, _states, query
from .sources import templates
from .sources.export import export


@query
def fn_unmask_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-14: part names behind every prefix."""
    prefixes = ["STRIPE*", "paypal *", "PP*", "GOOGLE *", "SQ *", "SP *", "GUMROAD*", "PADDLE.NET*", "FS *", "APPLE.COM/BILL ", "", "SHOP "]
    k = F.col("p_partkey")
    raw = F.concat(F.get(F.array(*[F.lit(p) for p in prefixes]), (k % 12).cast("int")), F.when(k % 5 == 0, "youtube_premium").when(k % 5 == 1, F.concat("p_name", F.lit(" aws"))).otherwise(F.col("p_name")))
    memo = F.get(F.array(*[F.lit(m) for m in MEMOS]), (F.floor(k / 12) % 10).cast("int"))
    out = table(spark, sf_dir, "part").select(k, processors.unmasked(raw, memo, F.lit(None).cast("string")).alias("u"))
    return out.select("p_partkey", "u.merchant", "u.is_processor", "u.hint", "u.boost")


@query
def cls_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-01, CLS-03, CLS-05, CLS-06: parts as merchants, by a small catalogue."""
    rows = [("ring", "Ring", "Security", "softwareOrSaaS", 0.9, 0.95), ("hot gear", "Hot Gear", "Sports", "generalRetail", 0.1, 0.9), ("gear", "Gear", "Tools", "generalRetail", 0.2, 0.8), ("blue", "Blue", "Music", "mediaStreaming", 0.97, 0.98), ("icloud", "iCloud", "Storage", "softwareOrSaaS", 0.96, 0.97)]
    brands = spark.createDataFrame(rows, "key string, name string, category string, kind string, affinity double, confidence double")
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("SQ *"), "p_name", F.lit(" "), k.cast("string")).alias("merchant_raw"), F.get(F.array(*[F.lit(m) for m in MEMOS]), (k % 10).cast("int")).alias("memo"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("p_type")).when(k % 4 == 2, "travel agency").alias("category"), (-(k % 500)).cast("decimal(18,4)").alias("amount"),
    )
    out = classification.classified(part, brands)
    return out.select("merchant_raw", "canonical", "service_category", "kind", F.round("affinity", 6).alias("affinity"), F.round("confidence", 6).alias("confidence"))


@query
def jn_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11: the charge with most text and the highest price of each merchant."""
    priority = F.length("memo") * 1000 + F.floor(F.abs("amount") / 1000)
    return classification.representatives(ledger(spark, sf_dir), priority, ["date", "id"]).select("merchant_raw", "id")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up rules for some merchants whose numbers have three digits or more, by a price, with or without its raw name."""
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").where((k % 20 < 2) & (k >= 100)).select(
        k.alias("rule"), F.concat(F.lit("Merchant "), k.cast("string")).alias("canonical"), (k % 40 == 0).alias("owns"), (k % 20 == 1).alias("negative"), (k % 7 * 100 + 500).alias("priority"),
        F.lit(None).cast("string").alias("account"), F.when(k % 3 == 0, "usd").when(k % 3 == 1, "").alias("currency"),
        F.when(k % 60 == 0, F.array(F.concat(F.lit("MERCHANT "), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("raw_merchants"),
        F.when(k % 5 == 0, F.array(F.lit("transfer"))).otherwise(F.array().cast("array<string>")).alias("excluded"), (100 + k % 50).alias("price"),
    )
    return rules.with_band(r).drop("price")


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("id", F.lit("main").alias("account"), F.when(F.col("id") % 9 == 0, "EUR").when(F.col("id") % 9 < 5, "USD").alias("currency"), "amount", "merchant_raw", "merchant", "memo", "category")


@query
def rul_history_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-08: suppliers as new groups and customers as old ones, by the line items that they share."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = lines.groupBy(F.col("l_suppkey").alias("cluster"), F.col("o_custkey").alias("owner")).agg(F.count("*").alias("n"))
    return matching.largest_overlaps(counts, "cluster", "owner", [-F.col("n"), F.col("cluster")]).select("cluster", "owner", "n")


@query
def rul_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-07: positive rules over orders of which some have an owner, and some had one before."""
    charges = ledger(spark, sf_dir).withColumns({"account": F.concat(F.lit("a"), (F.col("id") % 2).cast("string")), "currency": F.lit("USD")})
    c, k = F.col("cluster"), F.col("id")
    links = charges.where(k % 4 == 0).select("id", F.when(c % 3 == 0, F.concat(F.lit("Other "), c.cast("string"))).otherwise(F.col("merchant")).alias("canonical"))
    previous = charges.where(k % 5 == 0).select("id", F.when(c % 2 == 0, F.col("merchant")).otherwise("Other 1").alias("owner"))
    own = _rules(spark, sf_dir)
    found = rules.matches(charges, own).where("NOT negative").select("id", "rule")
    return replay.replay(found, own, charges, links, previous)


@query
def pip_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-04: the passes over all orders, with rules, links of an earlier run and names that a user confirmed."""
    charges = ledger(spark, sf_dir)
    charges = charges.withColumns({"account": F.concat(F.lit("a"), (F.col("id") % 2).cast("string")), "currency": F.lit("USD")})
    c = F.col("cluster")
    previous = charges.where(c % 11 < 3).select("id", F.when(c % 11 == 0, F.concat(F.lit("Service "), (c + F.col("id") % 2).cast("string"))).otherwise(F.col("merchant")).alias("owner"))
    confirmed = charges.where(c % 13 == 0).select(F.col("merchant").alias("canonical")).distinct()
    return passes.run(charges, _rules(spark, sf_dir), previous, confirmed, REF)


@query
def fn_token_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-02."""
    r = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("canonical"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 2 == 0).alias("negative"))
    return rules.with_band(r).select("p_partkey", F.array_join("required", ",").alias("required"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query
def jn_rule_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-03."""
    return rules.matches(_charges(spark, sf_dir), _rules(spark, sf_dir))


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Charges with marks and punctuation in their names, sources and imports, and rules by name or tokens in other spellings, some for a source or for imports."""
    k, c = F.col("id"), F.col("cluster")
    spelt = F.when(c % 4 == 0, F.concat(F.lit("Caf\u00e9 Zo\u00eb & Co. N"), c.cast("string"))).otherwise(F.concat(F.lit("Merchant-"), c.cast("string")))
    charges = ledger(spark, sf_dir).select(
        "id", F.lit("main").alias("account"), F.lit("USD").alias("currency"), "amount", F.upper(spelt).alias("merchant_raw"), spelt.alias("merchant"), "memo", "category",
        F.when(k % 3 == 0, "file").when(k % 3 == 1, "bank").alias("source"), F.when(k % 5 > 0, F.concat(F.lit("i"), (k % 5).cast("string"))).alias("import"),
    )
    k = F.col("c_custkey")
    text = lambda v: F.concat(F.lit(v), k.cast("string"))
    r = table(spark, sf_dir, "customer").where(k % 10 < 3).select(
        k.alias("rule"), F.when(k % 4 == 0, F.when(k % 8 == 0, text("cafe zoe co n")).otherwise(text("CAF\u00c9 ZO\u00cb & CO. N"))).otherwise(text("merchant ")).alias("canonical"),
        (k % 20 == 0).alias("owns"), (k % 10 == 1).alias("negative"), (k % 7).alias("priority"), F.lit(None).cast("string").alias("account"), F.lit("").alias("currency"), F.array().cast("array<string>").alias("raw_merchants"),
        F.when(k % 4 > 0, F.array(F.lit("MERCH\u00c4NT"), k.cast("string"))).otherwise(F.array().cast("array<string>")).alias("required"), F.when(k % 3 == 0, F.array(F.lit("r\u00e9fund"))).alias("excluded"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.when(k % 6 == 0, "file").alias("source"), F.when(k % 9 == 0, F.array(F.lit("i1"), F.lit("i2"))).alias("scope"),
    )
    return charges, r


@query
def jn_rule_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-03, PRD-17: names in other spellings, sources and imports."""
    return rules.matches(*_scoped(spark, sf_dir))


@query
def jn_rule_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-04."""
    return rules.claims(rules.matches(_charges(spark, sf_dir), _rules(spark, sf_dir))).select("id", "rule", "negative")


@query
def jn_anti_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-05."""
    charges = _charges(spark, sf_dir)
    return rules.unsuppressed(charges, rules.claims(rules.matches(charges, _rules(spark, sf_dir)))).select("id")


@query
def agg_band_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-12."""
    out = rules.band_scores(rules.matches(_charges(spark, sf_dir), _rules(spark, sf_dir)))
    return out.select("rule", "n", F.round("band_score", 6).alias("band_score"))


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with names of which some differ by one word."""
    k = F.col("id")
    name = F.concat(F.lit("north side shop store "), (F.col("merchant").cast("int") % 3).cast("string"), F.when(k % 2 == 0, " ltd").otherwise(""))
    return purchases(spark, sf_dir).select(k, F.lit("simpleFIN").alias("source"), F.concat(F.lit("a"), F.col("account").cast("string")).alias("account"), F.to_date("ts").alias("date"), F.floor(F.col("amount") / 10).cast("int").alias("amount"), name.alias("merchant"))


@query
def jn_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02, JN-03, JN-06, JN-07: every stored row comes again, known by less and less."""
    stored, k = _bank(spark, sf_dir), F.col("id")
    text_id = lambda p: F.concat(F.lit(p), k.cast("string"))
    known = stored.select("source", "account", text_id("e").alias("external_id"), F.when(k % 5 == 0, text_id("p")).alias("pending_id"), text_id("r").alias("reference"), text_id("f").alias("fingerprint"), F.when(k % 7 == 0, "pending").otherwise("posted").alias("status"), k)
    case = F.floor(k / 10) % 6
    drafts = stored.select(
        (k + 1_000_000_000).alias("draft"), F.when(case == 5, "manualImport").otherwise(F.col("source")).alias("source"), "account",
        F.when(case == 0, text_id("e")).when(case.isin(3, 4), text_id("x")).alias("external_id"), F.when(case == 1, text_id("p")).alias("pending_id"),
        F.when(case.isin(2, 5), text_id("r")).when(case == 3, text_id("y")).alias("reference"), text_id("f").alias("fingerprint"), F.date_add("date", 1).alias("date"), "amount", "merchant",
    )
    return identity.find_identities(drafts, known, stored)


@query
def jn_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08."""
    stored, k = _bank(spark, sf_dir), F.col("id")
    new = stored.select(k, F.when(k % 3 == 0, F.date_add("date", 1)).otherwise(F.col("date")).alias("date"), F.when(k % 4 == 0, None).when(k % 4 == 1, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"), "merchant")
    return identity.changed_fields(stored, new, "id", ["date", "amount", "merchant"]).select("id", F.array_join("changed", ",").alias("changed"))


@query
def jn_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05: names of parts against their brands and types."""
    a, b = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", F.lit("small blue"), "p_type", F.lit("ring"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.jaccard(text.tokens(a), text.tokens(b)), 6).alias("similarity"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules with the cadences of the subscriptions; the regular merchants of the ledger view among them."""
    charges = ledger(spark, sf_dir).select(F.col("cluster").alias("account"), "date")
    cadence = F.get(F.array(*[F.lit(c) for c in ("monthly", "weekly", "biweekly", "quarterly", "semiannual", "annual")]), (F.floor(F.col("account") / 2) % 6).cast("int"))
    return schedules.schedules(charges).withColumn("cadence", cadence)


@query
def sch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCH-01, AGG-15, AGG-16."""
    return schedules.schedules(billed(spark, sf_dir))


@query
def sch_dates_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCH-04."""
    return schedules.dates_between(_known(spark, sf_dir), F.lit("1998-03-01").cast("date"), F.lit("1998-06-30").cast("date"))


@query
def fn_nearest_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCH-02, SCH-03."""
    at = billed(spark, sf_dir).select("id", "account", "date").join(_known(spark, sf_dir), "account")
    found = schedule.nearest_cycle(F.col("date"), F.col("anchor"), F.col("anchor_day"), F.col("month_end"), F.col("cadence"))
    return at.select("id", found["cycle"].alias("cycle"), found["distance"].alias("distance"))


@query
def fn_cycle_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-25."""
    parts = schedule.cycle_progress(F.col("last_date"), F.col("next_date"), F.lit(REF).cast("date"))
    known = subscriptions(spark, sf_dir).where("cadence <> 'unknown'")
    return known.select("account", *[F.round(c, 6).alias(k) if k == "fraction" else c.alias(k) for k, c in parts.items()])


def _regular(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schedules with next_date, charges without every fifth one, missing cycles) of the ledger view."""
    charges = ledger(spark, sf_dir).where("id % 5 <> 0").select(F.col("cluster").alias("account"), "id", "date", F.abs("amount").alias("amount"))
    cadence = F.get(F.array(*[F.lit(c) for c in ("monthly", "weekly", "biweekly", "quarterly", "semiannual", "annual")]), (F.floor(F.col("account") / 2) % 6).cast("int"))
    last = charges.groupBy("account").agg(F.max("date").alias("last_date"))
    known = schedules.schedules(charges).withColumn("cadence", cadence).join(last, "account")
    known = known.withColumn("next_date", F.when(F.col("account") % 4 < 2, schedule.advanced(F.col("last_date"), F.col("cadence"), F.lit(1))))
    known = staged(known)  # a row for each account, which all that follows reads several times
    seen = lifecycle.coverage(by_account(spark, sf_dir), LEDGER_REF)
    return known, charges, staged(schedules.missing_cycles(known, seen, LEDGER_REF))


@query
def occ_missing_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCC-01..04: every cycle, gaps between charges included."""
    return _regular(spark, sf_dir)[2]


@query
def occ_expected_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCC-06: cycles of charges, missing ones, and the next one."""
    known, charges, missing = _regular(spark, sf_dir)
    return schedules.expected_cycles(known, charges, missing)


@query
def occ_status_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCC-07, OCC-08, OCC-12: what came of every expected cycle."""
    known, charges, missing = _regular(spark, sf_dir)
    expected = schedules.expected_cycles(known, charges, missing).join(known.select("account", "cadence"), "account")
    tolerance = schedule.of_cadence(F.col("cadence"), "tolerance")
    expected = expected.select("account", "cycle", "expected", (100 + F.col("account") % 50).cast("decimal(18,4)").alias("price"), F.date_sub("expected", tolerance).alias("opens"), F.date_add("expected", tolerance).alias("closes"))
    found = lifecycle.match_occurrences(staged(expected), charges)
    sure = F.when(F.col("account") % 4 < 2, 0.9).otherwise(0.5)
    status = lifecycle.occurrence_status(F.col("price"), F.col("amount"), sure, F.col("closes") < F.lit(LEDGER_REF).cast("date"))
    return found.select("account", "cycle", "expected", "id", status.alias("status"), F.round(schedules.amount_delta(F.col("price"), F.col("amount")), 6).alias("delta"))


@query
def occ_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCC-10."""
    return schedules.expectations(_known(spark, sf_dir), ledger(spark, sf_dir).select(F.col("cluster").alias("account"), "date"))


@query
def occ_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCC-11: missing cycles before 1995 were known before."""
    known, _, missing = _regular(spark, sf_dir)
    subs = known.select("account", ((F.col("account") % 10) / 10).cast("double").alias("confidence"))
    out = schedules.decayed(subs, missing.withColumn("status", F.lit("missed")), missing.where("expected < DATE '1995-01-01'"))
    return out.select("account", "newly_missed", F.round("confidence", 6).alias("confidence"))


@query
def win_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03."""
    rows = billed(spark, sf_dir).withColumn("matched", F.when(F.col("id") % 3 == 0, F.col("amount")))
    return aggregates.carried(rows, ["account"], ["date", "id"], "matched").select("id", "account", F.col("carried").alias("expected_amount"))


@query
def win_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04."""
    return aggregates.first_rows(billed(spark, sf_dir), ["account"], ["date", "id"]).select("account", "id", "date")


@query
def agg_import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17, AGG-20: months of orders as imports."""
    rows = ledger(spark, sf_dir).select(F.trunc("date", "month").alias("import"), "id", "cluster", "memo", "amount", "confidence")
    return aggregates.import_report(rows)


@query
def rec_recovery_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-17."""
    return aggregates.recovery_groups(ledger(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions with state, renewal, monthly price, confidence, change and tenure."""
    prices = aggregates.first_last_change(by_account(spark, sf_dir), "account", ["date", "id"], 0.0).select("account", F.col("first").alias("first_price"), "change")
    rise = aggregates.latest_against_rest(by_account(spark, sf_dir), "account", ["date", "id"], 0.05).select("account", "rise")
    months = F.timestamp_diff("MONTH", F.col("first_date").cast("timestamp"), F.col("last_date").cast("timestamp"))
    out = _states(spark, sf_dir).join(prices, "account", "left").join(rise, "account", "left")
    return out.withColumns({"months": months, "confidence": ((F.col("account") * 13 % 100) / 100).cast("double"), "monthly": F.round(per_month(F.col("cadence"), F.col("price")).cast("double"), 4)})


@query
def qry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-09, AGG-21: every fifth subscription has no category."""
    subs = _judged(spark, sf_dir).withColumn("category", F.when(F.col("account") % 5 > 0, F.concat("category", (F.col("account") % 200).cast("string"))))
    return audit.audit(subs).select("account", "points", "action")


@query
def qry_act_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-05."""
    subs = _judged(spark, sf_dir)
    overlaps = aggregates.overlap_groups(subs.where("account % 3 = 0 AND category < 'F'"), F.col("monthly"))
    return audit.act_now(subs, overlaps, REF)


@query
def qry_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-08."""
    return audit.review_queue(_judged(spark, sf_dir))


@query
def qry_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-11."""
    return audit.list_counts(_judged(spark, sf_dir))


@query
def qry_annual_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-12."""
    return audit.annual_list(_judged(spark, sf_dir))


@query
def qry_price_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-06: the greatest rises first."""
    return aggregates.latest_against_rest(billed(spark, sf_dir), "account", ["date", "id"], 0.05).select("account", "rise").orderBy(F.desc("rise"), "account")


@query
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-14: how many charges there are, how many match, and when the newest of these was."""
    matched = F.col("amount") >= 100_000
    return billed(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(matched).alias("matched"), F.max(F.when(matched, F.col("date"))).alias("newest"))


@query
def rec_bucket_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-01."""
    charges = ledger(spark, sf_dir).withColumns({"account": F.col("cluster") % 3, "currency": F.when(F.col("id") % 2 == 0, "usd")})
    return histories.history_key(charges).groupBy("bucket").agg(F.count("*").alias("n"))


@query
def rec_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REC-13, REC-14: every subscription's gaps against every cadence."""
    charges = billed(spark, sf_dir)
    gaps = aggregates.interval_days(charges, ["account"], ["date", "id"]).where("gap IS NOT NULL").groupBy(F.col("account").alias("cluster"), "gap").agg(F.count("*").alias("c"))
    each = gaps.select("*", F.explode(F.array(*[F.lit(c) for c in scoring.GAP_ORDER])).alias("tried"))
    out = scoring.consistencies(each, F.col("tried"))
    return out.select("cluster", "cadence", "all_fit", "some_direct", F.round("consistency", 6).alias("consistency"))


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as services, each with its name and the first four letters of it as aliases."""
    plain = services.normalized(F.col("n_name"))
    service = F.concat(F.lit("brand-"), F.translate(F.lower("n_name"), " ", "-"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry"), service.alias("service"), F.explode(F.array(plain, F.substring(plain, 1, 4))).alias("alias"))


def _nationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), "n_name")


@query
def qry_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-22: customers named after nations, with and without an identifier."""
    k, name = F.col("k"), F.col("n_name")
    names = _nationals(spark, sf_dir).select(
        k, F.when(k % 4 == 0, F.concat(F.lit("brand-"), F.translate(F.lower(name), " ", "-"))).when(k % 4 == 1, " ").alias("identifier"),
        F.when(k % 3 == 0, F.concat(F.lit("Shop of "), name)).when(k % 3 == 1, "zz").alias("canonical"),
        F.when(k % 5 == 0, F.concat(name, F.lit(" "), k.cast("string"))).when(k % 10 == 6, F.substring(name, 1, 4)).when(k % 5 == 1, F.concat(F.substring(name, 1, 4), F.lit(" co"))).when(k % 5 == 2, F.lower(name)).otherwise("none").alias("display"),
    )
    return services.resolved(names, _services(spark, sf_dir)).select("k", "service")


@query
def qry_service_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-23: parts of nations' names as queries, some with a word behind."""
    k = F.col("k")
    part = F.substring(F.col("n_name"), (1 + k % 4).cast("int"), (2 + k % 9).cast("int"))
    return services.search(_nationals(spark, sf_dir).select(F.concat(part, F.when(k % 7 == 0, " Inc").otherwise("")).alias("query")), _services(spark, sf_dir))


def _imported(spark: SparkSession, sf_dir: str) -> imports.Reconciled:
    """Every stored purchase comes again, known by less and less, and every eleventh one twice in the import; some identities have lost theirs."""
    bank, k = _bank(spark, sf_dir), F.col("id")
    text_id = lambda p: F.concat(F.lit(p), k.cast("string"))
    stored = bank.where(k % 13 > 0).withColumn("memo", F.lit("first"))
    known = bank.select((k + 5_000_000_000).alias("identity"), "source", "account", text_id("e").alias("external_id"), F.when(k % 5 == 0, text_id("p")).alias("pending_id"), text_id("r").alias("reference"), text_id("f").alias("fingerprint"), F.when(k % 7 == 0, "pending").otherwise("posted").alias("status"), k, F.lit("2001-08-01").cast("date").alias("seen"))
    case = F.floor(k / 10) % 6
    drafts = bank.withColumn("turn", F.explode(F.when(k % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        (k + F.col("turn") * 1_000_000_000).alias("draft"), F.when(case == 5, "manualImport").otherwise(F.col("source")).alias("source"), "account",
        F.when(case == 0, text_id("e")).when(case.isin(3, 4), text_id("x")).alias("external_id"), F.when(case == 1, text_id("p")).alias("pending_id"), F.when(case.isin(2, 5), text_id("r")).when(case == 3, text_id("y")).alias("reference"),
        text_id("f").alias("fingerprint"), F.lit("posted").alias("status"), F.date_add("date", (k % 2).cast("int")).alias("date"), "amount", "merchant",
        F.when((F.col("turn") == 1) & (k % 4 > 0), "first").when(k % 3 > 0, "again").alias("memo"),
    )
    return imports.reconciled(drafts, known, stored, ["source", "account", "date", "amount", "merchant", "memo"], F.lit(REF).cast("date"))


@query
def jn_import_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01, JN-06, JN-08: the stored transactions after an import."""
    return _imported(spark, sf_dir).transactions.select("id", "source", "account", "date", "amount", "merchant", "memo")


@query
def jn_import_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01: the identities after an import."""
    return _imported(spark, sf_dir).identities


@query
def jn_import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01: how many drafts were inserted, updated, unchanged and alike."""
    return imports.summary(_imported(spark, sf_dir).outcomes)


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as classified merchants, of which some are corrected, some old and some unsure."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("RAW "), k.cast("string")).alias("merchant_raw"), F.col("p_brand").alias("canonical"), F.when(k % 6 == 0, "Uncategorized").otherwise(F.col("p_type")).alias("service_category"), F.lit("unknown").alias("kind"),
        (k % 10 / 10).cast("double").alias("affinity"), (k % 8 / 8).cast("double").alias("confidence"), F.when(k % 3 == 0, 4).otherwise(5).alias("version"),
        (F.lit(REF).cast("timestamp") - F.make_dt_interval((k % 300).cast("int"))).alias("updated"), (k % 17 == 0).alias("corrected"),
    )


@query
def cls_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-09, JN-10: line items' parts as requests, by raw names of which some are new, and by brands and other names."""
    k = F.col("l_partkey")
    asked = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), k == F.col("p_partkey")).select(
        F.concat(F.when(k % 2 == 0, "RAW ").otherwise("NEW "), k.cast("string")).alias("merchant_raw"), F.when(k % 5 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("canonical")
    )
    out = imports.reused(asked, _cache(spark, sf_dir), F.lit(REF).cast("timestamp"))
    return out.select("merchant_raw", "asked", "cached_raw", "canonical", "service_category", "confidence")


@query
def cls_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-09: suppliers and every other part as new results."""
    cache = _cache(spark, sf_dir)
    k = F.col("s_suppkey")
    result = lambda df, name, current: df.select(name.alias("merchant_raw"), F.lit("New").alias("canonical"), F.lit("Film").alias("service_category"), F.lit("mediaStreaming").alias("kind"), F.lit(0.5).alias("affinity"), F.lit(0.75).alias("confidence"), current.alias("current"))
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == 0)
    both = result(part, F.concat(F.lit("RAW "), F.col("p_partkey").cast("string")), F.col("p_partkey") % 4 == 0).unionByName(result(table(spark, sf_dir, "supplier"), F.col("s_name"), k % 2 == 0))
    out = imports.cached(cache, both, F.lit(REF).cast("timestamp"))
    return out.select("merchant_raw", "canonical", "service_category", "confidence", "version", F.to_date("updated").alias("updated"), "corrected")


@query
def rul_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-01: customers as names with corrections, reviews, subscriptions and rules of an earlier look."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Merchant "), k.cast("string"))
    spelt = F.when(k % 8 == 0, F.upper(name)).otherwise(name)
    corrections = c.where(k % 3 == 0).select(k.alias("id"), name.alias("canonical"), (k % 6 == 3).alias("is_subscription"))
    reviews = c.where(k % 4 < 3).select(
        k.alias("id"), spelt.alias("canonical"), (k % 4 == 0).alias("false_positive"), (k % 5 == 0).alias("confirmed"), F.when(k % 7 == 0, (k % 90).cast("double")).alias("price"),
        F.when(k % 7 == 0, F.when(k % 2 == 0, " EUR ").otherwise("")).alias("currency"), F.when(k % 11 == 0, "monthly").alias("cadence"), F.lit(None).cast("string").alias("status"),
    )
    own = c.where(k % 2 == 0).select(k.alias("id"), name.alias("canonical"), (k % 10 == 0).alias("confirmed"), (k % 10 == 2).alias("manual"), (k % 100).cast("double").alias("price"), F.lit("USD").alias("currency"), (k % 10 / 10).cast("double").alias("score"))
    charges = ledger(spark, sf_dir).select("merchant", F.when(F.col("id") % 3 == 0, F.lower("merchant_raw")).otherwise(F.col("merchant_raw")).alias("merchant_raw"))
    origin = F.when(k % 3 == 0, "userCorrection").otherwise("reviewRule")
    earlier = c.where(k % 5 < 2).select(
        F.concat_ws("|", F.lower(name), F.when(k % 2 == 0, "negative").otherwise("positive"), origin).alias("_key"), name.alias("canonical"), (k % 2 == 0).alias("negative"), origin.alias("origin"), (k + 1000).alias("subscription"),
        F.lit(1.0).alias("price"), F.lit("GBP").alias("currency"), F.lit(0.5).alias("confidence"), F.lit(1).alias("priority"), F.array(F.lit("OLD")).alias("raw_merchants"), F.array(F.lit("old")).alias("required"), F.lit(0.0).alias("low"), F.lit(2.0).alias("high"),
    )
    out = derived.derived_rules(earlier, corrections, reviews, own, charges)
    return out.select(F.col("_key").alias("rule_key"), *derived.RULE, F.array_join("raw_merchants", ",").alias("raw_merchants"), F.array_join("required", ",").alias("required"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "outcome")


def _hidden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers of whom every third is hidden, and their orders in accounts, currencies, sources and imports."""
    k = F.col("id")
    charges = ledger(spark, sf_dir).select(
        F.col("cluster").alias("subscription"), F.when(k % 3 == 0, F.lower("merchant_raw")).otherwise(F.col("merchant_raw")).alias("merchant_raw"), F.when(k % 2 == 0, "main").otherwise(" ").alias("account"),
        F.when(k % 9 == 0, "eur").when(k % 9 < 5, "USD").alias("currency"), F.when(k % 4 == 0, "file").otherwise("bank").alias("source"), F.when(k % 5 == 0, "i1").alias("import"), "amount",
    )
    names = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 1)
    return names.select(F.col("c_custkey").alias("subscription"), F.concat(F.lit("Merchant "), F.col("c_custkey").cast("string")).alias("canonical")), charges


@query
def rul_hidden_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-15: a negative rule for each scope of each hidden customer."""
    out = derived.hidden_rules(*_hidden(spark, sf_dir))
    return out.select("subscription", "scope_key", "account", "currency", "source", F.array_join("scope", ",").alias("scope"), F.array_join("required", ",").alias("required"), "n", "n_spellings", "n_amounts", "price", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "priority")


@query
def rul_hidden_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-15: the raw names of the scopes."""
    return derived.hidden_spellings(*_hidden(spark, sf_dir))


@query
def snk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-02: some columns of orders and customers as one document, and how often each of its lines stands in it."""
    path = f"{shared_folder(spark)}/coffer-export-{uuid4().hex}.json"
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("memo"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") / 4).alias("share"), (F.col("c_custkey") % 2 == 0).alias("active"))
    export(spark, {"transactions": (orders, ["id"]), "accounts": (customers, ["id"])}, path, exportedAt="2001-09-01T00:00:00Z")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def snk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, SNK-04: orders and customers in a store, orders replaced by a later commit, then read by version."""
    store = Store(spark, f"{shared_folder(spark)}/coffer-store-{uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account"))
    store.commit({"transactions": orders, "accounts": table(spark, sf_dir, "customer").select("c_custkey")}, 0)
    store.commit({"transactions": store.tables()["transactions"].where("id % 2 = 0").withColumn("account", F.col("account") + 1)}, 1)
    store.clear(keep=("accounts",))
    rows = [df.select(F.lit(v).alias("version"), F.lit(n).alias("name"), F.col(df.columns[0]).alias("id"), F.col(df.columns[-1]).alias("last")) for v in store.versions() for n, df in sorted(store.tables(v).items())]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out.groupBy("version", "name").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("last").alias("last"))


_HEADERS = ["Date", "Text", "Sum", "Shop", "Kind"]


@query
def inf_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-11: orders as files with headers, suppliers as templates."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    names = lambda key: [F.when(key % p > 0, F.lit(h)) for h, p in zip(_HEADERS, (7, 2, 11, 3, 5))]
    none = [F.lit(None).cast("string").alias(r) for r in templates.ROLES[5:]]
    files = table(spark, sf_dir, "orders").select(
        k.alias("file"), F.reverse(F.array_compact(F.array(*names(k)))).alias("headers"), F.lit("own").alias("date"), *[F.lit(None).cast("string").alias(r) for r in templates.ROLES[1:]], F.when(k % 4 < 2, "positive").otherwise("negative").alias("sign"), F.lit(0.5).alias("confidence")
    )
    known = table(spark, sf_dir, "supplier").select(s.alias("template"), (s % 13).alias("created"), *[n.alias(r) for n, r in zip(names(s), templates.ROLES)], *none, F.when(s % 2 == 0, "positive").otherwise("negative").alias("sign"))
    return templates.with_template(files, known).select("file", "template", "date", "description", "amount", "merchant", "category", "sign", "confidence")


@query
def inf_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-12: suppliers' line items as files of statement rows."""
    s, k = F.col("l_suppkey"), F.col("l_orderkey")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem").select(
        s.alias("file"), F.struct("l_orderkey", "l_linenumber").alias("row"), F.when(k % 6 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.when(k % 7 == 0, None).otherwise(F.concat(F.when((k % 10 < s % 10), "-").otherwise(""), amount.cast("string"))).alias("amount"), F.when((k % 5 > 0) & (s % 8 > 0), F.col("l_returnflag")).alias("merchant"), F.when(s % 2 == 0, "positive").otherwise("negative").alias("sign"),
    )
    out = templates.previews(rows)
    return out.withColumn("warnings", F.array_join("warnings", ","))
