"""Queries that apply the ledger operators to the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import money, predicates, schedule, text
from .operators import aggregates, histories, identity, lifecycle
from .plans.staging import dealt
from .plans.views import billed, by_account, purchases, subscriptions, table, transactions
from .sources import decoding, statements, workbooks

#: The date that stands for today in these queries.
REF = "2001-09-01"
QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def agg_monthly_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.spend_by_period(transactions(spark, sf_dir), "month")


@query
def agg_yearly_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.spend_by_period(transactions(spark, sf_dir), "year")


@query
def agg_category_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.spend_by(transactions(spark, sf_dir), "category")


@query
def agg_run_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04: grand totals of the subscriptions with a known cadence."""
    known = subscriptions(spark, sf_dir).where("cadence <> 'unknown'")
    monthly = F.sum(money.per_month(F.col("cadence"), F.col("price")).cast("double"))
    return known.agg(F.count("*").alias("n"), F.round(monthly, 2).alias("monthly"), F.round(monthly * 12, 2).alias("yearly"))


@query
def agg_overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = subscriptions(spark, sf_dir).where("cadence <> 'unknown'")
    return aggregates.overlap_groups(known, money.per_month(F.col("cadence"), F.col("price")))


@query
def agg_mode_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mode(transactions(spark, sf_dir), "account", "category")


@query
def agg_upper_median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions(spark, sf_dir).select("account", "n", "median_gap")


@query
def agg_top_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.nth_smallest(billed(spark, sf_dir), ["account"], "amount", F.least(F.col("n") - 1, F.floor(F.col("n") * 3 / 4)), "threshold")


@query
def agg_price_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.latest_against_rest(billed(spark, sf_dir), "account", ["date", "id"], 0.05)


@query
def agg_first_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.first_last_change(billed(spark, sf_dir), "account", ["date", "id"], 0.03)


@query
def agg_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = F.timestamp_diff("MONTH", F.col("first_date").cast("timestamp"), F.col("last_date").cast("timestamp"))
    return subscriptions(spark, sf_dir).select("account", "first_date", "last_date", months.alias("months"))


@query
def agg_memo_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = transactions(spark, sf_dir).select("merchant", text.memo_shape(F.col("memo")).alias("shape"))
    return aggregates.distinct_share(dealt(shapes, table(spark, sf_dir, "lineitem").count(), "merchant", "shape"), "merchant", F.col("shape"))


@query
def agg_sorted_distinct_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_sample(transactions(spark, sf_dir), "account", "category", 3)


@query
def win_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.interval_days(billed(spark, sf_dir), ["account"], ["date", "id"]).select("id", "account", "gap")


@query
def win_price_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.price_steps(billed(spark, sf_dir), ["account"], ["date", "id"])
    return out.select("id", "account", F.round("step", 6).alias("step"))


@query
def win_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = billed(spark, sf_dir).withColumn("fingerprint", text.fingerprint(F.col("account"), F.trunc("date", "month")))
    return aggregates.ordinals(keyed, "fingerprint", ["date", "id"]).select("id", "fingerprint", "ordinal")


@query
def win_mom_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.period_change(agg_monthly_spend(spark, sf_dir))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by day, in whole tens, so that some agree."""
    return purchases(spark, sf_dir).select("id", "account", "merchant", F.to_date("ts").alias("date"), F.floor(F.col("amount") / 10).cast("int").alias("amount"))


@query
def jn_fuzzy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dated(spark, sf_dir).withColumn("merchant", F.concat(F.lit("shop "), F.substring("merchant", 1, 1)))
    return identity.fuzzy_duplicates(rows, rows).where("left_id < right_id")


@query
def jn_last_writer_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.last_writer(purchases(spark, sf_dir), ["account"], ["ts", "id"]).select("account", "id", "amount")


@query
def jn_fingerprint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = purchases(spark, sf_dir).select("id", "amount", "merchant")
    incoming = rows.where("id % 2 = 0").withColumn("amount", F.when(F.col("id") % 4 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)"))
    return identity.upsert(rows.where("id % 3 <> 0"), incoming, ["id"], ["amount", "merchant"])


@query
def jn_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("segment"))
    out = identity.lookup(purchases(spark, sf_dir), segments, ["account"], {"segment": "Uncategorized"})
    return out.groupBy("segment").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("amount"))


@query
def jn_semi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges of accounts that also purchased something."""
    return billed(spark, sf_dir).join(purchases(spark, sf_dir).select("account"), "account", "left_semi").select("id", "account")


@query
def set_except_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges that no subscription of a known cadence claims."""
    claimed = subscriptions(spark, sf_dir).where("cadence <> 'unknown'").select("account")
    return billed(spark, sf_dir).join(claimed, "account", "left_anti").select("id", "account", "date")


@query
def set_union_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-04: overlaps first, then price increases."""
    overlaps = agg_overlap_groups(spark, sf_dir).select(F.lit(0).alias("priority"), F.col("category").alias("key"))
    rises = agg_price_increase(spark, sf_dir).select(F.lit(1).alias("priority"), F.col("account").cast("string").alias("key"))
    return overlaps.unionByName(rises)


@query
def fn_normalize_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("POS "), F.col("p_brand"), F.lit("*"), F.col("p_name"), F.lit("/INTL 4411"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized_merchant(raw).alias("merchant"))


@query
def fn_parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written in four ways and read again."""
    v = F.col("value").cast("decimal(18,2)")
    us = F.format_number(v, 2)
    eu = F.translate(us, ",.", ".,")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("$"), us)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("("), us, F.lit(")"))).when(F.col("event_id") % 4 == 2, F.concat(eu, F.lit(" EUR"))).otherwise(F.concat(F.lit("ACH "), us))
    return table(spark, sf_dir, "events").select("event_id", money.parsed_amount(raw).alias("amount"))


@query
def fn_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in three ways and read again."""
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(d, "M.d.yy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", money.parsed_date(raw).alias("date"))


@query
def fn_monthly_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = money.per_month(F.col("cadence"), F.col("price")).cast("double")
    return subscriptions(spark, sf_dir).select("account", "cadence", F.round(monthly, 4).alias("monthly"))


@query
def fn_calendar_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, n: schedule.advanced(F.col("date"), F.lit(c), F.lit(n)).alias(f"{c}_{n}")
    return billed(spark, sf_dir).select("id", at("monthly", 1), at("quarterly", 2), at("annual", 1), at("biweekly", 3))


@query
def fn_month_end_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("date")
    return billed(spark, sf_dir).select("id", schedule.is_month_end(d).alias("at_end"), schedule.clamped_day(d, F.lit(31)).alias("day_31"), schedule.clamped_day(d, F.lit(30)).alias("day_30"))


@query
def pred_text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"movement": predicates.is_movement(), "bill": predicates.is_bill(), "noise": predicates.is_noise(), "keyword": predicates.has_keyword(), "excluded": predicates.is_excluded_category()}
    texts = ["memo", "category", "merchant_raw", "merchant"]
    rows = dealt(transactions(spark, sf_dir).select(*texts), table(spark, sf_dir, "lineitem").count(), *texts).groupBy(*texts).agg(F.count("*").alias("n"))
    return rows.select("n", *[v.alias(k) for k, v in flags.items()]).groupBy(*flags).agg(F.sum("n").alias("n"))


@query
def rec_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions(spark, sf_dir).select("account", "n", "median_gap", "cadence", "next_date")


@query
def rec_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent: tested on a fixture of known histories."""
    return histories.billing_histories(billed(spark, sf_dir), ["account"])


@query
def rec_amount_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent: compared with a plain loop in the tests."""
    return histories.amount_clusters(billed(spark, sf_dir), "account")


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which each account was seen."""
    days = dealt(transactions(spark, sf_dir).select("account", "date"), table(spark, sf_dir, "lineitem").count(), "account")
    return lifecycle.coverage(days, REF)


@query
def jn_range_missing_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.observed_missing(subscriptions(spark, sf_dir), _seen(spark, sf_dir), REF)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = subscriptions(spark, sf_dir)
    return lifecycle.lifecycle(subs, lifecycle.observed_missing(subs, _seen(spark, sf_dir), REF), REF)


@query
def lc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("account", "cadence", "state", "renews")


@query
def top_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-02: what renews within 90 days, the first twelve."""
    at = F.lit(REF).cast("date")
    soon = _states(spark, sf_dir).where((F.col("renews") >= at) & (F.col("renews") < F.date_add(at, 90)))
    return soon.select("account", "name", "renews").orderBy("renews", "name").limit(12)


@query
def qry_calendar_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-13: renewals by day of the month after the reference date."""
    at = F.trunc(F.add_months(F.lit(REF).cast("date"), 1), "month")
    due = _states(spark, sf_dir).where(F.trunc("renews", "month") == at)
    return due.groupBy("renews").agg(F.count("*").alias("n"), F.sum("price").cast("decimal(28,4)").alias("due"))


@query
def occ_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCC-06..08: three cycles from each subscription's first charge, and what came of them."""
    known = subscriptions(spark, sf_dir).where("cadence <> 'unknown'").select("account", "cadence", "first_date", "price", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cycle"))
    due = schedule.advanced(F.col("first_date"), F.col("cadence"), F.col("cycle"))
    tolerance = schedule.of_cadence(F.col("cadence"), "tolerance")
    expected = known.select("account", "cycle", "price", due.alias("expected"), F.date_sub(due, tolerance).alias("opens"), F.date_add(due, tolerance).alias("closes"))
    found = lifecycle.match_occurrences(expected, billed(spark, sf_dir))
    status = lifecycle.occurrence_status(F.col("price"), F.col("amount"), F.lit(0.9), F.col("closes") < F.lit(REF).cast("date"))
    return found.select("account", "cycle", "expected", "id", status.alias("status"))


@query
def page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-14: the newest hundred charges."""
    return billed(spark, sf_dir).orderBy(F.desc("date"), F.desc("id")).limit(100)


@query
def search_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-16: transactions with a text in one of four columns."""
    t = transactions(spark, sf_dir)
    hit = F.lit(False)
    for c in ("merchant_raw", "merchant", "category", "memo"):
        hit = hit | F.contains(text.folded(F.col(c)), F.lit("ring"))
    return t.where(hit).groupBy("memo").agg(F.count("*").alias("n"))


@query
def src_ofx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14..17: every order as a statement of its own, read again; odd orders leave their tags open."""
    close = F.when(F.col("o_orderkey") % 2 == 0, "</STMTTRN>").otherwise("")
    texts = table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("<OFX><STMTRS><CURDEF>USD<ACCTID>"), F.col("o_custkey").cast("string"), F.lit("<BANKTRANLIST><STMTTRN><DTPOSTED>"),
            F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000[0:GMT]<TRNAMT>-"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
            F.lit("<FITID>"), F.col("o_orderkey").cast("string"), F.lit("<MEMO>bill "), F.col("o_orderkey").cast("string"), close, F.lit("</BANKTRANLIST></STMTRS></OFX>"),
        ).alias("value")
    )
    return statements.ofx_transactions(texts).select("date", "amount", "merchant_raw", "account", "memo", "currency", "external_id")


@query
def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: every purchase as account JSON, read again; odd ones have the time of the transaction alone."""
    seconds = F.unix_timestamp("ts")
    odd = F.col("id") % 2 == 1
    transaction = F.struct(
        F.col("id").cast("string").alias("id"), F.when(odd, 0).otherwise(seconds).alias("posted"), seconds.alias("transacted_at"),
        F.col("amount").cast("string").alias("amount"), F.col("merchant").alias("payee"),
    )
    account = F.struct(F.col("account").cast("string").alias("id"), F.lit("").alias("name"), F.array(transaction).alias("transactions"))
    texts = purchases(spark, sf_dir).select(F.to_json(F.struct(F.array(account).alias("accounts"))).alias("value"))
    return statements.json_transactions(texts).select("date", "amount", "merchant_raw", "account", "external_id")


@query
def src_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04..06: every part's name as a table in one of seven encodings, its encoding found again."""
    k = F.col("p_partkey") % 8
    plain = F.concat(F.lit("date,note\n2025-01-02,"), "p_name", F.lit(" "))
    ends = {1: "E980", 2: "8F", 3: "C328"}  # single bytes: two letters of Windows, one that only the Mac has, and half a letter of UTF-8
    content = F.when(k == 0, F.encode(F.concat(plain, F.lit("é€\n")), "UTF-8"))
    for case, end in ends.items():
        content = content.when(k == case, F.concat(F.encode(plain, "UTF-8"), F.unhex(F.lit(end + "0A"))))
    for case, name in {4: "UTF-16", 5: "UTF-16LE", 6: "UTF-16BE"}.items():
        content = content.when(k == case, F.encode(F.concat(plain, F.lit("é€\n")), name))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), content.otherwise(F.encode("p_name", "UTF-8")).alias("content"))
    return decoding.decoded(files).select(F.col("path").cast("long").alias("p_partkey"), "encoding", "garbled", "text")


@query
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08, INF-03..10: every order as a file with quotes, mixed line ends and its own separators in texts, read again."""
    k = F.col("o_orderkey")
    end = F.when(k % 3 == 0, "\r\n").when(k % 3 == 1, "\r").otherwise(F.lit("\u2028"))
    text = F.concat(
        F.lit("Booking date;Payee;Amount;Memo"), end, F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(';"Customer; ""'), F.col("o_custkey").cast("string"),
        F.lit('""";-'), F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.", ","), F.lit(";\u0000bill "), k.cast("string"), end,
    )
    texts = table(spark, sf_dir, "orders").select(k.cast("string").alias("path"), text.alias("text"))
    mapping = statements.Mapping(";", "UTF-8", ("Booking date", "Payee", "Amount", "Memo"), _roles(date=0, merchant=1, amount=2, memo=3), True, False, 1.0)
    return statements.table_transactions(decoding.delimited_rows(texts, ";"), mapping).select("date", "amount", "merchant_raw", "memo")


@query
def src_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: orders as workbooks of at most 4,000 keys each, with cells left out, read again."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") / 4000).cast("int").alias("book"), "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_custkey")

    def books(frame):
        rows = [["Date", None, "Amount", "Merchant", "Memo"]]
        for r in frame.itertuples():
            rows.append([r.day, None if r.o_orderkey % 2 else "aside", -r.price, f"Customer {r.o_custkey}", None if r.o_orderkey % 3 == 0 else f"bill <{r.o_orderkey}>"])
        return pd.DataFrame({"path": [str(frame["book"].iloc[0])], "content": [workbooks.workbook(rows, shared=bool(frame["book"].iloc[0] % 2))]})

    files = orders.groupBy("book").applyInPandas(books, "path string, content binary")
    mapping = statements.Mapping("", "", ("Date", "", "Amount", "Merchant", "Memo"), _roles(date=0, amount=2, merchant=3, memo=4), False, False, 1.0)
    return statements.table_transactions(workbooks.sheet_rows(files), mapping).select("date", "amount", "merchant_raw", "memo")


def _roles(**places: int) -> tuple[tuple[str, int | None], ...]:
    return tuple((role, places.get(role)) for role in statements.KEYWORDS)
