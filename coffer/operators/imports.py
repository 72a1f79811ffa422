"""Imports laid over stored transactions and identities (JN-01, JN-06, JN-08), and the cache of classifications (CLS-09)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from ..plans.stores import Store
from .identity import find_identities

#: What an identity row holds beside its id, its transaction's id and when it was last seen.
KEYS = ["source", "account", "external_id", "pending_id", "reference", "fingerprint", "status"]


class Reconciled(NamedTuple):
    transactions: DataFrame
    identities: DataFrame
    outcomes: DataFrame


def _key(drafts: DataFrame) -> Column:
    """What makes two drafts of an import one charge: the external id, else the pending one, else reference and fingerprint."""
    text = lambda p, *c: F.concat(F.lit(p), *[F.col(x) for x in c])
    own = F.concat(F.lit("d"), F.col("draft").cast("string"))
    known = F.concat(F.lit("r"), F.col("reference"), F.lit("\n"), F.coalesce("fingerprint", F.lit("")))
    return F.coalesce(text("e", "external_id"), text("p", "pending_id"), known, own)


def reconciled(drafts: DataFrame, identities: DataFrame, stored: DataFrame, fields: list[str], seen: Column) -> Reconciled:
    """Stored transactions and identities after an import, and what became of each draft.

    drafts: ``draft`` (a new id, of the kind of the stored ones; drafts act in its order), the keys, date,
    amount, merchant and the fields; identities: ``identity``, the keys, id and ``seen``; stored: id and the fields, among them
    those that find_identities reads. A draft that is found takes its transaction over with every
    field, nulls included; columns beside the fields stay. One that is not found becomes a transaction under its own id. Drafts
    with one key are one charge: the first is looked up, the last one counts. An identity whose
    transaction is gone gets a new one. Outcomes: inserted, restored, updated, unchanged, or duplicate
    (found by likeness alone and nothing to change). Drafts of one import are not matched by likeness with each other; a
    pending row goes to the first draft that is like it and leaves others to be duplicates or new.
    """
    one = Window.partitionBy("source", F.coalesce("account", F.lit("")), "_key")
    d = drafts.withColumn("_key", _key(drafts)).withColumn("leader", F.min("draft").over(one)).drop("_key")
    found = find_identities(d.where("draft = leader"), identities, stored)
    d = d.join(found.select(F.col("draft").alias("leader"), F.col("id").alias("found"), "way", "identity"), "leader")
    d = d.withColumn("_at", F.coalesce("found", "leader"))  # an id that is not stored, rather than null, spreads over all tasks
    old = stored.select(F.col("id").alias("_at"), F.struct(*fields).alias("_old"))
    d = d.join(old, "_at", "left").withColumn("identity", F.coalesce("identity", "leader"))
    lost = F.col("found").isNotNull() & F.col("_old").isNull()
    d = d.withColumn("id", F.when(lost, F.min("leader").over(Window.partitionBy("identity"))).otherwise(F.col("_at")))
    turn = Window.partitionBy("id").orderBy("draft")
    new = F.struct(*fields)
    d = d.withColumns({"_turn": F.row_number().over(turn), "_before": F.lag(new).over(turn)})
    fresh = (F.col("_turn") == 1) & F.col("_old").isNull()
    same = new.eqNullSafe(F.when(F.col("_turn") == 1, F.col("_old")).otherwise(F.col("_before")))
    alike = F.coalesce((F.col("way") == "duplicate") & (F.col("draft") == F.col("leader")), F.lit(False))
    outcome = F.when(fresh & lost, "restored").when(fresh, "inserted").when(~same, "updated").when(alike, "duplicate").otherwise("unchanged")
    rows = staged(d.select(*drafts.columns, "id", "identity", "way", alike.alias("alike"), outcome.alias("outcome")))

    last = rows.groupBy("id").agg(F.max_by(F.struct(*fields), "draft").alias("_new"))
    taken = F.col("_new").isNotNull()
    merged = stored.join(last, "id", "full_outer").select(*[F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])
    names = rows.groupBy("identity").agg(F.max_by(F.struct(*KEYS, "id"), "draft").alias("_new"))
    kept = identities.join(names, "identity", "full_outer").select(
        "identity", *[F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in (*KEYS, "id")], F.when(taken, seen).otherwise(F.col("seen")).alias("seen")
    )
    return Reconciled(merged, kept, rows.select("draft", "id", "identity", "way", "alike", "outcome"))


def summary(outcomes: DataFrame) -> DataFrame:
    """One row: inserted, updated, unchanged, alike and reconciled drafts. A restored one counts as inserted and as unchanged."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    out = outcomes.agg(n("inserted", "restored").alias("inserted"), n("updated").alias("updated"), n("unchanged", "restored").alias("unchanged"), F.count_if("alike").alias("alike"))
    return out.withColumn("reconciled", F.col("inserted") + F.col("updated") + F.col("unchanged"))


def import_into(store: Store, drafts: DataFrame, fields: list[str], seen: Column) -> DataFrame:
    """Reconciles drafts with the store's ``transactions`` and ``identities`` in one commit, and returns the summary.

    The same drafts again (under new ids) change nothing but ``seen``, unless two of them were one identity, which
    knows the keys of the last one only. If anything fails, the store is as it was.
    """
    base = store.version()
    tables = store.tables(base)
    out = reconciled(drafts, tables["identities"], tables["transactions"], fields, seen)
    store.commit({"transactions": out.transactions, "identities": out.identities}, base)
    return summary(out.outcomes)


#: The version of classifications that may be used again, its age in days, and the least confidence.
CACHE_VERSION, CACHE_DAYS, CACHE_CONFIDENCE = 5, 180, 0.65
#: What a classification holds.
CLASSIFIED = ["canonical", "service_category", "kind", "affinity", "confidence"]


def usable(cache: DataFrame, now: Column) -> DataFrame:
    """Cached rows that may be used again: corrected by the user, or of this version, young, sure and with a category."""
    young = F.col("updated") >= now - F.expr(f"INTERVAL {CACHE_DAYS} DAYS")
    sure = (F.col("version") == CACHE_VERSION) & young & (F.col("confidence") >= CACHE_CONFIDENCE) & (F.col("service_category") != "Uncategorized")
    return cache.where(F.col("corrected") | F.coalesce(sure, F.lit(False)))


def reused(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Per request (merchant_raw, canonical) that the cache answers: the row used, a corrected one first, then one of its own raw name.

    Found by raw name and by canonical name, each by a join on its key; the best row of a
    canonical name is chosen before requests meet it, so a name with many spellings costs one row.
    """
    rows = usable(cache, now).withColumn("_rank", F.struct((~F.col("corrected")).alias("c"), F.col("merchant_raw").alias("m")))
    body = F.struct(F.col("merchant_raw").alias("cached_raw"), *CLASSIFIED)
    by_raw = rows.select("merchant_raw", F.struct(F.col("_rank.c").alias("c"), F.lit(0).alias("way"), body.alias("row")).alias("_r"))
    by_name = rows.groupBy("canonical").agg(F.min_by(body, "_rank").alias("row"), F.min("_rank.c").alias("c"))
    asked = requests.select("merchant_raw", F.col("canonical").alias("_name")).distinct()
    a = asked.join(by_raw, "merchant_raw")
    b = asked.join(by_name.withColumnRenamed("canonical", "_name"), "_name").withColumn("_r", F.struct("c", F.lit(1).alias("way"), F.col("row").alias("row")))
    both = a.select("merchant_raw", "_name", "_r").unionByName(b.select("merchant_raw", "_name", "_r"))
    best = both.groupBy("merchant_raw", "_name").agg(F.min_by("_r", F.struct("_r.c", "_r.way")).alias("_r"))
    return best.select("merchant_raw", F.col("_name").alias("asked"), "_r.row.*")


def cached(cache: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The cache with new results laid over it by raw name; ``corrected`` stays, and a result that is not ``current`` is given version 0.

    results: merchant_raw (once), what a classification holds, and current.
    """
    version = F.when(F.col("current"), CACHE_VERSION).otherwise(0)
    new = results.select("merchant_raw", F.struct(*CLASSIFIED, version.alias("version"), now.alias("updated")).alias("_new"))
    taken, held = F.col("_new").isNotNull(), [*CLASSIFIED, "version", "updated"]
    return cache.join(new, "merchant_raw", "full_outer").select(
        "merchant_raw", *[F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in held], F.coalesce("corrected", F.lit(False)).alias("corrected")
    )
