"""Identity of transactions: upsert, fuzzy duplicates, last writers (JN-01..12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens
from .matching import largest_overlaps

#: Days apart, and token similarity, of one charge seen twice.
FUZZY_DAYS, FUZZY_SIMILARITY = 2, 0.82


def last_writer(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each key (JN-09); nulls are keys, ties are broken by all of ``newest`` in turn."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest])
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def fuzzy_duplicates(left: DataFrame, right: DataFrame, text: str = "merchant", days: int = FUZZY_DAYS, similarity: float = FUZZY_SIMILARITY) -> DataFrame:
    """Pairs (left_id, right_id, days, similarity) of one account and amount within days (JN-04).

    Dates are cut into blocks of days + 1, so the join has an equality on the
    block too: a row meets its own block and the two beside it, each pair once.
    """
    block = F.floor(F.unix_date("date") / (days + 1))
    a = left.select(F.col("id").alias("left_id"), "account", "amount", F.col("date").alias("left_date"), tokens(F.col(text)).alias("left_tokens"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    b = right.select(F.col("id").alias("right_id"), "account", "amount", F.col("date").alias("right_date"), tokens(F.col(text)).alias("right_tokens"), block.alias("block"))
    pairs = a.join(b, ["account", "amount", "block"]).withColumn("days", F.abs(F.date_diff("left_date", "right_date")))
    pairs = pairs.withColumn("similarity", jaccard(F.col("left_tokens"), F.col("right_tokens")))
    return pairs.where((F.col("days") <= days) & (F.col("similarity") >= similarity)).select("left_id", "right_id", "days", F.round("similarity", 6).alias("similarity"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The stored rows with the incoming ones laid over them by key, and what became of each: ``outcome``.

    Outcomes are inserted, updated, unchanged and kept (not among the incoming,
    JN-01). Both frames hold a key once. A null incoming value keeps the stored one (JN-08).
    """
    a = stored.select(*keys, F.struct(*values).alias("old"))
    b = incoming.select(*keys, F.struct(*values).alias("new"))
    joined = a.join(b, keys, "full_outer")
    merged = [F.coalesce(F.col(f"new.{v}"), F.col(f"old.{v}")).alias(v) for v in values]
    same = F.lit(True)
    for v in values:
        same = same & F.coalesce(F.col(f"new.{v}"), F.col(f"old.{v}")).eqNullSafe(F.col(f"old.{v}"))
    outcome = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return joined.select(*keys, *merged, outcome.alias("outcome"))


def lookup(facts: DataFrame, dimension: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Facts with the dimension's columns, or their defaults where it has no row (JN-10, JN-12)."""
    marked = dimension.select(*keys, *defaults)
    return facts.join(marked, keys, "left").select(*facts.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


#: How an incoming row was found, in the order that counts.
WAYS = ("external", "pending", "reference", "pending_fuzzy", "duplicate")


def find_identities(drafts: DataFrame, identities: DataFrame, stored: DataFrame) -> DataFrame:
    """Per draft the stored transaction that it is, and how it was found (JN-02, JN-03, JN-06, JN-07); null for new ones.

    drafts and identities: source, account, external_id, pending_id, reference, fingerprint; drafts
    also draft, date, amount, merchant; identities also status and id (of a stored transaction);
    stored: id, source, account, date, amount, merchant. Manual drafts without external ids are
    found by reference and fingerprint alone. Five joins on keys, ranked; no nested scan. Only drafts
    that no key finds go into the fuzzy joins. Where identities hold ``identity``, so does the
    result: the row that led to the transaction, null for duplicates. Then a pending row that no key finds goes
    to one draft only, and drafts choose among them by their order, the least id first; else drafts don't compete.
    """
    named = ["identity"] if "identity" in identities.columns else []
    d = drafts.withColumn("account", F.coalesce("account", F.lit(""))).withColumn("_manual", (F.col("source") == "manualImport") & F.col("external_id").isNull() & F.col("pending_id").isNull())
    i = identities.select("source", F.coalesce("account", F.lit("")).alias("account"), *[F.col(c).alias(f"i_{c}") for c in ("external_id", "pending_id", "reference", "fingerprint", "status")], "id", *named)
    same = ["source", "account"]
    free = d.where("NOT _manual")
    found = [
        free.join(i, same).where("external_id = i_external_id"),
        free.join(i.select(*same, "id", *named, F.explode(F.array_compact(F.array("i_external_id", "i_pending_id"))).alias("_key")), same).where("pending_id = _key"),
        d.join(i, same).where("reference = i_reference AND fingerprint = i_fingerprint"),
    ]
    row = lambda df, k: df.select("draft", F.lit(k).alias("_way"), "id", *named)
    keyed = [row(df, k) for k, df in enumerate(found)]
    known = keyed[0].unionByName(keyed[1]).unionByName(keyed[2])
    left = free.join(known.select("draft"), "draft", "left_anti").select(F.col("draft").alias("id"), F.concat_ws("|", "source", "account").alias("account"), "date", "amount", "merchant", "external_id", "pending_id", "reference")
    right = stored.select("id", F.concat_ws("|", "source", F.coalesce("account", F.lit(""))).alias("account"), "date", "amount", "merchant")
    waiting = i.where("i_status = 'pending' OR i_pending_id IS NOT NULL")
    waiting = waiting.select("id", *named).distinct()
    fuzzy = lambda a, b: fuzzy_duplicates(a, b).select(F.col("left_id").alias("draft"), F.col("right_id").alias("id"))
    replaced = fuzzy(left.where("external_id IS NOT NULL"), right.join(waiting.select("id"), "id", "left_semi"))
    doubled = fuzzy(left.where("reference IS NULL AND (external_id IS NOT NULL OR pending_id IS NOT NULL)"), right)
    if named:
        rivals = replaced.join(waiting.join(known.select("identity"), "identity", "left_anti"), "id")
        replaced = largest_overlaps(rivals.select("draft", "identity", "id"), "draft", "identity", [F.col("draft"), F.col("id")])
        doubled = doubled.withColumn("identity", F.lit(None).cast(identities.schema["identity"].dataType))
    union = known.unionByName(row(replaced, 3)).unionByName(row(doubled, 4))
    best = union.groupBy("draft").agg(F.min(F.struct("_way", "id", *named)).alias("m"))
    way = F.get(F.array(*[F.lit(w) for w in WAYS]), F.col("m._way"))
    return drafts.select("draft").join(best, "draft", "left").select("draft", F.col("m.id").alias("id"), way.alias("way"), *[F.col(f"m.{c}").alias(c) for c in named])


def changed_fields(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, changed): the fields, in order, that an incoming row with a value would change (JN-08)."""
    new = incoming.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return stored.join(new, key).select(key, changed.alias("changed"))
