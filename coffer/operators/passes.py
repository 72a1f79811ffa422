"""The ordered detection passes over a ledger as one run (PIP-01, PIP-04..11).

Each pass takes the charges that earlier passes left, by an anti-join on their links, and
proposes clusters with a canonical name; a name that an earlier pass has taken is
not taken again. Links of each pass are checkpointed, so a pass is planned on
rows and not on the passes before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import FLAGS, flags
from ..plans.staging import staged
from .aggregates import mode, recovery_keys
from .clusters import candidate_clusters
from .histories import history_key
from .matching import largest_overlaps
from .replay import replay
from .rules import claims, matches
from .scoring import analysable, decisions, single_charges, snapshots

_LINK = {"canonical": "string", "disposition": "string", "rule": "string", "score": "double"}


def _links(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """Rows (id, pass, canonical, disposition, rule, score); what is not given is null."""
    return df.select("id", F.lit(name).alias("pass"), *[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _LINK.items()])


def _named(clusters: DataFrame, charges: DataFrame, group: str, previous: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds canonical, old to (group, bucket, part, id) rows: the name that most of a cluster's charges bore before, else the group's, or one of its own (RUL-08).

    A group's only cluster takes the group's name if no other has it; else a cluster is named by its first charge.
    """
    at = F.struct(group, "bucket", "part")
    rows = clusters.withColumn("at", at)
    before = rows.join(previous, "id").join(seen, F.col("owner") == F.col("canonical"), "left_anti")
    counts = before.groupBy("at", "owner").agg(F.count("*").alias("n"))
    kept = largest_overlaps(counts, "at", "owner", [F.col("at")[group], -F.col("n"), F.col("at")]).select("at", "owner")
    first = rows.join(charges.select("id", "date"), "id").groupBy("at", group).agg(F.min(F.struct("date", "id"))["id"].alias("first"))
    first = first.withColumn("alone", F.count("*").over(Window.partitionBy(group)) == 1)
    taken = previous.select(F.col("owner").alias("canonical")).union(seen.select("canonical")).distinct().select(F.col("canonical").alias("taken"))
    names = first.join(kept, "at", "left").join(taken, F.col(group) == F.col("taken"), "left")
    own = F.concat(F.col(group), F.lit(":history:"), F.col("first").cast("string"))
    canonical = F.coalesce("owner", F.when(F.col("alone") & F.col("taken").isNull(), F.col(group)).otherwise(own))
    return rows.join(names.select("at", canonical.alias("canonical")), "at").select("id", "canonical")


def _judged(charges: DataFrame, members: DataFrame, confirmed: DataFrame, fallback: bool) -> DataFrame:
    """Members with the score and disposition of their cluster; a cluster without a cadence is suppressed."""
    clustered = charges.drop("cluster").join(members.select("id", F.col("canonical").alias("cluster")), "id")
    marked = snapshots(clustered).join(confirmed.select(F.col("canonical").alias("cluster"), F.lit(True).alias("_confirmed")), "cluster", "left")
    scored = decisions(marked, F.coalesce("_confirmed", F.lit(False)), fallback=fallback, review_only=fallback)
    scored = scored.select(F.col("cluster").alias("canonical"), "disposition", F.round("score", 9).alias("score"))
    return members.join(scored, "canonical", "left").withColumn("disposition", F.coalesce("disposition", F.lit("suppressed")))


def _left(charges: DataFrame, links: list[DataFrame]) -> DataFrame:
    return charges.join(reduce(DataFrame.unionByName, links).select("id"), "id", "left_anti")


def _seen(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, links).select("canonical").where("canonical IS NOT NULL").distinct()


def run(charges: DataFrame, rules: DataFrame, previous: DataFrame, confirmed: DataFrame, ref: str) -> DataFrame:
    """One row per debit: id, pass, canonical, disposition, rule, score (PIP-04).

    ``charges`` are classified rows of a ledger with ids of their own; ``rules`` as in ``rules.matches``;
    ``previous`` (id, owner) holds the links of the run before; ``confirmed`` (canonical) what a user confirmed.
    The passes: negative rules (suppressed), histories by merchant (primary), looser
    groups for review only (fallback), positive rules (rule), and single recent charges
    (recent). Other debits have the pass none. What the words of a charge say is looked up once, for all passes.
    """
    debits = staged(flags(charges.where("amount < 0").drop("cluster", *FLAGS)))
    previous = staged(previous.where("owner IS NOT NULL").select("id", F.col("owner").cast("string").alias("owner")).dropDuplicates(["id"]))
    confirmed = staged(confirmed.select("canonical"))
    found = staged(matches(debits, rules))
    against = claims(found.where("negative"))
    links = [staged(_links(against, "suppressed", disposition=F.lit("suppressed"), rule=F.col("rule")))]

    live = _left(debits, links)
    ok = analysable(live.withColumn("cluster", F.col("merchant"))).select(F.col("cluster").alias("merchant"))
    ready = staged(history_key(live.join(ok, "merchant", "left_semi")))
    clusters = staged(candidate_clusters(ready, ["merchant", "bucket"]))
    members = staged(_named(clusters, ready, "merchant", previous, _seen(links)))
    links.append(staged(_taken(_judged(ready, members, confirmed, False), "primary")))

    rest = staged(recovery_keys(_left(debits, links)))
    ok = analysable(rest.withColumn("cluster", F.col("key"))).select(F.col("cluster").alias("key"))
    rest = staged(history_key(rest.join(ok, "key", "left_semi")))
    shown = mode(rest.withColumnsRenamed({"key": "k"}).withColumn("name", F.coalesce(F.nullif(F.trim("merchant"), F.lit("")), "merchant_raw")), "k", "name").select(F.col("k").alias("key"), "name")
    named = staged(rest.join(shown, "key").withColumn("group", F.col("name")).withColumn("bucket", F.concat_ws("|", "key", "bucket")))
    clusters = staged(candidate_clusters(named, ["group", "bucket"], "fallback"))
    members = staged(_named(clusters, named, "group", previous, _seen(links)))
    links.append(staged(_taken(_judged(named, members, confirmed, True), "fallback")))

    rest = staged(_left(debits, links))
    positive = found.where("NOT negative").join(rest.select("id"), "id", "left_semi")
    owned = reduce(DataFrame.unionByName, links).where("canonical IS NOT NULL").select("id", "canonical")
    replayed = replay(positive, rules, debits, owned, previous)
    links.append(staged(_links(replayed, "rule", canonical=F.col("name"), disposition=F.lit("detected"), rule=F.col("rule"))))

    rest = staged(_left(debits, links).withColumn("cluster", F.col("merchant")))
    single = single_charges(rest, ref).where("disposition <> 'suppressed'").join(_seen(links), F.col("cluster") == F.col("canonical"), "left_anti")
    links.append(staged(_links(single, "recent", canonical=F.col("cluster"), disposition=F.col("disposition"), score=F.round("score", 9))))

    return debits.select("id").join(reduce(DataFrame.unionByName, links), "id", "left").withColumns({"pass": F.coalesce("pass", F.lit("none")), "disposition": F.coalesce("disposition", F.lit("none"))})


def _taken(judged: DataFrame, name: str) -> DataFrame:
    return _links(judged.where("disposition <> 'suppressed'"), name, canonical=F.col("canonical"), disposition=F.col("disposition"), score=F.col("score"))
