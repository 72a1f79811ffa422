"""Positive rules replayed over what detection left, in their order and with guards for owners (RUL-06, RUL-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged, stored

#: Marks the name of an owner that is one history among several of its merchant.
HISTORY = ":history:"


def _currency() -> Column:
    return F.coalesce(F.upper("currency"), F.lit("USD"))


def allowed(asked: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows of ``asked`` (id, rule, name, owner, account, cur, m) that no guard forbids, with these owners' charges (canonical, account, cur, m).

    A name that owns no charge yet takes all that its rule matches. An owner that is one history takes back its own charges
    alone. Any other takes charges of an account that it is charged to: its own from before, and
    those without an owner if no other owner has charges of that merchant, account and currency.
    """
    names = owned.select(F.col("canonical").alias("l_name"), F.lit(True).alias("alive")).distinct()
    accounts = owned.select(F.col("canonical").alias("a_name"), F.col("account").alias("a_account"), F.lit(True).alias("same")).distinct()
    # Who owns charges of a merchant in an account: one name, or several.
    siblings = owned.groupBy(F.col("m").alias("s_name"), F.col("account").alias("s_account"), F.col("cur").alias("s_cur")).agg(F.min("canonical").alias("s_least"), F.max("canonical").alias("s_most"))
    out = asked.join(names, F.col("name") == F.col("l_name"), "left")
    out = out.join(accounts, (F.col("name") == F.col("a_name")) & F.col("account").eqNullSafe(F.col("a_account")), "left")
    out = out.join(siblings, (F.lower("name") == F.col("s_name")) & F.col("account").eqNullSafe(F.col("s_account")) & (F.col("cur") == F.col("s_cur")), "left")
    mine = F.coalesce(F.col("owner") == F.col("name"), F.lit(False))
    other = F.coalesce((F.col("s_least") != F.col("name")) | (F.col("s_most") != F.col("name")), F.lit(False))
    free = F.col("same").isNotNull() & (mine | (F.col("owner").isNull() & ~other))
    may = F.when(F.col("alive").isNull(), F.lit(True)).when(F.contains("name", F.lit(HISTORY)), mine).otherwise(free)
    return out.where(may).select(*asked.columns)


def replay(found: DataFrame, rules: DataFrame, charges: DataFrame, links: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows (id, rule, name): the charges that each rule takes when the rules act one after the other, by falling priority, then by rule.

    ``found`` (id, rule) are the positive matches of charges that may still be linked; ``rules`` has rule, canonical and priority,
    ``charges`` id, account, currency and merchant, ``links`` (id, canonical) what has
    an owner already, ``previous`` (id, owner) the owners of the run before.

    What a rule does depends on earlier ones only through names: of its owner, of
    the merchants whose charges it matches, and of the merchant that it is named after. So all
    rules act at once that come first for each of their names; then these leave, and the next ones
    come. As many rounds as the longest chain of rules that share names. Null ids and rules take no part.
    The given frames are read before the first round alone: a round reads the matches
    of the rules that still wait, and one row for each owner, merchant, account and currency that a rule names. What a round
    takes is stored, so that Spark's estimate of the owners' size follows their rows and not the number of rounds.
    """
    order = F.struct((-F.col("priority")).alias("p"), F.col("rule").alias("r"))
    named = rules.select("rule", F.col("canonical").alias("name"), order.alias("turn")).dropDuplicates(["rule"])
    owners = previous.select("id", "owner").where("owner IS NOT NULL").dropDuplicates(["id"])
    known = charges.select("id", "account", _currency().alias("cur"), F.lower("merchant").alias("m"))
    free = found.select("id", "rule").distinct().join(links.select("id"), "id", "left_anti")
    asked = staged(free.join(named, "rule").join(owners, "id", "left").join(known, "id"))
    own = asked.select("rule", "turn", F.explode(F.array(F.concat(F.lit("m"), F.coalesce("m", F.lit(""))), F.concat(F.lit("m"), F.lower("name")), F.concat(F.lit("o"), "name"))).alias("use"))
    uses = staged(own.where("use IS NOT NULL").distinct())
    asked = asked.drop("turn")
    told = asked.select("name").distinct()
    owned = links.where("canonical IS NOT NULL").join(known, "id").select("canonical", "account", "cur", "m").distinct()
    relevant = owned.join(told.withColumnRenamed("name", "canonical"), "canonical", "left_semi").unionByName(owned.join(told.select(F.lower("name").alias("m")).distinct(), "m", "left_semi").select(*owned.columns))
    owned, taken = staged(relevant.distinct()), asked.select("id", "rule", "name").limit(0)
    while not uses.isEmpty():
        first = uses.groupBy("use").agg(F.min("turn").alias("first"))
        waiting = uses.join(first, "use").where("turn <> first").select("rule").distinct()
        acting = staged(uses.select("rule").distinct().join(waiting, "rule", "left_anti"))
        now = stored(allowed(asked.join(acting, "rule", "left_semi"), owned))
        taken = taken.unionByName(now.select("id", "rule", "name"))
        asked = staged(asked.join(acting, "rule", "left_anti").join(now.select("id"), "id", "left_anti"))
        owned = staged(owned.unionByName(now.select(F.col("name").alias("canonical"), "account", "cur", "m")).distinct())
        uses = staged(uses.join(acting, "rule", "left_anti"))
    return taken
