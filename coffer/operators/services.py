"""Names resolved to known services, and services searched by a text (QRY-22, QRY-23).

``services`` has a row for each alias: entry (its place in the list), service and alias (normalized). Names and aliases
meet by equal pieces of text, never by comparing all with all; distinct names are looked up, so a hot name costs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, nil_if_blank

CANDIDATES = ["identifier", "canonical", "display"]
PREFIX, PART, TITLE, SHOWN = 1_000, 2_000, 3_000, 6


def normalized(c: Column) -> Column:
    """Letters and digits alone, folded."""
    return F.regexp_replace(folded(c), "[^a-z0-9]+", "")


def title(service: Column) -> Column:
    return F.initcap(F.translate(F.regexp_replace(service, "brand-", ""), "-", " "))


def _lengths(most: Column) -> Column:
    """1 to ``most``, nothing if that is 0 or null."""
    return F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))


def resolved(names: DataFrame, services: DataFrame) -> DataFrame:
    """``names`` with ``service`` added: the service that identifier, canonical and display stand for, or null.

    An identifier that is an alias or a service as it stands comes first, then the first of the three that equals an
    alias, then the first of them that begins or ends with one: its longest alias counts. Of entries that share an alias,
    the last one has it where the alias is met whole, and the earliest where it is a beginning or an end.
    Blank names stand for nothing. Rows are kept as they are, repeated ones too; a column named service is replaced.
    """
    names = names.drop("service")
    known = services.where("alias <> ''").select("entry", F.col("service").alias("found"), "alias").distinct()
    most = known.agg(F.max(F.length("alias")).alias("most"))  # one row
    asked = names.select(*CANDIDATES).distinct()
    given = nil_if_blank(F.col("identifier"))
    # as it stands: 0 by alias, 1 by service; equal: 2; beginnings and ends: 3
    itself = asked.where(given.isNotNull()).select(*CANDIDATES, F.col("identifier").alias("piece"))
    by_service = known.groupBy("found").agg(F.min("entry").alias("entry")).withColumn("alias", F.col("found"))
    each = asked.select(*CANDIDATES, F.posexplode(F.array(given, "canonical", "display")).alias("place", "name"))
    each = each.withColumn("name", normalized(F.col("name"))).where("name <> ''")
    near = each.crossJoin(F.broadcast(most)).withColumn("n", F.explode(_lengths(F.least(F.length("name"), "most"))))
    ends = F.array_distinct(F.array(F.expr("left(name, n)"), F.expr("right(name, n)")))
    order = ["level", "place", "shorter", "turn"]

    def met(left: DataFrame, right: DataFrame, level: int, place: Column) -> DataFrame:
        rows = left.join(right, F.col("piece") == F.col("alias"))
        return rows.select(*CANDIDATES, F.lit(level).alias("level"), place.alias("place"), (-F.length("alias")).alias("shorter"), (-F.col("entry") if level in (0, 2) else F.col("entry")).alias("turn"), "found")

    hits = met(itself, known, 0, F.lit(0)).unionByName(met(itself, by_service, 1, F.lit(0)))
    hits = hits.unionByName(met(each.withColumnRenamed("name", "piece"), known, 2, F.col("place")))
    hits = hits.unionByName(met(near.withColumn("piece", F.explode(ends)), known, 3, F.col("place")))
    best = hits.groupBy(*[F.col(c).alias(f"_{c}") for c in CANDIDATES]).agg(F.min_by("found", F.struct(*order)).alias("service"))
    same = [names[c].eqNullSafe(F.col(f"_{c}")) for c in CANDIDATES]
    return names.join(best, same[0] & same[1] & same[2], "left").select(*[names[c] for c in names.columns], "service")


def search(queries: DataFrame, services: DataFrame, shown: int = SHOWN) -> DataFrame:
    """query, rank, service, title and score of the ``shown`` services that fit each distinct query best.

    0 for an alias, 1,000 and the missing letters for the beginning of one, 2,000 and the difference for a part of one or
    around one, 3,000 for a part of the title. The first entry of a service that fits counts; equal scores go by title,
    then service. A query without letters and digits finds nothing.
    """
    asked = queries.select("query").distinct().withColumn("plain", normalized(F.col("query"))).where("plain <> ''")
    known = services.where("alias <> ''").select("entry", "service", "alias").distinct()
    most = known.agg(F.max(F.length("alias")).alias("most"))  # one row

    def pieces(df: DataFrame, c: str, longest: Column) -> DataFrame:
        """Every distinct part of a text of up to that length, and whether it is its beginning."""
        cut = df.withColumn("at", F.explode(_lengths(F.length(c)))).withColumn("n", F.explode(_lengths(F.least(longest, F.length(c) - F.col("at") + 1))))
        return cut.withColumn("piece", F.substring(F.col(c), F.col("at"), F.col("n"))).withColumn("first", F.col("at") == 1)

    gap = F.abs(F.length("alias") - F.length("plain"))
    inside = pieces(known, "alias", F.length("alias")).join(asked, F.col("piece") == F.col("plain"))
    inside = inside.select("query", "entry", "service", F.when(gap == 0, 0).when(F.col("first"), PREFIX + gap).otherwise(PART + gap).alias("score"))
    around = pieces(asked.crossJoin(F.broadcast(most)), "plain", F.col("most")).join(known, F.col("piece") == F.col("alias"))
    around = around.where(gap > 0).select("query", "entry", "service", (PART + gap).alias("score"))
    titled = known.select("entry", "service").distinct().withColumn("text", F.lower(title(F.col("service"))))
    titled = pieces(titled, "text", F.length("text")).join(asked, F.col("piece") == F.col("plain")).select("query", "entry", "service", F.lit(TITLE).alias("score"))
    of_entry = inside.unionByName(around).unionByName(titled).groupBy("query", "entry", "service").agg(F.min("score").alias("score"))
    fits = of_entry.groupBy("query", "service").agg(F.min_by("score", "entry").alias("score")).withColumn("title", title(F.col("service")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "title", "service"))
    return fits.withColumn("rank", rank).where(F.col("rank") <= shown).select("query", "rank", "service", "title", "score")
