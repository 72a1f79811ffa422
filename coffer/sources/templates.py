"""Saved column mappings found by a file's headers, and a preview of what a mapping yields (INF-11, INF-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import parsed_amount, parsed_date

#: The columns that a mapping names.
ROLES = ["date", "description", "amount", "merchant", "category", "account", "currency"]


def _set(names: Column) -> Column:
    """Equal for arrays with the same set of names, whatever their order; nulls don't count."""
    return F.to_json(F.array_sort(F.array_distinct(F.array_compact(names))))


def with_template(files: DataFrame, templates: DataFrame) -> DataFrame:
    """Files with the mapping of the newest template that names exactly their headers, or their own.

    files: file, headers, the roles (the inferred columns, or null), sign and confidence; templates: template,
    created, the roles and sign. Where the signs disagree, the file keeps its sign and its confidence; else the confidence is 1.
    Of templates with one set of headers only the newest (then the greatest id) meets files, by a join
    on the set. Without headers no template is found.
    """
    newest = templates.groupBy(_set(F.array(*ROLES)).alias("_set")).agg(F.max(F.struct("created", "template", *ROLES, "sign")).alias("_t"))
    joined = files.withColumn("_set", _set(F.col("headers"))).join(newest.where("_set <> '[]'"), "_set", "left")
    found = F.col("_t").isNotNull()
    agrees = F.coalesce(F.col("_t.sign") == F.col("sign"), F.lit(False))
    return joined.select(
        "file", F.col("_t.template").alias("template"), *[F.when(found, F.col(f"_t.{r}")).otherwise(F.col(r)).alias(r) for r in ROLES], "sign", F.when(agrees, 1.0).otherwise(F.col("confidence")).alias("confidence")
    )


def saved(templates: DataFrame, mappings: DataFrame) -> DataFrame:
    """The templates with those mappings added whose roles and sign none of them has, each once (the newest)."""
    same = F.to_json(F.struct(*[F.coalesce(r, F.lit("")).alias(r) for r in (*ROLES, "sign")]))
    order = Window.partitionBy("_same").orderBy(F.desc("created"), F.desc("template"))
    new = mappings.withColumn("_same", same).join(templates.select(same.alias("_same")), "_same", "left_anti")
    new = new.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return templates.unionByName(new.select(templates.columns))


#: Rows of a file that a preview looks at.
PREVIEW_ROWS = 200


def previews(rows: DataFrame, limit: int = PREVIEW_ROWS, day_first: bool = False) -> DataFrame:
    """What the mapping of each file makes of its first rows: counts, and codes of the warnings in order.

    rows: file, row (its place), date, amount and merchant (texts of the mapped cells, null for none) and sign
    ("positive" where debits are positive). A preview is the first ``limit`` rows, which is what it is for. Rows are filtered by a rank in
    each file; a file of any size is sorted once, not held. Warnings: unparseable, nameless, no_debits, few_debits.
    """
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("row"))).where(F.col("_n") <= limit)
    amount = parsed_amount(F.coalesce("amount", F.lit("")))
    read = F.coalesce(parsed_date(F.coalesce("date", F.lit("")), day_first).isNotNull() & amount.isNotNull(), F.lit(False))
    named = read & (F.trim(F.coalesce("merchant", F.lit(""))) != "")
    debit = named & F.coalesce(F.when(F.col("sign") == "positive", amount > 0).otherwise(amount < 0), F.lit(False))
    marked = first.select("file", read.alias("_read"), named.alias("_named"), debit.alias("_debit"))
    out = marked.groupBy("file").agg(F.count("*").alias("sampled"), F.count_if("_read").alias("parseable"), F.count_if("_named").alias("usable"), F.count_if("_debit").alias("debits"))
    out = out.withColumn("missing", F.col("parseable") - F.col("usable"))
    warn = lambda when, code: F.when(when, F.lit(code))
    none, some = F.col("debits") == 0, F.col("usable") > 0
    codes = F.array(warn(F.col("parseable") == 0, "unparseable"), warn((F.col("usable") == 0) & (F.col("parseable") > 0), "nameless"), warn(some & none, "no_debits"), warn(some & ~none & (F.col("debits") * 4 < F.col("usable")), "few_debits"))
    return out.withColumn("warnings", F.array_compact(codes))
