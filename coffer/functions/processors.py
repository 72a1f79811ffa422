"""Merchants behind payment processors (FN-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes in the order that they are tried, and whether they hint at a subscription.
PREFIXES = [
    ("STRIPE*", True), ("STRIPE *", True), ("PAYPAL *", False), ("PAYPAL*", False), ("PP*", False), ("GOOGLE *", False), ("GOOGLE*", False),
    ("SQ *", False), ("SQC*", False), ("SQUAREUP*", False), ("SP *", True), ("SHOPIFY*", True), ("GUMROAD*", True), ("PADDLE*", True), ("PADDLE.NET*", True), ("FS *", True), ("FASTSPRING*", True),
]
# Services of one biller by what its texts say: (words, merchant, hint).
BILLED = [
    ("icloud", "iCloud", "iCloud+"), ("apple music", "Apple Music", None), ("apple tv", "Apple TV+", None), ("apple one", "Apple One", None),
    ("apple arcade", "Apple Arcade", None), ("apple news", "Apple News+", None), ("apple fitness", "Apple Fitness+", None), ("apple care", "AppleCare", None),
]
RECURRING = ["subscription", "membership", "member", "plan", "premium", "plus", "monthly", "annual", "yearly", "renew", "renewal", "billing", "autopay", "auto pay", "trial"]
# Spellings of whole names and of words.
NAMES = {"YOUTUBE PREMIUM": "YouTube Premium", "YOUTUBE MUSIC": "YouTube Music", "ICLOUD": "iCloud", "GITHUB": "GitHub"}
WORDS = {"AWS": "AWS", "AI": "AI", "API": "API", "TV": "TV", "ID": "ID", "YT": "YT"}


def _spelled(values: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def _cleaned(name: Column) -> Column:
    plain = F.trim(F.regexp_replace(name, r"[\s_\-*/]+", " "))
    words = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.coalesce(_spelled(WORDS, F.upper(w)), F.initcap(F.lower(w))))
    return F.coalesce(_spelled(NAMES, F.upper(plain)), F.array_join(words, " "))


def unmasked(raw: Column, memo: Column, category: Column) -> Column:
    """struct(merchant, is_processor, hint, boost): the merchant that a processor bills for, null where none is at work."""
    name = F.trim(F.upper(F.coalesce(raw, F.lit(""))))
    told = F.lower(F.concat_ws(" ", raw, memo, category))
    biller = F.contains(name, F.lit("APPLE.COM/BILL")) | F.contains(name, F.lit("APPLE.COM BILL"))
    service = F.coalesce(*[F.when(F.contains(told, F.lit(words)), F.struct(F.lit(m).alias("merchant"), F.lit(h).cast("string").alias("hint"))) for words, m, h in BILLED])
    recurring = F.lit(False)
    for word in RECURRING:
        recurring = recurring | F.contains(told, F.lit(word))
    behind = lambda p: F.nullif(F.trim(F.substring(name, len(p) + 1, 1 << 20)), F.lit(""))
    # a prefix with nothing behind it gives way to the next one
    tried = [F.when(F.startswith(name, F.lit(p)) & behind(p).isNotNull(), F.struct(behind(p).alias("name"), F.lit(b).alias("boost"))) for p, b in PREFIXES]
    stripped = F.coalesce(*tried)
    out = lambda merchant, is_processor, hint, boost: F.struct(merchant.alias("merchant"), is_processor.alias("is_processor"), hint.cast("string").alias("hint"), boost.alias("boost"))
    none = F.lit(None).cast("string")
    return (
        F.when(biller, out(F.coalesce(service["merchant"], F.lit("Apple")), F.lit(True), service["hint"], service.isNotNull() | recurring))
        .when(stripped.isNotNull(), out(_cleaned(stripped["name"]), F.lit(True), none, stripped["boost"]))
        .otherwise(out(none, F.lit(False), none, F.lit(False)))
    )
