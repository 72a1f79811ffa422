"""Match rules over transactions (RUL-02..05, PRD-17, PIP-12).

A rule holds rule, canonical, owns (it has a subscription), negative, priority,
account and currency (or null), raw_merchants, required and excluded (arrays of
tokens), low and high (or null); it may hold source (or null) and scope (an array of
imports, or null for all). A charge holds id, account, currency, amount,
merchant_raw, merchant, memo and category, and may hold source and import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, identity_token
from ..plans.staging import staged

#: Least band around a price, and its share of the price.
BAND, BAND_SHARE = 2.5, 0.12


def token_hints(canonical: Column) -> Column:
    """The first three words of three characters or more (RUL-02)."""
    return F.slice(F.filter(F.split(F.lower(canonical), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) >= 3), 1, 3)


def with_band(rules: DataFrame) -> DataFrame:
    """Adds required, low and high to (canonical, price, negative) rows (RUL-02)."""
    price = F.abs(F.col("price").cast("double"))
    room = F.greatest(F.lit(BAND), price * BAND_SHARE)
    positive = lambda c: F.when(~F.col("negative"), c)
    return rules.withColumns({"required": token_hints(F.col("canonical")), "low": positive(price - room), "high": positive(price + room)})


_TEXTS = ["merchant_raw", "merchant", "memo", "category"]
#: Most characters of a needle's word by which rules and texts meet.
KEY = 32
#: A word of more texts than this leaves the texts before they are dealt by word, unless a rule asks for it.
HOT = 10_000


def _words(text: Column) -> Column:
    """The distinct words of a text between spaces, and first an empty one, which every text has."""
    return F.array_union(F.array(F.lit("")), F.split(text, " "))


def _keys(word: Column, sizes: Column) -> Column:
    """The distinct parts of a word that have one of these lengths."""
    each = F.transform(F.filter(sizes, lambda n: n <= F.length(word)), lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)))
    return F.array_distinct(F.flatten(each))


def _meeting(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Texts with the rules that they may hold all needles of, by a word of the text and a piece of a needle.

    A piece of a needle between spaces stands within one word of a text. So needles are looked for in
    the distinct words of all texts, by equal keys: the piece, or the beginning of a long one, against the parts of a
    word of the lengths that pieces have. A rule and a text then meet by the words that hold the one of the
    rule's pieces that stands in the fewest texts. Needles of spaces alone meet every text by the empty word.
    """
    pieces = F.array_distinct(F.flatten(F.transform("needles", lambda t: F.filter(F.split(t, " "), lambda w: w != ""))))
    asked = rules.select("rule", F.explode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))).alias("_piece")).distinct()
    keyed = asked.select("_piece", F.substring("_piece", 1, KEY).alias("_key")).distinct()
    sizes = keyed.where("_key <> ''").agg(F.sort_array(F.collect_set(F.length("_key"))).alias("_sizes"))
    held = texts.select(*_TEXTS, "c_text", F.explode(_words(F.col("c_text"))).alias("_word"))
    words = held.groupBy("_word").agg(F.count("*").alias("_n"))
    parts = words.join(F.broadcast(sizes)).select("_word", "_n", F.explode(F.when(F.col("_word") == "", F.array(F.lit(""))).otherwise(_keys(F.col("_word"), F.col("_sizes")))).alias("_key"))
    hits = staged(parts.join(keyed, "_key").where(F.contains("_word", F.col("_piece"))).select("_piece", "_word", "_n"))
    counts = hits.groupBy("_piece").agg(F.sum("_n").alias("_n"))
    # A piece that no word holds counts 0 and comes first: its rule meets no text.
    rarest = asked.join(counts, "_piece", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_piece"))["_piece"].alias("_piece"))
    met = rarest.join(hits.select("_piece", "_word"), "_piece")
    idle = words.where(F.col("_n") > HOT).join(met.select("_word").distinct(), "_word", "left_anti").select("_word")
    return held.join(F.broadcast(idle), "_word", "left_anti").join(met.join(rules, "rule"), "_word")


def _by_text(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Texts with the rules all of whose needles they hold, each pair once."""
    at = _meeting(texts, rules)
    # A text meets a rule by the first of its words that hold the piece.
    first = F.get(F.filter(_words(F.col("c_text")), lambda w: F.contains(w, F.col("_piece"))), F.lit(0)) == F.col("_word")
    return at.where(first & F.forall("needles", lambda t: F.contains(F.col("c_text"), t))).drop("_piece", "_word", "needles", "c_text")


def matches(charges: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (id, rule, negative, priority, in_band): every rule that takes a charge (RUL-03, PRD-17).

    A rule takes a charge by its raw name, by its canonical name, or by parts of its text: all
    required tokens, or, where the rule has none, the canonical name without punctuation. These
    ways exclude each other, so no pair is found twice. Case and diacritics of tokens
    don't count. Distinct texts are matched, not charges; scope, amount and the
    rest are looked at afterwards. Null texts count as empty.
    """
    given = lambda df, name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
    none = F.array().cast("array<string>")
    tokens = lambda name: F.filter(F.transform(F.coalesce(name, none), folded), lambda t: t != "")
    r = rules.select(
        "rule", F.lower("canonical").alias("r_canonical"), identity_token(F.col("canonical")).alias("_search"), "owns", "negative", "priority", F.nullif(F.col("account"), F.lit("")).alias("r_account"),
        F.upper(F.nullif(F.col("currency"), F.lit(""))).alias("r_currency"), F.coalesce("raw_merchants", none).alias("raw_merchants"), tokens("required").alias("required"), tokens("excluded").alias("excluded"),
        "low", "high", given(rules, "source", "string").alias("r_source"), given(rules, "scope", "array<string>").alias("scope"),
    )
    known = charges.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _TEXTS]).distinct()
    texts = known.withColumn("c_text", folded(F.concat_ws(" ", *_TEXTS)))
    names = [c for c in r.columns if c != "_search"]
    by_raw = texts.join(r.withColumn("_raw", F.explode(F.array_distinct("raw_merchants"))), F.col("merchant_raw") == F.col("_raw"))
    exact = F.lower("merchant") == F.col("r_canonical")
    other = ~F.array_contains("raw_merchants", F.col("merchant_raw"))
    by_name = texts.join(r, exact).where(other & F.forall("required", lambda t: F.contains(F.col("c_text"), t)))
    needles = F.when(F.size("required") > 0, F.col("required")).when(F.length("_search") >= 3, F.array("_search"))
    by_text = _by_text(texts, r.withColumn("needles", needles).where("needles IS NOT NULL")).where(other & ~exact)
    found = by_raw.select(*_TEXTS, *names, folded(F.concat_ws(" ", *_TEXTS)).alias("c_text")).unionByName(by_name.select(*_TEXTS, *names, "c_text"))
    found = found.unionByName(by_text.select(*_TEXTS, *names, folded(F.concat_ws(" ", *_TEXTS)).alias("c_text")))
    found = found.where(~F.exists("excluded", lambda t: F.contains(F.col("c_text"), t))).drop("c_text", "required", "excluded", "raw_merchants")

    c = charges.select(
        "id", "account", F.coalesce(F.upper("currency"), F.lit("USD")).alias("c_currency"), F.abs("amount").cast("double").alias("c_amount"), *[F.coalesce(x, F.lit("")).alias(x) for x in _TEXTS],
        given(charges, "source", "string").alias("c_source"), given(charges, "import", "string").alias("c_import"),
    )
    in_band = (F.col("c_amount") >= F.coalesce("low", F.lit(float("-inf")))) & (F.col("c_amount") <= F.coalesce("high", F.lit(float("inf"))))
    same = lambda rule, own: F.col(rule).isNull() | F.coalesce(F.col(rule) == F.col(own), F.lit(False))
    scope = same("r_account", "account") & same("r_currency", "c_currency") & same("r_source", "c_source")
    scope &= F.col("scope").isNull() | F.coalesce(F.array_contains("scope", F.col("c_import")), F.lit(False))
    both = c.join(found, _TEXTS).withColumn("in_band", in_band)
    return both.where(scope & (F.col("in_band") | (F.col("owns") & ~F.col("negative") & exact))).select("id", "rule", "negative", "priority", "in_band")


def claims(found: DataFrame) -> DataFrame:
    """The rule that each charge goes to: negative ones first, then by priority, then by name (RUL-04)."""
    order = Window.partitionBy("id").orderBy(F.desc("negative"), F.desc("priority"), "rule")
    return found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def unsuppressed(charges: DataFrame, claimed: DataFrame) -> DataFrame:
    """Charges that no negative rule took (RUL-05)."""
    return charges.join(claimed.where("negative").select("id"), "id", "left_anti")


def band_scores(found: DataFrame) -> DataFrame:
    """Per rule the share of its matches within the band (PIP-12)."""
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.avg(F.col("in_band").cast("double")).alias("band_score"))
