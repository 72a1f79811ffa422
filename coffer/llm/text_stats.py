"""Statistics of whole texts as native columns, for the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, words

#: The characters that count as symbols (fixed by the result's contract).
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _window_hashes(hashes: Column, n: Column) -> Column:
    """One hash per window of five words."""
    return F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)])),
    )


def _sorted_windows(word_list: Column, n: Column) -> Column:
    return F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.struct(F.array_join(F.slice(word_list, i + 1, WINDOW), " ").alias("s"), i.alias("i")),
        )
    )


def _repeated_starts(pairs: Column) -> Column:
    """Starts, in order, of the windows whose words occur twice or more; pairs are sorted by the words."""
    last = F.size(pairs) - 1
    hit = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: (F.when(k > 0, pairs[k - 1]["s"] == pairs[k]["s"]).otherwise(False))
        | (F.when(k < last, pairs[k + 1]["s"] == pairs[k]["s"]).otherwise(False)),
    )
    return F.sort_array(F.transform(hit, lambda k: pairs[k]["i"]))


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at these sorted starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["p"])).alias("n"), s.alias("p")),
        lambda acc: acc["n"],
    )


def with_text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds one struct column ``stats`` of longs, computed on the whole text without Python.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (those equal to an earlier one), n_repeat_words (words in
    five-word windows that occur twice or more), n_distinct_words, n_upper and
    n_digits (characters), n_bangs (``!`` and ``?``), n_marked_words (words that
    end in a symbol). Null and empty texts have zeros throughout. A column named
    stats is replaced; other columns are kept.

    Windows are first compared by a 64-bit hash; only texts in which hashes repeat
    are compared again by their words, so the counts are exact.
    """
    df = df.drop("stats")
    names = df.columns
    kept = F.struct(*[column(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    out = df.select(kept.alias("row"), F.coalesce(column(df, text_col), F.lit("")).alias("t"))
    out = out.select("row", "t", words(F.col("t")).alias("w"))
    out = out.select(
        "row",
        "t",
        "w",
        F.size("w").alias("n"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.array_join("w", "").alias("joined"),
    )
    out = out.select("*", _window_hashes(F.col("h"), F.col("n")).alias("g"))
    out = out.select(
        "*",
        F.coalesce(F.size(F.array_distinct("g")) < F.size("g"), F.lit(False)).alias("again"),
    )
    out = out.select("*", F.when(F.col("again"), _sorted_windows(F.col("w"), F.col("n"))).alias("pairs"))
    out = out.select("*", F.when(F.col("again"), _repeated_starts(F.col("pairs"))).alias("starts"))
    counts = {
        "n_words": F.col("n"),
        "word_chars": F.length("joined"),
        "n_symbols": F.regexp_count("joined", F.lit(SYMBOLS)),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("again"), _covered(F.col("starts"))).otherwise(0),
        "n_distinct_words": F.size(F.array_distinct("h")),
        "n_upper": F.regexp_count("joined", F.lit(r"\p{Lu}")),
        "n_digits": F.regexp_count("joined", F.lit("[0-9]")),
        "n_bangs": F.regexp_count("joined", F.lit("[!?]")),
        "n_marked_words": F.size(F.filter("w", lambda x: F.right(x, F.lit(1)).rlike(SYMBOLS))),
    }
    stats = F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])
    # One element each: a filter on stats then stays above, instead of being pushed down with every count written out in it.
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)], F.explode(F.array(stats)).alias("stats"))
