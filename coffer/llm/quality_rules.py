"""Quality rules with thresholds learnt per language and source from quantile sketches.

The sketch of a metric is a histogram of integer buckets that keep the six
leading bits of a value, so a quantile is off by 1/32 of itself at most. Sketches
of two groups merge by adding counts, which is a plain ``groupBy().sum()``: a hot
source is summed on the map side first, and small groups use the merged sketch
of their language, then that of the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, written
from .text_stats import with_text_statistics

LEADING_BITS = 6
#: Texts that a group's own sketch must hold to be used.
MIN_GROUP = 50
#: A value may lie so many times the spread (interquartile range) beyond a quartile.
FENCE = 3
#: Metric: (smallest spread, whether low values are outliers too). All are per thousand.
METRICS = {
    "word_len": (400, True),
    "symbols": (30, False),
    "dup_lines": (30, False),
    "repeats": (30, False),
}


def bucket(value: Column) -> Column:
    """The smallest value with the same leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - LEADING_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def base_metrics(df: DataFrame) -> DataFrame:
    """Adds the base verdict and the metrics (per thousand) to a frame that has ``stats``."""
    s = lambda name: F.col("stats")[name]
    per_mille = lambda a, b: F.when(b > 0, F.expr("0") + F.floor(a * 1000 / b)).otherwise(0).cast("long")
    return df.withColumns(
        {
            "base_failed": (s("n_words") < 10) | (100 * s("n_repeat_words") > 20 * s("n_words")),
            "word_len": per_mille(s("word_chars"), s("n_words")),
            "symbols": per_mille(s("n_symbols"), s("n_words")),
            "dup_lines": per_mille(s("n_dup_lines"), s("n_lines")),
            "repeats": per_mille(s("n_repeat_words"), s("n_words")),
        }
    )


def sketches(measured: DataFrame) -> DataFrame:
    """Rows (level, lang, source, metric, bucket, n): counts per bucket at three levels.

    Level 0 is a language and source, 1 a language, 2 everything; the upper two
    are merged from level 0.
    """
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS]))
    fine = (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", metrics.alias("m"))
        .groupBy("lang", "source", "m.metric", "m.bucket")
        .agg(F.count("*").alias("n"))
    )
    null = F.lit(None).cast("string")
    by_lang = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")).withColumn("source", null)
    of_all = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n")).withColumn("source", null).withColumn("lang", null)
    return (
        fine.withColumn("level", F.lit(0))
        .unionByName(by_lang.withColumn("level", F.lit(1)))
        .unionByName(of_all.withColumn("level", F.lit(2)))
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per level and group: its size n and a map from each metric to (lo, hi)."""
    group = ["level", "lang", "source", "metric"]
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    q = (
        sketch.withColumn("upto", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(whole))
        .groupBy(*group)
        .agg(
            F.max("total").alias("n"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
            F.min(F.when(F.col("upto") * 4 >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
        )
    )
    least = F.create_map(*[x for m, (s, _) in METRICS.items() for x in (F.lit(m), F.lit(s))])
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("metric")])
    fences = q.groupBy("level", "lang", "source").pivot("metric", list(METRICS)).agg(
        F.first(F.struct("n", (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi")))
    )
    return fences


def apply_rules(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Every row of ``df`` with the columns stats, base_failed, thresholds_level and kept added.

    A text fails the base rules if it has under ten words or more than a fifth of
    them repeat. Others are kept unless a metric lies beyond the fences of its
    group. A group is a language and source (null is a value of its own); below
    ``min_group`` base-passing texts the language's merged sketch holds, below
    that again the corpus's. Null and blank texts fail the base rules; repeated
    rows are judged alike; an empty table gives an empty result. Columns of df
    that bear the added names are replaced.
    """
    added = ["stats", "base_failed", "thresholds_level", "kept"]
    df = df.drop(*[c for c in added if c not in (text_col, lang_col, source_col)])
    packed = df.select(
        F.struct(*[column(df, c).alias(f"c{i}") for i, c in enumerate(df.columns) if c != text_col]).alias("rest")
        if len(df.columns) > 1
        else F.struct(F.lit(0).alias("none")).alias("rest"),
        column(df, text_col).cast("string").alias("text"),
        (column(df, lang_col).cast("string") if lang_col in df.columns else F.lit(None).cast("string")).alias("lang"),
        (column(df, source_col).cast("string") if source_col in df.columns else F.lit(None).cast("string")).alias("source"),
    )
    names = df.columns
    return _judge(packed, min_group).select(
        *[(F.col("text") if c == text_col else F.col("rest")[f"c{i}"]).alias(c) for i, c in enumerate(names)],
        *added,
    )


def judged_statistics(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Verdicts for rows that already carry lang, source, base_failed and the metrics."""
    limits = thresholds(sketches(measured)).persist()
    out = measured
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        side = limits.where(F.col("level") == level).select(
            *[F.col(k).alias(f"k{level}_{k}") for k in keys], F.struct(*METRICS).alias(f"l{level}")
        )
        # Null-safe, by an equal hash-joinable key: a null group is a group.
        on = F.lit(True)
        for k in keys:
            on = on & out[k].eqNullSafe(side[f"k{level}_{k}"])
        if keys:
            out = out.join(side, on, "left").drop(*[f"k{level}_{k}" for k in keys])
        else:
            out = out.join(F.broadcast(side), F.lit(True), "left")  # one row
    enough = lambda c: F.coalesce(c["word_len"]["n"] >= min_group, F.lit(False))
    level = F.when(enough(F.col("l0")), 0).when(enough(F.col("l1")), 1).otherwise(2)
    limit = F.when(enough(F.col("l0")), F.col("l0")).when(enough(F.col("l1")), F.col("l1")).otherwise(F.col("l2"))
    good = ~F.col("base_failed")
    for m, (_, low) in METRICS.items():
        good = good & (F.col(m) <= F.col("limit")[m]["hi"])
        if low:
            good = good & (F.col(m) >= F.col("limit")[m]["lo"])
    return (
        out.withColumn("limit", limit)
        .withColumn("thresholds_level", level)
        .withColumn("kept", F.coalesce(good, F.lit(False)))
        .drop("l0", "l1", "l2", "limit")
    )


def _judge(packed: DataFrame, min_group: int) -> DataFrame:
    return judged_statistics(base_metrics(with_text_statistics(packed, "text")), min_group)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents; the statistics are written once, since sketches and verdicts both read them."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    measured = written(base_metrics(with_text_statistics(docs, "text")).drop("text"), "rules")
    s = lambda name: F.col("stats")[name].alias(name)
    return judged_statistics(measured).select(
        "doc_id",
        s("n_words"),
        s("word_chars"),
        s("n_symbols"),
        s("n_dup_lines"),
        s("n_repeat_words"),
        "base_failed",
        "kept",
    )


def _sql() -> str:
    fences = []
    for m, (least, low) in METRICS.items():
        pick = lambda end, m=m: f"CASE WHEN l0.{m}_n >= {MIN_GROUP} THEN l0.{m}_{end} WHEN l1.{m}_n >= {MIN_GROUP} THEN l1.{m}_{end} ELSE l2.{m}_{end} END"
        fences.append(f"s.{m} <= {pick('hi')}")
        if low:
            fences.append(f"s.{m} >= {pick('lo')}")
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in METRICS.items()) + " END"
    wide = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {e} END) AS {m}_{e}" for m in METRICS for e in ("n", "lo", "hi"))
    fine = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM s WHERE NOT base_failed" for m in METRICS)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, sum(least(5, i - p)) AS n FROM
        (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5) AS p FROM r) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rw ON w.doc_id = rw.doc_id),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_len,
        CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
        CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
        CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats FROM c),
v AS ({fine}),
b AS (SELECT *, (v >> greatest(0, length(bin(v)) - {LEADING_BITS})) << greatest(0, length(bin(v)) - {LEADING_BITS}) AS bucket FROM v),
h AS (SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM b GROUP BY ALL
      UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM b GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM h),
q AS (SELECT level, lang, source, metric, max(total) AS n, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1,
        min(CASE WHEN upto * 4 >= 3 * total THEN bucket END) AS q3 FROM u GROUP BY level, lang, source, metric),
f AS (SELECT *, q1 - {FENCE} * greatest(q3 - q1, {least}) AS lo, q3 + {FENCE} * greatest(q3 - q1, {least}) AS hi FROM q),
x AS (SELECT level, lang, source, {wide} FROM f GROUP BY level, lang, source)
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
  coalesce(NOT s.base_failed AND {' AND '.join(fences)}, false) AS kept
FROM s LEFT JOIN x l0 ON l0.level = 0 AND s.lang IS NOT DISTINCT FROM l0.lang AND s.source IS NOT DISTINCT FROM l0.source
LEFT JOIN x l1 ON l1.level = 1 AND s.lang IS NOT DISTINCT FROM l1.lang
LEFT JOIN x l2 ON l2.level = 2"""


SQL = _sql()
