"""Quality classifier: a sparse ensemble of rules over text statistics.

Small decision trees are grown on bootstrap samples; the path to each node is a
rule, a conjunction of comparisons. A logistic regression with an L1 penalty
chooses few of the rules and weighs them. The chosen rules become one Spark
column expression, so scoring needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_fold
from .labels import SAMPLE_ROWS, training_rows
from .text_stats import with_text_statistics

TREES, DEPTH, BOOTSTRAP, CUTS = 40, 3, 2_000, 32
PENALTY, STEPS = 0.0015, 400
#: Rules that hold for a smaller or larger share of the sample are left out.
SUPPORT = 0.003
KEEP_FROM = 0.3

Condition = tuple[str, bool, float]  # statistic, above?, threshold


def statistics(stats: Column) -> dict[str, Column]:
    """The numbers that rules compare, from the struct of counts; shares of words or characters."""
    s = {k: stats[k].cast("double") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_bangs", "n_marked_words")}
    per_word = lambda k: s[k] / F.greatest(s["n_words"], F.lit(1.0))
    per_char = lambda k: s[k] / F.greatest(s["word_chars"], F.lit(1.0))
    return {
        "log_words": F.log1p(s["n_words"]),
        "word_length": per_word("word_chars"),
        "symbols": per_word("n_symbols"),
        "marked": per_word("n_marked_words"),
        "bangs": per_word("n_bangs"),
        "upper": per_char("n_upper"),
        "digits": per_char("n_digits"),
        "distinct": per_word("n_distinct_words"),
        "repeats": per_word("n_repeat_words"),
        "dup_lines": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1.0)),
        "line_words": s["n_words"] / F.greatest(s["n_lines"], F.lit(1.0)),
    }


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept on the log-odds of label 1."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, values: dict[str, Column]) -> Column:
        """The probability of label 1 as a column."""
        odds = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, threshold in conditions:
                holds = holds & ((values[name] > threshold) if above else (values[name] <= threshold))
            odds = odds + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def _split(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
    """The statistic and threshold that lower the Gini impurity most, among half of the statistics."""
    best, found = 1e-9, None
    whole = y.mean() * (1 - y.mean())
    for j in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1], method="lower"))
        for t in cuts:
            above = x[:, j] > t
            n = above.sum()
            if 5 <= n <= len(y) - 5:
                p, q = y[above].mean(), y[~above].mean()
                gain = whole - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if gain > best:
                    best, found = gain, (int(j), float(t))
    return found


def _paths(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, path: tuple, depth: int, out: dict) -> None:
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    found = _split(x, y, rng)
    if found is None:
        return
    j, t = found
    for above in (True, False):
        at = (x[:, j] > t) == above
        rule = (*path, (names[j], above, t))
        out[tuple(sorted(rule))] = None
        _paths(x[at], y[at], names, rng, rule, depth - 1, out)


def _holds(x: np.ndarray, names: list[str], rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, t in rule:
        out &= (x[:, names.index(name)] > t) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for L1-penalised logistic regression; the intercept is free."""
    n, p = r.shape
    rate = y.mean()
    b, w = float(np.log(rate / (1 - rate))), np.zeros(p, np.float32)
    vb, vw, t = b, w.copy(), 1.0
    size = 4.0 / (1.0 + float(np.linalg.norm(r @ (r.T @ np.ones(n, np.float32) / n)) / np.sqrt(n)))
    for _ in range(steps):
        d = (1 / (1 + np.exp(-(r @ vw + vb))) - y).astype(np.float32) / n
        nb, nw = vb - size * float(d.sum()), vw - size * (r.T @ d)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw.astype(np.float32), nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> RuleModel:
    """Trees, their paths, and the lasso over them. One class or no rows: a smoothed constant."""
    if len(y) < 20 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))), ())
    rng, found = np.random.default_rng(seed), {}
    for _ in range(TREES):
        at = rng.integers(0, len(y), min(len(y), BOOTSTRAP))
        _paths(x[at], y[at], names, rng, (), DEPTH, found)
    by_rows: dict[bytes, tuple] = {}  # of rules that hold for the same rows, the shortest found first
    for r in sorted(found, key=len):
        holds = _holds(x, names, r)
        if SUPPORT <= holds.mean() <= 1 - SUPPORT:
            by_rows.setdefault(np.packbits(holds).tobytes(), r)
    rules = list(by_rows.values())
    if not rules:
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))), ())
    matrix = np.empty((len(x), len(rules)), np.float32)
    for j, r in enumerate(rules):
        matrix[:, j] = _holds(x, names, r)
    b, w = lasso(matrix, y, PENALTY, STEPS)
    return RuleModel(float(b), tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, rows: int = SAMPLE_ROWS) -> RuleModel:
    """The model of a bounded sample of labelled documents outside the held-out fold."""
    sample = with_text_statistics(training_rows(docs, labels, label, modulus, remainder, rows))
    values = statistics(F.col("stats"))
    got = sample.select(F.col("label").cast("double"), *[v.alias(k) for k, v in values.items()]).collect()  # ``rows`` rows of a dozen numbers
    table = np.array([tuple(r) for r in got], float).reshape(-1, 1 + len(values))
    return fit(table[:, 1:], table[:, 0], list(values))


def classify(df: DataFrame, model: RuleModel, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Every row of ``df`` with stats, score and predicted added; columns of those names are replaced.

    Null and empty texts are scored by the rules on zero counts; equal texts have
    equal scores; an empty table gives an empty result.
    """
    df = df.drop("score", "predicted")
    out = with_text_statistics(df, text_col)
    out = out.withColumn("score", model.column(statistics(F.col("stats"))))
    return out.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
