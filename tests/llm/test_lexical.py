"""Ranked search against DuckDB and a plain loop."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from coffer.llm import lexical

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _plain(docs, items, k):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, words, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (d, c), size in zip(counts, sizes):
            score = 0
            for t in _terms(text):
                if t in c:
                    m = 25 + 75 * size * n // words
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def _rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_agrees_with_sql_and_a_loop(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = sorted(db.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.SQL})").fetchall(), key=repr)
    assert _rows(lexical.op13_ranked_search(spark, SMALL)) == want
    docs, items = (db.sql(f"SELECT * FROM {n}").fetchall() for n in ("documents", "benchmark"))
    columns = [c[0] for c in db.sql("SELECT * FROM documents").description]
    at = columns.index("doc_id"), columns.index("text")
    assert _plain([(r[at[0]], r[at[1]]) for r in docs], [(r[0], r[1]) for r in items], 10) == want


@pytest.mark.parametrize(("head", "block", "run_words"), [(64, 4096, 10**6), (2, 8, 30), (1, 3, 1)])
def test_random_tables(spark, monkeypatch, head, block, run_words):
    monkeypatch.setattr(lexical, "HEAD", head)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "RUN_WORDS", run_words)
    rng = random.Random(head)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(7, "W1 w2. w3!"), (7, "W1 w2. w3!"), (None, "w1 w2 w3"), (901, None), (902, ""), (903, " ,;"), (904, "É é ß_漢字 w5 " * 3), (905, "w1 " * 20_000)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 15)))) for i in range(8)] + [(20, None), (21, ""), (22, "nowhere"), (23, "é É ß 漢字 w1 w1")]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert _rows(lexical.search(frame, asked, 10)) == _plain(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
    assert _rows(lexical.search(spark.createDataFrame([(1, "b c"), (2, "c")], "doc_id long, text string"), items)) == _plain([(1, "b c"), (2, "c")], [(1, "a b")], 10)
