"""Rules against a look at every rule and charge, with short tokens, marks, punctuation, sources and imports."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest

from coffer.operators import rules

RULE = "rule int, canonical string, owns boolean, negative boolean, priority int, account string, currency string, raw_merchants array<string>, required array<string>, excluded array<string>, low double, high double, source string, scope array<string>"
CHARGE = "id int, account string, currency string, amount double, merchant_raw string, merchant string, memo string, category string, source string, import string"


def _fold(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _takes(r, c):
    """None, or whether the charge is within the rule's band."""
    if r["source"] is not None and c["source"] != r["source"] or r["scope"] is not None and c["import"] not in r["scope"]:
        return None
    if r["account"] and c["account"] != r["account"] or r["currency"] and r["currency"].upper() != (c["currency"] or "USD").upper():
        return None
    text = _fold(" ".join(c[k] or "" for k in ("merchant_raw", "merchant", "memo", "category")))
    if any(_fold(t) in text for t in r["excluded"] or []):
        return None
    exact = (c["merchant"] or "").lower() == r["canonical"].lower()
    search, required = re.sub("[^a-z0-9]+", " ", _fold(r["canonical"])).strip(), [_fold(t) for t in r["required"] or []]
    if (c["merchant_raw"] or "") not in (r["raw_merchants"] or []):
        told = bool(required) and all(t in text for t in required)
        if required and not told or not (exact or told or len(search) >= 3 and search in text):
            return None
    size = abs(c["amount"])
    in_band = (r["low"] is None or size >= r["low"]) and (r["high"] is None or size <= r["high"])
    return in_band if in_band or (r["owns"] and not r["negative"] and exact) else None


@pytest.mark.parametrize(("seed", "tokens"), [(1, ["shop", "pro", "plus"]), (2, ["é", "x", "ab", "plus", "café"])])
def test_matches_by_a_plain_loop(spark, seed, tokens):
    rng = random.Random(seed)
    names = ["Shop One", "Shop Two", "Café Zoë", "CAFE ZOE", "AT&T", "X", "Ab", "Shop", "Pro-Plus"]
    some = lambda of, most: rng.sample(of, rng.randrange(most + 1))
    told = [
        (i, rng.choice(names), rng.random() < 0.5, rng.random() < 0.3, 1, rng.choice([None, "", "a"]), rng.choice([None, "", "usd", "EUR"]), some(["SHOP 1", "AT&T"], 1), rng.choice([None, some(tokens, 2)]), rng.choice([None, some(["zoé", "void"], 1)]),
         rng.choice([None, 5.0]), rng.choice([None, 20.0]), rng.choice([None, None, "bank"]), rng.choice([None, None, ["i1"], []]))
        for i in range(40)
    ]
    charges = [
        (i, rng.choice(["a", "b", None]), rng.choice([None, "usd", "EUR"]), -rng.uniform(1, 30), rng.choice(["SHOP 1", "AT&T", "at t", None, "CAFÉ-ZOË"]), rng.choice([*names, None, "at t"]), rng.choice([None, "", "x plus", "café ab", "void"]), rng.choice([None, "pro"]),
         rng.choice(["bank", "file", None]), rng.choice(["i1", "i2", None]))
        for i in range(60)
    ]
    keys = [[f.split()[0] for f in s.split(", ")] for s in (RULE, CHARGE)]
    want = []
    for r in (dict(zip(keys[0], x)) for x in told):
        for c in (dict(zip(keys[1], x)) for x in charges):
            band = _takes(r, c)
            if band is not None:
                want.append((c["id"], r["rule"], r["negative"], 1, band))
    got = rules.matches(spark.createDataFrame(charges, CHARGE), spark.createDataFrame(told, RULE))
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert rules.matches(spark.createDataFrame([], CHARGE), spark.createDataFrame(told, RULE)).collect() == []
    assert rules.matches(spark.createDataFrame(charges, CHARGE), spark.createDataFrame([], RULE)).collect() == []


def test_rules_meet_few_texts(spark):
    """Numbers share their parts of three digits, so that by such parts each rule met a share of all texts."""
    keys = range(100_000, 104_000)
    texts = spark.createDataFrame([(f"M {k}", f"m {k}", "", "", f"m {k} m {k}  ") for k in keys], "merchant_raw string, merchant string, memo string, category string, c_text string")
    told = spark.createDataFrame([(k, ["m", str(k)]) for k in keys], "rule int, needles array<string>")
    assert rules._meeting(texts, told).count() == len(keys)
    got = rules._by_text(texts, told)
    assert sorted((r["rule"], r["merchant"]) for r in got.collect()) == [(k, f"m {k}") for k in keys]


def test_pieces_of_spaces_and_of_many_characters(spark):
    long = "abcdefgh" * 6
    words = ["a b", f"x{long}y z", f"{long[:40]}", "11 1", "a  b"]
    texts = spark.createDataFrame([(w, w, "", "", w) for w in words], "merchant_raw string, merchant string, memo string, category string, c_text string")
    needles = [[" "], ["  "], [long], [long[:33]], ["1"], ["1 1"], ["b", "a"], ["a b"], ["c a"]]
    got = rules._by_text(texts, spark.createDataFrame(list(enumerate(needles)), "rule int, needles array<string>"))
    assert sorted((r["rule"], r["merchant"]) for r in got.collect()) == sorted((i, w) for i, n in enumerate(needles) for w in words if all(t in w for t in n))
