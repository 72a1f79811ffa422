"""SimHash components against all pairs, and the pigeonhole's thresholds."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from coffer.llm import simhash

SMALL = "/root/testdata/sf0.001"


def _plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(prints):
    """prints: (id, print) of every row; the least id reachable, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, p) in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known, default=None)
    return [least[find(i)] for i in range(len(prints))]


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_components_by_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, _plain_print(r.text)) for r in sorted(docs)]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, _plain_components(prints))), key=repr)
    assert _rows(simhash.op11_simhash(spark, SMALL)) == want


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "a b c d " * 9), (5, "a b c d " * 9), (None, "A B C D " * 9), (None, "alone " * 3 + "quite"), (6, "é ß " * 50_000)]
    frame = spark.createDataFrame([(d, t, "clash", 0) for d, t in texts], "doc_id long, text string, print string, component_id int")
    prints = [(d, _plain_print(t)) for d, t in texts]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, _plain_components(prints))), key=repr)
    assert _rows(simhash.near_groups(frame)) == want
    assert simhash.near_groups(frame.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1, 65, 10_000])
def test_links_in_crowds(spark, monkeypatch, most):
    """Balls of close prints around a few centres, some bits correlated: the same components whatever the crowd's bound."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(5)
    base = [rng.getrandbits(56) * 257 % 2**64 for _ in range(6)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) for b in base for k in range(6) for _ in range(20)}
    prints = sorted(p & (2**64 - 1) for p in prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.close_links(frame).distinct().collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in links)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = _plain_components([(p, p) for p in prints])
    got = {}
    for p in prints:
        got.setdefault(find(p), []).append(p)
    assert sorted(min(v) for v in got.values()) == sorted(set(want))


@pytest.mark.parametrize("m", simhash.PARTITIONS)
def test_thresholds_keep_the_pigeonhole(m):
    """Thresholds add up to d - m + 1 and have the least cost; any two prints within the distance meet in a partition."""
    rng = np.random.default_rng(m)
    prints = rng.integers(-(2**63), 2**63 - 1, 400)
    bits = simhash._bits(prints)
    together = bits.astype(int).T @ bits.astype(int)
    parts = simhash.grouped_bits(together, len(prints), m)
    assert sorted(b for p in parts for b in p) == list(range(64))
    counts = np.stack([np.bincount(simhash._values(bits, c), minlength=256) for p in parts for c in simhash._cuts(p)])
    plan = simhash.Plan(parts, counts, len(prints))
    limits, cost = plan.thresholds(bits)
    assert (limits.sum(axis=1) == 2 - m + 1).all()
    costs = plan.costs(bits)
    assert np.allclose(cost, np.take_along_axis(costs, limits[:, :, None] + 1, axis=2)[:, :, 0].sum(axis=1))
    for i in range(100):
        other = bits[i].copy()
        other[rng.integers(0, 64, 2)] ^= 1
        assert any((other[p] != bits[i][p]).sum() <= t for p, t in zip(parts, limits[i]))
