"""Tables that change: commits, imports against a plain loop, the cache, and derived rules."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from coffer.operators import derived, imports
from coffer.plans.stores import Store

FIELDS = ["source", "account", "date", "amount", "merchant", "memo"]
STORED = "id long, source string, account string, date date, amount int, merchant string, memo string, note string"
IDENTITIES = "identity long, source string, account string, external_id string, pending_id string, reference string, fingerprint string, status string, id long, seen date"
DRAFTS = "draft long, source string, account string, external_id string, pending_id string, reference string, fingerprint string, status string, date date, amount int, merchant string, memo string"
DAY = dt.date(2024, 1, 1)


def test_a_failing_commit_leaves_the_old_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.tables() == {}
    assert store.commit({"a": spark.range(3), "b": spark.range(1)}, 0) == 1
    broken = spark.range(5).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        store.commit({"a": spark.range(9), "b": broken}, 1)
    assert store.version() == 1 and {n: t.count() for n, t in store.tables().items()} == {"a": 3, "b": 1}
    assert len(list((tmp_path / "store" / "data").iterdir())) == 1


def test_only_one_commit_follows_a_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"a": spark.range(3)}, 0)
    store.commit({"b": spark.range(2)}, 1)
    with pytest.raises(FileExistsError):
        store.commit({"a": spark.range(9)}, 1)
    store._put("000000000003.json", "{}")
    with pytest.raises(FileExistsError):
        store._put("000000000003.json", "{}")
    assert store.versions() == [1, 2, 3]


def test_clear_and_prune(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"a": spark.range(3), "templates": spark.range(2)}, 0)
    store.clear(keep=("templates",))
    assert {n: t.count() for n, t in store.tables().items()} == {"a": 0, "templates": 2}
    assert {n: t.count() for n, t in store.tables(1).items()} == {"a": 3, "templates": 2}
    store.commit({"templates": spark.range(4)}, 2)
    store.prune(last=1)
    assert store.versions() == [3] and {n: t.count() for n, t in store.tables().items()} == {"a": 0, "templates": 4}


def _similar(a: str, b: str) -> bool:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) >= 0.82


def _looked_up(leaders, identities, stored):
    """Per leading draft (transaction, identity, how): by keys, then, in turn, by likeness to pending rows that are left, then to any row; the least ids first."""
    got, taken = {}, set()
    own = lambda r: (r["source"], r["account"] or "")
    manual = lambda d: d["source"] == "manualImport" and not d["external_id"] and not d["pending_id"]
    for draft in leaders:
        same = [i for i in identities if own(i) == own(draft)]
        ways = [
            [i for i in same if draft["external_id"] and i["external_id"] == draft["external_id"]],
            [i for i in same if draft["pending_id"] and draft["pending_id"] in (i["external_id"], i["pending_id"])],
            [i for i in same if draft["reference"] and (i["reference"], i["fingerprint"]) == (draft["reference"], draft["fingerprint"])],
        ]
        for found in ways[2:] if manual(draft) else ways:
            if found and draft["draft"] not in got:
                best = min(found, key=lambda i: (i["id"], i["identity"]))
                got[draft["draft"]] = best["id"], best["identity"], "key"
                # every row that a key of the import finds is spoken for
            taken |= {i["identity"] for i in found}
    for draft in leaders:
        if draft["draft"] in got or manual(draft):
            continue
        alike = {t["id"] for t in stored.values() if (*own(t), t["amount"]) == (*own(draft), draft["amount"]) and abs((t["date"] - draft["date"]).days) <= 2 and _similar(t["merchant"], draft["merchant"])}
        waiting = [i for i in identities if (i["status"] == "pending" or i["pending_id"]) and i["id"] in alike and i["identity"] not in taken]
        if draft["external_id"] and waiting:
            best = min(waiting, key=lambda i: (i["id"], i["identity"]))
            taken.add(best["identity"])
            got[draft["draft"]] = best["id"], best["identity"], "key"
        elif alike and not draft["reference"] and (draft["external_id"] or draft["pending_id"]):
            got[draft["draft"]] = min(alike), None, "alike"
    return got


def _own_key(d):
    key = d["external_id"] and ("e", d["external_id"]) or d["pending_id"] and ("p", d["pending_id"]) or d["reference"] and ("r", d["reference"], d["fingerprint"]) or ("d", d["draft"])
    return (d["source"], d["account"] or "", *key)


def _plain(drafts, identities, stored):
    """The import as a loop over drafts; likeness and keys are looked up among the rows before the import."""
    before_i, before_t = [dict(i) for i in identities], {t["id"]: dict(t) for t in stored}
    now_i, now_t, what = {i["identity"]: dict(i) for i in identities}, {k: dict(t) for k, t in before_t.items()}, {}
    leaders = {_own_key(d): d for d in reversed(drafts)}
    hits = _looked_up(sorted(leaders.values(), key=lambda d: d["draft"]), before_i, before_t)
    moved = {}
    for d in drafts:
        leader = leaders[_own_key(d)]["draft"]
        at, who, how = hits.get(leader, (None, None, None))
        first = leader == d["draft"]
        who = leader if who is None else who
        at = leader if at is None else moved.setdefault(who, leader) if at not in before_t else at
        new = {f: d[f] for f in FIELDS}
        alike = how == "alike" and first
        if at not in now_t:
            outcome = "restored" if how else "inserted"
            now_t[at] = {"id": at, "note": None, **new}
        else:
            changed = {f: now_t[at][f] for f in FIELDS} != new
            outcome = "updated" if changed else "duplicate" if alike else "unchanged"
            now_t[at].update(new)
        now_i[who] = {"identity": who, **{k: d[k] for k in imports.KEYS}, "id": at, "seen": DAY}
        what[d["draft"]] = (at, who, alike, outcome)
    return now_t, now_i, what


def _random_tables(seed: int):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    stored = [dict(id=k, source="bank", account=pick("a", None), date=DAY + dt.timedelta(days=rng.randrange(30)), amount=rng.randrange(3), merchant=pick("north side shop", "south end cafe"), memo=pick("m", None), note=f"n{k}") for k in range(30)]
    identities = [
        dict(identity=500 + k, source="bank", account=t["account"], external_id=pick(f"e{k}", None), pending_id=pick(f"p{k}", None, None), reference=pick(f"r{k}", None), fingerprint="f", status=pick("pending", "posted", "posted"), id=t["id"] if k % 6 else 900 + k, seen=dt.date(2023, 1, 1))
        for k, t in enumerate(stored)
    ]
    drafts = []
    for n in range(60):
        k = rng.randrange(35)
        base = stored[k] if k < 30 else dict(stored[k - 30], amount=77 + n)
        moved = dict(date=base["date"] + dt.timedelta(days=rng.randrange(4)), amount=base["amount"], merchant=base["merchant"], memo=pick(base["memo"], None, "new"))
        drafts.append(dict(draft=1000 + n, source=pick("bank", "bank", "manualImport"), account=base["account"], external_id=pick(f"e{k}", f"x{n % 20}", None), pending_id=pick(f"p{k}", None, None), reference=pick(f"r{k}", None), fingerprint=pick("f", "f", "g"), status="posted", **moved))
    return drafts, identities, stored


@pytest.mark.parametrize("seed", range(4))
def test_imports_are_those_of_a_plain_loop(spark, seed):
    drafts, identities, stored = _random_tables(seed)
    frames = spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(identities, IDENTITIES), spark.createDataFrame(stored, STORED)
    out = imports.reconciled(*frames, FIELDS, F.lit(DAY))
    transactions, names, what = _plain(drafts, identities, stored)
    assert {r.draft: (r.id, r.identity, r.alike, r.outcome) for r in out.outcomes.collect()} == what
    assert {r.id: r.asDict() for r in out.transactions.collect()} == transactions
    assert {r.identity: r.asDict() for r in out.identities.collect()} == names
    assert {o[3] for o in what.values()} >= {"inserted", "updated", "unchanged"}


def test_a_repeated_import_changes_nothing(spark, tmp_path):
    drafts, identities, stored = _random_tables(9)
    drafts = [dict(d, external_id=f"e{n}", pending_id=None, reference=None, source="bank") for n, d in enumerate(drafts)]
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"transactions": spark.createDataFrame(stored, STORED), "identities": spark.createDataFrame(identities, IDENTITIES)}, 0)
    frame = spark.createDataFrame(drafts, DRAFTS)
    imports.import_into(store, frame, FIELDS, F.lit(DAY))
    once = sorted(map(str, store.tables()["transactions"].collect()))
    again = imports.import_into(store, frame.withColumn("draft", F.col("draft") + 5000), FIELDS, F.lit(DAY)).first()
    assert again.inserted == 0 and again.alike == 0 and again.reconciled == len(drafts)
    assert once == sorted(map(str, store.tables()["transactions"].collect()))
    third = imports.import_into(store, frame.withColumn("draft", F.col("draft") + 9000), FIELDS, F.lit(DAY)).first()
    assert third.inserted == 0 and third.updated == again.updated


def test_imports_of_nothing_and_into_nothing(spark):
    drafts, identities, stored = _random_tables(3)
    none = [spark.createDataFrame([], s) for s in (DRAFTS, IDENTITIES, STORED)]
    some = [spark.createDataFrame(r, s) for r, s in ((drafts, DRAFTS), (identities, IDENTITIES), (stored, STORED))]
    out = imports.reconciled(none[0], some[1], some[2], FIELDS, F.lit(DAY))
    assert out.transactions.count() == len(stored) and imports.summary(out.outcomes).first().reconciled == 0
    out = imports.reconciled(some[0], none[1], none[2], FIELDS, F.lit(DAY))
    row = imports.summary(out.outcomes).first()
    assert row.inserted == out.transactions.count() and row.reconciled == len(drafts)


CACHE = "merchant_raw string, canonical string, service_category string, kind string, affinity double, confidence double, version int, updated timestamp, corrected boolean"
NOW = "2024-07-01"


def test_cache_rows_that_may_be_used(spark):
    day = lambda d: dt.datetime(2024, 7, 1) - dt.timedelta(days=d)
    rows = [
        ("A1", "A", "Music", "k", 0.5, 0.9, 5, day(1), False), ("A2", "A", "Music", "k", 0.5, 0.1, 0, day(999), True),
        ("B", "B", "Music", "k", 0.5, 0.9, 4, day(1), False), ("C", "C", "Music", "k", 0.5, 0.9, 5, day(181), False), ("D", "D", "Music", "k", 0.5, 0.64, 5, day(1), False),
        ("E", "E", "Uncategorized", "k", 0.5, 0.9, 5, day(1), False), ("F", "F", "Music", "k", 0.5, 0.65, 5, day(180), False), ("G", "G", None, "k", 0.5, 0.9, 5, day(1), False),
    ]
    cache = spark.createDataFrame(rows, CACHE)
    asked = spark.createDataFrame([("A1", "A"), ("A9", "A"), ("B", "B"), ("C", "C"), ("D", "D"), ("E", "E"), ("F", "other"), ("G", "G"), ("A1", "none")], "merchant_raw string, canonical string")
    got = {(r.merchant_raw, r.asked): r.cached_raw for r in imports.reused(asked, cache, F.lit(NOW).cast("timestamp")).collect()}
    assert got == {("A1", "A"): "A2", ("A9", "A"): "A2", ("F", "other"): "F", ("A1", "none"): "A1"}
    new = spark.createDataFrame([("A2", "AA", "Film", "k", 0.1, 0.2, True), ("Z", "Z", "Film", "k", 0.1, 0.2, False)], "merchant_raw string, canonical string, service_category string, kind string, affinity double, confidence double, current boolean")
    after = {r.merchant_raw: (r.canonical, r.version, r.corrected) for r in imports.cached(cache, new, F.lit(NOW).cast("timestamp")).collect()}
    assert len(after) == 9 and after["A2"] == ("AA", 5, True) and after["Z"] == ("Z", 0, False) and after["B"] == ("B", 4, False)


def test_rules_of_decisions(spark):
    corrections = spark.createDataFrame([(1, "Acme", False), (2, "Beta", False), (3, "Gamma", True), (4, None, False)], "id int, canonical string, is_subscription boolean")
    reviews = spark.createDataFrame(
        [(1, "Beta", False, True, None, None, None, None), (2, "Delta", True, False, 5.0, "EUR", None, None), (3, "Echo", False, False, None, None, None, None), (4, "Fox", False, False, 40.0, " ", None, None)],
        "id int, canonical string, false_positive boolean, confirmed boolean, price double, currency string, cadence string, status string",
    )
    subscriptions = spark.createDataFrame([(10, "Beta", True, False, 8.0, "USD", 0.4), (11, "Gamma", False, True, 100.0, "USD", 0.9), (12, "Hotel", False, False, 1.0, "USD", 0.9)], "id int, canonical string, confirmed boolean, manual boolean, price double, currency string, score double")
    charges = spark.createDataFrame([("Beta", "BETA 1"), ("Beta", "BETA 2"), ("Beta", "BETA 1"), ("Acme", "ACME")], "merchant string, merchant_raw string")
    nothing = "_key string, canonical string, negative boolean, origin string, subscription int, price double, currency string, confidence double, priority int, raw_merchants array<string>, required array<string>, low double, high double"
    first = derived.derived_rules(spark.createDataFrame([], nothing), corrections, reviews, subscriptions, charges)
    got = {r._key: (r.priority, r.subscription, r.price, r.currency, r.low, r.high, r.raw_merchants, r.outcome) for r in first.collect()}
    assert got == {
        "acme|negative|userCorrection": (1100, None, None, None, None, None, ["ACME"], "inserted"), "beta|positive|reviewRule": (900, 10, 8.0, "USD", 5.5, 10.5, ["BETA 1", "BETA 2"], "inserted"),
        "delta|negative|reviewRule": (1000, None, None, "EUR", None, None, [], "inserted"), "fox|positive|reviewRule": (900, None, 40.0, None, 35.2, 44.8, [], "inserted"),
        "beta|positive|confirmedSubscription": (850, 10, 8.0, "USD", 5.5, 10.5, ["BETA 1", "BETA 2"], "inserted"), "gamma|positive|confirmedSubscription": (700, 11, 100.0, "USD", 88.0, 112.0, [], "inserted"),
    }
    turned = spark.createDataFrame([(5, "DELTA", False, True, None, None, None, None), (6, "Acme", False, True, None, None, None, None)], reviews.schema)
    second = derived.derived_rules(first.drop("outcome"), corrections, turned, subscriptions.where("id = 11"), charges)
    assert {r._key: r.outcome for r in second.collect()} == {
        "beta|negative|userCorrection": "inserted", "beta|positive|reviewRule": "kept", "delta|positive|reviewRule": "inserted", "fox|positive|reviewRule": "kept",
        "beta|positive|confirmedSubscription": "kept", "gamma|positive|confirmedSubscription": "updated", "acme|positive|reviewRule": "inserted",
    }


def test_hidden_scopes(spark):
    hidden = spark.createDataFrame([(1, "Acme Music"), (2, "Empty")], "subscription int, canonical string")
    rows = [(1, "ACME", "a", "usd", "bank", None, -10.0), (1, "ACME 2", "a", "USD", "bank", None, -12.0), (1, "ACME", " ", None, "file", "i1", -1.0), (3, "X", "a", "USD", "bank", None, -1.0)]
    charges = spark.createDataFrame(rows, "subscription int, merchant_raw string, account string, currency string, source string, import string, amount double")
    got = {r.source: r for r in derived.hidden_rules(hidden, charges).collect()}
    assert set(got) == {"bank", "file"}
    a, b = got["bank"], got["file"]
    assert (a.account, a.currency, a.scope, a.n_spellings, a.price, round(a.low, 6), round(a.high, 6)) == ("a", "USD", None, 2, 12.0, 9.76, 12.24)
    assert (b.account, b.currency, b.scope, round(b.low, 6), round(b.high, 6)) == (None, None, ["i1"], 0.95, 1.05)
    again = derived.hidden_rules(hidden, charges.unionByName(charges.limit(1)).repartition(3)).collect()
    assert {r.scope_key for r in again} == {a.scope_key, b.scope_key}
    other = derived.hidden_rules(hidden, charges.withColumn("amount", F.col("amount") - 1)).collect()
    assert not {r.scope_key for r in other} & {a.scope_key, b.scope_key}
    assert derived.hidden_spellings(hidden, charges).count() == 3
