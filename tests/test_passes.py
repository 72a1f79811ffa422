"""Identities, clusters and the ordered passes against plain loops and a ledger of known outcomes."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from coffer import registry
from coffer.functions import predicates
from coffer.operators import clusters, histories, matching, passes, replay, rules
from coffer.plans.staging import staged

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_by_a_greedy_loop(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.randrange(25), f"o{rng.randrange(20)}"): rng.randrange(1, 5) for _ in range(180)}.items())
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in rows] + [(None, "o1", 9), (3, None, 9)], "a int, b string, n int")
    lefts, rights, want = set(), set(), []
    for (a, b), n in sorted(rows, key=lambda r: (-r[1], r[0])):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            want.append((a, b, n))
    got = matching.largest_overlaps(frame, "a", "b", [-F.col("n")])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert matching.largest_overlaps(frame.limit(0), "a", "b", [-F.col("n")]).collect() == []


def test_overlaps_write_few_rows(spark, monkeypatch):
    """All rows are written once; the rounds write the first rows of each left."""
    written = []

    def counted(df):
        out = staged(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(matching, "staged", counted)
    rng = random.Random(3)
    rows = [(a, b, rng.choice([1, 1, 1, 2])) for a in range(100) for b in rng.sample(range(1000), 300)]
    frame = spark.createDataFrame(rows, "a int, b int, n int")
    lefts, rights, want = set(), set(), []
    for a, b, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            want.append((a, b, n))
    assert sorted(map(tuple, matching.largest_overlaps(frame, "a", "b", [-F.col("n"), F.col("a")]).collect())) == sorted(want)
    assert sum(written) < 2 * len(rows)


def test_overlaps_widen_a_left_that_a_wider_one_puts_out(spark):
    """B asks r16 only when it has lost its first 16 rows; A then has none of its own left, but for one beyond them."""
    rows = [(f"D{i:02}", f"r{i:02}", 100) for i in range(16)]
    rows += [("B", f"r{i:02}", 50) for i in range(17)] + [("A", f"r{i:02}", 10) for i in range(1, 18)]
    frame = spark.createDataFrame(rows, "a string, b string, n int")
    got = matching.largest_overlaps(frame, "a", "b", [-F.col("n"), F.col("a")])
    assert sorted(map(tuple, got.collect())) == sorted([*rows[:16], ("A", "r17", 10), ("B", "r16", 50)])


def _may(charge, name, links, charges, owner):
    """The guards for one charge, by a look at all links."""
    before = owner.get(charge["id"])
    held = [charges[i] for i, n in links.items() if n == name]
    if not held:
        return True
    if before not in (None, name):
        return False
    if replay.HISTORY in name:
        return before == name
    if all(x["account"] != charge["account"] for x in held):
        return False
    if before == name:
        return True
    return not any(n != name and charges[i]["merchant"].lower() == name.lower() and charges[i]["account"] == charge["account"] and (charges[i]["currency"] or "USD").upper() == (charge["currency"] or "USD").upper() for i, n in links.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_by_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    merchants = ["Alpha", "Beta", "Gamma", "Delta", "alpha"]
    names = ["Alpha", "Beta", "Gamma", "Delta:history:3", "Epsilon"]
    charges = [{"id": i, "account": rng.choice(["a", "b", None]), "currency": rng.choice(["USD", "usd", None, "EUR"]), "merchant": rng.choice(merchants)} for i in range(60)]
    links = {i: rng.choice(names) for i in range(60) if rng.random() < 0.2}
    owner = {i: rng.choice(names) for i in range(60) if rng.random() < 0.4}
    told = [(r, rng.choice(names), rng.randrange(3)) for r in range(7)]
    found = sorted({(rng.randrange(60), rng.randrange(7)) for _ in range(120)})
    state, want, by_id = dict(links), [], {c["id"]: c for c in charges}
    for rule, name, _ in sorted(told, key=lambda r: (-r[2], r[0])):
        matched = [i for i, r in found if r == rule and i not in state and _may(by_id[i], name, state, by_id, owner)]
        want += [(i, rule, name) for i in matched]
        state |= {i: name for i in matched}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = replay.replay(
        frame(found, "id int, rule int"), frame(told, "rule int, canonical string, priority int"), frame([tuple(c.values()) for c in charges], "id int, account string, currency string, merchant string"),
        frame(list(links.items()), "id int, canonical string"), frame(list(owner.items()), "id int, owner string"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_replay_reads_its_frames_once(spark):
    """However many rounds the rules take, the given charges are not read anew in each."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    schema = "id int, account string, currency string, merchant string"
    charges = spark.createDataFrame([(i, "a", "USD", "Alpha") for i in range(8)], schema).mapInArrow(counted, schema)
    told = spark.createDataFrame([(r, f"Name {r}", r) for r in range(8)], "rule int, canonical string, priority int")
    found = spark.createDataFrame([(i, r) for i in range(8) for r in range(8)], "id int, rule int")
    links, owners = spark.createDataFrame([(99, "Alpha")], "id int, canonical string"), spark.createDataFrame([], "id int, owner string")
    got = replay.replay(found, told, charges, links, owners).collect()
    assert sorted(map(tuple, got)) == [(i, 7, "Name 7") for i in range(8)]
    assert reads.value <= 4 * 8


def test_replay_keeps_size_estimates_small(spark, monkeypatch):
    """However many rounds the rules take, the sizes that Spark estimates have no more digits than at first."""
    bits = []

    def sized(df):
        out = staged(df)
        n = out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        bits.append(n.bit_length() if isinstance(n, int) else n.bigInteger().bitLength())
        return out

    monkeypatch.setattr(replay, "staged", sized)
    charges = spark.createDataFrame([(i, "a", "USD", "Alpha") for i in range(4)], "id int, account string, currency string, merchant string")
    told = spark.createDataFrame([(r, f"Name {r}", r) for r in range(7)], "rule int, canonical string, priority int")
    found = spark.createDataFrame([(i, r) for i in range(4) for r in range(7)], "id int, rule int")
    links, owners = spark.createDataFrame([(99, "Alpha")], "id int, canonical string"), spark.createDataFrame([], "id int, owner string")
    got = replay.replay(found, told, charges, links, owners).collect()
    assert sorted(map(tuple, got)) == [(i, 6, "Name 6") for i in range(4)]
    assert len(bits) > 7 and max(bits) < 1000


def test_words_are_looked_up_once(spark):
    """Flags that a frame holds are not made again, and a charge is read once for its bucket."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    schema = "id int, currency string, account string, confidence double, merchant string, merchant_raw string, memo string, category string, kind string"
    rows = [(i, "usd", "a", 0.5 + i / 10, "Netflix", "NETFLIX 1", "monthly subscription", "streaming", "mediaStreaming") for i in range(4)]
    marked = predicates.flags(spark.createDataFrame(rows, schema))
    assert set(predicates.FLAGS) <= set(marked.columns) and predicates.flags(marked) is marked
    got = histories.history_key(spark.createDataFrame(rows, schema).mapInArrow(counted, schema)).collect()
    assert [(r.id, r.bucket.split("|")[0]) for r in sorted(got)] == [(i, "USD") for i in range(4)]
    assert reads.value == 4


def _first_near(amounts, absolute, share):
    """Amounts in rising order to the first cluster whose mean is near."""
    found = []
    for a in sorted(amounts):
        near = [c for c in found if abs(sum(c) / len(c) - a) <= max(absolute, share * sum(c) / len(c))]
        near[0].append(a) if near else found.append([a])
    return sorted(c for c in found if len(c) > 1)


@pytest.mark.parametrize("mode", ["primary", "fallback"])
def test_fragments_widen_with_use(spark, mode):
    """Charges a day apart have no calendar, so all are fragments; the profile goes by kind, affinity and wording."""
    rng = random.Random(4)
    kinds = {"plain": ("generalRetail", 0.1, "thanks"), "soft": ("softwareOrSaaS", 0.2, "thanks"), "high": ("subscriptionService", 0.9, "thanks"), "low": ("subscriptionService", 0.5, "thanks"), "words": ("unknown", 0.1, "metered compute")}
    rows, k = [], 0
    for bucket, (kind, affinity, memo) in kinds.items():
        for _ in range(14):
            rows.append((k, bucket, date(2024, 1, 1), -round(rng.uniform(1, 90), 2), kind, affinity, memo, "", "X", "X"))
            k += 1
    frame = spark.createDataFrame(rows, "id int, bucket string, date date, amount double, kind string, affinity double, memo string, category string, merchant_raw string, merchant string")
    amount = {r[0]: -r[3] for r in rows}
    found = {}
    for r in clusters.candidate_clusters(frame, ["bucket"], mode).collect():
        assert r.cadence is None
        found.setdefault((r.bucket, r.part), []).append(amount[r.id])
    for bucket in kinds:
        profile = clusters.TOLERANCE[mode] if bucket in ("plain", "low") else clusters.TOLERANCE_OF_USE[mode]
        assert sorted(sorted(v) for (b, _), v in found.items() if b == bucket) == _first_near([-r[3] for r in rows if r[1] == bucket], *profile)


def _monthly(start, n):
    return [date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, start.day) for i in range(n)]


@pytest.fixture(scope="module")
def outcome(spark):
    """A ledger with one case of each pass, run once: (rows by id, ids by case)."""
    rows, cases = [], {}

    def add(case, merchant, dates, amounts, memo="", category="", kind="subscriptionService", affinity=0.95, confidence=0.95, account="main", raw=None):
        for d, a in zip(dates, amounts if isinstance(amounts, list) else [amounts] * len(dates)):
            cases.setdefault(case, []).append(len(rows))
            rows.append((len(rows), account, "USD", d, a, raw or merchant.upper(), merchant, memo, category, kind, affinity, confidence))

    day = date(2024, 1, 10)
    add("plain", "Streamly", _monthly(day, 6), -9.99, "monthly subscription")
    add("suppressed", "Gymnast", _monthly(day, 6), -30.0, "membership plan")
    add("grocery", "Fresh Market", [day + timedelta(days=i * 3 + i * i % 5) for i in range(9)], [-20.0 - 7 * (i % 4) for i in range(9)], "weekly shop", "groceries", "groceryRetailer", 0.08, 0.9)
    add("one account", "Paperly", _monthly(day, 6), -5.0, "monthly plan", account="a")
    add("other account", "Paperly", _monthly(day + timedelta(days=9), 6), -5.0, "monthly plan", account="b")
    add("kept name", "Renamed", _monthly(day, 6), -12.0, "monthly subscription")
    add("replayed", "Oddly", [day, day + timedelta(days=5)], [-40.0, -90.0], "", "", "unknown", 0.1, 0.5)
    add("recent", "Cloudbox", [date(2024, 6, 20)], -11.0, "premium subscription")
    add("old", "Longago", [date(2023, 1, 5)], -11.0, "premium subscription")
    add("credit", "Streamly", [date(2024, 3, 3)], 9.99, "monthly subscription")
    schema = "id long, account string, currency string, date date, amount double, merchant_raw string, merchant string, memo string, category string, kind string, affinity double, confidence double"
    charges = spark.createDataFrame(rows, schema).withColumn("cluster", F.lit(0))
    empty = []
    told = [(1, "Gymnast", False, True, 1100, None, None, empty, ["gymnast"], empty, None, None), (2, "Oddly Named", False, False, 500, None, None, ["ODDLY"], empty, empty, None, None), (3, "Streamly", False, False, 900, None, None, ["STREAMLY"], empty, empty, None, None)]
    given = spark.createDataFrame(told, "rule int, canonical string, owns boolean, negative boolean, priority int, account string, currency string, raw_merchants array<string>, required array<string>, excluded array<string>, low double, high double")
    previous = spark.createDataFrame([(i, "Former Name") for i in cases["kept name"][:4]] + [(cases["plain"][0], None)], "id long, owner string")
    confirmed = spark.createDataFrame([], "canonical string")
    return {r.id: r for r in passes.run(charges, given, previous, confirmed, "2024-07-01").collect()}, cases


@pytest.mark.parametrize(
    ("case", "step", "canonical", "rule"),
    [("plain", "primary", "Streamly", None), ("suppressed", "suppressed", None, "1"), ("grocery", "none", None, None), ("kept name", "primary", "Former Name", None), ("replayed", "rule", "Oddly Named", "2"), ("recent", "recent", "Cloudbox", None), ("old", "none", None, None)],
)
def test_outcome_of_each_pass(outcome, case, step, canonical, rule):
    got, cases = outcome
    assert {(got[i]["pass"], got[i].canonical, got[i].rule) for i in cases[case]} == {(step, canonical, rule)}


def test_histories_of_one_merchant_have_names_of_their_own(outcome):
    got, cases = outcome
    assert {got[i].canonical for i in cases["one account"]} == {f"Paperly:history:{cases['one account'][0]}"}
    assert {got[i].canonical for i in cases["other account"]} == {f"Paperly:history:{cases['other account'][0]}"}
    assert not set(cases["credit"]) & set(got)
    assert {got[i].disposition for i in cases["plain"]} == {"detected"} and {got[i].disposition for i in cases["recent"]} == {"needsReview"}


def test_run_over_the_tables(spark):
    """Every debit comes once, a name belongs to one pass but for rules, and links agree with the rules that made them."""
    from coffer.engine_queries import _rules
    from coffer.plans.views import ledger

    got = registry.QUERIES["pip_run"](spark, SMALL).collect()
    assert Counter(r.id for r in got) == Counter(r.id for r in ledger(spark, SMALL).where("amount < 0").select("id").collect())
    names = {}
    for r in got:
        if r["pass"] in ("primary", "fallback", "recent"):
            names.setdefault(r.canonical, set()).add(r["pass"])
            assert r.disposition in ("detected", "needsReview") and (r["pass"] == "primary" or r.disposition == "needsReview")
    assert names and all(len(v) == 1 for v in names.values())
    charges = ledger(spark, SMALL).withColumns({"account": F.concat(F.lit("a"), (F.col("id") % 2).cast("string")), "currency": F.lit("USD")})
    found = rules.matches(charges.where("amount < 0"), _rules(spark, SMALL)).collect()
    against = {r.id for r in found if r.negative}
    assert {r.id for r in got if r["pass"] == "suppressed"} == against
    assert {(r.id, r.rule) for r in got if r["pass"] == "rule"} <= {(r.id, str(r.rule)) for r in found if not r.negative}
