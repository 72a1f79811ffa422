"""Packing token sequences by a configuration linear program over the length histogram.

Only the histogram (one count per length, so at most ``capacity`` numbers) comes
to the driver. There a configuration is a multiset of lengths that fits into one
sequence. The program "use each configuration x times, cover every length's
count, use as few as possible" is solved by multiplicative weights: a length's
weight is multiplied down as it is covered, and the next configurations are the most
valuable ones under the weights, found by dynamic programming over the capacity; the
same weights bound the program from below (``solve``). Whole parts of the solution are kept; what is left over, a few items per
configuration, is packed best-fit by decreasing length.

Spark then ranks the pieces of each length and looks up the place that the plan
holds for that rank.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import REMEMBERED, encoder
from .common import column, documents, slices, written

#: The ranks of the vocabulary byte_bpe_50k.json.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longer pieces are encoded in halves.
LONG_PIECE = 256
CAPACITY = 2048
#: Share of the scarcest length's count that one step of the solver covers.
STEP = 0.25
#: How fast the weights fall, rounds of pricing, configurations taken from one, and how far below the best they may be worth.
ETA, ROUNDS, BATCH, SLACK = 0.2, 300, 48, 0.02
#: What the first weight of a sequence's whole length gets beyond its share.
TILT = 0.05
# Of weights that converge: their fall a cover, steps between two pricings, pricings, new configurations of each, and the gap to the bound that is good enough.
FINE, STEPS, TURNS, FRESH, GAP = 0.1, 1_000, 96, 32, 0.003
#: Rows of one length that one window ranks.
RANK_ROWS = 50_000
END = np.zeros(1, "<u4").tobytes()

Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _added(path: str) -> dict[str, bytes]:
    """Added tokens, with their packed ids, of the tokenizers file beside the ranks; none without such a file."""
    file = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(file):
        return {}
    with open(file, encoding="utf-8") as f:
        return {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(f).get("added_tokens") or []}


class _Pieces:
    """Token ids of the vocabulary, each distinct piece of the pattern encoded once.

    The ids are those of the tokenizers library for the same vocabulary (the tests
    compare them), its added tokens included: they are found in the text before it
    is split. Its encodings carry offsets that are not needed here and cost several
    times the ids, so unseen pieces are encoded by their ranks.
    """

    def __init__(self, path: str, pattern: str):
        self.by = encoder(path, pattern)
        self.plain = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=self.by.ranks, special_tokens={}).encode_ordinary
        self.find, self.known = regex.compile(pattern), {}
        self.added = _added(path)
        # The first alternative counts, so longer ones stand first.
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=lambda t: (-len(t), t))) + ")").split if self.added else None

    def _new(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:  # the tree reduction has no limit on runs
            return self.by.piece(piece)
        packed = self.known[piece] = array("I", self.plain(piece)).tobytes()
        return packed

    def packed(self, text: str) -> bytes:
        if self.split is None or not any(t in text for t in self.added):
            return self._ordinary(text)
        return b"".join(self.added.get(part) or self._ordinary(part) for part in self.split(text))

    def _ordinary(self, text: str) -> bytes:
        pieces = self.find.findall(text)
        parts = list(map(self.known.get, pieces))
        if None in parts:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            get = self.known.get
            parts = [(get(p) or self._new(p)) if t is None else t for p, t in zip(pieces, parts)]
        return b"".join(parts)


@lru_cache(maxsize=2)
def _pieces(path: str, pattern: str) -> _Pieces:
    return _Pieces(path, pattern)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids (packed, 32 bits each).

    A document is its ids and a final id 0, so null and empty texts have one piece
    of length 1. Repeated rows give their pieces each.
    """
    path, pattern = vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    kind = dict(df.select(column(df, id_col).alias("i")).dtypes)["i"]
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            by, at, rows = _pieces(path, pattern), [], []
            for i, text in enumerate(batch.column(1)):
                packed = by.packed(text.as_py() or "") + END
                for k, (start, n) in enumerate(cut(len(packed) // 4, capacity)):
                    own = packed[4 * start : 4 * (start + n)]
                    at.append(i)
                    rows.append((k, start, n, zlib.crc32(own)) + ((own,) if keep_ids else ()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            )

    return df.select(column(df, id_col).alias("id"), column(df, text_col).cast("string").alias("text")).mapInArrow(run, schema)


def priced(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int) -> tuple[list[Configuration], float]:
    """Up to ``most`` of the most valuable multisets of sizes that fit, by dynamic programming over the capacity, and the best value.

    The first is the best one; the others begin with another size and fill the
    rest of the room in the best way.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    ends = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    reach = np.zeros(0)
    for c in range(int(sizes[0]), capacity + 1):
        reach = values[: ends[c]] + best[c - sizes[: ends[c]]]
        k = int(reach.argmax())
        better = reach[k] > best[c - 1]
        best[c], choice[c] = (reach[k], k) if better else (best[c - 1], -1)
    out = []
    for k in np.argsort(-reach, kind="stable")[:most]:
        if reach[k] < (1 - SLACK) * best[capacity]:
            break
        taken, c = Counter([int(k)]), capacity - int(sizes[k])
        while c > 0:
            j = int(choice[c])
            taken[j] += j >= 0
            c -= int(sizes[j]) if j >= 0 else 1
        out.append(tuple(sorted(((int(sizes[j]), n) for j, n in taken.items() if n), reverse=True)))
    return list(dict.fromkeys(out)), float(best[capacity])


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, float]:
    """A fractional cover of the histogram by configurations, and a lower bound of any packing.

    Both come from multiplicative weights. ``covered`` is quick and good where short items fill any room; where its
    rounded cover is not yet within GAP of the bound, ``refined`` lets the weights converge, and the better one counts.
    """
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], np.float64)
    used, bound = covered(sizes, counts, capacity)
    needed = sum(rounded(used, histogram, capacity).values())
    if needed <= (1 + GAP) * np.ceil(bound - 1e-6):
        return used, bound
    other, proven = refined(sizes, counts, capacity, needed)
    if sum(rounded(other, histogram, capacity).values()) < needed:
        used = other
    return used, max(bound, proven)


def covered(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[Counter, float]:
    """A cover in which lengths leave as soon as they are covered.

    Each length has a weight, first its share of the capacity. A round prices
    configurations under the weights and uses each in part; the weight of a length
    then falls by the factor exp(-ETA) for each full cover of its count that was
    used. What is uncovered after the last round is left to the rounding. With no
    configuration worth more than ``best``, the weights over ``best`` are a dual
    solution: no packing has fewer sequences than the counts' weights sum to over it.
    """
    place = {int(s): i for i, s in enumerate(sizes)}
    shares = sizes / capacity
    # Longer is worth a little more than in proportion, as short items fill any room.
    weights = shares * (1 + TILT * shares)
    covered, used = np.zeros(len(sizes)), Counter()
    bound = float(counts @ shares)
    for _ in range(ROUNDS):
        live = np.flatnonzero(covered < 1 - 1e-9)
        if not len(live):
            break
        configs, best = priced(sizes[live], weights[live], capacity, BATCH)
        bound = max(bound, float(counts[live] @ weights[live]) / best)
        for config in configs:
            at, n = np.array([place[s] for s, _ in config]), np.array([k for _, k in config], np.float64)
            step = min(STEP * (counts[at] / n).min(), ((1 - covered[at]) * counts[at] / n).min())
            if step > 0:
                used[config] += step
                covered[at] += step * n / counts[at]
                weights[at] *= np.exp(-ETA * step * n / counts[at])
    return used, bound



def refined(sizes: np.ndarray, counts: np.ndarray, capacity: int, enough: float) -> tuple[Counter, float]:
    """A cover averaged over rounds of weights that converge, and the best bound they prove.

    The lengths share a weight of 1. A step takes the configuration of the pool that is worth most under the weights,
    uses it until it covers one of its lengths once more, and lowers the weights of its lengths by exp(-FINE) a cover, by less in later turns.
    After STEPS of them the weights and their mean are priced by dynamic programming: each proves a bound, and the
    best new configurations join the pool. Means and cover start anew at every power of two, so that early rounds are
    forgotten. Ends when the cover, scaled to cover all, is within GAP of the bound, or the bound reaches ``enough`` - 1.
    """
    shares = sizes / capacity
    place = {int(s): i for i, s in enumerate(sizes)}
    configs: list[Configuration] = [((int(s), capacity // int(s)),) for s in sizes]
    known, pool = set(configs), np.diag((capacity // sizes) / counts)
    weights = counts * shares * (1 + TILT * shares)
    weights /= weights.sum()
    used, cover, mean = np.zeros(len(configs)), np.zeros(len(sizes)), np.zeros(len(sizes))
    bound, cost, kept = 0.0, np.inf, Counter()
    for turn in range(1, TURNS + 1):
        for w in (weights, mean / mean.sum()) if mean.any() else (weights,):
            found, best = priced(sizes, w / counts, capacity, FRESH)
            bound = max(bound, 1 / best)
            fresh = [c for c in found if c not in known]
            known.update(fresh)
            columns = np.zeros((len(sizes), len(fresh)))
            for k, config in enumerate(fresh):
                for s, n in config:
                    columns[place[s], k] = n / counts[place[s]]
            configs += fresh
            pool, used = np.hstack([pool, columns]), np.append(used, np.zeros(len(fresh)))
        if cost <= (1 + GAP) * bound or np.ceil(bound - 1e-6) >= enough:
            break
        if turn & (turn - 1) == 0:
            used[:], cover[:], mean[:] = 0, 0, 0
        worth, rate = weights @ pool, FINE / turn.bit_length()
        for _ in range(STEPS):
            k = int(worth.argmax())
            at = np.flatnonzero(pool[:, k])
            step = 1 / pool[at, k].max()
            used[k] += step
            cover[at] += step * pool[at, k]
            change = weights[at] * np.expm1(-rate * step * pool[at, k])
            weights[at] += change
            worth += change @ pool[at]
            mean += step / weights.sum() * weights
        weights /= weights.sum()
        if cover.min() > 0 and used.sum() / cover.min() < cost:
            cost = used.sum() / cover.min()
            kept = Counter({configs[k]: used[k] / cover.min() for k in np.flatnonzero(used)})
    return kept, bound


def best_fit(left: Counter, capacity: int) -> Counter:
    """Bins for a few leftovers: each item, longest first, goes where least room remains."""
    room: list[int] = []  # sorted free space of the open bins
    bins: dict[int, list[list[int]]] = {}
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            k = bisect_left(room, size)
            if k < len(room):
                free = room.pop(k)
                items = bins[free].pop()
            else:
                free, items = capacity, []
            items.append(size)
            insort(room, free - size)
            bins.setdefault(free - size, []).append(items)
    return Counter(tuple(sorted(Counter(items).items(), reverse=True)) for group in bins.values() for items in group)


def rounded(used: Counter, histogram: dict[int, int], capacity: int) -> Counter:
    """Whole uses of configurations: first their whole parts, fullest first, then one more where all its items are left, then best fit."""
    left, out = Counter({s: n for s, n in histogram.items() if n}), Counter()
    full = lambda c: sum(s * n for s, n in c)
    for most in (lambda c: int(used[c] + 1e-9), lambda c: 1):
        for config in sorted(used, key=lambda c: (-full(c), c)):
            times = min([most(config), *(left[s] // n for s, n in config)])
            if times > 0:
                out[config] += times
                for s, n in config:
                    left[s] -= times * n
    out.update(best_fit(Counter({s: n for s, n in left.items() if n}), capacity))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """How often to use each configuration, so that every item has exactly one place."""
    items = {s: n for s, n in histogram.items() if n}
    return rounded(solve(items, capacity)[0], items, capacity) if items else Counter()


def places(configurations: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, how often in each, offset): where the ranks of a length go."""
    out, rank, base = [], Counter(), 0
    for config, times in sorted(configurations.items(), reverse=True):
        offset = 0
        for size, n in config:
            out.append((size, rank[size], base, n, offset))
            rank[size] += n * times
            offset += n * size
        base += times
    return out


def pack(pieces: DataFrame, keys: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to every row; lengths lie between 1 and the capacity.

    ``keys`` order the rows of a length; rows equal in all of them are alike and
    take each other's places. An empty table stays empty. Columns named
    sequence_id or offset are replaced. ``pieces`` is read twice and should be a
    written table.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}  # one row per length
    total = sum(histogram.values())
    # at least as many as there are tasks, for a length that many documents share
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANK_ROWS)
    held: dict[int, list] = {}
    for size, first, base, n, offset in places(plan(histogram, capacity)):
        held.setdefault(size, []).append((first, base, n, offset))
    # At most a few places per configuration, and at most a few thousand configurations at any size of the input.
    table = spark.createDataFrame(
        [(s, v) for s, v in held.items()], "p_length bigint, p_places array<struct<first:bigint,base:bigint,n:bigint,offset:bigint>>"
    )
    salted = pieces.withColumn("p_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = salted.groupBy(F.col(length_col).alias("c_length"), F.col("p_bucket").alias("c_bucket")).agg(F.count("*").alias("c_n"))
    upto = Window.partitionBy("c_length").orderBy("c_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("c_length", "c_bucket", F.coalesce(F.sum("c_n").over(upto), F.lit(0)).alias("c_before"))
    own = Window.partitionBy(length_col, "p_bucket").orderBy(*keys)
    ranked = salted.withColumn("p_rank", F.row_number().over(own) - 1).join(
        counts, (F.col(length_col) == F.col("c_length")) & (F.col("p_bucket") == F.col("c_bucket"))
    )
    ranked = ranked.withColumn("p_rank", F.col("p_rank") + F.col("c_before"))
    found = ranked.join(F.broadcast(table), F.col(length_col) == F.col("p_length"))
    found = found.withColumn("p_at", F.element_at(F.filter("p_places", lambda p: p["first"] <= F.col("p_rank")), -1))
    step = F.col("p_rank") - F.col("p_at.first")
    return found.select(
        *[column(pieces, c) for c in pieces.columns],
        (F.col("p_at.base") + F.floor(step / F.col("p_at.n"))).cast("long").alias("sequence_id"),
        (F.col("p_at.offset") + step % F.col("p_at.n") * F.col(length_col)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents (doc_id, text) with their places."""
    pieces = written(token_pieces(docs, capacity=capacity), "pieces")
    return pack(pieces, ["id", "piece", "start", "ids_crc32"], capacity=capacity).withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
