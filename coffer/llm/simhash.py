"""Near duplicates by SimHash fingerprints, found by the generalised pigeonhole principle.

The 64 bits are grouped into m partitions, correlated bits together. If the
thresholds t of the partitions add up to d - m + 1, two fingerprints at distance d
or less are within t in one partition at least. So every fingerprint
gets its own thresholds, by dynamic programming on the candidates that
histograms of all fingerprints let it expect: partitions in which it looks like
many others get -1, which probes nothing. It probes each partition with
every value within its threshold, and what it meets is verified.

A fingerprint that would meet more candidates than it has one-bit neighbours is
linked by those neighbours instead: two fingerprints differ in two bits or fewer
exactly if they share such a neighbour (or one is the other's). All that share a
neighbour are linked, so a chain to the least of them says the same as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, slices, written
from .components import connected_components

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
#: Numbers of partitions to choose from; the one with the least expected cost over all fingerprints is taken.
PARTITIONS = (2, 3, 4, 5)
#: Bits of one histogram.
HISTOGRAM_BITS = 8
#: Candidates of a probed value beyond which a fingerprint goes by its neighbours: as many as it has, itself included.
MOST = BITS + 1

_ROW = np.arange(BITS)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The majority of the bits of all shingles' hashes, repeats included; zero without words."""
    words = text.lower().split()  # bytes: only A-Z change, and only 0x20 and 0x09 to 0x0D separate
    if not words:
        return 0
    joined, k = b" ".join(words), min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[k - 1 :].tolist()
    cuts = map(joined.__getitem__, map(slice, starts.tolist(), ends))
    ones, n, most = np.zeros(BITS, np.int64), len(ends), 1 << 16
    for lo in range(0, n, most):
        h = np.fromiter((xxhash.xxh64_intdigest(c, SEED) for c, _ in zip(cuts, repeat(None, min(most, n - lo)))), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = part.column(1).cast(pa.binary())
            found = pa.array([fingerprint(t.as_py() or b"", size) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "print"])

    return run


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, print): the fingerprint of each whole text as a long. A null, empty or blank text has zero."""
    rows = df.select(column(df, id_col).cast("long").alias("doc_id"), column(df, text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id bigint, print bigint")


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many prints have two bits both set: the diagonal counts single bits; the last row all prints."""
    total = np.zeros((BITS, BITS), np.int64)
    n = 0
    for batch in batches:
        b = _bits(batch.column(0).to_numpy()).astype(np.float32)
        for lo in range(0, len(b), 1 << 20):
            total += (b[lo : lo + (1 << 20)].T @ b[lo : lo + (1 << 20)]).astype(np.int64)
        n += len(b)
    cells = np.append(total.ravel(), n)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "n"])


def _summed(counts: DataFrame, size: int) -> np.ndarray:
    """The sums of the tasks' counts by cell: as many numbers as cells, whatever the table."""
    out = np.zeros(size, np.int64)
    for row in counts.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0").collect():
        out[row["cell"]] = row["n"]
    return out


def grouped_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of about equal width; each grows by the bit that is most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    left, out = set(range(BITS)), []
    for width in [BITS // m + (i < BITS % m) for i in range(m)]:
        free = sorted(left)
        own = [free[int(like[np.ix_(free, free)].sum(axis=1).argmax())]]
        left -= set(own)
        while len(own) < width:
            free = sorted(left)
            own.append(free[int(like[np.ix_(free, own)].sum(axis=1).argmax())])
            left.discard(own[-1])
        out.append(own)
    return out


def _values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """The value that a partition's bits spell."""
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part) - 1, -1, -1, dtype=np.int64))


def _cuts(part: list[int]) -> list[list[int]]:
    return [part[i : i + HISTOGRAM_BITS] for i in range(0, len(part), HISTOGRAM_BITS)]


def _histograms(plans: list[list[list[int]]]):
    cuts = [c for plan in plans for part in plan for c in _cuts(part)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cuts), 1 << HISTOGRAM_BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy())
            for k, c in enumerate(cuts):
                total[k] += np.bincount(_values(bits, c), minlength=1 << HISTOGRAM_BITS)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], names=["cell", "n"])

    return run


_NEAR = np.array([[bin(a ^ b).count("1") for b in range(1 << HISTOGRAM_BITS)] for a in range(1 << HISTOGRAM_BITS)])


class Plan:
    """Partitions, and for every value of eight bits of one the share of prints at each distance from it."""

    def __init__(self, parts: list[list[int]], counts: np.ndarray, n: int):
        self.parts, self.n, self.shares, at = parts, n, [], 0
        for part in parts:
            own = []
            for _ in _cuts(part):
                own.append(np.stack([(_NEAR == e) @ counts[at] / max(n, 1) for e in range(DISTANCE + 1)], axis=1))
                at += 1
            self.shares.append(own)

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """By print, partition and threshold (-1, 0, ...): expected candidates and the values to probe."""
        out = np.zeros((len(bits), len(self.parts), DISTANCE + 2))
        for i, part in enumerate(self.parts):
            far = None
            for c, shares in zip(_cuts(part), self.shares[i]):
                own = shares[_values(bits, c)]
                if far is None:
                    far = own
                else:
                    far = np.stack([sum(far[:, e] * own[:, d - e] for e in range(d + 1)) for d in range(DISTANCE + 1)], axis=1)
            probes = np.cumsum([sum(1 for _ in combinations(part, e)) for e in range(DISTANCE + 1)])
            out[:, i, 1:] = np.cumsum(far, axis=1) * self.n + probes
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each print's thresholds of least cost that add up to DISTANCE - m + 1, and that cost."""
        cost, m = self.costs(bits), len(self.parts)
        most = (DISTANCE + 1) * m  # sums are counted from -m
        best = np.full((len(bits), most + 1), np.inf)
        best[:, 0], came = 0.0, []
        for i in range(m):
            options = np.full((len(bits), most + 1, DISTANCE + 2), np.inf)
            for t in range(DISTANCE + 2):
                options[:, t:, t] = best[:, : most + 1 - t] + cost[:, i, t][:, None]
            came.append(options.argmin(axis=2))
            best = options.min(axis=2)
        at = np.full(len(bits), DISTANCE + 1)
        total, out = best[np.arange(len(bits)), at], np.zeros((len(bits), m), np.int64)
        for i in reversed(range(m)):
            out[:, i] = came[i][np.arange(len(bits)), at]
            at = at - out[:, i]
        return out - 1, total


def _key(part: int, values: np.ndarray) -> np.ndarray:
    return (np.int64(part) << np.int64(48)) | values


#: Prints whose thresholds are found at once.
AT_ONCE = 1 << 15


def _costs(plans: list[Plan]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plans))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy())
            for lo in range(0, len(bits), AT_ONCE):
                total += [np.minimum(p.thresholds(bits[lo : lo + AT_ONCE])[1], MOST * len(p.parts)).sum() for p in plans]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(plans)), pa.int32()), pa.array(np.ceil(total).astype(np.int64))], names=["cell", "n"])

    return run


def _indexed(parts: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy()
            bits = _bits(prints)
            keys = np.concatenate([_key(i, _values(bits, p)) for i, p in enumerate(parts)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(prints, len(parts)))], names=["key", "print"])

    return run


def _probes(plan: Plan):
    """Rows (key, print): the values that each print looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                prints = batch.column(0).slice(lo, AT_ONCE).to_numpy()
                bits = _bits(prints)
                limits, _ = plan.thresholds(bits)
                keys, owners = [], []
                for i, part in enumerate(plan.parts):
                    values = _values(bits, part)
                    for e in range(DISTANCE + 1):
                        asks = limits[:, i] >= e
                        if not asks.any():
                            continue
                        for flipped in combinations(range(len(part)), e):
                            keys.append(_key(i, values[asks] ^ sum(1 << b for b in flipped)))
                            owners.append(prints[asks])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "print"])

    return run


def chosen_plan(prints: DataFrame) -> Plan:
    """The partitions of least expected cost for these distinct prints. Only counts of bits and bytes reach the driver."""
    cells = _summed(prints.mapInArrow(_together, "cell int, n bigint"), BITS * BITS + 1)
    n, together = int(cells[-1]), cells[:-1].reshape(BITS, BITS)
    grouped = [grouped_bits(together, n, m) for m in PARTITIONS]
    sizes = [sum(len(_cuts(p)) for p in g) for g in grouped]
    width = 1 << HISTOGRAM_BITS
    counts = _summed(prints.mapInArrow(_histograms(grouped), "cell int, n bigint"), sum(sizes) * width).reshape(-1, width)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    plans = [Plan(g, counts[a:b], n) for g, a, b in zip(grouped, starts, starts[1:])]
    total = _summed(prints.mapInArrow(_costs(plans), "cell int, n bigint"), len(plans))
    return plans[int(total.argmin())]


def close_links(prints: DataFrame) -> DataFrame:
    """Rows (a, b) of distinct prints that differ in two bits or fewer: all such pairs, or chains of them where many are close."""
    plan = chosen_plan(prints)
    index = prints.mapInArrow(_indexed(plan.parts), "key bigint, print bigint")
    probes = written(prints.mapInArrow(_probes(plan), "key bigint, print bigint"), "probes")
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > MOST).select("key"), "large")
    crowded = written(probes.join(large, "key", "left_semi").select("print").distinct(), "crowded")
    own = probes.join(crowded, "print", "left_anti").select("key", F.col("print").alias("a"))
    seen = index.join(large, "key", "left_anti").select("key", F.col("print").alias("b"))
    met = own.join(seen, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    ones = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < BITS - 1 else -(1 << b)).cast("long") for b in range(BITS)])
    flips = crowded.select("print", F.explode(F.transform(ones, lambda x: F.col("print").bitwiseXOR(x))).alias("key"))
    least = flips.groupBy("key").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    shared = flips.join(least, "key").select(F.col("print").alias("a"), "b").where("a <> b")
    return met.unionByName(shared)


def near_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hexadecimal digits) and component_id, the least id that links reach.

    Fingerprints link at two or fewer differing bits, equal ones included. Null, empty and
    blank texts have the fingerprint zero and link like any other; a text of fewer
    words than a shingle has one shingle of all of them. Rows with a null id take
    part, and a component of such rows alone has a null id; repeated rows come out
    as often as they stand in ``df``; an empty table gives an empty result; other
    columns are left out.
    """
    rows = written(fingerprints(df, text_col, id_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    groups = connected_components(close_links(distinct.select("print")))
    rooted = distinct.join(groups.select(F.col("node").alias("print"), "root"), "print", "left")
    rooted = written(rooted.select("print", "first", F.coalesce("root", "print").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = written(rooted.join(least, "root").select("print", "component_id"), "named")
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; edge cases as in ``near_groups``."""
    return near_groups(documents(spark, sf_dir))
