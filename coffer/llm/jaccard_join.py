"""Similarity join of texts on word shingles by chosen paths.

A text is the set of its five-word shingles; texts with equal sets are one class.
For a threshold t, a set of n shingles follows every shingle whose hash under the
path so far falls below 1 / (t n): 1/t branches on average, and sets at the
threshold share a branch on average. Sets that share a path share a bucket.
Small buckets are compared by brute force; large ones are split again along the
next step of the paths. All is repeated with fresh hashes until a pair at the
threshold is found with the target recall, even at the greatest depth.

Buckets only propose links, judged by short sketches; the proposed links make
groups, and within a group all pairs are compared by their whole sets. A group too
large for one task is cut into blocks and compared block by block, and only counts
leave a task, not pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, slices, written
from .components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.995
DEPTH = 3
#: Members of a bucket that are compared by brute force; larger ones are split while depth remains.
BUCKET = 128
#: Beyond this a bucket at the greatest depth is proposed whole.
BUCKET_LAST = 4096
SKETCH = 64
#: Share of equal sketch values from which a link is proposed: four deviations below the threshold.
PROPOSE = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)
#: Sets, and shingles, of one block of a group.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_500_000

_U = np.uint64
_A, _B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def repetitions(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a bucket at the greatest depth with this probability.

    Such a pair shares 2t/(1+t) of either set, so 2/(1+t) branches on average at a
    step; whether a path survives d steps follows the recursion of a branching
    process with Poisson offspring.
    """
    mean, alive = 2 / (1 + THRESHOLD), 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-mean * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


_PERMUTATIONS = _mix(np.arange(1, SKETCH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


#: Words whose hashes a worker remembers; beyond that it forgets them all.
REMEMBERED = 100_000


class Shingler:
    """Sets of 64-bit shingle hashes; a worker remembers the hashes of words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}
        self.powers = _mix(np.arange(11, 11 + size, dtype=_U)) | _U(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted and distinct. A text of fewer words has one shingle of all of them, a blank one none."""
        words, known = WORD.findall(text or ""), self.known
        if not words:
            return np.zeros(0, _U)
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        k = min(self.size, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, _U)
        for i in range(k):
            out += h[i : i + n] * self.powers[i]
        return np.unique(_mix(out))


def sketch(s: np.ndarray) -> bytes:
    least = np.full(SKETCH, ~_U(0), _U)
    for lo in range(0, len(s), 4096):
        np.minimum(least, (s[None, lo : lo + 4096] * _PERMUTATIONS[:, None]).min(axis=1), out=least)
    return (_mix(least) >> _U(48)).astype("<u2").tobytes()


def _chosen(s: np.ndarray, prefixes: np.ndarray, below: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, shingle) numbers of the branches: products with an odd number, by their size."""
    odd, found = (prefixes | _U(1))[:, None], []
    for lo in range(0, len(s), 1 << 16):
        at, of = np.nonzero(odd * s[None, lo : lo + (1 << 16)] < below)
        found.append((at, of + lo))
    return tuple(np.concatenate(x) for x in zip(*found))


def paths(s: np.ndarray, runs: int, depth: int, threshold: float) -> np.ndarray:
    """One row per chosen path: a key per step; zeros where no branch was chosen."""
    if not len(s):
        return np.zeros((0, depth), np.int64)
    below = _U(min(2**64 - 1, int(2**64 / (threshold * len(s)))))
    prefixes, keys, rows = _mix(np.arange(1, runs + 1, dtype=_U) * _B), np.zeros((runs, 0), np.int64), []
    for step in range(depth):
        at, of = _chosen(s, prefixes, below)
        if step:
            ended = np.ones(len(prefixes), bool)
            ended[at] = False
            rows.append(np.pad(keys[ended], ((0, 0), (0, depth - step))))
        prefixes = _mix(_mix(s[of]) + prefixes[at])
        key = prefixes.view(np.int64)
        keys = np.column_stack([keys[at], np.where(key == 0, 1, key)])
    return np.concatenate([*rows, keys])


@lru_cache(maxsize=2)
def _shingler(size: int) -> Shingler:
    return Shingler(size)


def _describe(size: int, runs: int, depth: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _shingler(size)
        for batch in slices(batches, 2):
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for text in part.column(2):
                    s = by.shingles(text.as_py())
                    if len(s):
                        rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), sketch(s), paths(s, runs, depth, threshold).ravel().tolist()))
                    else:
                        rows.append((None, 0, None, None))
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["doc", "own", "set", "size", "sketch", "keys"]
                )

    return run


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of one key (the first columns) at a time, from batches sorted by key."""
    held: list[dict] = []
    for batch in batches:
        names = batch.schema.names[:keys]
        for row in batch.to_pylist():
            if held and any(row[n] != held[0][n] for n in names):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def _links(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], names=["a", "b"])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets: each set to the least set that its chain of similar sketches reaches."""
    out: list[tuple[bytes, bytes]] = []
    for rows in _by_key(batches, 1):
        rows.sort(key=lambda r: r["set"])
        if len(rows) > BUCKET_LAST:
            root = [0] * len(rows)
        else:
            sk = np.stack([np.frombuffer(r["sketch"], "<u2") for r in rows])
            size = np.array([r["size"] for r in rows], float)
            pairs = []
            for i in range(len(rows) - 1):
                like = (sk[i + 1 :] == sk[i]).mean(axis=1) >= PROPOSE
                like &= np.minimum(size[i + 1 :], size[i]) >= THRESHOLD * np.maximum(size[i + 1 :], size[i])
                pairs += [(i, i + 1 + j) for j in np.flatnonzero(like)]
            root = _roots(len(rows), iter(pairs))
        out += [(r["set"], rows[k]["set"]) for r, k, i in zip(rows, root, range(len(rows))) if k != i]
        if len(out) > 20_000:
            yield _links(out)
            out = []
    yield _links(out)


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets with each other, or with those of b: products of 0/1 matrices, some columns at a time."""
    sets = a + (b or [])
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n[at] > 1
    which, at = which[keep], at[keep]
    order = np.argsort(at, kind="stable")
    which, at = which[order], at[order]
    new = np.concatenate(([0], np.cumsum(at[1:] != at[:-1]))) if len(at) else at
    total = np.zeros((len(a), len(b) if b is not None else len(a)), np.float32)
    width = max(64, min(4096, 4_000_000 // len(sets)))
    edges = np.searchsorted(new, np.arange(0, (int(new[-1]) if len(new) else -1) + 1 + width, width))
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            m = np.zeros((len(sets), width), np.float32)
            m[which[lo:hi], new[lo:hi] % width] = 1
            total += m[: len(a)] @ (m[len(a) :] if b is not None else m).T
    return total.astype(np.int64)


def _verify(size: int, threshold: float):
    """Per block of a group: for each set the documents of the sets it is similar to, and its root in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, out = _shingler(size), []

        def batch() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["set", "root", "links"])

        for rows in _by_key(batches, 3):
            rows = list({r["set"]: r for r in rows}.values())  # equal rows repeat a set
            rows.sort(key=lambda r: (r["block"] != r["i"], r["set"]))
            sets = [by.shingles(r["text"]) for r in rows]
            sizes = np.array([len(s) for s in sets])
            copies = np.array([r["copies"] for r in rows])
            first = sum(r["block"] == r["i"] for r in rows)
            across = rows[0]["i"] != rows[0]["j"]
            a, b = (slice(0, first), slice(first, None)) if across else (slice(None), slice(None))
            inter = common_counts(sets[a], sets[b] if across else None)
            like = inter * (1 + threshold) >= threshold * (sizes[a][:, None] + sizes[b][None, :]) - 1e-9
            if not across:
                np.fill_diagonal(like, False)
            links = np.zeros(len(rows), np.int64)
            links[a] += like @ copies[b]
            if across:
                links[b] += copies[a] @ like
            pairs = np.argwhere(like)
            root = _roots(len(rows), ((int(i), int(j) + (first if across else 0)) for i, j in pairs))
            least = {}
            for r, k in zip(rows, root):
                least[k] = min(least.get(k, r["set"]), r["set"])
            out += [(r["set"], least[k], int(n)) for r, k, n in zip(rows, root, links)]
            if len(out) > 20_000:
                yield batch()
                out = []
        yield batch()

    return run


def similar_groups(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL
) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, n_links, n_copies, stands_for_class and text_hash.

    n_links: other rows whose shingle sets have a Jaccard similarity of the
    threshold or more, copies among them; n_copies: rows with an equal set, itself
    included; class_id: the least id that chains of links reach. A text of under
    five words is one shingle of all its words; null and blank texts have none and
    link to nothing. Null ids take part, but a class is named by another id where it
    has one. stands_for_class marks the row of the least id of each class (and rows
    equal to it). An empty table gives an empty result; other columns are left out.
    """
    spark = df.sparkSession
    runs = repetitions(recall)
    text = column(df, text_col).cast("string")
    texts = df.select(column(df, id_col).cast("long").alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("own"), text.alias("text"))
    described = texts.mapInArrow(
        _describe(shingle, runs, DEPTH, threshold), "doc bigint, own bigint, set binary, size bigint, sketch binary, keys array<bigint>"
    )
    sets = written(described, "sets")
    least = F.min(F.struct(F.coalesce("doc", F.lit(2**63 - 1)).alias("d"), "doc", "own", "size", "sketch", "keys"))
    classes = sets.where("set IS NOT NULL").groupBy("set").agg(least.alias("r"), F.count("*").alias("copies"))
    classes = written(classes.select("set", "copies", "r.doc", "r.own", "r.size", "r.sketch", "r.keys"), "classes")

    steps = F.transform(F.sequence(F.lit(0), (F.size("keys") / DEPTH).cast("int") - 1), lambda i: F.slice("keys", (i * DEPTH + 1).cast("int"), DEPTH))
    active = classes.where(F.size("keys") > 0).select("set", F.explode(steps).alias("path"))
    members = None
    for d in range(DEPTH):
        level = active.where(F.col("path")[d] != 0).select("set", F.col("path")[d].alias("bucket"), "path")
        counts = level.groupBy("bucket").agg(F.count_distinct("set").alias("n")).where("n > 1")
        last = d == DEPTH - 1
        small = counts if last else counts.where(F.col("n") <= BUCKET)
        own = level.select("bucket", "set").distinct().join(small, "bucket").select("bucket", "set")
        members = own if members is None else members.unionByName(own)
        if not last:
            large = counts.where(F.col("n") > BUCKET).select("bucket")
            active = written(level.join(large, "bucket").select("set", "path"), "active")
            if active.isEmpty():
                break
    sketches = classes.select("set", "size", "sketch")
    proposed = members.join(sketches, "set").select("bucket", "set", "size", "sketch")
    proposed = proposed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_propose, "a binary, b binary")
    groups = connected_components(proposed.distinct()).select(F.col("node").alias("set"), F.col("root").alias("group"))

    grouped = written(groups.join(classes.select("set", "copies", "doc", "own", "size"), "set"), "groups")
    whole = grouped.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocked = grouped.join(whole, "group").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    pairs = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "copies", "doc", "own", "blocks")
    with_text = texts.withColumnsRenamed({"doc": "t_doc", "own": "t_own"})
    with_text = with_text.join(pairs.hint("shuffle_hash"), F.col("t_doc").eqNullSafe(F.col("doc")) & (F.col("t_own") == F.col("own")))
    with_text = with_text.select("group", "i", "j", "block", "set", "copies", "text").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    found = written(with_text.mapInArrow(_verify(shingle, threshold), "set binary, root binary, links bigint"), "found")

    links = found.groupBy("set").agg(F.sum("links").alias("links"), F.count_distinct("root").alias("roots"), F.min("root").alias("root"))
    if whole.where("blocks > 1").isEmpty():
        roots = links.select("set", "root")
    else:
        roots = connected_components(found.select(F.col("set").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("set"), "root")
    result = classes.select("set", "copies").join(links.select("set", "links"), "set", "left").join(roots, "set", "left")
    result = result.select(
        F.col("set").alias("c_set"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set").alias("root")
    )
    rows = sets.select("doc", "own", "set").join(result, F.col("set") == F.col("c_set"), "left").drop("c_set")
    rows = written(rows, "rows")
    first = F.min(F.struct(F.coalesce("doc", F.lit(2**63 - 1)).alias("d"), "own")).alias("first")
    names = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("class_id"), first)
    alone = F.col("root").isNull()
    stands = (F.coalesce("doc", F.lit(2**63 - 1)) == F.col("first.d")) & (F.col("own") == F.col("first.own"))
    return rows.join(names.withColumnRenamed("root", "n_root"), F.col("root") == F.col("n_root"), "left").select(
        F.col("doc").alias("doc_id"),
        F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | stands).alias("stands_for_class"),
        F.col("own").alias("text_hash"),
    )


def one_per_group(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stand for their class: of each, the one with the least id, with all its columns.

    Equal rows (id and text) count as one. Rows without any word all stay, once each
    if equal. Rows that share an id but not the text are told apart by the text.
    """
    found = similar_groups(df, text_col, id_col).where("stands_for_class")
    keepers = found.groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.count("*").alias("k_rows"))
    own = F.coalesce(F.xxhash64(column(df, text_col).cast("string")), F.lit(0))
    kept = df.join(keepers, column(df, id_col).cast("long").eqNullSafe(F.col("k_id")) & (own == F.col("k_hash")))
    single = kept.where("k_rows = 1").select(*[column(df, c) for c in df.columns])
    repeated = kept.where("k_rows > 1").dropDuplicates(["k_id", "k_hash"]).select(*[column(df, c) for c in df.columns])
    return single.unionByName(repeated)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir).select("doc_id", "text")).drop("stands_for_class", "text_hash")
