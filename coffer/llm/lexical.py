"""Ranked lexical search by three phases over term-partitioned postings (TPUT).

A list holds the postings of a term, dealt by term and block of documents and sorted by weight
within a block, so that a common term's list lies in many tasks.

1. The heads of all lists give every query partial sums of some documents; the
   k-th highest is a lower bound of its final k-th score.
2. That bound divided by the number of the query's lists is the uniform threshold:
   a document that reaches the bound has a posting at or above it in one list at least. All lists
   send what reaches the threshold to the blocks of documents, where partial sums
   give a better bound, and what may be missing an upper bound for each document.
3. Documents whose upper bound reaches the better bound are candidates; the postings that
   they lack are looked up in the lists, and the exact scores are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, slices, written

#: Entries of a list's head.
HEAD = 64
#: Documents of a block.
BLOCK = 4096
#: Words of the queries that are searched for in one run; more queries take more runs.
RUN_WORDS = 1_000_000
#: Stands for a null id.
NULL_ID = 2**63 - 1

#: What separates terms becomes a space, and A-Z lower case.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lowered."""
    return text.translate(_TERM_BYTES).split()


_POSTINGS = "term int, block bigint, n bigint, words bigint, rows binary, tf binary, sizes binary"


def _postings(vocabulary: Broadcast):
    """Per block and term the rows that hold it, how often, and their words; term -1 has the block's ids, and counts its texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base, k = vocabulary.value, TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, 1):
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                keys, sizes = [], np.zeros(len(ids), np.int64)
                for i, text in enumerate(part.column(1).cast(pa.binary())):
                    found = terms(text.as_py() or b"")
                    sizes[i] = len(found)
                    own = np.fromiter(map(code.get, found, repeat(-1)), np.int64, len(found))
                    keys.append(own[own >= 0] * BLOCK + i)
                pairs, tf = np.unique(np.concatenate(keys), return_counts=True)
                term, row = pairs // BLOCK, pairs % BLOCK
                cuts = np.concatenate((np.flatnonzero(np.diff(term, prepend=-1)), [len(term)]))
                out = [(-1, int((sizes > 0).sum()), int(sizes.sum()), b"", ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes())]
                for a, b in zip(cuts, cuts[1:]):
                    out.append((int(term[a]), int(b - a), 0, row[a:b].astype("<u2").tobytes(), tf[a:b].astype("<u4").tobytes(), sizes[row[a:b]].astype("<u4").tobytes()))
                cols = list(zip(*out))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                term_c, n_c, words_c, rows_c, tf_c, sizes_c = (pa.array(c, kind) for c, kind in zip(cols, kinds))
                yield pa.RecordBatch.from_arrays([term_c, pa.array([base + k] * len(out), pa.int64()), n_c, words_c, rows_c, tf_c, sizes_c], names=["term", "block", "n", "words", "rows", "tf", "sizes"])
                k += 1

    return run


def _weighed(total: int, words: int, weights: np.ndarray):
    """Lists with impacts instead of counts, highest first; the blocks' ids pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, out = batch.column(0).to_numpy(), []
            for i, t in enumerate(term):
                rows, tf, sizes = (batch.column(c)[i].as_buffer() for c in (4, 5, 6))
                if t < 0:
                    out.append((rows.to_pybytes(), tf.to_pybytes(), 0))
                    continue
                tf, sizes = np.frombuffer(tf, "<u4").astype(np.int64), np.frombuffer(sizes, "<u4").astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * sizes * total // words))
                order = np.argsort(-impact, kind="stable")
                out.append((np.frombuffer(rows, "<u2")[order].tobytes(), impact[order].astype("<i4").tobytes(), int(impact[order[0]] * weights[t])))
            rows, data, top = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(top, pa.int64()), pa.array(rows, pa.binary()), pa.array(data, pa.binary())], names=["term", "block", "n", "top", "rows", "data"]
            )

    return run


_LISTS = "term int, block bigint, n bigint, top bigint, rows binary, data binary"


def _heads(weights: np.ndarray):
    """A task's best entries of each list: (term, block, row, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        none = np.zeros(0, np.int64)
        for batch in batches:
            for t, block, rows, data in zip(*(batch.column(c) for c in (0, 1, 4, 5))):
                t = t.as_py()
                if t < 0:
                    continue
                rows, value = np.frombuffer(rows.as_buffer(), "<u2")[:HEAD].astype(np.int64), np.frombuffer(data.as_buffer(), "<i4")[:HEAD].astype(np.int64) * weights[t]
                old = best.get(t, (none, none, none))
                if len(old[2]) == HEAD and value[0] <= old[2][-1]:
                    continue
                both = [np.concatenate(x) for x in zip(old, (np.full(len(rows), block.as_py()), rows, value))]
                order = np.argsort(-both[2], kind="stable")[:HEAD]
                best[t] = tuple(x[order] for x in both)
        lengths = [len(x[0]) for x in best.values()]
        cols = [np.concatenate([none, *[x[i] for x in best.values()]]) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), lengths), pa.int32()), *map(pa.array, cols)], names=["term", "block", "row", "value"])

    return run


def _least(need: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many of these values, highest first, reach each need."""
    return np.searchsorted(-value, -need, side="right")


class _Queries:
    """The queries of a run with their lists: term, repeats and threshold of each."""

    def __init__(self, items: list[int], lists: dict[int, list[tuple[int, int]]], weights: np.ndarray, tops: np.ndarray, bounds: dict[int, int]):
        self.items, self.weights = items, weights
        self.term = {i: np.array([t for t, _ in lists[i]], np.int64) for i in items}
        self.times = {i: np.array([q for _, q in lists[i]], np.int64) for i in items}
        #: Entries of a list are fetched from this value on: the bound divided by the number of lists, over the repeats.
        self.need = {i: np.maximum(1, -(-bounds.get(i, 0) // (len(self.term[i]) * self.times[i]))) for i in items}
        #: What an entry that was not fetched has at most.
        self.rest = {i: self.times[i] * np.minimum(self.need[i] - 1, tops[self.term[i]]) for i in items}
        self.bounds = bounds
        self.least = np.full(len(weights), 2**62, np.int64)
        for i in items:
            np.minimum.at(self.least, self.term[i], self.need[i])


def _fetched(of: Broadcast):
    """The entries of each list that reach the lowest threshold of any query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Queries = of.value
        for batch in batches:
            out = []
            for t, block, rows, data in zip(*(batch.column(c) for c in (0, 1, 4, 5))):
                t = t.as_py()
                rows, data = rows.as_buffer(), data.as_buffer()
                if t < 0:
                    out.append((t, block.as_py(), rows.to_pybytes(), data.to_pybytes()))
                    continue
                n = int(_least(q.least[t], np.frombuffer(data, "<i4").astype(np.int64) * q.weights[t]))
                if n:
                    out.append((t, block.as_py(), rows.to_pybytes()[: 2 * n], data.to_pybytes()[: 4 * n]))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["term", "block", "rows", "data"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """Block by block, from rows sorted by block: its ids and what was fetched of each list."""
    at, ids, lists = None, None, {}
    for batch in batches:
        for t, block, rows, data in zip(*(batch.column(c) for c in range(4))):
            if block.as_py() != at:
                if at is not None:
                    yield at, ids, lists
                at, lists = block.as_py(), {}
            if t.as_py() < 0:
                ids = np.frombuffer(data.as_buffer(), "<i8")
            else:
                lists[t.as_py()] = np.frombuffer(rows.as_buffer(), "<u2").astype(np.int64), np.frombuffer(data.as_buffer(), "<i4").astype(np.int64)
    if at is not None:
        yield at, ids, lists


def _sums(q: _Queries, item: int, n: int, lists: dict) -> tuple[np.ndarray, np.ndarray]:
    """Partial sums of a block's documents for a query, and upper bounds of their scores."""
    partial, above = np.zeros(n, np.int64), np.full(n, q.rest[item].sum())
    for t, times, need, rest in zip(q.term[item].tolist(), q.times[item].tolist(), q.need[item].tolist(), q.rest[item].tolist()):
        found = lists.get(t)
        if found is None:
            continue
        rows, value = found[0], found[1] * q.weights[t]
        if value[-1] < need:
            upto = int(_least(need, value))
            rows, value = rows[:upto], value[:upto]
        partial[rows] += times * value
        above[rows] += times * value - rest
    return partial, above


def _better(of: Broadcast, k: int):
    """A task's k highest partial sums for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Queries = of.value
        best = {i: np.zeros(0, np.int64) for i in q.items}
        for _, ids, lists in _blocks(batches):
            for i in q.items:
                partial, _ = _sums(q, i, len(ids), lists)
                partial = partial[partial > 0]
                best[i] = -np.partition(-np.concatenate([best[i], partial]), min(k, len(best[i]) + len(partial)) - 1)[:k] if len(partial) else best[i]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(q.items, np.int64), [len(best[i]) for i in q.items])), pa.array(np.concatenate([np.zeros(0, np.int64), *[best[i] for i in q.items]]))], names=["item", "value"]
        )

    return run


def _candidates(of: Broadcast, better: dict[int, int]):
    """Documents whose upper bound reaches the better bound, with their partial sums and the lists to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Queries = of.value
        for block, ids, lists in _blocks(batches):
            for i in q.items:
                partial, above = _sums(q, i, len(ids), lists)
                rows = np.flatnonzero(above >= max(1, better.get(i, 0)))
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), i, np.int64)), pa.array(np.full(len(rows), block, np.int64)), pa.array(rows, pa.int32()), pa.array(ids[rows].astype(np.int64)), pa.array(partial[rows])],
                        names=["item", "block", "row", "doc_id", "partial"],
                    )

    return run


def _looked_up(of: Broadcast):
    """What the lists hold of the candidates below the threshold: (item, block, row, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Queries = of.value
        for batch in batches:
            out = []
            for t, block, rows, data, asked in zip(*(batch.column(c) for c in range(5))):
                t, rows, value = t.as_py(), np.frombuffer(rows.as_buffer(), "<u2"), np.frombuffer(data.as_buffer(), "<i4").astype(np.int64)
                value = value * q.weights[t]
                by_row = np.argsort(rows, kind="stable")
                for ask in asked.as_py():
                    at = int(np.searchsorted(rows[by_row], ask["row"]))
                    if at < len(rows) and rows[by_row[at]] == ask["row"] and value[by_row[at]] < ask["need"]:
                        out.append((ask["item"], block.as_py(), ask["row"], int(value[by_row[at]]) * ask["times"]))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64()])], names=["item", "block", "row", "value"])

    return run


def _run(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """The ranked documents of some queries, whose words are RUN_WORDS at most (or one query's)."""
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, found in queries for t in found}))}
    code = spark.sparkContext.broadcast(vocabulary)
    raw = written(docs.mapInArrow(_postings(code), _POSTINGS), "postings")
    total = {r["term"]: r for r in raw.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()}
    n, words = (total[-1]["n"], total[-1]["words"]) if -1 in total else (0, 0)
    weights = np.array([np.floor(1000 * np.log((2 * n + 2) / (2 * total[t]["n"] + 1))) if t in total else 0 for t in range(len(vocabulary))]).astype(np.int64)
    lists = raw.mapInArrow(_weighed(n, words, weights), _LISTS)
    lists = written(lists.repartition("term", F.pmod("block", F.lit(64))).sortWithinPartitions("term", "block"), "lists")

    asked: dict[int, list[tuple[int, int]]] = {}
    for item, found in queries:
        codes, times = np.unique([vocabulary[t] for t in found], return_counts=True)
        asked[item] = [(int(t), int(c)) for t, c in zip(codes, times) if t in total and weights[t] > 0]
    items = [i for i in asked if asked[i]]
    pairs = spark.createDataFrame([(i, t, c) for i in items for t, c in asked[i]], "item long, term int, times long")

    order = Window.partitionBy("term").orderBy(F.desc("value"), "block", "row")
    heads = lists.mapInArrow(_heads(weights), "term int, block bigint, row bigint, value bigint").select("*", F.row_number().over(order).alias("at")).where(F.col("at") <= HEAD)
    sums = heads.join(pairs, "term").groupBy("item", "block", "row").agg(F.sum(F.col("value") * F.col("times")).alias("value"))

    def kth(values: DataFrame) -> dict[int, int]:
        by_item = Window.partitionBy("item").orderBy(F.desc("value"))
        ranked = values.select("item", "value", F.row_number().over(by_item).alias("at")).where(F.col("at") <= k)
        return {r["item"]: r["value"] for r in ranked.where(F.col("at") == k).collect()}

    bounds = kth(sums)
    tops = np.zeros(len(vocabulary), np.int64)
    for r in lists.where("term >= 0").groupBy("term").agg(F.max("top").alias("top")).collect():
        tops[r["term"]] = r["top"]
    of = spark.sparkContext.broadcast(_Queries(items, asked, weights, tops, bounds))
    fetched = lists.mapInArrow(_fetched(of), "term int, block bigint, rows binary, data binary")
    fetched = written(fetched.repartition("block").sortWithinPartitions("block", "term"), "fetched")
    better = kth(fetched.mapInArrow(_better(of, k), "item bigint, value bigint"))

    found = written(fetched.mapInArrow(_candidates(of, better), "item bigint, block bigint, row int, doc_id bigint, partial bigint"), "candidates")
    q: _Queries = of.value
    short = spark.createDataFrame(
        [(i, int(t), int(c), int(x)) for i in items for t, c, x in zip(q.term[i], q.times[i], q.need[i]) if x > 1], "item long, term int, times long, need long"
    )
    wanted = found.select("item", "block", "row").join(short, "item").groupBy("term", "block").agg(F.collect_list(F.struct("item", "row", "times", "need")).alias("asked"))
    missing = lists.select("term", "block", "rows", "data").join(wanted, ["term", "block"]).mapInArrow(_looked_up(of), "item bigint, block bigint, row int, value bigint")
    missing = missing.groupBy("item", "block", "row").agg(F.sum("value").alias("missing"))
    scored = found.join(missing, ["item", "block", "row"], "left").withColumn("score", F.col("partial") + F.coalesce("missing", F.lit(0))).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "block", "row")).cast("int")
    ranked = scored.select(F.col("item").alias("item_id"), rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
    return ranked.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def search(docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item, ties to the smaller id.

    Each row of ``docs`` is a document of its own, even if ids or texts repeat; a null
    id comes last among equals. Null, empty and wordless texts match nothing and
    don't count; an item without words has no rows, and items that share an
    id are one item of all their words. Null item ids are left out, and so are other columns. An empty table gives an empty result.

    The queries are the bounded side: their words go to every task, RUN_WORDS in a
    run, and more queries are searched in further runs.
    """
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    asked = items.select(column(items, item_id_col).cast("long").alias("item"), column(items, item_text_col).cast("string").alias("text")).where("item IS NOT NULL").orderBy("item")
    runs: list[dict[int, list[bytes]]] = [{}]
    held = 0
    out = None

    def union(one: DataFrame) -> DataFrame:
        return one if out is None else out.unionByName(one)

    for r in asked.toLocalIterator():
        found = terms((r["text"] or "").encode())
        if held and held + len(found) > RUN_WORDS and r["item"] not in runs[-1]:
            out = union(_run(rows, list(runs.pop().items()), k))
            runs, held = [{}], 0
        runs[-1].setdefault(r["item"], []).extend(found)
        held += len(found)
    return union(_run(rows, list(runs[-1].items()), k))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; edge cases as in ``search``."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
t AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, t),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN v USING (term) JOIN p USING (term) JOIN s USING (doc_id), t GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""
