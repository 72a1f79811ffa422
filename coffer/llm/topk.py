"""Exact top-k inner-product search in three phases with a uniform threshold.

Vectors are packed into blocks of integer matrices where they are read; blocks of
queries meet blocks of candidates by a cell number, so no row is paired singly.
The dimensions are cut into slices. After some slices a partial score, and the
product of the two lengths that the other slices have, bound the score from above.

1. Gather: every pair of blocks scores the first half of the slices, and sends each
   query's local list: the entries with the best partial scores, scored in full, and
   the highest bound that any entry of the block has.
2. Cutoff: a query's k-th best gathered score is a lower bound of its final k-th
   score. It is broadcast to the blocks whose highest bound reaches it; other
   blocks are not read again for that query.
3. Collect and resolve: there partial scores are taken up slice by slice, and entries
   leave as soon as their bound is under the cutoff. The few that stay are sufficient:
   their scores are completed one by one, and those that reach the cutoff go
   to the final ranking, k at most from each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Slices of the dimensions, and how many times k entries a local list has.
SLICES, LISTED = 4, 2
#: Share of a block's entries below which they are completed one by one.
FEW = 0.2
QUERY_BLOCK = 1024
VECTOR_BLOCK = 8192
#: Scores saturate here (only components beyond 2**28 or so can reach it).
LARGEST = 2**63 - 1

_BLOCK = "ids binary, dims int, rows int, data binary, cutoffs binary"
_ENTRIES = "query_id bigint, query_hash bigint, vec_id bigint, score bigint, resolved bigint, block bigint, bound double"


def quantised(vectors: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component as longs; null where the vector or a component is null or not finite."""
    as_double = F.transform(vectors, lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(as_double, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists as a matrix; shorter ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    most = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    return m.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                names = part.schema.names
                m = _narrow(_matrix(part.column(names.index("q"))))
                key = [part.column(names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("vec_id", "hash")]
                cut = part.column(names.index("cutoff")).to_numpy(zero_copy_only=False).astype(np.int64)
                row = [np.stack(key).tobytes(), m.shape[1], m.itemsize * 10_000_000 + len(m), m.tobytes(), cut.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.int32()), pa.array([row[3]], pa.binary()), pa.array([row[4]], pa.binary())],
                    names=["ids", "dims", "rows", "data", "cutoffs"],
                )

    return pack


def _by_block(size: int):
    """Packs runs of queries that are sent to the same block."""
    pack = _packer(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = batch.column(batch.schema.names.index("q_block")).to_numpy()
            edges = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)] if len(to) else [0]
            for a, b in zip(edges, edges[1:]):
                for row in pack(iter([batch.slice(a, b - a)])):
                    yield row.append_column("block", pa.array(np.full(row.num_rows, to[a]), pa.int64()))

    return run


def _unpack(ids: bytes, dims: int, rows: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[rows // 10_000_000]
    keys = np.frombuffer(ids, np.int64).reshape(2, -1)
    return keys[0], keys[1], np.frombuffer(data, kind).reshape(rows % 10_000_000, dims)


def _widened(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while they hold them, else longs, else Python's integers."""
    bound = q.shape[1] * max(1, int(np.abs(q.astype(np.float64)).max(initial=0))) * max(1, int(np.abs(v.astype(np.float64)).max(initial=0)))
    if bound < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def _slices(dims: int) -> list[slice]:
    edges = np.linspace(0, dims, min(SLICES, max(1, dims)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _rests(m: np.ndarray, parts: list[slice]) -> np.ndarray:
    """The length of each row beyond each slice."""
    squares = np.stack([(m[:, s].astype(np.float64) ** 2).sum(1) for s in parts])
    return np.sqrt(np.maximum(squares.sum(0) - np.cumsum(squares, 0), 0))


def _bounds(partial: np.ndarray, q_rest: np.ndarray, v_rest: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores; a little beyond what rounding may lose."""
    out = partial + np.outer(q_rest, v_rest) * (1 + 1e-9)
    return out + 1 + np.abs(out) * 1e-12


def _completed(q: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores of single entries."""
    out = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), 4096):
        a, b = q[rows[lo : lo + 4096]], v[cols[lo : lo + 4096]]
        most = a.shape[1] * max(1, int(np.abs(a.astype(np.float64)).max(initial=0))) * max(1, int(np.abs(b.astype(np.float64)).max(initial=0)))
        if most < 2**63:
            out[lo : lo + 4096] = np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
        else:
            out[lo : lo + 4096] = np.clip((a.astype(object) * b.astype(object)).sum(1), -LARGEST, LARGEST).astype(np.int64)
    return out


def _gather(k: int):
    """Phase 1 over pairs of blocks: local lists and, with a null vec_id, the block's highest bound."""

    def found(q, q_ids, v, v_ids, cut):
        parts = _slices(q.shape[1])
        half = max(1, len(parts) // 2)
        partial = sum(_products(q[:, s], v[:, s]) for s in parts[:half])
        bound = _bounds(partial, _rests(q, parts)[half - 1], _rests(v, parts)[half - 1])
        own = q_ids[:, None] == v_ids[None, :]
        partial[own], bound[own] = -LARGEST, -np.inf
        n = min(LISTED * k, len(v_ids))
        cols = np.argpartition(-partial, n - 1, axis=1)[:, :n].ravel()
        rows = np.repeat(np.arange(len(q)), n)
        keep = ~own[rows, cols]
        rows, cols = rows[keep], cols[keep]
        return rows, cols, _completed(q, v, rows, cols), np.bincount(rows, minlength=len(q)), bound.max(1, initial=-np.inf)

    return found


def _collect(k: int):
    """Phase 3 over pairs of blocks: the entries that reach the cutoff."""

    def found(q, q_ids, v, v_ids, cut):
        parts = _slices(q.shape[1])
        q_rest, v_rest = _rests(q, parts), _rests(v, parts)
        other = q_ids[:, None] != v_ids[None, :]
        partial, alive = np.zeros((len(q), len(v)), np.int64), other
        for i, s in enumerate(parts):
            partial = partial + _products(q[:, s], v[:, s])
            alive = other & (_bounds(partial, q_rest[i], v_rest[i]) >= cut[:, None])
            if alive.mean() < FEW:
                break
        rows, cols = np.nonzero(alive)
        totals = _completed(q, v, rows, cols)
        resolved = np.bincount(rows, minlength=len(q))
        reach = totals >= cut[rows]
        return rows[reach], cols[reach], totals[reach], resolved, None

    return found


def _scan(k: int, find):
    """Entries of ``find`` for every pair of blocks, a few queries at a time, k at most a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                q_ids, q_hash, q = _unpack(pair["q_ids"], pair["q_dims"], pair["q_rows"], pair["q_data"])
                v_ids, _, v = _unpack(pair["ids"], pair["dims"], pair["rows"], pair["data"])
                cut = np.frombuffer(pair["q_cutoffs"], np.int64)
                dims = max(q.shape[1], v.shape[1])
                q, v = _widened(q, dims), _widened(v, dims)
                for lo in range(0, len(q), 128):
                    part = slice(lo, lo + 128)
                    rows, cols, totals, resolved, bound = find(q[part], q_ids[part], v, v_ids, cut[part])
                    order = np.lexsort((v_ids[cols], -totals, rows))
                    rows, cols, totals = rows[order], cols[order], totals[order]
                    first = np.searchsorted(rows, np.arange(len(q[part])))
                    best = np.arange(len(rows)) - first[rows] < k
                    rows, cols, totals = rows[best], cols[best], totals[best]
                    told = np.arange(len(q[part]))  # a row per query with what its entries took
                    at = lo + np.concatenate((rows, told))
                    some = np.arange(len(at)) < len(rows)
                    none = np.zeros(len(told), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(q_ids[at]),
                            pa.array(q_hash[at]),
                            pa.array(np.concatenate((v_ids[cols], none)), mask=~some),
                            pa.array(np.concatenate((totals, none)), mask=~some),
                            pa.array(np.concatenate((np.zeros(len(rows), np.int64), resolved.astype(np.int64)))),
                            pa.array(np.full(len(at), pair["block"])),
                            pa.array(np.concatenate((np.zeros(len(rows)), none if bound is None else bound)), mask=some),
                        ],
                        names=["query_id", "query_hash", "vec_id", "score", "resolved", "block", "bound"],
                    )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, with_resolved: bool = False) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries``: query_id, rank, vec_id, score.

    Scores are inner products of floor(scale * x); ties go to the smaller id. A
    query is not compared with rows that bear its own id. Rows with a null id, a
    null vector or a null or non-finite component take no part; the missing
    components of shorter vectors count as zero; scores beyond a long saturate.
    Repeated rows of ``vectors`` are candidates each; repeated equal queries
    answer once, and unequal ones under one id each have their own ranks. Fewer
    than k candidates give fewer rows, an empty table none. Other columns are
    ignored. ``with_resolved`` adds how many entries were scored in full for the query.
    """
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        q = quantised(df["`" + vector_col + "`"], scale)
        out = df.select(df["`" + id_col + "`"].cast("long").alias("vec_id"), q.alias("q"))
        return out.where(F.col("vec_id").isNotNull() & F.col("q").isNotNull()).withColumn("hash", F.xxhash64("q"))

    cells = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(0).cast("long")
    blocks = prepared(vectors).withColumn("cutoff", none).mapInArrow(_packer(VECTOR_BLOCK), _BLOCK).drop("cutoffs")
    blocks = written(blocks.withColumn("block", F.xxhash64("ids", "data")).withColumn("cell", F.pmod("block", F.lit(cells)).cast("int")), "vectors")
    asked = written(prepared(queries).dropDuplicates(["vec_id", "hash"]), "queries")
    sides = ("ids", "dims", "rows", "data", "cutoffs")

    packed = asked.withColumn("cutoff", none).mapInArrow(_packer(QUERY_BLOCK), _BLOCK)
    # Cells that hold no block need no queries. Packed rows are far larger than Spark takes them for: they are shuffled, never broadcast.
    used = [r.cell for r in blocks.select("cell").distinct().collect()]
    to_all = packed.select(*[F.col(c).alias(f"q_{c}") for c in sides], F.explode(F.array(*[F.lit(c) for c in used]).cast("array<int>")).alias("q_cell"))
    gathered = written(to_all.hint("merge").join(blocks, F.col("q_cell") == F.col("cell")).drop("q_cell", "cell").mapInArrow(_scan(k, _gather(k)), _ENTRIES), "gathered")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    head = gathered.where("vec_id IS NOT NULL").select("query_id", "query_hash", "score", "vec_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    cutoffs = head.where(F.col("rank") == k).select("query_id", "query_hash", F.col("score").alias("cutoff"))

    # Each block with the queries whose cutoff its highest bound reaches.
    reached = gathered.where("vec_id IS NULL").select("query_id", "query_hash", "block", "bound").join(cutoffs, ["query_id", "query_hash"], "left")
    reached = reached.where(F.col("cutoff").isNull() | (F.col("bound") >= F.col("cutoff"))).select("query_id", "query_hash", F.col("block").alias("q_block"), F.coalesce("cutoff", F.lit(-LARGEST)).alias("cutoff")).distinct()
    informed = asked.hint("merge").join(reached, (F.col("vec_id") == F.col("query_id")) & (F.col("hash") == F.col("query_hash")))
    informed = informed.select("vec_id", "q", "hash", "cutoff", "q_block").repartition(cells, "q_block").sortWithinPartitions("q_block")
    sent = informed.mapInArrow(_by_block(QUERY_BLOCK), _BLOCK + ", block bigint")
    sent = sent.select(*[F.col(c).alias(f"q_{c}") for c in sides], F.col("block").alias("q_block"))
    final = sent.hint("merge").join(blocks, F.col("q_block") == F.col("block")).drop("q_block", "cell").mapInArrow(_scan(k, _collect(k)), _ENTRIES)
    if with_resolved:
        final = written(final, "collected")
    ranked = final.where("vec_id IS NOT NULL").select("query_id", "query_hash", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    if with_resolved:
        work = gathered.unionByName(final).groupBy(F.col("query_id").alias("w_id"), F.col("query_hash").alias("w_hash")).agg(F.sum("resolved").alias("resolved"))
        ranked = ranked.join(work, (F.col("query_id") == F.col("w_id")) & (F.col("query_hash") == F.col("w_hash"))).drop("w_id", "w_hash")
    return ranked.drop("query_hash")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""
