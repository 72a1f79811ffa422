"""Alignment of two tokenizers over the same bytes.

Every byte of a text gets a label: no token ends with it, one of the first tokenizer (A),
one of the second (B), or one of both. A regular expression scans the labels
for spans up to each both-label; a span's labels count the tokens of
either side that make a group.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, slices, written

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Labels of a byte; one of both tokenizers has the bits of either.
NONE, A_END, B_END, BOTH = range(4)
_SPAN = re.compile(rb"[^\x03]*\x03")
#: Bytes that no token ends with count for nothing, so they go before the scan.
_NO_END = bytes([NONE])
#: Bytes of text that are encoded and labelled at once.
AT_ONCE = 1 << 18


class _Shapes(dict):
    """Tokens of either side in a span, from its labels (a times 2**32, plus b); short spans are remembered."""

    def __missing__(self, span: bytes) -> int:
        n = (span.count(A_END) + 1) << 32 | (span.count(B_END) + 1)
        if len(span) <= 12:
            self[span] = n
        return n


@dataclass
class Groups:
    """The token groups of a text: tokens of either side in order, how many of them each group has, and where it ends."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    ends: np.ndarray


class Aligner:
    """Encodes by both tokenizers and aligns their tokens."""

    def __init__(self, folder: Callable[[str], str]):
        with open(folder(RANKS), "rb") as f:
            ranks = {base64.b64decode(x): int(r) for x, r in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=folder(PIECES))
        n_a, n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        byte = {self.b.piece_to_id(f"<0x{x:02X}>"): bytes([x]) for x in range(256)}
        self.b_bytes = [byte.get(i, self.b.id_to_piece(i).replace("\u2581", " ").encode()) for i in range(n_b)]
        self.a_length = np.zeros(n_a, np.int64)
        self.a_length[list(ranks.values())] = [len(x) for x in ranks]
        self.b_length = np.array([len(x) for x in self.b_bytes])
        if max(n_a, n_b) > 1 << 16:
            raise ValueError("pairs of ids are kept in four bytes: at most 65,536 ids each")
        #: Each id as text: followed by another of its side, and at the end of its side.
        self.a_text, self.b_text = (np.array([[f"{i}," for i in range(n)], [f"{i}{end}" for i in range(n)]], object) for n, end in ((n_a, "|"), (n_b, ";")))
        self.shapes = _Shapes()

    def groups(self, texts: list[str | None]) -> list[Groups | None]:
        """Per text its groups; None for null and empty texts and where the second tokenizer's bytes are not the text's."""
        asked = [t for t in texts if t]
        found = iter([self._aligned(" " + t, b) for t, b in zip(asked, self.b.encode(asked, num_threads=1) if asked else [])])
        return [next(found) if t else None for t in texts]

    def _aligned(self, text: str, b: list[int]) -> Groups | None:
        if b"".join(map(self.b_bytes.__getitem__, b)) != text.encode():
            return None
        a, b = self.a.encode_to_numpy(text, disallowed_special=()), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        labels = np.zeros(int(a_ends[-1]), np.uint8)
        labels[a_ends - 1] = A_END
        labels[b_ends - 1] |= B_END
        spans = _SPAN.findall(labels.tobytes().translate(None, _NO_END))
        shapes = np.fromiter(map(self.shapes.__getitem__, spans), np.int64, len(spans))
        return Groups(a, b, shapes >> 32, shapes & 0xFFFFFFFF, np.flatnonzero(labels == BOTH) + 1)

    def as_text(self, g: Groups) -> str:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        a_to, b_to = np.cumsum(g.n_a), np.cumsum(g.n_b)
        parts = np.empty(len(g.a) + len(g.b), object)
        last = np.zeros(len(g.a), np.int64)
        last[a_to - 1] = 1
        parts[np.arange(len(g.a)) + np.repeat(b_to - g.n_b, g.n_a)] = self.a_text[last, g.a]
        last = np.zeros(len(g.b), np.int64)
        last[b_to - 1] = 1
        parts[np.arange(len(g.b)) + np.repeat(a_to, g.n_b)] = self.b_text[last, g.b]
        return "".join(parts.tolist())[:-1]


@lru_cache(maxsize=2)
def _aligner(folder: Callable[[str], str]) -> Aligner:
    return Aligner(folder)


def _grouped(folder: Callable[[str], str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[Groups | None]]]:
    by = _aligner(folder)
    for part in slices(batches, 1, AT_ONCE):
        yield part.column(0), by.groups(part.column(1).to_pylist())


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


def align(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", folder: Callable[[str], str] = public_tokenizers.path) -> DataFrame:
    """Rows (doc_id, groups): per row of ``df`` its token groups (start, end, a, b) in order.

    Offsets are bytes of a space and the text, which is what both tokenizers
    encode. Null and empty texts have no groups, nor has a text whose second
    encoding has other bytes. Ids may be null or repeat; each row stands for itself;
    an empty table gives an empty result; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for ids, texts in _grouped(folder, batches):
            found = [Groups(none, none, none, none, none) if g is None else g for g in texts]
            ends, starts = (np.concatenate([x(g.ends) for g in found]) for x in (lambda e: e, lambda e: np.concatenate(([0], e[:-1]))[: len(e)]))
            sides = [_lists(np.concatenate([v(g) for g in found]), np.concatenate([n(g) for g in found])) for v, n in ((lambda g: g.a, lambda g: g.n_a), (lambda g: g.b, lambda g: g.n_b))]
            rows = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), *sides], ["start", "end", "a", "b"])
            offsets = np.concatenate(([0], np.cumsum([len(g.ends) for g in found])))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], names=["doc_id", "groups"])

    rows = df.select(column(df, id_col).cast("long").alias("doc_id"), column(df, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>")


def _digests(folder: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _grouped(folder, batches):
            rows = []
            for g in texts:
                if g is None:
                    rows.append((0, 0, 0, "", b""))
                    continue
                pairs = (g.a[np.cumsum(g.n_a) - 1].astype("<u4") << 16) | g.b[np.cumsum(g.n_b) - 1].astype("<u4")
                digest = hashlib.sha256(_aligner(folder).as_text(g).encode()).hexdigest()
                rows.append((len(g.a), len(g.b), len(g.ends), digest, pairs.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    return run


#: Links that a task counts at once.
LINKS = 4_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's documents link each pair of ids: as many rows as there are pairs of the vocabularies, at most."""
    codes, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    waiting = 0

    def folded() -> tuple[np.ndarray, np.ndarray]:
        new, own = np.unique(np.concatenate([codes[:0], *held]), return_counts=True)
        both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([n, own]), len(both)).astype(np.int64)

    for batch in batches:
        for x in batch.column(0):
            held.append(np.frombuffer(x.as_buffer(), "<u4"))
            waiting += len(held[-1])
            if waiting > LINKS:
                codes, n = folded()
                held, waiting = [], 0
    codes, n = folded()
    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], names=["pair", "n"])


def pair_counts(digests: DataFrame) -> DataFrame:
    """Rows (pair, n): links of the whole corpus by id pair (a times 65,536, plus b)."""
    counted = digests.where("n_groups > 0").select("pairs").mapInArrow(_counted, "pair bigint, n bigint")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", folder: Callable[[str], str] = public_tokenizers.path) -> DataFrame:
    """One row per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of tokens that end together, so a document has one per group. A
    pair's count is the number of links of the whole table that hold it; n_best counts links whose
    count is the highest of their second id; count_sum adds them up. Texts
    without groups (see ``align``) have zeros and an empty digest.

    Of two tokens that end together one's bytes end the other's, so the pairs
    that can occur are bounded by the vocabularies (each token has no more such partners
    than bytes in one direction). Their counts alone pass the driver and are broadcast.
    """
    rows = df.select(column(df, id_col).cast("long").alias("doc_id"), column(df, text_col).cast("string").alias("text"))
    found = written(rows.mapInArrow(_digests(folder), "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs binary"), "aligned")
    counted = pair_counts(found).toArrow()
    order = np.argsort(counted.column("pair").to_numpy())
    pairs, n = counted.column("pair").to_numpy()[order].astype(np.uint32), counted.column("n").to_numpy()[order]
    most = np.zeros(1 << 16, np.int64)
    np.maximum.at(most, pairs & 0xFFFF, n)
    table = df.sparkSession.sparkContext.broadcast((pairs, n, n == most[pairs & 0xFFFF]))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = table.value
        for batch in slices(batches, 5):
            links = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(5)), "<u4")
            at = np.searchsorted(codes, links)
            ends = np.cumsum(batch.column(3).to_numpy())
            sums = [np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(x[at])))[ends]))) for x in (best.astype(np.int64), counts)]
            arrays = [*batch.columns[:4], batch.column(3), *map(pa.array, sums), batch.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.mapInArrow(weighed, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document's token groups; edge cases as in ``alignment_counts``."""
    return alignment_counts(documents(spark, sf_dir))
