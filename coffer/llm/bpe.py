"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

A text is cut in halves down to leaves; each leaf is encoded alone, and
neighbours are joined up the tree. Two kinds of boundary meet at a join:

*Pieces.* The pattern splits a text into pieces. A match looks at most two
characters past its end (an apostrophe, for 're, 've and 'll), so what ends two
characters or more before the end of the left half cannot change. The join scans
on from there until a piece begins where a piece of the right half does;
from there on both scans see the same text and agree.

*Tokens.* Long pieces are halved as well. A token sequence is the encoding of its
bytes exactly if every two neighbours are the encoding of theirs. So the join
encodes a window around the boundary anew, and widens it until the tokens at its
edges form such pairs with the tokens outside.

Decoding joins the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a leaf of the text's tree, and bytes of a leaf of a piece's.
LEAF_CHARS = 1 << 16
LEAF_BYTES = 6
#: Characters past its end that a match of the pattern looks at.
AHEAD = 2
#: Pieces, leaves and pairs of tokens that a worker remembers; beyond that it forgets them all.
REMEMBERED = 200_000
NONE = 1 << 60
#: Rows that are encoded before they go back to Spark.
ROWS = 512


class Encoder:
    """Encodes text by ranks; ``pattern`` splits it into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaves: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.known: dict[str, bytes] = {}

    # tokens of one piece

    def _merged(self, piece: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return self._merged_by_heap(piece)
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [rank(x + y, NONE) for x, y in zip(parts, parts[1:])]
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        n, rank = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if j <= i or j >= n or end[j] != to:  # one of the two has changed since
                continue
            end[i], end[j] = to, -1
            if to < n:
                before[to] = i
                if (r := rank(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pair(self, left: int, right: int) -> list[int]:
        """The tokens of two tokens' bytes."""
        out = self.pairs.get((left, right))
        if out is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            out = self.pairs[left, right] = self._merged(self.bytes_of[left] + self.bytes_of[right])
        return out

    def _joined_tokens(self, left: list[int], right: list[int]) -> list[int]:
        middle = self._pair(left[-1], right[0])
        i = j = 1
        while True:
            grow_left = i < len(left) and self._pair(left[-i - 1], middle[0]) != [left[-i - 1], middle[0]]
            grow_right = j < len(right) and self._pair(middle[-1], right[j]) != [middle[-1], right[j]]
            if not grow_left and not grow_right:
                return left[: len(left) - i] + middle + right[j:]
            i = min(len(left), 2 * i) if grow_left else i
            j = min(len(right), 2 * j) if grow_right else j
            middle = self._merged(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))

    def _of_bytes(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            out = self.leaves.get(piece)
            if out is None:
                if len(self.leaves) >= REMEMBERED:
                    self.leaves.clear()
                out = self.leaves[piece] = self._merged(piece)
            return out
        half = (len(piece) + 1) // 2
        return self._joined_tokens(self._of_bytes(piece[:half]), self._of_bytes(piece[half:]))

    def piece(self, text: str) -> bytes:
        """The packed ids of one piece."""
        packed = self.known.get(text)
        if packed is None:
            packed = np.array(self._of_bytes(text.encode("utf-8", "replace")), "<u4").tobytes()
            if len(text) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = packed
        return packed

    # pieces of a text

    def _joined_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        tail, back, at = left[-1], 1, 1
        while len(tail) < AHEAD and back < len(left):
            back += 1
            tail = left[-back] + tail
        while True:
            # The text from the left's last pieces up to right[at].
            found = self.find.findall(tail + "".join(right[:at]))
            if at == len(right):
                return left[:-back] + found
            starts, begin = {}, len(tail)
            for k in range(at):
                starts[begin] = k
                begin += len(right[k])
            end = 0
            for n, p in enumerate(found[:-1]):  # the last one may go on beyond this text
                end += len(p)
                if end in starts and end + AHEAD <= begin:
                    return left[:-back] + found[: n + 1] + right[starts[end] :]
            at = min(len(right), 2 * at)

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.find.findall(text)
        half = len(text) // 2
        return self._joined_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> bytes:
        """Packed ids: little-endian, unsigned, 32 bits each."""
        pieces = self.pieces(text)
        parts = list(map(self.known.get, pieces))
        if None in parts:
            parts = [self.piece(p) if t is None else t for p, t in zip(pieces, parts)]
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder per worker, kept between batches."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def _mapped(df: DataFrame, kept: list[str], source: str, schema: list[tuple[str, str, pa.DataType]], compute) -> DataFrame:
    """Adds columns computed from column ``source``, a few hundred rows at a time."""
    fields = [f"`{c}` {t}" for c, t in df.select(*[column(df, c) for c in kept]).dtypes]
    fields += [f"`{n}` {t}" for n, t, _ in schema]
    place = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = compute(part.column(part.schema.names.index(source)))
                arrays = [part.column(part.schema.names.index(c)) for c in kept]
                arrays += [pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(schema)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + [n for n, _, _ in schema])

    return df.mapInArrow(run, ", ".join(fields))


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens``.

    Null and empty texts have no ids; every row is kept, repeated ones too, in an
    empty table none. Columns named ids or n_tokens are replaced. Special tokens
    are ordinary text.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    df = df.drop("ids", "n_tokens") if text_col not in ("ids", "n_tokens") else df

    def compute(texts: pa.Array) -> list[tuple[bytes, int]]:
        by = encoder(path, pattern)
        out = []
        for text in texts:
            ids = by.encode(text.as_py() or "")
            out.append((ids, len(ids) // 4))
        return out

    return _mapped(df, df.columns, text_col, [("ids", "binary", pa.binary()), ("n_tokens", "bigint", pa.int64())], compute)


def decode(df: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded`` (binary, the bytes of the tokens); null ids give no bytes."""
    path = ranks_path or public_tokenizers.path(RANKS)
    df = df.drop("decoded")

    def compute(column: pa.Array) -> list[tuple[bytes]]:
        by = encoder(path, pattern)
        return [(by.decode(np.frombuffer(ids.as_py() or b"", np.dtype("<u4"))),) for ids in column]

    return _mapped(df, df.columns, ids_col, [("decoded", "binary", pa.binary())], compute)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
