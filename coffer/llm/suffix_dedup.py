"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Only suffixes that can matter are sorted:

1. *Anchors.* In every window of ``length`` bytes the GRAM bytes with the least
   hash are its anchor, so equal windows have equal anchors at equal places, and
   each window belongs to one anchor. An anchor whose hash occurs once in the
   corpus has windows that occur once; only the others go on. Their hashes are
   exchanged packed, and repeats within one batch are known without an exchange.
2. *Runs.* The suffix at an anchor, as far as its windows reach, followed by the
   bytes before it in reverse, is one string. A task sorts its strings; equal ones
   fold into the earliest. The sorted run is front-coded (each string as the
   number of bytes it shares with the one before, and the rest) and dealt out by
   the anchor's hash.
3. *Merge.* A loser tree merges the runs of a task. It carries for each run the
   prefix its head shares with the last winner: of two heads the one that shares
   more is the smaller, and only equals are compared, from there on. So no byte
   that is known to be shared is compared again, and the merge yields the shared
   prefix of each string with the one before.
4. *Verdict.* Strings that are shared in full are one class, whose windows start
   earlier at its earliest place. Classes that share only the anchor are compared
   around it: their windows are equal as far as both contexts are.

Anchors too frequent for one merge task do not take part in 2 to 4:
equal surroundings fold into the earliest where they are read, and the windows of the
others are grouped by their bytes. Verdicts leave a run as ranges that are joined.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, slices, written

LENGTH = 100
GRAM = 32
#: An anchor at more places than this, and than a merge task has on average, is resolved by grouping
#: its windows. There are fewer such anchors than merge tasks.
HOT = 20_000
#: Classes around one anchor that are compared with each other; beyond that their windows are grouped.
CLASSES = 512
#: Windows that are folded at once before they are grouped.
FOLDED = 100_000
#: Bytes of text that one vectorised step covers.
CHUNK = 1 << 19
#: Bytes of texts whose anchors are found at once, and of strings in one run.
FIND_BYTES, RUN_BYTES = 12 << 20, 12 << 20
#: Bytes of all texts that one merge task stands for; more input means more tasks, not larger ones.
PART_BYTES = 64 << 20

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position of the last axis on, by doubling."""
    h, m = data.astype(np.uint64), 1
    while m < GRAM:
        n = h.shape[-1] - m
        if n <= 0:
            return np.zeros(0, np.uint64)
        right = h[..., m:]
        h = (h[..., :n] * _MUL) ^ ((right + (right >> np.uint64(29))) * _MIX)
        h ^= h >> np.uint64(32)
        m *= 2
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor, in order; windows by their start.

    ``ends`` are the ends of the texts that ``data`` is made of; windows lie within
    one text. Hashes are compared by their high bits, and the rightmost of equals is
    the anchor. Every window belongs to exactly one anchor.
    """
    bits = np.uint64(23)
    mask = np.uint64((1 << 23) - 1)
    inside = np.ones(len(data), bool)
    begin = 0
    for end in ends.tolist():
        inside[max(begin, end - length + 1) : end] = False
        begin = end
    parts, span = [], length - GRAM + 1
    for lo in range(0, len(data), CHUNK):
        ok = inside[lo : lo + CHUNK]
        if not ok.any():
            continue
        h = gram_hashes(data[lo : lo + CHUNK + length - 1])
        key = (h >> bits << bits) | (mask - np.arange(len(h), dtype=np.uint64))
        m = 1
        while 2 * m <= span:
            key = np.minimum(key[:-m], key[m:])
            m *= 2
        key = np.minimum(key[: len(key) - (span - m)], key[span - m :]) if span > m else key
        starts = np.flatnonzero(ok[: len(key)])
        key = key[starts]
        new = np.concatenate(([True], (key[1:] != key[:-1])))
        at = np.flatnonzero(new)
        pos = (mask - (key[at] & mask)).astype(np.int64)
        last = starts[np.append(at[1:], len(starts)) - 1]
        parts.append((h[pos], pos + lo, starts[at] + lo, last + lo))
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def _places(position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's position and windows as one number (the windows lie within 100 bytes before it)."""
    return (position << 16) | ((position - first) << 8) | (position - last)


def _from_place(place: int) -> tuple[int, int, int]:
    """Position, and how far before it the first and the last window start."""
    return place >> 16, (place >> 8) & 255, place & 255


# Runs: sorted distinct strings, front-coded.


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that both begin with; the first ``known`` are known to be shared."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_coded(items: list[tuple[bytes, int, int, int]]) -> bytes:
    """A sorted run of (string, doc, place, text's hash) packed: shared bytes, length of the rest, numbers, rest."""
    out, before = [], b""
    for text, doc, place, own in items:
        k = shared_prefix(before, text)
        out.append(struct.pack("<HHqqq", k, len(text) - k, doc, own, place))
        out.append(text[k:])
        before = text
    return zlib.compress(b"".join(out), 1)


def decoded(packed: bytes) -> Iterator[tuple]:
    """(bytes shared with the one before, string, doc, place, text's hash) of a front-coded run."""
    data, at, before = zlib.decompress(packed), 0, b""
    while at < len(data):
        k, rest, doc, own, place = struct.unpack_from("<HHqqq", data, at)
        at += 28
        before = before[:k] + data[at : at + rest]
        at += rest
        yield k, before, doc, place, own


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs by a loser tree; yields (bytes shared with the last one out, string, doc, place, text's hash).

    A node keeps the loser of its two subtrees and what that shares with the
    winner that passed it. Equal strings come out in order of (doc, place).
    """
    n = 1
    while n < len(runs):
        n *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (n - len(runs))
    sources = list(runs)
    shared = [0] * n  # with the last winner, per source
    losers = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is then the one with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shared[a], shared[b]
        if p > q:
            return a, b  # b parted from the last winner earlier, so it is larger
        if q > p:
            return b, a
        k = shared_prefix(x[1], y[1], p)
        s, t = x[1], y[1]
        if k == len(s) or k == len(t):
            first = (len(s), x[2], x[3]) <= (len(t), y[2], y[3])
        else:
            first = s[k] < t[k]
        if first:
            shared[b] = k
            return a, b
        shared[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if n == 1:
        winner = 0
    else:
        winner = build(1)
    while heads[winner] is not None:
        yield (shared[winner], *heads[winner][1:])
        heads[winner] = following = next(sources[winner], None)
        shared[winner] = following[0] if following is not None else 0
        node = (winner + n) // 2
        while node >= 1:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


# Verdicts: rows (doc, first window start, number of window starts) that start earlier elsewhere.


NO_ID = -(2**63)
_PACKED = "p int, docs binary, own binary, places binary, hashes binary, counts binary, known boolean"
_PLACED = "doc bigint, own bigint, place bigint, hot bigint"
_ROWS = "kind int, p int, payload binary, doc bigint, own bigint, start bigint, n bigint"
_RUN, _VERDICT, _WINDOW = 0, 1, 2


def _batch_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings, and where each text ends."""
    pieces = [(t.as_py() or "").encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(x) for x in pieces], dtype=np.int64)


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64)


def _find(length: int, parts: int):
    """Texts to packed anchors, dealt out by their hash; repeats within a batch go along as known."""

    def pack(p: int, docs, own, places, hashes, counts, known: bool) -> tuple:
        z = lambda x: zlib.compress(x.tobytes(), 1)
        return p, z(docs), z(own), z(places), hashes.tobytes(), z(counts), known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, FIND_BYTES):
            doc, own = _numbers(batch.column(0)), _numbers(batch.column(1))
            data, ends = _batch_text(batch.column(2))
            h, pos, first, last = anchors(data, ends, length)
            if not len(h):
                continue
            at = np.searchsorted(ends, pos, side="right")
            begin = np.concatenate(([0], ends))[at]
            place = _places(pos - begin, first - begin, last - begin)
            order = np.argsort(h, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            counts = np.diff(np.append(heads, len(h)))
            many = np.repeat(counts > 1, counts)
            dup = np.sort(order[many])
            rows = [pack(int(h[0] % np.uint64(parts)), doc[at[dup]], own[at[dup]], place[dup], h[dup], np.zeros(0, np.int64), True)] if len(dup) else []
            one, n = order[heads], counts
            by_place = np.argsort(one, kind="stable")
            one, n = one[by_place], n[by_place]
            to = (h[one] % np.uint64(parts)).astype(np.int64)
            deal = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[deal], np.arange(parts + 1))
            for p in range(parts):
                k = deal[edges[p] : edges[p + 1]]
                if len(k):
                    i = one[k]
                    rows.append(pack(p, doc[at[i]], own[at[i]], place[i], h[i], n[k].astype(np.int32), False))
            kinds = [pa.int32(), *[pa.binary()] * 5, pa.bool_()]
            names = ["p", "docs", "own", "places", "hashes", "counts", "known"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the packed anchors of a partition, the places of those whose hash is there more than once.

    A last row for each hash at more than HOT places holds it as ``hot``.
    """
    got: dict[str, list] = defaultdict(list)

    def out(doc, own, place, hot=None) -> pa.RecordBatch:
        hot = pa.nulls(len(doc), pa.int64()) if hot is None else pa.array(hot, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(own), pa.array(place), hot], names=["doc", "own", "place", "hot"])

    unzip = lambda x, kind: np.frombuffer(zlib.decompress(x), kind)
    for batch in batches:
        for r in batch.to_pylist():
            doc, own, place = (unzip(r[k], np.int64) for k in ("docs", "own", "places"))
            if r["known"]:
                yield out(doc, own, place)
                continue
            for k, v in (("doc", doc), ("own", own), ("place", place), ("h", np.frombuffer(r["hashes"], np.uint64)), ("n", unzip(r["counts"], np.int32))):
                got[k].append(v)
    if got:
        x = {k: np.concatenate(v) for k, v in got.items()}
        order = np.argsort(x["h"], kind="stable")
        h = x["h"][order]
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        entries = np.diff(np.append(heads, len(h)))
        # An entry that stands for several of its batch is known there already.
        new = order[np.repeat(entries > 1, entries)]
        new = new[x["n"][new] == 1]
        yield out(x["doc"][new], x["own"][new], x["place"][new])
        total = np.add.reduceat(x["n"][order].astype(np.int64), heads)
        hot = total > HOT
        if hot.any():
            none = np.zeros(int(hot.sum()), np.int64)
            yield out(total[hot], none, none, h[heads[hot]].view(np.int64))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
    names = ["kind", "p", "payload", "doc", "own", "start", "n"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _verdict(doc: int, own: int, place: int, far: int | None = None, near: int | None = None) -> tuple:
    pos, whole_far, whole_near = _from_place(place)
    far, near = whole_far if far is None else far, whole_near if near is None else near
    return _VERDICT, None, None, doc, own, pos - far, far - near + 1


def _windows(text: bytes, doc: int, place: int, own: int, length: int) -> list[tuple[bytes, int, int, int]]:
    """(window, doc, start, own) of the windows around an anchor, by its string."""
    pos, far, near = _from_place(place)
    cut = length - near
    whole = text[cut + 2 :][::-1] + text[:cut]
    return [(whole[far - d : far - d + length], doc, pos - d, own) for d in range(near, far + 1)]


def _fold_windows(windows: list[tuple[bytes, int, int, int]]) -> Iterator[tuple]:
    """(window, doc, start, own) to one row per distinct window, and verdicts on the rest."""
    windows.sort()
    first = None
    for w, doc, start, own in windows:
        if first is None or w != first[0]:
            first = (w, doc, start)
            yield _WINDOW, None, w, doc, own, start, 1
        elif (doc, start) > first[1:]:
            yield _VERDICT, None, None, doc, own, start, 1
        else:  # the same place in a repeated row
            yield _WINDOW, None, w, doc, own, start, 1


def _joined(verdicts: list[tuple]) -> list[tuple]:
    """The same window starts in fewer rows: of each document, ranges that meet or overlap are one."""
    out: list[list] = []
    for doc, own, start, n in sorted(v[3:] for v in verdicts):
        if out and out[-1][:2] == [doc, own] and start <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], start + n - out[-1][2])
        else:
            out.append([doc, own, start, n])
    return [(_VERDICT, None, None, *v) for v in out]


def _at_hot(batch: pa.RecordBatch, hot: np.ndarray) -> Iterator[bool]:
    """Of each place in a batch of (doc, own, text, places), whether its anchor is hot."""
    data, ends = _batch_text(batch.column(2))
    offsets = batch.column(3).offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    pos = np.concatenate(([0], ends))[row] + (_numbers(batch.column(3).flatten()) >> 16)
    for lo in range(0, len(pos), 1 << 15):
        grams = data[pos[lo : lo + (1 << 15), None] + np.arange(GRAM)]
        yield from np.isin(gram_hashes(grams)[:, 0].view(np.int64), hot).tolist()


def _cut_runs(length: int, parts: int, hot: np.ndarray):
    """Texts with their repeated anchors to sorted front-coded runs, and what is settled already."""

    def flush(strings: list[tuple], crowded: list[tuple]) -> Iterator[pa.RecordBatch]:
        strings.sort()
        out, settled, windows, runs, first = [], [], [], defaultdict(list), None
        for item in strings:
            text, doc, place, own = item
            if first is not None and text == first[0]:
                if (doc, place) > first[1:3]:
                    settled.append(_verdict(doc, own, place))
                    continue
                runs[first[4]].append(item)  # the same place in a repeated row
                continue
            p = zlib.crc32(text[:GRAM]) % parts
            first = (text, doc, place, own, p)
            runs[p].append(item)
        # Of equal surroundings of a hot anchor, the earliest alone is taken apart into windows.
        crowded.sort()
        first = None
        for text, doc, place, own in crowded:
            if first is not None and text == first[0] and (doc, place) > first[1:]:
                settled.append(_verdict(doc, own, place))
                continue
            first = (text, doc, place)
            windows += _windows(text, doc, place, own, length)
        for row in _fold_windows(windows):
            (settled if row[0] == _VERDICT else out).append(row)
        out += [(_RUN, p, front_coded(items), None, None, None, None) for p, items in runs.items()]
        out += _joined(settled)
        for k in range(0, len(out), 20_000):
            yield _rows(out[k : k + 20_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, crowded, held = [], [], 0
        for batch in slices(batches, 2):
            is_hot = _at_hot(batch, hot) if len(hot) else None
            for doc, own, text, places in zip(*(batch.column(i) for i in range(4))):
                data, doc, own = text.as_py().encode("utf-8", "replace"), doc.as_py(), own.as_py()
                for place in places.as_py():
                    pos, far, near = _from_place(place)
                    # the suffix as far as its windows reach, their range, and the bytes before in reverse
                    text_at = data[pos : pos - near + length] + bytes((far, near)) + data[pos - far : pos][::-1]
                    hot_here = is_hot is not None and next(is_hot)
                    (crowded if hot_here else strings).append((text_at, doc, place, own))
                    held += (far - near + 1) * length if hot_here else length + far
                if held > RUN_BYTES:
                    yield from flush(strings, crowded)
                    strings, crowded, held = [], [], 0
        yield from flush(strings, crowded)

    return run


def _settle(group: list[list], length: int) -> Iterator[tuple]:
    """Verdicts on the first places of the classes around one anchor.

    ``group``: per class, in suffix order, [shared with the one before, string, doc, place, own].
    """
    if len(group) == 1:
        return
    if len(group) > CLASSES:
        windows = []
        for _, text, doc, place, own in group:
            windows += _windows(text, doc, place, own, length)
            if len(windows) > FOLDED:
                yield from _fold_windows(windows)
                windows = []
        yield from _fold_windows(windows)
        return
    halves = []
    for _, text, doc, place, own in group:
        _, far, near = _from_place(place)
        halves.append((text[length - near + 2 :], far, near, (doc, place >> 16)))
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in range(1, len(group)):
        right = length
        left_i, far_i, near_i, at_i = halves[i]
        for j in range(i - 1, -1, -1):
            right = min(right, group[j + 1][0])
            left_j, far_j, near_j, at_j = halves[j]
            reach = min(right, length - near_i, length - near_j)
            near, far = length - reach, min(far_i, far_j)
            if near > far or at_i == at_j:
                continue
            far = min(far, shared_prefix(left_i, left_j))
            if near <= far:
                found[i if at_j < at_i else j].append((near, far))
    for i, ranges in found.items():
        _, _, doc, place, own = group[i]
        for near, far in ranges:
            yield _verdict(doc, own, place, far, near)


def _merge(length: int):
    """The runs of a partition, merged, to verdicts and windows."""

    def settled(packed: list[bytes]) -> Iterator[tuple]:
        group: list[list] = []
        for k, text, doc, place, own in merged([decoded(x) for x in packed]):
            if group and k >= GRAM and k == len(text) == len(group[-1][1]):
                if (doc, place) > tuple(group[-1][2:4]):
                    yield _verdict(doc, own, place)
                    continue
            elif group and k < GRAM:
                yield from _settle(group, length)
                group = []
            group.append([k, text, doc, place, own])
        yield from _settle(group, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list] = defaultdict(list)
        for batch in batches:
            for p, payload in zip(batch.column(0), batch.column(1)):
                runs[p.as_py()].append(payload.as_py())
        out: list[tuple] = []
        for row in (row for packed in runs.values() for row in settled(packed)):
            out.append(row)
            if len(out) >= 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _finish(length: int, names: list[str]):
    """Texts and verdicts to spans and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            for part in slices(iter([batch]), n - 3):
                spans, kept, size = [], [], []
                for text, starts, counts in zip(part.column(n - 3), part.column(n - 2), part.column(n - 1)):
                    data = (text.as_py() or "").encode("utf-8", "replace")
                    own: list[list[int]] = []
                    for a, k in sorted(zip(starts.as_py() or [], counts.as_py() or [])):
                        b = a + k - 1 + length
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], b)
                        else:
                            own.append([a, b])
                    out, at = [], 0
                    for a, b in own:
                        out.append(data[at:a])
                        at = b
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(b"".join(out) + data[at:])
                    size.append(len(data))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                added = [pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: n - 3], part.column(n - 3), *added], names=[*names, "text", "n_bytes", "removed", "kept"])

    return run


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Every row of ``df`` with n_bytes, removed (spans of bytes, in order) and kept (the other bytes).

    A byte is removed if a string of ``length`` bytes that covers it also starts in
    a text with a smaller id, or earlier in the same one. Null ids come before all
    others; rows that share an id are parts of one document, and a string at the
    same place of two of them starts at one place. Null and empty texts, and texts
    under ``length`` bytes, keep all. Columns of the added names are replaced.
    """
    if not GRAM <= length <= GRAM + 200:
        raise ValueError(f"length must lie between {GRAM} and {GRAM + 200}")
    spark = df.sparkSession
    df = df.drop(*[c for c in ("n_bytes", "removed", "kept") if c not in (text_col, id_col)])
    names = df.columns
    size = df.agg(F.sum(F.octet_length(column(df, text_col).cast("string")))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    text, doc = column(df, text_col).cast("string"), F.coalesce(column(df, id_col).cast("long"), F.lit(NO_ID))
    keyed = [doc.alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("own")]

    packed = df.select(*keyed, text.alias("text")).mapInArrow(_find(length, parts), _PACKED)
    placed = written(packed.repartition(parts, "p").mapInArrow(_repeated, _PLACED), "places")
    total = placed.where("hot IS NULL").count()
    least = max(HOT, total // parts)
    hot = np.array([r[0] for r in placed.where(F.col("hot").isNotNull() & (F.col("doc") > least)).select("hot").collect()], np.int64)

    by_text = placed.where("hot IS NULL").groupBy("doc", "own").agg(F.collect_list("place").alias("places"))
    texts = df.select(*keyed, text.alias("text"))
    joined = texts.join(by_text.hint("shuffle_hash"), ["doc", "own"]).select("doc", "own", "text", "places")
    rows = written(joined.mapInArrow(_cut_runs(length, parts, hot), _ROWS), "runs")
    merged_rows = written(
        rows.where(F.col("kind") == _RUN).select("p", "payload").repartition(parts, "p").mapInArrow(_merge(length), _ROWS), "merged"
    )
    both = rows.where(F.col("kind") != _RUN).unionByName(merged_rows)

    found = both.where(F.col("kind") == _WINDOW).groupBy("payload").agg(F.min(F.struct("doc", "start")).alias("first"))
    late = both.where(F.col("kind") == _WINDOW).join(found, "payload").where(F.struct("doc", "start") > F.col("first"))
    verdicts = both.where(F.col("kind") == _VERDICT).select("doc", "own", "start", "n").unionByName(late.select("doc", "own", "start", "n"))
    by_doc = verdicts.distinct().groupBy("doc", "own").agg(F.collect_list(F.struct("start", "n")).alias("v"))
    out = df.select(*keyed, F.struct(*[column(df, c).alias(f"c{i}") for i, c in enumerate(names) if c != text_col]).alias("rest") if len(names) > 1 else F.struct(F.lit(0).alias("none")).alias("rest"), text.alias("text"))
    out = out.join(by_doc.hint("shuffle_hash"), ["doc", "own"], "left").select("rest", "text", F.col("v.start").alias("starts"), F.col("v.n").alias("ns"))
    kind = dict(out.dtypes)["rest"]
    done = out.mapInArrow(_finish(length, ["rest"]), f"rest {kind}, text string, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
    back = [(F.col("text") if c == text_col else F.col("rest")[f"c{i}"]).alias(c) for i, c in enumerate(names)]
    return done.select(*back, "n_bytes", "removed", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
