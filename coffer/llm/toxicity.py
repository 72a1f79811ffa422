"""Toxicity by compression distance between dictionaries trained on toxic and on ordinary text.

A text is cut into overlapping windows of a few words. A window is compressed under
a dictionary that the zstandard library trained on windows of toxic documents, and
under one trained on windows of ordinary ones; the difference of the two lengths is
the window's gain. Both dictionaries end in the same base, trained on ordinary
windows, so that a window which both know equally well has no gain by chance, and
every window follows a header from that base, which hides a frame's fixed costs.

A toxic label says little about each window of its document. So the two
dictionaries are trained in rounds, each on the windows of its own class that the
other one of the round before does better on than it should: the toxic one on the
windows with gains that ordinary windows hardly reach, the ordinary one on those of
its windows that had a gain. What the first pair leaves unexplained, the documents
without any high gain, trains a second pair on top of the first; its ordinary dictionary
serves both toxic ones. Equal windows count once, so copies of a document carry no weight.

The threshold is calibrated: a document's gains give a few numbers whose logistic
weights come from labelled documents that no dictionary was trained on.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, in_fold, slices, written
from .labels import SAMPLE_ROWS, training_rows

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Words of a window, and how many of them the next window does not share.
WORDS, STRIDE = 5, 4
LEVEL, MIN_MATCH, TABLE_LOG = 12, 3, 14
#: Bytes of the base, of what each round trains on top of it, and of the header.
BASE_BYTES, OWN_BYTES, HEADER_BYTES = 48_000, 4_000, 64
#: Lengths of the segments and substrings that the trainer looks at, in the base and on top of it.
BASE_SEGMENT, OWN_SEGMENT, SUBSTRING = 24, 16, 6
#: Windows that the dictionaries are trained on at most, by class (the least by hash).
ORDINARY_WINDOWS, TOXIC_WINDOWS = 60_000, 150_000
#: Rounds of the two pairs, and the share of ordinary windows that stays below a toxic window's gain.
ROUNDS, BELOW = (5, 4), (0.995, 0.95)
#: A document is unexplained while no window of it gains so many bytes.
EXPLAINED = 7
REJECT_FROM = 0.3
#: Bytes of text whose windows are compressed at once.
SCORED_BYTES = 1 << 20


def windows(text: str | None) -> list[bytes]:
    """The distinct windows of a text in order; blank texts have none."""
    words = WORD.findall((text or "").lower().encode("utf-8", "replace"))
    last = max(1, len(words) - WORDS + STRIDE) if words else 0
    return list(dict.fromkeys(b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, last, STRIDE)))


@dataclass(frozen=True)
class Distance:
    """Pairs of dictionaries (ordinary, toxic), the header they share, and the calibrated weights."""

    pairs: tuple[tuple[bytes, bytes], ...]
    header: bytes
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    intercept: float = 0.0


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=96, min_match=MIN_MATCH, hash_log=TABLE_LOG, chain_log=TABLE_LOG, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def _gains(pair: tuple[bytes, bytes], header: bytes, of: list[bytes]) -> np.ndarray:
    """The bytes that the toxic dictionary saves on each window."""
    ordinary, toxic = (_compressor(d).compress for d in pair)
    return np.array([len(ordinary(header + w)) - len(toxic(header + w)) for w in of], np.int64)


def numbers(gains: np.ndarray) -> list[float]:
    """Of one pair's gains: mean, shares and counts beyond some bytes, the best, and the mean of the best three."""
    if not len(gains):
        return [0.0] * 12
    g = np.sort(gains)[::-1].astype(float)
    at_least = [float((g >= k).sum()) for k in range(1, 7)]
    return [float(g.mean()), *[n / len(g) for n in at_least[:3]], float(g[0]), float(g[:3].mean()), *np.log1p(at_least).tolist()]


class Scorer:
    """Features and scores of texts; holds the compressors of a task."""

    def __init__(self, by: Distance):
        self.by = by
        self.by_content = {d: _compressor(d).compress for pair in by.pairs for d in pair}

    def features(self, texts: list[str | None]) -> list[list[float]]:
        """Of each text. One dictionary is used on all windows before the next, so that it stays at hand."""
        own = [windows(t) for t in texts]
        flat = [self.by.header + w for ws in own for w in ws]
        lengths = {d: np.fromiter(map(len, map(compress, flat)), np.int64, len(flat)) for d, compress in self.by_content.items()}
        gains = [lengths[ordinary] - lengths[toxic] for ordinary, toxic in self.by.pairs]
        out, at = [], 0
        for ws in own:
            to = at + len(ws)
            out.append([float(np.log1p(len(ws))), *(x for g in gains for x in numbers(g[at:to]))])
            at = to
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        by = self.by
        z = (np.array(self.features(texts)).reshape(len(texts), len(by.means)) - by.means) / by.scales
        odds = np.clip((z * np.array(by.weights)).sum(1) + by.intercept, -30.0, 30.0)
        return (1 / (1 + np.exp(-odds))).tolist()


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; their own bytes where they are too few to train on."""
    if sum(map(len, samples)) < 2 * size:
        return b"".join(samples)[-size:]
    try:
        whole = zstandard.train_dictionary(size, samples, k=segment, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return whole[300:]  # what stands before is the library's header and entropy tables


def _refined(toxic: list[bytes], ordinary: list[bytes], below: tuple[bytes, bytes], base: bytes, rounds: int, quantile: float, first: bool) -> tuple[bytes, bytes]:
    """Dictionaries (ordinary, toxic) trained against each other, on top of those ``below``."""
    header = base[-HEADER_BYTES:]
    own_t, own_o = toxic, ordinary
    if first:  # begin with what the base knows worst
        known = _compressor(below[0] + base).compress
        share = [np.array([len(known(header + w)) / len(w) for w in of]) for of in (toxic, ordinary)]
        least = np.quantile(share[1], 0.9)
        own_t, own_o = ([w for w, s in zip(of, by) if s > least] for of, by in zip((toxic, ordinary), share))
    found = below
    for _ in range(rounds):
        if not own_t:
            break
        found = (trained(own_o, OWN_BYTES, OWN_SEGMENT) + below[0], trained(own_t, OWN_BYTES, OWN_SEGMENT) + below[1])
        pair = (found[0] + base, found[1] + base)
        gain_t, gain_o = _gains(pair, header, toxic), _gains(pair, header, ordinary)
        cut = max(1.0, float(np.quantile(gain_o, quantile)))
        own_t = [toxic[i] for i in np.argsort(-gain_t, kind="stable") if gain_t[i] > cut]
        hard = [ordinary[i] for i in np.argsort(-gain_o, kind="stable") if gain_o[i] >= 1]
        own_o = hard + own_o[: len(hard)]
    return found


def dictionaries(ordinary: list[bytes], toxic: list[tuple[bytes, int]]) -> Distance:
    """Both pairs. ``toxic`` holds windows with the document that each is of."""
    base = trained(ordinary[: len(ordinary) * 2 // 3], BASE_BYTES, BASE_SEGMENT) or b" " * HEADER_BYTES
    header = base[-HEADER_BYTES:]
    if not ordinary or not toxic:
        return Distance(((base, base),) * len(ROUNDS), header)
    texts = [w for w, _ in toxic]
    first = _refined(texts, ordinary, (b"", b""), base, ROUNDS[0], BELOW[0], True)
    most: dict[int, int] = defaultdict(int)
    pair = (first[0] + base, first[1] + base)
    for (_, doc), gain in zip(toxic, _gains(pair, header, texts).tolist()):
        most[doc] = max(most[doc], gain)
    left = [w for w, doc in toxic if most[doc] < EXPLAINED]
    second = _refined(left, ordinary, first, base, ROUNDS[1], BELOW[1], False)
    known = second[0] + base  # what both toxic dictionaries are compared with: it holds the first ordinary one
    return Distance(((known, pair[1]), (known, second[1] + base)), header)


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        doc, label, own = [], [], []
        for d, text, y in zip(*(c.to_pylist() for c in batch.columns)):
            found = windows(text)
            doc += [d] * len(found)
            label += [y] * len(found)
            own += found
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(label, pa.int32()), pa.array(own, pa.binary())], names=["doc_id", "label", "window"])


def _features_of(by: Distance):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(by)
        for batch in slices(batches, 1, SCORED_BYTES):
            rows = scorer.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["label", "features"])

    return run


def calibrated(by: Distance, rows: list[tuple[int, list[float]]], rate: float) -> Distance:
    """Logistic weights by Newton's method with a small ridge; without both classes, the rate itself."""
    n = 1 + 12 * len(by.pairs)
    x = np.array([r[1] for r in rows]).reshape(-1, n)
    y = np.array([r[0] for r in rows], float)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 20 or y.min() == y.max():
        return Distance(by.pairs, by.header, (0.0,) * n, (1.0,) * n, (0.0,) * n, base)
    means, scales = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - means) / scales, np.ones(len(y))])
    w = np.zeros(n + 1)
    ridge = np.diag([1.0] * n + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        w -= np.linalg.solve(hessian, z.T @ (p - y) + ridge @ w)
    return Distance(by.pairs, by.header, tuple(map(float, means)), tuple(map(float, scales)), tuple(map(float, w[:-1])), float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, rows: int = SAMPLE_ROWS) -> Distance:
    """Dictionaries from two thirds of a bounded labelled sample, calibrated on the other third.

    The driver gets ORDINARY_WINDOWS and TOXIC_WINDOWS windows at most and the features of the sample's rows.
    """
    sample = written(training_rows(docs, labels, label, modulus, remainder, rows), "labelled")
    kept = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / modulus) % 3 == 0
    own = sample.where(~kept).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    distinct = own.mapInArrow(_windows_of, "doc_id bigint, label int, window binary").groupBy("label", "window").agg(F.min("doc_id").alias("doc_id"))
    distinct = written(distinct, "windows")

    def least(of: int, most: int) -> list[tuple[bytes, int]]:
        got = distinct.where(F.col("label") == of).orderBy(F.xxhash64("window"), "window").limit(most)
        return [(bytes(r.window), r.doc_id) for r in got.toLocalIterator()]

    by = dictionaries([w for w, _ in least(0, ORDINARY_WINDOWS)], least(1, TOXIC_WINDOWS))
    ones, total = sample.agg(F.sum("label"), F.count("*")).first()
    features = sample.where(kept).select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(_features_of(by), "label int, features array<double>")
    return calibrated(by, [(r.label, r.features) for r in features.toLocalIterator()], ((ones or 0) + 1) / (total + 2))


@lru_cache(maxsize=2)
def _scorer(by: Distance) -> Scorer:
    return Scorer(by)


def classify(df: DataFrame, model: Distance, text_col: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """Every row of ``df`` with toxicity score and predicted added; columns of those names are replaced.

    Null and empty texts have no window and a score of their own; texts of fewer
    words than a window are one window; equal texts have equal scores; an empty
    table gives an empty result.
    """
    df = df.drop("score", "predicted")
    names = df.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + ["`score` double", "`predicted` int"])
    shared = df.sparkSession.sparkContext.broadcast(model)  # three dictionaries of under 64 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in slices(batches, names.index(text_col), SCORED_BYTES):
            scores = scorer.scores(batch.column(names.index(text_col)).to_pylist())
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= reject_from) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    return df.select(*[column(df, c) for c in names]).mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learns outside the fold of crc32(doc_id) % 4 = 2. Edge cases: see ``classify``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
