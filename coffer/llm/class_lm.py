"""Language-model scores by a class bigram model in the manner of Brown et al.

Words are sorted into classes, and a token's probability is that of its class after
the class before, times that of the word in its class, mixed with a smoothed unigram.

1. *Counts.* Every word of the training texts is counted in Spark.
2. *Exchange.* The UNITS - 2 commonest words, the end of a text, and all other words
   as one unit: the bigrams of these units are counted in Spark, and the driver
   sorts the words by the exchange algorithm. A word moves to the class in which the
   class bigrams of the corpus are likeliest; all counts follow each move, so the
   likelihood never falls, and the algorithm ends when no word moves or a round gains
   next to nothing.
3. *All other words.* Each word seen LEAST times or more gets its class by one
   exchange step of its own. Its left and right neighbours' classes are counted in
   Spark, and the step's gain is taken in the first order, as such a word's counts
   are small against those of a class. So the classed words grow with the corpus.
   Still rarer words share the last class with words to come.
4. *Sequences.* Every text becomes the sequence of its words' classes. Counts and
   classes of the HEAD commonest words go along to where texts are read; those of
   other words are joined, with the places that they are at.
5. *Scores.* Class bigrams are counted over the sequences of the training texts.

The driver sees the bigrams of the units, HEAD words, and counts per pair of classes.
Probabilities of the next token, words to come as one kind included, sum to 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, in_fold, slices, written

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UNITS, HEAD, LEAST = 1 << 11, 1 << 17, 4
#: Classes, rounds of the exchange at most, and the share of the likelihood that a round has to gain.
CLASSES, ROUNDS, ENOUGH = 64, 12, 1e-5
#: Weight of the class model beside the unigram, and of the classes' shares beside the bigrams of a class.
MIX, SMOOTH = 0.95, 2.0
END = b""
#: Stands in a sequence for a word whose class is joined.
LATER = 255


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the end of the text is not among them."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0):
        n: Counter = Counter()
        for text in batch.column(0):
            n.update(tokens(text.as_py()))
            n[END] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "c"])


@dataclass
class Lexicon:
    """The commonest words with their counts and classes, the end of a text among them."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray  # LATER where a word's class is not known yet
    _place: dict = field(default_factory=dict, repr=False)

    def place(self) -> dict[bytes, int]:
        if not self._place:
            self._place.update((w, i) for i, w in enumerate(self.words))
        return self._place

    def __getstate__(self):
        return {"blob": b"\n".join(self.words), "counts": self.counts, "classes": self.classes}

    def __setstate__(self, s):
        self.words = s["blob"].split(b"\n") if len(s["counts"]) else []
        self.counts, self.classes, self._place = s["counts"], s["classes"], {}


def _flat(texts: pa.Array, place: dict[bytes, int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All tokens of the texts with their ends, the place of each or -1, and where each text stops."""
    flat, stops = [], []
    for text in texts:
        flat += tokens(text.as_py())
        flat.append(END)
        stops.append(len(flat))
    return flat, np.fromiter((place.get(w, -1) for w in flat), np.int64, len(flat)), np.array(stops, np.int64)


def _unit_bigrams(lexicon):
    """Bigrams of the units as packed pairs: the place of a word of the lexicon, or its length for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = lexicon.value.place()
        n, end = len(place), place[END]
        for batch in slices(batches, 0):
            _, unit, stops = _flat(batch.column(0), place)
            unit[unit < 0] = n
            before = np.concatenate(([end], unit[:-1]))
            before[stops[:-1]] = end
            codes, count = np.unique(before * (n + 1) + unit, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(count.astype(np.int64))], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """The part of the corpus' log-likelihood that depends on the classes, by the counts of class bigrams."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())


def class_bigrams(bigrams: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    onto = np.zeros((len(classes), n_classes))
    onto[np.arange(len(classes)), classes] = 1
    return onto.T @ bigrams @ onto


def exchange(bigrams: np.ndarray, classes: np.ndarray, n_classes: int, fixed: set[int], rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Classes after the exchange algorithm, and the likelihood before it and after each round.

    Units move in the order of their counts, into classes that no fixed unit is in.
    Class bigrams and the contexts of later units follow each move.
    """
    classes, m = classes.copy(), class_bigrams(bigrams, classes, n_classes)
    total = bigrams.sum(1)
    free = np.ones(n_classes, bool)
    free[[classes[u] for u in fixed]] = False
    course = [likelihood(m)]
    for _ in range(rounds):
        moved = 0
        for u in np.argsort(-total, kind="stable").tolist():
            if u in fixed or total[u] == 0:
                continue
            s, a = bigrams[u, u], int(classes[u])
            left = np.bincount(classes, bigrams[:, u], n_classes)
            right = np.bincount(classes, bigrams[u], n_classes)
            left[a] -= s
            right[a] -= s
            m[a, :] -= right
            m[:, a] -= left
            m[a, a] -= s
            rows, cols, d, known = m.sum(1) + left, m.sum(0) + right, np.diag(m), _xlogx(m)
            gain = (_xlogx(m + right[None, :]) - known).sum(1) + (_xlogx(m + left[:, None]) - known).sum(0)
            gain += _xlogx(d + right + left + s) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= _xlogx(rows + right.sum() + s) - _xlogx(rows) + _xlogx(cols + left.sum() + s) - _xlogx(cols)
            best = int(np.where(free, gain, -np.inf).argmax())
            b = best if gain[best] > gain[a] + 1e-6 else a
            moved += b != a
            m[b, :] += right
            m[:, b] += left
            m[b, b] += s
            classes[u] = b
        m = class_bigrams(bigrams, classes, n_classes)  # without what rounding has added up
        course.append(likelihood(m))
        if not moved or course[-1] - course[-2] < ENOUGH * abs(course[-1]):
            break
    return classes, course


def _contexts(lexicon, n_classes: int):
    """For words without a class: (place, word, context, n); contexts are the class before, or n_classes and the class after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        place, end, others = lex.place(), n_classes - 2, n_classes - 1
        for batch in slices(batches, 0):
            flat, at, stops = _flat(batch.column(0), place)
            own = np.where(at >= 0, lex.classes[at], LATER)
            todo = np.flatnonzero(own == LATER)
            own = np.where(own == LATER, others, own).astype(np.int64)
            before = np.concatenate(([end], own[:-1]))
            before[stops[:-1]] = end
            after = np.append(own[1:], end)
            held = todo[at[todo] >= 0]
            tail = todo[at[todo] < 0]
            named = pa.array([flat[i] for i in tail.tolist()], pa.binary()).dictionary_encode()
            kinds = named.dictionary
            key = np.concatenate((at[held], len(place) + named.indices.to_numpy(zero_copy_only=False).astype(np.int64)))
            which = np.concatenate((held, tail))
            pairs = np.concatenate((key * 2 * n_classes + before[which], key * 2 * n_classes + n_classes + after[which]))
            codes, n = np.unique(pairs, return_counts=True)
            key, context = codes // (2 * n_classes), codes % (2 * n_classes)
            is_tail = key >= len(place)
            word = kinds.take(pa.array(np.where(is_tail, key - len(place), 0), mask=~is_tail))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(is_tail, -1, key)), word.cast(pa.binary()), pa.array(context.astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["place", "word", "context", "n"],
            )

    return run


def _assigned(pairs: np.ndarray):
    """The class of each word with its contexts, by the first-order gain of an exchange step."""
    n = len(pairs)
    logs = np.log(pairs + 0.1)
    size = np.log(pairs.sum(1) + 1) + np.log(pairs.sum(0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            contexts, counts = lists.flatten().flatten()
            seen = np.zeros((batch.num_rows, 2 * n))
            np.add.at(seen, (row, contexts.to_numpy(zero_copy_only=False)), counts.to_numpy(zero_copy_only=False))
            gain = seen[:, :n] @ logs + seen[:, n:] @ logs.T - seen[:, n:].sum(1, keepdims=True) * size
            best = gain[:, : n - 2].argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32))], names=["place", "word", "class"])

    return run


@dataclass
class Classes:
    """Every word of the training texts with its count and class, the commonest of them also as a lexicon."""

    lexicon: Lexicon
    words: DataFrame  # word, c, class
    n_classes: int
    tokens: int
    distinct: int
    course: list[float]


def cluster(docs: DataFrame, text_col: str = "text", n_classes: int = CLASSES, rounds: int = ROUNDS) -> Classes:
    """Counts and classes of all words of the texts; the last two classes are the end's and the rarest words'. No texts: none."""
    spark = docs.sparkSession
    texts = docs.select(column(docs, text_col).cast("string").alias("text"))
    counts = written(texts.mapInArrow(_counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    if not total:
        none = counts.withColumn("class", F.lit(0))
        return Classes(Lexicon([], np.zeros(0, np.int64), np.zeros(0, np.int64)), none, n_classes, 0, 0, [])
    common = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(HEAD)
    head = [(bytes(r.word), r.c) for r in common.toLocalIterator()]  # HEAD rows at most, read a partition at a time
    ends = counts.where(F.col("word") == F.lit(END)).first().c

    n = min(len(head), UNITS - 2)
    units = Lexicon([w for w, _ in head[:n]] + [END], np.array([c for _, c in head[:n]] + [ends], np.int64), np.zeros(n + 1, np.int64))
    shared = spark.sparkContext.broadcast(units)  # UNITS words at most
    found = texts.mapInArrow(_unit_bigrams(shared), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # UNITS squared rows at most
    bigrams = np.zeros((n + 2) ** 2)
    bigrams[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    bigrams = bigrams.reshape(n + 2, n + 2)
    start = np.append(np.arange(n) % (n_classes - 2), [n_classes - 2, n_classes - 1])
    classes, course = exchange(bigrams, start, n_classes, {n, n + 1}, rounds)
    pairs = class_bigrams(bigrams, classes, n_classes)

    own = np.full(len(head) + 1, LATER, np.int64)
    own[:n], own[-1] = classes[:n], n_classes - 2
    lexicon = Lexicon([w for w, _ in head] + [END], np.array([c for _, c in head] + [ends], np.int64), own)
    shared = spark.sparkContext.broadcast(lexicon)  # HEAD words at most
    seen = texts.mapInArrow(_contexts(shared, n_classes), "place bigint, word binary, context int, n bigint")
    seen = seen.groupBy("place", "word", "context").agg(F.sum("n").alias("n"))
    seen = seen.groupBy("place", "word").agg(F.collect_list(F.struct("context", "n")).alias("contexts"), F.sum("n").alias("n"))  # two per class at most
    seen = seen.where(F.col("n") >= 2 * LEAST).select("place", "word", "contexts")
    assigned = written(seen.mapInArrow(_assigned(pairs), "place bigint, word binary, class int"), "classes")
    for r in assigned.where("place >= 0").select("place", "class").toLocalIterator():  # HEAD rows at most
        own[r.place] = r["class"]
    lexicon.classes = np.where(own == LATER, n_classes - 1, own)
    listed = spark.createDataFrame(list(zip(map(bytearray, lexicon.words), lexicon.classes.tolist())), "h_word binary, h_class int")
    tail = assigned.where("place < 0").select(F.col("word").alias("h_word"), F.col("class").alias("h_class"))
    words = counts.join(listed.unionByName(tail), F.col("word") == F.col("h_word"), "left")
    words = words.select("word", "c", F.coalesce("h_class", F.lit(n_classes - 1)).alias("class"))
    return Classes(lexicon, written(words, "words"), n_classes, total, distinct, course)


_MAIN = "doc bigint, own bigint, n_tokens bigint, n_head bigint, plus double, seq binary"
_TAIL = "word binary, texts array<struct<doc:bigint,own:bigint,at:binary>>"


def _head_sequences(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        place = lex.place()
        for batch in slices(batches, 2):
            _, at, stops = _flat(batch.column(2), place)
            starts = np.concatenate(([0], stops[:-1]))
            known = at >= 0
            own = (np.where(known, lex.classes[at], LATER) if len(place) else np.full(len(at), LATER)).astype(np.uint8)
            plus = np.where(known, np.log10((lex.counts[at] if len(place) else 0) + 1.0), 0.0)
            packed = [own[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), plus)]
            columns = [batch.column(0), batch.column(1), pa.array(stops - starts), pa.array(sums[0]), pa.array(sums[1]), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "own", "n_tokens", "n_head", "plus", "seq"])

    return run


def _tail_words(lexicon):
    """(word, the texts that hold it with its places there) of words that are not in the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = lexicon.value.place()
        entry = pa.struct([("doc", pa.int64()), ("own", pa.int64()), ("at", pa.binary())])
        for batch in slices(batches, 2):
            flat, known, stops = _flat(batch.column(2), place)
            tail = np.flatnonzero(known < 0)
            doc = np.searchsorted(stops, tail, side="right")
            at = (tail - np.concatenate(([0], stops))[doc]).astype(np.int32)
            named = pa.array([flat[i] for i in tail.tolist()], pa.binary()).dictionary_encode()
            key = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(stops) + 1) + doc
            order = np.argsort(key, kind="stable")  # by word, text, and place
            key, doc, at = key[order], doc[order], at[order]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            places = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(np.append(heads, len(key)).astype(np.int32) * np.int32(4)), pa.py_buffer(at)])
            rows = pa.array(doc[heads])
            struct = pa.StructArray.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), places], fields=list(entry))
            word = key[heads] // (len(stops) + 1)
            offsets = np.searchsorted(word, np.arange(len(named.dictionary) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([named.dictionary.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=["word", "texts"])

    return run


def _filled(n_classes: int):
    """Sequences with the joined words put in, what they add to the sums, and the rarest class for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5):
            lengths = batch.column(2).to_numpy()
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            own = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).copy()
            count = np.zeros(len(own), np.int64)
            lists = batch.column(6)
            entries = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            words = lists.flatten()
            places, c, kind = (words.field(i) for i in range(3))
            n = pc.binary_length(places).to_numpy(zero_copy_only=False) // 4
            # a repeated row brings its words again, to the same places
            at = np.frombuffer(b"".join(places.to_pylist()), np.int32) + np.repeat(starts[entries], n)
            own[at] = np.repeat(kind.to_numpy(zero_copy_only=False), n)
            count[at] = np.repeat(c.to_numpy(zero_copy_only=False), n)
            own[own == LATER] = n_classes - 1
            known = batch.column(3).to_numpy() + np.add.reduceat((count > 0).astype(np.int64), starts)
            plus = batch.column(4).to_numpy() + np.add.reduceat(np.log10(count + 1.0), starts)
            seqs = [own[a:b].tobytes() for a, b in zip(starts.tolist(), (starts + lengths).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(known), pa.array(plus), pa.array(seqs, pa.binary())], names=["doc_id", "n_tokens", "n_known", "plus", "seq"]
            )

    return run


def sequences(docs: DataFrame, by: Classes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, plus (the sum of log10(count + 1)) and seq (a byte per token: its class)."""
    spark = docs.sparkSession
    text = column(docs, text_col).cast("string")
    keyed = docs.select(column(docs, id_col).cast("long").alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("own"), text.alias("text"))
    shared = spark.sparkContext.broadcast(by.lexicon)  # HEAD words at most
    main = keyed.mapInArrow(_head_sequences(shared), _MAIN)
    held = spark.createDataFrame([(bytearray(w),) for w in by.lexicon.words], "h_word binary")
    tail = by.words.join(held, F.col("word") == F.col("h_word"), "left_anti").withColumnRenamed("word", "t_word")
    tail = keyed.mapInArrow(_tail_words(shared), _TAIL).join(tail, F.col("word") == F.col("t_word")).select("c", "class", F.explode("texts").alias("t"))
    # as many entries as the text has words
    tail = tail.groupBy(F.col("t.doc").alias("t_doc"), F.col("t.own").alias("t_own")).agg(F.collect_list(F.struct(F.col("t.at").alias("at"), "c", "class")).alias("words"))
    both = main.join(tail, F.col("doc").eqNullSafe(F.col("t_doc")) & (F.col("own") == F.col("t_own")), "left").drop("t_doc", "t_own")
    return both.mapInArrow(_filled(by.n_classes), "doc_id bigint, n_tokens bigint, n_known bigint, plus double, seq binary")


def _pairs_of(n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes, n_classes), np.int64)
        for batch in slices(batches, 0):
            for seq in batch.column(0):
                own = np.frombuffer(seq.as_py(), np.uint8).astype(np.int64)
                total += np.bincount(np.concatenate(([n_classes - 2], own[:-1])) * n_classes + own, minlength=n_classes**2).reshape(n_classes, n_classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["pair", "n"])

    return run


@dataclass
class ClassModel:
    """Numbers per class and pair of classes; a word's probability needs its count and class beside them."""

    tokens: int
    distinct: int
    transitions: np.ndarray  # P(class | class before)
    sizes: np.ndarray  # per class: counts of its words plus 1 each, and 1 for words to come in the last one

    @property
    def unigram(self) -> float:
        """What the smoothed unigram gives each count + 1."""
        return 1.0 / (self.tokens + self.distinct + 1)

    def steps(self) -> np.ndarray:
        """P(word | class before) for each count + 1, by class before and class of the word."""
        return MIX * self.transitions / self.sizes[None, :] + (1 - MIX) * self.unigram


def fit(seqs: DataFrame, by: Classes) -> ClassModel:
    """The model by the class bigrams of these sequences."""
    n = by.n_classes
    pairs, sizes = np.zeros(n * n), np.zeros(n)
    for r in seqs.select("seq").mapInArrow(_pairs_of(n), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # n squared rows
        pairs[r.pair] = r.n
    for r in by.words.groupBy("class").agg(F.sum(F.col("c") + 1).alias("n")).collect():  # n rows
        sizes[r["class"]] = r.n
    sizes[n - 1] += 1
    pairs = pairs.reshape(n, n)
    share = (pairs.sum(0) + sizes / sizes.sum()) / (pairs.sum() + 1)
    share = np.where(sizes > 0, share, 0.0)
    share /= share.sum()
    transitions = (pairs + SMOOTH * share[None, :]) / (pairs.sum(1, keepdims=True) + SMOOTH)
    return ClassModel(by.tokens, by.distinct, transitions, np.maximum(sizes, 1e-12))


def _scored(model: ClassModel):
    steps = np.log10(model.steps()).ravel()
    n = len(model.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            scores = []
            for seq in batch.column(4):
                own = np.frombuffer(seq.as_py(), np.uint8).astype(np.int64)
                scores.append(float(steps[np.concatenate(([n - 2], own[:-1])) * n + own].sum()))
            score = pa.array(batch.column(3).to_numpy() + np.array(scores))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), score], names=["doc_id", "n_tokens", "n_known", "plus", "score"])

    return run


def score(seqs: DataFrame, model: ClassModel) -> DataFrame:
    """Of sequences: doc_id, n_tokens, n_known, base_score and score (log10 probabilities).

    Null and empty texts are one end. Repeated rows are scored each, and equal ones alike. With
    nothing learnt every token has probability 1 in both scores. An empty table gives an empty
    result; columns of the documents other than id and text are left out.
    """
    if not model.tokens:
        return seqs.select("doc_id", "n_tokens", "n_known", F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    out = seqs.mapInArrow(_scored(model), "doc_id bigint, n_tokens bigint, n_known bigint, plus double, score double")
    return out.select("doc_id", "n_tokens", "n_known", (F.col("plus") + F.col("n_tokens") * F.lit(float(np.log10(model.unigram)))).alias("base_score"), "score")


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by what those outside the fold of crc32(doc_id) % 7 = 2 teach. Edge cases: see ``score``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    by = cluster(docs.where(~in_fold(F.col("doc_id"), 7, 2)))
    seqs = written(sequences(docs, by), "sequences")
    out = score(seqs, fit(seqs.where(~in_fold(F.col("doc_id"), 7, 2)), by))
    return out.select(
        "doc_id",
        in_fold(F.col("doc_id"), 7, 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(by.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
