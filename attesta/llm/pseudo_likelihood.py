"""Language-model scores: masked pseudo-likelihood of a bidirectional window network.

Words are counted over all documents. The ``OWN`` most frequent ones are classes of
their own, the others fall into classes by their ending. A network of one hidden layer
reads the classes left and right of a masked word and predicts its class; it is trained
in numpy on the counts of (left, word, right) classes of the whole corpus, which bound
its training data by the number of classes, not of documents. Given its class, every word
has its own share of the class's occurrences: the ``WORDS`` most frequent ones are looked up
in a dictionary, the others of a document are joined with the table of counts. The number of
classes and the reach of a context (one word on each side) do not grow with the corpus. A document's score is the sum over its words of
log p(class | left, right) + log p(word | class), and per word.

Defined cases: null or empty texts have 0 words, log_prob 0 and a null per-word score;
repeated rows are scored each; an empty table gives no rows. Only doc_id, text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table, words
from attesta.settings import written

OWN, ENDINGS, WORDS, HIDDEN, STEPS = 40, 23, 20_000, 24, 300
HELD = 1 << 18  # words looked up at once, or one text's
EDGE = OWN + ENDINGS  # what stands beyond the first and last word
CLASSES = EDGE + 1
UNIT = 1 << 32


def lowered(text: Column) -> Column:
    return words(F.lower(text))


def ending(word: str) -> int:
    code = 7
    for c in word[-2:]:
        code = (code * 131 + ord(c)) % 1_000_003
    return OWN + code % ENDINGS


class Piece:
    """Some texts: where each one's words begin, the distinct words, and each word's place among them; no word becomes a Python string."""

    def __init__(self, rows: pa.RecordBatch, texts: pa.ListArray, sizes: np.ndarray):
        coded = texts.flatten().dictionary_encode()
        self.rows, self.sizes, self.words, self.at = rows, sizes, coded.dictionary, coded.indices.to_numpy()
        self.text = np.repeat(np.arange(len(sizes)), sizes)

    def contexts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class left of every word, its own and the one right of it; an edge stands before, between and behind the texts."""
        row = np.full(len(self.at) + len(self.sizes) + 1, EDGE)
        place = np.arange(1, len(self.at) + 1) + self.text
        row[place] = classes[self.at]
        return row[place - 1], row[place], row[place + 1]

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        """Per text the sum over its words."""
        out, some = np.zeros(len(self.sizes)), self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(of_words, (np.cumsum(self.sizes) - self.sizes)[some], dtype=np.float64)
        return out

    def counted(self, chosen: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
        """Per text its distinct words among the chosen ones, and how often each stands in it."""
        mine = chosen[self.at]
        pairs, times = np.unique(self.text[mine] * max(len(self.words), 1) + self.at[mine], return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(len(self.sizes) + 1) * max(len(self.words), 1)), pa.int32())
        words = self.words.take(pa.array(pairs % max(len(self.words), 1))).cast(pa.string())
        return pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[Piece]:
    """Texts of some ``HELD`` words in all at a time, a longer text alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + HELD, "right")))
            part = batch.slice(start, stop - start)
            yield Piece(part, part.column(column), sizes[start:stop])
            start = stop


class Vocabulary(dict):
    """Class and log p(word | class) of frequent words; of the others the class and what log of their count is to be added to."""

    def __init__(self, frequent: list[tuple[str, int]], others: dict[int, int]):
        total = np.zeros(CLASSES)
        self.of = {w: (i if i < OWN else ending(w)) for i, (w, _) in enumerate(frequent)}
        for w, n in frequent:
            total[self.of[w]] += n
        for c, n in others.items():
            total[c] += n
        total += 1
        self.log = {w: float(np.log(n / total[self.of[w]])) for w, n in frequent}
        self.rest = -np.log(total)
        self.frequent = pa.array([w for w, _ in frequent], pa.string())
        self.frequent_classes = np.array([self.of[w] for w, _ in frequent], np.int64)
        self.frequent_logs = np.array([self.log[w] for w, _ in frequent], np.float64)

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``self[word]`` gives, of many words at once: only their distinct endings become Python strings."""
        at = pc.fill_null(pc.index_in(words, value_set=self.frequent.cast(words.type)), -1).to_numpy()
        ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        classes = np.array([ending(e) for e in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
        known = at >= 0
        classes[known] = self.frequent_classes[at[known]]
        logs = self.rest[classes]
        logs[known] = self.frequent_logs[at[known]]
        return classes, logs, ~known

    def __missing__(self, word: str) -> tuple[int, float, bool]:
        """Its class, its log probability, and whether the log of its count is still to be added; words seen lately are kept."""
        if len(self) > 200_000:
            self.clear()
        c = self.of.get(word, -1)
        c = ending(word) if c < 0 else c
        got = self[word] = (c, self.log[word], False) if word in self.log else (c, float(self.rest[c]), True)
        return got

    def __reduce__(self):
        return _restored, (self.__dict__,)


def _restored(state: dict) -> Vocabulary:
    v = Vocabulary.__new__(Vocabulary)
    v.__dict__.update(state)
    return v


def word_counts(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.explode(lowered(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "lm-words")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """At most WORDS rows and one per class come to the driver."""
    counts = word_counts(docs) if counts is None else counts
    frequent = [(r["word"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(WORDS).collect()]

    def task(batches):
        top = {w for w, _ in frequent}
        n = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w not in top:
                    n[ending(w)] += k
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(n)], ["c", "n"])

    rest = counts.mapInArrow(task, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return Vocabulary(frequent, {r["c"]: r["n"] for r in rest})


def context_counts(docs: DataFrame, v: Vocabulary) -> np.ndarray:
    """Counts of (left, word, right) classes over all documents."""
    def task(batches):
        total = np.zeros(CLASSES ** 3, np.int64)
        for piece in pieces(batches, 0):
            left, own, right = piece.contexts(v.looked_up(piece.words)[0])
            total += np.bincount((left * CLASSES + own) * CLASSES + right, minlength=CLASSES ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = docs.select(lowered(F.col("text")).alias("w")).mapInArrow(task, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES ** 3)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return out.reshape(CLASSES, CLASSES, CLASSES)


def train(counts: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3) -> np.ndarray:
    """log p(word class | left class, right class), as the trained network gives it for every pair (Adam, all contexts a step)."""
    rng = np.random.default_rng(seed)
    data = counts.transpose(0, 2, 1).reshape(-1, CLASSES) + 1e-3  # contexts x targets
    data /= data.sum()
    mass = data.sum(1, keepdims=True)
    p = [rng.normal(0, 0.3, (CLASSES, hidden)), rng.normal(0, 0.3, (CLASSES, hidden)), np.zeros(hidden), rng.normal(0, 0.3, (hidden, CLASSES)), np.log(data.sum(0))]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def forward():
        h = np.tanh(p[0][:, None, :] + p[1][None, :, :] + p[2]).reshape(-1, hidden)
        z = h @ p[3] + p[4]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    for t in range(1, steps + 1):
        h, log = forward()
        dz = np.exp(log) * mass - data
        dh = ((dz @ p[3].T) * (1 - h * h)).reshape(CLASSES, CLASSES, hidden)
        for i, g in enumerate([dh.sum(1), dh.sum(0), dh.sum((0, 1)), h.T @ dz, dz.sum(0)]):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            p[i] -= 0.05 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.99 ** t)) + 1e-9)
    return forward()[1].reshape(CLASSES, CLASSES, CLASSES)  # [left, right, word]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_prob, per_word."""
    counts = word_counts(docs)
    v = vocabulary(docs, counts)
    log = train(context_counts(docs, v)).astype(np.float32)

    def task(batches):
        for piece in pieces(batches, 1):
            classes, logs, rare = v.looked_up(piece.words)
            left, own, right = piece.contexts(classes)
            part = piece.sums(log[left, right, own]) + piece.sums(logs[piece.at])
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), pa.array(piece.sizes), pa.array(part), *piece.counted(rare)],
                                             ["doc_id", "n_words", "part", "others", "times"])

    rows = docs.select("doc_id", lowered(F.col("text")).alias("w")).mapInArrow(task, "doc_id long, n_words long, part double, others array<string>, times array<long>")
    rows = written(rows.withColumn("row_", F.monotonically_increasing_id()), "lm-rows")
    other = rows.select("row_", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row_", F.col("x.others").alias("word"), F.col("x.times").alias("k"))
    # In whole numbers, so that reruns agree.
    added = other.join(counts, "word").groupBy(F.col("row_").alias("of")).agg(F.sum(F.col("k") * F.round(F.log("n") * UNIT).cast("long")).alias("more"))
    out = rows.join(added, F.col("row_") == F.col("of"), "left").withColumn("log_prob", F.col("part") + F.coalesce("more", F.lit(0)) / UNIT)
    return out.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("per_word"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
