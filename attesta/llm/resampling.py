"""Importance resampling towards a target, on hashed n-gram features.

A table of 256 bytes lower-cases A-Z and blanks every separator of the UTF-8 text, and
``bytes.split`` yields its words. The crc32 of a word is the seed for the crc32 of a space
and the next word, so runs of 1 to ``longest`` words are hashed without being built. A
task reduces its features with a Counter to at most one number a bucket, and Spark adds
these up; so both models are tables of ``buckets`` rows, whatever the corpus (10,000: the
gains are 80 kB, and all that goes to the driver and the tasks).

A bucket's gain compares its smoothed share in the target with that in the corpus. A
document's score is the sum of its gains plus Gumbel noise that depends on its id, and the
documents of greatest score are the sample. Ranks come from a range-partitioned sort: a
row's place in its partition plus the rows of the partitions before it, so no task and no
driver sees the whole order, and equal scores are parted by doc_id.

Defined cases: a null text has no words; a document without words has weight 0; equal
scores go by smaller doc_id, a null doc_id before others and with the seed of an empty id;
repeated rows are ranked one after the other; an empty target or corpus counts 0 in every
bucket; an empty table has no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import table
from attesta.settings import written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
BLOCK, DISTINCT = 1 << 20, 1 << 18

KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
PLAIN = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in KEPT else 0x20) for b in range(256))


def word_blocks(text: bytes, most: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, block by block; no block ends inside a word."""
    plain, at = text.translate(PLAIN), 0
    while len(plain) - at > most:
        stop = plain.rfind(b" ", at, at + most)
        if stop <= at:
            stop = plain.find(b" ", at + most)
        if stop < 0:
            break
        yield plain[at:stop].split()
        at = stop
    yield (plain[at:] if at else plain).split()


def feature_hashes(text: bytes, longest: int = LONGEST, most: int = BLOCK) -> Iterator[Iterator[int]]:
    """The crc32 of every run of 1 to ``longest`` words, a few iterators at a time."""
    before: list[bytes] = []
    for new in word_blocks(text, most):
        if longest == 1:
            yield map(crc32, new)
            continue
        words = before + new
        spaced = [b" " + w for w in words]
        seeds = list(map(crc32, words))
        yield iter(seeds[len(before):])
        for n in range(2, longest + 1):
            seeds = list(map(crc32, spaced[n - 1:], seeds))
            # Runs that lie in the words carried over were given out with the block before.
            yield iter(seeds[max(len(before) - n + 1, 0):])
        before = words[-(longest - 1):]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: the features of all rows by bucket, at most one row a bucket."""
    def task(batches):
        total = np.zeros(buckets, np.int64)

        def fold(found: Counter):
            at = np.fromiter(found.keys(), np.int64, len(found)) % buckets
            np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
            found.clear()

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for hashes in feature_hashes(text.as_py(), longest):
                    found.update(hashes)
                    if len(found) > DISTINCT:
                        fold(found)
        fold(found)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    rows = texts.where("text is not null").select(F.col("text").cast("binary"))
    return rows.mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The gain of every bucket, from two tables of at most ``buckets`` rows each."""
    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for row in bucket_counts(texts, buckets, longest).collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = counts(corpus), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = len(gain)

    def weighed(text: bytes) -> tuple[int, int, int]:
        n_words = n_features = weight = 0
        for i, hashes in enumerate(feature_hashes(text, longest)):
            at = np.fromiter(hashes, np.int64) % buckets
            n_words += len(at) if i % longest == 0 else 0
            n_features, weight = n_features + len(at), weight + int(gain[at].sum())
        return n_words, n_features, weight

    def task(batches):
        for batch in batches:
            rows = np.array([weighed(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary"))
    return rows.mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")


def with_rank(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Every row's place in the given order, from 1, without sorting in one task."""
    row = F.monotonically_increasing_id()
    # An id is the partition in its high bits and the place in the partition in its low 33.
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", row), "ranked")
    part = F.shiftright("_row", 33)
    # One row a partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (placed.withColumn("_part", part).join(starts, "_part")
            .withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_row", "_part", "_start"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn."""
    weighed = weigh(docs, gains(docs, target, buckets, longest), longest)
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = written(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u)))), "scored")
    may = F.col("n_words") >= least_words
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = with_rank(scored.where(may).select(*names), [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight"])
    drawn = percent * scored.where(may).count() // 100
    taken = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    return ranked.select(*names, taken).unionByName(scored.where(~may).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
