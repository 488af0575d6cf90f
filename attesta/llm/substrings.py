"""Exact substring dedup over 50-word windows by super-k-mer partitioning.

A window's minimiser is the least hash among its runs of ``GRAM`` words. Consecutive
windows with one minimiser travel as one packed string to the minimiser's bucket, where
the windows are cut out and sorted, so equal ones meet and are told apart exactly.

Steps: (1) places of super-k-mers, without text, by minimiser; those whose minimiser
occurs in one document only can't repeat and stop there. (2) Equal super-k-mers (by a
128-bit hash) are folded into one with its least and greatest doc_id, so a passage that
a third of all documents share is sent once. (3) The packed strings are cut from the
texts and go to their buckets; a bucket with many different strings is dealt out
again by the window itself, each window then being its own minimiser: its 128-bit hash
is counted with partial sums, so a window in very many strings meets in no task. (4) Windows that
start in a smaller doc_id go back to every document that holds their super-k-mer.

Defined cases: null text has no words; documents of under 50 words keep all; a null
doc_id neither gives nor takes windows; rows that repeat a doc_id are documents of the
same id, so they don't remove each other's words; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table, word_hashes, words
from attesta.llm.neardup import shingle_hashes
from attesta.settings import written

WINDOW, GRAM, RUN, HOT = 50, 8, 64, 500


def least_of_each(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    size, out = 1, v
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer of a document's word hashes; at most RUN windows each."""
    if len(h) < WINDOW:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    low = least_of_each(shingle_hashes(h, GRAM), WINDOW - GRAM + 1)
    start = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    stop = np.append(start[1:], len(low))
    pieces = -(-(stop - start) // RUN)
    first = np.repeat(start, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return low[first], first, np.minimum(np.repeat(stop, pieces) - first, RUN)


def places(docs: DataFrame) -> DataFrame:
    """mini, h1, h2 (hash of the words), row, doc_id, first, n of all super-k-mers."""
    rows = docs.where("doc_id is not null").select("doc_id", "row", word_hashes(F.col("text")).alias("h"))

    def task(batches):
        np.seterr(over="ignore")
        for batch in batches:
            col = batch.column(2)
            flat, off = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.asarray(col.offsets) - col.offsets[0].as_py()
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[] for _ in range(7)]
            for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
                h = flat[a:b]
                mini, first, n = super_kmers(h)
                for m, f, k in zip(mini.astype(np.int64).tolist(), first.tolist(), n.tolist()):
                    d = np.frombuffer(hashlib.blake2b(h[f: f + k + WINDOW - 1].tobytes(), digest_size=16).digest(), np.int64)
                    for o, v in zip(out, (m, int(d[0]), int(d[1]), marks[i], ids[i], f, k)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, [pa.int64()] * 5 + [pa.int32()] * 2)], ["mini", "h1", "h2", "row", "doc_id", "first", "n"])

    return rows.mapInArrow(task, "mini long, h1 long, h2 long, row long, doc_id long, first int, n int")


def cut_out(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """bucket, h1, h2, low, high, offset, packed, window: the words of the wanted places, packed; a hot bucket's as hashes of single windows."""
    per = wanted.groupBy("row").agg(F.collect_list(F.struct("mini", "h1", "h2", "low", "high", "first", "n", "hot")).alias("cuts"))
    both = per.join(docs.select("row", "text"), "row").select("cuts", words(F.col("text")).alias("w"))
    names, types = ["bucket", "h1", "h2", "low", "high", "offset", "packed", "window"], [pa.int64()] * 5 + [pa.int32(), pa.string(), pa.binary()]

    def task(batches):
        shape = lambda out: pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names)
        for batch in batches:
            out, held = [[] for _ in names], 0
            for row in range(batch.num_rows):
                w = batch.column(1)[row].as_py()
                for c in batch.column(0)[row].as_py():
                    part = w[c["first"]: c["first"] + c["n"] + WINDOW - 1]
                    if c["hot"]:
                        todo = [(i, None, hashlib.blake2b(" ".join(part[i:i + WINDOW]).encode(), digest_size=16).digest()) for i in range(c["n"])]
                    else:
                        todo = [(0, " ".join(part), None)]
                    for i, s, d in todo:
                        held += len(s or d)
                        for o, v in zip(out, (c["mini"], c["h1"], c["h2"], c["low"], c["high"], i, s, d)):
                            o.append(v)
                if held > 4_000_000:
                    yield shape(out)
                    out, held = [[] for _ in names], 0
            yield shape(out)

    return both.mapInArrow(task, "bucket long, h1 long, h2 long, low long, high long, offset int, packed string, window binary")


def count_hot(cut: DataFrame) -> DataFrame:
    """h1, h2, offset, least of the windows of hot buckets, as ``count_windows`` gives them for the others."""
    least = cut.groupBy(F.col("window").alias("of")).agg(F.min("low").alias("least"), F.max("high").alias("top")).where("least < top")
    return cut.join(least, F.col("window") == F.col("of")).where("least < high").select("h1", "h2", "offset", "least")


def count_windows(packed: DataFrame) -> DataFrame:
    """h1, h2, offset, least: windows of a super-k-mer that start in a doc_id under its greatest; buckets arrive sorted."""
    ready = packed.select("bucket", "h1", "h2", "low", "high", "offset", "packed").repartition(F.col("bucket")).sortWithinPartitions("bucket")

    def group(rows):
        cut = []
        for h1, h2, low, high, offset, text in rows:
            w = text.split(" ")
            cut += [(" ".join(w[i:i + WINDOW]), low, h1, h2, offset + i, high) for i in range(len(w) - WINDOW + 1)]
        cut.sort()
        out, last, least = [], None, None
        for text, low, h1, h2, offset, high in cut:
            if text != last:
                last, least = text, low
            if least < high:
                out.append((h1, h2, offset, least))
        return out

    def task(batches):
        held, bucket = [], None
        shape = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.int64()])], ["h1", "h2", "offset", "least"])
        ready_rows = []
        for batch in batches:
            for b, h1, h2, low, high, offset, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if held:
                        ready_rows += group(held)
                    held, bucket = [], b
                held.append((h1, h2, low, high, offset, text))
            if ready_rows:
                yield shape(ready_rows)
                ready_rows = []
        if held:
            ready_rows = group(held)
        if ready_rows:
            yield shape(ready_rows)

    return ready.mapInArrow(task, "h1 long, h2 long, offset int, least long")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text left)."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = written(places(docs), "sub-places")
    minis = found.groupBy(F.col("mini").alias("m")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    shared = written(found.join(minis, F.col("mini") == F.col("m"), "left_semi"), "sub-shared")
    one = shared.groupBy("mini", "h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct("doc_id", "row", "first", "n")).alias("p"))
    one = written(one, "sub-kinds")
    many = one.groupBy(F.col("mini").alias("m")).agg(F.count("*").alias("kinds"))
    wanted = one.join(many, F.col("mini") == F.col("m")).select("mini", "h1", "h2", "low", "high", "p.row", "p.first", "p.n", (F.col("kinds") > HOT).alias("hot"))
    # Equal rows have one mark: their text is needed once.
    cut = written(cut_out(wanted, docs.select("row", "text").dropDuplicates(["row"])), "sub-cuts")
    again = written(count_windows(cut.where("packed is not null")).unionByName(count_hot(cut.where("packed is null"))), "sub-windows")
    gone = again.groupBy("h1", "h2").agg(F.collect_list(F.struct("offset", "least")).alias("runs")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "runs")
    hit = shared.join(gone, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    starts = F.transform(F.filter("runs", lambda x: x["least"] < F.col("doc_id")), lambda x: F.col("first") + x["offset"])
    per = hit.select("row", starts.alias("starts")).where("size(starts) > 0").groupBy(F.col("row").alias("r")).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    out = docs.join(per, F.col("row") == F.col("r"), "left").select("doc_id", words(F.col("text")).alias("w"), "starts")
    # Only the words of documents that lose some cross over one by one.
    whole = F.col("starts").isNull()
    out = out.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(whole, F.array_join("w", " ")).alias("plain"), F.when(~whole, F.col("w")).alias("w"), "starts")

    def task(batches):
        for batch in batches:
            lost, kept = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row in np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False)).tolist():
                w, starts = batch.column(3)[row].as_py(), np.array(batch.column(4)[row].as_py(), np.int64)
                gone = np.zeros(len(w) + 1, np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, np.minimum(starts + WINDOW, len(w)), -1)
                keep = np.cumsum(gone)[:-1] == 0
                lost[row], kept[row] = (~keep).sum(), " ".join(x for x, k in zip(w, keep.tolist()) if k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lost), pc.coalesce(pa.array(kept, pa.string()), batch.column(2).cast(pa.string()))],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    return out.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
