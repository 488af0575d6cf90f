"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Over every document slide windows of each benchmark item's number of words; a document
shorter than an item is one window for it. A window's
64-bit SimHash is summed from its five-word shingles, each weighted by its rarity among
all items, counted once. Fingerprints are cut into four 16-bit blocks and each block of an item is indexed
with all values at most ``RADIUS // 4`` bits away: by the pigeonhole principle no
fingerprint within ``RADIUS`` bits is missed. Candidates are verified by the exact
weighted Jaccard similarity of their shingles, ``LEAST`` or more.

A window whose shingles known from any item weigh under ``LEAST`` of its weight has less
similarity than that with every item, so only the other windows get a fingerprint. Items are taken in blocks of
``ITEMS``, each a pass over the documents. The table of all items' shingle weights goes to
every task, so it and the driver's indexes grow with the benchmark.

Defined cases: null or empty texts and items leak nothing; items of under five words
have one shingle, all their words; repeated rows are reported each; equal items are
reported each; empty tables give no rows. Only doc_id, text, item_id are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table, word_hashes
from attesta.llm.neardup import shingle_hashes

SHINGLE, LEAST, RADIUS, ITEMS = 5, 0.8, 19, 2000
BLOCKS = 4


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Cumulated signed weights per bit: row i holds the sums before shingle i."""
    bits = ((shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
    out = np.zeros((len(shingles) + 1, 64), np.int64)
    np.cumsum(bits * weights[:, None], axis=0, out=out[1:])
    return out


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)


class Index:
    """Items of one block: fingerprints, their blocks' neighbourhoods. ``stats`` are all items' shingles, their weights, and an unknown one's weight."""

    def __init__(self, items: list[tuple[int, np.ndarray]], stats: tuple[np.ndarray, np.ndarray, int]):
        self.stats = stats
        self.ids = [i for i, _ in items]
        self.words = np.array([len(h) for _, h in items])
        self.sizes = np.unique(self.words)
        shingles = [shingle_hashes(h, SHINGLE) for _, h in items]
        self.known = np.unique(np.concatenate(shingles))
        self.shingles = shingles
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.prints = np.array([fingerprint(simhash(s, self.weights(s))[-1]) for s in shingles], np.uint64)
        near = [0] + [sum(1 << b for b in c) for r in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(16), r)]
        keys = [((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ np.array(near)[None, :] for b in range(BLOCKS)]
        # Block b's value v: the items order[b][start[b][v]:start[b][v + 1]].
        self.start, self.order = [], []
        for k in keys:
            flat, item = k.ravel(), np.repeat(np.arange(len(items)), len(near))
            place = np.argsort(flat, kind="stable")
            self.order.append(item[place].astype(np.int32))
            self.start.append(np.searchsorted(flat[place], np.arange((1 << 16) + 1)))

    def weights(self, s: np.ndarray) -> np.ndarray:
        known, weight, other = self.stats
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        return np.where(known[at] == s, weight[at], other)

    def exact(self, a: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of shingle multisets."""
        (x, nx), (y, ny) = np.unique(a, return_counts=True), np.unique(self.shingles[item], return_counts=True)
        _, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = (np.minimum(nx[ix], ny[iy]) * self.weights(x[ix])).sum()
        return float(both / ((nx * self.weights(x)).sum() + (ny * self.weights(y)).sum() - both))

    def places(self, s: np.ndarray) -> np.ndarray:
        """Where shingles that some item has stand."""
        hit = np.flatnonzero(self.low[(s & np.uint64(0xFFFFF)).astype(np.int64)])
        return hit[self.known[np.minimum(np.searchsorted(self.known, s[hit]), len(self.known) - 1)] == s[hit]]

    def search(self, h: np.ndarray, s5: np.ndarray, hit5: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, Hamming distance) of its best window in a document; hit5 = places(s5)."""
        best: dict[int, tuple[float, int, int]] = {}
        sizes = self.sizes if len(hit5) else self.sizes[self.sizes < SHINGLE]
        if len(hit5) and len(h) < sizes[-1]:
            # Longer items have one window, the whole document.
            weight, known = self.weights(s5), np.zeros(len(s5), bool)
            known[hit5] = True
            if (weight * known).sum() >= LEAST * weight.sum() - 1e-6:
                self._probe(fingerprint(simhash(s5, weight)[-1:]), np.zeros(1, np.int64), s5, len(s5), self.words > len(h), best)
        for size in sizes[sizes <= len(h)]:
            size = int(size)
            s = s5 if size >= SHINGLE else shingle_hashes(h, size)
            count = max(1, size - SHINGLE + 1)
            hit = hit5 if size >= SHINGLE else self.places(s)
            if not len(hit):
                continue
            known = np.zeros(len(s), bool)
            known[hit] = True
            starts = np.unique((hit[:, None] - np.arange(count)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(h) - size)]
            for run in np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1):
                for at in range(0, len(run), 4096):
                    part = run[at:at + 4096]
                    if not len(part):
                        continue
                    local = s[part[0]: part[-1] + count]
                    weight = self.weights(local)
                    i = part - part[0]
                    # Shared weight is at most that of known shingles, so a window that has too little of it is not similar to any item.
                    total, shared = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, weight * known[part[0]: part[-1] + count]))
                    enough = shared[i + count] - shared[i] >= LEAST * (total[i + count] - total[i]) - 1e-6
                    part, i = part[enough], i[enough]
                    if not len(part):
                        continue
                    sums = simhash(local, weight)
                    prints = fingerprint(sums[i + count] - sums[i])
                    self._probe(prints, part, s, count, self.words == size, best)
        return best

    def _probe(self, prints, starts, s, count, fits, best):
        seen = set()
        for b in range(BLOCKS):
            v = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, hi = self.start[b][v], self.start[b][v + 1]
            n = hi - lo
            w = np.repeat(np.arange(len(v)), n)
            item = self.order[b][np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            far = np.bitwise_count(prints[w] ^ self.prints[item])
            ok = (far <= RADIUS) & fits[item]
            seen.update(zip(w[ok].tolist(), item[ok].tolist(), far[ok].tolist()))
        for w, item, far in sorted(seen):
            sim = self.exact(s[starts[w]: starts[w] + count], item)
            if sim >= LEAST and sim > best.get(item, (0.0,))[0]:
                best[item] = (sim, int(starts[w]), int(far))


def shingle_weights(items: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """All items' shingles in order, the weight of each, and that of a shingle no item has."""
    def task(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for h in batch.column(0).to_pylist():
                s = np.unique(shingle_hashes(np.array(h, np.int64).view(np.uint64), SHINGLE))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    often, n = items.select("h").mapInArrow(task, "s long").groupBy("s").agg(F.count("*").alias("n")).toPandas(), items.count()
    s = often["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    weight = np.round(16 * (1 + np.log(max(n, 1) / often["n"].to_numpy(float)))).astype(np.int64)
    return s[order], weight[order], 16 + int(16 * np.log(n + 1))


def leaks(docs: DataFrame, benchmark: DataFrame, row_id: bool = False) -> DataFrame:
    """doc_id, item_id, similarity, first_word, distance: the best window of each item in each document."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where("size(h) > 0").orderBy("item_id")
    cols = [*(["row_"] if row_id else []), "doc_id"]
    rows = docs.select(*cols, word_hashes(F.col("text")).alias("h"))
    out, held = None, []
    stats = shingle_weights(items)
    shared = docs.sparkSession.sparkContext.broadcast(stats)

    def searched(index):
        index.stats = None

        def task(batches):
            np.seterr(over="ignore")
            index.stats = shared.value
            for batch in batches:
                col, found = batch.column(batch.num_columns - 1), []
                flat, off = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.asarray(col.offsets) - col.offsets[0].as_py()
                every = shingle_hashes(flat, SHINGLE) if len(flat) >= SHINGLE else np.zeros(0, np.uint64)
                hits = index.places(every)
                for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
                    s5 = every[a: b - SHINGLE + 1] if b - a >= SHINGLE else every[:0]
                    hit5 = hits[slice(*np.searchsorted(hits, (a, a + len(s5))))] - a
                    for item, (sim, first, far) in index.search(flat[a:b], s5, hit5).items():
                        found.append((i, index.ids[item], sim, first, far))
                take = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(len(cols))], pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                                                  pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())], [*cols, "item_id", "similarity", "first_word", "distance"])
        return task

    schema = ("row_ long, " if row_id else "") + "doc_id long, item_id long, similarity double, first_word long, distance long"
    for item in items.toLocalIterator():
        held.append((item["item_id"], np.array(item["h"], np.int64).view(np.uint64)))
        if len(held) == ITEMS:
            out, held = _also(out, rows.mapInArrow(searched(Index(held, stats)), schema)), []
    if held:
        out = _also(out, rows.mapInArrow(searched(Index(held, stats)), schema))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _also(out, more):
    return more if out is None else out.unionByName(more)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with their own columns. Rows are told apart by the hash of id and text."""
    mark = F.xxhash64("doc_id", "text")
    found = leaks(docs.withColumn("row_", mark), benchmark, row_id=True).select("row_").distinct()
    packed = docs.select(F.struct("*").alias("all_"), mark.alias("row_"))
    return packed.join(found, "row_", "left_anti").select("all_.*")
