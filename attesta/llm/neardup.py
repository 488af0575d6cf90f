"""Near duplicates by Order MinHash, verified by banded alignment.

The one measure is word-level edit similarity, 1 - distance / longer length: a pair is a
link at ``LEAST`` or more. The distance comes from alignment within a band that a pair of
that similarity cannot leave. Classes are connected components of links.

Equal texts form one class first. Of every distinct text, ``DRAWS`` times, the
``LENGTH`` smallest occurrence-labelled words are sampled and kept in text order; their
hash is a bucket key. Six words in one order are rare in texts that only share words or a
passage. Texts under ``SHORT`` words have ``SKETCHES`` keys each of ``FEW`` two-word shingles and of ``FEW``
words (those within a link's length of ``SHORT`` have both kinds), and those under ``TINY`` a
key for all that is left of them after as many deletions as a link allows, so no link
between two of these is missed.

Buckets of the same texts stand once, with their number. Each bucket names one of its texts. Each text is compared with the one that most of its
buckets name, then, in rounds while that joins texts, with all that they name and that are
not in its component. Then every pair of a bucket that is not in one component yet is
compared, unless a bound rules it out, so no link of a bucket is lost and near copies cost
about one comparison a text, however many buckets they share. The bounds are exact: lengths,
then words of one text that the other lacks, first in a bitmap of ``BITS`` places and then
word by word. A round's links join the components of the rounds before it.

Defined cases: a null text is a class of its own; texts without words are equal only if
the same; texts of one word have one shingle, the word; equal rows are copies;
an empty table gives no rows. Ids may repeat or be null: links join texts, not ids.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table, word_hashes
from attesta.settings import written

SHINGLE, FEW, LENGTH, LEAST = 2, 3, 6, 0.8
SKETCHES, DRAWS = 64, 72  # samples of FEW, of LENGTH
SHORT, TINY = 48, 15  # under so many words: sketches of FEW; all that one or two deletions leave
BITS = 4096
MIX = np.random.default_rng(11).integers(1, 2 ** 63, (2 * SKETCHES + DRAWS, 2, 1), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; of all words where there are fewer."""
    if not len(h):
        return h[:0]
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i:len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles mixed with their occurrence number."""
    order = np.argsort(s, kind="stable")
    v = s[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    if new.all():
        return s
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty_like(s)
    out[order] = v + (np.arange(len(v)) - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def folded(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash of each row, in order, from a start value."""
    for i in range(x.shape[1]):
        key = (key ^ x[:, i]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key = key ^ (key >> np.uint64(31))
    return key


def drawn(s: np.ndarray, first: int, count: int, length: int) -> np.ndarray:
    """``count`` hashes of the ``length`` smallest by a mix of their own, in text order; none of so few that all would be drawn."""
    if len(s) <= length:
        return s[:0]
    # A place in the low bits of its mixed value comes along when values are partitioned.
    place, low = np.arange(len(s), dtype=np.uint64), np.uint64(len(s).bit_length())
    keys, step = [], max(1, (1 << 14) // len(s))
    for at in range(first, first + count, step):
        mix = MIX[at:min(at + step, first + count)]
        v = s ^ mix[:, 1]
        v *= mix[:, 0]
        v ^= v >> np.uint64(32)
        v *= mix[:, 0]
        v >>= low
        v <<= low
        v |= place
        v.partition(length - 1, axis=1)
        least = np.sort(v[:, :length] & ((np.uint64(1) << low) - np.uint64(1)), axis=1).astype(np.int64)
        keys.append(folded(s[least], np.arange(at + 1, at + 1 + len(mix), dtype=np.uint64)))
    return np.concatenate(keys)


@cache
def stays(n: int, gone: int) -> np.ndarray:
    return np.array([[i for i in range(n) if i not in c] for c in combinations(range(n), gone)])


def sketch(h: np.ndarray) -> np.ndarray:
    """The bucket keys of a text."""
    n = len(h)
    if not n:
        return h.view(np.int64)
    single, keys = labelled(h), []
    if n >= LEAST * SHORT:
        keys.append(drawn(single, 2 * SKETCHES, DRAWS, LENGTH))
    if n < SHORT:
        keys += [drawn(labelled(shingle_hashes(h, SHINGLE)), 0, SKETCHES, FEW), drawn(single, SKETCHES, SKETCHES, FEW)]
    if n < TINY:
        # Texts d edits apart have a text in common that d deletions at most leave of each.
        most = int((1 - LEAST) * min(n / LEAST, TINY - 1) + 1e-9)
        keys += [folded(h[stays(n, gone)], np.uint64(2 * SKETCHES + DRAWS + 1)) for gone in range(most + 1)]
    return np.unique(np.concatenate(keys)).view(np.int64)


def bitmap(h: np.ndarray) -> np.ndarray:
    """BITS places, those of the labelled words set: a place set in one text only stands for a word the other lacks."""
    out = np.zeros(BITS, np.uint8)
    if len(h):
        out[(labelled(h) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(out).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, its words, bucket keys."""
    rows = docs.where("text is not null").select("doc_id", F.unhex(F.md5("text")).alias("key"), word_hashes(F.col("text")).alias("h"))

    def task(batches):
        np.seterr(over="ignore")
        for batch in batches:
            col = batch.column(2)
            flat, off = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.asarray(col.offsets) - col.offsets[0].as_py()
            keys = [sketch(flat[a:b]) for a, b in zip(off[:-1], off[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off), pa.int32()), lists], ["doc_id", "key", "n", "buckets"])

    return rows.mapInArrow(task, "doc_id long, key binary, n int, buckets array<long>")


MARKS = [f"w{i}" for i in range(BITS // 64)]


def bitmaps(texts: DataFrame) -> DataFrame:
    """of (the key of a text), its bitmap and the places set in it."""
    def task(batches):
        np.seterr(over="ignore")
        for batch in batches:
            bits = np.array([bitmap(np.frombuffer(h, np.uint64)) for h in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MARKS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bitwise_count(bits.view(np.uint64)).sum(axis=1), pa.int32()), *(pa.array(w) for w in bits.T)], ["of", "set", *MARKS])

    rows = texts.select("key", "h").mapInArrow(task, f"of binary, set int, {', '.join(f'{w} long' for w in MARKS)}")
    return rows.select("of", F.struct("set", *MARKS).alias("bits"))


def lacking(left: str, right: str) -> Column:
    """Places set in one of two bitmaps and not in the other, the larger of both ways."""
    both = [F.bit_count(F.col(f"{left}.{w}").bitwiseAND(F.col(f"{right}.{w}"))) for w in MARKS]
    return F.greatest(f"{left}.set", f"{right}.set") - reduce(lambda x, y: x + y, both)


def banded(long: list[int], short: list[int], band: int) -> int:
    """Edit distance by way of diagonals -band..band: exact where it is <= band, else not below it.

    The cells of one column within the band are bits of an integer, by the differences to
    their neighbours; the band moves down one row a column. ``band`` is at least the
    difference of the lengths.
    """
    width = 2 * band + 1
    mask, middle = (1 << width) - 1, 1 << band
    found: dict[int, int] = {w: 0 for w in short}
    for i, w in enumerate(long):
        if w in found:
            found[w] |= 1 << i
    # In the first column each row from 1 on is one more than the row before it.
    up, down, distance = mask ^ (middle - 1), 0, 0
    for j, w in enumerate(short):
        same = found[w]
        if same:
            same = (same >> (j - band) if j >= band else same << (band - j)) & mask
        diagonal = ((((same & up) + up) ^ up) | same | down) & mask
        right = down | (mask ^ (diagonal | up))
        left = diagonal & up
        if not diagonal & middle:
            distance += 1
        diagonal >>= 1
        up = left | (mask ^ (diagonal | right))
        down = diagonal & right
    last = ((1 << (len(long) - len(short))) - 1) << band
    return distance + (up & last).bit_count() - (down & last).bit_count()


def bag_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Words one text has more of than the other, the larger of both ways: never above the edit distance."""
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    v = both[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    more = np.add.reduceat(np.where(order < len(x), 1, -1), first)
    return max(int(more[more > 0].sum()), -int(more[more < 0].sum()))


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = LEAST) -> np.ndarray:
    """Which pairs of word-hash arrays have an edit similarity of ``least`` or more."""
    verdict = np.zeros(len(pairs), bool)
    for i, (x, y) in enumerate(pairs):
        if len(x) < len(y):
            x, y = y, x
        most = int((1 - least) * len(x) + 1e-9)
        if len(x) - len(y) > most:
            continue
        n = len(y)
        diff = np.flatnonzero(x[:n] != y)
        head = int(diff[0]) if len(diff) else n
        x, y = x[head:], y[head:]
        n = len(y)
        diff = np.flatnonzero(x[len(x) - n:][::-1] != y[::-1])
        tail = int(diff[0]) if len(diff) else n
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if len(x) <= most:
            verdict[i] = True
        elif bag_distance(x, y) <= most:
            x, y = x.tolist(), y.tolist()
            # A narrow band finds most links; the one of width ``most`` decides.
            verdict[i] = any(banded(x, y, band) <= most for band in sorted({max(len(x) - len(y), min(256, most)), most}))
    return verdict


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys that are links."""
    left = texts.select(F.col("key").alias("a"), F.col("h").alias("ha"))
    right = texts.select(F.col("key").alias("b"), F.col("h").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb")

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ok = similar([(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())])
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(task, "a binary, b binary")


def once(left: DataFrame) -> DataFrame:
    """key, n, bucket, times: of buckets (key, n, bucket) that hold the same texts, one, and how many they are.

    Near copies share most of their buckets, often with no other text. Two texts are told by their keys,
    larger sets by these ends, their number and 128 bits of hashes.
    """
    told = [F.count("*").alias("c"), F.min("key").alias("low"), F.max("key").alias("high"),
            F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]
    kept = left.groupBy("bucket").agg(*told).groupBy("c", "low", "high", "x", "y").agg(F.min("bucket").alias("kept"), F.count("*").alias("times"))
    return written(left.join(kept.select("kept", "times"), F.col("bucket") == F.col("kept")).select("key", "n", "bucket", "times"), "near-once")


def joined(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """key, label of its component, for keys of texts with links to different texts."""
    rows = sketched.groupBy("key").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets")).select("key", "n", F.explode("buckets").alias("bucket"))
    often = rows.groupBy(F.col("bucket").alias("shared")).agg(F.count("*").alias("n")).where("n > 1")
    left = once(written(rows.join(often, F.col("bucket") == F.col("shared"), "left_semi"), "near-buckets"))
    # Written, so that Spark knows how few they are: few are sent to the texts, and no text but theirs moves.
    wanted = written(left.select(F.col("key").alias("wanted")).distinct(), "near-wanted")
    hashed = docs.where("text is not null").select(F.unhex(F.md5("text")).alias("key"), "text").join(wanted, F.col("key") == F.col("wanted"), "left_semi")

    def pack(batches):
        for batch in batches:
            col = batch.column(1)
            flat, off = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False)), np.asarray(col.offsets) - col.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], ["key", "h"])

    texts = written(hashed.dropDuplicates(["key"]).select("key", word_hashes(F.col("text")).alias("h")).mapInArrow(pack, "key binary, h binary"), "near-texts")
    longest = F.greatest("n", "n2")
    most = F.floor((1 - LEAST) * longest + 1e-9)
    fits = longest - F.least("n", "n2") <= most
    tried = docs.sparkSession.createDataFrame([], "a binary, b binary")
    label = docs.sparkSession.createDataFrame([], "key binary, label binary")
    rounds, more = 0, True
    while True:
        rows = left.join(label.select(F.col("key").alias("of"), "label"), F.col("key") == F.col("of"), "left").drop("of")
        rows = rows.withColumn("label", F.coalesce("label", "key"))
        kinds = rows.groupBy(F.col("bucket").alias("in")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        left = written(rows.join(kinds, F.col("bucket") == F.col("in"), "left_semi"), "near-left")
        if more:
            first = F.min_by(F.struct("key", "n", "label"), F.struct(F.xxhash64("key", F.lit(rounds)), "key"))
            other = left.groupBy(F.col("bucket").alias("in")).agg(first.alias("one")).select("in", F.col("one.key").alias("key2"), F.col("one.n").alias("n2"), F.col("one.label").alias("label2"))
            named = left.join(other, (F.col("bucket") == F.col("in")) & (F.col("label") != F.col("label2")) & fits)
            if not rounds:
                shared = named.groupBy("key", "key2").agg(F.sum("times").alias("shared"))
                named = shared.groupBy("key").agg(F.max_by("key2", F.struct("shared", "key2")).alias("key2"))
            met = named
        else:
            # Those outside the bucket's largest component with all that aren't in theirs.
            size = left.groupBy(F.col("bucket").alias("in"), "label").agg(F.count("*").alias("c"))
            main = size.groupBy("in").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
            marked = left.join(bitmaps(texts), F.col("key") == F.col("of")).drop("of")
            apart = marked.join(main, (F.col("bucket") == F.col("in")) & (F.col("label") != F.col("main"))).select(
                "in", "main", F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("label").alias("label2"), F.col("bits").alias("bits2"))
            near = lacking("bits", "bits2") <= most
            met = marked.join(apart, (F.col("bucket") == F.col("in")) & (F.col("label") != F.col("label2")) & ((F.col("label") == F.col("main")) | (F.col("key") < F.col("key2"))) & fits & near)
        met = met.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()
        met = written(met.join(tried, ["a", "b"], "left_anti"), "near-met")
        ok = written(verified(met, texts), "near-links")
        label, tried, rounds = hooked(label, ok), tried.unionByName(met), rounds + 1
        left = left.drop("label")
        if not more:
            return label
        # A round that joins few is followed by the last one, of all that is left.
        more = 10 * ok.count() > met.count()


def components(edges: DataFrame) -> DataFrame:
    """key, least key of its component, for keys with edges: smallest-neighbour hooking and pointer jumps until nothing changes."""
    edges = written(edges.distinct(), "near-edges")
    both = edges.union(edges.select("b", "a"))
    label = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        seen = both.join(label, F.col("b") == F.col("key")).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("least"))
        better = label.join(seen, F.col("key") == F.col("to")).select("key", F.least("label", "least").alias("new"), "label")
        hop = label.select(F.col("key").alias("via"), F.col("label").alias("root"))
        better = written(better.join(hop, F.col("new") == F.col("via"), "left").select("key", F.least("new", F.coalesce("root", "new")).alias("new"), "label"), "near-labels")
        changed = better.where("new <> label").limit(1).count()
        label = better.select("key", F.col("new").alias("label"))
        if not changed:
            return label


def hooked(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``label`` (key, label) with new links (a, b): only the labels that these join are worked on."""
    for end in "ab":
        links = links.join(label.select(F.col("key").alias("of"), F.col("label").alias(f"root_{end}")), F.col(end) == F.col("of"), "left").drop("of")
    edges = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    new = components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    moved = label.join(new.select(F.col("key").alias("was"), F.col("label").alias("now")), F.col("label") == F.col("was"), "left")
    fresh = new.join(label.select(F.col("key").alias("of")), F.col("key") == F.col("of"), "left_anti")
    return written(moved.select("key", F.coalesce("now", "label").alias("label")).unionByName(fresh), "near-joined")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, label) of rows with a text, label being that of the class; (label, class_id, n_docs)."""
    docs = docs.select("doc_id", "text")
    sketched = written(sketches(docs), "near-sketches")
    label = joined(docs, sketched).select(F.col("key").alias("of"), "label")
    rows = sketched.select("doc_id", "key").join(label, F.col("key") == F.col("of"), "left").select("doc_id", "key", F.coalesce("label", "key").alias("label"))
    rows = written(rows, "near-rows")
    return rows, rows.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.count("*").alias("n_docs"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (its smallest doc_id), copy_of (smallest doc_id with the same text), n_docs of the class."""
    docs = table(spark, sf_dir, "documents")
    rows, groups = classes(docs)
    same = rows.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("copy_of"))
    out = rows.join(groups.select(F.col("label").alias("l"), F.col("best.doc_id").alias("class_id"), "n_docs"), F.col("label") == F.col("l"))
    out = out.join(same, F.col("key") == F.col("k")).select("doc_id", "class_id", "copy_of", "n_docs")
    alone = docs.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("n_docs"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one of smallest doc_id, with its own columns."""
    best = classes(docs)[1].select(F.col("best.doc_id").alias("d"), F.col("best.key").alias("k"))
    packed = docs.select(F.struct("*").alias("row_"), F.unhex(F.md5("text")).alias("key"))
    one = packed.where("key is not null").join(best, (F.col("key") == F.col("k")) & F.col("row_.doc_id").eqNullSafe(F.col("d")), "left_semi")
    one = one.withColumn("id_", F.col("row_.doc_id")).dropDuplicates(["key", "id_"])
    return one.select("row_.*").unionByName(packed.where("key is null").select("row_.*"))
