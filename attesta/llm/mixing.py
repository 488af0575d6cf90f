"""Mixing sources to target weights by Pareto order sampling [native].

Sources sorted by code point (null last) get the weights 5, 2, 1, 5, ... and share all
words by weight; a target stops at ``max_copies`` times its source's words and the
excess is shared again. Every document then has an expected number of copies e,
somewhat higher for short documents, whose word-weighted mean is target / source words:
floor(e) copies are certain, and the rest p = e - floor(e) is its inclusion probability
in a Pareto order sample: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being
a fixed hash of the document, and the first ones are taken until the words still due
are reached. The sample's fixed size is measured in words.

No window spans the documents of a source: the cut rank is found by adding up words
over 1,024 slices of the ranks, then over 1,024 slices of the slice that holds the cut,
then over the ranks in that one, so a source with most rows costs no more than a scan.

Defined cases: null text has size 0; documents of size 0 are taken 0 words; a null
source is a source of its own; equal rows have equal ranks and are taken or left
together; an empty table gives no rows. Only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import SPACE_RUN, SPACES, table
from attesta.settings import written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
TILT = 0.5  # 0: every document of a source has the same expectation; 1: as unequal as the bounds allow
SHORT = 1000  # words at which the preference for short documents is half of the greatest
BITS, LEVELS = 40, (30, 20, 0)
SEED = "mix-1"


def sizes(docs: DataFrame, carry=()) -> DataFrame:
    """doc_id, source, size, and the 52 bits that make u."""
    trimmed = F.btrim("text", F.lit(SPACES))
    size = F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE_RUN, -1))).otherwise(0).cast("long")
    mark = F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select(*carry, "doc_id", "source", size.alias("size"),
                       F.conv(F.substring(F.md5(mark), 1, 13), 16, 10).cast("long").alias("bits"))


def _short(size):
    """Thousandths of preference, in whole numbers so that sums don't depend on their order."""
    return F.floor(F.lit(1000 * SHORT) / (SHORT + size))


def targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, share: float = 1.0) -> DataFrame:
    """Per source: its words, target and mean preference. One row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(_short(F.col("size")) * F.col("size")).alias("lean"))
    every = Window.partitionBy()
    ranked = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", max_copies * F.col("source_size"))
    fill = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    # Filled in the order of top / w: what each weight unit gets if the sources before are full.
    unit = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = ranked.withColumn("unit", unit).withColumn("place", F.row_number().over(fill)).withColumn(
        "full", F.col("top") <= F.col("w") * F.col("unit"))
    rest = F.min_by("unit", F.when(~F.col("full"), F.col("place"))).over(every)
    return level.select("source", "source_size", F.when(F.col("full"), F.col("top").cast("double")).otherwise(
        F.col("w") * rest).alias("target"), (F.col("lean") / (1000.0 * F.col("source_size"))).alias("mean"))


def expectations(sized: DataFrame, goal: DataFrame, max_copies: int = MAX_COPIES, tilt: float = TILT, carry=()) -> DataFrame:
    """Certain copies of every document and its rank among the random odds (null: not in the draw)."""
    m, r = F.col("mean"), F.col("target") / F.col("source_size")
    slope = tilt * F.least(r / m, (max_copies - r) / (1 - m))
    goal = goal.select(F.col("source").alias("of"), "source_size", "target", r.alias("r"), m.alias("m"), slope.alias("slope"))
    d = sized.join(goal, sized["source"].eqNullSafe(F.col("of")))
    d = d.withColumn("e", F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), F.col("r") + F.coalesce("slope", F.lit(0.0)) * (
        _short(F.col("size")) / 1000.0 - F.col("m"))))).otherwise(0.0))
    d = d.withColumn("sure", F.floor("e")).withColumn("p", F.col("e") - F.floor("e"))
    u = (F.col("bits") + 0.5) / float(2 ** 52)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rank = F.floor(odds / (1 + odds) * float(2 ** BITS))
    return d.select(*carry, "doc_id", "source", "size", "source_size", "target", "sure", F.when((F.col("p") > 0) & (F.col("size") > 0), rank).alias("rank"))


def cuts(drawn: DataFrame) -> DataFrame:
    """Per source the largest rank taken (null: none)."""
    due = drawn.groupBy("source").agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("due"))
    cut, above = due.select(F.col("source").alias("of"), "due", F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("had")), BITS
    drawn = drawn.where("rank is not null").select("source", "size", "rank")
    for shift in LEVELS:
        inside = drawn.join(cut, drawn["source"].eqNullSafe(F.col("of")) & (F.shiftright("rank", above) == F.col("slice")))
        sums = inside.groupBy("of", F.shiftright("rank", shift).alias("part")).agg(F.sum("size").alias("n"), F.max("due").alias("due"), F.max("had").alias("had"))
        upto = F.sum("n").over(Window.partitionBy("of").orderBy("part"))
        sums = sums.withColumn("start", F.col("had") + upto - F.col("n"))
        if shift:
            # The last slice that starts at or before the words due holds the cut.
            cut = sums.where("start <= due").groupBy("of").agg(F.max("due").alias("due"), F.max("part").alias("slice"), F.max("start").alias("had"))
        else:
            # Nothing of the last slice may fit; then all before it is taken.
            fits = sums.where("start + n / 2 <= due").groupBy(F.col("of").alias("src")).agg(F.max("part").alias("part"))
            cut = cut.join(fits, F.col("of").eqNullSafe(F.col("src")), "left").select("of", F.coalesce("part", F.shiftleft("slice", above) - 1).alias("last"))
        above = shift
    return cut


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, share: float = 1.0, tilt: float = TILT, carry=()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document."""
    sized = written(sizes(docs, carry), "mix-sizes")
    drawn = written(expectations(sized, targets(sized, weights, max_copies, share), max_copies, tilt, carry), "mix-drawn")
    last = cuts(drawn)
    out = drawn.join(last, drawn["source"].eqNullSafe(F.col("of")), "left")
    taken = F.when(F.col("rank") <= F.col("last"), 1).otherwise(0)
    return out.select(*carry, "doc_id", "source", "size", "source_size", "target", (F.col("sure") + taken).cast("long").alias("copies"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns. Equal rows are taken alike."""
    mark = F.xxhash64("doc_id", "source", "text")
    rows = docs.select(F.struct("*").alias("row_"), mark.alias("m_"))
    mixed = mix(docs.select(F.col("doc_id"), "source", "text", mark.alias("m_")), carry=("m_",))
    # Equal rows are drawn alike, so any of them tells the copies of all.
    copies = mixed.groupBy(F.col("m_").alias("of_")).agg(F.max("copies").alias("n_")).where("n_ > 0")
    out = rows.join(copies, F.col("m_") == F.col("of_"))
    return out.select("row_", F.explode(F.sequence(F.lit(1), F.col("n_").cast("int"))).alias("copy_")).select("row_.*")
