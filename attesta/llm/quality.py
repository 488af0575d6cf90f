"""Quality rules by robust multivariate outliers [native].

Every document gets base counts and a vector of transformed statistics, in whole
1/256ths. Per language and source, a minimum-covariance-determinant estimate is found
by concentration steps: centre and scatter of all rows, then of the half (``core``)
nearest by Mahalanobis distance, a few times over. The half is cut on a fixed grid of
distances, so it is counted, not sorted, and a hot source costs partial sums. Documents
beyond ``limit`` in a bad direction are rejected, as are those that fail the base rule. A
direction is bad if the word length alone is beyond the limit, or if half of the squared
distance or more is from word length, either way, and from other statistics above their centre.

Sums are over whole numbers, so reruns agree. A scatter has a floor for each statistic,
as most clean documents have no symbols or repeats at all.

Groups of under ``least`` documents are pooled by language, then all together; a pool
still under ``least`` is not judged by the method. Null text has no words and fails the
base rule; null languages and sources are groups of their own; extra columns and
clashing names are safe, as a row travels packed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import table, words
from attesta.settings import written

SCALE = 256
STATS = ("word_len", "symbols", "dup_lines", "repeats")
FLOOR = (0.15, 0.05, 0.10, 0.10)  # least standard deviation of each statistic
CORE, STEPS, LEAST, LIMIT, GRID = 0.75, 3, 100, 6.0, 32


def counts(docs: DataFrame) -> DataFrame:
    """The packed row, doc_id, lang, source and the base counts."""
    d = docs.select(F.struct("*").alias("row_"), F.col("doc_id"), F.col("lang"), F.col("source"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words(F.col("t"))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    d = d.withColumn("lines", F.transform(lines, lambda x: F.xxhash64(x)))
    n = F.size("w")
    at = lambda i, k: F.element_at("h", i + k)
    five = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(5)]).alias("g"), i.alias("i")))
    d = d.withColumn("five", F.when(n >= 5, F.sort_array(five)))
    twin = F.filter("five", lambda x, k: (F.coalesce(F.get("five", k - 1)["g"] == x["g"], F.lit(False))) | (F.coalesce(F.get("five", k + 1)["g"] == x["g"], F.lit(False))))
    d = d.withColumn("twin", F.sort_array(F.transform(twin, lambda x: x["i"])))
    covered = F.aggregate("twin", F.struct(F.lit(0).alias("n"), F.lit(-9).alias("end")), lambda a, i: F.struct(
        (a["n"] + i + 5 - F.greatest(a["end"], i)).alias("n"), (i + 5).alias("end")), lambda a: a["n"])
    return d.select("row_", "doc_id", "lang", "source", n.cast("long").alias("n_words"),
                    F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                    (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"))


def vector(d: DataFrame) -> DataFrame:
    """x0..x3 in whole 1/256ths: mean word length, and square roots of three shares."""
    full = F.col("n_words") > 0
    stats = (F.log(F.col("word_chars") / F.col("n_words")), F.sqrt(F.col("n_symbols") / F.col("word_chars")),
             F.sqrt(F.col("n_dup_lines") / F.col("n_lines")), F.sqrt(F.col("n_repeat_words") / F.col("n_words")))
    return d.withColumns({f"x{i}": F.when(full, F.round(s * SCALE)).otherwise(0).cast("long") for i, s in enumerate(stats)})


def pools(d: DataFrame, least: int) -> DataFrame:
    """Which pool (g_lang, g_source, level) the documents of a language and source belong to."""
    n = d.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < least
    n = n.withColumn("rest", F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang")))
    level = F.when(~small, 2).when(F.col("rest") >= least, 1).otherwise(0)
    return n.select(F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), F.concat_ws(
        "\x1f", level.cast("string"), F.when(level >= 1, F.coalesce("lang", F.lit("\x1e"))), F.when(level == 2, F.coalesce("source", F.lit("\x1e")))).alias("pool"))


def fit(rows: DataFrame) -> DataFrame:
    """Per pool: n, centre m0.. and the Cholesky factor l00.. of the floored scatter."""
    k = len(STATS)
    sums = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(k)] + [
        F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(k) for j in range(i + 1)]
    out = rows.groupBy("pool").agg(*sums)
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(k)})
    for i in range(k):
        for j in range(i + 1):
            rest = F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                rest = F.greatest(rest, F.lit(0.0)) + (FLOOR[i] * SCALE) ** 2
            for c in range(j):
                rest = rest - F.col(f"l{i}{c}") * F.col(f"l{j}{c}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(F.col("pool").alias("of"), F.col("n").alias("n_pool"), *[f"m{i}" for i in range(k)], *[f"l{i}{j}" for i in range(k) for j in range(i + 1)])


def distance(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """The Mahalanobis distance as ``far``, by forward substitution; null where a pool has no estimate."""
    out = rows.join(fitted, F.col("pool") == F.col("of"), "left")
    for i in range(len(STATS)):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    square: Column = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(STATS))), F.col("y0") * F.col("y0"))
    return out.withColumn("far", F.sqrt(square))


def estimate(rows: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """The estimate of each pool after the concentration steps."""
    fitted = written(fit(rows), "quality-fit")
    for _ in range(steps):
        near = distance(rows, fitted).withColumn("bin", F.floor(F.col("far") * GRID).cast("long"))
        hist = near.groupBy("pool", "bin").agg(F.count("*").alias("c"))
        upto = Window.partitionBy("pool").orderBy("bin")
        hist = hist.withColumn("upto", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(Window.partitionBy("pool")))
        cut = hist.where(F.col("upto") - F.col("c") < core * F.col("all")).groupBy(F.col("pool").alias("cut_of")).agg(F.max("bin").alias("cut"))
        kept = near.join(cut, F.col("pool") == F.col("cut_of")).where("bin <= cut").select(*[c for c in rows.columns])
        fitted = written(fit(kept), "quality-fit")
    return fitted


def judge(docs: DataFrame, limit: float = LIMIT, least: int = LEAST, packed: bool = True) -> DataFrame:
    """The packed row, base counts, base_failed, far and kept."""
    rows = written(vector(counts(docs) if packed else counts(docs).drop("row_")), "quality-rows")
    pool = pools(rows, least)
    stats = rows.join(pool, F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("source").eqNullSafe(F.col("p_source"))).drop("p_lang", "p_source")
    fitted = estimate(stats.where("n_words > 0").select("pool", *[f"x{i}" for i in range(len(STATS))]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    sizes = fitted.where(F.col("n_pool") >= least * CORE / 2)
    out = distance(stats, sizes)
    # The parts of the squared distance: each deviation times its row of the inverse scatter, by back substitution.
    part, k = [], len(STATS)
    for i in reversed(range(k)):
        z = F.col(f"y{i}")
        for j in range(i + 1, k):
            z = z - F.col(f"l{j}{i}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        off = F.col(f"x{i}") - F.col(f"m{i}")
        part.append(F.when((off > 0) | F.lit(i == 0), off * F.col(f"z{i}")).otherwise(0.0))
    bad = (F.col("far") > limit) & ((F.abs("y0") > limit) | (2 * sum(part[1:], part[0]) >= F.col("far") * F.col("far")))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(bad, F.lit(False)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge(docs, packed=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "far")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, packed=True).where("kept").select("row_.*")
