"""Whitening of embeddings by a distributed covariance and refined eigenvectors.

Entries become integers x = floor(1024 * c) + 100000, so that everything up to the
covariance is exact: tasks give integer sums per dimension, then integer sums of products
of the entries less the integer nearest to their mean, and what that integer misses is
taken off as a fraction. The covariance is a table of d * d numbers (d dimensions; a few
thousand at most), whatever the rows.

Its eigenvectors are first taken in float32. Each Ogita-Aishima round then forms
R = I - X'X and S = X'AX by matrix multiplications in the platform's extended precision
(80 bits on x86) and corrects X by X + XE, which squares the error. Where eigenvalues lie
closer than a round can tell apart, E only makes the columns orthogonal; such a cluster is
solved on its own: the matrix X_k'AX_k less the cluster's mean eigenvalue is small against
A, so a float64 solve of it gives the directions inside the cluster, and rounds go on.

A last pass projects every row; identity_error is measured on the written projections with
Spark's mergeable covariances.

Defined cases: a null, empty, or ragged vector, and one with null or non-finite entries or
entries of 2**51 or more, is dropped (ragged: not of the most frequent length, of equally
frequent ones the longer); a component without variance has no whitened value (null), and a
table without any variance no explained share; deviation is null where it is beyond a long;
repeated rows and null ids keep their rows; an empty table has no rows; columns other than
the id and the vector are not looked at.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table
from attesta.settings import written

SCALE, OFFSET, TOP = 1024, 100_000, 8
REACH, HALF = 2.0 ** 51, 1 << 60
ROUNDS = 30


def grid(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of a batch (its last column), one pair for each length found."""
    col = batch.column(batch.num_columns - 1)
    size = np.diff(np.asarray(col.offsets)).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start, out = np.cumsum(size) - size, []
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        c = flat[start[rows][:, None] + np.arange(d)]
        fit = (np.abs(c) < REACH).all(1)  # not so for NaN either, which a null entry becomes
        out.append((rows[fit], np.floor(SCALE * c[fit]).astype(np.int64) + OFFSET))
    return out


def sums(vectors: DataFrame) -> DataFrame:
    """d, dim, n, total, lo, hi: for each length of vector, exact sums and the range of each dimension."""
    def task(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for rows, x in grid(batch):
                if len(rows):
                    n, total, lo, hi = held.get(x.shape[1], (0, 0, x[0], x[0]))
                    lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
                    small = len(x) * float(max(hi.max(), -lo.min())) < 2.0 ** 62
                    held[x.shape[1]] = [n + len(x), total + (x if small else x.astype(object)).sum(0).astype(object), lo, hi]
        for d, (n, total, lo, hi) in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                                              "total": [str(t) for t in total], "lo": lo, "hi": hi})

    parts = vectors.mapInArrow(task, "d int, dim int, n long, total string, lo long, hi long")
    return parts.groupBy("d", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def products(vectors: DataFrame, middle: np.ndarray, far: int) -> DataFrame:
    """i, j, high, low: exact sums over all rows of (x_i - middle_i) * (x_j - middle_j), i <= j, as high * HALF + low.

    No difference is beyond ``far``.
    """
    d = len(middle)
    upper = np.triu_indices(d)
    # So many rows' products add up exactly in float64, and so many such blocks in a long.
    fit = int(2.0 ** 53 // max(far, 1) ** 2)

    def task(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            for _, x in grid(batch):
                if x.shape[1] != d:
                    continue
                z = x - middle
                if fit < 16:
                    y = z.astype(object)
                    total = total + y.T @ y
                    continue
                for at in range(0, len(z), fit):
                    y = z[at:at + fit].astype(np.float64)
                    total = total + (y.T @ y).astype(np.int64)
        if total.any():
            high, low = zip(*(divmod(int(t), HALF) for t in total[upper]))
            yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "high": list(map(str, high)), "low": list(map(str, low))})

    parts = vectors.mapInArrow(task, "i int, j int, high string, low string")
    return parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])


def covariance(vectors: DataFrame, n: int, total: list[int], far: int, middle: np.ndarray) -> np.ndarray:
    """The covariance with divisor n, each entry rounded once from its exact value."""
    out = np.zeros((len(total), len(total)), np.longdouble)
    left = [t - n * int(m) for t, m in zip(total, middle)]
    for i, j, high, low in products(vectors, middle, far).collect():
        out[i, j] = out[j, i] = extended(Fraction(n * (int(high) * HALF + int(low)) - left[i] * left[j], n * n))
    return out


def extended(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


def refined(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix."""
    d = len(a)
    scale = np.abs(a).max(initial=0)
    if scale == 0:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    a, one = (a / scale).astype(np.longdouble), np.eye(d, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    size, eps = np.sqrt((a * a).sum()), np.finfo(np.longdouble).eps
    last = np.inf
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ a @ x
        value = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + size * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(-value, kind="stable")
        x, value = x[:, order], value[order]
        for k in np.split(np.arange(d), np.flatnonzero(-np.diff(value) > near) + 1):
            if len(k) > 1:
                x[:, k] = x[:, k] @ inside(a, x[:, k])
        done = np.abs(e).max()
        if done < 8 * eps or done >= last and done < d * np.sqrt(eps):
            break
        last = done
    for _ in range(2):  # columns of one cluster, which the rounds leave orthogonal only as far as they are apart
        x = x @ (1.5 * one - x.T @ x / 2)
    x = x / np.sqrt((x * x).sum(0))
    value = (x * (a @ x)).sum(0)
    order = np.argsort(-value, kind="stable")
    return value[order] * scale, x[:, order]


def inside(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Directions inside a cluster: the eigenvectors of its own small matrix, shifted by its mean and orthonormal to start with."""
    gram = x.T @ x
    # One step towards the orthonormal basis nearest to x, which is close to it already.
    x = x @ (1.5 * np.eye(len(gram)) - gram / 2)
    b = x.T @ a @ x
    b = b - np.diag(b).mean() * np.eye(len(b))
    b = (b + b.T) / 2
    scale = np.abs(b).max()
    return np.linalg.eigh((b / scale).astype(np.float64))[1][:, ::-1] if scale > 0 else np.eye(len(b))


def project(rows: DataFrame, n: int, total: list[int], far: int, axes: np.ndarray) -> DataFrame:
    """vec_id, deviation, w: each row's distance from the mean and its coordinates along the columns of ``axes``."""
    d, limit = len(total), np.iinfo(np.int64).max
    narrow = d * (n * (far + 1.0)) ** 2 < 2.0 ** 62 and max(map(abs, total), default=0) + n * (far + 1.0) < 2.0 ** 62
    shift = np.array(total, np.int64 if narrow else object)

    def task(batches):
        for batch in batches:
            for at, x in grid(batch):
                if x.shape[1] == d:
                    y = n * (x if narrow else x.astype(object)) - shift
                    deviation = [v if v <= limit else None for v in (y * y).sum(1).tolist()]
                    w = (y / n).astype(np.float64) @ axes
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    return rows.mapInArrow(task, "vec_id long, deviation long, w array<double>")


def whiten(rows: DataFrame, top: int = TOP, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that is not dropped."""
    spark = rows.sparkSession
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    vectors = rows.select("v")
    found = written(sums(vectors), "sums")
    length = found.where("dim = 0").orderBy(F.desc("n"), F.desc("d")).select("d").first()
    if length is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    by_dim = found.where(F.col("d") == length[0]).orderBy("dim").collect()
    n, total = by_dim[0]["n"], [int(r["total"]) for r in by_dim]
    middle = np.array([round(Fraction(t, n)) for t in total], np.int64)
    far = int(max(np.max([r["hi"] for r in by_dim] - middle), np.max(middle - [r["lo"] for r in by_dim])))
    values, axes = refined(covariance(vectors, n, total, far, middle))
    whole = values.sum()
    top = min(top, len(total))
    some = [k for k in range(top) if values[k] > len(total) * np.finfo(np.float64).eps * values[0]]
    scaled = np.array(axes[:, some] / np.sqrt(values[some]), np.float64)
    out = written(project(rows, n, total, far, scaled), "whitened")

    pairs = [(i, j) for i in range(len(some)) for j in range(i, len(some))]
    cov = out.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first() if pairs else []
    error = max((abs(c - (i == j)) for c, (i, j) in zip(cov, pairs)), default=0.0)
    one = [F.struct(F.lit(k + 1).alias("component"), (F.col("w")[some.index(k)] if k in some else F.lit(None).cast("double")).alias("whitened"),
                    F.lit(float(values[k] / whole) if whole > 0 else None).cast("double").alias("explained")) for k in range(top)]
    return (out.select("vec_id", "deviation", F.explode(F.array(*one)).alias("c"))
            .select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
