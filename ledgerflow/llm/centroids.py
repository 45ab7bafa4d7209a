"""Centroid clustering in integers, with PCA-rotated filtering of the centroids.

The vectors are rotated to their principal axes.  Of each vector (and centroid)
the leading ``LEADING`` rotated coordinates and the norm of the rest are stored.
For a vector x and a centroid c

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

so the bound on the right costs ``LEADING + 1`` terms and rules centroids out.
The exact integer distance to the centroid of the least bound is computed
first; only centroids whose bound (less ``SLACK`` of the squared norms, far
above the rounding of doubles) does not exceed it are verified, in integers.
Ties go to the smaller centroid number.

The axes come from the exact moments of all vectors: each task adds up its own
products and hands on one row.  The vectors are stored once with their rotated
coordinates; a round sends the centroids (bounded by their number) to the tasks,
which hand back one row of integer sums per centroid.  No vector is exchanged.

Takes part: a vector of exactly ``dim`` components, none null or non-finite.
Others get no row.  Null ids take part but start no centroid.  Repeated rows
count each; where ids repeat, the order of the first centroids goes on by the
components.  With fewer vectors than centroids there are as many centroids as
vectors with an id; with none, no rows.  A component whose integer is beyond
``LIMIT`` would not leave room for squared distances in 64 bits: that raises
ArithmeticError.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import materialize, ship

LEADING = 12
LIMIT = 1 << 27
SLACK = 1e-9
SLICE = 8_192


def integers(vec: Column, factor: int, dim: int) -> Column:
    """floor(factor * x) per component; null for vectors that take no part."""
    x = F.transform(vec, lambda v: v.cast("double"))
    good = (F.size(vec) == dim) & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * factor).cast("bigint")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return (flat.astype(np.int64) if flat.dtype.kind == "i" else flat).reshape(-1, dim)


def _moments(dim: int):
    """mapInArrow: number, sums and products of the vectors of a task, as one row."""
    def run(batches):
        n, one, two = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column("q"), dim).astype(np.float64)
            n, one, two = n + len(x), one + x.sum(0), two + x.T @ x
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "m": pa.array(
            [np.r_[one, two.ravel()].tolist()], pa.list_(pa.float64()))})

    return run


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) of the integer vectors ``q``; axes by falling variance."""
    rows = vectors.select("q").mapInArrow(_moments(dim), "n bigint, m array<double>")
    # dim + dim^2 sums, added up by place: one row of them a task, never a row a vector
    got = (rows.select("n", F.posexplode("m")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
           .collect())
    if not got or not got[0]["n"]:
        return np.zeros(dim), np.eye(dim)
    s = np.zeros(dim + dim * dim)
    for r in got:
        s[r["pos"]] = r["s"]
    mean = s[:dim] / got[0]["n"]
    spread = s[dim:].reshape(dim, dim) / got[0]["n"] - np.outer(mean, mean)
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return mean, axes[:, ::-1]


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the norm of the others."""
    y = (x.astype(np.float64) - mean) @ axes
    return y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(1))


def nearest(q: np.ndarray, head: np.ndarray, rest: np.ndarray, cents: np.ndarray, mean: np.ndarray,
            axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many distances were verified."""
    c_head, c_rest = rotated(cents, mean, axes, head.shape[1])
    scale = (head ** 2).sum(1) + rest ** 2
    c_scale = (c_head ** 2).sum(1) + c_rest ** 2
    bound = ((head ** 2).sum(1)[:, None] - 2 * head @ c_head.T + (c_head ** 2).sum(1)
             + (rest[:, None] - c_rest) ** 2 - SLACK * (scale[:, None] + c_scale + 1))
    rows = np.arange(len(q))
    best = bound.argmin(1)
    dist = ((q - cents[best]) ** 2).sum(1)
    bound[rows, best] = np.inf
    i, j = np.nonzero(bound <= dist[:, None])
    for lo in range(0, len(i), SLICE):
        a, b = i[lo:lo + SLICE], j[lo:lo + SLICE]
        d = ((q[a] - cents[b]) ** 2).sum(1)
        order = np.lexsort((b, d, a))  # the best survivor of each vector comes first
        a, b, d = a[order], b[order], d[order]
        first = np.r_[True, a[1:] != a[:-1]]
        a, b, d = a[first], b[first], d[first]
        won = (d < dist[a]) | ((d == dist[a]) & (b < best[a]))
        dist[a[won]], best[a[won]] = d[won], b[won]
    return best, dist, len(i) + len(q)


def _sums(cents: np.ndarray, mean: np.ndarray, axes: np.ndarray):
    """mapInArrow: per centroid, number and component sums of the vectors of a task."""
    k, dim = cents.shape

    def run(batches):
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for b in batches:
            q = _matrix(b.column("q"), dim)
            best, _, _ = nearest(q, _matrix(b.column("head"), min(LEADING, dim)),
                                 b.column("rest").to_numpy(), cents, mean, axes)
            order = np.argsort(best, kind="stable")
            have, at = np.unique(best[order], return_index=True)
            if len(have):
                n[have] += np.diff(np.r_[at, len(best)])
                total[have] += np.add.reduceat(q[order], at, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64()),
            **{f"s{d}": pa.array(total[some, d], pa.int64()) for d in range(dim)}})

    return run


def _assigned(cents: np.ndarray, mean: np.ndarray, axes: np.ndarray):
    def run(batches):
        dim = cents.shape[1]
        for b in batches:
            best, dist, _ = nearest(_matrix(b.column("q"), dim), _matrix(b.column("head"), min(LEADING, dim)),
                                    b.column("rest").to_numpy(), cents, mean, axes)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(best, pa.int32()), pa.array(dist, pa.int64())], ["id", "cluster", "distance"])

    return run


def _stored(mean: np.ndarray, axes: np.ndarray):
    def run(batches):
        dim = len(mean)
        for b in batches:
            head, rest = rotated(_matrix(b.column("q"), dim), mean, axes, LEADING)
            flat = pa.array(head.ravel(), pa.float64())
            at = pa.array(np.arange(len(rest) + 1, dtype=np.int32) * head.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("q"), pa.ListArray.from_arrays(at, flat), pa.array(rest, pa.float64())],
                ["id", "q", "head", "rest"])

    return run


def cluster(vectors: DataFrame, id_col: str, vec: Column, dim: int, k: int, rounds: int,
            seed: str) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), final centroids) of the integer vectors ``vec``.

    The first centroids are the ``k`` vectors of the least lower-case hex
    sha256 of ``seed`` followed by the decimal id.
    """
    spark = vectors.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "id bigint, cluster int, distance bigint")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.alias("q")).filter("q is not null")
    wide = F.exists("q", lambda v: (v > LIMIT) | (v < -LIMIT))
    rows = rows.withColumn("q", F.when(wide, F.raise_error(
        F.lit(f"ArithmeticError: a component is beyond {LIMIT}, squared distances would leave 64 bits")
    ).cast("array<int>")).otherwise(F.col("q").cast("array<int>")))
    start = (rows.filter("id is not null")
             .select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "q")
             .orderBy("h", "q").limit(k).collect())
    if not start:
        return empty, np.empty((0, dim), dtype=np.int64)
    cents = np.array([r["q"] for r in start], dtype=np.int64)
    mean, axes = principal_axes(rows, dim)
    kept = materialize(rows.mapInArrow(
        _stored(mean, axes), "id bigint, q array<int>, head array<double>, rest double"))
    schema = "cluster int, n bigint, " + ", ".join(f"s{d} bigint" for d in range(dim))
    for _ in range(rounds):
        # k rows a task, then k rows in all
        got = (kept.select("q", "head", "rest").mapInArrow(_sums(cents, mean, axes), schema)
               .groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(dim)])
               .collect())
        new = cents.copy()
        for r in got:
            new[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dim)]
        done = (new == cents).all()
        cents = new
        if done:  # a further round would find the same
            break
    return materialize(kept.select("id", "q", "head", "rest").mapInArrow(
        _assigned(cents, mean, axes), "id bigint, cluster int, distance bigint")), cents


def with_inertia(assigned: DataFrame, cents: np.ndarray) -> DataFrame:
    """``assigned`` with the inertia of each cluster and of all, and each centroid's digest."""
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row per centroid
    total = sum(r["s"] for r in per)
    told = assigned.sparkSession.createDataFrame(
        [(r["cluster"], r["s"], total, centroid_digest(cents[r["cluster"]])) for r in per],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster")


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
