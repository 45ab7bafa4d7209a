import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, distance int, q string"


def slow(rows, dim, k, rounds, seed="2:"):
    """Plain clustering with Python integers: sorted (id, cluster, distance), centroids."""
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows
         if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    cents = [q for _, q in sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), q)
                                  for i, q in v if i is not None)[:k]]
    if not cents:
        return [], []

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(q)[1] for _, q in v]
        new = []
        for j, c in enumerate(cents):
            mine = [q for (_, q), o in zip(v, of) if o == j]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
        cents = new
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in v), key=str), cents


def run(spark, rows, dim, k, rounds):
    df = spark.createDataFrame([(i, e, "x", 7, None) for i, e in rows], SCHEMA)
    got, cents = C.cluster(df, "vec_id", C.integers(F.col("embedding"), 256, dim), dim, k, rounds, "2:")
    return sorted(map(tuple, got.collect()), key=str), cents.tolist(), got, cents


def test_equals_plain_clustering_with_odd_rows(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(i % 7, 1) for _ in range(6)]) for i in range(200)]
    rows += [rows[3], rows[3], (7, [0.5] * 6), (None, [1.0] * 6), (900, None), (901, [1.0] * 5), (902, [None] * 6),
             (903, [float("nan")] + [0.0] * 5), (904, [float("-inf")] + [0.0] * 5), (905, [])]
    for k, rounds in ((9, 5), (1, 2), (40, 0)):
        got, cents, assigned, c = run(spark, rows, 6, k, rounds)
        want, want_c = slow(rows, 6, k, rounds)
        assert cents == want_c and got == want
        told = C.with_inertia(assigned, c).collect()
        assert len(told) == len(want)
        for r in told:
            assert r["inertia"] == sum(x[2] for x in want)
            assert r["cluster_inertia"] == sum(x[2] for x in want if x[1] == r["cluster"])
            text = ",".join(map(str, want_c[r["cluster"]]))
            assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_ties_and_all_vectors_equal(spark):
    rows = [(i, [float(i % 2), -1.0]) for i in range(30)]
    got, cents, *_ = run(spark, rows, 2, 6, 3)
    assert (got, cents) == slow(rows, 2, 6, 3)
    rows = [(i, [0.25, 0.25]) for i in range(9)]
    got, cents, *_ = run(spark, rows, 2, 4, 2)
    assert (got, cents) == slow(rows, 2, 4, 2) and {x[1] for x in got} == {0}


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    got, cents, *_ = run(spark, rows, 2, 40, 5)
    assert (got, cents) == slow(rows, 2, 40, 5)
    got, cents, assigned, c = run(spark, [(1, None)], 2, 40, 5)
    assert got == [] and cents == [] and C.with_inertia(assigned, c).collect() == []
    assert run(spark, [(None, [1.0, 1.0])], 2, 3, 1)[0] == []


def test_large_components(spark):
    rows = [(i, [500_000.0 * (-1) ** i, float(i)]) for i in range(8)]
    got, cents, *_ = run(spark, rows, 2, 3, 2)
    assert (got, cents) == slow(rows, 2, 3, 2)
    with pytest.raises(Exception, match="ArithmeticError"):
        run(spark, rows + [(99, [1e30, 0.0])], 2, 3, 2)


def test_the_bound_rules_centroids_out_and_loses_none():
    rng = np.random.default_rng(5)
    basis = rng.normal(size=(5, 64))
    q = np.floor(256 * (rng.normal(size=(3000, 5)) @ basis + 0.05 * rng.normal(size=(3000, 64)))).astype(np.int64)
    mean = q.mean(0)
    axes = np.linalg.eigh(np.cov(q.T))[1][:, ::-1]
    head, rest = C.rotated(q, mean, axes, C.LEADING)
    best, dist, verified = C.nearest(q, head, rest, q[:40], mean, axes)
    full = ((q[:, None, :] - q[None, :40, :]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (dist == full.min(1)).all()
    assert verified < 3000 * 3  # of 40 each
