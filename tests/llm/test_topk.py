import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import topk as K


def slow(rows, k):
    """(query, rank, id, score) of quantized vectors, ids that 20 divides as queries."""
    own = sorted((i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
                 if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v))
    out = []
    for i, q in own:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in own if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def run(df, k=20, **kw):
    got = K.search(df, "vec_id", K.quantized(F.col("embedding")), F.col("vec_id") % 20 == 0, k, **kw)
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(130)]
    rows += [rows[0], rows[41], (300, None), (301, [1.0, None, 0.0]), (302, [float("nan"), 0.0, 0.0]),
             (303, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (340, [2.0, 2.0]), (360, [])]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows],
                               "vec_id bigint, embedding array<double>, query_id string, score int")
    want = slow(rows, 20)
    assert run(df) == want
    assert run(df, block_bytes=200) == want          # many blocks of queries
    assert run(df.repartition(40)) == want           # a tree of merges
    assert run(df, k=200) == slow(rows, 200)         # fewer candidates than asked for
    assert sum(x[:2] == (0, 1) for x in want) == 2   # a repeated query row has a list of its own


def test_equal_scores_everywhere(spark):
    rows = [(i, [0.5, 0.5]) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert run(df, 7) == slow(rows, 7)


def test_large_components_and_empty_tables(spark):
    rows = [(0, [2.0 ** 24, 1.0]), (1, [2.0 ** 24, 3.0]), (2, [2.0 ** 24 - 1, 3.0]), (20, [-2.0 ** 24, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert run(df, 3) == slow(rows, 3)
    big = [(0, [2.0 ** 27, 2.0 ** 25]), (1, [2.0 ** 27, -2.0 ** 27]), (2, [2.0 ** 23, 2.0 ** 23])]
    past = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):  # 2^33 * 2^33
        run(past)
    near = [(0, [2.0 ** 25, -2.0 ** 25 + 1]), (1, [2.0 ** 25, 2.0 ** 25]), (2, [-2.0 ** 25, 5.0])]
    assert run(spark.createDataFrame(near, "vec_id bigint, embedding array<double>")) == slow(near, 20)
    with pytest.raises(Exception, match="64 bits"):
        run(spark.createDataFrame([(0, [3e38]), (1, [1.0])], "vec_id bigint, embedding array<double>"))
    assert run(df.limit(0)) == []
    assert run(df.filter("vec_id = 1")) == []
