import contextlib
import io

import pytest
from pyspark.sql import functions as F

from ledgerflow import session as SS


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_broadcast_only_of_measured_small_frames(spark):
    small = spark.range(10).withColumn("t", F.lit("x" * 100))
    out, size = SS.cut_and_measure(small)
    assert size == 10 * (2 * 16 + 100) and out.count() == 10
    assert SS.cut_and_measure(spark.range(0))[1] == 0
    big = spark.range(1000)
    near = big.join(SS.cut_for_join(small), "id")
    far = big.join(SS.cut_for_join(small, max_bytes=10), "id")
    assert "ResolvedHint" not in _plan(far) and "BroadcastHashJoin" in _plan(near)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))


def test_no_own_checkpoint_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        SS.ensure_checkpoint_dir(Session())


def test_cut_lineage_keeps_rows_and_drops_plan(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    cut = SS.cut_lineage(df)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        cut.explain()
    assert "Exchange" not in plan.getvalue() and "HashAggregate" not in plan.getvalue()


def test_checkpoint_dir_is_kept_when_set(spark):
    first = SS.ensure_checkpoint_dir(spark)
    assert first and SS.ensure_checkpoint_dir(spark) == first


def test_store_keeps_rows_and_goes_on_from_true_sizes(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(null as string) AS s")
    got = SS.store(df)
    assert got.schema.simpleString() == df.schema.simpleString() and got.count() == 1000
    for _ in range(12):  # joins of joins: the estimates of checkpoints would run away here
        got = SS.store(got.join(got.select(got.id.alias("j")), got.id == F.col("j")).drop("j"))
    assert sorted(got.select("id").toPandas()["id"]) == list(range(1000))
    assert SS.store(df.limit(0)).collect() == []
