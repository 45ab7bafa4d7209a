"""Partition-wise write-back: which files change, and the rows against a plain rewrite."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import changes as C
from ledgerflow.sources import partitions as P

SCHEMA = "id long, year string, status string, amount int"


def _table(spark, rows):
    base = tempfile.mkdtemp(prefix="ledgerflow-parts-") + "/t"
    P.write_keyed(spark.createDataFrame(rows, SCHEMA), base, "year", "id")
    return base


def _files(base):
    """Every data file with its bytes."""
    return {f: open(f, "rb").read() for f in glob.glob(f"{base}/data/*/*.parquet")}


def _rows(spark, base):
    return sorted((tuple(r) for r in P.read_keyed(spark, base).collect()), key=repr)


def _want(rows):
    return sorted(((i, s, a, y) for i, y, s, a in rows), key=repr)


def _columns_first(spark, base, rows):
    names = P.read_keyed(spark, base).columns
    at = [SCHEMA.replace(",", "").split()[::2].index(x) for x in names]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


YEARS = ["2019", "2020", "2021", None, "2022/23 x"]
ROWS = [(i, YEARS[i % 5], "review", i) for i in range(500)] + [(None, "2019", "review", 1), (7, "2020", "review", 7)]


def test_only_changed_partitions_get_new_files(spark):
    base = _table(spark, ROWS)
    before = _files(base)
    batch = spark.createDataFrame([(1, "filed"), (6, "filed"), (9999, "filed"), (2, "bogus")], "id long, status string")
    done = P.rewrite(spark, base, "year", "id", batch,
                     lambda rows: rows.join(batch.select("id", F.col("status").alias("s")), "id", "left")
                     .withColumn("status", F.when(F.col("s") == "filed", "filed").otherwise(F.col("status")))
                     .drop("s"))
    assert done.rewritten == ["2020"] and set(done.asked) >= {"2020", "2021"}
    after = _files(base)
    for f, data in before.items():
        assert ("year=2020" in f) != (after.get(f) == data)
    want = [(i, y, "filed" if i in (1, 6) else s, a) for i, y, s, a in ROWS]
    assert _rows(spark, base) == _columns_first(spark, base, want)


def test_moves_removals_new_partitions_and_nulls(spark):
    base = _table(spark, ROWS[:20])
    batch = spark.createDataFrame([(i,) for i in (3, 8, 13, 18, 4)], "id long")

    def job(rows):  # the NULL year leaves whole; row 4 moves to a partition not read; 1000 opens a new one
        kept = rows.filter("id not in (3, 8, 13, 18)")
        moved = kept.withColumn("year", F.when(F.col("id") == 4, F.lit("2019")).otherwise(F.col("year")))
        return moved.unionByName(spark.createDataFrame([(1000, "2030", "new", 1)], SCHEMA))

    done = P.rewrite(spark, base, "year", "id", batch, job)
    assert set(done.rewritten) == {None, "2022/23 x", "2019", "2030"}
    want = [(i, "2019" if i == 4 else y, s, a) for i, y, s, a in ROWS[:20] if i not in (3, 8, 13, 18)]
    want.append((1000, "2030", "new", 1))
    assert _rows(spark, base) == _columns_first(spark, base, want)
    # the summaries follow: new keys are found, keys that left are not
    for key, part in ((1000, ["2030"]), (4, ["2019"]), (3, []), (0, ["2019"])):
        assert P.holding(spark, base, "year", "id", spark.createDataFrame([(key,)], "id long"))[1] == part
    assert not [f for f in os.listdir(f"{base}/data") if "HIVE" in f]


def test_rejects_equal_those_of_the_whole_table(spark):
    base = _table(spark, ROWS[:100])
    batch = spark.createDataFrame([(1, "completed"), (2, "bogus"), (777, "completed")], "id long, status string")
    whole = C.set_status(spark.createDataFrame(ROWS[:100], SCHEMA), batch, None)
    want = sorted((r.id, r.reason) for r in whole.rejects.collect())
    whole_state = sorted((r.id, r.status) for r in whole.state.collect())
    done = P.rewrite(spark, base, "year", "id", batch,
                     lambda rows: C.Applied((a := C.set_status(rows, batch, None)).state, a.rejects))
    assert sorted((r.id, r.reason) for r in done.rejects.collect()) == want and want
    assert sorted((r.id, r.status) for r in P.read_keyed(spark, base).collect()) == whole_state


def test_filters_have_no_false_negatives_and_few_candidates(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 40).cast("int").alias("p"))
    base = tempfile.mkdtemp(prefix="ledgerflow-parts-") + "/t"
    P.write_keyed(keys, base, "p", "id")
    maybe, held = P.holding(spark, base, "p", "id", keys.filter("p in (3, 5)"))
    assert sorted(held) == [3, 5] and set(maybe) >= {3, 5}
    one = spark.createDataFrame([("k17",)], "id string")
    maybe, held = P.holding(spark, base, "p", "id", one)
    assert held == [17] and len(maybe) <= 8
    base_of_numbers = _table(spark, ROWS)
    typed = spark.createDataFrame([("0007",), ("x",)], "id string")  # 7 as a number; no number
    assert sorted(P.holding(spark, base_of_numbers, "year", "id", typed)[1]) == ["2020", "2021"]
    absent = spark.createDataFrame([("zzz",), (None,)], "id string")
    assert P.holding(spark, base, "p", "id", absent) == ([], [])


def test_empty_table_empty_batch_and_wrong_columns(spark):
    base = _table(spark, [])
    batch = spark.createDataFrame([(1,)], "id long")
    assert P.rewrite(spark, base, "year", "id", batch, lambda r: r).rewritten == []
    base = _table(spark, ROWS[:10])
    before = _files(base)
    assert P.rewrite(spark, base, "year", "id", batch.limit(0), lambda r: r).rewritten == []
    with pytest.raises(ValueError, match="columns"):
        P.rewrite(spark, base, "year", "id", batch, lambda r: r.withColumn("z", F.lit(1)))
    assert _files(base) == before
