"""Stored pages and lookups: equal to the plain list, and how many rows they read."""

import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.paging import page
from ledgerflow.sources import indexed as IX


def _path():
    return tempfile.mkdtemp(prefix="ledgerflow-indexed-") + "/t"


def _rows_read(df):
    """Rows that the file scans of ``df`` gave, after running it."""
    df.collect()
    todo, read = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            read += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return read


def _list(spark, n=3000):
    # a third of the rows share one value, some have none, some rows are there twice
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 10 != 1, F.col("id") % 97)
                               .cast("int").alias("v"), F.concat(F.lit("t"), "id").alias("text"))
    return df.unionByName(df.filter("id % 500 = 2"))


@pytest.mark.parametrize("direction", ["DESC", "ASC"])
def test_pages_concatenated_are_the_list(spark, direction):
    df, base = _list(spark), _path()
    IX.write_pages(df, base, "v", direction, chunks=12)
    n = df.count()
    whole = [tuple(r) for r in page(df, "v", direction, 1, n, ["v"]).collect()]
    got = []
    for no in range(1, n // 701 + 2):
        got += [tuple(r) for r in IX.read_page(spark, base, "v", direction, no, 701).collect()]
    assert got == whole
    assert IX.read_page(spark, base, "v", direction, 9999, 20).collect() == []


def test_deep_page_reads_no_more_than_the_first(spark):
    base = _path()
    IX.write_pages(_list(spark), base, "v", "DESC", chunks=30)
    reads = [_rows_read(IX.read_page(spark, base, "v", "DESC", no, 20)) for no in (1, 75, 149)]
    assert max(reads) <= 2 * (3006 // 30) * 2 and min(reads) >= 20


def test_empty_list_and_refused_names(spark):
    base = _path()
    IX.write_pages(_list(spark).limit(0), base, "v")
    assert IX.read_page(spark, base, "v", "DESC", 1, 5).collect() == []
    with pytest.raises(ValueError):
        IX.write_pages(_list(spark), _path(), "v; drop", "DESC")
    with pytest.raises(ValueError, match="__chunk"):
        IX.write_pages(_list(spark).withColumn("__chunk", F.lit(1)), _path(), "v")
    with pytest.raises(ValueError):
        IX.read_page(spark, base, "v", "DESC", 0, 5)


def test_lookup_reads_few_rows_and_finds_all(spark):
    path = _path()
    df = spark.range(200000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), "id")
    IX.write_lookup(df.unionByName(df.filter("id = 5")), path, "key", files=8, row_group_bytes=1 << 18)
    keys = [r.key for r in df.filter("id in (5, 77, 150000)").collect()] + ["absent", None]
    found = IX.lookup_keys(spark.read.parquet(path), "key", keys)
    assert sorted(r.id for r in found.collect()) == [5, 5, 77, 150000]
    assert _rows_read(IX.lookup_keys(spark.read.parquet(path), "key", keys)) < 200000 // 4
    # an absent key inside the range of a row group is ruled out by its Bloom filter
    absent = IX.lookup_keys(spark.read.parquet(path), "key", ["7" * 64])
    assert absent.collect() == [] and _rows_read(absent) == 0
    assert IX.lookup_keys(spark.read.parquet(path), "key", []).collect() == []
