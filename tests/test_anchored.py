"""Client-anchored request windows: brute force, a hot client, live against batch."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerflow.streaming import anchored as AN

SCHEMA = "client string, ts timestamp_ntz, status int, extra string"
T0 = dt.datetime(2024, 3, 1, 9, 7, 30)
LENGTH = dt.timedelta(minutes=15)


def _brute(rows, counted=lambda r: True):
    """The limiter itself: one pass over each client's requests in time order."""
    out = {}
    by_client = {}
    for r in rows:
        if r[1] is not None:
            by_client.setdefault(r[0], []).append(r)
    for client, reqs in by_client.items():
        start = None
        for r in sorted(reqs, key=lambda r: r[1]):
            if start is None or r[1] >= start + LENGTH:
                start = r[1]
            out.setdefault((client, start), 0)
            out[client, start] += counted(r)
    return {(c, s, s + LENGTH, n) for (c, s), n in out.items()}


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _random_rows(seed, clients, n, span_minutes):
    r = random.Random(seed)
    rows = [(r.choice(clients), T0 + dt.timedelta(seconds=r.randrange(span_minutes * 60)),
             r.choice([200, 401, None]), "x") for _ in range(n)]
    return rows + rows[: n // 10]


def test_windows_equal_the_limiter(spark):
    rows = _random_rows(1, ["a", "b", None, "c"], 400, 700) + _random_rows(2, ["hot"], 2000, 900)
    rows += [("quiet", T0, 200, None), ("quiet", T0 + LENGTH, 200, None), ("timeless", None, 401, "")]
    rows += [("old", dt.datetime(1969, 12, 31, 23, 50), 401, ""), ("old", dt.datetime(1970, 1, 1), 401, "")]
    rows += [("steady", T0 + i * LENGTH, 200, "") for i in range(40)]  # one unbroken chain of 40 windows
    got = AN.anchored_windows(_frame(spark, rows)).collect()
    assert len(got) == len(_brute(rows))
    assert {tuple(r) for r in got} == _brute(rows)
    failed = AN.anchored_windows(_frame(spark, rows), counted=F.col("status") >= 400).collect()
    assert {tuple(r) for r in failed} == _brute(rows, lambda r: r[2] is not None and r[2] >= 400)


def test_limits_edges_and_no_requests(spark):
    rows = [("a", T0 + dt.timedelta(seconds=i), 200, "") for i in range(101)]
    rows += [("b", T0 + dt.timedelta(seconds=i), 200, "") for i in range(100)]
    # 60 before an aligned boundary and 60 behind it: two aligned windows, one of the client's
    rows += [("c", dt.datetime(2024, 3, 1, 10, 14) + dt.timedelta(seconds=i), 200, "") for i in range(120)]
    assert {(r.client, r.requests) for r in AN.anchored_breaches(_frame(spark, rows)).collect()} == {
        ("a", 101), ("c", 120)}
    auth = [("a", T0 + dt.timedelta(seconds=i), 401 if i % 2 else 200, "") for i in range(12)]
    assert [(r.client, r.window_start, r.requests)
            for r in AN.anchored_auth_breaches(_frame(spark, auth)).collect()] == [("a", T0, 6)]
    assert AN.anchored_windows(_frame(spark, [])).collect() == []


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_live_equals_batch_over_drops_and_restarts(rocks):
    spark = rocks
    d = tempfile.mkdtemp(prefix="ledgerflow-anchored-")
    rows = _random_rows(3, ["a", "b", "c"], 300, 300)
    rows.sort(key=lambda r: r[1])
    late = random.Random(4)
    # out of order within the watermark's hour; a last request closes all windows
    rows = [r for _, r in sorted((r[1] + dt.timedelta(minutes=late.randrange(40)), r) for r in rows)]
    end = ("z", T0 + dt.timedelta(days=2), 200, "")
    drops = [rows[:110], rows[110:200], rows[200:] + [end]]
    out = []
    for i, part in enumerate(drops):
        _frame(spark, part).coalesce(1).write.mode("append").parquet(f"{d}/in")
        raw = spark.readStream.schema(SCHEMA).parquet(f"{d}/in")
        q = (AN.monitor_anchored(raw, max_requests=2).writeStream.outputMode("append").format("parquet")
             .option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck")
             .trigger(availableNow=True).start())
        assert q.awaitTermination(180)
        out.append(len(os.listdir(f"{d}/out")))
    live = [tuple(r) for r in spark.read.parquet(f"{d}/out").collect()]
    batch = [tuple(r) for r in AN.anchored_breaches(_frame(spark, rows + [end]), 2).collect()]
    assert len(live) == len(set(live)) and sorted(live) == sorted(batch) and len(batch) > 20
