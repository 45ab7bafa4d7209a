import datetime as dt
import os
import shutil
import tempfile

from pyspark.sql import functions as F

from ledgerflow.sources import seed as SD
from ledgerflow.sources import sinks, tables, uploads
from ledgerflow.sources.schemas import RAW, TABLES
from ledgerflow.sources.standins import DEPS, STANDIN_SQL
from ledgerflow.streaming import rates as RT

SF = "/root/testdata/sf0.001"


def _requests(spark, n, client=1, status=200, start=dt.datetime(2024, 1, 1, 10, 0)):
    return [(i, client, start + dt.timedelta(seconds=i), status) for i in range(n)]


def test_limit_100_vs_101(spark):
    rows = _requests(spark, 100, client=1) + _requests(spark, 101, client=2)
    df = spark.createDataFrame(rows, "id long, client long, ts timestamp_ntz, status int")
    got = RT.rate_breaches(df).collect()
    assert [(r.client, r.requests) for r in got] == [(2, 101)]
    assert got[0].window_start == dt.datetime(2024, 1, 1, 10, 0)


def test_auth_failures_count_only_failed(spark):
    rows = _requests(spark, 6, status=401) + [(100 + i, 1, dt.datetime(2024, 1, 1, 10, 1), 200)
                                              for i in range(10)]
    rows += _requests(spark, 5, client=3, status=403)
    df = spark.createDataFrame(rows, "id long, client long, ts timestamp_ntz, status int")
    assert [(r.client, r.requests) for r in RT.auth_failure_breaches(df).collect()] == [(1, 6)]


def _stream_dir():
    d = tempfile.mkdtemp(prefix="ledgerflow-stream-")
    os.makedirs(f"{d}/events")
    shutil.copy(f"{SF}/events.parquet", f"{d}/events/part-0.parquet")
    return d


def test_stream_equals_batch(spark):
    d = _stream_dir()
    raw = spark.readStream.schema(RAW["events"]).parquet(f"{d}/events")
    assert raw.isStreaming
    log = spark.sql(STANDIN_SQL["request_log"], events=raw)
    breaches = RT.rate_breaches(log, max_requests=1)
    q = (breaches.writeStream.outputMode("complete").format("memory").queryName("lf_rates")
         .option("checkpointLocation", f"{d}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.table("lf_rates").collect())
    batch_log = spark.sql(STANDIN_SQL["request_log"],
                          **{k: spark.read.parquet(f"{SF}/{k}.parquet") for k in DEPS["request_log"]})
    batch = sorted(tuple(r) for r in RT.rate_breaches(batch_log, max_requests=1).collect())
    assert streamed == batch and len(batch) > 0
    # append mode emits only windows closed by the watermark: a subset
    q2 = (breaches.writeStream.outputMode("append").format("memory").queryName("lf_rates_app")
          .option("checkpointLocation", f"{d}/ckpt2").trigger(availableNow=True).start())
    q2.awaitTermination(120)
    appended = {tuple(r) for r in spark.table("lf_rates_app").collect()}
    assert appended <= set(batch)


def test_activity_stream_union(spark):
    d = _stream_dir()
    raw = spark.readStream.schema(RAW["events"]).parquet(f"{d}/events")
    ci = spark.sql(STANDIN_SQL["contact_inquiries"], events=raw,
                   supplier=spark.read.schema(RAW["supplier"]).parquet(f"{SF}/supplier.parquet"))
    us = spark.createDataFrame([("u", "A", "B", dt.datetime(2024, 1, 1))],
                               "id string, first_name string, last_name string, created_at timestamp_ntz")
    tr = spark.createDataFrame([("r", "2023-24", dt.datetime(2024, 1, 1))],
                               "id string, tax_year string, created_at timestamp_ntz")
    us.write.parquet(f"{d}/users")
    tr.write.parquet(f"{d}/returns")
    us_s = spark.readStream.schema(us.schema).parquet(f"{d}/users")
    tr_s = spark.readStream.schema(tr.schema).parquet(f"{d}/returns")
    s = RT.activity_stream(us_s, tr_s, ci)  # three live sources, one union
    assert s.isStreaming
    q = (s.writeStream.format("memory").queryName("lf_activity").outputMode("append")
         .option("checkpointLocation", f"{d}/ckpt3").trigger(availableNow=True).start())
    q.awaitTermination(120)
    n_events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert spark.table("lf_activity").count() == n_events + 2


def test_upload_manifest_on_files(spark):
    d = tempfile.mkdtemp(prefix="ledgerflow-drop-")
    def put(batch, name, size):
        os.makedirs(f"{d}/{batch}", exist_ok=True)
        with open(f"{d}/{batch}/{name}", "wb") as f:
            f.truncate(size)
    put("b1", "Scan.PDF", 100)
    put("b1", "exact.png", 10 * 1024 * 1024)
    put("b2", "big.pdf", 10 * 1024 * 1024 + 1)
    put("b2", "ok.doc", 10)
    put("b3", "notes", 10)
    for i in range(6):
        put("b4", f"f{i}.pdf", 1)
    files = uploads.read_upload_dir(spark, d)
    out = {(r.batch_id, r.file_name): r for r in uploads.upload_manifest(files).collect()}
    assert out[("b1", "Scan.PDF")].accepted and out[("b1", "exact.png")].accepted
    assert out[("b1", "Scan.PDF")].ext == "pdf" and out[("b1", "Scan.PDF")].document_type == "other"
    assert out[("b2", "big.pdf")].reason == "file_too_large"
    assert out[("b2", "ok.doc")].reason == "batch_rejected"
    assert out[("b3", "notes")].reason == "file_type_not_allowed"
    assert {out[("b4", f"f{i}.pdf")].reason for i in range(6)} == {"too_many_files"}


def test_seed_and_settings(spark):
    s = SD.seed(spark)
    assert s["system_settings"].count() == 7
    assert s["users"].schema == TABLES["users"]
    keys = [r.setting_key for r in s["system_settings"].orderBy("setting_key").collect()]
    assert keys[0] == "allowed_file_types"


def test_write_client_form_and_snapshot(spark):
    d = tempfile.mkdtemp(prefix="ledgerflow-out-")
    us = SD.seed(spark)["users"]
    sinks.write(us, f"{d}/users", client_form=True)
    back = spark.read.parquet(f"{d}/users")
    assert "firstName" in back.columns and "password_hash" not in back.columns
    tr = SD.seed(spark)["tax_returns"]
    p = sinks.write_snapshot(tr, f"{d}/tax_returns", 1, ["tax_year"])
    assert os.path.isdir(f"{p}/tax_year=2023-24")
    tr.write.parquet(f"{d}/declared/tax_returns")
    assert tables.load(spark, f"{d}/declared", "tax_returns").schema == TABLES["tax_returns"]


def test_register_views(spark):
    s = SD.seed(spark)
    names = tables.register_views(spark, s, prefix="t_")
    row = spark.table(names["tax_return_summary"]).collect()[0]
    assert row.customer_name == "Owen Hughes" and row.accountant_name == "Priya Malik"


def test_bucketed_tables_join_without_exchange(spark):
    d = tempfile.mkdtemp(prefix="ledgerflow-bucket-")
    tr = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("v"))
    inc = spark.range(1000).select((F.col("id") % 200).alias("tax_return_id"),
                                   F.col("id").alias("amount"))
    sinks.write_bucketed(tr, "lf_b_returns", f"{d}/r", 8, key="id")
    sinks.write_bucketed(inc, "lf_b_income", f"{d}/i", 8, key="tax_return_id")
    # tables this small would be broadcast; ask for the join that big ones get
    j = spark.table("lf_b_returns").join(spark.table("lf_b_income").hint("merge"),
                                         F.col("id") == F.col("tax_return_id"))
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert j.count() == 1000


def test_monitor_file_sink_restarts_from_checkpoint(spark):
    d = _stream_dir()
    raw = spark.readStream.schema(RAW["events"]).parquet(f"{d}/events")
    log = spark.sql(STANDIN_SQL["request_log"], events=raw)
    q = RT.start_monitor(RT.rate_breaches(log, max_requests=1), f"{d}/out", f"{d}/ck",
                         {"availableNow": True})
    q.awaitTermination(120)
    first = spark.read.parquet(f"{d}/out").count()
    # a restart on the same checkpoint with no new input writes nothing again
    q = RT.start_monitor(RT.rate_breaches(log, max_requests=1), f"{d}/out", f"{d}/ck",
                         {"availableNow": True})
    q.awaitTermination(120)
    assert spark.read.parquet(f"{d}/out").count() == first
    batch_log = spark.sql(STANDIN_SQL["request_log"],
                          events=spark.read.parquet(f"{SF}/events.parquet"))
    assert first <= RT.rate_breaches(batch_log, max_requests=1).count()
