import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions import expr as X


def one(spark, col, data=None, schema="a string, b string"):
    df = spark.createDataFrame(data or [(None, None)], schema)
    return df.select(col.alias("v")).collect()


def test_pg_concat_skips_nulls(spark):
    rows = one(spark, X.full_name("a", "b"), [("Ann", None), (None, "Lee"), (None, None)])
    assert [r.v for r in rows] == ["Ann ", " Lee", " "]


def test_spark_concat_would_be_null(spark):
    rows = one(spark, F.concat(F.col("a"), F.lit(" "), F.col("b")), [("Ann", None)])
    assert rows[0].v is None  # the reason pg_concat exists


def test_file_ext(spark):
    names = ["Report.PDF", "noext", ".env", "a.b.docx", "dir.x/file", "x.", "up/Scan.JPeG"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.e for r in df.select(X.file_ext("n").alias("e")).collect()]
    assert got == ["pdf", "", "", "docx", "", "", "jpeg"]


def test_topic_slug(spark):
    rows = one(spark, X.topic_slug("a"), [("Tax  Return\tHelp", None)])
    assert rows[0].v == "tax-return-help"


def test_js_trim_removes_all_whitespace(spark):
    rows = one(spark, X.js_trim("a"), [("\n hi \t\r", None)])
    assert rows[0].v == "hi"


def test_epoch_text_and_deleted_email(spark):
    assert X.epoch_text("2001-08-02 00:00:00") == "996710400.000000"
    assert X.epoch_text(dt.datetime(1970, 1, 1, 0, 0, 1, 500)) == "1.000500"
    rows = one(spark, X.deleted_email("a", "2001-08-02 00:00:00"), [("x@y.z", None)])
    assert rows[0].v == "x@y.z_deleted_996710400.000000"


def test_interval_ago_month_end_clamps(spark):
    rows = spark.range(1).select(X.interval_ago("2024-03-31 10:00:00", "1 month").alias("v"),
                                 X.interval_ago("2024-01-31 00:00:00", "7 days").alias("w"),
                                 X.midnight_ago("2024-01-31 15:30:00", "7 days").alias("m")
                                 ).collect()[0]
    assert rows.v == dt.datetime(2024, 2, 29, 10, 0)
    assert rows.w == dt.datetime(2024, 1, 24)
    assert rows.m == dt.datetime(2024, 1, 24)


def test_elapsed(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 12))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(X.elapsed_days("b", "a").alias("d"), X.elapsed_hours("b", "a").alias("h")
                  ).collect()[0]
    assert r.d == 1.5 and r.h == 36.0


def test_count_where_counts_only_true(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert df.agg(X.count_where(F.col("f")).alias("n")).collect()[0].n == 1


def test_ceil_div(spark):
    df = spark.createDataFrame([(0,), (20,), (21,)], "t long")
    assert [r.p for r in df.select(X.ceil_div("t", 20).alias("p")).collect()] == [0, 1, 2]
