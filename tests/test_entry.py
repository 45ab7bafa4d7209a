import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from ledgerflow.plans.catalog import QUERIES  # noqa: E402
from parity import TABLES, rows_duck, rows_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert "total_returns" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def test_all_queries_match_oracle_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    bad = []
    orc = E.oracle_sql()
    for name, fn in sorted(QUERIES.items()):
        sc, sr = rows_spark(fn(spark, SF))
        if name in orc:
            dc, dr = rows_duck(con, orc[name])
            if sc != dc or sr != dr:
                bad.append(name)
    assert bad == []
