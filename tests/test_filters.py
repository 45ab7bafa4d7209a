import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerflow.functions import expr as X
from ledgerflow.operators import changes as C
from ledgerflow.operators import filters as FL
from ledgerflow.sources import seed as SD
from fixtures import AS_OF, accountants, returns, users


def test_filter_eq_skips_all_and_empty(spark):
    tr = returns(spark)
    assert FL.filter_eq(tr, {"status": "all", "tax_year": "", "payment_status": None}).count() == 25
    assert FL.filter_eq(tr, {"status": "filed", "payment_status": "paid"}).count() == 1


def test_filter_model_skips_falsy(spark):
    tr = returns(spark)
    assert FL.filter_model(tr, {"status": "", "tax_year": 0, "accountant_id": False}).count() == 25
    us = users(spark)
    assert FL.filter_model(us, {"is_verified": False}).count() == us.filter("not is_verified").count() > 0


def test_filter_users_verified_text(spark):
    us = users(spark)
    assert FL.filter_users(us, is_verified="true").count() == 5
    assert FL.filter_users(us, is_verified="no").count() == 2   # anything but 'true' is false
    assert FL.filter_users(us, role="accountant", is_verified="all").count() == 2


def test_search_keeps_wildcards(spark):
    us = users(spark)
    assert {r.id for r in FL.search(us, ["email"], "_n@").collect()} == {"u1", "u4", "u6"}
    assert FL.search(us, ["first_name", "last_name", "email"], "").count() == 7
    assert {r.id for r in FL.search(us, ["first_name", "last_name"], "nG").collect()} == {"u3"}


def test_lookup_forms(spark):
    tr = returns(spark)
    assert FL.lookup(tr, "id", "r01").count() == 1
    assert FL.lookup(tr, "id", ["r01", "r02", "zz"]).count() == 2
    keys = spark.createDataFrame([("r03",), ("r03",), ("r04",)], "k string")
    assert FL.lookup(tr, "id", keys).count() == 2
    many = [f"r{i:02d}" for i in range(1, 26)] + [f"x{i}" for i in range(2000)]
    assert FL.lookup(tr, "id", many).count() == 24


def test_by_owner_newest_first_with_limit(spark):
    out = FL.by_owner(returns(spark), "customer_id", "c1", {"status": "", "tax_year": "2023-24"}, 2)
    assert [r.id for r in out.collect()] == ["r99", "r23"]


def test_tokens_and_active(spark):
    live = FL.not_expired(users(spark), "reset_password_expires", AS_OF)
    assert [r.id for r in live.collect()] == ["u2"]     # expired and NULL expiry drop out
    assert {r.id for r in FL.active(accountants(spark)).collect()} == {"a1", "a2"}


def test_public_views(spark):
    pu = FL.public_user(users(spark))
    assert pu.columns == ["id", "email", "firstName", "lastName", "phone", "role", "isVerified",
                          "lastLogin", "createdAt", "updatedAt"]
    assert "totalIncome" in FL.public_return(returns(spark)).columns


def test_settings_listing_and_update(spark):
    st_ = SD.settings(spark)
    keys = [r.setting_key for r in FL.settings(st_).collect()]
    assert keys == sorted(keys) and len(keys) == 7
    res = C.set_setting(st_, spark.createDataFrame(
        [("site_name", "LedgerPro"), ("nope", "x")], "setting_key string, setting_value string"),
        AS_OF)
    by = {r.setting_key: r for r in res.state.collect()}
    assert by["site_name"].setting_value == "LedgerPro" and by["site_name"].updated_at == AS_OF
    assert [r.setting_key for r in res.rejects.collect()] == ["nope"]


def _node_extname(name: str) -> str:
    """Reference model of the upload suffix rule (path.extname, lower, no dot)."""
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    i = base.rfind(".")
    if i <= 0:
        return ""
    return base[i + 1:].lower()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB.x/_-9 ", max_size=12), min_size=1, max_size=20))
def test_file_ext_matches_model(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.e for r in df.select(X.file_ext("n").alias("e")).collect()]
    assert got == [_node_extname(n) for n in names]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=5)),
                          st.one_of(st.none(), st.text(max_size=5))), min_size=1, max_size=10))
def test_full_name_matches_pg(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.v for r in df.select(X.full_name("a", "b").alias("v")).collect()]
    assert got == [f"{a or ''} {b or ''}" for a, b in pairs]


@settings(max_examples=25, deadline=None)
@given(st.integers(min_value=1, max_value=9))
def test_pages_partition_the_list(spark, size):
    from ledgerflow.operators import paging as P
    tr = returns(spark)
    full = [r.id for r in P.page(tr, "created_at", "asc", 1, 0).collect()]
    pages, p = [], 1
    while True:
        chunk = [r.id for r in P.page(tr, "created_at", "asc", p, size).collect()]
        if not chunk:
            break
        pages += chunk
        p += 1
    assert pages == full
