from pyspark.sql import functions as F

from ledgerflow.operators import access as AC
from ledgerflow.operators import quality as Q
from fixtures import accountants, customers, inquiries, returns, table, users


def test_not_null_and_enum(spark):
    us = users(spark)
    nn = Q.dq_not_null({"users": us}).collect()
    assert {(r.row_key, r.column_name) for r in nn} == {("u2", "last_name"), ("u1", "password_hash"),
                                                         ("u3", "password_hash"), ("u4", "password_hash"),
                                                         ("u5", "password_hash"), ("u6", "password_hash"),
                                                         ("u7", "password_hash")}
    tr = returns(spark).withColumn(
        "status", F.when(F.col("id") == "r01", "archived").when(F.col("id") == "r02", None)
        .otherwise(F.col("status")))
    en = Q.dq_enum({"tax_returns": tr}).collect()
    assert [(r.row_key, r.value) for r in en] == [("r01", "archived")]   # NULL passes


def test_rating_range_and_amounts(spark):
    rv = table(spark, "reviews", [dict(id=str(v), rating=v) for v in (0, 1, 5, 6)])
    got = sorted(r.row_key for r in Q.dq_rating_range({"reviews": rv}).collect())
    assert got == ["0", "6"]
    from decimal import Decimal
    tr = table(spark, "tax_returns", [dict(id="x", total_income=Decimal("-1.00"))])
    assert Q.dq_amount_range({"tax_returns": tr}).count() == 1


def test_phone_email_uuid_patterns(spark):
    us = users(spark)
    ph = {r.row_key for r in Q.dq_uk_phone({"users": us}).collect()}
    assert ph == {"u5"}                           # the landline fails; NULL passes
    df = table(spark, "users", [dict(id="1", email="a@b.co"), dict(id="2", email="no-at"),
                                dict(id="3", email=" X@Y.ORG ")])
    assert {r.row_key for r in Q.dq_email({"users": df}).collect()} == {"2"}
    ids = table(spark, "users", [dict(id="3f2504e0-4f89-11d3-9a0c-0305e82c3301"), dict(id="u1")])
    assert [r.row_key for r in Q.dq_uuid({"users": ids}).collect()] == ["u1"]


def test_string_lengths(spark):
    ci = inquiries(spark).withColumn(
        "subject", F.when(F.col("id") == "i1", F.lit("Hi  ")).otherwise(F.col("subject")))
    got = {(r.row_key, r.column_name, r.rule) for r in Q.dq_string_length({"contact_inquiries": ci}).collect()}
    assert ("i1", "subject", "length") in got


def test_unique_and_foreign_keys(spark):
    us = users(spark)
    dup = Q.dq_unique({"users": us}, {"users": [["id"], ["email"]]}).collect()
    assert dup == []                              # case differs: ANN@ vs ann@
    tr = returns(spark)
    dup = Q.dq_unique({"tax_returns": tr}).collect()
    assert any(r.key_columns == "customer_id,tax_year" and r.n > 1 for r in dup)
    fk = Q.dq_foreign_key({"customers": customers(spark), "users": us}).collect()
    assert [(r.table_name, r.value, r.n_rows) for r in fk] == [("customers", "u-missing", 1)]


def test_validate_inquiries_messages(spark):
    df = spark.createDataFrame(
        [("1", "J", "Doe", "bad", None, "Hi", "short", "spam"),
         ("2", "Jane", "Doe", "jane@example.com", "07700900123", "Hello there",
          "A long enough message.", None)],
        "id string, first_name string, last_name string, email string, phone string, "
        "subject string, message string, inquiry_type string")
    out = {r.id: r for r in Q.validate_inquiries(df).collect()}
    assert out["2"].valid and out["2"].errors == []
    assert out["1"].errors == [Q.MESSAGES[k] for k in
                               ("first_name", "email", "subject", "message", "inquiry_type")]


def test_validate_returns_and_registrations(spark):
    tr = table(spark, "tax_returns", [dict(id="a", tax_year="2023-24", situation_type="other"),
                                      dict(id="b", tax_year="2023/24", situation_type="pirate")])
    out = {r.id: r.valid for r in Q.validate_returns(tr).collect()}
    assert out == {"a": True, "b": False}
    reg = Q.validate_registrations(users(spark)).collect()
    assert {r.id for r in reg if not r.valid} == {"u2", "u5", "u7"}  # no last name; admin; bad email


def test_error_classes(spark):
    counts = spark.createDataFrame([("unique", 3)], "rule string, violations long")
    got = {r.rule: (r.message, r.violations) for r in Q.class_counts(counts).collect()}
    assert got["unique"] == ("Duplicate entry", 3)
    assert got["not_null"] == ("Required field missing", 0)
    v = Q.error_classes(spark.createDataFrame([("foreign_key",)], "rule string")).collect()[0]
    assert v.message == "Referenced resource not found" and v.sqlstate == "23503"


def test_visible_returns_and_check(spark):
    g = AC.visible_returns(users(spark), customers(spark), accountants(spark), returns(spark))
    rows = g.collect()
    assert ("u5", None, "all") in {(r.user_id, r.object_id, r.scope) for r in rows}
    own = {r.object_id for r in rows if r.user_id == "u1"}
    assert own == {r.id for r in returns(spark).filter(F.col("customer_id") == "c1").collect()}
    req = spark.createDataFrame([("u1", "r01"), ("u1", "r02"), ("u5", "r02"), ("u3", "r01")],
                                "user_id string, object_id string")
    got = {(r.user_id, r.object_id): r.allowed for r in AC.check_access(req, g).collect()}
    assert got == {("u1", "r01"): True, ("u1", "r02"): False, ("u5", "r02"): True,
                   ("u3", "r01"): True}


def test_owned_outcomes(spark):
    docs = table(spark, "documents", [dict(id="d1", uploaded_by="u1"), dict(id="d2")])
    req = spark.createDataFrame([("u1", "d1"), ("u2", "d1"), ("u5", "d2"), ("u1", "d2"),
                                 ("u1", "zz")], "user_id string, resource_id string")
    got = [(r.user_id, r.resource_id, r.outcome)
           for r in AC.owned(req, docs, "uploaded_by", users(spark)).collect()]
    assert sorted(got) == sorted([("u1", "d1", "allowed"), ("u2", "d1", "denied"),
                                  ("u5", "d2", "allowed"), ("u1", "d2", "not_found"),
                                  ("u1", "zz", "not_found")])
