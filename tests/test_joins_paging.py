import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import joins as J
from ledgerflow.operators import paging as P
from ledgerflow.operators import setops as SO
from ledgerflow.operators.util import left_join_split_nulls
from fixtures import AS_OF, accountants, customers, inquiries, returns, table, users


def test_return_summary_names(spark):
    out = {r.id: r for r in J.return_summary(returns(spark), customers(spark), users(spark),
                                             accountants(spark)).collect()}
    assert out["r05"].accountant_name == " "          # unassigned: CONCAT of NULLs
    assert out["r01"].customer_name == "Ann Lee"
    assert out["r02"].customer_name == "Bob "         # NULL last name
    assert len(out) == 25                             # every return has a customer with a user


def test_return_summary_drops_customer_without_user(spark):
    tr = table(spark, "tax_returns", [dict(id="x", customer_id="c9")])
    assert J.return_summary(tr, customers(spark), users(spark), accountants(spark)).count() == 0


def test_split_null_join_equals_plain_left_join(spark):
    tr = returns(spark).select("id", "accountant_id")
    ac = accountants(spark).select(F.col("id").alias("aid"), "rating")
    plain = tr.join(ac, F.col("accountant_id") == F.col("aid"), "left")
    split = left_join_split_nulls(tr, ac, "accountant_id", "aid")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    joined = J.dim_join(tr, ac, "accountant_id", "aid", "left")
    assert joined.columns == plain.columns and joined.count() == tr.count()


def test_messages_drop_missing_party(spark):
    m = table(spark, "messages", [dict(id="m1", tax_return_id="r01", sender_id="u1",
                                       recipient_id="u3", message="hi"),
                                  dict(id="m2", tax_return_id="r01", sender_id=None,
                                       recipient_id="u3", message="hi")])
    out = J.return_messages(m, users(spark)).collect()
    assert [r.id for r in out] == ["m1"] and out[0].recipient_name == "Cat Ng"


def test_messages_same_by_broadcast_and_by_shuffle(spark):
    m = table(spark, "messages", [dict(id=f"m{i}", tax_return_id=f"r0{i % 3}", sender_id=f"u{i % 7}",
                                       recipient_id=f"u{i % 4}", message="x" * i) for i in range(40)])
    small, large = (J.return_messages(m, users(spark), max_broadcast=b).collect() for b in (1 << 20, -1))
    assert small == large and small


def test_deep_pages_same_by_broadcast_and_by_shuffle(spark):
    tr = spark.range(400).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("a1").alias("accountant_id"),
                                 F.when(F.col("id") % 50 == 0, "c1").otherwise("gone").alias("customer_id"),
                                 (F.col("id") % 11).alias("created_at"))
    args = (tr, customers(spark), users(spark), accountants(spark), None, "created_at", "DESC")
    whole = J.return_listing(*args[:4]).select("id", "created_at").collect()
    want = [r.id for r in sorted(whole, key=lambda r: (-r.created_at, r.id))]
    for page_no in (1, 2, 3):
        small, large = (J.return_listing_page(*args, page_no, 3, ["created_at"], max_broadcast=b).collect()
                        for b in (1 << 20, -1))
        assert small == large and [r.id for r in small] == want[3 * page_no - 3:3 * page_no]


def test_documents_need_known_uploader(spark):
    d = table(spark, "documents", [dict(id="d1", tax_return_id="r01", uploaded_by="u1"),
                                   dict(id="d2", tax_return_id="r01", uploaded_by="nobody")])
    assert [r.id for r in J.return_documents(d, users(spark)).collect()] == ["d1"]


def test_inquiry_listing_unassigned_name(spark):
    out = {r.id: r.assigned_to_name for r in J.inquiry_listing(inquiries(spark), users(spark)).collect()}
    assert out["i1"] == " " and out["i2"] == "Eve Ray"


def test_profile_drops_secrets(spark):
    out = J.profile(users(spark), customers(spark), "customer")
    assert "password_hash" not in out.columns and "reset_password_token" not in out.columns
    assert {r.id: r.city for r in out.collect()}["u1"] == "Leeds"
    admins = J.profile(users(spark), None, "admin")
    assert [r.id for r in admins.collect()] == ["u5"]


def test_pages_concatenate_to_list(spark):
    us = users(spark)
    full = [r.id for r in P.page(us, "created_at", "desc", 1, 0).collect()]
    paged = []
    for p in range(1, 5):
        paged += [r.id for r in P.page(us, "created_at", "desc", p, 2, P.USER_SORTS).collect()]
    assert paged == full
    assert full[:2] == ["u1", "u6"]
    assert full.index("u3") < full.index("u4")  # tie on created_at broken by id


def test_sort_column_allow_list(spark):
    with pytest.raises(ValueError):
        P.page(users(spark), "password_hash; DROP", "desc", 1, 20, P.USER_SORTS)


def test_top_per_group(spark):
    tr = returns(spark)
    top = P.top_per_group(tr, "customer_id", [F.col("created_at").desc(), F.col("id")], 2)
    got = sorted((r.customer_id, r.id) for r in top.collect())
    assert got == [("c1", "r23"), ("c1", "r99"), ("c2", "r22"), ("c2", "r24")]


def test_activity_feed_and_top10(spark):
    feed = SO.activity_feed(users(spark), returns(spark), inquiries(spark), AS_OF)
    types = sorted({r.type for r in feed.collect()})
    assert types == ["contact_inquiry", "tax_return_created", "user_registration"]
    top = SO.recent_activity(users(spark), returns(spark), inquiries(spark), AS_OF, 2).collect()
    assert top[0].description == "Ann Lee" and len(top) == 2


def test_listing_page_equals_page_of_listing(spark):
    args = (returns(spark), customers(spark), users(spark), accountants(spark))
    for pg in (1, 2, 3, 4):
        fast = J.return_listing_page(*args, {"status": "all"}, "created_at", "desc", pg, 7)
        slow = P.page(J.return_listing(*args, {"status": "all"}), "created_at", "desc", pg, 7)
        assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in slow.collect()]


def test_salted_summary_equals_plain(spark):
    args = (returns(spark), customers(spark), users(spark), accountants(spark))
    plain = sorted(tuple(r) for r in J.return_summary(*args).collect())
    salted = sorted(tuple(r) for r in J.return_summary(*args, salt_buckets=4).collect())
    assert plain == salted and len(plain) == 25


def test_invariants_on_test_data(spark):
    """Status counts add up to the total; revenue chart adds up to its totals."""
    from ledgerflow.operators import aggregates as A
    from ledgerflow.sources.standins import AS_OF_RETURNS, Domain
    d = Domain(spark, "/root/testdata/sf0.01")
    tr = d.tax_returns
    st = A.return_stats(tr).collect()[0]
    others = tr.filter(F.col("status").isin("review", "cancelled")).count()
    assert (st.pending_returns + st.in_progress_returns + st.completed_returns
            + st.filed_returns + others) == st.total_returns
    for period in ("7days", "30days", "12months"):
        chart = A.revenue_by_period(tr, AS_OF_RETURNS, period).collect()
        tot = A.revenue_totals(tr, AS_OF_RETURNS, period).collect()[0]
        assert tot.total_returns == sum(r.returns_count for r in chart)
        assert tot.total_revenue == sum(r.revenue for r in chart)


def test_details_by_ids_and_parties(spark):
    args = (returns(spark), customers(spark), users(spark), accountants(spark))
    det = J.return_details(*args, ids=["r01", "r05"]).collect()
    by = {r.id: r for r in det}
    assert set(by) == {"r01", "r05"}
    assert by["r05"].accountant_name == " " and by["r05"].accountant_email is None
    assert by["r01"].customer_email == "ann@example.com"
    parties = {r.id: r for r in J.return_parties(returns(spark), customers(spark),
                                                 accountants(spark)).collect()}
    assert parties["r05"].accountant_user_id is None and parties["r01"].customer_user_id == "u1"


def test_inquiry_detail_and_profile_ids(spark):
    det = {r.id: r for r in J.inquiry_detail(inquiries(spark), users(spark), ["i1", "i2"]).collect()}
    assert set(det) == {"i1", "i2"} and det["i2"].assigned_to_email == "eve@example.com"
    ids = {r.user_id: (r.customer_id, r.accountant_id)
           for r in J.profile_ids(users(spark), customers(spark), accountants(spark))
           .filter(F.col("user_id").isin("u1", "u5")).collect()}
    assert ids == {"u1": ("c1", None), "u5": (None, None)}


def test_document_owner_and_view_grants(spark):
    from ledgerflow.operators import access as AC
    docs = table(spark, "documents", [dict(id="d1", tax_return_id="r01", uploaded_by="u3"),
                                      dict(id="d2", tax_return_id="r04", uploaded_by="u1"),
                                      dict(id="d3", tax_return_id="nope", uploaded_by="u1")])
    own = {r.id: (r.customer_id, r.accountant_id) for r in J.document_owner(docs, returns(spark)).collect()}
    assert own == {"d1": ("c1", "a1"), "d2": ("c2", "a1")}   # d3 has no return
    g = AC.visible_documents(users(spark), customers(spark), accountants(spark), returns(spark),
                             docs, "view")
    rows = {(r.user_id, r.object_id, r.scope) for r in g.collect()}
    assert ("u1", "d1", "row") in rows and ("u3", "d1", "row") in rows
    assert ("u1", "d2", "row") not in rows                    # uploader alone may not view
    assert ("u5", None, "all") in rows


def test_positions_equal_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).alias("v"),
                                  F.col("id"))
    df = df.union(spark.range(3000, 9000).select(F.lit(0).cast("long").alias("g"),
                                                 (F.col("id") % 13).alias("v"), F.col("id")))
    got = P.positions(df.repartition(7), "g", [F.col("v").desc(), F.col("id")])
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    want = df.withColumn("pos", F.row_number().over(w))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_inquiry_page_equals_page_of_listing(spark):
    for pg in (1, 2, 3):
        fast = J.inquiry_listing_page(inquiries(spark), users(spark), None, "created_at", "desc", pg, 1)
        slow = P.page(J.inquiry_listing(inquiries(spark), users(spark)), "created_at", "desc", pg, 1)
        assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in slow.collect()]


def test_keyset_pages_equal_offset_pages(spark):
    tr = returns(spark).withColumn(
        "filed_date", F.when(F.col("id").isin("r01", "r02", "r03"), F.lit(None))
        .otherwise(F.col("filed_date")))
    for sort, direction in (("filed_date", "desc"), ("filed_date", "asc"), ("created_at", "desc")):
        full = [r.id for r in P.page(tr, sort, direction, 1, 0).collect()]
        got, cursor = [], None
        while True:
            rows = P.page_after(tr, sort, direction, cursor, 4).collect()
            if not rows:
                break
            got += [r.id for r in rows]
            cursor = (rows[-1][sort], rows[-1].id)
        assert got == full, (sort, direction)


def test_positions_keep_rows_without_a_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 7), (None, 5)], "g string, x int")
    got = sorted(((r.g or "", r.x, r.pos) for r in P.positions(df, "g", [F.col("x").asc()]).collect()))
    assert got == [("", 5, 1), ("", 7, 2), ("a", 1, 1), ("a", 2, 2)]


def test_page_survives_many_dropped_rows(spark):
    tr = table(spark, "tax_returns", [dict(id=f"n{i:03}", customer_id="c9" if i < 150 else "c1",
                                           tax_year="2020-21") for i in range(160)])
    got = J.return_listing_page(tr, customers(spark), users(spark), accountants(spark), None, "id", "ASC", 1, 5)
    assert [r.id for r in got.collect()] == ["n150", "n151", "n152", "n153", "n154"]
