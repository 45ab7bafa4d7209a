import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators import access as AC
from ledgerflow.operators import changes as C
from fixtures import AS_OF, accountants, customers, inquiries, returns, table, users


def rows(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_set_status_rules_and_trigger(spark):
    tr = returns(spark)
    chg = spark.createDataFrame(
        [("r01", "review", "admin", None), ("r02", "archived", "admin", None),
         ("r03", "filed", "accountant", "a1"), ("r04", "filed", "accountant", "a1"),
         ("zz", "filed", "admin", None)],
        "id string, status string, actor_role string, actor_accountant_id string")
    res = C.set_status(tr, chg, AS_OF)
    st = rows(res.state)
    rj = rows(res.rejects)
    assert st["r01"].status == "review" and st["r01"].updated_at == AS_OF
    assert st["r04"].status == "filed"
    assert rj["r02"].reason == "invalid_status" and rj["r03"].reason == "not_assigned"
    assert rj["zz"].reason == "not_found"
    assert st["r05"].updated_at is None
    # invariant: state keeps every row; accepted + rejected = batch
    assert res.state.count() == tr.count()
    changed = res.state.filter(F.col("updated_at").isNotNull()).count()
    assert changed + res.rejects.count() == chg.count()


def test_last_change_per_key_wins(spark):
    tr = returns(spark)
    chg = spark.createDataFrame([("r01", "review", 1), ("r01", "completed", 2)],
                                "id string, status string, seq int")
    st = rows(C.set_status(tr, chg, AS_OF, seq="seq").state)
    assert st["r01"].status == "completed"


def test_assign_accountant_active_only(spark):
    tr = returns(spark)
    chg = spark.createDataFrame([("r13", "a1"), ("r14", "a3"), ("r15", "a4")],
                                "id string, accountant_id string")
    res = C.assign_accountant(tr, chg, accountants(spark), AS_OF)
    st, rj = rows(res.state), rows(res.rejects)
    assert st["r13"].status == "in_progress" and st["r13"].accountant_id == "a1"
    assert rj["r14"].reason == "inactive_accountant" and rj["r15"].reason == "inactive_accountant"


def test_set_calculations_missing_becomes_null(spark):
    tr = returns(spark).withColumn("total_refund", F.lit(Decimal("5.00")))
    chg = spark.createDataFrame([("r01", Decimal("10.00"), None), ("r02", Decimal("-1.00"), None),
                                 ("r03", None, Decimal("1.00"))],
                                "id string, total_income decimal(12,2), total_tax_due decimal(12,2)")
    res = C.set_calculations(tr, chg, AS_OF)
    st, rj = rows(res.state), rows(res.rejects)
    assert st["r01"].total_income == Decimal("10.00") and st["r01"].total_refund is None
    assert rj["r02"].reason == "negative_amount" and rj["r03"].reason == "income_required"


def test_mark_filed_and_payment(spark):
    tr = returns(spark)
    res = C.mark_filed(tr, spark.createDataFrame([("r13", "HM-1"), ("r14", ""), ("r15", None),
                                                  ("r16", " ")],
                                                 "id string, hmrc_reference string"), AS_OF)
    st, rj = rows(res.state), rows(res.rejects)
    assert (st["r13"].status, st["r13"].filed_date, st["r13"].hmrc_reference) == ("filed", AS_OF, "HM-1")
    assert rj["r14"].reason == "reference_required" and rj["r15"].reason == "reference_required"
    assert st["r16"].status == "filed"          # the route's check does not trim
    pay = C.set_payment_status(tr, spark.createDataFrame([("r01", "paid"), ("r02", "void")],
                                                         "id string, payment_status string"), AS_OF)
    assert rows(pay.rejects)["r02"].reason == "invalid_payment_status"


def test_insert_returns_defaults(spark):
    tr = returns(spark)
    new = spark.createDataFrame([("n1", "c1", "2024-25", "other", None, None)],
                                "id string, customer_id string, tax_year string, "
                                "situation_type string, submission_deadline date, price decimal(10,2)")
    r = rows(C.insert_returns(tr, new, AS_OF))["n1"]
    assert (r.status, r.payment_status, r.price) == ("pending", "pending", Decimal("169.00"))
    assert r.submission_deadline == dt.date(2024, 1, 31) and r.created_at == AS_OF


def test_create_returns_dedup(spark):
    req = spark.createDataFrame([(1, "c1", "2022-23"), (2, "c1", "2030-31"), (3, "c1", "2030-31"),
                                 (4, "cX", "2030-31")], "seq int, customer_id string, tax_year string")
    out = rows(C.create_returns_dedup(returns(spark), req, customers(spark)), "seq")
    assert [out[i].outcome for i in (1, 2, 3, 4)] == [
        "duplicate_year", "accepted", "duplicate_in_batch", "no_customer_profile"]


def test_insert_income_r14(spark):
    cur = table(spark, "income_sources", [dict(id="i0", tax_return_id="r01", source_type="rental",
                                                gross_income=Decimal("1.00"))])
    new = spark.createDataFrame([("i1", "r01", "employment", Decimal("100.00")),
                                 ("i2", "r01", "salary", Decimal("100.00")),
                                 ("i3", "r01", "rental", Decimal("-5.00"))],
                                "id string, tax_return_id string, source_type string, gross_income decimal(12,2)")
    res = C.insert_income(cur, new)
    st = rows(res.state)
    assert st["i1"].tax_deducted is None and st["i1"].ni_contributions == Decimal("0.00")
    assert {r.id: r.reason for r in res.rejects.collect()} == {
        "i2": "invalid_source_type", "i3": "invalid_gross_income"}


def test_inquiry_status_and_assignment(spark):
    ci = inquiries(spark)
    res = C.set_inquiry_status(ci, spark.createDataFrame(
        [("i2", "in_progress"), ("i3", "new"), ("i4", "bogus")], "id string, status string"), AS_OF)
    st = rows(res.state)
    assert st["i2"].responded_at == AS_OF          # set again on a repeat
    assert st["i3"].responded_at == dt.datetime(2023, 12, 2)  # back to new keeps it
    assert rows(res.rejects)["i4"].reason == "invalid_status"
    asg = C.assign_inquiry(ci, spark.createDataFrame([("i1", "u5"), ("i3", "u5"), ("i4", "u3")],
                                                     "id string, assigned_to string"),
                           users(spark), AS_OF)
    st = rows(asg.state)
    assert (st["i1"].status, st["i1"].assigned_to) == ("in_progress", "u5")
    assert st["i3"].status == "resolved"
    assert rows(asg.rejects)["i4"].reason == "invalid_admin_user"


def test_new_inquiries_defaults(spark):
    new = spark.createDataFrame([("n1", "Hello", None)], "id string, subject string, inquiry_type string")
    r = rows(C.insert_inquiries(inquiries(spark), new, AS_OF))["n1"]
    assert (r.inquiry_type, r.status, r.created_at) == ("general", "new", AS_OF)


def test_update_profile_allowed_fields_only(spark):
    us = users(spark)
    chg = spark.createDataFrame([("u1", None, "Smith", "hacker@x.com")],
                                "id string, first_name string, last_name string, email string")
    r = rows(C.update_profile(us, chg, AS_OF).state)["u1"]
    assert (r.first_name, r.last_name, r.email) == ("Ann", "Smith", "ann@example.com")
    assert r.updated_at == AS_OF


def test_register_users(spark):
    req = spark.createDataFrame(
        [(1, " Ann@Example.com ", "A", "B", None), (2, "new@x.com", "N", "W", "accountant"),
         (3, "NEW@x.com", "N", "W", None), (4, "boss@x.com", "B", "S", "admin"),
         (5, "cust@x.com", "C", "U", None)],
        "seq int, email string, first_name string, last_name string, role string")
    reg = C.register_users(users(spark), req, AS_OF)
    out = rows(reg.outcomes, "seq")
    assert [out[i].outcome for i in range(1, 6)] == [
        "email_exists", "accepted", "duplicate_in_batch", "invalid_role", "accepted"]
    assert reg.accountants.count() == 1 and reg.customers.count() == 1
    assert {r.role for r in reg.users.collect()} == {"accountant", "customer"}


def test_verify_and_soft_delete(spark):
    us = users(spark).withColumn("verification_token",
                                 F.when(F.col("id") == "u2", F.lit("tok")).otherwise(None))
    res = C.verify_users(us, spark.createDataFrame([("tok",), ("bad",)], "verification_token string"),
                         AS_OF)
    r = rows(res.state)["u2"]
    assert r.is_verified is True and r.verification_token is None
    assert [x.verification_token for x in res.rejects.collect()] == ["bad"]
    req = spark.createDataFrame([("u1", "u5", "admin"), ("u5", "u5", "admin")],
                                "id string, actor_id string, actor_role string")
    sd = C.soft_delete_users(users(spark), req, "2001-08-02 00:00:00")
    st = rows(sd.state)
    assert st["u1"].email == "ann@example.com_deleted_996710400.000000" and not st["u1"].is_verified
    assert rows(sd.rejects)["u5"].reason == "cannot_delete_self"


def test_delete_returns_blocked_by_reviews(spark):
    tr = returns(spark)
    rv = table(spark, "reviews", [dict(id="v1", tax_return_id="r02", rating=5)])
    inc = table(spark, "income_sources", [dict(id="i1", tax_return_id="r01"),
                                          dict(id="i2", tax_return_id="r03")])
    out, blocked = C.delete_returns({"tax_returns": tr, "reviews": rv, "income_sources": inc},
                                    spark.createDataFrame([("r01",), ("r02",)], "id string"))
    assert [r.id for r in blocked.collect()] == ["r02"]
    assert out["tax_returns"].count() == tr.count() - 1
    assert [r.id for r in out["income_sources"].collect()] == ["i2"]


def test_cascade_users(spark):
    tr = returns(spark)
    msgs = table(spark, "messages", [dict(id="m1", tax_return_id="r01", sender_id="u2",
                                          recipient_id="u3", message="x")])
    tables = {"users": users(spark), "customers": customers(spark),
              "accountants": accountants(spark), "tax_returns": tr, "messages": msgs,
              "reviews": table(spark, "reviews", [])}
    out, blocked = C.cascade_users(tables, spark.createDataFrame([("u1",), ("u2",)], "id string"))
    assert {(r.user_id, r.blocked_by) for r in blocked.collect()} == {("u2", "messages.sender_id")}
    assert "u1" not in {r.id for r in out["users"].collect()}
    assert {r.customer_id for r in out["tax_returns"].collect()} == {"c2"}
    assert out["messages"].count() == 0   # r01 belonged to u1's customer: cascaded


def test_audit_diff(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "id string, v int")
    got = {r.record_id: r for r in C.audit_diff(before, after, "t").collect()}
    assert set(got) == {"b", "c", "d"}
    assert (got["b"].action, got["b"].old_values, got["b"].new_values) == (
        "UPDATE", '{"v":"2"}', '{"v":"5"}')
    assert got["c"].action == "DELETE" and got["c"].new_values is None
    assert got["d"].action == "INSERT" and got["d"].old_values is None


def test_delete_documents_uploader_not_customer(spark):
    docs = table(spark, "documents", [dict(id="d1", tax_return_id="r01", uploaded_by="u3"),
                                      dict(id="d2", tax_return_id="r01", uploaded_by="u1")])
    grants = AC.visible_documents(users(spark), customers(spark), accountants(spark),
                                  returns(spark), docs, "delete")
    req = spark.createDataFrame([("d1", "u1"), ("d2", "u1"), ("d1", "u5")], "id string, user_id string")
    res = C.delete_documents(docs, req, grants)
    assert res.state.count() == 0
    assert [(r.id, r.user_id) for r in res.rejects.collect()] == [("d1", "u1")]


def test_role_gates_and_check_order(spark):
    tr = returns(spark)
    chg = spark.createDataFrame(
        [("r01", "review", "customer", None), ("zz", "bogus", "admin", None),
         ("zz2", "review", "admin", None), ("r03", "review", "accountant", "a1")],
        "id string, status string, actor_role string, actor_accountant_id string")
    rj = rows(C.set_status(tr, chg, AS_OF).rejects)
    assert rj["r01"].reason == "forbidden_role"
    assert rj["zz"].reason == "invalid_status"       # request checks come before the lookup
    assert rj["zz2"].reason == "not_found"
    assert rj["r03"].reason == "not_assigned"
    calc = spark.createDataFrame([("r04", Decimal("1.00"), "accountant", "a1"),
                                  ("r03", Decimal("1.00"), "accountant", "a1")],
                                 "id string, total_income decimal(12,2), actor_role string, "
                                 "actor_accountant_id string")
    res = C.set_calculations(tr, calc, AS_OF)
    assert rows(res.state)["r04"].total_income == Decimal("1.00")
    assert rows(res.rejects)["r03"].reason == "not_assigned"
    asg = spark.createDataFrame([("r13", "a1", "accountant")],
                                "id string, accountant_id string, actor_role string")
    assert rows(C.assign_accountant(tr, asg, accountants(spark), AS_OF).rejects)["r13"].reason \
        == "forbidden_role"


def test_missing_active_flag_is_stored_as_null(spark):
    ac = accountants(spark)
    res = C.set_accountant_active(ac, spark.createDataFrame([("a1", None)], "id string, is_active boolean"),
                                  AS_OF)
    assert rows(res.state)["a1"].is_active is None and res.rejects.count() == 0


def test_insert_income_access(spark):
    tr = returns(spark)
    cur = table(spark, "income_sources", [])
    new = spark.createDataFrame(
        [("i1", "r01", "employment", Decimal("1.00"), "customer", "c1", None),
         ("i2", "r02", "employment", Decimal("1.00"), "customer", "c1", None),
         ("i3", "r04", "employment", Decimal("1.00"), "accountant", None, "a1"),
         ("i4", "zz", "employment", Decimal("1.00"), "admin", None, None),
         ("i5", "zz", "salary", Decimal("1.00"), "admin", None, None)],
        "id string, tax_return_id string, source_type string, gross_income decimal(12,2), "
        "actor_role string, actor_customer_id string, actor_accountant_id string")
    res = C.insert_income(cur, new, tr)
    assert sorted(r.id for r in res.state.collect()) == ["i1", "i3"]
    assert "actor_role" not in res.state.columns
    assert {r.id: r.reason for r in res.rejects.collect()} == {
        "i2": "access_denied", "i4": "return_not_found", "i5": "invalid_source_type"}


def test_generated_ids_are_stable_across_jobs(spark):
    req = spark.createDataFrame([(1, "x@y.com", "Xa", "Ya", None), (2, "z@y.com", "Za", "Wa",
                                                                    "accountant")],
                                "seq int, email string, first_name string, last_name string, role string")
    reg = C.register_users(users(spark), req, AS_OF)
    ids = {r.id for r in reg.users.collect()}
    linked = {r.user_id for r in reg.customers.collect()} | {r.user_id for r in reg.accountants.collect()}
    assert linked == ids and len(ids) == 2
    assert ids == {r.id for r in reg.users.collect()}          # same again in a new job
    new = spark.createDataFrame([("c1", "2030-31", "other")],
                                "customer_id string, tax_year string, situation_type string")
    a = C.insert_returns(returns(spark), new, AS_OF).filter(F.col("tax_year") == "2030-31")
    assert a.collect()[0].id == a.collect()[0].id and len(a.collect()[0].id) == 36
    twice = C.insert_returns(returns(spark), new.unionAll(new), AS_OF).filter(F.col("tax_year") == "2030-31")
    assert len({r.id for r in twice.collect()}) == 2           # two rows of one pair are two returns
    some = spark.createDataFrame([("n1", "c1", "2030-31", "other"), (None, "c1", "2030-31", "other")],
                                 "id string, customer_id string, tax_year string, situation_type string")
    ids = {r.id for r in C.insert_returns(returns(spark), some, AS_OF).filter("tax_year = '2030-31'").collect()}
    assert "n1" in ids and None not in ids and len(ids) == 2
    named = [C.insert_returns(returns(spark), some.withColumn("request_seq", F.lit(4)), AS_OF, "b7")
             .filter("tax_year = '2030-31' and id <> 'n1'").collect()[0].id for _ in range(2)]
    assert named[0] == named[1]                                # a named batch gives the same ids again


def test_inserted_rows_get_ids(spark):
    new = spark.createDataFrame([("Hello", None)], "subject string, inquiry_type string")
    out = C.insert_inquiries(inquiries(spark), new, AS_OF).filter(F.col("subject") == "Hello")
    assert len(out.collect()[0].id) == 36
    cur = table(spark, "income_sources", [])
    inc = spark.createDataFrame([("r01", "rental", Decimal("5.00"))],
                                "tax_return_id string, source_type string, gross_income decimal(12,2)")
    assert len(C.insert_income(cur, inc).state.collect()[0].id) == 36


def test_create_returns_flow(spark):
    req = spark.createDataFrame(
        [(1, "c1", "2030-31", "other"), (2, "c1", "2030-31", "landlord"),
         (3, "c2", "2030/31", "other"), (4, "c1", "2022-23", "investor"), (5, "c2", "2031-32", "pirate")],
        "seq int, customer_id string, tax_year string, situation_type string")
    res = C.create_returns(returns(spark), req, customers(spark), AS_OF)
    new = res.state.filter(F.col("tax_year") == "2030-31").collect()
    assert len(new) == 1 and new[0].situation_type == "other" and new[0].status == "pending"
    assert res.state.count() == returns(spark).count() + 1
    out = {r.seq: (r.outcome, list(r.errors or [])) for r in res.rejects.collect()}
    assert out[2][0] == "duplicate_in_batch" and out[4][0] == "duplicate_year"
    assert out[3][0] == "invalid" and "Tax year must be in format YYYY-YY (e.g., 2023-24)" in out[3][1]
    assert out[5] == ("invalid", ["Invalid situation type"])


def test_audit_diff_null_swaps_and_no_change(spark):
    before = spark.createDataFrame([("a", None, 1), ("b", 1, None), ("c", 2, 2)],
                                   "id string, x int, y int")
    after = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("c", 2, 2)],
                                  "id string, x int, y int")
    got = C.audit_diff(before, after, "t").collect()
    assert [(r.record_id, r.action) for r in got] == [("a", "UPDATE")]
    assert got[0].old_values == '{"x":null,"y":"1"}' and got[0].new_values == '{"x":"1","y":null}'


def test_every_change_of_a_batch_is_accounted_for(spark):
    tr = returns(spark)
    chg = spark.createDataFrame(
        [("r01", "review", 1), ("r01", "completed", 2), ("r01", "archived", 3), ("r02", "archived", 1),
         ("zz", "review", 1), ("r03", "filed", 5), ("r03", "review", 4)],
        "id string, status string, seq int")
    res = C.set_status(tr, chg, AS_OF, seq="seq")
    st = rows(res.state)
    assert st["r01"].status == "completed"            # the invalid change after it hides nothing
    assert st["r03"].status == "filed" and st["r02"].status == rows(tr)["r02"].status
    assert sorted((r.id, r.seq, r.reason) for r in res.rejects.collect()) == [
        ("r01", 3, "invalid_status"), ("r02", 1, "invalid_status"), ("zz", 1, "not_found")]
    assert sorted((r.id, r.seq) for r in res.superseded.collect()) == [("r01", 1), ("r03", 4)]
    changed = res.state.filter(F.col("updated_at").isNotNull()).count()
    assert changed + res.rejects.count() + res.superseded.count() == chg.count()


def test_profile_columns_fold_apart(spark):
    chg = spark.createDataFrame([("u2", "Rob", None, 1), ("u2", None, "0123", 2), ("u1", "A", "1", 1),
                                 ("u1", "B", "2", 2)], "id string, first_name string, phone string, seq int")
    res = C.update_profile(users(spark), chg, AS_OF, seq="seq")
    st = rows(res.state)
    assert (st["u2"].first_name, st["u2"].phone) == ("Rob", "0123")
    assert (st["u1"].first_name, st["u1"].phone) == ("B", "2")
    assert [(r.id, r.seq) for r in res.superseded.collect()] == [("u1", 1)]


def test_two_changes_of_a_key_need_an_order(spark):
    tr = returns(spark)
    chg = spark.createDataFrame([("r01", "review"), ("r01", "filed"), ("r02", "review"), ("r02", "archived")],
                                "id string, status string")
    res = C.set_status(tr, chg, AS_OF)
    st = rows(res.state)
    assert res.state.count() == tr.count() and st["r01"].updated_at is None
    assert st["r02"].status == "review"
    assert sorted((r.id, r.reason) for r in res.rejects.collect()) == [
        ("r01", C.NO_ORDER), ("r01", C.NO_ORDER), ("r02", "invalid_status")]


def test_big_batch_by_shuffle_equals_broadcast(spark):
    tr = returns(spark)
    chg = spark.createDataFrame([("r01", "review", 1), ("zz", "review", 1), ("r02", "x", 2)],
                                "id string, status string, seq int")
    got = [C.apply_changes(tr, chg, "id", {"status": F.col("chg_status")},
                           [("short", F.length("chg_status") > 1)], AS_OF, seq="seq", max_broadcast=n)
           for n in (0, 1 << 20)]
    for part in ("state", "rejects", "superseded"):
        a, b = (sorted(map(str, getattr(g, part).collect())) for g in got)
        assert a == b


def test_equal_new_lines_get_ids_of_their_own(spark):
    cur = table(spark, "income_sources", [])
    inc = spark.createDataFrame([("r01", "rental", Decimal("5.00"))] * 2,
                                "tax_return_id string, source_type string, gross_income decimal(12,2)")
    first = C.insert_income(cur, inc).state
    both = C.insert_income(first, inc).state
    assert both.select("id").distinct().count() == both.count() == 4


def test_a_refused_registration_takes_no_email(spark):
    req = spark.createDataFrame([(1, "n@y.com", "Aa", "Bb", "admin"), (2, "n@y.com", "Aa", "Bb", None),
                                 (3, "N@y.com", "Aa", "Bb", None)],
                                "seq int, email string, first_name string, last_name string, role string")
    out = {r.seq: r.outcome for r in C.register_users(users(spark), req, AS_OF).outcomes.collect()}
    assert out == {1: "invalid_role", 2: "accepted", 3: "duplicate_in_batch"}


def test_own_rows_do_not_block_a_cascade(spark):
    tables = {"users": users(spark), "customers": customers(spark), "accountants": accountants(spark),
              "tax_returns": table(spark, "tax_returns", [dict(id="x1", customer_id="c2", tax_year="2020-21"),
                                                          dict(id="x2", customer_id="c1", tax_year="2020-21")]),
              "documents": table(spark, "documents", [dict(id="d1", tax_return_id="x1", uploaded_by="u2"),
                                                      dict(id="d2", tax_return_id="x1", uploaded_by="u1")])}
    asked = spark.createDataFrame([("u1",), ("u2",)], "id string")
    out, blocked = C.cascade_users(tables, asked)
    assert [(r.user_id, r.blocked_by) for r in blocked.collect()] == [("u1", "documents.uploaded_by")]
    assert {r.id for r in out["tax_returns"].collect()} == {"x2"}
    assert out["documents"].count() == 0 and "u2" not in rows(out["users"])


def test_audit_diff_sees_columns_of_one_side(spark):
    before = spark.createDataFrame([("a", 1), ("b", 1)], "id string, x int")
    after = spark.createDataFrame([("a", 1, "note"), ("b", 1, None)], "id string, x int, notes string")
    got = C.audit_diff(before, after, "t").collect()
    assert [(r.record_id, r.old_values, r.new_values) for r in got] == [
        ("a", '{"notes":null}', '{"notes":"note"}')]
