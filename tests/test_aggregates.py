import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators import aggregates as A
from fixtures import AS_OF, accountants, inquiries, returns, table, users


def test_return_stats_counts_and_revenue(spark):
    r = A.return_stats(returns(spark)).collect()[0]
    assert r.total_returns == 25
    assert r.pending_returns == 5 and r.filed_returns == 4 and r.completed_returns == 4
    assert r.paid_returns == 7
    # paid rows: r02 r06 r10 r14 r18 r22 (169 each) + r99 (169)
    assert r.total_revenue == Decimal("1183.00")
    assert r.avg_income == (17000 + 18000 + 19000 + 20000) / 4


def test_return_stats_avg_income_zero_when_nothing_filed(spark):
    tr = returns(spark).filter(F.col("status") != "filed")
    assert A.return_stats(tr).collect()[0].avg_income == 0.0


def test_return_stats_filters_skip_falsy(spark):
    tr = returns(spark)
    a = A.return_stats(tr, {"tax_year": "2023-24", "customer_id": "", "accountant_id": None})
    assert a.collect()[0].total_returns == tr.filter(F.col("tax_year") == "2023-24").count()


def test_return_stats_grouped_skip_null_key(spark):
    rows = A.return_stats(returns(spark), group=["accountant_id"]).collect()
    assert {r.accountant_id for r in rows} == {"a1", "a2"}
    assert sum(r.total_returns for r in rows) == 25 - 5  # r05 r10 r15 r20 r99 unassigned


def test_dashboard_one_row(spark):
    ci = inquiries(spark)
    r = A.dashboard(users(spark), returns(spark), ci).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.total_users, r.total_customers, r.total_accountants, r.verified_users) == (7, 4, 2, 5)
    assert r.total_tax_returns == 25 and r.new_inquiries == 1 and r.total_inquiries == 4


def test_leaderboard_keeps_idle_and_orders_nulls_first(spark):
    rows = A.leaderboard(accountants(spark), users(spark), returns(spark)).collect()
    ids = [r.id for r in rows]
    assert ids[0] == "a2"                      # NULL rating first when descending
    by = {r.id: r for r in rows}
    assert by["a3"].total_returns == 0 and by["a3"].avg_completion_days is None
    assert set(ids) == {"a1", "a2", "a3", "a4"}
    # completed = completed or filed
    tr = returns(spark).filter(F.col("accountant_id") == "a1")
    want = tr.filter(F.col("status").isin("completed", "filed")).count()
    assert by["a1"].completed_returns == want


def test_filing_performance_deadline_day_is_late(spark):
    r = A.filing_performance(returns(spark), AS_OF).collect()[0]
    assert r.total_filings == 4
    assert r.on_time_filings == 3       # 00:00:00 on the deadline day on time, 00:00:01 late
    assert r.overdue_pending == 4       # r99 was created exactly 7 days ago: not older


def test_monthly_revenue_window_not_month_aligned(spark):
    rows = [dict(id=f"m{i}", status="pending", payment_status="paid", price=Decimal("10.00"),
                 created_at=dt.datetime(2023, 1, 31) + dt.timedelta(days=30 * i))
            for i in range(13)]
    tr = table(spark, "tax_returns", rows)
    out = A.monthly_revenue(tr, "2024-01-31 00:00:00").collect()
    months = [r.month for r in out]
    assert months == sorted(months)
    assert months[0] == dt.date(2023, 1, 1)  # partial first bucket
    assert sum(r.returns_count for r in out) == 13


def test_revenue_totals_equal_chart(spark):
    tr = returns(spark)
    chart = A.revenue_by_period(tr, AS_OF, "12months").collect()
    tot = A.revenue_totals(tr, AS_OF, "12months").collect()[0]
    assert tot.total_returns == sum(r.returns_count for r in chart)
    assert tot.total_paid_revenue == sum(r.paid_revenue for r in chart)
    assert A.period_spec("bogus") == A.period_spec("12months")


def test_inquiry_overview_midnight_window(spark):
    r = A.inquiry_overview(inquiries(spark), "2024-01-31 15:00:00").collect()[0]
    assert r.total_inquiries == 4 and r.new_inquiries == 1
    assert r.inquiries_last_7_days == 1       # i1 at midnight 7 days back counts, i2 a minute early not
    assert r.inquiries_last_30_days == 3
    assert r.avg_response_time_hours == (2.0 + 24.0) / 2


def test_inquiry_overview_avg_stays_null_without_responses(spark):
    ci = inquiries(spark).withColumn("responded_at", F.lit(None).cast("timestamp_ntz"))
    assert A.inquiry_overview(ci, AS_OF).collect()[0].avg_response_time_hours is None


def test_approved_expenses_zero_when_none(spark):
    tr = table(spark, "tax_returns", [dict(id="r1"), dict(id="r2")])
    ex = table(spark, "expenses", [
        dict(id="e1", tax_return_id="r1", amount=Decimal("10.00"), is_approved=True),
        dict(id="e2", tax_return_id="r1", amount=Decimal("5.00"), is_approved=False),
        dict(id="e3", tax_return_id="r1", amount=Decimal("7.00"), is_approved=None)])
    got = {r.id: r.total_expenses for r in A.approved_expenses(tr, ex).collect()}
    assert got == {"r1": Decimal("10.00"), "r2": Decimal("0.00")}


def test_page_meta(spark):
    r = A.page_meta(returns(spark), 20).collect()[0]
    assert (r.total, r.pages) == (25, 2)


def test_satisfaction(spark):
    rv = table(spark, "reviews", [dict(id=str(i), rating=v, is_approved=a) for i, (v, a) in
                                  enumerate([(3, True), (4, True), (5, True), (1, False)])])
    r = A.satisfaction(rv).collect()[0]
    assert (r.total_reviews, r.positive_reviews, r.avg_rating) == (3, 2, 4.0)


def test_return_bundle_chunks_and_order(spark):
    tr = table(spark, "tax_returns", [dict(id="r1"), dict(id="r2")])
    inc = table(spark, "income_sources", [
        dict(id=f"i{i}", tax_return_id="r1", gross_income=Decimal(i),
             created_at=dt.datetime(2024, 1, 1) + dt.timedelta(days=5 - i)) for i in range(5)])
    ex = table(spark, "expenses", [dict(id="e1", tax_return_id="r2", amount=Decimal("1.00"),
                                        expense_date=dt.date(2024, 1, 1))])
    out = A.return_bundle(tr, {"income": inc, "expenses": ex}, ["r1"], chunk_size=2)
    assert [r.id for r in out["return"].collect()] == ["r1"]
    chunks = sorted(out["income"].collect(), key=lambda r: r.chunk)
    assert [len(c.items) for c in chunks] == [2, 2, 1]
    flat = [it.id for c in chunks for it in c.items]
    assert flat == ["i4", "i3", "i2", "i1", "i0"]      # oldest first
    assert out["expenses"].count() == 0                 # r2 not requested


def test_return_stats_by_user_scopes(spark):
    from fixtures import customers
    rows = A.return_stats_by_user(users(spark), customers(spark), accountants(spark),
                                  returns(spark)).collect()
    out = {r.user_id: r for r in rows}
    assert len(rows) == len(out)                                     # one row per user
    tr = returns(spark)
    assert out["u5"].total_returns == 25                             # admin: everything
    assert out["u1"].total_returns == tr.filter(F.col("customer_id") == "c1").count()
    # u3 holds two accountant profiles (a1, a4): one scope
    assert out["u3"].total_returns == tr.filter(F.col("accountant_id").isin("a1", "a4")).count()
    assert out["u6"].total_returns == 0 and out["u6"].avg_income == 0.0  # no profile: empty scope
    assert len(out) == 7
