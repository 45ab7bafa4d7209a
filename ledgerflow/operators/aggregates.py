"""Dashboards, statistics and analytics.

All of these are algebraic aggregates (count / sum / avg / min / max), so
Spark runs a partial aggregate before the shuffle: a hot key (an accountant
holding a third of the returns) costs one partial row per task, not a third
of the data in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (avg6, avg_where, ceil_div, count_where, elapsed_days,
                              elapsed_hours, interval_ago, midnight_ago, money,
                              sum_where, trunc_to_date)
from .filters import filter_model
from .util import one_row, pg_order, present

S = F.col


def _status(v: str):
    return S("status") == F.lit(v)


def _paid():
    return S("payment_status") == F.lit("paid")


# -- return statistics ---------------------------------------------------------

def return_stat_columns():
    return [
        F.count(F.lit(1)).alias("total_returns"),
        count_where(_status("pending")).alias("pending_returns"),
        count_where(_status("in_progress")).alias("in_progress_returns"),
        count_where(_status("completed")).alias("completed_returns"),
        count_where(_status("filed")).alias("filed_returns"),
        count_where(_paid()).alias("paid_returns"),
        money(F.coalesce(sum_where("price", _paid()), F.lit(0))).alias("total_revenue"),
        avg6(F.coalesce(avg_where(S("total_income").cast("double"), _status("filed")),
                         F.lit(0.0))).alias("avg_income"),
    ]


def return_stats(tr: DataFrame, filters: dict | None = None, group: list[str] | None = None
                 ) -> DataFrame:
    """Return counts by status, paid count and revenue, average filed income.

    ``filters``: accountant_id / customer_id / tax_year (falsy = no filter).
    ``group``: compute the row for every value of these columns at once; rows
    without a value (an unassigned return) form no group.
    """
    df = filter_model(tr, filters)
    if not group:
        return df.agg(*return_stat_columns())
    keyed = df
    for g in group:
        keyed = keyed.filter(S(g).isNotNull())
    return keyed.groupBy(*group).agg(*return_stat_columns())


STAT_ZERO = {"total_returns": 0, "pending_returns": 0, "in_progress_returns": 0,
             "completed_returns": 0, "filed_returns": 0, "paid_returns": 0,
             "total_revenue": 0, "avg_income": 0.0}


def _profile_parts(tr: DataFrame, key: str) -> DataFrame:
    """Re-aggregatable statistics per profile key (counts and sums only)."""
    filed = _status("filed")
    inc = S("total_income").cast("double")
    return (tr.filter(S(key).isNotNull()).groupBy(S(key).alias("__p"))
            .agg(F.count(F.lit(1)).alias("total_returns"),
                 count_where(_status("pending")).alias("pending_returns"),
                 count_where(_status("in_progress")).alias("in_progress_returns"),
                 count_where(_status("completed")).alias("completed_returns"),
                 count_where(filed).alias("filed_returns"),
                 count_where(_paid()).alias("paid_returns"),
                 sum_where("price", _paid()).alias("__rev"),
                 sum_where(inc, filed).alias("__inc_sum"),
                 F.count(F.when(filed, inc)).alias("__inc_n")))


def return_stats_by_user(us: DataFrame, cu: DataFrame, ac: DataFrame, tr: DataFrame
                         ) -> DataFrame:
    """The statistics row of every user, over the returns that user may see.

    Customers: their own returns; accountants: the returns assigned to them
    (all of a user's profiles together); admins: all returns; a user without
    a profile: an empty scope (zeros).  Returns are reduced per profile first
    (partial aggregates), mapped to their user and summed; the average is
    rebuilt from the filed-income sum and count.  The global row reaches the
    admins through an equi-join on a constant key (one row on one side).
    """
    counts = ["total_returns", "pending_returns", "in_progress_returns", "completed_returns",
              "filed_returns", "paid_returns"]
    parts = ["__rev", "__inc_sum", "__inc_n"]
    cmap = cu.select(S("id").alias("__p"), S("user_id").alias("__u"))
    amap = ac.select(S("id").alias("__p"), S("user_id").alias("__u"))
    by_profile = (_profile_parts(tr, "customer_id").join(cmap, "__p")
                  .withColumn("__role", F.lit("customer"))
                  .unionByName(_profile_parts(tr, "accountant_id").join(amap, "__p")
                               .withColumn("__role", F.lit("accountant"))))
    per_user = (by_profile.groupBy("__u", "__role")
                .agg(*[F.sum(c).alias(c) for c in counts + parts]))
    everything = (_profile_parts(tr.withColumn("__all", F.lit(1)), "__all")
                  .drop("__p").withColumn("__k", F.lit(1)))
    people = us.select(S("id").alias("user_id"), "role")
    scoped = (people.join(per_user, (S("user_id") == S("__u")) & (S("role") == S("__role")),
                          "left")
              .drop("__u", "__role"))
    admins = (people.filter(S("role") == "admin").withColumn("__k", F.lit(1))
              .join(F.broadcast(everything), "__k").drop("__k"))
    non_admin = scoped.filter(~F.coalesce(S("role") == "admin", F.lit(False)))
    out = non_admin.unionByName(admins)
    zero = F.lit(0)
    return out.select(
        "user_id", "role", *[F.coalesce(S(c), zero).cast("long").alias(c) for c in counts],
        money(F.coalesce(S("__rev"), zero)).alias("total_revenue"),
        avg6(F.coalesce(S("__inc_sum") / S("__inc_n"), F.lit(0.0))).alias("avg_income"))


# -- dashboard -------------------------------------------------------------------

def dashboard(us: DataFrame, tr: DataFrame, ci: DataFrame) -> DataFrame:
    """The 13 overview figures in one row, from one scan per table."""
    users = us.agg(
        F.count(F.lit(1)).alias("total_users"),
        count_where(S("role") == "customer").alias("total_customers"),
        count_where(S("role") == "accountant").alias("total_accountants"),
        count_where(S("is_verified") == F.lit(True)).alias("verified_users"))
    returns = tr.agg(
        F.count(F.lit(1)).alias("total_tax_returns"),
        count_where(_status("pending")).alias("pending_returns"),
        count_where(_status("in_progress")).alias("in_progress_returns"),
        count_where(_status("completed")).alias("completed_returns"),
        count_where(_status("filed")).alias("filed_returns"),
        count_where(_paid()).alias("paid_returns"),
        money(F.coalesce(sum_where("price", _paid()), F.lit(0))).alias("total_revenue"))
    inquiries = ci.agg(
        F.count(F.lit(1)).alias("total_inquiries"),
        count_where(_status("new")).alias("new_inquiries"))
    return one_row(users, returns, inquiries)


# -- revenue ---------------------------------------------------------------------

# The revenue periods (window, bucket); unknown names use the last.
PERIODS = {"7days": ("7 days", "day"), "30days": ("30 days", "day"),
           "12months": ("12 months", "month")}


def period_spec(period: str) -> tuple[str, str]:
    return PERIODS.get(period, PERIODS["12months"])


def monthly_revenue(tr: DataFrame, as_of) -> DataFrame:
    """Paid returns of the last 12 months by month: count and revenue.

    The window starts at ``as_of - 12 months`` exactly (not a month start), so
    the first bucket may be partial; months without rows are absent.
    """
    recent = tr.filter(_paid() & (S("created_at") >= interval_ago(as_of, "12 months")))
    return (recent.groupBy(trunc_to_date("month", "created_at").alias("month"))
            .agg(F.count(F.lit(1)).alias("returns_count"),
                 money(F.coalesce(F.sum("price"), F.lit(0))).alias("revenue"))
            .orderBy("month"))


def revenue_by_period(tr: DataFrame, as_of, period: str = "12months") -> DataFrame:
    """All returns of the period by day or month, with paid count and revenue."""
    window, unit = period_spec(period)
    recent = tr.filter(S("created_at") >= interval_ago(as_of, window))
    return (recent.groupBy(trunc_to_date(unit, "created_at").alias("period"))
            .agg(F.count(F.lit(1)).alias("returns_count"),
                 money(F.coalesce(F.sum("price"), F.lit(0))).alias("revenue"),
                 count_where(_paid()).alias("paid_count"),
                 money(F.coalesce(sum_where("price", _paid()), F.lit(0))).alias("paid_revenue"))
            .orderBy("period"))


def revenue_totals(tr: DataFrame, as_of, period: str = "12months") -> DataFrame:
    """The period's four totals in one row."""
    window, _ = period_spec(period)
    recent = tr.filter(S("created_at") >= interval_ago(as_of, window))
    return recent.agg(
        F.count(F.lit(1)).alias("total_returns"),
        money(F.coalesce(F.sum("price"), F.lit(0))).alias("total_revenue"),
        count_where(_paid()).alias("total_paid"),
        money(F.coalesce(sum_where("price", _paid()), F.lit(0))).alias("total_paid_revenue"))


# -- accountants -----------------------------------------------------------------

LEADERBOARD_USER_COLUMNS = ["first_name", "last_name", "email", "phone", "is_verified"]


def leaderboard(ac: DataFrame, us: DataFrame, tr: DataFrame) -> DataFrame:
    """Every accountant with profile, return counts and average days to file.

    Returns are aggregated per accountant first (partial aggregation, one row
    per accountant after the shuffle), then joined to the profiles, so the
    join never multiplies rows and accountants without returns keep 0.
    """
    per = (tr.filter(S("accountant_id").isNotNull())
           .groupBy(S("accountant_id").alias("__acc"))
           .agg(F.count("id").alias("total_returns"),
                count_where(S("status").isin("completed", "filed")).alias("completed_returns"),
                avg6(avg_where(elapsed_days("filed_date", "created_at"), _status("filed")))
                .alias("avg_completion_days")))
    ucols = present(us, LEADERBOARD_USER_COLUMNS)
    users = us.select(S("id").alias("__uid"), *ucols,
                      S("created_at").alias("user_created_at"))
    # accountants are few: the planner broadcasts them by file size, or AQE by
    # measured size, into the user join (users is the big side)
    prof = ac.join(users, S("user_id") == S("__uid"), "inner").drop("__uid")
    out = prof.join(per, S("id") == S("__acc"), "left").drop("__acc")
    out = (out.withColumn("total_returns", F.coalesce(S("total_returns"), F.lit(0)).cast("long"))
              .withColumn("completed_returns",
                          F.coalesce(S("completed_returns"), F.lit(0)).cast("long")))
    return out.orderBy(pg_order("rating", "desc"), pg_order("total_returns", "desc"),
                       S("id").asc())


def filing_performance(tr: DataFrame, as_of) -> DataFrame:
    """Days to file (avg/min/max), on-time and total filings, old pending.

    On time compares the filing timestamp with the deadline date at midnight,
    so a filing during the deadline day counts as late.
    """
    filed = _status("filed")
    days = elapsed_days("filed_date", "created_at")
    return tr.agg(
        avg6(avg_where(days, filed)).alias("avg_completion_days"),
        avg6(F.min(F.when(filed, days))).alias("min_completion_days"),
        avg6(F.max(F.when(filed, days))).alias("max_completion_days"),
        count_where(filed & (S("filed_date") <= S("submission_deadline").cast("timestamp_ntz")))
        .alias("on_time_filings"),
        count_where(filed).alias("total_filings"),
        count_where(_status("pending") & (S("created_at") < interval_ago(as_of, "7 days")))
        .alias("overdue_pending"))


def satisfaction(rv: DataFrame) -> DataFrame:
    """Approved reviews: average rating, count, count rated 4 or more."""
    approved = rv.filter(S("is_approved") == F.lit(True))
    return approved.agg(avg6(F.avg("rating")).alias("avg_rating"),
                        F.count(F.lit(1)).alias("total_reviews"),
                        count_where(S("rating") >= 4).alias("positive_reviews"))


# -- inquiries -------------------------------------------------------------------

def inquiry_overview(ci: DataFrame, as_of) -> DataFrame:
    """Counts by status, last 7 / 30 days from midnight, average response hours."""
    return ci.agg(
        F.count(F.lit(1)).alias("total_inquiries"),
        count_where(_status("new")).alias("new_inquiries"),
        count_where(_status("in_progress")).alias("in_progress_inquiries"),
        count_where(_status("resolved")).alias("resolved_inquiries"),
        count_where(_status("closed")).alias("closed_inquiries"),
        count_where(S("created_at") >= midnight_ago(as_of, "7 days")).alias("inquiries_last_7_days"),
        count_where(S("created_at") >= midnight_ago(as_of, "30 days")).alias("inquiries_last_30_days"),
        avg6(avg_where(elapsed_hours("responded_at", "created_at"), S("responded_at").isNotNull()))
        .alias("avg_response_time_hours"))


def inquiries_by_type(ci: DataFrame) -> DataFrame:
    """Inquiry count per type, largest first."""
    return (ci.groupBy("inquiry_type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(S("count").desc(), pg_order("inquiry_type")))


# -- expenses, paging ------------------------------------------------------------

def approved_expenses(tr: DataFrame, ex: DataFrame) -> DataFrame:
    """Sum of approved expenses per return; 0 for a return with none.

    Expenses are reduced to one row per return before the join, so the join
    is one-to-one.
    """
    per = (ex.filter(S("is_approved") == F.lit(True))
           .groupBy(S("tax_return_id").alias("__rid"))
           .agg(F.sum("amount").alias("__sum")))
    return (tr.select("id").join(per, S("id") == S("__rid"), "left")
            .select("id", money(F.coalesce(S("__sum"), F.lit(0))).alias("total_expenses")))


def page_meta(df: DataFrame, limit: int = 20) -> DataFrame:
    """Rows under the filter and the page count ``ceil(total / limit)``."""
    return (df.agg(F.count(F.lit(1)).alias("total"))
            .withColumn("limit", F.lit(limit).cast("long"))
            .withColumn("pages", ceil_div("total", limit)))


# -- return detail ---------------------------------------------------------------

def return_child_totals(tr: DataFrame, inc: DataFrame, ex: DataFrame, doc: DataFrame,
                        msg: DataFrame) -> DataFrame:
    """Per return: number and amount of income, expenses, documents, messages.

    Each child table is aggregated to one row per return before the joins, so
    rows do not multiply and a return with many children costs partial rows
    only.
    """
    def per(df, name, amount=None):
        aggs = [F.count(F.lit(1)).alias(f"{name}_count")]
        if amount:
            aggs.append(money(F.sum(amount)).alias(f"{name}_total"))
        return df.groupBy(S("tax_return_id").alias(f"__{name}")).agg(*aggs)

    out = tr.select("id")
    for df, name, amount in ((inc, "income", "gross_income"), (ex, "expense", "amount"),
                             (doc, "document", None), (msg, "message", None)):
        p = per(df, name, amount)
        out = out.join(p, S("id") == S(f"__{name}"), "left").drop(f"__{name}")
        out = out.withColumn(f"{name}_count", F.coalesce(S(f"{name}_count"), F.lit(0)))
    return out


# Child lists of the return detail and their order.
BUNDLE_ORDER = {"income": ("created_at", "asc"), "expenses": ("expense_date", "desc"),
                "documents": ("created_at", "desc"), "messages": ("created_at", "asc")}


def return_bundle(tr: DataFrame, children: dict[str, DataFrame], ids,
                  chunk_size: int = 500) -> dict[str, DataFrame]:
    """The nested return detail for requested returns.

    Returns ``{"return": rows, <kind>: (tax_return_id, chunk, items)}``: each
    child list is ordered as the detail page orders it, numbered by
    ``paging.positions`` (no window over a whole return, so a return with
    millions of children is spread over many tasks) and cut into arrays of
    at most ``chunk_size`` items, so no output row holds an unbounded list.  Lists stay separate outputs (joining
    them would multiply rows).  ``ids`` is anything ``filters.lookup`` takes.
    """
    from .filters import lookup
    from .paging import positions

    out = {"return": lookup(tr, "id", ids)}
    keys = out["return"].select(S("id").alias("__rid"))
    for kind, df in children.items():
        col, direction = BUNDLE_ORDER.get(kind, ("id", "asc"))
        col = col if col in df.columns else ("seq" if "seq" in df.columns else "id")
        if col not in df.columns:
            col = df.columns[0]
        mine = df.join(keys, S("tax_return_id") == S("__rid"), "left_semi")
        tie = [S("id").asc()] if "id" in df.columns and col != "id" else []
        numbered = positions(mine, "tax_return_id", [pg_order(col, direction), *tie], "__pos")
        item = F.struct(S("__pos"), *[S(x) for x in df.columns if x != "tax_return_id"])
        out[kind] = (numbered.groupBy("tax_return_id",
                                      F.floor((S("__pos") - 1) / chunk_size).alias("chunk"))
                     .agg(F.sort_array(F.collect_list(item)).alias("items")))
    return out
