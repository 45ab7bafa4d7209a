"""Named queries: figures kept from change batches, search through stored postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import changes as C
from ..operators import incremental as I
from ..operators import postings as PO
from ..operators.util import one_row
from ..session import cut_lineage, store
from ..sources.standins import AS_OF_RETURNS, Domain
from .analytics import _stats_sql
from .changes import STATUS_HIT, _status_changes
from .registry import register

S = F.col


@register("dashboard_after_changes", views=("users", "tax_returns", "contact_inquiries"), oracle=f"""
WITH now AS (SELECT t.* REPLACE (CASE WHEN {STATUS_HIT} THEN 'completed' ELSE t.status END AS status) FROM tax_returns t)
SELECT (SELECT COUNT(*) FROM users) AS total_users, (SELECT COUNT(*) FROM users WHERE role = 'customer') AS total_customers,
  (SELECT COUNT(*) FROM users WHERE role = 'accountant') AS total_accountants,
  (SELECT COUNT(*) FROM users WHERE is_verified) AS verified_users,
  COUNT(*) AS total_tax_returns, COUNT(*) FILTER (WHERE status = 'pending') AS pending_returns,
  COUNT(*) FILTER (WHERE status = 'in_progress') AS in_progress_returns,
  COUNT(*) FILTER (WHERE status = 'completed') AS completed_returns,
  COUNT(*) FILTER (WHERE status = 'filed') AS filed_returns, COUNT(*) FILTER (WHERE payment_status = 'paid') AS paid_returns,
  CAST(COALESCE(SUM(price) FILTER (WHERE payment_status = 'paid'), 0) AS DECIMAL(18,2)) AS total_revenue,
  (SELECT COUNT(*) FROM contact_inquiries) AS total_inquiries,
  (SELECT COUNT(*) FROM contact_inquiries WHERE status = 'new') AS new_inquiries
FROM now""")
def dashboard_after_changes(d: Domain):
    """The dashboard after the status batch: the stored figures of the returns
    and the signed parts of the changed ones (users and inquiries as stored)."""
    stored = store(I.return_parts(d.tax_returns))
    whole = A.dashboard(d.users, d.tax_returns.limit(0), d.inquiries)
    others = cut_lineage(whole.select("total_users", "total_customers", "total_accountants", "verified_users",
                                      "total_inquiries", "new_inquiries"))
    kept = I.after_changes(stored, d.tax_returns, _status_changes(d),
                           lambda rows, chg: C.set_status(rows, chg, AS_OF_RETURNS).state)
    returns = I.return_stats(kept).withColumnRenamed("total_returns", "total_tax_returns").drop("avg_income")
    return one_row(others, returns)


MOVED = "t.status = 'pending' AND t.id % 2 = 1"


@register("accountant_stats_after_changes", views=("tax_returns", "accountants"), oracle=_stats_sql(f"""(
  SELECT t.* REPLACE (CASE WHEN a.id IS NOT NULL THEN a.id ELSE t.accountant_id END AS accountant_id,
                      CASE WHEN a.id IS NOT NULL THEN 'in_progress' ELSE t.status END AS status)
  FROM tax_returns t LEFT JOIN accountants a ON {MOVED} AND a.is_active AND a.id = t.id % 10)""", "accountant_id"))
def accountant_stats_after_changes(d: Domain):
    """Statistics per accountant after every other pending return was handed to
    another accountant: it leaves one summary row and enters another."""
    tr = d.tax_returns
    stored = store(I.return_parts(tr, ["accountant_id"]))
    chg = tr.filter((S("status") == "pending") & (S("id") % 2 == 1)).select("id", (S("id") % 10).alias("accountant_id"))
    return I.return_stats(I.after_changes(
        stored, tr, chg, lambda rows, c: C.assign_accountant(rows, c, d.accountants, AS_OF_RETURNS).state,
        group=["accountant_id"]))


@register("search_users_postings", views=("users",), oracle="""
SELECT * FROM users WHERE first_name ILIKE '%00_012%EXAM%' OR last_name ILIKE '%00_012%EXAM%' OR email ILIKE '%00_012%EXAM%'""")
def search_users_postings(d: Domain):
    """Substring search through the stored trigrams; wildcards in the text as in the scan."""
    cols = ["first_name", "last_name", "email"]
    return PO.search(d.users, "id", cols, "00_012%EXAM", PO.build(d.users, "id", cols))
