"""Named queries: typed audit rows of one batch, and the snapshots they give back.

The batch: filed returns take income and tax due from their income lines,
cancelled returns leave, and every completed return gets a pending one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import changes as C
from ..sources.standins import AS_OF_RETURNS, Domain
from .registry import register

S = F.col


def _snapshots(d: Domain):
    tr = d.tax_returns
    income = (d.income_sources.groupBy("tax_return_id")
              .agg(F.sum("gross_income").alias("total_income"), F.sum("tax_deducted").alias("total_tax_due")))
    sums = (tr.filter(S("status") == "filed").select("id")
            .join(income, S("id") == S("tax_return_id"), "left").drop("tax_return_id"))
    before = (tr.withColumn("total_refund", F.lit(None).cast("decimal(12,2)"))
              .withColumn("updated_at", F.lit(None).cast("timestamp_ntz")))
    new = (before.filter(S("status") == "completed")
           .withColumns({"id": -S("id") - F.lit(1), "status": F.lit("pending")}))
    state = C.set_calculations(before, sums, AS_OF_RETURNS).state
    after = state.filter(S("status") != "cancelled").unionByName(new)
    return before, after


AFTER_SQL = f"""
SELECT t.* EXCLUDE (hit, gross, tax) REPLACE (CASE WHEN t.hit THEN CAST(t.gross AS DECIMAL(12,2)) ELSE t.total_income END AS total_income,
    CASE WHEN t.hit THEN CAST(t.tax AS DECIMAL(12,2)) ELSE t.total_tax_due END AS total_tax_due),
  CAST(NULL AS DECIMAL(12,2)) AS total_refund,
  CASE WHEN t.hit THEN TIMESTAMP '{AS_OF_RETURNS}' END AS updated_at
FROM (SELECT r.*, i.gross, i.tax, r.status = 'filed' AND i.gross IS NOT NULL AS hit
      FROM tax_returns r LEFT JOIN (SELECT tax_return_id, SUM(gross_income) AS gross,
        SUM(tax_deducted) AS tax FROM income_sources GROUP BY tax_return_id) i
      ON i.tax_return_id = r.id) t
WHERE t.status <> 'cancelled'
UNION ALL
SELECT * REPLACE (-id - 1 AS id, 'pending' AS status), NULL, NULL FROM tax_returns WHERE status = 'completed'"""


def _held(alias: str, column: str) -> str:
    other = "b" if alias == "a" else "a"
    return (f"CASE WHEN {other}.id IS NULL OR a.{column} IS DISTINCT FROM b.{column} "
            f"THEN {alias}.{column} END")


@register("audit_log", views=("tax_returns", "income_sources"), oracle=f"""
WITH b AS (SELECT *, CAST(NULL AS TIMESTAMP) AS updated_at FROM tax_returns),
a AS ({AFTER_SQL})
SELECT CASE WHEN b.id IS NULL THEN 'INSERT' WHEN a.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action,
  'tax_returns' AS table_name, COALESCE(a.id, b.id) AS record_id,
  {_held("b", "total_income")} AS old_income, {_held("a", "total_income")} AS new_income,
  {_held("b", "total_tax_due")} AS old_tax_due, {_held("a", "total_tax_due")} AS new_tax_due,
  {_held("b", "submission_deadline")} AS old_deadline, {_held("a", "submission_deadline")} AS new_deadline,
  {_held("a", "created_at")} AS new_created_at, {_held("a", "updated_at")} AS new_updated_at,
  b.id IS NOT NULL AND (a.id IS NULL OR a.total_tax_due IS DISTINCT FROM b.total_tax_due) AS holds_old_tax
FROM b FULL JOIN a ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.total_income IS DISTINCT FROM b.total_income
  OR a.total_tax_due IS DISTINCT FROM b.total_tax_due OR a.updated_at IS DISTINCT FROM b.updated_at""")
def audit_log(d: Domain):
    """Typed audit rows of the batch; values are read back in their own types."""
    log = A.audit_log(*_snapshots(d), "tax_returns")
    return log.select(
        "action", "table_name", "record_id",
        A.value("old_values", "total_income", "decimal(12,2)").alias("old_income"),
        A.value("new_values", "total_income", "decimal(12,2)").alias("new_income"),
        A.value("old_values", "total_tax_due", "decimal(12,2)").alias("old_tax_due"),
        A.value("new_values", "total_tax_due", "decimal(12,2)").alias("new_tax_due"),
        A.value("old_values", "submission_deadline", "date").alias("old_deadline"),
        A.value("new_values", "submission_deadline", "date").alias("new_deadline"),
        A.value("new_values", "created_at", "timestamp_ntz").alias("new_created_at"),
        A.value("new_values", "updated_at", "timestamp_ntz").alias("new_updated_at"),
        F.coalesce(A.has("old_values", "total_tax_due"), F.lit(False)).alias("holds_old_tax"))


@register("audit_undo", views=("tax_returns",), oracle="""
SELECT *, CAST(NULL AS DECIMAL(12,2)) AS total_refund, CAST(NULL AS TIMESTAMP) AS updated_at FROM tax_returns""")
def audit_undo(d: Domain):
    """The batch's new snapshot turned back by its audit rows: the old one."""
    before, after = _snapshots(d)
    return A.undo(after, A.audit_log(before, after, "tax_returns"), "tax_returns")


@register("audit_redo", views=("tax_returns", "income_sources"), oracle=AFTER_SQL)
def audit_redo(d: Domain):
    """The old snapshot brought forward by the audit rows: the new one."""
    before, after = _snapshots(d)
    return A.redo(before, A.audit_log(before, after, "tax_returns"), "tax_returns")
