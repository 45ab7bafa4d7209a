"""Statistics kept up to date from change batches, without a recount.

A summary holds only parts that add up: counts and sums, per group.  A batch
adds the parts of the rows it touched as they are now (+) and takes away those
of the same rows as they were (-), so figures go down as well as up, a row
that moves between groups leaves one and enters the other, and a group whose
last row has left is dropped.  Inserts have no rows before, deletes none after.

Rows the batch does not name are never aggregated again: the table is met once
by the batch's keys (broadcast when they measure small), and what follows grows
with the batch, as the summary does with its groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import avg6, money
from ..session import cut_for_join, cut_lineage

S = F.col
COUNTS = ["total_returns", "pending_returns", "in_progress_returns", "completed_returns",
          "filed_returns", "paid_returns"]
SUMS = ["revenue", "filed_income", "filed_income_n"]


def return_parts(tr: DataFrame, group: list[str] | None = None, sign: int = 1) -> DataFrame:
    """Additive parts of the return statistics (rows without a group value form no group)."""
    one = F.lit(sign).cast("long")

    def counted(cond):
        return F.coalesce(F.sum(F.when(cond, one)), F.lit(0))

    filed, paid = S("status") == "filed", S("payment_status") == "paid"
    zero = F.lit(0).cast("decimal(28,2)")
    parts = [counted(F.lit(True)).alias("total_returns"),
             *[counted(S("status") == s).alias(f"{s}_returns") for s in ("pending", "in_progress", "completed", "filed")],
             counted(paid).alias("paid_returns"),
             F.coalesce(F.sum(F.when(paid, S("price") * sign)), zero).cast("decimal(28,2)").alias("revenue"),
             F.coalesce(F.sum(F.when(filed, S("total_income") * sign)), zero).cast("decimal(28,2)").alias("filed_income"),
             counted(filed & S("total_income").isNotNull()).alias("filed_income_n")]
    for g in group or []:
        tr = tr.filter(S(g).isNotNull())
    return tr.groupBy(*group).agg(*parts) if group else tr.agg(*parts)


def _added(parts: DataFrame, group: list[str] | None) -> DataFrame:
    sums = [F.sum(x).alias(x) for x in COUNTS + SUMS]
    out = parts.groupBy(*group).agg(*sums) if group else parts.agg(*sums)
    return out.withColumn("revenue", S("revenue").cast("decimal(28,2)")).withColumn(
        "filed_income", S("filed_income").cast("decimal(28,2)"))


def delta(before: DataFrame, after: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Signed parts of a batch: its rows as they are, less its rows as they were."""
    return _added(return_parts(after, group).unionByName(return_parts(before, group, -1)), group)


def maintained(summary: DataFrame, change: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The stored summary with a batch's signed parts; groups without rows go."""
    out = _added(summary.unionByName(change), group)
    return out.filter(S("total_returns") != 0) if group else out


def after_changes(summary: DataFrame, current: DataFrame, changes: DataFrame,
                  job: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id",
                  group: list[str] | None = None) -> DataFrame:
    """``summary`` of ``current`` after ``job(rows, changes)``, which gives the named rows' new state."""
    keys = cut_for_join(changes.filter(S(key).isNotNull()).select(key).distinct())
    before = cut_lineage(current.join(keys, key, "left_semi"))
    return maintained(summary, delta(before, job(before, changes).select(*before.columns), group), group)


def return_stats(parts: DataFrame) -> DataFrame:
    """The statistics a summary stands for."""
    kept = [x for x in parts.columns if x not in SUMS]
    mean = F.when(S("filed_income_n") != 0, S("filed_income").cast("double") / S("filed_income_n"))
    return parts.select(*kept, money(S("revenue")).alias("total_revenue"),
                        avg6(F.coalesce(mean, F.lit(0.0))).alias("avg_income"))
