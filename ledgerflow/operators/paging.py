"""Sorted, paged listings and top-k.

``orderBy(...).offset(n).limit(k)`` plans as a per-task top-(n+k) followed by
one merge (TakeOrderedAndProject), so a page never sorts the whole table; deep
pages cost proportionally more, as they do in the database.  An ``id``
tie-break makes every page stable, so pages concatenated equal the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.schemas import DEFAULT_PAGE_SIZE
from .util import checked_column, pg_order

USER_SORTS = {"created_at", "email", "first_name", "last_name", "role", "last_login"}
RETURN_SORTS = {"created_at", "tax_year", "status", "payment_status", "price",
                "submission_deadline", "filed_date", "updated_at"}
INQUIRY_SORTS = {"created_at", "status", "inquiry_type", "subject", "email", "responded_at"}


def page(df: DataFrame, sort: str = "created_at", direction: str = "DESC", page_no: int = 1,
         limit: int = DEFAULT_PAGE_SIZE, allowed=None, tiebreak: str = "id") -> DataFrame:
    """One page of ``df`` sorted by an allow-listed column.

    ``limit`` 0 or None means no limit (the models' rule); pages start at 1.
    """
    if allowed is not None:
        checked_column(sort, allowed)
    direction = "desc" if str(direction).lower() == "desc" else "asc"
    order = [pg_order(sort, direction)]
    if tiebreak and tiebreak != sort and tiebreak in df.columns:
        order.append(F.col(tiebreak).asc())
    out = df.orderBy(*order)
    if not limit:
        return out
    start = max(int(page_no) - 1, 0) * int(limit)
    if start:
        out = out.offset(start)
    return out.limit(int(limit))


def ordered(df: DataFrame, col: str, direction: str = "asc", group: str | None = None
            ) -> DataFrame:
    """Rows sorted by ``col`` (within ``group`` when given): a range-partitioned
    global sort, so a large group is spread over many tasks."""
    order = ([F.col(group).asc()] if group else []) + [pg_order(col, direction)]
    return df.orderBy(*order)


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group under ``order``.

    ``row_number() <= k`` lets Spark insert a partial group limit before the
    shuffle (WindowGroupLimit), so each map task ships at most ``k`` rows per
    group and a hot group cannot flood one reducer.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return (df.withColumn("__rn", F.row_number().over(w))
            .filter(F.col("__rn") <= k).drop("__rn"))


def positions(df: DataFrame, group: str, order: list, name: str = "pos") -> DataFrame:
    """1-based position of every row within its group under ``order``,
    without putting a group into one task.

    A global sort range-partitions the rows on (group, order), so a group
    holding a third of the data spans many partitions.  Row numbers within
    each partition are fixed by a checkpoint (so a retried task cannot
    reshuffle them); a small table of (group, partition) row counts gives
    each partition's offset in its group by a prefix sum, and the position is
    that offset plus the row's index in the partition.
    """
    from ..session import cut_lineage

    s = (df.orderBy(F.col(group).asc_nulls_last(), *order)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    parts = s.groupBy(group, "__pid").agg(F.count(F.lit(1)).alias("__n"),
                                          F.min("__mid").alias("__m0"))
    before = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    at = parts.drop("__n").withColumnsRenamed({group: "__g", "__pid": "__p"})
    # NULL is a group of its own
    j = s.join(at, s[group].eqNullSafe(F.col("__g")) & (s["__pid"] == F.col("__p"))).drop("__g", "__p")
    return (j.withColumn(name, (F.col("__off") + (F.col("__mid") - F.col("__m0")) + 1).cast("long"))
            .drop("__pid", "__mid", "__m0", "__off"))


def page_after(df: DataFrame, sort: str, direction: str = "DESC", after=None,
               limit: int = DEFAULT_PAGE_SIZE, allowed=None, tiebreak: str = "id") -> DataFrame:
    """Keyset page: the ``limit`` rows that follow the cursor ``after``.

    ``after`` is the (sort value, tie-break value) of the previous page's
    last row, or None for the first page.  The cursor becomes a filter that
    reaches the scan, then a per-task top-k keeps ``limit`` rows, so a deep
    page costs what the first page costs (OFFSET paging keeps
    ``offset + limit`` rows per task).  Same order as :func:`page`, NULL
    sort values included (first when descending, last when ascending).
    """
    if allowed is not None:
        checked_column(sort, allowed)
    desc = str(direction).lower() == "desc"
    out = df
    if after is not None:
        value, key = after
        s, t = F.col(sort), F.col(tiebreak)
        if value is None:
            # cursor inside the NULL block: NULLs after it, then (desc) every value
            past_nulls = s.isNull() & (t > F.lit(key))
            out = out.filter(past_nulls | s.isNotNull()) if desc else out.filter(past_nulls)
        else:
            beyond = (s < F.lit(value)) if desc else (s > F.lit(value))
            same = (s == F.lit(value)) & (t > F.lit(key))
            cond = beyond | same
            if not desc:
                cond = cond | s.isNull()          # NULLs come last ascending
            out = out.filter(cond)
    return page(out, sort, direction, 1, limit, None, tiebreak)
