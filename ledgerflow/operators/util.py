"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, cols) -> list[str]:
    """The subset of ``cols`` that ``df`` has, in the given order."""
    have = set(df.columns)
    return [x for x in cols if x in have]


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates side by side without a cross join.

    Each frame holds one row with its own columns; a union with missing
    columns as NULL followed by a global ``max`` per column gives the single
    combined row.  Three rows in, one row out, no pair building.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [x for f in frames for x in f.columns]
    return merged.agg(*[F.max(x).alias(x) for x in cols])


def pg_order(col: Column | str, direction: str = "asc") -> Column:
    """Sort order with the database's NULL placement.

    The database puts NULLs last ascending and first descending; Spark does
    the reverse by default.
    """
    col = F.col(col) if isinstance(col, str) else col
    if direction.lower() == "desc":
        return col.desc_nulls_first()
    return col.asc_nulls_last()


NULL_SPREAD = 64


def left_join_split_nulls(left: DataFrame, right: DataFrame, left_key: str,
                          right_key: str) -> DataFrame:
    """LEFT JOIN on ``left_key = right_key`` with NULL keys spread over tasks.

    Rows whose key is NULL can never match, yet a shuffle join sends them all
    to one task (they hash alike).  When a third of the rows carry no key
    (unassigned returns), that task is the whole job.  A second join key, 0
    for rows with a key and a hash of the row for the others, spreads them;
    the left side is read once.
    """
    plain = [c for c, t in left.dtypes if not t.startswith("map")]
    spread = F.when(F.col(left_key).isNull(), F.pmod(F.xxhash64(*plain), F.lit(NULL_SPREAD)) + 1)
    keyed = left.withColumn("__spread", F.coalesce(spread, F.lit(0)))
    other = right.withColumn("__zero", F.col(right_key).isNull().cast("long"))
    cond = (F.col(left_key) == F.col(right_key)) & (F.col("__spread") == F.col("__zero"))
    return keyed.join(other, cond, "left").drop("__spread", "__zero")


_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def checked_column(name: str, allowed) -> str:
    """Allow-list a caller-chosen column name (sort keys and the like)."""
    if name not in allowed or not _IDENT.match(name):
        raise ValueError(f"column {name!r} is not allowed; choose one of {sorted(allowed)}")
    return name


def salted_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                how: str = "inner", buckets: int = 16, spread_by: str | None = None
                ) -> DataFrame:
    """Equi-join with the key split into ``buckets`` salted sub-keys.

    Each dimension row is copied once per bucket (``buckets`` copies, not
    pairs) and each fact row picks a bucket from a hash of ``spread_by`` (its
    own id: deterministic, so a retried task lands in the same bucket).  A key
    holding a third of the fact rows is then spread over ``buckets`` tasks.
    For when AQE skew handling is off or a hot key is known in advance.
    """
    spread = F.col(spread_by) if spread_by else F.col(fact_key)
    f = fact.withColumn("__salt", F.pmod(F.hash(spread), F.lit(buckets)))
    d = dim.withColumn("__dsalt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    cond = (F.col(fact_key) == F.col(dim_key)) & (F.col("__salt") == F.col("__dsalt"))
    return f.join(d, cond, how).drop("__salt", "__dsalt")
