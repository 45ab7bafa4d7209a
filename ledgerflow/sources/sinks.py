"""Writing results: lists in client form and table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.filters import SECRET_USER_COLUMNS
from ..operators.util import camel


def write(df: DataFrame, path: str, partition_cols=None, client_form: bool = False,
          mode: str = "errorifexists") -> None:
    """Save a result as parquet.

    ``client_form`` drops secret user columns and renames to camelCase, as the
    API's JSON does.  Returns are best written ``partition_cols=["tax_year"]``
    so readers prune by year.
    """
    out = df
    if client_form:
        out = out.drop(*SECRET_USER_COLUMNS)
        out = out.select(*[out[c].alias(camel(c)) for c in out.columns])
        partition_cols = [camel(c) for c in (partition_cols or [])]
    w = out.write.mode(mode)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def write_snapshot(df: DataFrame, base: str, version: int, partition_cols=None) -> str:
    """Write a new snapshot at ``<base>/v=<version>`` and return its path.

    A change job reads snapshot N and writes N+1; readers move to N+1 once it
    is complete, so no path is overwritten while it is read, and a failed
    write leaves N intact (the job can simply be re-run).
    """
    path = f"{base.rstrip('/')}/v={int(version)}"
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)
    return path


# Join keys the practice tables are bucketed on: returns by their id, the
# child tables by the return they belong to, so return/child joins (detail,
# cascades, deletes, per-return aggregates) read co-located buckets and need
# no shuffle.  Every table in a group must use the same bucket count.
BUCKET_KEYS = {
    "tax_returns": "id", "income_sources": "tax_return_id", "expenses": "tax_return_id",
    "documents": "tax_return_id", "messages": "tax_return_id", "payments": "tax_return_id",
}


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int,
                   key: str | None = None, mode: str = "overwrite") -> str:
    """Save ``df`` as an external table bucketed and sorted by its join key.

    Returns the catalog table name.  Later joins between tables bucketed on
    the same key with the same bucket count are planned without an exchange.
    """
    key = key or BUCKET_KEYS[table]
    (df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return table
