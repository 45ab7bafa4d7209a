"""Reading the practice tables with their declared schemas, and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLES


def load(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One table as parquet with its declared schema (no inference).

    Column pruning and filters reach the scan; a table written partitioned
    (``tax_year=.../``) is pruned by directory as well.
    """
    return spark.read.schema(TABLES[name]).parquet(f"{base_dir.rstrip('/')}/{name}")


def load_all(spark: SparkSession, base_dir: str, names=None) -> dict[str, DataFrame]:
    return {n: load(spark, base_dir, n) for n in (names or TABLES)}


def load_jdbc(spark: SparkSession, url: str, table: str, partition_col: str | None = None,
              bounds: tuple[int, int] | None = None, num_partitions: int = 64,
              properties: dict | None = None, id_prefixes: str | None = None) -> DataFrame:
    """Read an operational database table over JDBC, split into parallel ranges.

    ``id_prefixes``: a UUID column to split by its first two hex digits (256
    tasks).  With a numeric ``partition_col`` and its bounds the read is split
    by ranges.  Without either it is a single task, for small tables only.
    """
    props = dict(properties or {})
    if id_prefixes:
        edges = [f"{n:02x}" for n in range(256)]
        parts = [f"{id_prefixes} >= '{a}'" + (f" AND {id_prefixes} < '{b}'" if b else "")
                 for a, b in zip(edges, [*edges[1:], None])]
        parts[0] = f"({id_prefixes} < '01' OR {id_prefixes} IS NULL)"
        return spark.read.jdbc(url, table, predicates=parts, properties=props)
    if partition_col and bounds:
        return spark.read.jdbc(url, table, column=partition_col, lowerBound=bounds[0],
                               upperBound=bounds[1], numPartitions=num_partitions,
                               properties=props)
    return spark.read.jdbc(url, table, properties=props)


def register_views(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = ""
                   ) -> dict[str, str]:
    """Temp views for the given tables plus the declared summary view.

    Returns logical name -> view name.  The summary view is the DataFrame job
    of ``return_summary``, so reading it by name plans the same joins.
    """
    from ..operators.joins import return_summary

    names = {}
    for n, df in tables.items():
        df.createOrReplaceTempView(prefix + n)
        names[n] = prefix + n
    if all(k in tables for k in ("tax_returns", "customers", "users", "accountants")):
        summary = return_summary(tables["tax_returns"], tables["customers"], tables["users"],
                                 tables["accountants"])
        summary.createOrReplaceTempView(prefix + "tax_return_summary")
        names["tax_return_summary"] = prefix + "tax_return_summary"
    return names
