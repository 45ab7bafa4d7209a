"""Registry of named queries: a Spark job and, where SQL can say it, an oracle.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the stand-in views of
the driver tables.  The oracle is DuckDB SQL over the driver's views, written
independently of the Spark job, with the same output column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.standins import Domain, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _compose(views: tuple[str, ...], body: str) -> str:
    """Prefix the stand-in views; a body with its own WITH joins the same list."""
    if not views:
        return body
    head = with_views(*views)
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE" + head.strip()[4:] + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return head.rstrip() + ",\n" + body[4:].lstrip()
    return head + body


def register(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``views`` are the stand-ins the oracle body uses."""
    def deco(fn: Callable[[Domain], DataFrame]) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Domain(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = _compose(views, oracle.strip())
        return run
    return deco
