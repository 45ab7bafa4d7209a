"""Named queries over stored lists: a deep page, and lookups by key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_folder
from ..sources import indexed as IX
from ..sources.standins import Domain
from .registry import register

LOOKED_UP = [1, 7, 32, 999, 14999, 2_000_000_000]


def _base(d: Domain) -> str:
    return f"{scratch_folder(d.spark)}/{uuid.uuid4().hex}"


@register("page_returns_indexed", views=("tax_returns",), oracle="""
SELECT * EXCLUDE (place, total) FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY filed_date DESC NULLS FIRST, id) AS place, COUNT(*) OVER () AS total
  FROM tax_returns)
WHERE place BETWEEN (total // 40) * 20 + 1 AND (total // 40) * 20 + 20""")
def page_returns_indexed(d: Domain):
    """The page in the middle of all returns by filing date, from the stored list."""
    base = _base(d)
    IX.write_pages(d.tax_returns, base, "filed_date", "DESC", chunks=32)
    total = d.spark.read.parquet(f"{base}/index").agg(F.sum("n")).first()[0] or 0
    return IX.read_page(d.spark, base, "filed_date", "DESC", total // 40 + 1, 20)


@register("lookup_returns_indexed", views=("tax_returns",), oracle=f"""
SELECT * FROM tax_returns WHERE id IN ({", ".join(map(str, LOOKED_UP))})""")
def lookup_returns_indexed(d: Domain):
    """A few returns by id, from the table stored for lookups (one id is unknown)."""
    path = _base(d)
    IX.write_lookup(d.tax_returns, path, "id", files=16)
    return IX.lookup_keys(d.spark.read.schema(d.tax_returns.schema).parquet(path), "id", LOOKED_UP)
