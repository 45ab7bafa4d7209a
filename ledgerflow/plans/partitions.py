"""Named queries: a change job written back to the partitions it changes, no others."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import changes as C
from ..session import scratch_folder
from ..sources import partitions as P
from ..sources.standins import AS_OF_RETURNS, Domain
from .changes import STATUS_HIT, _status_changes, updated_sql
from .registry import register

S = F.col


def _stored(d: Domain) -> str:
    """The returns as a stored table of this run, partitioned by tax year."""
    base = f"{scratch_folder(d.spark)}/{uuid.uuid4().hex}"
    rows = d.tax_returns.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    P.write_keyed(rows, base, "tax_year", "id")
    return base


def _apply(d: Domain, base: str) -> P.Rewritten:
    batch = _status_changes(d)
    return P.rewrite(d.spark, base, "tax_year", "id", batch,
                     lambda rows: C.set_status(rows, batch, AS_OF_RETURNS))


@register("write_back_status", views=("tax_returns",),
          oracle=updated_sql("tax_returns", STATUS_HIT, {"status": "'completed'"}))
def write_back_status(d: Domain):
    """The stored returns after the status batch was written back."""
    base = _stored(d)
    _apply(d, base)
    return P.read_keyed(d.spark, base)


@register("write_back_partitions", views=("tax_returns",), oracle=f"""
SELECT tax_year, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {STATUS_HIT}) AS n_changed,
  COUNT(*) FILTER (WHERE {STATUS_HIT}) > 0 AS rewritten
FROM tax_returns t GROUP BY tax_year""")
def write_back_partitions(d: Domain):
    """Per tax year: rows, rows changed, and whether its files are new ones."""
    base = _stored(d)

    def files():
        return (P.read_keyed(d.spark, base).select("tax_year", S("_metadata.file_path").alias("file"))
                .distinct())

    before = files().checkpoint(eager=True)
    _apply(d, base)
    gone = before.join(files().select("file"), "file", "left_anti").select("tax_year").distinct()
    rows = (P.read_keyed(d.spark, base).groupBy("tax_year")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("updated_at").alias("n_changed")))
    return (rows.join(gone.withColumn("new", F.lit(True)), "tax_year", "left")
            .select("tax_year", "n_rows", "n_changed", F.coalesce("new", F.lit(False)).alias("rewritten")))
