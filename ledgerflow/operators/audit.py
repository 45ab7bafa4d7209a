"""Typed audit rows: written as VARIANT objects, read back, undone and done again.

``audit_log`` keeps what a JSONB column keeps and plain text loses: numbers,
booleans, dates, times and nulls.  Since nothing is lost, a log and one of its two
snapshots give the other (``undo``, ``redo``).

Defined cases: a changed value that becomes or was NULL is a null in the object,
an unchanged column of an UPDATE is missing from it (``has`` tells the two apart);
an empty log leaves a snapshot as it is; log rows of other tables are passed over;
keys are unique and not null in both snapshots, as the schema declares them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_for_join
from .changes import _named_col, audit_diff

S = F.col


def audit_log(before: DataFrame, after: DataFrame, table: str, key: str = "id",
              cols: list[str] | None = None) -> DataFrame:
    """``audit_diff`` with VARIANT objects in ``old_values`` and ``new_values``."""
    return audit_diff(before, after, table, key, cols, typed=True)


def _path(name: str) -> str:
    quote = "'" if '"' in name else '"'
    return f"$[{quote}{name}{quote}]"


def has(values: str | Column, name: str) -> Column:
    """Whether an audit object holds ``name`` (a null held counts as held)."""
    return F.variant_get(_col(values), _path(name), "variant").isNotNull()


def value(values: str | Column, name: str, kind: str) -> Column:
    """One value of an audit object in the type ``kind``; NULL if null or not held."""
    return F.variant_get(_col(values), _path(name), kind)


def _col(values: str | Column) -> Column:
    return S(values) if isinstance(values, str) else values


def _replay(state: DataFrame, log: DataFrame, table: str, key: str, side: str,
            gone: str, made: str) -> DataFrame:
    """``state`` with the log's rows of ``table`` applied from their ``side`` objects.

    Rows of action ``gone`` leave, those of ``made`` come back whole, others take
    the values held.  The log is written once and measured; a small one is
    broadcast, so the table is scanned but not shuffled.
    """
    if state.schema[key].dataType.typeName() == "variant":
        raise ValueError("a key cannot be a VARIANT")
    rows = cut_for_join(log.filter(S("table_name") == F.lit(table))
                        .select(S("action").alias("__action"), S("record_id").alias("__key"),
                                S(side).alias("__values")))
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    j = state.join(rows.filter(S("__action") != F.lit(made)), S(key) == S("__key"), "left")
    kept = (j.filter(S("__action").isNull() | (S("__action") != F.lit(gone)))
            .select(*[S(x) if x == key else F.when(has("__values", x), value("__values", x, kind))
                      .otherwise(_named_col(x)).alias(x) for x, kind in kinds.items()]))
    back = (rows.filter(S("__action") == F.lit(made))
            .select(*[S("__key").cast(kind).alias(x) if x == key
                      else value("__values", x, kind).alias(x) for x, kind in kinds.items()]))
    return kept.unionByName(back)


def undo(after: DataFrame, log: DataFrame, table: str, key: str = "id") -> DataFrame:
    """The snapshot before the log's changes, from the one after them."""
    return _replay(after, log, table, key, "old_values", "INSERT", "DELETE")


def redo(before: DataFrame, log: DataFrame, table: str, key: str = "id") -> DataFrame:
    """The snapshot after the log's changes, from the one before them."""
    return _replay(before, log, table, key, "new_values", "DELETE", "INSERT")
