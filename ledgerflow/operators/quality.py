"""Data quality: the declared constraints and the request rules, as jobs.

Row rules (NOT NULL, enums, ranges, lengths, formats) run as one pass per
table: every rule becomes a ``when(bad, struct(...))`` entry of an array, the
NULL entries are dropped and the rest exploded - one scan, no shuffle.
Set rules first reduce to distinct values with counts (a partial aggregate, so a
value held by a third of the rows is one partial row per task) and only then
join: foreign keys their references, unique keys fixed-width prints of the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import js_trim
from ..session import cut_for_join
from ..sources import schemas as SC
from .util import present

S = F.col

# The format rules (regex stand-ins for the validator library).
TAX_YEAR_PATTERN = r"^[0-9]{4}-[0-9]{2}$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
EMAIL_PATTERN = (r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"
                 r"(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$")
UK_MOBILE_PATTERN = r"^(\+?44|0)7[0-9]{9}$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# Request validation messages, in rule order.
MESSAGES = {
    "first_name": "First name must be between 2 and 50 characters",
    "last_name": "Last name must be between 2 and 50 characters",
    "email": "Please provide a valid email",
    "phone": "Please provide a valid UK phone number",
    "subject": "Subject must be between 5 and 255 characters",
    "message": "Message must be between 10 and 2000 characters",
    "inquiry_type": "Invalid inquiry type",
    "role": "Role must be either customer or accountant",
    "tax_year": "Tax year must be in format YYYY-YY (e.g., 2023-24)",
    "situation_type": "Invalid situation type",
    "submission_deadline": "Invalid submission deadline format",
}

# Database error class -> client message.
ERROR_CLASSES = [("unique", "23505", "Duplicate entry"),
                 ("foreign_key", "23503", "Referenced resource not found"),
                 ("not_null", "23502", "Required field missing")]

VIOLATION_COLUMNS = ["table_name", "row_key", "column_name", "rule", "value"]


def row_key(df: DataFrame) -> Column:
    """The row's id as text; child tables without an id use their parent key."""
    for k in ("id", "tax_return_id"):
        if k in df.columns:
            return S(k).cast("string")
    return F.lit(None).cast("string")


def row_violations(df: DataFrame, table: str, checks: list[tuple[str, str, Column]]
                   ) -> DataFrame:
    """Rows (table_name, row_key, column_name, rule, value) of failed checks.

    ``checks``: (column, rule, bad) where ``bad`` is true for a violation.
    """
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "table_name string, row_key string, column_name string, rule string, value string")
    entries = [F.when(F.coalesce(bad, F.lit(False)),
                      F.struct(F.lit(col).alias("column_name"), F.lit(rule).alias("rule"),
                               S(col).cast("string").alias("value")))
               for col, rule, bad in checks]
    hits = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return (df.select(F.lit(table).alias("table_name"), row_key(df).alias("row_key"),
                      F.explode(hits).alias("__v"))
            .select("table_name", "row_key", "__v.column_name", "__v.rule", "__v.value"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _each(tables: dict[str, DataFrame], make) -> DataFrame:
    """Violations of every table that has at least one rule (tables without a
    rule are not read at all)."""
    frames = [row_violations(df, name, checks) for name, df in tables.items()
              for checks in [make(name, df)] if checks]
    if not frames:
        any_df = next(iter(tables.values()))
        return row_violations(any_df, "", [])
    return _union(frames)


# -- row rules ---------------------------------------------------------------------

def dq_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    return _each(tables, lambda t, df: [(c, "not_null", S(c).isNull())
                                        for c in present(df, SC.NOT_NULL.get(t, []))])


def dq_enum(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside the allowed lists; NULL passes, as a CHECK does."""
    def make(t, df):
        return [(c, "enum", S(c).isNotNull() & ~S(c).isin(vals))
                for (tt, c), vals in SC.ENUMS.items() if tt == t and c in df.columns]
    return _each(tables, make)


def dq_rating_range(tables: dict[str, DataFrame]) -> DataFrame:
    return _each(tables, lambda t, df: [("rating", "range_1_5", ~S("rating").between(1, 5))]
                 if "rating" in df.columns and t == "reviews" else [])


AMOUNT_COLUMNS = {"tax_returns": ["total_income", "total_tax_due", "total_refund"],
                  "income_sources": ["gross_income", "tax_deducted"]}


def dq_amount_range(tables: dict[str, DataFrame]) -> DataFrame:
    return _each(tables, lambda t, df: [(c, "non_negative", S(c) < 0)
                                        for c in present(df, AMOUNT_COLUMNS.get(t, []))])


def dq_string_length(tables: dict[str, DataFrame]) -> DataFrame:
    """Request length rules (trimmed) and the DDL's VARCHAR limits."""
    def make(t, df):
        out = []
        for (tt, c), (lo, hi) in SC.REQUEST_LENGTHS.items():
            if tt == t and c in df.columns:
                n = F.length(js_trim(S(c).cast("string")))
                bad = F.lit(False)
                if lo is not None:
                    bad = bad | (n < lo)
                if hi is not None:
                    bad = bad | (n > hi)
                out.append((c, "length", bad))
        for c, limit in SC.VARCHAR.get(t, {}).items():
            if c in df.columns:
                out.append((c, f"varchar_{limit}", F.length(S(c).cast("string")) > limit))
        return out
    return _each(tables, make)


def _pattern_rule(tables, table, col, rule, pattern, transform=None):
    def make(t, df):
        if t != table or col not in df.columns:
            return []
        v = S(col).cast("string")
        v = transform(v) if transform else v
        return [(col, rule, ~v.rlike(pattern))]
    return _each(tables, make)


def dq_tax_year(tables):
    return _pattern_rule(tables, "tax_returns", "tax_year", "tax_year_format", TAX_YEAR_PATTERN)


def dq_iso_date(tables):
    return _pattern_rule(tables, "tax_returns", "submission_deadline", "iso_date",
                         ISO_DATE_PATTERN)


def dq_email(tables, table="users"):
    return _pattern_rule(tables, table, "email", "email_format", EMAIL_PATTERN,
                         lambda v: F.lower(js_trim(v)))


def dq_uk_phone(tables, table="users"):
    return _pattern_rule(tables, table, "phone", "uk_mobile", UK_MOBILE_PATTERN)


def dq_uuid(tables, table="users", col="id"):
    return _pattern_rule(tables, table, col, "uuid", UUID_PATTERN)


# -- set rules ---------------------------------------------------------------------

def _key_sets(tables: dict[str, DataFrame], keys) -> list[tuple[str, list[str]]]:
    return [(t, cols) for t, df in tables.items() for cols in keys.get(t, [])
            if all(c in df.columns for c in cols)]


def _keys_of(df: DataFrame, sets: list[tuple[int, list[str]]], values: bool) -> DataFrame:
    """(set_no, print[, value]) of every key of every row, from one scan of the table.

    ``print`` is a 64-bit hash of the key's parts.  A key with a NULL part is no key.
    """
    entries = []
    for no, cols in sets:
        parts = F.array(*[S(c).cast("string") for c in cols])
        fields = [F.lit(no).alias("set_no"), F.xxhash64(parts).alias("print")]
        if values:
            fields.append(parts.alias("value"))
        entries.append(F.when(reduce(lambda a, b: a & b, [S(c).isNotNull() for c in cols]),
                              F.struct(*fields)))
    return df.select(F.explode(F.array(*entries)).alias("k")).filter(S("k").isNotNull()).select("k.*")


def repeated_prints(tables: dict[str, DataFrame], sets: list[tuple[str, list[str]]]) -> DataFrame:
    """(set_no, print) that more than one row has.

    Each task first counts its own rows per print, so a key held by a third of
    the rows is one row per task; keys themselves are never exchanged.
    """
    prints = _union([_keys_of(df, [(n, c) for n, (t, c) in enumerate(sets) if t == name], False)
                     for name, df in tables.items() if any(t == name for t, _ in sets)])
    return (prints.groupBy("set_no", "print").agg(F.count(F.lit(1)).alias("n"))
            .filter(S("n") > 1).select("set_no", "print"))


def dq_unique(tables: dict[str, DataFrame], keys: dict[str, list[list[str]]] | None = None
              ) -> DataFrame:
    """Key values held by more than one row: (table, key_columns, key_value, n).

    Two passes, each one scan a table for all its keys.  The first counts
    fixed-width prints of the keys and keeps those that repeat.  The second
    counts the keys themselves, exactly, but only of rows whose print repeats:
    of almost unique ids hardly any row is exchanged, and two keys that share
    a print by chance are told apart.  The repeating prints are checkpointed
    and broadcast only if they measured small.
    """
    sets = _key_sets(tables, keys or SC.UNIQUE)
    again = cut_for_join(repeated_prints(tables, sets))
    frames = []
    for name, df in tables.items():
        own = [(n, c) for n, (t, c) in enumerate(sets) if t == name]
        if own:
            frames.append(_keys_of(df, own, True).join(again, ["set_no", "print"], "left_semi"))
    counts = (_union(frames).groupBy("set_no", "value").agg(F.count(F.lit(1)).alias("n"))
              .filter(S("n") > 1))

    def of_set(texts: list[str]) -> Column:
        return F.array(*[F.lit(x) for x in texts])[S("set_no")]

    return counts.select(of_set([t for t, _ in sets]).alias("table_name"),
                         of_set([",".join(c) for _, c in sets]).alias("key_columns"),
                         F.array_join("value", "|").alias("key_value"), "n")


def dq_foreign_key(tables: dict[str, DataFrame], fks=None) -> DataFrame:
    """Non-NULL references without a parent: (table, column, parent, value, n_rows).

    Each child table is read once: its reference columns are exploded to
    (column, parent, value) and reduced to distinct values with counts (a
    partial aggregate, so however skewed the references are, the join sees
    each value once).  One anti join against the ids of all parents follows.
    """
    wanted: dict[str, list[tuple[str, str]]] = {}
    for child, col, parent, _cascade in (fks or SC.FOREIGN_KEYS):
        if child in tables and parent in tables and col in tables[child].columns:
            wanted.setdefault(child, []).append((col, parent))
    refs = []
    for child, pairs in wanted.items():
        entries = [F.struct(F.lit(col).alias("column_name"), F.lit(parent).alias("parent_table"),
                            S(col).cast(tables[parent].schema["id"].dataType).cast("string")
                            .alias("value")) for col, parent in pairs]
        refs.append(tables[child].select(F.explode(F.array(*entries)).alias("r")).select("r.*")
                    .filter(S("value").isNotNull())
                    .groupBy("column_name", "parent_table", "value")
                    .agg(F.count(F.lit(1)).alias("n_rows"))
                    .withColumn("table_name", F.lit(child)))
    ids = [tables[p].select(F.lit(p).alias("__t"), S("id").cast("string").alias("__id"))
           for p in sorted({p for pairs in wanted.values() for _, p in pairs})]
    return (_union(refs).join(_union(ids), (S("parent_table") == S("__t")) & (S("value") == S("__id")),
                              "left_anti")
            .select("table_name", "column_name", "parent_table", "value", "n_rows"))


# -- request validation --------------------------------------------------------------

def _len_between(c: str, lo: int, hi: int) -> Column:
    n = F.length(js_trim(c))
    return n.between(lo, hi)


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``errors`` (messages of failed rules, in order) and ``valid``."""
    errs = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(MESSAGES[field]))
                              for field, ok in rules]), lambda e: e.isNotNull())
    return df.withColumn("errors", errs).withColumn("valid", F.size("errors") == 0)


def _optional(c: str, ok: Column) -> Column:
    return S(c).isNull() | ok


def validate_inquiries(df: DataFrame) -> DataFrame:
    """All contact-form rules; phone and inquiry type are optional."""
    rules = [("first_name", _len_between("first_name", 2, 50)),
             ("last_name", _len_between("last_name", 2, 50)),
             ("email", F.lower(js_trim("email")).rlike(EMAIL_PATTERN)),
             ("phone", _optional("phone", S("phone").rlike(UK_MOBILE_PATTERN))
              if "phone" in df.columns else F.lit(True)),
             ("subject", _len_between("subject", 5, 255)),
             ("message", _len_between("message", 10, 2000)),
             ("inquiry_type", _optional("inquiry_type", S("inquiry_type").isin(SC.INQUIRY_TYPES))
              if "inquiry_type" in df.columns else F.lit(True))]
    return validate(df, rules)


def validate_registrations(df: DataFrame) -> DataFrame:
    """Registration rules except the password ones (not kept as data)."""
    rules = [("email", F.lower(js_trim("email")).rlike(EMAIL_PATTERN)),
             ("first_name", _len_between("first_name", 2, 50)),
             ("last_name", _len_between("last_name", 2, 50)),
             ("phone", _optional("phone", S("phone").rlike(UK_MOBILE_PATTERN))
              if "phone" in df.columns else F.lit(True)),
             ("role", _optional("role", S("role").isin(SC.REGISTRATION_ROLES))
              if "role" in df.columns else F.lit(True))]
    return validate(df, rules)


def validate_returns(df: DataFrame) -> DataFrame:
    """Tax year format, situation type, optional ISO deadline."""
    rules = [("tax_year", S("tax_year").rlike(TAX_YEAR_PATTERN)),
             ("situation_type", S("situation_type").isin(SC.SITUATION_TYPES)),
             ("submission_deadline",
              _optional("submission_deadline",
                        S("submission_deadline").cast("string").rlike(ISO_DATE_PATTERN)))]
    return validate(df, rules)


def error_classes(violations: DataFrame, rule_col: str = "rule") -> DataFrame:
    """Attach the client message and SQLSTATE of each violation's class.

    The class table is three fixed rows, so it is broadcast by construction.
    """
    spark = violations.sparkSession
    classes = F.broadcast(spark.createDataFrame(ERROR_CLASSES, "rule string, sqlstate string, "
                                                               "message string"))
    return violations.join(classes.withColumnRenamed("rule", "__rule"),
                           S(rule_col) == S("__rule"), "left").drop("__rule")


def class_counts(counts: DataFrame, rule_col: str = "rule") -> DataFrame:
    """Every error class with its message and the number of violations (0
    when none); ``counts`` holds (rule, violations)."""
    spark = counts.sparkSession
    classes = spark.createDataFrame(ERROR_CLASSES, "rule string, sqlstate string, message string")
    c = counts.select(S(rule_col).alias("__rule"), S("violations"))
    return (classes.join(c, S("rule") == S("__rule"), "left")
            .select("rule", "sqlstate", "message",
                    F.coalesce(S("violations"), F.lit(0)).cast("long").alias("violations")))
