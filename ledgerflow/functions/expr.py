"""Column expressions shared by the jobs.

They reproduce the relational database's rules where Spark differs
(NULL-skipping CONCAT, counting only true CASE branches) and give time
arithmetic that works on TIMESTAMP_NTZ.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

MICROS_PER_DAY = 86_400_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0


def c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- strings -----------------------------------------------------------------

def pg_concat(*parts: ColumnOrName) -> Column:
    """CONCAT that skips NULL parts (Spark's ``concat`` returns NULL).

    ``concat_ws`` is no substitute: it also drops the separator, so an
    unassigned accountant would give ``''`` instead of ``' '``.
    """
    return F.concat(*[F.coalesce(c(p).cast("string"), F.lit("")) for p in parts])


def full_name(first: ColumnOrName = "first_name", last: ColumnOrName = "last_name") -> Column:
    """``CONCAT(first, ' ', last)`` with NULL parts as empty strings."""
    return pg_concat(first, F.lit(" "), last)


def described(prefix: str, value: ColumnOrName) -> Column:
    """``CONCAT('<prefix>', value)`` as in the activity feed."""
    return pg_concat(F.lit(prefix), value)


# Fixed value: the whitespace the request validators trim (JS String.trim,
# ASCII part).
TRIM_PATTERN = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def js_trim(text: ColumnOrName) -> Column:
    """Strip leading / trailing whitespace of every kind (not only blanks)."""
    return F.regexp_replace(c(text), TRIM_PATTERN, "")


def topic_slug(text: ColumnOrName) -> Column:
    """Lower-case and turn every whitespace run into one ``-``."""
    return F.regexp_replace(F.lower(c(text)), r"\s+", "-")


def file_ext(name: ColumnOrName) -> Column:
    """Last suffix of the file's base name, lower-cased, without the dot.

    A leading dot alone (``.env``) is no suffix; ``a.`` gives ``''``.
    """
    base = F.regexp_extract(c(name), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))


def epoch_text(as_of) -> str:
    """Epoch seconds of a UTC wall-clock time, with 6 decimals as the database
    prints ``EXTRACT(EPOCH FROM ...)``.  Computed once on the driver, so the
    session time zone cannot shift it."""
    if not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime.fromisoformat(str(as_of))
    delta = as_of.replace(tzinfo=None) - _dt.datetime(1970, 1, 1)
    micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return f"{micros // 1_000_000}.{micros % 1_000_000:06d}"


def deleted_email(email: ColumnOrName, as_of) -> Column:
    """``email || '_deleted_' || <epoch seconds of as_of>``."""
    return pg_concat(email, F.lit("_deleted_" + epoch_text(as_of)))


def stable_uuid(*parts: ColumnOrName) -> Column:
    """A UUID-shaped id derived from the row's natural key (md5 of the parts).

    Unlike ``uuid()``, it is the same in every job and every task retry, so
    a new user and the profile row that points at it always agree, and a
    recomputed partition produces the same ids.
    """
    # NULL and the empty string are different parts
    said = [F.coalesce(F.concat(F.lit("="), c(p).cast("string")), F.lit("")) for p in parts]
    h = F.md5(F.concat_ws("\u0001", *said))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def ilike_any(cols: list[ColumnOrName], text: str) -> Column:
    """Case-insensitive ``%text%`` over several columns, OR-ed.

    The text is not escaped: ``%`` and ``_`` keep their wildcard meaning.
    """
    pattern = f"%{text}%"
    return reduce(or_, [c(x).ilike(pattern) for x in cols])


# -- conditional aggregates ----------------------------------------------------

def count_where(cond: Column) -> Column:
    """``COUNT(CASE WHEN cond THEN 1 END)``: counts rows where cond is true."""
    return F.count(F.when(cond, F.lit(1)))


def sum_where(value: ColumnOrName, cond: Column) -> Column:
    return F.sum(F.when(cond, c(value)))


def avg_where(value: ColumnOrName, cond: Column) -> Column:
    return F.avg(F.when(cond, c(value)))


def money(x: Column) -> Column:
    """Sums of money as DECIMAL(18,2) (same type in every engine we compare)."""
    return x.cast("decimal(18,2)")


def avg6(x: Column) -> Column:
    """Averages as double rounded to 6 places (engines differ past that)."""
    return F.round(x.cast("double"), 6)


# -- time --------------------------------------------------------------------

def ts_lit(as_of) -> Column:
    """A TIMESTAMP_NTZ literal from a string or naive datetime."""
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(as_of, _dt.date):
        as_of = as_of.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def interval_ago(as_of, spec: str) -> Column:
    """``as_of - INTERVAL '<spec>'`` (e.g. '7 days', '12 months').

    Month arithmetic clamps to the month end as the database does.
    """
    n, unit = spec.split()
    unit = unit.upper().rstrip("S")
    return ts_lit(as_of) - F.expr(f"INTERVAL '{int(n)}' {unit}")


def midnight_ago(as_of, spec: str) -> Column:
    """``CURRENT_DATE - INTERVAL '<spec>'``: the window starts at midnight."""
    day = ts_lit(as_of).cast("date").cast("timestamp_ntz")
    n, unit = spec.split()
    unit = unit.upper().rstrip("S")
    return day - F.expr(f"INTERVAL '{int(n)}' {unit}")


def elapsed_micros(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return _tsdiff(c(earlier), c(later))


def _tsdiff(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def elapsed_days(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """``EXTRACT(EPOCH FROM later - earlier) / 86400``."""
    return _tsdiff(c(earlier), c(later)) / F.lit(MICROS_PER_DAY)


def elapsed_hours(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """``EXTRACT(EPOCH FROM later - earlier) / 3600``."""
    return _tsdiff(c(earlier), c(later)) / F.lit(MICROS_PER_HOUR)


def trunc_to_date(unit: str, ts: ColumnOrName) -> Column:
    """``DATE_TRUNC(unit, ts)`` returned as a date."""
    return F.date_trunc(unit, c(ts)).cast("date")


def ceil_div(total: ColumnOrName, size: int) -> Column:
    """``Math.ceil(total / size)``; size 0 means no paging (one page)."""
    if not size:
        return F.when(c(total) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.ceil(c(total) / F.lit(size)).cast("long")
