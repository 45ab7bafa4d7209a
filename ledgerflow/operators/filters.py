"""Projections, filters and predicates of the listings and lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ilike_any, ts_lit
from .util import camel, pg_order, present

# A filter value meaning "no filter": JS falsy values in the models, 'all' in
# the routes.
NO_FILTER = (None, "", "all")

# Largest key list we inline as an IN list; bigger lists become a semi join.
MAX_INLINE_KEYS = 1000


def _skipped(v, skip) -> bool:
    for s in skip:
        if s is None and v is None:
            return True
        if isinstance(s, str) and isinstance(v, str) and v == s:
            return True
    return False


def _active(filters: dict | None, skip=NO_FILTER) -> dict:
    return {k: v for k, v in (filters or {}).items() if not _skipped(v, skip)}


def filter_eq(df: DataFrame, filters: dict | None, skip=NO_FILTER) -> DataFrame:
    """AND of ``col = value`` for every filter whose value is not "no filter".

    One ``filter`` with a folded predicate, so Catalyst pushes all of it to
    the parquet scan at once.
    """
    active = _active(filters, skip)
    if not active:
        return df
    return df.filter(reduce(and_, [F.col(k) == F.lit(v) for k, v in active.items()]))


def filter_model(df: DataFrame, filters: dict | None) -> DataFrame:
    """The models' rule: a falsy value means no filter, but a flag filters also when False."""
    flags = {c for c, t in df.dtypes if t == "boolean"}
    return filter_eq(df, {k: v for k, v in (filters or {}).items()
                          if v or (v is False and k in flags)}, skip=(None,))


def filter_users(df: DataFrame, role=None, is_verified=None) -> DataFrame:
    """Role / verification filters of the user listing.

    ``is_verified`` arrives as the query-string text; anything but 'true'
    compares as false, as the route does.
    """
    conds = {}
    if role not in NO_FILTER:
        conds["role"] = role
    out = filter_eq(df, conds)
    if is_verified not in NO_FILTER:
        out = out.filter(F.col("is_verified") == F.lit(str(is_verified) == "true"))
    return out


def search(df: DataFrame, cols, text: str | None) -> DataFrame:
    """Case-insensitive substring match over ``cols`` (OR); no text, no filter."""
    if not text:
        return df
    return df.filter(ilike_any(list(cols), text))


def lookup(df: DataFrame, col: str, keys) -> DataFrame:
    """Rows whose ``col`` equals a key.

    ``keys`` is one value, a short list (inlined as IN), or a DataFrame of
    keys (semi join; the planner or AQE broadcasts it when it is small).
    """
    if isinstance(keys, DataFrame):
        key_col = keys.columns[0]
        # a semi join takes each row once however often its key is listed
        return df.join(keys.select(F.col(key_col).alias("__k")), F.col(col) == F.col("__k"), "left_semi")
    if isinstance(keys, (list, tuple, set)):
        keys = list(keys)
        if len(keys) > MAX_INLINE_KEYS:
            kdf = df.sparkSession.createDataFrame([(k,) for k in keys], ["__k"])
            return lookup(df, col, kdf)
        return df.filter(F.col(col).isin(keys))
    return df.filter(F.col(col) == F.lit(keys))


def by_owner(df: DataFrame, owner_col: str, owner_id, filters: dict | None = None,
             limit: int | None = None, order_col: str = "created_at") -> DataFrame:
    """An owner's rows, optional filters, newest first, optional limit."""
    out = filter_model(df.filter(F.col(owner_col) == F.lit(owner_id)), filters)
    order = [pg_order(order_col, "desc")] + ([F.col("id").asc()] if "id" in df.columns else [])
    out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def not_expired(df: DataFrame, col: str, as_of) -> DataFrame:
    """Rows whose expiry lies after ``as_of``; a NULL expiry drops out."""
    return df.filter(F.col(col) > ts_lit(as_of))


def active(df: DataFrame, col: str = "is_active") -> DataFrame:
    """Rows where the flag is true (NULL drops out, as in WHERE)."""
    return df.filter(F.col(col) == F.lit(True))


PUBLIC_USER_COLUMNS = ["id", "email", "first_name", "last_name", "phone", "role",
                       "is_verified", "last_login", "created_at", "updated_at"]

PUBLIC_RETURN_COLUMNS = ["id", "customer_id", "accountant_id", "tax_year", "status",
                         "situation_type", "total_income", "total_tax_due", "total_refund",
                         "submission_deadline", "filed_date", "hmrc_reference", "notes",
                         "price", "payment_status", "created_at", "updated_at"]

ADMIN_USER_COLUMNS = ["id", "email", "first_name", "last_name", "phone", "role",
                      "is_verified", "last_login", "created_at"]

SECRET_USER_COLUMNS = ["password_hash", "verification_token", "reset_password_token",
                       "reset_password_expires"]


def public_view(df: DataFrame, cols) -> DataFrame:
    """Project to ``cols`` (those present) renamed to camelCase."""
    return df.select(*[F.col(x).alias(camel(x)) for x in present(df, cols)])


def public_user(df: DataFrame) -> DataFrame:
    """A user without password hash and tokens, in camelCase."""
    return public_view(df, PUBLIC_USER_COLUMNS)


def public_return(df: DataFrame) -> DataFrame:
    """All return columns in camelCase."""
    return public_view(df, PUBLIC_RETURN_COLUMNS)


def select_cols(df: DataFrame, cols) -> DataFrame:
    return df.select(*present(df, cols))


def settings(df: DataFrame) -> DataFrame:
    """Settings with their public flag, ordered by key."""
    return (df.select("setting_key", "setting_value", "description", "is_public")
            .orderBy("setting_key"))
