"""The activity feed: a UNION ALL of three recent-event sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import described, full_name, interval_ago
from .util import pg_order

FEED_COLUMNS = ["type", "description", "timestamp"]


def _recent(df: DataFrame, as_of, window: str) -> DataFrame:
    return df.filter(F.col("created_at") >= interval_ago(as_of, window))


def activity_feed(us: DataFrame, tr: DataFrame, ci: DataFrame, as_of,
                  window: str = "7 days") -> DataFrame:
    """Registrations, created returns and inquiries of the last ``window``.

    Each branch is filtered before the union (the filter reaches each scan),
    and the union is a plain concatenation: no shuffle.
    """
    users = _recent(us, as_of, window).select(
        F.lit("user_registration").alias("type"), full_name().alias("description"),
        F.col("created_at").alias("timestamp"))
    returns = _recent(tr, as_of, window).select(
        F.lit("tax_return_created").alias("type"),
        described("Tax return for ", "tax_year").alias("description"),
        F.col("created_at").alias("timestamp"))
    inquiries = _recent(ci, as_of, window).select(
        F.lit("contact_inquiry").alias("type"),
        described("Inquiry: ", "subject").alias("description"),
        F.col("created_at").alias("timestamp"))
    return users.unionByName(returns).unionByName(inquiries)


def recent_activity(us: DataFrame, tr: DataFrame, ci: DataFrame, as_of, k: int = 10
                    ) -> DataFrame:
    """The newest ``k`` feed entries (ties broken by type, then description)."""
    feed = activity_feed(us, tr, ci, as_of)
    return feed.orderBy(pg_order("timestamp", "desc"), F.col("type"),
                        F.col("description")).limit(k)
