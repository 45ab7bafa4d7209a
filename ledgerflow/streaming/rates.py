"""Request-rate monitors and the live activity union (Structured Streaming).

One function serves both modes: on a batch DataFrame the watermark is a
no-op and the result is the full answer; on a streaming DataFrame the same
plan runs incrementally with a watermark bounding the window state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import described, full_name

S = F.col

# The server's limits (requests per window per client).
GENERAL_LIMIT = 100
AUTH_FAILURE_LIMIT = 5
WINDOW = "15 minutes"
WATERMARK = "1 hour"


def rate_breaches(requests: DataFrame, window: str = WINDOW, max_requests: int = GENERAL_LIMIT,
                  watermark: str = WATERMARK, ts_col: str = "ts", client_col: str = "client",
                  min_status: int | None = None) -> DataFrame:
    """Clients with more than ``max_requests`` requests in a tumbling window.

    Windows are aligned to the epoch.  Event time is cast to TIMESTAMP (the
    watermark needs it) and window bounds are returned as TIMESTAMP_NTZ.
    ``min_status`` keeps only failed requests (status >= it).  The count is a
    partial aggregate per (window, client), so a client sending a third of
    all traffic is still one partial row per task.
    """
    df = requests
    if min_status is not None:
        df = df.filter(S("status") >= F.lit(min_status))
    df = df.select(S(client_col).alias("client"), S(ts_col).cast("timestamp").alias("__ts"))
    df = df.withWatermark("__ts", watermark)
    counts = (df.groupBy(F.window("__ts", window).alias("w"), S("client"))
              .agg(F.count(F.lit(1)).alias("requests")))
    return counts.filter(S("requests") > F.lit(max_requests)).select(
        "client", S("w.start").cast("timestamp_ntz").alias("window_start"),
        S("w.end").cast("timestamp_ntz").alias("window_end"), "requests")


def auth_failure_breaches(requests: DataFrame, window: str = WINDOW,
                          max_failures: int = AUTH_FAILURE_LIMIT, watermark: str = WATERMARK,
                          ts_col: str = "ts", client_col: str = "client") -> DataFrame:
    """More than ``max_failures`` failed (status >= 400) requests per window;
    successful requests are not counted, as the auth limiter skips them."""
    return rate_breaches(requests, window, max_failures, watermark, ts_col, client_col,
                         min_status=400)


def activity_stream(us: DataFrame, tr: DataFrame, ci: DataFrame) -> DataFrame:
    """Registrations, new returns and inquiries as one (type, description,
    timestamp) stream: a union, no state, no shuffle."""
    return (us.select(F.lit("user_registration").alias("type"), full_name().alias("description"),
                      S("created_at").alias("timestamp"))
            .unionByName(tr.select(F.lit("tax_return_created").alias("type"),
                                   described("Tax return for ", "tax_year").alias("description"),
                                   S("created_at").alias("timestamp")))
            .unionByName(ci.select(F.lit("contact_inquiry").alias("type"),
                                   described("Inquiry: ", "subject").alias("description"),
                                   S("created_at").alias("timestamp"))))


def start_monitor(stream: DataFrame, sink_path: str, checkpoint: str, trigger: dict | None = None):
    """Write a breach stream to parquet in append mode (closed windows only).

    The checkpoint folder must be on shared storage; the query restarts from
    it after a failure with exactly-once output to the file sink.
    """
    w = (stream.writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint))
    w = w.trigger(**(trigger or {"processingTime": "1 minute"}))
    return w.start()
