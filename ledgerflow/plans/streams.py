"""Named queries: the streaming jobs run on batch input (same functions)."""

from __future__ import annotations

from ..sources.standins import Domain
from ..streaming import anchored as AN
from ..streaming import rates as RT
from .registry import register

BUCKET = "TIME_BUCKET(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01')"


@register("request_rate_breaches", views=("request_log",), oracle=f"""
SELECT client, {BUCKET} AS window_start, {BUCKET} + INTERVAL '15 minutes' AS window_end,
  COUNT(*) AS requests
FROM request_log GROUP BY client, {BUCKET} HAVING COUNT(*) > 1""")
def request_rate_breaches(d: Domain):
    """More than one request per client and 15 minutes (the test data holds at
    most three per window, so the server's 100 would report nothing)."""
    return RT.rate_breaches(d.request_log, max_requests=1)


@register("auth_failure_breaches", views=("request_log",), oracle=f"""
SELECT client, {BUCKET} AS window_start, {BUCKET} + INTERVAL '15 minutes' AS window_end,
  COUNT(*) AS requests
FROM request_log WHERE status >= 400 GROUP BY client, {BUCKET} HAVING COUNT(*) > 1""")
def auth_failure_breaches(d: Domain):
    """More than one failed request per client and 15 minutes."""
    return RT.auth_failure_breaches(d.request_log, max_failures=1)


@register("request_rate_limit_100", views=("request_log",), oracle=f"""
SELECT client, {BUCKET} AS window_start, {BUCKET} + INTERVAL '15 minutes' AS window_end,
  COUNT(*) AS requests
FROM request_log GROUP BY client, {BUCKET} HAVING COUNT(*) > 100""")
def request_rate_limit_100(d: Domain):
    """The server's own limit: more than 100 requests per 15 minutes."""
    return RT.rate_breaches(d.request_log)


@register("activity_stream", views=("users", "tax_returns", "contact_inquiries"), oracle="""
SELECT 'user_registration' AS type, CONCAT(first_name, ' ', last_name) AS description,
  created_at AS timestamp FROM users
UNION ALL SELECT 'tax_return_created', CONCAT('Tax return for ', tax_year), created_at FROM tax_returns
UNION ALL SELECT 'contact_inquiry', CONCAT('Inquiry: ', subject), created_at FROM contact_inquiries""")
def activity_stream(d: Domain):
    """The live union of the three activity sources, run over whole tables."""
    return RT.activity_stream(d.users, d.tax_returns, d.inquiries)


def _anchored_sql(counted: str, limit: int) -> str:
    """Windows by recursion: each starts at the first request after the one before."""
    return f"""
WITH RECURSIVE windows AS (
  SELECT client, MIN(ts) AS start FROM request_log GROUP BY client
  UNION ALL
  SELECT w.client, MIN(r.ts) FROM windows w JOIN request_log r
    ON r.client = w.client AND r.ts >= w.start + INTERVAL '15 minutes'
  GROUP BY w.client)
SELECT w.client, w.start AS window_start, w.start + INTERVAL '15 minutes' AS window_end,
  COUNT(*) AS requests
FROM windows w JOIN request_log r ON r.client = w.client AND r.ts >= w.start
  AND r.ts < w.start + INTERVAL '15 minutes'
WHERE {counted} GROUP BY w.client, w.start HAVING COUNT(*) > {limit}"""


@register("request_rate_anchored", views=("request_log",), oracle=_anchored_sql("TRUE", 1))
def request_rate_anchored(d: Domain):
    """More than one request in 15 minutes that begin at a client's own request."""
    return AN.anchored_breaches(d.request_log, max_requests=1)


@register("auth_failure_anchored", views=("request_log",), oracle=_anchored_sql("r.status >= 400", 0))
def auth_failure_anchored(d: Domain):
    """Windows as the limiter opens them (by any request) that hold a failed one."""
    return AN.anchored_auth_breaches(d.request_log, max_failures=0)


@register("request_windows_36h", views=("request_log",), oracle="""
WITH RECURSIVE windows AS (
  SELECT client, MIN(ts) AS start FROM request_log GROUP BY client
  UNION ALL
  SELECT w.client, MIN(r.ts) FROM windows w JOIN request_log r
    ON r.client = w.client AND r.ts >= w.start + INTERVAL '36 hours'
  GROUP BY w.client)
SELECT w.client, w.start AS window_start, w.start + INTERVAL '36 hours' AS window_end,
  COUNT(*) AS requests
FROM windows w JOIN request_log r ON r.client = w.client AND r.ts >= w.start
  AND r.ts < w.start + INTERVAL '36 hours'
GROUP BY w.client, w.start""")
def request_windows_36h(d: Domain):
    """Every window of 36 hours: long unbroken chains of windows, all clients."""
    return AN.anchored_windows(d.request_log, seconds=36 * 3600)
