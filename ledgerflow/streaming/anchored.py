"""Request limits whose windows open at a client's own request, batch and live.

The limiter keeps a window per client: the first request opens it, it holds for
a fixed length, and the first request at or after its end opens the next.  Where
a window starts therefore depends on every window before it, unlike the
epoch-aligned windows of :mod:`rates`.

Batch (:func:`anchored_windows`): every request time points at the first request
at or after the end of a window opened there.  The pointers are found inside
groups of one client and one window length of time, and resolved by pointer
jumping, so a client that sends a third of all requests is spread over its times.
Live (:func:`monitor_anchored`): the same fold by ``transformWithState``, with an
event-time timer that closes a window.

Defined cases: requests without a time take no part; requests without a client
are those of one client (NULL); requests of one client at one time share a
window, repeated rows count each; no requests give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import store
from .rates import AUTH_FAILURE_LIMIT, GENERAL_LIMIT, WATERMARK

S = F.col

# Fixed value: the length of the server's windows.
WINDOW_SECONDS = 15 * 60
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _micros(ts_col: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), S(ts_col).cast("timestamp_ntz"))


def _time(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH)).cast("timestamp_ntz")


def _block(t: Column, length: int) -> Column:
    """The start of the block of ``length`` that holds ``t``."""
    return t - F.pmod(t, F.lit(length))


def _join(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Equi-join that takes NULL clients for one client; ``right`` brings other names."""
    cond = F.lit(True)
    for a, b in on.items():
        cond = cond & S(a).eqNullSafe(S(b))
    return left.join(right, cond, how).drop(*on.values())


def _points(times: DataFrame, length: int) -> DataFrame:
    """``times`` (client, t, hits) with their block ``b``, ``sure`` and ``next``.

    ``sure``: the client was silent for a whole window before, so a window opens
    here whatever came earlier.  ``next``: the first time at or after ``t`` +
    ``length``, as a struct of its time and its own ``sure``; null at the end.
    """
    at = times.withColumn("b", _block(S("t"), length))
    # one row a client and block: bounded by the time span, not by the requests
    by_block = Window.partitionBy("client").orderBy("b")
    blocks = (at.groupBy("client", "b").agg(F.min("t").alias("first"), F.max("t").alias("last"))
              .withColumn("before", F.lag("last").over(by_block))
              .withColumn("sure_first", F.coalesce(S("first") - S("before") >= F.lit(length), F.lit(True)))
              .withColumn("head", F.struct(S("first").alias("t"), S("sure_first").alias("sure")))
              .withColumn("b1", F.lead("b").over(by_block))
              .withColumn("later", F.when(S("b1") == S("b") + F.lit(length), F.lead("head", 2).over(by_block))
                          .otherwise(F.lead("head").over(by_block)))
              .select(S("client").alias("bc"), S("b").alias("bb"), "before", "later"))
    in_block = Window.partitionBy("client", "b").orderBy("t")
    rows = (_join(at, blocks, {"client": "bc", "b": "bb"})
            .withColumn("prev", F.coalesce(F.lag("t").over(in_block), S("before")))
            .withColumn("sure", F.coalesce(S("t") - S("prev") >= F.lit(length), F.lit(True))))
    # A window opened at t ends at the same place of the next block: ask there.
    # Walking a block backwards, the smallest time so far is the answer.
    data = rows.select("client", "b", S("t").alias("q"), F.lit(1).alias("kind"), "hits", "later",
                       F.struct("t", "sure").alias("here"))
    asks = rows.select("client", (S("b") + F.lit(length)).alias("b"), (S("t") + F.lit(length)).alias("q"),
                       F.lit(0).alias("kind"), "hits", "later",
                       F.lit(None).cast("struct<t:bigint,sure:boolean>").alias("here"),
                       S("sure").alias("asker"))
    back = (Window.partitionBy("client", "b").orderBy(S("q").desc(), S("kind").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (data.withColumn("asker", F.lit(None).cast("boolean")).unionByName(asks)
            .withColumn("found", F.min("here").over(back)).filter(S("kind") == 0)
            .select("client", (S("q") - F.lit(length)).alias("t"), "hits", S("asker").alias("sure"),
                    F.coalesce("found", "later").alias("next")))


def _starts(points: DataFrame) -> DataFrame:
    """(client, t) of every window start: what the sure starts reach by ``next``.

    Round k marks what lies up to 2^k windows after a sure start and doubles the
    pointers; pointers to a sure start are needless, so the rounds are the
    logarithm of the longest unbroken stretch in windows (at most 16 a year).
    """
    marks = points.filter(S("sure")).select("client", "t")
    jumps = store(points.filter(S("next").isNotNull() & ~S("next.sure"))
                  .select("client", "t", S("next.t").alias("to")))
    while not jumps.isEmpty():
        hop = jumps.select(S("client").alias("jc"), S("t").alias("jt"), "to")
        reached = _join(marks, hop, {"client": "jc", "t": "jt"}).select("client", S("to").alias("t"))
        marks = store(marks.unionByName(reached))
        far = jumps.select(S("client").alias("jc"), S("t").alias("jt"), S("to").alias("far"))
        jumps = store(_join(jumps, far, {"client": "jc", "to": "jt"})
                      .select("client", "t", S("far").alias("to")))
    return marks


def anchored_windows(requests: DataFrame, counted: Column | None = None, seconds: int = WINDOW_SECONDS,
                     ts_col: str = "ts", client_col: str = "client") -> DataFrame:
    """Every window of every client: (client, window_start, window_end, requests).

    ``counted`` says which requests count (default: all); a window opens at any
    request, as the limiter does before it knows how a request ends.  Runs Spark
    jobs while it is built (the jumps end when no pointer is left).
    """
    length = seconds * 1_000_000
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    times = (requests.filter(S(ts_col).isNotNull())
             .select(S(client_col).alias("client"), _micros(ts_col).alias("t"),
                     counted.cast("long").alias("hit"))
             .groupBy("client", "t").agg(F.sum("hit").alias("hits")))
    points = store(_points(times, length))
    starts = _starts(points)
    # starts lie a window apart, so a block holds one at most, and a request
    # belongs to the start of its own block or of the block before
    own = starts.select("client", _block(S("t"), length).alias("b"), S("t").alias("here"),
                        F.lit(None).cast("long").alias("ago"))
    prior = own.select("client", (S("b") + F.lit(length)).alias("b"), F.lit(None).cast("long").alias("here"),
                       S("here").alias("ago"))
    around = (own.unionByName(prior).groupBy("client", "b")
              .agg(F.max("here").alias("here"), F.max("ago").alias("ago"))
              .select(S("client").alias("sc"), S("b").alias("sb"), "here", "ago"))
    placed = _join(points.select("client", "t", "hits", _block(S("t"), length).alias("b")), around,
                   {"client": "sc", "b": "sb"})
    start = F.when(S("here") <= S("t"), S("here")).otherwise(S("ago"))
    return (placed.groupBy("client", start.alias("start")).agg(F.sum("hits").alias("requests"))
            .select("client", _time(S("start")).alias("window_start"),
                    _time(S("start") + F.lit(length)).alias("window_end"), "requests"))


def anchored_breaches(requests: DataFrame, max_requests: int = GENERAL_LIMIT, **kw) -> DataFrame:
    """Windows of :func:`anchored_windows` with more than ``max_requests`` requests."""
    return anchored_windows(requests, **kw).filter(S("requests") > F.lit(max_requests))


def anchored_auth_breaches(requests: DataFrame, max_failures: int = AUTH_FAILURE_LIMIT, **kw) -> DataFrame:
    """More than ``max_failures`` failed requests (status >= 400) in a client's window;
    a successful request may open the window but is not counted."""
    return anchored_breaches(requests, max_failures, counted=S("status") >= F.lit(400), **kw)


class WindowFold(StatefulProcessor):
    """A client's requests folded into windows in order of their times.

    State: request times not yet passed by the watermark with their counts (a
    map, so it is bounded by the watermark's delay), and the open window.  A
    timer at the watermark's next point of interest folds what is then final;
    a window is emitted once, when the watermark passes its end.
    """

    def __init__(self, length: int, max_requests: int):
        self.length, self.max_requests = length, max_requests

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "t bigint", "hits bigint")
        self.open = handle.getValueState("open", "start bigint, hits bigint")

    def _fold(self, client, mark: int) -> Iterator[pd.DataFrame]:
        """Fold every pending time below ``mark`` (microseconds) and set the next timer."""
        length, closed = self.length, []
        start, hits = self.open.get() if self.open.exists() else (None, 0)
        times = sorted((int(k[0]), int(v[0])) for k, v in self.pending.iterator())
        for t, n in times:
            if t >= mark:
                break
            if start is None or t >= start + length:
                if start is not None:
                    closed.append((start, hits))
                start, hits = t, 0
            hits += n
            self.pending.removeKey((t,))
        if start is not None and start + length <= mark:
            closed.append((start, hits))
            start = None
        left = [t for t, _ in times if t >= mark]
        if start is None:
            self.open.clear()
        else:
            self.open.update((start, hits))
            left.append(start + length)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            # timers are in milliseconds and fire once the watermark passes them
            self.handle.registerTimer(max(min(left), mark) // 1000 + 1)
        over = [(s, n) for s, n in closed if n > self.max_requests]
        if over:
            yield pd.DataFrame({"client": [client] * len(over), "start": [s for s, _ in over],
                                "requests": [n for _, n in over]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            for t, n in part.groupby("t")["hit"].sum().items():
                had = self.pending.getValue((int(t),)) if self.pending.containsKey((int(t),)) else (0,)
                self.pending.updateValue((int(t),), (int(had[0]) + int(n),))
        yield from self._fold(key[0], mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def monitor_anchored(requests: DataFrame, max_requests: int = GENERAL_LIMIT, counted: Column | None = None,
                     seconds: int = WINDOW_SECONDS, watermark: str = WATERMARK, ts_col: str = "ts",
                     client_col: str = "client") -> DataFrame:
    """The live form of :func:`anchored_breaches`: append mode, each window once closed.

    Requests may come out of order within ``watermark``; later ones are dropped
    by the stream, as everywhere.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    length = seconds * 1_000_000
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    client = requests.schema[client_col].dataType.simpleString()
    df = (requests.filter(S(ts_col).isNotNull())
          .select(S(client_col).alias("client"), S(ts_col).cast("timestamp").alias("at"),
                  _micros(ts_col).alias("t"), counted.cast("long").alias("hit"))
          .withWatermark("at", watermark))
    folded = df.groupBy("client").transformWithStateInPandas(
        WindowFold(length, max_requests), f"client {client}, start bigint, requests bigint",
        "append", "eventTime")
    return folded.select("client", _time(S("start")).alias("window_start"),
                         _time(S("start") + F.lit(length)).alias("window_end"), "requests")
