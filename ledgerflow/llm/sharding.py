"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a key (hash of the text, then the id), so equal texts stand
together.  The splitters between shards are found without sorting: each round
counts, across all partitions, the exact bytes below evenly spaced candidate
boundaries of the intervals that still hold a splitter, and goes on with the
interval between the two candidates around each target.  A splitter is settled
once a candidate lies within the tolerance of its target, or when the interval
cannot be cut further.  Boundaries fall between different texts; only where one
text's copies alone outweigh the tolerance is the id used to cut among them.
Then rows move once, range-partitioned by shard and key, and get their places
from per-partition counts.

The driver sees only histograms: at most ``PROBES`` counts per open splitter and
round.  The law is ``bytes``: shard sizes are near equal.

Size is the text's UTF-8 bytes plus 1 (null: none plus 1).  Null texts hash like
empty ones, null ids come first among equal texts.  Rows equal in text and id
are cut, where their bytes outweigh the tolerance, by a hash of their place in
the stored table.  An empty table gives an empty result.  Column names are
compared as Spark does, without case; where one of the table's is the name of a
result or of a key, the carried columns come as a struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import materialize

PROBE_BITS = 10
PROBES = 1 << PROBE_BITS
TOLERANCE = 0.002  # of a shard's target bytes
ROWS_PER_PARTITION = 1_000_000
_FLIP = -(1 << 63)


def size_of(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def keys_of(text, ident) -> tuple[F.Column, F.Column]:
    """Sort keys as signed 64-bit integers: of the text, and of the id among equal texts."""
    first = F.xxhash64(F.coalesce(text, F.lit("")))
    second = F.coalesce(ident.cast("bigint"), F.lit(_FLIP).cast("bigint"))
    return first, second


def _unsigned_top(col: str, bits: int) -> str:
    """SQL: the first ``bits`` bits of a signed key, in its order."""
    if not bits:
        return "0L"
    return f"shiftrightunsigned({col} ^ {_FLIP + 1}L ^ 1L, {64 - bits})"


def _search(rows: DataFrame, key: str, targets: dict, tolerance: float) -> dict:
    """Splitters on one key.

    ``targets`` maps a splitter to (filter value or None, bytes wanted below
    it).  Returns per splitter (prefix, bits, bytes below): rows whose first
    ``bits`` bits of the key are below the prefix lie below it; bytes below is
    exact.  ``missed`` tells those whose key is used up.
    """
    open_ = {s: (0, 0, 0) for s in targets}  # prefix, bits, bytes below the prefix
    settled = {}
    while open_:
        bits = next(iter(open_.values()))[1]
        wider = min(64, bits + PROBE_BITS)
        ranges = {p for p, _, _ in open_.values()}
        top = F.expr(_unsigned_top(key, bits))
        here = rows.filter(top.isin([F.lit(p).cast("bigint") for p in ranges]) if bits else F.lit(True))
        got = (here.groupBy(F.expr(_unsigned_top(key, wider)).alias("probe"))
               .agg(F.sum("size").alias("bytes")).collect())
        hist: dict = {}
        for r in got:
            hist.setdefault((r["probe"] & ((1 << 64) - 1)) >> (wider - bits), []).append(
                (r["probe"] & ((1 << 64) - 1), r["bytes"]))
        still = {}
        for s, (prefix, _, below) in open_.items():
            want = targets[s]
            for probe, size in sorted(hist.get(prefix & ((1 << 64) - 1), [])):
                lo, hi = below, below + size
                if abs(lo - want) <= tolerance:
                    settled[s] = (probe, wider, lo, True)
                    break
                if abs(hi - want) <= tolerance or hi == want:
                    settled[s] = (probe + 1, wider, hi, True)
                    break
                if hi > want:
                    if wider == 64:
                        settled[s] = (probe, 64, lo, False)
                    else:
                        still[s] = (probe - (1 << 64) if probe >> 63 else probe, wider, lo)
                    break
                below = hi
            else:
                settled[s] = ((prefix & ((1 << 64) - 1)) + 1 << (wider - bits), wider, below, True)
        open_ = still
    return settled


def _signed(probe: int) -> int:
    """The key that a 64-bit prefix stands for."""
    signed = probe ^ (1 << 63)
    return signed - (1 << 64) if signed >> 63 else signed


def splitters(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Boundaries of a table (k1, k2, k3, size): a first key, and a second and third where needed.

    Keys are unsigned integers in the order of the signed ones; a row is below
    a boundary if its keys, as many as the boundary has, come before it.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = {s: total * s / n_shards for s in range(1, n_shards)}
    slack = tolerance * total / n_shards
    out = {}
    for s, (probe, bits, below, met) in _search(rows, "k1", targets, slack).items():
        if met:
            out[s] = (probe << (64 - bits),)
            continue
        # the copies of one text outweigh the tolerance: cut among them by id, then by place
        copies, want, keys = rows.filter(F.col("k1") == F.lit(_signed(probe))), targets[s] - below, [probe]
        for key in ("k2", "k3"):
            at, used, below, met = _search(copies, key, {s: want}, slack)[s]
            keys.append(at << (64 - used))
            if met:
                break
            copies, want = copies.filter(F.col(key) == F.lit(_signed(at))), want - below
        out[s] = tuple(keys)
    return [out[s] for s in sorted(out)]


def shard_of(bounds: list[tuple[int, ...]]) -> F.Column:
    """Column: number of boundaries at or below a row's keys k1, k2, k3."""
    def reached(bound: tuple[int, ...], names: tuple[str, ...]) -> F.Column:
        if bound[0] >> 64:  # above every key
            return F.lit(False)
        key, at = F.col(names[0]), F.lit(bound[0] + _FLIP).cast("bigint")
        if len(bound) == 1:
            return key >= at
        return (key > at) | ((key == at) & reached(bound[1:], names[1:]))

    out = F.lit(0)
    for bound in bounds:
        out = out + reached(bound, ("k1", "k2", "k3")).cast("int")
    return out


def shard(df: DataFrame, text_col: str, id_col: str, n_shards: int = 8,
          tolerance: float = TOLERANCE, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) of ``df`` with size, shard and slot.

    ``slot`` counts the rows of a shard from 0 in key order.  Only the columns
    carried are moved.
    """
    carry = df.columns if carry is None else carry
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    k1, k2 = keys_of(text, ident)
    if {"k1", "k2", "k3", "size", "row_at", "part", "n", "first", "before", "shard", "slot"} & {c.lower() for c in df.columns}:
        df = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       k1.alias("k1"), k2.alias("k2"), size_of(text).alias("size"))
        back = [F.col("row")]
    else:
        df = df.select(*[F.col(f"`{c}`") for c in carry], k1.alias("k1"), k2.alias("k2"), size_of(text).alias("size"))
        back = [F.col(f"`{c}`") for c in carry]
    # places in the checkpoint stay the same in every job and retry
    rows = materialize(df).withColumn("k3", F.xxhash64(F.monotonically_increasing_id()))
    narrow = rows.select("k1", "k2", "k3", "size")
    bounds = splitters(narrow, n_shards, tolerance)
    rows = rows.withColumn("shard", shard_of(bounds))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
            rows.count() // ROWS_PER_PARTITION)
    # the one exchange; the checkpoint fixes each row's place
    moved = materialize(rows.repartitionByRange(n, "shard", "k1", "k2")
                        .sortWithinPartitions("shard", "k1", "k2")
                        .withColumn("row_at", F.monotonically_increasing_id()))
    moved = moved.withColumn("part", F.shiftright("row_at", 33))
    counts = moved.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("row_at").alias("first"))
    # one row per partition and shard in it: offsets of each piece in its shard
    offsets = _running(counts)
    return (moved.join(F.broadcast(offsets), ["part", "shard"])
            .select(*back, "size", "shard", (F.col("row_at") - F.col("first") + F.col("before")).alias("slot")))


def _running(counts: DataFrame) -> DataFrame:
    """Rows of the same shard in earlier partitions (a few rows per partition)."""
    from pyspark.sql import Window

    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
