"""Exact top-k by inner product: tiles of queries and shards.

Queries are taken in blocks of bounded bytes.  A block is broadcast and every
task multiplies it with its shard of the candidates, tile by tile, keeping the
best ``k`` of each query after each tile.  Each task hands on one packed list
per query; lists are merged as a tree, ``FAN_IN`` at a time, until one is left.
The blocks follow one another, so neither the driver nor a task ever holds more
than one block of queries.

Products are exact: integer vectors are multiplied as doubles when no sum can
reach 2^53, as 64-bit integers when none can reach 2^63, else as integers of any
length; a score or a component that 64 bits cannot hold raises an error.

Vectors that are null, hold null or non-finite components, or have no id take
no part.  Vectors meet only those of equal length.  Every row is a candidate of
its own, and every query row gets a list of its own, so repeated rows repeat in
the result; rows with the query's id are its own and no candidates.  Ties go to
the smaller id.  With fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import materialize, ship

K = 20
BLOCK_BYTES = 32 << 20
TILE = 4_096
FAN_IN = 16
_LISTS = "query bigint, query_id bigint, part bigint, ids binary, scores binary"
_SCHEMA = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("part", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])


def quantized(vec, factor: int = 64):
    """floor(factor * x) per component as doubles; null for vectors that take no part.

    A component past 64 bits raises an error.
    """
    def whole(x):
        y = F.floor(x.cast("double") * factor)
        return F.when(F.abs(x.cast("double") * factor) < 2.0 ** 63, y).otherwise(
            F.raise_error(F.lit("a component does not fit in 64 bits")).cast("bigint"))

    q = F.transform(vec, whole)
    good = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(good, q)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, by score, then smaller id."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= cut
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top < 2 ** 63:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    if exact.size and max(exact.max(), -exact.min()) >= 2 ** 63:
        raise OverflowError("a score does not fit in 64 bits")
    return exact.astype(np.int64)


def _tiles(sent, k: int):
    """mapInArrow over a shard of candidates: the shard's best lists of a block."""
    def run(batches):
        blocks = {dim: (np.array(ids), np.frombuffer(raw, dtype=np.int64).reshape(len(ids), dim))
                  for dim, (_, ids, raw) in sent.value.items()}
        best = {dim: (np.full((len(ids), k), np.iinfo(np.int64).min), np.full((len(ids), k), -1))
                for dim, (ids, _) in blocks.items()}
        filled = {dim: np.zeros((len(ids), k), dtype=bool) for dim, (ids, _) in blocks.items()}
        part = None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py() if part is None else part
            ids = b.column("id").to_numpy()
            vec = b.column("q")
            flat, at = vec.values.to_numpy(), vec.offsets.to_numpy()
            lens = np.diff(at)
            for dim in np.unique(lens):
                if int(dim) not in blocks:
                    continue
                rows = np.flatnonzero(lens == dim)
                c = flat[(at[rows][:, None] + np.arange(dim))].reshape(len(rows), dim)
                qid, q = blocks[int(dim)]
                s0, i0 = best[int(dim)]
                f0 = filled[int(dim)]
                for lo in range(0, len(rows), TILE):
                    ci = ids[rows[lo:lo + TILE]]
                    for qlo in range(0, len(qid), TILE):
                        sl = slice(qlo, min(qlo + TILE, len(qid)))
                        s = np.concatenate([s0[sl], _product(q[sl], c[lo:lo + TILE])], axis=1)
                        i = np.concatenate([i0[sl], np.broadcast_to(ci, (s.shape[0], len(ci)))], axis=1)
                        ok = np.concatenate([f0[sl], np.broadcast_to(True, (s.shape[0], len(ci)))], axis=1)
                        ok &= i != qid[sl][:, None]
                        s = np.where(ok, s, np.iinfo(np.int64).min)
                        # partial selection, then exact order among all that tie with the last
                        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                        row, col = np.nonzero((s >= cut) & ok)
                        order = np.lexsort((i[row, col], -s[row, col], row))
                        row, col = row[order], col[order]
                        place = np.arange(len(row)) - np.searchsorted(row, row)
                        row, col, place = row[place < k], col[place < k], place[place < k]
                        s0[qlo + row, place], i0[qlo + row, place] = s[row, col], i[row, col]
                        f0[qlo + row, place] = True
        out = {"query": [], "query_id": [], "part": [], "ids": [], "scores": []}
        for dim, (qid, _) in blocks.items():
            s0, i0 = best[dim]
            for r, q in enumerate(sent.value[dim][0]):
                f = filled[dim][r]
                if f.any():
                    out["query"].append(q)
                    out["query_id"].append(int(qid[r]))
                    out["part"].append(part)
                    out["ids"].append(i0[r][f].tobytes())
                    out["scores"].append(s0[r][f].tobytes())
        if out["query_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return run


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """Merge the lists of each (query, part) into one: the union's best k."""
    @F.arrow_udf("struct<ids:binary,scores:binary>")
    def merged(ids: pa.Array, scores: pa.Array) -> pa.Array:
        oi, os_ = [], []
        for a, b in zip(ids.to_pylist(), scores.to_pylist()):
            s, i = _best(np.frombuffer(b"".join(b), dtype=np.int64), np.frombuffer(b"".join(a), dtype=np.int64), k)
            oi.append(i.tobytes())
            os_.append(s.tobytes())
        return pa.StructArray.from_arrays([pa.array(oi, pa.binary()), pa.array(os_, pa.binary())], ["ids", "scores"])

    got = (lists.groupBy("query", "query_id", "part")  # FAN_IN lists of k entries at most
           .agg(F.collect_list(F.struct("ids", "scores")).alias("l")))
    return (got.withColumn("m", merged(F.col("l")["ids"], F.col("l")["scores"]))
            .select("query", "query_id", "part", "m.ids", "m.scores"))


def search(vectors: DataFrame, id_col: str, vec: F.Column, is_query: F.Column, k: int = K,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score) for every row of ``vectors`` that ``is_query`` marks.

    ``vec`` is an integer vector column, null where a row takes no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.alias("q"),
                           F.coalesce(is_query, F.lit(False)).alias("is_query"))
            .filter("id is not null and q is not null")
            .withColumn("query", F.monotonically_increasing_id()))
    rows = materialize(rows)  # fixes the rows' numbers, too
    size = rows.filter("is_query").agg(F.sum(F.size("q") * 8 + 8).alias("b")).first()["b"] or 0
    n_blocks = max(1, math.ceil(size / block_bytes * 1.25)) if size > block_bytes else 1
    numbered = rows.filter("is_query").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks)))
    parts = rows.rdd.getNumPartitions()
    shards = rows.select("id", "q", F.spark_partition_id().cast("bigint").alias("part"))
    found = []
    for n in range(n_blocks):
        block: dict = {}
        for r in numbered.filter(F.col("block") == n).select("query", "id", "q").toLocalIterator():
            queries, ids, qs = block.setdefault(len(r["q"]), ([], [], []))
            queries.append(r["query"])
            ids.append(r["id"])
            qs.append(np.array(r["q"], dtype=np.int64))
        sent = spark.sparkContext.broadcast(
            {d: (queries, ids, np.concatenate(qs).tobytes() if d else b"") for d, (queries, ids, qs) in block.items()})
        lists = shards.mapInArrow(_tiles(sent, k), _LISTS)
        width = parts
        while True:  # tree of merges
            lists = _merge(lists.withColumn("part", F.floor(F.col("part") / FAN_IN)), k)
            width = math.ceil(width / FAN_IN)
            if width <= 1:
                break
        if n_blocks > 1:
            lists = materialize(lists)
            sent.unpersist()
        found.append(lists)
    return _unpacked(reduce(DataFrame.unionByName, found))


def _unpacked(lists: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            ids = [np.frombuffer(x, dtype=np.int64) for x in b.column("ids").to_pylist()]
            scores = [np.frombuffer(x, dtype=np.int64) for x in b.column("scores").to_pylist()]
            lens = [len(x) for x in ids]
            if not ids:
                continue
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.repeat(b.column("query_id").to_numpy(), lens)),
                "rank": pa.array(np.concatenate([np.arange(1, n + 1) for n in lens]), pa.int32()),
                "id": pa.array(np.concatenate(ids)), "score": pa.array(np.concatenate(scores))})

    return lists.select("query_id", "ids", "scores").mapInArrow(rows, "query_id bigint, rank int, id bigint, score bigint")
