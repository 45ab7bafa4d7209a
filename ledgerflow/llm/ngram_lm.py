"""Stupid-backoff language-model scores, computed relationally.

The n-gram tables (counts of words and word pairs over all texts) are
partitioned by hash and joined to the texts' own n-grams; the scores are summed
per document.  Rows of single n-grams would weigh several times the text, so
both sides travel packed:

1. ``chunk`` rows hold some whole documents: the distinct word hashes of the
   chunk and the documents as positions in that list.  They are written once.
2. Each chunk hands its distinct n-grams (sorted hashes with the chunk's own
   counts, delta-packed) to the hash buckets they fall in: the exploded n-grams,
   already summed per chunk, so a frequent n-gram is one entry per chunk.
3. A bucket adds up its part of the count table and joins it back to the chunks'
   entries; the totals go back to the chunks.
4. A chunk joined with its totals scores its documents and sums per document.

Scores leave a document's own n-grams out of the counts (else every pair would
have been seen): with c the counts in all other documents and N their words,

    S(w | v) = c(v w) / c(v)                if c(v w) > 0
             = 0.4 * max(c(w), 0.4) / N     otherwise

and the first word of a document is scored by the second line without its 0.4.
N is at least 1.  ``log_score`` is the sum of natural logarithms; a document
without words has 0.

Words are runs without white space (blank, tab to carriage return), as they
are.  Null and empty texts have no words.  Repeated rows are documents of their
own.  A null id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import materialize, mix64, ship, word_hashes

ALPHA = 0.4
CHUNK_WORDS = 1_500_000
BUCKET_KEYS = 1_000_000
_CODEC = "zstd"

_WORD: list[np.ndarray] = []


def _spaceless() -> np.ndarray:
    if not _WORD:
        t = np.ones(0x110000, dtype=bool)
        t[[32, *range(9, 14)]] = False
        _WORD.append(t)
    return _WORD[0]


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(v * np.uint64(0x9E3779B97F4A7C15) + mix64(w ^ np.uint64(0x5851F42D4C957F2D)))


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes (the planes of small numbers vanish)."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def unpack(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec=_CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


_CHUNK = "chunk bigint, n_docs int, n_words bigint, n_keys int, keys binary, docs binary, ids binary, missing binary, words binary"


def _to_chunks(batches):
    """Documents to chunk rows of about CHUNK_WORDS words."""
    docs: list = []

    def row():
        ids = np.concatenate([d[0] for d in docs])
        missing = np.concatenate([d[1] for d in docs])
        counts = np.concatenate([d[2] for d in docs])
        h = np.concatenate([d[3] for d in docs])
        keys, at = np.unique(h, return_inverse=True)
        # a name for the chunk that a repeated attempt gives again
        with np.errstate(over="ignore"):
            name = mix64(np.array([np.bitwise_xor.reduce(mix64(ids.view(np.uint64) + mix64(counts.astype(np.uint64) + np.arange(len(ids), dtype=np.uint64))))]))
        return {"chunk": int(name.view(np.int64)[0]), "n_docs": len(ids), "n_words": len(h), "n_keys": len(keys),
                "keys": pack(np.diff(keys, prepend=np.uint64(0))), "docs": pack(counts.astype(np.int64)),
                "ids": pack(ids), "missing": pack(missing), "words": pack(at.astype(np.uint32))}

    def flush():
        r = row()
        docs.clear()
        return pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, v), t in zip(r.items(), (
            pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5))})

    words = 0
    for b in batches:
        ids, texts = b.column("id"), b.column("t").to_pylist()
        missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        ids = ids.fill_null(0).to_numpy()
        lo, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size < 2_000_000 and i + 1 < len(texts):
                continue
            h, counts = word_hashes(texts[lo:i + 1], _spaceless())
            docs.append((ids[lo:i + 1], missing[lo:i + 1], counts, h))
            words += len(h)
            lo, size = i + 1, 0
            if words >= CHUNK_WORDS:
                yield flush()
                words = 0
    if docs:
        yield flush()


def _rows(batch: pa.RecordBatch):
    """Rows one at a time: a chunk is large, and a batch may hold several."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class _Chunk:
    """A chunk row unpacked, with its distinct pairs."""

    def __init__(self, r: dict):
        n_docs, n = r["n_docs"], r["n_words"]
        self.keys = np.cumsum(unpack(r["keys"], r["n_keys"], np.uint64), dtype=np.uint64)
        self.counts = unpack(r["docs"], n_docs, np.int64)
        self.ids = unpack(r["ids"], n_docs, np.int64)
        self.missing = unpack(r["missing"], n_docs, np.uint8) > 0
        self.words = unpack(r["words"], n, np.uint32).astype(np.int64)
        self.owner = np.repeat(np.arange(n_docs), self.counts)
        follows = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1 if n else np.empty(0, np.int64)
        self.follows = follows  # words with one before them in their document
        h = pair_hash(self.keys[self.words[follows - 1]], self.keys[self.words[follows]]) if len(follows) else np.empty(0, np.uint64)
        self.pairs, self.pair_at = np.unique(h, return_inverse=True)
        # both kinds in one key space, kept apart by the last bit
        self.all = np.concatenate([self.keys & ~np.uint64(1), self.pairs | np.uint64(1)])
        n_word = np.bincount(self.words, minlength=len(self.keys))
        n_pair = np.bincount(self.pair_at, minlength=len(self.pairs))
        self.own = np.concatenate([n_word, n_pair]).astype(np.uint32)


def _bucket_edges(n: int) -> np.ndarray:
    """First hash of each of ``n`` equal ranges (all but the first)."""
    return np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)


_SENT = "bucket int, chunk bigint, n int, keys binary, counts binary"


def _to_buckets(n_buckets: int):
    def run(batches):
        edges = _bucket_edges(n_buckets)
        for b in batches:
            for r in _rows(b):
                c = _Chunk(r)
                order = np.argsort(c.all, kind="stable")
                keys, own = c.all[order], c.own[order]
                cut = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                out = {k: [] for k in ("bucket", "chunk", "n", "keys", "counts")}
                for k in range(n_buckets):
                    lo, hi = cut[k], cut[k + 1]
                    if hi > lo:
                        out["bucket"].append(k)
                        out["chunk"].append(r["chunk"])
                        out["n"].append(int(hi - lo))
                        out["keys"].append(pack(np.diff(keys[lo:hi], prepend=np.uint64(0))))
                        out["counts"].append(pack(own[lo:hi]))
                if out["n"]:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (
                        pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))})

    return run


_TOTALS = "chunk bigint, bucket int, n int, totals binary"


def _count(table: pa.Table) -> pa.Table:
    """A bucket's part of the count table, joined back to the chunks' entries."""
    rows = table.to_pylist()
    keys = np.concatenate([np.cumsum(unpack(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
    counts = np.concatenate([unpack(r["counts"], r["n"], np.uint32) for r in rows])
    _, at = np.unique(keys, return_inverse=True)
    del keys
    totals = np.bincount(at, weights=counts).astype(np.int64)[at]  # exact below 2^53
    end = np.cumsum([r["n"] for r in rows])
    return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                     "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                     "n": pa.array([r["n"] for r in rows], pa.int32()),
                     "totals": pa.array([pack(totals[e - r["n"]:e]) for e, r in zip(end, rows)], pa.binary())})


def _within(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each entry's code comes in its own document."""
    if not len(codes):
        return np.empty(0, np.int64)
    key = owner.astype(np.int64) * (int(codes.max()) + 1) + codes
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at]


def _score(total_words: int):
    def run(batches):
        for b in batches:
            for r in _rows(b):
                c = _Chunk(r)
                order = np.argsort(c.all, kind="stable")
                parts = sorted(r["parts"], key=lambda p: p["bucket"])
                got = np.concatenate([unpack(p["totals"], p["n"], np.int64) for p in parts]) if parts else np.empty(0, np.int64)
                totals = np.empty(len(order), dtype=np.int64)
                totals[order] = got
                n_word = totals[:len(c.keys)][c.words] - _within(c.words, c.owner)
                n_pair = totals[len(c.keys):][c.pair_at] - _within(c.pair_at, c.owner[c.follows])
                rest = np.maximum(total_words - c.counts, 1)[c.owner].astype(np.float64)
                s = np.maximum(n_word, ALPHA) / rest
                back = ALPHA * s[c.follows]
                before = n_word[c.follows - 1] if len(c.follows) else np.empty(0)
                s[c.follows] = np.where(n_pair > 0, n_pair / np.maximum(before, 1), back)
                total = np.bincount(c.owner, weights=np.log(s), minlength=len(c.counts)).astype(np.float64)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(c.ids, pa.int64(), mask=c.missing), "n_words": pa.array(c.counts),
                    "log_score": pa.array(total)})

    return run


def score(df: DataFrame, id_col: str, text_col: str, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(id, n_words, log_score) of every document of ``df``."""
    spark = df.sparkSession
    ship(spark)
    chunks = materialize(df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("t"))
                         .mapInArrow(_to_chunks, _CHUNK))
    seen = chunks.agg(F.sum("n_words").alias("words"), F.count_distinct("chunk").alias("names"),
                      F.count(F.lit(1)).alias("chunks")).first()
    words = seen["words"] or 0
    if seen["names"] != seen["chunks"]:  # equal chunks (repeated tables): number them apart
        chunks = materialize(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    # distinct n-grams are at most two per word; a bucket gets about bucket_keys of them
    n_buckets = max(1, min(2 ** 31 - 1, -(-2 * words // bucket_keys)))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    totals = (chunks.mapInArrow(_to_buckets(n_buckets), _SENT)
              .repartition(max(n_parts, min(n_buckets, 100_000)), "bucket")
              .groupBy("bucket").applyInArrow(_count, _TOTALS))
    parts = totals.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "totals")).alias("parts"))
    both = chunks.join(parts, "chunk", "left").withColumn("parts", F.coalesce("parts", F.array()))
    return both.mapInArrow(_score(words), "id bigint, n_words bigint, log_score double")
