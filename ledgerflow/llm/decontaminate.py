"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask: the token positions it keeps are hashed, the others are
ignored, so a changed word in a gap does not hide a hit.  The seeds of the test
items are joined with those of the training texts (a hash join on the map side,
behind a bit table of the test seeds), and around every hit the text is laid
against the item along that diagonal: there must be a stretch of ``MIN_TOKENS``
tokens or more (of the whole item, if shorter) of which four fifths or more are
equal.  The stretch reported is the one in which equal tokens are furthest
above that share.

Any substitution in a six-token item and any three in a fifteen-token one leave
a hit of some mask.  Tokens are lower-cased runs of letters and digits.

Test items are a stated query set: they are taken in blocks of about
``BLOCK_CHARS`` characters, each broadcast in turn against all training texts,
whole, in one pass without an exchange; a passage that a third of the texts
share costs each text its own check only.

Null or empty texts and items have no tokens and match nothing; items of fewer
than five tokens, the weight of a seed, take no part.  Items with a null id are
reported with a null id.  Repeated items are reported each; repeated texts are
judged alike.  Columns are appended under names of the caller's choice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import chunks, flat_index, ship, word_hashes

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 2, 3, 4, 5), (0, 1, 3, 5, 6))
WEIGHT = 5
MIN_TOKENS = 13
LOSS = 4  # of a substitution; equal tokens gain 1, so four fifths are level
BLOCK_CHARS = 16_000_000
_TABLE_BITS = (12, 24)  # of the bit table of a mask: least and most

_WORD: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _WORD:
        _WORD.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _WORD[0]


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.lower() if t else t for t in texts], _letters())


def seeds(tok: np.ndarray, owner: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a mask at every place where it lies within one text, and the places."""
    span = mask[-1] + 1
    n = len(tok) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(n, salt, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in mask:
            h = h * np.uint64(0x9E3779B97F4A7C15) + tok[k:k + n]
            h ^= h >> np.uint64(29)
    at = np.flatnonzero(owner[:n] == owner[span - 1:])
    return h[at], at


class Index:
    """Seeds and tokens of a block of test items."""

    def __init__(self, ids: list, texts: list):
        tok, counts = tokens(texts)
        self.ids = ids
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.tok = tok
        owner = np.repeat(np.arange(len(ids)), counts)
        self.masks = []
        for salt, mask in enumerate(MASKS):
            h, at = seeds(tok, owner, mask, salt + 1)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            bits = min(max((32 * len(h)).bit_length(), _TABLE_BITS[0]), _TABLE_BITS[1])
            shift = np.uint64(64 - bits)
            table = np.zeros(1 << bits, dtype=bool)
            table[h >> shift] = True
            self.masks.append((mask, salt + 1, h, at, owner[at], table, shift))

    def matches(self, texts: list) -> list[list[tuple]]:
        """Per text: (item, first token, end token, equal tokens) of every verified overlap."""
        tok, counts = tokens(texts)
        end = np.cumsum(counts)
        start = end - counts
        owner = np.repeat(np.arange(len(texts)), counts)
        cand = []
        for mask, salt, h, at, item, table, shift in self.masks:
            g, place = seeds(tok, owner, mask, salt)
            maybe = table[g >> shift]
            g, place = g[maybe], place[maybe]
            lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
            lens = hi - lo
            hit = lens > 0
            if hit.any():
                k = np.repeat(place[hit], lens[hit])
                q = flat_index(lo[hit], lens[hit])
                d = owner[k]
                diag = (k - start[d]) - (at[q] - self.start[item[q]])
                cand.append(np.stack([d, item[q], diag], axis=1))
        out: list[list[tuple]] = [[] for _ in texts]
        if cand:
            for d, i, diag in np.unique(np.concatenate(cand), axis=0).tolist():
                m = self._overlap(tok[start[d]:end[d]], self.tok[self.start[i]:self.end[i]], diag)
                if m:
                    out[d].append((self.ids[i], *m))
        return out

    @staticmethod
    def _overlap(text: np.ndarray, item: np.ndarray, diag: int) -> tuple[int, int, int] | None:
        """The best long enough stretch of one diagonal, if any is like enough."""
        lo, hi = max(0, -diag), min(len(item), len(text) - diag)
        least = min(MIN_TOKENS, len(item))
        if hi - lo < least:
            return None
        same = text[lo + diag:hi + diag] == item[lo:hi]
        total = np.r_[0, np.cumsum(np.where(same, 1, -LOSS))]
        # the lowest total before each end, at least ``least`` tokens back
        gain = total[least:] - np.minimum.accumulate(total[:len(total) - least])
        b = int(np.argmax(gain))
        if gain[b] < 0:
            return None
        a = int(np.argmin(total[:b + 1]))
        b += least
        return lo + diag + a, lo + diag + b, int(same[a:b].sum())


MATCH = "array<struct<item_id:bigint,start:int,end:int,equal:int>>"
_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("equal", pa.int32())]))
_INDEX: dict = {}


def _worker_index(key: str, sent) -> Index:
    """This worker's index of a block (kept between its tasks)."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(*sent.value)
    return _INDEX[key]


def _column(text: F.Column, sent, key: str) -> F.Column:
    @F.arrow_udf(MATCH)
    def found(texts: pa.Array) -> pa.Array:
        index, t, out = _worker_index(key, sent), texts.to_pylist(), []
        for lo, hi in chunks(t):
            out += index.matches(t[lo:hi])
        return pa.array([[dict(zip(("item_id", "start", "end", "equal"), m)) for m in x] for x in out], _TYPE)

    return found(text)


def matches_column(df: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str,
                   block_chars: int = BLOCK_CHARS) -> F.Column:
    """Column: all verified overlaps of each whole text with the test items."""
    spark = df.sparkSession
    ship(spark)
    own = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("t")).filter("t is not null")
    size = own.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_chars))
    parts = []
    for n in range(blocks):
        block = own.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == n) if blocks > 1 else own
        ids, texts = [], []
        for r in block.toLocalIterator():
            ids.append(r["id"])
            texts.append(r["t"])
        sent = spark.sparkContext.broadcast((ids, texts))
        parts.append(_column(F.col(f"`{text_col}`"), sent, f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"))
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))
