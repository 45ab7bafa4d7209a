"""Periodic runs of words, found by an online sparse diagonal recurrence.

A match of word i with an earlier occurrence i-q lies on the diagonal of lag q.
Along a diagonal the match length grows by one for each matching word and falls
to zero at the first that differs; a diagonal that ends after at least
``max(min_length - q, (min_exponent - 1) * q)`` matches gives the run of period
q that it spans together with the q words before it.

What keeps the recurrence sparse, with the same result:

- lags below ``DENSE`` are followed at every word;
- a run of period q holds two further repetitions, so it meets every grid of
  step s <= q at least ``min_exponent - 1`` times in a row.  Lags of
  ``[s, 2s)`` are therefore only opened at every s-th word, from that word's
  earlier occurrences at such a distance, and only those that match again at
  the next grid points are followed word by word.  That is at most one opening
  per word and doubling of the lag, however often a word occurs;
- a lag that is a multiple of the period of a run around both words adds
  nothing (its diagonal is that run again) and is not followed.

A stretch is reported once, with its smallest period.

Each text is worked on whole, in the task that reads it; no rows move.  Nulls
and corner cases: a null, empty or blank text has no words and no runs; repeated
rows give the same result each; words are compared as they are (no folding of
case); very long texts take memory in proportion to their own words; an empty
table gives an empty table; other columns are not read, so their names are free.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import CHUNK_CHARS, chunks, flat_index, ship

MIN_LENGTH = 6
MIN_EXPONENT = 4
DENSE = 16

REPORT = "struct<n:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _segments(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last index of the stretches of True of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].view(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    long = hi - lo >= least
    return lo[long], hi[long]


def _reach(keys: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """First and one-past-last word of the diagonal of lag q around word i."""
    hi, step, n = i + 1, 64, len(keys)
    while hi < n:
        end = min(n, hi + step)
        differ = np.flatnonzero(keys[hi:end] != keys[hi - q:end - q])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = end, step * 2
    lo, step = i, 64
    while lo > q:
        begin = max(q, lo - step)
        differ = np.flatnonzero(keys[begin:lo] != keys[begin - q:lo - q])
        if len(differ):
            lo = begin + int(differ[-1]) + 1
            break
        lo, step = begin, step * 2
    return lo, hi


def find_runs(keys: np.ndarray, longest: int, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``keys``, by start, then period.

    ``keys`` numbers the words of one or more texts, equal where text and word
    are; ``longest`` is the number of words of the longest text.
    ``min_exponent`` is 3 or more.
    """
    n, e = len(keys), min_exponent
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last_lag = longest // e
    for q in range(1, min(DENSE, last_lag + 1)):
        lo, hi = _segments(keys[q:] == keys[:-q], max(min_length - q, (e - 1) * q, 1))
        found.append((lo, hi - lo + q, np.full(len(lo), q)))  # the words before the first match belong to it
    if last_lag >= DENSE:
        around, period = np.full(n, n, dtype=np.int64), np.ones(n, dtype=np.int64)
        start, length, q = _smallest(found)
        for k in np.argsort(length, kind="stable"):  # of runs that overlap, the longest is noted
            around[start[k]:start[k] + length[k]], period[start[k]:start[k] + length[k]] = start[k], q[k]
        order = np.argsort(keys, kind="stable")
        places = keys[order] * n + order  # occurrences of a word side by side, in order
        more = []
        s = DENSE
        while s <= last_lag:
            i, q = _opened(keys, places, s, around, period, e)
            more += _followed(keys, i, q, last_lag, around, period, min_length, e)
            s *= 2
        if more:
            found.append(tuple(np.array(x, dtype=np.int64) for x in zip(*more)))
    start, length, period = _smallest(found)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _smallest(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with the smallest of its lags."""
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]
    return start[first], length[first], period[first]


def _opened(keys, places, s: int, around, period, e: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) on the grid of step s whose diagonal matches at the next grid points too."""
    n = len(keys)
    grid = np.arange(s, n - (e - 2) * s, s, dtype=np.int64)
    if not len(grid):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    base = keys[grid] * n
    lo = np.searchsorted(places, base + np.maximum(grid - 2 * s + 1, 0))
    hi = np.searchsorted(places, base + (grid - s), "right")
    size = np.maximum(hi - lo, 0)
    i = np.repeat(grid, size)
    q = i - (places[flat_index(lo, size)] - np.repeat(base, size))
    known = (i - q >= around[i]) & (q % period[i] == 0)
    i, q = i[~known], q[~known]
    for t in [k * s for k in range(1, e - 1)] + [1, 2, 3, s // 2, s + 1, s - 1, s // 4, s + s // 3, 5, 7, 11, 13]:
        if not len(i):
            break
        on = keys[i + t] == keys[i + t - q]
        i, q = i[on], q[on]
    return i, q


def _followed(keys, i, q, last_lag, around, period, min_length, e) -> list[tuple[int, int, int]]:
    """Runs of the opened diagonals, each followed to both of its ends once."""
    out = []
    order = np.lexsort((i, q))
    lag, end = 0, 0
    for at, by in zip(i[order].tolist(), q[order].tolist()):
        if by > last_lag:
            break
        if by != lag:
            lag, end = by, 0
        if at < end or (at - by >= around[at] and by % period[at] == 0):
            continue
        lo, end = _reach(keys, at, by)
        length = end - lo + by
        if length >= max(min_length, e * by):
            out.append((lo - by, length, by))
            around[lo - by:end], period[lo - by:end] = lo - by, by
    return out


def reports(texts: list, edits: list | None = None, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """Per text: its number of words, its runs, and its words without the repetitions.

    ``edits`` may hold, per text, a function from the number of words to the
    place that each word is taken from (None leaves a text as it is).
    """
    words = [(t or "").encode("utf-8").split() for t in texts]  # bytes: ASCII white space only
    for d, edit in enumerate(edits or []):
        place = edit(len(words[d])) if edit and words[d] else None
        if place is not None:
            words[d] = [words[d][k] for k in place]
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    total = int(sizes.sum())
    if not total:
        return [(0, [], "")] * len(texts)
    flat = np.empty(total, dtype=object)
    flat[:] = [x for w in words for x in w]
    number, distinct = pd.factorize(flat)
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(words)), sizes)
    keys = pd.factorize(text * len(distinct) + number)[0].astype(np.int64)  # small, so that places fit
    start, length, period = find_runs(keys, int(sizes.max()), min_length, min_exponent)
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    bound = np.searchsorted(start, np.r_[first, total])
    out = []
    for d, w in enumerate(words):
        lo, hi = bound[d], bound[d + 1]
        if lo == hi:
            out.append((len(w), [], b" ".join(w).decode("utf-8")))
            continue
        runs = list(zip((start[lo:hi] - first[d]).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist()))
        left = np.flatnonzero(kept[first[d]:first[d] + sizes[d]])
        out.append((len(w), runs, b" ".join([w[k] for k in left]).decode("utf-8")))
    return out


def report_column(df: DataFrame, text_col: str, id_col: str | None = None,
                  edit: Callable[[int | None, int], np.ndarray | None] | None = None,
                  min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Column:
    """Column (``REPORT``): words, runs and collapsed text of each whole text.

    ``edit(id, n)`` may name, for a row of that id and n words, the places its
    words are taken from before the runs are looked for.
    """
    ship(df.sparkSession)

    @F.arrow_udf(REPORT)
    def report(ids: pa.Array, texts: pa.Array) -> pa.Array:
        parts = []
        ids, texts = ids.to_pylist(), texts.to_pylist()
        for lo, hi in chunks(texts, CHUNK_CHARS):
            edits = [(lambda n, i=i: edit(i, n)) for i in ids[lo:hi]] if edit else None
            got = reports(texts[lo:hi], edits, min_length, min_exponent)
            runs = [r for _, rs, _ in got for r in rs]
            cols = list(zip(*runs)) if runs else [[], [], []]
            items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], ["start", "length", "period"])
            at = np.r_[0, np.cumsum([len(rs) for _, rs, _ in got])].astype(np.int32)
            parts.append(pa.StructArray.from_arrays(
                [pa.array([n for n, _, _ in got], pa.int64()), pa.ListArray.from_arrays(pa.array(at), items),
                 pa.array([c for _, _, c in got], pa.string())], ["n", "runs", "collapsed"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(
            [("n", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
             ("collapsed", pa.string())]))

    return report(F.col(f"`{id_col}`") if id_col else F.lit(None).cast("bigint"), F.col(f"`{text_col}`"))
