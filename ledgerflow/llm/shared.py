"""Small helpers the operators of this package share."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import ledgerflow
from ledgerflow.session import cut_for_join, ensure_checkpoint_dir, store

# Texts are worked through in pieces of about this many characters, so the
# memory of a Python worker follows the piece (or one very long text), not the
# Arrow batch.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A given table, cut to the named columns (all when none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f"`{c}`") for c in cols]) if cols else df


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder the session's cluster names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df``'s (case-insensitively)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs run inside exchange Arrow batches of at most ``rows`` rows with Python.

    A worker's memory follows its batch; the session's own setting comes back
    at the end.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


HOT_ROWS = 4_096


def hot_join(big: DataFrame, small: DataFrame, key: str, spread: Column, counted: DataFrame | None = None,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """``big`` joined with ``small`` on ``key`` (unique in ``small``), hot keys dealt over several tasks.

    The rows of a key that has more than ``hot_rows`` are numbered by ``spread``
    (a whole number that a retried task finds again) into that many parts, and
    the key's row of ``small`` is repeated for each.  There is at most one hot
    key per ``hot_rows`` rows; they are broadcast if they measure small.
    ``counted`` may name a narrower frame with the same keys to count.
    """
    hot = ((counted if counted is not None else big).groupBy(key).agg(F.count(F.lit(1)).alias("hot_n"))
           .filter(F.col("hot_n") > hot_rows)
           .select(key, F.ceil(F.col("hot_n") / hot_rows).cast("int").alias("hot_parts")))
    hot = cut_for_join(hot)
    if hot.isEmpty():
        return big.join(small, key)
    parts = F.coalesce("hot_parts", F.lit(1))
    dealt = (big.withColumn("hot_spread", spread).join(hot, key, "left")
             .withColumn("hot_part", F.pmod("hot_spread", parts).cast("int")).drop("hot_parts", "hot_spread"))
    copied = (small.join(hot, key, "left")
              .withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_parts"))
    return dealt.join(copied, [key, "hot_part"]).drop("hot_part")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    The functions that tasks run are pickled by reference, so a worker must be
    able to import them also where the package is not installed.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(ledgerflow.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "ledgerflow_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ledgerflow", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def send_file(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Distribute bounded bytes as a file; executors open it by ``local_file``.

    Spark's file server hands it to every executor, replacements of lost ones
    included.  Returns the name to ask for.
    """
    name = f"{uuid.uuid4().hex}{suffix}"
    path = os.path.join(tempfile.mkdtemp(prefix="artifact-"), name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return name


def local_file(name: str) -> str:
    """Path of a file sent by ``send_file`` on this executor."""
    return SparkFiles.get(name)


def arrays_to_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` holding about ``limit`` characters each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def flat_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i]+lens[i]-1`` for all i, one after another."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


# ---- exact word counts ---------------------------------------------------

# A task hands its counts on whenever it holds so many words, or has read so
# many characters since.
TALLY_WORDS = 100_000
TALLY_CHARS = 16_000_000
TABLE_CHARS = 64  # a longer word takes no place in a lookup table


def tallies(batches, split, words: int = TALLY_WORDS, chars: int = TALLY_CHARS) -> Iterator[pa.RecordBatch]:
    """Counts (word, n) of all words of the texts, in parts that add up to the whole.

    Words of more than ``TABLE_CHARS`` characters are left out.
    """
    def part() -> pa.RecordBatch:
        kept = {w: n for w, n in seen.items() if len(w) <= TABLE_CHARS}
        return pa.RecordBatch.from_pydict({"word": pa.array(kept.keys(), pa.string()),
                                           "n": pa.array(kept.values(), pa.int64())})

    seen: Counter = Counter()
    read = 0
    for b in batches:
        for t in b.column(0):
            if text := t.as_py():
                seen.update(split(text))
                read += len(text)
                if len(seen) >= words or read >= chars:
                    yield part()
                    seen, read = Counter(), 0
    yield part()


def top_words(df: DataFrame, text_col: str, split, size: int) -> list[str]:
    """The ``size`` most frequent words of all texts, most frequent first (of equals the smaller one).

    Exact: every text is read and every word of at most ``TABLE_CHARS``
    characters is counted.  Counts are added up in the tasks, then by word, and
    stored; how many words have which count gives the least count that a
    chosen word can have, so few others are sorted with them.  ``split`` maps a
    text to its words.
    """
    counts = store(df.select(F.col(f"`{text_col}`").alias("t"))
                   .mapInArrow(lambda batches: tallies(batches, split), "word string, n bigint")
                   .groupBy("word").agg(F.sum("n").alias("n")))
    least, found = 0, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(size).collect():
        least, found = r["n"], found + r["words"]
        if found >= size:
            break
    # toArrow selects in tasks; collect would bring each task's selection to the driver
    return (counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size)
            .toArrow()["word"].to_pylist())


# ---- words as numbers ----------------------------------------------------

_N_POINTS = 0x110000


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_TABLES: dict = {}


def _tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """A number per code point, and powers for the places in a word."""
    if "points" not in _TABLES:
        with np.errstate(over="ignore"):
            _TABLES["points"] = mix64(np.arange(1, _N_POINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _TABLES["powers"] = np.ones(1, np.uint64)
    if len(_TABLES["powers"]) < length:
        with np.errstate(over="ignore"):
            _TABLES["powers"] = np.cumprod(np.full(max(1024, length), 0xD6E8FEB86659FD93, dtype=np.uint64))
    return _TABLES["points"], _TABLES["powers"]


def word_hashes(texts: list, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and how many each has.

    A word is a longest run of code points that the table ``is_word`` marks
    (the line feed, which is put between texts, must not be one of them).
    """
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
    cp = np.frombuffer("".join([(t or "") + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    w = is_word[cp]
    edge = np.diff(np.r_[False, w, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    lens = ends - starts
    points, powers = _tables(int(lens.max()))
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    with np.errstate(over="ignore"):
        h = mix64(np.add.reduceat(points[cp[w]] * powers[place], at))
    counts = np.diff(np.r_[0, np.searchsorted(starts, np.cumsum(sizes))])
    return h, counts
