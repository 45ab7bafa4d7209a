"""URL rules by a Bloom filter cascade, with DataFrame functions only.

A rule is a host and a path prefix (``example.com/en/``) with an action.  Every
url has a few candidate keys: the suffixes of its host at label borders with as
many labels as some rule, each with the prefixes of its path as long as some
rule's.  The complete key universe is all candidate keys of the corpus.

For each action a cascade is built over that universe: level 1 encodes the
listed keys, level 2 the universe's other keys that pass level 1 by mistake,
level 3 the listed keys that pass level 2, and so on until no key is wrong.
Membership is then exact for every key of the universe, and a url is judged by
bit tests alone: no join, no exchange.  (Building level 2 sets the listed keys
apart from those that pass level 1, the listed ones and a hundredth of the
universe, by a join of these keys.)  The longest listed candidate is the rule; a
url without one is not on any list and gets ``default``.

Levels are bit arrays, held as scalar subqueries and so sent to each task like a
small broadcast.  Keys are split by a hash into so many slices, each with a
cascade of its own, that no first or second level passes ``MAX_BITS`` bits; the
slices come from the number of listed keys and of the universe's.  At most
``AT_ONCE`` slices are judged in one pass over the rows; more take further
passes, between which the rows are written to the shared folder with the best
rule so far.  So a task holds a bounded number of bits however long the list is.

A null url or one without ``://`` has an empty host and path and fits no rule.
Repeated rows are judged alike; an empty table gives an empty result; other
columns stay as they are, and a new column whose name is taken (names are
compared without case) gets an underscore behind its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import fresh, materialize

RATE = 0.01        # of level 1; later levels need less, they hold few keys
LATER_RATE = 0.5
MAX_BITS = 1 << 23
AT_ONCE = 16       # slices of one pass: 16 MB of first levels an action at most
MAX_LEVELS = 40

# The rules of the registered query (host, path, action).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidates(host: Column, path: Column, rules) -> list[Column]:
    """The keys of a url that could be on the list; null where it has no such key."""
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    out = []
    for n in labels:
        parts = F.size(F.split(host, r"\."))
        suffix = F.when(parts >= n, F.substring_index(host, ".", -n))
        for k in lengths:
            out.append(F.when(F.length(path) >= k, F.concat(suffix, F.substring(path, 1, k))))
    return out


class Level:
    """A Bloom filter: ``bits`` positions, ``hashes`` per key, its words as a table."""

    def __init__(self, keys: DataFrame, n: int, rate: float, salt: int):
        want = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.bits = 64 * math.ceil(want / 64)
        self.hashes = max(1, round(self.bits / max(n, 1) * math.log(2)))
        self.hashes = min(self.hashes, 12)
        self.salt = salt
        place = F.explode(F.array(*[self._place(F.col("key"), k) for k in range(self.hashes)]))
        # one row per word of the array, however many keys there are
        empty = keys.sparkSession.range(self.bits // 64).select(
            F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
        words = (keys.select(place.alias("p"))
                 .select(F.floor(F.col("p") / 64).alias("w"),
                         F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
                 .unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b")))
        dense = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))),
                                      lambda x: x["b"]).alias("words"))
        self.table = materialize(dense)

    def _place(self, key: Column, k: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.salt * 100 + k)), F.lit(self.bits).cast("bigint"))

    def passes(self, key: Column) -> Column:
        test = F.lit(True)
        for k in range(self.hashes):
            p = self._place(key, k)
            word = F.element_at(self.table.scalar(), (F.floor(p / 64) + 1).cast("int"))
            bit = F.call_function("getbit", word, (p % 64).cast("int"))
            test = test & (bit == 1)
        return test


class Cascade:
    """Exact membership of ``listed`` among the keys of ``universe`` (column key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, salt: int):
        listed = materialize(listed.select("key").distinct())
        self.levels: list[Level] = []
        inside, outside = listed, universe  # the keys of this level, those it must tell apart
        for k in range(MAX_LEVELS):
            inside = materialize(inside)
            n = inside.count()
            if not n:
                return
            level = Level(inside, n, RATE if k == 0 else LATER_RATE, salt * 1000 + k)
            self.levels.append(level)
            wrong = outside.filter(level.passes(F.col("key")))
            if k == 0:  # the universe's listed keys pass rightly
                wrong = wrong.join(listed, "key", "left_anti")
            inside, outside = wrong, inside
        raise ValueError(f"no exact cascade within {MAX_LEVELS} levels")

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: odd levels hold listed keys."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[k].passes(key), F.lit(k % 2 == 1)).otherwise(answer)
        return answer


def _slices(listed: int, others: int, max_bits: int) -> int:
    """Slices that keep level 1 (``listed`` keys) and level 2 (the ``others`` it
    passes by mistake, and as many again) within ``max_bits``.

    Slices are dealt by a hash; a fifth more leaves room for uneven ones.
    """
    first = listed * -math.log(RATE) / math.log(2) ** 2
    second = others * 2 * RATE * -math.log(LATER_RATE) / math.log(2) ** 2
    return max(1, math.ceil(1.2 * max(first, second) / max_bits))


def judge(df: DataFrame, url_col: str, rules=RULES, default: str = "allow",
          max_bits: int = MAX_BITS, at_once: int = AT_ONCE) -> DataFrame:
    """``df`` with host, path, rule and verdict of each url."""
    spark = df.sparkSession
    names = {n: fresh(df, n) for n in ("host", "path", "rule", "verdict")}
    rules = list(rules)
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parts = df.select(host.alias("host"), path.alias("path"))
    keys = F.array_compact(F.array_distinct(F.array(*candidates(F.col("host"), F.col("path"), rules))))
    universe = materialize(parts.select(F.explode(keys).alias("key")).distinct())
    listed = materialize(spark.createDataFrame([(h + p, a) for h, p, a in rules], "key string, action string").distinct())
    sizes = {r["action"]: r["n"] for r in listed.groupBy("action").agg(F.count("*").alias("n")).collect()}
    n_slices = _slices(max(sizes.values(), default=0), universe.count(), max_bits)

    def slice_of(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(n_slices).cast("bigint")).cast("int")

    out = df.withColumn(names["host"], host).withColumn(names["path"], path)
    keys = candidates(F.col(f"`{names['host']}`"), F.col(f"`{names['path']}`"), rules)
    found = fresh(out, "best")
    best = F.lit(None).cast("struct<n:int,rule:string,action:string>")
    for first in range(0, n_slices, at_once):
        now = range(first, min(first + at_once, n_slices))
        tests = []
        for i, action in enumerate(sorted(sizes)):
            cascades = [Cascade(listed.filter((F.col("action") == action) & (slice_of(F.col("key")) == n)),
                                universe.filter(slice_of(F.col("key")) == n), i * n_slices + n + 1) for n in now]
            for c in keys:
                if n_slices == 1:
                    held = cascades[0].holds(c)
                else:
                    held = F.lit(False)
                    for n, cascade in zip(now, cascades):
                        held = F.when(slice_of(c) == n, cascade.holds(c)).otherwise(held)
                tests.append(F.when(c.isNotNull() & held,
                                    F.struct(F.length(c).alias("n"), c.alias("rule"), F.lit(action).alias("action"))))
        best = F.array_max(F.array_compact(F.array(best, *tests)))  # the longest rule
        if now.stop < n_slices:
            out = materialize(out.withColumn(found, best))
            best = F.col(f"`{found}`")
    verdict = f"`{names['verdict']}`"
    return (out.withColumn(names["verdict"], best).drop(found)
            .withColumn(names["rule"], F.col(verdict)["rule"])
            .withColumn(names["verdict"], F.coalesce(F.col(verdict)["action"], F.lit(default))))
