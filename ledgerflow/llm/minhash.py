"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct word shingles.  Two collections of
``SIDE`` half keys are made, a half key from ``HALF`` minhashes; a table key is
a half key of the first collection combined with one of the second, so
2 * SIDE * HALF minhashes (32) give SIDE * SIDE tables (64) of 2 * HALF
minhashes each, which would take 256 on their own.  Two sets of similarity s
meet in a table with probability (1 - (1 - s**HALF)**SIDE)**2: at 0.85, 7 in
100,000 pairs are missed; at 0.9, 3 in a million.

Equal sets are merged first, so copies of any number are one node.  The tables
are dealt by key and node range, so the rows of a hot key spread over tasks.
All pairs of a bucket are never made.  Instead

1. every node of a bucket is compared with the bucket's first node (its
   centre) by the minhash sketches, and on the full sets with up to ``WAVES``
   centres that agree, as long as it is in another component than they are;
2. where that leaves a bucket in more than one component, its nodes are split
   exactly by prefix filtering: with shingles ordered by falling rarity among
   these nodes, two sets of the asked similarity share one among their first
   ``n - ceil(t * n) + 1``.  Nodes that share one, lie in different components,
   fit in size and place and agree in sketch are compared on the full sets.
   A shingle that more than ``BLOCK`` nodes of several components share is
   worked on in pairs of blocks, one task each.

So no link between components is lost behind a large bucket, and groups of
near copies cost a row a member and bucket.  A sketch is four bits of each
minhash; a pair is set aside if fewer than ``AGREE`` of 32 agree (at 0.85 less
than one pair in a million).  Links are always confirmed on the full sets
(built-in array functions, integers).  Sets hold 64-bit hashes of shingles; equal hashes of different
shingles (2**-64 a pair) are not told apart.

Nulls and corner cases: null, empty and blank texts have no shingles, link with
nothing and are their own component.  With fewer words than a shingle the whole
sequence is the only shingle.  Repeated rows are copies of each other.  A row
with a null id takes part; its component is the smallest non-null id it
reaches, null if there is none.  Very long texts are hashed in pieces.  An
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import CHUNK_CHARS, chunks, hot_join, mix64, ship, small_batches, word_hashes
from ledgerflow.llm.simhash import connected
from ledgerflow.session import cut_for_join, store

WORDS = 3
PERCENT = 85
SIDE = 8
HALF = 2
HASHES = 2 * SIDE * HALF
AGREE = 16
BLOCK = 512
WAVES = 3

_BLANK = re.compile(r"[\x20\x09-\x0d]")
_IS_WORD = np.ones(0x110000, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FLIP, _TURN = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(c))
                for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_TURN |= np.uint64(1)

FEATURES = "struct<n:bigint,node:binary,one:array<bigint>,two:array<bigint>,s1:bigint,s2:bigint,items:array<bigint>>"
_FEATURES = pa.struct([("n", pa.int64()), ("node", pa.binary()), ("one", pa.list_(pa.int64())),
                       ("two", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64()), ("items", pa.list_(pa.int64()))])


# ---- sets and sketches ----------------------------------------------------


def _pieces(text: str) -> list[str]:
    """A text cut at blanks into pieces of about ``CHUNK_CHARS``."""
    out, lo = [], 0
    while len(text) - lo > CHUNK_CHARS:
        m = _BLANK.search(text, lo + CHUNK_CHARS)
        if not m:
            break
        out.append(text[lo:m.start()])
        lo = m.start()
    return out + [text[lo:]]


def shingle_sets(texts: list, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text (A-Z lower-cased)."""
    lowered = [_pieces((t or "").encode("utf-8").lower().decode("utf-8")) for t in texts]
    h, counts = word_hashes([p for ps in lowered for p in ps], _IS_WORD)
    ends = np.cumsum(np.add.reduceat(counts, np.cumsum([0] + [len(ps) for ps in lowered])[:-1])) if texts else []
    out, lo = [], 0
    for hi in map(int, ends):
        w = h[lo:hi]
        k = min(words, len(w))
        lo = hi
        if not k:
            out.append(np.empty(0, np.uint64))
            continue
        s = mix64(w[:len(w) - k + 1] + np.uint64(k))
        for j in range(1, k):
            s = mix64(s ^ w[j:len(w) - k + 1 + j])
        out.append(np.unique(s))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``HASHES`` minhashes for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    out = np.empty((len(sets), HASHES), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((flat ^ _FLIP[k]) * _TURN[k], starts)
    return out


def half_keys(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two collections of half keys, one row per set; no two places share a key by design."""
    groups = m.reshape(len(m), 2 * SIDE, HALF)
    key = np.broadcast_to(np.arange(1, 2 * SIDE + 1, dtype=np.uint64), groups.shape[:2])
    for k in range(HALF):
        key = mix64(key ^ groups[:, :, k])
    return key[:, :SIDE].view(np.int64), key[:, SIDE:].view(np.int64)


def sketches(m: np.ndarray) -> np.ndarray:
    """Four bits of each minhash, as two 64-bit integers a set."""
    nib = mix64(m) >> np.uint64(60)
    shift = np.arange(HASHES, dtype=np.uint64) % np.uint64(16) * np.uint64(4)
    return np.bitwise_or.reduce((nib << shift).reshape(len(m), 2, 16), axis=2).view(np.int64)


def agreeing(a1, a2, b1, b2) -> np.ndarray:
    """How many of the 32 four-bit values agree."""
    ones = np.uint64(0x1111111111111111)
    n = np.zeros(np.broadcast(a1, b1).shape, dtype=np.uint8)
    for a, b in ((a1, b1), (a2, b2)):
        x = a.view(np.uint64) ^ b.view(np.uint64)
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        n += 16 - np.bitwise_count(x & ones)
    return n


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32()), pa.array(flat))


def features_column(df: DataFrame, text_col: str, words: int = WORDS) -> Column:
    """Column: size, 128-bit name, half keys, sketch and hashes of each text's set."""
    ship(df.sparkSession)

    def of(texts: list) -> pa.Array:
        sets = shingle_sets(texts, words)
        some = [i for i, s in enumerate(sets) if len(s)]
        m = minhashes([sets[i] for i in some]) if some else np.empty((0, HASHES), np.uint64)
        one, two = half_keys(m)
        sk = sketches(m)
        at = dict(zip(some, range(len(some))))
        names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]

        def pick(rows):
            return [rows[at[i]].tolist() if i in at else None for i in range(len(sets))]

        return pa.StructArray.from_arrays([
            pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
            pa.array(pick(one), pa.list_(pa.int64())), pa.array(pick(two), pa.list_(pa.int64())),
            pa.array(pick(sk[:, 0]), pa.int64()), pa.array(pick(sk[:, 1]), pa.int64()),
            _lists(sets)], fields=list(_FEATURES))

    @F.arrow_udf(FEATURES)
    def features(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        parts = [of(texts[lo:hi]) for lo, hi in chunks(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], _FEATURES)

    return features(F.col(f"`{text_col}`"))


# ---- tables ---------------------------------------------------------------


def _stars(batches):
    """Rows sorted by (key, row): every row with the first of its key, and the partition's edge keys."""
    key0 = c0 = x0 = y0 = first = None
    for b in batches:
        if not b.num_rows:
            continue
        key, row, s1, s2 = (b.column(c).to_numpy() for c in ("key", "row", "s1", "s2"))
        new = np.r_[key0 is None or key[0] != key0, key[1:] != key[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        c, x, y = (np.where(at < 0, old if old is not None else 0, col[np.maximum(at, 0)])
                   for old, col in ((c0, row), (x0, s1), (y0, s2)))
        if first is None:
            first = (key[0], row[0])
        m = ~new
        ok = agreeing(x[m], y[m], s1[m], s2[m]) >= AGREE
        yield pa.RecordBatch.from_pydict({
            "key": pa.nulls(int(m.sum()), pa.int64()), "a": pa.array(c[m]), "b": pa.array(row[m]), "ok": pa.array(ok)})
        key0, c0, x0, y0 = key[-1], c[-1], x[-1], y[-1]
    if first is not None:
        edges = sorted({first, (key0, c0)})
        yield pa.RecordBatch.from_pydict({
            "key": pa.array([k for k, _ in edges], pa.int64()), "a": pa.array([c for _, c in edges], pa.int64()),
            "b": pa.array([c for _, c in edges], pa.int64()), "ok": pa.array([True] * len(edges))})


def star_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, ok): centre, member, whether their sketches agree; (a, b) of buckets cut by a task's edge).

    The second frame pairs the centres of the pieces of one bucket: at most two
    rows a task.
    """
    n = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = (nodes.select("row", "s1", "s2", F.explode("one").alias("x"), "two")
             .select("row", "s1", "s2", "x", F.explode("two").alias("y"))
             .select(F.xxhash64("x", "y").alias("key"), "row", "s1", "s2")
             .repartitionByRange(n, "key", "row").sortWithinPartitions("key", "row"))
    made = store(keyed.mapInArrow(_stars, "key bigint, a bigint, b bigint, ok boolean").distinct())
    edge = made.filter("key is not null").select("key", "a")
    least = edge.groupBy("key").agg(F.min("a").alias("m"), F.count_distinct("a").alias("n")).filter("n > 1")
    cut = store(edge.join(least, "key").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct())
    return made.filter("key is null").select("a", "b", "ok"), cut


# ---- full sets ------------------------------------------------------------


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose full sets reach the similarity."""
    pairs = store(pairs.select("u", "v").distinct())
    need = cut_for_join(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct())
    have = sets.join(need, "row", "left_semi").select("row", "items")

    left = hot_join(pairs, have.select(F.col("row").alias("u"), F.col("items").alias("x")), "u", F.xxhash64("v"))
    both = hot_join(left, have.select(F.col("row").alias("v"), F.col("items").alias("y")), "v", F.xxhash64("u"),
                    counted=pairs)
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    common = F.when(100 * small >= percent * large, F.size(F.array_intersect("x", "y"))).otherwise(0)
    return store(both.withColumn("k", common).filter(100 * F.col("k") >= percent * (small + large - F.col("k")))
                 .select("u", "v"))


def _labelled(df: DataFrame, col: str, labels: DataFrame, out: str) -> DataFrame:
    """``df`` with the component of the node in ``col`` (the node itself where it has no link)."""
    got = df.join(labels.select(F.col("node").alias(col), F.col("root").alias(out)), col, "left")
    return got.withColumn(out, F.coalesce(out, col))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components."""
    both = _labelled(_labelled(pairs, "a", labels, "ca"), "b", labels, "cb")
    return both.filter("ca <> cb").drop("ca", "cb")


# ---- buckets of several components: prefix filtering ------------------------


_MET = ["g", "row", "comp", "n", "left", "p1", "p2", "s1", "s2"]


def _met(percent: int):
    """Rows sorted by group: pairs in different components that fit in size and place and agree in sketch."""
    def pairs(t: pa.Table):
        g, row, comp, n, left, p1, p2, s1, s2 = (t.column(c).to_numpy() for c in _MET)
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        for lo, hi in zip(edge[:-1], edge[1:]):
            if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                continue
            order = lo + np.argsort(n[lo:hi], kind="stable")
            far = np.searchsorted(n[order] * percent, 100 * n[order], "right")  # sizes that may still link
            for a, i in enumerate(order):
                j = order[a + 1:far[a]]
                j = j[comp[j] != comp[i]]
                # a shingle just before this one is shared as well: they met there
                j = j[(p1[j] != p1[i]) & (p1[j] != p2[i]) & (p2[j] != p1[i]) & (p2[j] != p2[i])]
                # this shingle and the ones after it, if it is the first that they share
                j = j[(100 + percent) * np.minimum(left[i], left[j]) >= percent * (n[i] + n[j])]
                j = j[agreeing(s1[i:i + 1], s2[i:i + 1], s1[j], s2[j]) >= AGREE]
                if len(j):
                    yield np.minimum(row[i], row[j]), np.maximum(row[i], row[j])

    def run(batches):
        held = None
        def out(t):
            got = list(pairs(t))
            if got:
                u, v = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            held = t if held is None else pa.concat_tables([held, t])
            g = held.column("g").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[-1])  # the last group may go on
            if cut:
                yield from out(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from out(held)

    return run


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(u, v) of nodes in different components that share a prefix shingle, fit in size and agree in sketch.

    ``nodes`` has (row, comp, n, s1, s2), ``sets`` (row, items) of the same
    rows.  Shingles are taken by falling rarity among these nodes; those of one
    node only come first and can't be shared, so they are counted, not dealt.
    """
    spark = nodes.sparkSession
    each = sets.select("row", F.explode("items").alias("h"))
    shared = store(each.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"))
    listed = (hot_join(each, shared, "h", F.col("row"))
              .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("l")))  # at most a set
    alone = F.col("n") - F.size("l")
    room = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - alone

    def before(i: Column, back: int) -> Column:  # of the first ones, a number no other row has
        return F.coalesce(F.get("l", i - back)["h"], 2 * F.col("row") + back - 1)

    places = F.transform(F.slice("l", F.lit(1), room.cast("int")), lambda x, i: F.struct(
        x["h"].alias("h"), i.alias("at"), before(i, 1).alias("p1"), before(i, 2).alias("p2")))
    dealt = store(listed.join(nodes, "row").filter(room > 0)
                  .select("row", "comp", "n", "s1", "s2", alone.alias("alone"), F.explode(places).alias("x"))
                  .select("row", "comp", "n", "s1", "s2", "x.h", "x.p1", "x.p2",
                          (F.col("n") - F.col("alone") - F.col("x.at")).alias("left")))
    groups = (dealt.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
              .filter("c0 <> c1").select("h", F.ceil(F.col("k") / block).cast("int").alias("blocks")))
    met = hot_join(dealt, groups, "h", F.col("row"))
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    met = (met.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select(F.xxhash64("h", F.least("own", "with"), F.greatest("own", "with")).alias("g"), *_MET[1:]))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (met.repartition(parts, "g").sortWithinPartitions("g")
            .mapInArrow(_met(percent), "u bigint, v bigint").distinct())


# ---- the operator -----------------------------------------------------------


def components(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT,
               block: int = BLOCK) -> DataFrame:
    """(id, n, component): each row's set size and the least id of its component."""
    with small_batches(df.sparkSession):
        docs, named = _components(df, id_col, text_col, words, percent, block)
    with_set = hot_join(docs.filter("n > 0").select("id", "n", "node", "row"), named, "node", F.col("row"))
    return (with_set.select("id", "n", "component")
            .unionByName(docs.filter("n = 0").select("id", "n", F.col("id").alias("component"))))


def _components(df: DataFrame, id_col: str, text_col: str, words: int, percent: int,
                block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their set's name, (node, component) of every set)."""
    docs = store(
        df.select(F.col(f"`{id_col}`").alias("id"), features_column(df, text_col, words).alias("f"))
        .select("id", "f.*").withColumn("row", F.monotonically_increasing_id()))
    nodes = store(docs.filter("n > 0").groupBy("node").agg(
        F.min("row").alias("row"), F.min("id").alias("least"),
        *[F.any_value(c).alias(c) for c in ("n", "one", "two", "s1", "s2")]))
    stars, cut = star_pairs(nodes)
    sets = docs.select("row", "items")

    def grown(links, more):
        links = more if links is None else links.unionByName(more)
        return links, connected(links)

    # a node with one centre a wave; buckets that this leaves in several components by prefixes
    agree, tried = stars.filter("ok").select("a", "b"), cut
    links = labels = None
    for _ in range(WAVES):
        left = agree if labels is None else _apart(agree, labels).join(tried, ["a", "b"], "left_anti")
        wave = store(left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        tried = tried.unionByName(wave)
        pairs = wave if labels is not None else wave.unionByName(cut)
        links, labels = grown(links, confirmed(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), sets, percent))
    mixed = _apart(stars.select("a", "b"), labels).select("a")
    torn = _apart(cut, labels).select("a")
    torn = torn.unionByName(cut.join(torn.distinct(), "a", "left_semi").select(F.col("b").alias("a")))
    centres = cut_for_join(mixed.unionByName(torn).distinct())
    inside = stars.join(centres, "a", "left_semi").select(F.explode(F.array("a", "b")).alias("row"))
    inside = store(inside.unionByName(centres.select(F.col("a").alias("row"))).distinct())
    few = cut_for_join(inside)
    part = store(_labelled(nodes.select("row", "n", "s1", "s2").join(few, "row", "left_semi"), "row", labels, "comp"))
    more = prefix_pairs(part, sets.join(few, "row", "left_semi"), percent, block)
    links, labels = grown(links, confirmed(more, sets, percent))

    tops = _labelled(nodes.select("row", "node", "least"), "row", labels, "comp")
    least = tops.groupBy("comp").agg(F.min("least").alias("component"))
    named = store(hot_join(tops.select("node", "comp", "row"), least, "comp", F.col("row"))
                  .select("node", "component"))
    return docs, named
