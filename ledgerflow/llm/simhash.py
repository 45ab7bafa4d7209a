"""Near-duplicate documents by SimHash, joined through a binary trie.

Fingerprints are 64-bit words; two link when at most ``max_bits`` bits differ.
A binary trie over the fingerprints is joined with itself: pairs of nodes are
walked down together, the differing bits so far are added up and a pair is
pruned once they exceed the budget.

How that is spread over the cluster:

- equal fingerprints are merged first, so a group of copies of any size is one
  leaf;
- the 64 bits are cut into ``max_bits + 1`` blocks; two linked fingerprints
  agree in one block at least.  For each block the fingerprint is rotated to
  begin with it, and the nodes at the end of that block with no differing bit
  are the roots from which pairs are walked;
- a node pair that holds more than ``MAX_NODE`` fingerprints is walked down by
  ``STEP_BITS`` more bits with DataFrame operations (each fingerprint goes to
  the child pairs within its budget) until no task gets a larger one;
- the rest of the walk runs inside tasks, all node pairs of a batch at once,
  level by level.

Linked fingerprints are then grouped by repeated minimum exchange.

Nulls and corner cases: a null or empty text has no words and fingerprint zero,
which links like any other; repeated rows count as copies; rows with a null id
take part, and a component of null ids only has a null component id.  Texts of
any length are taken whole, ties go to the smaller id, an empty table gives an
empty table.  ``components`` reads two columns and returns three; ``keep_one``
returns all columns of its table, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import fresh, hot_join, materialize, ship
from ledgerflow.session import cut_for_join, store

WORDS = 3
MAX_BITS = 2
SEED = 42
MAX_NODE = 2_048
STEP_BITS = 4
MAX_ROUNDS = 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned SimHash of one text."""
    w = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed=SEED)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, dtype=np.int64)
    n = len(w) - words + 1
    for lo in range(0, n, 50_000):
        hi = min(n, lo + 50_000)
        parts = zip(*(w[lo + k:hi + k] for k in range(words)))
        h = np.array([h64(join(s), SEED) for s in parts], dtype=np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_column(df: DataFrame, text_col: str, words: int = WORDS):
    """Column: the fingerprint of each whole text as a signed 64-bit integer."""
    ship(df.sparkSession)

    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        got = np.array([fingerprint(t, words) for t in texts.to_pylist()], dtype=np.uint64)
        return pa.array(got.view(np.int64), pa.int64())

    return fp(F.col(f"`{text_col}`"))


def as_hex(fp) -> F.Column:
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- the trie self-join ------------------------------------------------


def walk_pairs(key: np.ndarray, a: np.ndarray, side: np.ndarray, used: np.ndarray,
               depth: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk root pairs down to leaf pairs; the positions of linked fingerprints.

    Rows are sorted by (key, side, a).  Rows of one key form a root pair: side
    0 alone is a node paired with itself; with a negative ``depth`` sides 0
    and 1 are two nodes whose prefixes of ``-depth`` bits differ in ``used`` bits.
    """
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[edge[1:], len(key)]
    ones = np.r_[0, np.cumsum(side)]
    n1 = ones[end] - ones[edge]
    two = depth[edge] < 0  # a negative depth marks a pair of two nodes
    d0 = np.abs(depth[edge]).astype(np.int64)
    lo_a, hi_a = edge, np.where(two, end - n1, end)
    lo_b, hi_b = np.where(two, end - n1, edge), end
    d = used[edge].astype(np.int64)
    bits = a.view(np.uint64)
    out_i, out_j = [], []
    keep = (hi_a > lo_a) & (hi_b > lo_b) & (two | (hi_a - lo_a > 1))
    lo_a, hi_a, lo_b, hi_b, d, d0 = (x[keep] for x in (lo_a, hi_a, lo_b, hi_b, d, d0))
    start = int(d0.min()) if len(d0) else 64
    for level in range(start, 65):
        single = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        if single.any():  # two leaves: the remaining bits at once
            i, j = lo_a[single], lo_b[single]
            x = bits[i] ^ bits[j]
            near = np.bitwise_count(x) <= max_bits
            out_i.append(i[near])
            out_j.append(j[near])
            rest = ~single
            lo_a, hi_a, lo_b, hi_b, d, d0 = (x[rest] for x in (lo_a, hi_a, lo_b, hi_b, d, d0))
        if level == 64 or not len(lo_a):
            break
        wait = d0 > level
        ones = np.r_[0, np.cumsum((bits >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)]
        mid_a = hi_a - (ones[hi_a] - ones[lo_a])
        mid_b = hi_b - (ones[hi_b] - ones[lo_b])
        same = lo_a == lo_b
        go = ~wait
        parts = [tuple(x[wait] for x in (lo_a, hi_a, lo_b, hi_b, d, d0))]
        for la, ha, lb, hb, more, which in (
                (lo_a, mid_a, lo_b, mid_b, 0, go), (mid_a, hi_a, mid_b, hi_b, 0, go),
                (lo_a, mid_a, mid_b, hi_b, 1, go), (mid_a, hi_a, lo_b, mid_b, 1, go & ~same)):
            ok = which & (ha > la) & (hb > lb) & (d + more <= max_bits)
            if not more:
                ok &= ~same | (ha - la > 1)
            parts.append((la[ok], ha[ok], lb[ok], hb[ok], d[ok] + more, d0[ok]))
        lo_a, hi_a, lo_b, hi_b, d, d0 = (np.concatenate(x) for x in zip(*parts))
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _walker(max_bits: int):
    """mapInArrow over partitions sorted by (key, side, r): links of each root pair."""
    def walk(batches):
        held = None

        def links(t: pa.Table):
            key = t.column("key").to_numpy()
            r = t.column("r").to_numpy()
            turn = t.column("turn").to_numpy()
            i, j = walk_pairs(key, r, t.column("side").to_numpy().astype(np.int64),
                              t.column("used").to_numpy(), t.column("depth").to_numpy(), max_bits)
            back = np.uint64(64) - turn.astype(np.uint64)
            u = r.view(np.uint64)
            own = np.where(turn == 0, u, (u << (back & np.uint64(63))) | (u >> (turn.astype(np.uint64) & np.uint64(63))))
            own = own.view(np.int64)
            return pa.RecordBatch.from_pydict({"u": pa.array(own[i]), "v": pa.array(own[j])})

        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    return walk


def link_pairs(fps: DataFrame, max_bits: int = MAX_BITS, max_node: int = MAX_NODE) -> DataFrame:
    """Pairs (u, v) of different fingerprints with at most ``max_bits`` differing bits.

    ``fps`` has one distinct, non-null bigint column ``fp``.
    """
    ship(fps.sparkSession)
    cuts = [round(64 * k / (max_bits + 1)) for k in range(max_bits + 2)]
    # one row per block: fingerprint rotated left by ``turn`` so the block comes first
    turned = []
    for k in range(max_bits + 1):
        turn, width = cuts[k], cuts[k + 1] - cuts[k]
        r = F.col("fp") if turn == 0 else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))
        turned.append(F.struct(F.lit(turn).alias("turn"), r.alias("r"), F.lit(width).alias("depth")))
    roots = (fps.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
             .withColumn("pa", F.expr("shiftrightunsigned(r, 64 - depth)")).withColumn("pb", F.col("pa"))
             .withColumn("used", F.lit(0)).withColumn("side", F.lit(0)))
    done = None
    pair = ["turn", "depth", "pa", "pb"]
    for _ in range(MAX_ROUNDS):
        roots = materialize(roots)
        sizes = roots.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"),
                                         F.min("side").alias("s0"), F.max("side").alias("s1"))
        # a node alone pairs with nothing; two nodes need both sides
        live = sizes.filter(((F.col("pa") == F.col("pb")) & (F.col("n") > 1)) | (F.col("s0") < F.col("s1")))
        live = materialize(live.withColumn("big", (F.col("n") > max_node) & (F.col("depth") < 60)))
        kept = roots.join(live.select(*pair, "big"), pair)
        small = kept.filter(~F.col("big")).drop("big")
        done = small if done is None else done.unionByName(small)
        if live.filter("big").isEmpty():
            break
        roots = _step_down(kept.filter("big").drop("big"), max_bits)
    keyed = done.select(
        F.xxhash64(*pair).alias("key"), "r", F.col("turn").cast("int").alias("turn"),
        F.col("side").cast("int").alias("side"), F.col("used").cast("int").alias("used"),
        F.when(F.col("pa") == F.col("pb"), F.col("depth")).otherwise(-F.col("depth")).cast("int").alias("depth"))
    n = max(8, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (keyed.repartition(n, "key").sortWithinPartitions("key", "side", _unsigned("r"))
            .mapInArrow(_walker(max_bits), "u bigint, v bigint")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def _unsigned(c):
    """Sort key that orders a signed column by its unsigned value."""
    return F.col(c).bitwiseXOR(F.lit(-(1 << 63)))


def _step_down(roots: DataFrame, max_bits: int) -> DataFrame:
    """Children of too large node pairs, ``STEP_BITS`` bits further down.

    A fingerprint goes to each child pair that can still be within the budget:
    its own child on one side, and on the other a child whose new bits differ
    in at most the bits left.
    """
    masks = F.array(*[F.lit(m).cast("bigint") for m in range(1 << STEP_BITS)
                      if bin(m).count("1") <= max_bits])
    own = F.expr(f"shiftrightunsigned(r, 64 - depth - {STEP_BITS})")
    other_parent = F.when(F.col("side") == 0, F.col("pb")).otherwise(F.col("pa"))
    mine = own.bitwiseAND(F.lit((1 << STEP_BITS) - 1).cast("bigint"))
    rows = (roots.withColumn("own", own).withColumn("mask", F.explode(masks))
            .withColumn("used2", F.col("used") + F.bit_count("mask"))
            .filter(F.col("used2") <= max_bits)
            .withColumn("other", F.shiftleft(other_parent, STEP_BITS).bitwiseOR(mine.bitwiseXOR(F.col("mask")))))
    itself = F.col("pa") == F.col("pb")
    first = F.when(itself, F.col("own") <= F.col("other")).otherwise(F.col("side") == 0)
    return rows.select(
        "turn", "r", (F.col("depth") + STEP_BITS).alias("depth"),
        F.when(first, F.col("own")).otherwise(F.col("other")).alias("pa"),
        F.when(first, F.col("other")).otherwise(F.col("own")).alias("pb"),
        F.col("used2").alias("used"), F.when(first, 0).otherwise(1).alias("side"))


# ---- components --------------------------------------------------------


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``links`` (u, v) reaches.

    Each round takes the least root among a node and its neighbours, then
    jumps to that root's own root; the number of rounds follows the logarithm
    of the longest chain.  Degrees are bounded by the bit budget, the jump is
    a plain join that AQE may split where many nodes share a root.
    """
    both = store(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    state = store(both.groupBy("u").agg(F.min("v").alias("m"))
                  .select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        near = (both.join(state.select(F.col("node").alias("v"), "root"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near")))
        step = state.join(near, "node").select("node", F.col("root").alias("old"),
                                               F.least("root", "near").alias("mid"))
        jump = state.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = store(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")))
        moved = not new.filter("old <> root").isEmpty()
        state = new.select("node", "root")
        if not moved:
            return state


def _groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component): every fingerprint's group and the least id in it."""
    least = store(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected(link_pairs(least.select("fp"), max_bits))
    linked = store(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    of_root = linked.groupBy("root").agg(F.min("least").alias("component"))
    return store(linked.select("fp", "root").join(of_root, "root"))


def components(df: DataFrame, id_col: str, text_col: str, words: int = WORDS,
               max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component): every row's fingerprint and its component's least id.

    ``fp`` is the signed 64-bit fingerprint.  One row per row of ``df``.
    """
    fps = store(df.select(F.col(f"`{id_col}`").alias("id"),
                          fingerprint_column(df, text_col, words).alias("fp")))
    labels = _groups(fps, max_bits).select("fp", "component")
    return hot_join(fps, labels, "fp", F.monotonically_increasing_id()).select("id", "fp", "component")


def keep_one(df: DataFrame, id_col: str, text_col: str, words: int = WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with one row of each component: that of the least id.

    Rows are told apart by id and text (two 64-bit hashes), so a row that only
    shares its id with another stays unless its own group has a lesser one; of
    rows of the least id and several texts that of the least hashes stays, of
    rows equal in both the one whose columns come first as JSON.  Rows with a
    null id link others but stay as they are.  The groups are worked out on ids
    and hashes; whole rows meet only the list of those that go.
    """
    keys = [fresh(df, "row_id"), fresh(df, "row_a"), fresh(df, "row_b")]
    text = F.col(f"`{text_col}`")
    keyed = (df.withColumn(keys[0], F.col(f"`{id_col}`")).withColumn(keys[1], F.xxhash64(text))
             .withColumn(keys[2], F.xxhash64(F.lit(1), text)))
    fps = store(keyed.select(*[F.col(k).alias(n) for k, n in zip(keys, ("id", "a", "b"))],
                             fingerprint_column(df, text_col, words).alias("fp")))
    labels = _groups(fps, max_bits).select("fp", "root")
    each = store(fps.filter("id is not null").groupBy("id", "a", "b", "fp").agg(F.count(F.lit(1)).alias("n")))
    each = store(hot_join(each, labels, "fp", F.monotonically_increasing_id()))
    first = each.groupBy("root").agg(F.min(F.struct("id", "a", "b")).alias("first"))
    each = hot_join(each, first, "root", F.monotonically_increasing_id())
    stays = F.struct("id", "a", "b") == F.col("first")
    named = store(each.select(*[F.col(n).alias(k) for k, n in zip(keys, ("id", "a", "b"))],
                              stays.alias("stays"), (F.col("n") > 1).alias("again")))
    out = keyed.join(cut_for_join(named.filter("not stays").select(*keys)), keys, "left_anti")
    again = cut_for_join(named.filter("stays and again").select(*keys))
    if not again.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        one = (out.join(again, keys, "left_semi").groupBy(*keys).agg(F.min_by(whole, F.to_json(whole)).alias(keys[0] + "w"))
               .select(F.col(keys[0] + "w").alias("w")).select("w.*"))
        return out.join(again, keys, "left_anti").drop(*keys).unionByName(one)
    return out.drop(*keys)
