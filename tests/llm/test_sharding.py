import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cases import documents
from ledgerflow.llm import queries as Q
from ledgerflow.llm import sharding as H


def check(df, rows, n, near=None):
    assert len(rows) == df.count()
    slots, size = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if near:
        target = sum(size.values()) / n
        assert all(abs(size[s] - target) <= near * target for s in range(n))
    return size


def test_near_equal_bytes(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab é"), (F.col("id") % 37).cast("int")).alias("t"),
                                  F.col("id").cast("string").alias("u"))
    df = df.select("doc_id", F.concat("t", "u").alias("text"))
    rows = H.shard(df, "text", "doc_id", 8).collect()
    check(df, rows, 8, near=0.02)
    of = {r.doc_id: r for r in rows}
    assert of[3]["size"] == len((of[3].text).encode()) + 1


def test_copies_stay_together_unless_they_outweigh_a_shard(spark):
    some = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 500).cast("string")).alias("text"))
    homes = defaultdict(set)
    for r in H.shard(some, "text", "doc_id", 4, tolerance=0.05).collect():
        homes[r.text].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    hot = some.unionByName(spark.range(10_000, 14_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text")))
    rows = H.shard(hot, "text", "doc_id", 8).collect()
    check(hot, rows, 8, near=0.02)                   # a third and more are one text: cut by id


def test_odd_rows(spark):
    df = documents(spark).withColumn("shard", F.lit("mine")).withColumn("k1", F.lit(9))
    rows = H.shard(df, "text", "doc_id", 3).collect()
    check(df, rows, 3)
    assert {r.row.shard for r in rows} == {"mine"}
    plain = documents(spark, extra=False)
    assert sorted(r["size"] for r in H.shard(plain, "text", "doc_id", 1).collect()) == sorted(
        len((r.text or "").encode()) + 1 for r in plain.collect())
    assert H.shard(plain.limit(0), "text", "doc_id").collect() == []
    same = spark.createDataFrame([(1, "a")] * 50, "doc_id bigint, text string")
    check(same, H.shard(same, "text", "doc_id", 4).collect(), 4)


def test_same_shards_again(spark):
    sf = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, Q.op8_sharding(spark, sf).collect()), key=str) for _ in range(2))
    assert a == b
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op8_sharding(spark, sf).collect():
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)


def test_repeated_rows_and_clashing_names(spark):
    rows = [(7, "the very same text " * 20, "mine")] * 500 + [(i, f"text {i} " * 48, "mine") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Shard string").repartition(9)
    got = H.shard(df, "text", "doc_id", 8).collect()
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["row"]["Shard"] == "mine"
    longest = max(len(t) + 1 for _, t, _ in rows)
    target = sum(size.values()) / 8
    assert len(got) == 1000 and set(size) == set(range(8))
    assert all(abs(x - target) <= 0.004 * target + longest for x in size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert H.shard(df.withColumnRenamed("Shard", "SLOT"), "text", "doc_id", 2).count() == 1000


def test_splitters_against_a_sorted_list(spark):
    rng = random.Random(7)
    rows = [(rng.choice([rng.getrandbits(63) - (1 << 62), 5]), rng.choice([1, 2, rng.getrandbits(40)]), k, rng.randrange(1, 90))
            for k in range(3000)]
    df = spark.createDataFrame(rows, "k1 bigint, k2 bigint, k3 bigint, size bigint")
    total = sum(r[3] for r in rows)
    bounds = H.splitters(df, 6)
    assert bounds == sorted(bounds)
    for s, bound in enumerate(bounds, 1):
        below = sum(r[3] for r in rows if tuple(k + (1 << 63) for k in r[:len(bound)]) < bound)
        assert abs(below - total * s / 6) <= max(H.TOLERANCE * total / 6, 90)
