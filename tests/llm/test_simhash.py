import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cases import documents
from ledgerflow.llm import queries as Q
from ledgerflow.llm import simhash as S


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fp = [(i, slow_fingerprint(t)) for i, t in rows]
    group = list(range(len(fp)))
    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for (i, f), g in zip(fp, group):
        ids = [j for (j, _), h in zip(fp, group) if h == g and j is not None]
        out.append((i, f, min(ids) if ids else None))
    return out


def test_fingerprints():
    for t in (None, "", " \t", "A", "a b", "A b c", "Été ÉTÉ x\ty\x0bz\u00a0q", "a b c " * 40):
        assert S.fingerprint(t) == slow_fingerprint(t)
    assert S.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", seed=42)


def test_components_on_odd_rows(spark):
    df = documents(spark)
    got = [(r.id, r.fp, r.component) for r in S.components(df, "doc_id", "text").collect()]
    want = [(i, signed(f), c) for i, f, c in slow_components([(r.doc_id, r.text) for r in df.collect()])]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert S.components(df.limit(0), "doc_id", "text").collect() == []


def test_near_copies_chain(spark):
    rng = random.Random(5)
    base = [f"t{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for k in range(40):
        if k % 8 == 0:
            rng.shuffle(base)
        base[rng.randrange(400)] = f"t{rng.randrange(500)}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "id bigint, t string")
    got = {r.id: r.component for r in S.components(df, "id", "t").collect()}
    assert got == {i: c for i, _, c in slow_components(rows)}
    assert len(set(got.values())) < len(got)  # some do link


def test_links_equal_brute_force_at_every_node_size(spark):
    rng = random.Random(3)
    roots = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    for _ in range(300):
        x = rng.choice(roots)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    a = np.array(sorted(fps), dtype=np.uint64)
    for bits in (0, 2, 3):
        want = {tuple(sorted((signed(int(x)), signed(int(y))))) for x in a
                for y in a[np.bitwise_count(a ^ x) <= bits] if x != y}
        df = spark.createDataFrame([(signed(int(x)),) for x in a], "fp bigint")
        for most in (40, 2_048) if bits == 2 else (2_048,):
            assert {(r.u, r.v) for r in S.link_pairs(df, bits, most).collect()} == want


def test_keep_one_keeps_columns_and_one_row_a_group(spark):
    df = documents(spark)
    out = S.keep_one(df, "doc_id", "text")
    assert out.columns == df.columns
    kept = sorted(r.doc_id for r in out.filter(F.col("doc_id").isNotNull()).collect())
    comp = {c for i, _, c in slow_components([(r.doc_id, r.text) for r in df.collect()]) if i is not None}
    assert kept == sorted(comp)
    assert out.filter(F.col("doc_id").isNull()).count() == 1


def test_keep_one_keeps_other_texts_of_an_id(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(80)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, c, "y"), (2, c, "w"), (None, a, "n"), (4, a, "x")]
    schema = "id bigint, t string, row_id string"
    for _ in range(2):
        df = spark.createDataFrame(rows, schema).repartition(7)
        got = sorted(map(tuple, S.keep_one(df, "id", "t").collect()), key=str)
        assert got == sorted([(1, a, "x"), (1, b, "x"), (2, c, "w"), (None, a, "n")], key=str)
        rng.shuffle(rows)
    assert S.keep_one(df.limit(0), "id", "t").collect() == []


def test_query_columns_equal_brute_force(spark, tmp_path):
    rng = random.Random(13)
    base = [f"t{rng.randrange(300)}" for _ in range(300)]
    rows = [(i, " ".join(base[:i] + [f"n{i}"] + base[i + 1:]) if i % 3 else " ".join(sorted(base[i:i + 40])))
            for i in range(45)] + [(100, None), (101, ""), (102, "A b"), (103, "a B")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, Q.op7_simhash(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == sorted((i, f"{f:016x}", c) for i, f, c in slow_components(rows))
