import math
import random
from collections import Counter

import numpy as np

from cases import documents, sentence
from ledgerflow.llm import ngram_lm as L


def slow(rows):
    docs = [(i, (t or "").replace("\n", " ").replace("\t", " ").split(" ")) for i, t in rows]
    docs = [(i, [w for w in d if w]) for i, d in docs]
    one, two = Counter(), Counter()
    for _, w in docs:
        one.update(w)
        two.update(zip(w, w[1:]))
    total, out = sum(one.values()), []
    for i, w in docs:
        o1, o2, s = Counter(w), Counter(zip(w, w[1:])), 0.0
        rest = max(total - len(w), 1)
        for k, x in enumerate(w):
            low = max(one[x] - o1[x], 0.4) / rest
            if k == 0:
                s += math.log(low)
                continue
            pair = (w[k - 1], x)
            c = two[pair] - o2[pair]
            s += math.log(c / max(one[w[k - 1]] - o1[w[k - 1]], 1) if c > 0 else 0.4 * low)
        out.append((i, len(w), s))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], round(r[2], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(sentence(rng, rng.randint(0, 60), 40))) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    for buckets in (L.BUCKET_KEYS, 300):
        same(L.score(df.repartition(5), "id", "t", buckets).collect(), slow(rows))


def test_odd_rows(spark):
    df = documents(spark)
    got = L.score(df, "doc_id", "text").collect()
    same(got, slow([(r.doc_id, r.text) for r in df.collect()]))
    assert L.score(df.limit(0), "doc_id", "text").collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, L.score(empty, "doc_id", "text").collect())) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_repeated_chunks_stay_apart(spark):
    one = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id bigint, text string").coalesce(1)
    rows = [(1, "a b c"), (2, "a b d")] * 2
    same(L.score(one.unionByName(one), "doc_id", "text").collect(), slow(rows))


def test_packing():
    for x in (np.array([], np.uint64), np.array([0, 2 ** 63, 5], np.uint64), np.arange(-3, 3)):
        assert L.unpack(L.pack(x), len(x), x.dtype).tolist() == x.tolist()
