import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerflow.llm import minhash as M
from cases import LONG, TEXTS, documents, sentence


def shingles(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    k = min(words, len(w))
    return {b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


def slow(rows, percent=85):
    """Sorted (id, n, component) by comparing all pairs of full sets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)].append(d)
    return sorted(((d, len(s), min(least[top(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))),
                  key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id bigint, text string, n int, node string")
    return sorted(map(tuple, M.components(df.repartition(5), "doc_id", "text", **kw).collect()), key=str)


def drawn(seed, n=260):
    """Copies, chains of near copies, and a passage that a third of the documents share."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    texts = []
    while len(texts) < n:
        kind = rng.randrange(6)
        base = sentence(rng, rng.randrange(1, 120))
        if kind < 2:  # the passage with some words of its own: alike, mostly not enough
            texts.append(passage + sentence(rng, rng.randrange(0, 25)))
        elif kind == 2:
            texts += [list(base) for _ in range(rng.randrange(2, 5))]
        elif kind == 3:  # each a word or two from the one before
            for _ in range(rng.randrange(2, 12)):
                base = list(base)
                base[rng.randrange(len(base))] = f"n{rng.randrange(9)}"
                texts.append(base)
        else:
            texts.append(base)
    return [(i, rng.choice([" ", "  ", "\n"]).join(t).title()) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = drawn(1)
    assert run(spark, rows) == slow(rows)


def test_equals_brute_force_in_pairs_of_blocks(spark):
    rows = drawn(2)
    assert run(spark, rows, block=3) == slow(rows)


def test_odd_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t != LONG] + [(0, TEXTS[0]), (None, TEXTS[0]), (None, "alone here")]
    rows += [(50, "One two"), (51, "one TWO"), (52, "one two three"), (53, "one two three four"), (54, "É É"), (55, "é é")]
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows[:0]) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    got = M.components(documents(spark), "doc_id", "text")
    assert got.columns == ["id", "n", "component"]
    assert got.filter(F.col("id") == 7).first()["n"] == len(shingles(LONG))


def test_a_large_group_of_copies_and_one_of_near_copies(spark):
    rng = random.Random(8)
    base = sentence(rng, 200)
    rows = [(i, " ".join(base)) for i in range(5000)]  # past the rows that a task takes of one key
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"z{i}"
        rows.append((10_000 + i, " ".join(w)))
    rows.append((20_000, " ".join(sentence(rng, 200))))
    got = run(spark, rows)
    assert {c for d, _, c in got if d < 20_000} == {0} and (20_000, 198, 20_000) in got


def test_similar_sets_agree_in_sketch():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2 ** 63, 300, dtype=np.uint64))
        a = pool[:int(rng.integers(1, len(pool)))]
        drop = int(len(a) * 0.07)
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2 ** 63, drop, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            s = M.sketches(M.minhashes([a, b]))
            assert M.agreeing(s[:1, 0], s[:1, 1], s[1:, 0], s[1:, 1])[0] >= M.AGREE


def test_agreeing_counts_equal_four_bit_values():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 2 ** 63, (50, M.HASHES), dtype=np.uint64)
    m[25:, ::3] = m[:25, ::3]
    s = M.sketches(m)
    nib = M.mix64(m) >> np.uint64(60)
    got = M.agreeing(s[:25, 0], s[:25, 1], s[25:, 0], s[25:, 1])
    assert got.tolist() == (nib[:25] == nib[25:]).sum(1).tolist()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(sentence(random.Random(2), 5000)) + "é" * 50
    whole = M.shingle_sets([text, "a b c d", ""])
    monkeypatch.setattr(M, "CHUNK_CHARS", 64)
    cut = M.shingle_sets([text, "a b c d", ""])
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]
    assert len(cut[0]) == len(shingles(text))
