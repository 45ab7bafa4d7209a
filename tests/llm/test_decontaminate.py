import itertools
import random

from cases import documents, sentence
from ledgerflow.llm import decontaminate as D
from ledgerflow.llm import queries as Q


def slow(text, items):
    """Items of which some diagonal has a long, like enough stretch (all diagonals, all stretches)."""
    import re
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    t, out = tok(text), set()
    for i, item in items:
        q = tok(item)
        if len(q) < D.WEIGHT:
            continue
        least = min(D.MIN_TOKENS, len(q))
        for diag in range(-len(q) + 1, len(t)):
            lo, hi = max(0, -diag), min(len(q), len(t) - diag)
            same = [t[k + diag] == q[k] for k in range(lo, hi)]
            if len(same) >= least and any(sum(same[a:b]) * 5 >= 4 * (b - a) for a, b in (
                    (a, b) for a in range(len(same)) for b in range(a + least, len(same) + 1))):
                out.add(i)
                break
    return out


def found(texts, items, **kw):
    index = D.Index([i for i, _ in items], [t for _, t in items])
    return [{m[0] for m in x} for x in index.matches(texts)]


def test_any_three_substitutions_in_fifteen_tokens():
    item = [f"t{k}" for k in range(15)]
    texts = []
    for gone in itertools.combinations(range(15), 3):
        w = list(item)
        for k in gone:
            w[k] = "other"
        texts.append(" ".join(["before"] * 7 + w + ["after"] * 7))
    assert all(x == {1} for x in found(texts, [(1, " ".join(item))]))


def test_any_substitution_in_six_tokens():
    item = list("abcdef")
    texts = [" ".join(["z"] * 3 + item[:k] + ["other"] + item[k + 1:] + ["z"] * 3) for k in range(6)]
    assert found(texts, [(1, " ".join(item))]) == [{1}] * 6


def test_equals_brute_force_on_mixed_texts():
    rng = random.Random(7)
    items = [(i, " ".join(sentence(rng, rng.randint(4, 40), 300))) for i in range(12)]
    texts = []
    for _ in range(60):
        w = sentence(rng, rng.randint(0, 60), 300)
        i = rng.randrange(12)
        part = items[i][1].split()
        for _ in range(rng.randint(0, len(part) // 4)):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randint(0, len(w))
        texts.append(" ".join(w[:at] + part + w[at:]).upper().replace(" ", ", "))
    got, want = found(texts, items), [slow(t, items) for t in texts]
    assert sum(map(len, want)) > 40 and got == want


def test_clean_texts_and_short_items():
    rng = random.Random(1)
    texts = [" ".join(sentence(rng, 80)) for _ in range(30)]
    items = [(1, "yes"), (2, ""), (3, None), (4, "one two three four"), (5, " ".join(sentence(rng, 30)))]
    assert found(texts + ["yes", "one two three four"], items) == [set()] * 32
    assert found(["", None, "a"], [(5, "a b c d e f")]) == [set()] * 3
    assert found(["x a b c d e f y"], [(5, "A b c. D e f")]) == [{5}]


def test_odd_rows_and_blocks(spark):
    df = documents(spark)
    items = spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dog", "x"), (8, None, "x"), (None, "word1 word2 word3 word4 word5", "x"),
                                   (7, "the quick brown fox jumps over the lazy dog", "x")], "item_id int, text string, doc_id string")
    for size in (D.BLOCK_CHARS, 30):
        got = df.select("doc_id", "text", D.matches_column(df, "text", items, "item_id", "text", size).alias("m")).collect()
        for r in got:
            ids = [x.item_id for x in r.m]
            if r.text and "fox" in r.text:
                assert ids == [7, 7] and {(x.start, x.end, x.equal) for x in r.m} == {(0, 9, 9)}
            elif r.text and r.text.startswith("word0"):
                assert set(ids) == {None}
            else:
                assert ids == []
    none = items.limit(0)
    assert all(not r.m for r in df.select(D.matches_column(df, "text", none, "item_id", "text").alias("m")).collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = Q.op1_decontamination(spark, sf).collect()
    assert len(rows) == len(docs)
    whole = {d for d, t in docs.items() if any(i in t for _, i in items)}
    assert whole <= {r.doc_id for r in rows if r.contaminated}
    for r in rows:
        assert r.contaminated == bool(r.items) and r.n_items == len([x for x in r.items.split(",") if x])
        if r.contaminated:
            assert {int(x) for x in r.items.split(",")} <= slow(docs[r.doc_id], items)
