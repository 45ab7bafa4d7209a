import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerflow.llm import periodic as P
from ledgerflow.llm import queries as Q
from cases import LONG, documents


def slow(w):
    """Every lag, every stretch: (start, length, smallest period)."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def left(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def drawn(rng):
    n, v = rng.randrange(300), rng.choice([1, 2, 3, 5, 40])
    w = [str(rng.randrange(v)) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a, p = rng.randrange(n), rng.randrange(1, 60)
        for i in range(a, min(n, a + rng.randrange(1, 280))):
            w[i] = w[a + (i - a) % p]
    return w


def test_equals_brute_force_on_drawn_texts():
    rng = random.Random(11)
    for _ in range(120):
        texts = [drawn(rng) for _ in range(6)]
        for w, (n, runs, rest) in zip(texts, P.reports([" ".join(w) for w in texts])):
            want = slow(w)
            assert (n, runs, rest) == (len(w), want, left(w, want))


def test_one_word_two_words_and_nested_runs():
    w = (["a"] * 6 + ["b"]) * 8
    assert P.reports([" ".join(w)])[0][1] == slow(w)
    assert P.reports([" ".join(["x"] * 5), " ".join(["x"] * 6), "a b " * 4])[0][1] == []
    assert P.reports([" ".join(["x"] * 6)])[0] == (6, [(0, 6, 1)], "x")
    assert P.reports(["a b " * 4])[0] == (8, [(0, 8, 2)], "a b")


def test_long_repetitive_texts_stay_sparse():
    n = 120_000
    for unit in (["a"], ["a", "b", "c"], [f"w{k % 700}" for k in range(9_000)]):
        w = (unit * (n // len(unit) + 1))[:n]
        got = P.reports([" ".join(w)])[0]
        assert max(got[1], key=lambda r: r[1])[:2] == (0, n)
        assert len(got[2].split()) <= len(unit)


def test_longer_bounds_of_length_and_exponent():
    w = ["a", "b"] * 3 + ["c"] + ["d"] * 9
    assert P.reports([" ".join(w)], min_length=6, min_exponent=3)[0][1] == [(0, 6, 2), (7, 9, 1)]
    assert P.reports([" ".join(w)], min_length=10)[0][1] == []


def test_query_on_odd_documents(spark, tmp_path):
    texts = ["", None, "  \n ", "one", "go go go go go go stop", "A a A a A a A a", LONG, "é " * 9, "x\x0by\x1cz " * 7]
    texts += [" ".join(f"w{k * k % 31}" for k in range(400))] * 30  # some get a repeated tail
    docs = documents(spark, texts).withColumnRenamed("score", "runs")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in Q.op11_periodic_runs(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[0]) == 2 and len(got[None]) == 1
    edited = 0
    for d, t in enumerate(texts):
        w = (t or "").encode().split()
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, o = h // 10, list(w)
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [o[i] if i < a else o[a + (i - a) % p] for i in range(len(w))]
            edited += 1
        runs = slow(w) if d != 6 else P.reports([b" ".join(w).decode()])[0][1]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        for r in got[d]:
            assert r["n_runs"] == len(runs)
            assert (r["start"], r["length"], r["period"]) == tuple(best)
            assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
            assert r["collapsed_sha256"] == hashlib.sha256(rest).hexdigest()
    assert edited


def test_empty_table_and_own_edit(spark):
    df = documents(spark)
    none = df.limit(0).select(P.report_column(df, "text").alias("r"))
    assert none.collect() == [] and none.schema["r"].dataType.simpleString() == P.REPORT
    back = df.filter("doc_id = 6").select(P.report_column(
        df, "text", "doc_id", lambda i, n: np.zeros(8 * n, dtype=int)).alias("r")).select(F.col("r.runs")).first()
    assert [tuple(x) for x in back["runs"]] == [(0, 8, 1)]
