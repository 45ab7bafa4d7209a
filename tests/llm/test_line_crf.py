import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import documents
from ledgerflow.llm import line_crf as C
from ledgerflow.llm import queries as Q


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    per = np.array([1, 4, 2, 5])
    u, t = rng.normal(size=per.sum()), rng.normal(size=4)
    got, at = C.marginals(u, per, t), 0
    for n in per:
        x = u[at:at + n]
        good, total = np.zeros(n), 0.0
        for y in itertools.product((1, 0), repeat=int(n)):
            s = sum(x[k] for k in range(n) if y[k])
            s += sum(t[(0 if y[k] else 2) + (0 if y[k + 1] else 1)] for k in range(n - 1))
            total += np.exp(s)
            good += np.exp(s) * np.array(y)
        assert np.allclose(got[at:at + n], good / total)
        at += n


def test_pair_marginals_agree_with_line_marginals():
    rng = np.random.default_rng(1)
    per = np.array([3, 1, 6])
    u, t = rng.normal(size=per.sum()), rng.normal(size=4)
    inner = np.ones(len(u), dtype=bool)
    inner[np.cumsum(per) - per] = False
    pair, p = C.Field._pairs(u, per, t, inner), C.marginals(u, per, t)
    assert np.allclose(pair.sum(axis=0), 1)
    assert np.allclose(pair[0] + pair[2], p[inner]) and np.allclose(pair[0] + pair[1], p[np.flatnonzero(inner) - 1])


def test_a_text_is_scored_alike_in_any_company():
    rng = np.random.default_rng(2)
    field = C.Field(rng.normal(size=3 * C.OWN + 3), rng.normal(size=4))
    texts = ["Same. Same.\nSame. Same.", "Same. Same.", "", None, "x y\n\nx y", "A!! B!!\n| a | b |", "same same\nsame"]
    together = field.scores(texts)
    assert np.allclose(together, [field.scores([t])[0] for t in texts], rtol=1e-12)
    assert field.scores([""])[0] == field.scores([None])[0] and ((together >= 0) & (together <= 1)).all()


def test_without_both_labels_everything_is_even(spark):
    for labels in (np.empty(0, np.int64), np.ones(3, np.int64)):
        field = C.Field.fit([C.features(["a"])[0]] * len(labels), labels)
        assert field.scores(["a\nb", ""]).tolist() == [0.5, 0.5]


def test_odd_rows(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(0, 1, "a"), (7, 0, "a"), (8, 1, "a"), (3, 0, "a"), (None, 1, "a"), (2, None, "a"), (99, 1, "a")],
                                   "doc_id bigint, quality int, text string")
    own, y = C.sample(df, "doc_id", "text", labels, "doc_id", "quality")
    assert sorted(y.tolist()) == [0, 0, 1, 1, 1]  # row 0 comes twice
    field = C.Field.fit(own, y)
    got = df.select("text", C.score_column(df, "text", field).alias("q")).collect()
    assert np.allclose([r.q for r in got], [field.scores([r.text])[0] for r in got], rtol=1e-12)
    none = df.limit(0)
    assert none.select(C.score_column(none, "text", field).alias("q")).collect() == []
    assert len(C.sample(none, "doc_id", "text", labels, "doc_id", "quality")[1]) == 0
    assert len(C.sample(df, "doc_id", "text", labels, "doc_id", "quality", size=2)[1]) <= 2


def test_every_line_of_every_labelled_document_is_learnt_from(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "STEPS", 6)
    monkeypatch.setattr(C, "LINES", 500)  # several parts a task
    # 4,200 labelled texts, three quarters not held out; one has 130 lines, the last 30 unlike the others
    texts = {i: f"Text {i} is good." if i % 3 else "|| ## 1 1 1\n" * (1 + i % 5) for i in range(4_200)}
    texts[4] = "A plain line.\n" * 100 + "@@ @@ 77\n" * 29 + "@@ @@ 77"
    spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learnt) > 3_000 and 4 in learnt
    own = [C.features([texts[i]])[0].astype(np.float32).astype(np.float64) for i in learnt]
    want = C.Field.fit(own, np.array([int(i % 3 > 0) for i in learnt]))
    got = Q.quality_field(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert got.fitted and np.allclose(got.w, want.w, atol=1e-8) and np.allclose(got.t, want.t, atol=1e-8)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op3_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97 and np.mean([p == y for _, y, p in held]) > 0.95
