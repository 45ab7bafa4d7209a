import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cases import documents, LONG
from ledgerflow.llm import decontaminate as D
from ledgerflow.llm import pii, queries, simhash, transducer

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    docs = documents(spark).withColumn("n_chars", F.length("text").cast("bigint"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and all(r.decodes for r in last)
    masked = P.personal_data(spark, docs, SF).filter("doc_id = 0").first()
    assert "[IP]" in masked.text and "[EMAIL]" in masked.text and masked.n_chars == len(masked.text)


def test_run_equals_the_stages_by_hand(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    score = {r.doc_id: r.predicted for r in queries.op3_quality(spark, SF).collect()}
    kept = {i: t for i, t in rows.items() if score[i]}
    fp = {i: simhash.fingerprint(t) for i, t in kept.items()}
    group = {i: i for i in kept}
    for _ in kept:
        new = {i: min(group[j] for j in kept if (fp[i] ^ fp[j]).bit_count() <= 2) for i in kept}
        if new == group:
            break
        group = new
    kept = {i: t for i, t in kept.items() if group[i] == i}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = D.Index([r.item_id for r in items], [r.text for r in items])
    kept = {i: pii.mask(t) for i, t in kept.items() if not index.matches([t])[0]}
    got = P.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(kept) and len(got) == len(kept)
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in got)


def test_last_stage_counts_the_words_of_all_texts(spark, monkeypatch):
    # 12,780 texts, one word each; the counts differ by one
    names = [a + b for a in "abcdefgh" for b in "vwxyz"]
    docs = spark.createDataFrame([(w, 300 + k) for k, w in enumerate(names)], "text string, n int").selectExpr(
        "explode(array_repeat(text, n)) text", "monotonically_increasing_id() doc_id")
    asked = []
    build = transducer.build_lexicon
    monkeypatch.setattr(transducer, "build_lexicon", lambda words, enc: asked.append(words) or build(words, enc))
    assert P.token_ids(spark, docs, SF).filter("decodes").count() == 12_780
    assert asked == [names[::-1]]


def test_repeated_ids_and_missing_labels_lose_no_rows(spark, tmp_path):
    rows = [(1, "one text of this id is here for good measure and stays"), (1, LONG[:3000]), (2, None), (None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for quality in ([], [(1, 1, 0)], [(1, None, 0)]):
        folder = tmp_path / f"labels-{len(quality)}-{bool(quality and quality[0][1])}"
        spark.createDataFrame(quality, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert P.quality(spark, docs, str(folder)).count() == 4
    assert sorted(map(tuple, P.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(queries.ORACLES[name])
    cols = sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert [tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in got] == [
        tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in want]
