import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cases import documents
from ledgerflow.llm import queries as Q
from ledgerflow.llm import token_counts as T
from ledgerflow.llm import shared
from ledgerflow.llm import transducer as X

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.MODEL))
BYTES = Tokenizer.from_file(public_tokenizers.path(X.MODEL))
with open(public_tokenizers.path(T.MODEL), "rb") as f:
    LOOKUP = T.Lookup({}, f.read())
with open(public_tokenizers.path(X.MODEL), encoding="utf-8") as f:
    MODEL = f.read()
ENCODER, DECODER = X.Encoder(MODEL), X.Decoder(MODEL)
ODD = st.text(st.sampled_from(" ▁ab\n\tthe<s>é0９ｱ　|endoftx's½\u0301中🎉\u200b\x1c\x85"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text(max_size=30)))
def test_counts_equal_the_library(text):
    assert sum(map(LOOKUP.__getitem__, T.split(text))) == len(PIECES.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text(max_size=30), st.just("a<|endoftext|><|endoftext|> b")))
def test_ids_and_text_equal_the_library(text):
    ids, lens = ENCODER.encode([text, None, text])
    want = BYTES.encode(text, add_special_tokens=False).ids
    assert lens.tolist() == [len(want), 0, len(want)] and ids.tolist() == want + want
    assert DECODER.decode(np.array(want, dtype=np.int64)) == BYTES.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=12))
def test_decoding_any_ids(ids):
    assert DECODER.decode(np.array(ids, dtype=np.int64)) == BYTES.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=6), min_size=1, max_size=60), st.lists(st.binary(max_size=6), max_size=40))
def test_transducer_numbers_its_words(words, others):
    auto = X.Transducer.compile(sorted(words))
    ask = sorted(words) + others
    lens = np.array([len(w) for w in ask])
    got = auto.numbers(np.frombuffer(b"".join(ask) + b"\0", dtype=np.uint8), np.cumsum(lens) - lens, lens)
    number = {w: i for i, w in enumerate(sorted(words))}
    assert got.tolist() == [number.get(w, -1) for w in ask]


def test_transducer_shares_suffixes():
    words = sorted(a + b"ing" + c for a in (b"walk", b"talk", b"jump", b"sing") for c in (b"", b"s", b"ly"))
    assert len(X.Transducer.compile(words).final) < sum(map(len, words)) / 3


def test_lexicon_file_round_trip(tmp_path):
    words = [" the", "the", " of", "é", " \n", "123"]
    path = tmp_path / "words.lexicon"
    path.write_bytes(X.build_lexicon(words, ENCODER))
    enc = X.Encoder(MODEL, X.map_lexicon(str(path)))
    assert isinstance(enc.lexicon["ids"], np.memmap)
    text = "the of the é 123\n unseenword" * 3
    assert enc.encode([text])[0].tolist() == BYTES.encode(text, add_special_tokens=False).ids
    assert not {"the", " of"} & set(enc.cache) and " unseenword" in enc.cache


def test_tallies_add_up_to_the_whole():
    texts = ["a b a", None, "", "b c " * 50, "x" * 65 + " a", " ".join(f"w{i}" for i in range(40)), "c"]
    batches = [pa.RecordBatch.from_pydict({"t": pa.array(texts[k:k + 3], pa.string())}) for k in (0, 3, 6)]
    want = Counter(w for t in texts if t for w in X.split(t) if len(w) <= 64)
    for words, chars in ((5, 10**6), (10**6, 20), (10**6, 10**6)):
        got = Counter()
        for b in shared.tallies(batches, X.split, words, chars):
            for r in b.to_pylist():
                got[r["word"]] += r["n"]
        assert got == want


def test_lexicon_counts_all_texts(spark, monkeypatch):
    # 12,780 texts of 40 words whose counts differ by one each, and a few odd ones
    names = [a + b for a in "abcdefgh" for b in "vwxyz"]
    df = spark.createDataFrame([(w, 300 + k) for k, w in enumerate(names)], "t string, n int")
    df = df.selectExpr("explode(array_repeat(t, n)) t").union(
        spark.createDataFrame([("once",), ("x" * 65,), (None,), ("",)], "t string")).repartition(5)
    asked = []
    monkeypatch.setattr(X, "build_lexicon", lambda words, encoder: asked.append(words) or b"")
    for size in (25, 1_000):
        X.ids_column(df, "t", lexicon_words=size)
    assert asked == [names[:14:-1], [*names[::-1], "once"]]


def test_frequent_pre_tokens_of_all_texts(spark, monkeypatch):
    # one text a partition, one word a text; each word has one text more than the word before it
    words = [a + b for a in "abcd" for b in "vwxyz"]
    rows = [(w,) for k, w in enumerate(words) for _ in range(k + 1)]
    df = spark.createDataFrame(rows, "t string").repartition(len(rows))
    asked = []
    monkeypatch.setattr(T, "length", lambda sp, w: asked.append(w) or 1)
    T.count_column(df, "t", table_words=15)
    assert asked == [" " + w for w in words[:4:-1]]


def test_counts_of_odd_rows(spark):
    df = documents(spark)
    got = df.select("doc_id", "text", T.count_column(df, "text", table_words=50).alias("n")).collect()
    assert len(got) == df.count()
    assert all(r.n == len(PIECES.encode(r.text or "")) for r in got)
    none = df.limit(0)
    assert none.select(T.count_column(none, "text").alias("n")).collect() == []


def test_encode_decode_of_odd_rows(spark):
    df = documents(spark)
    ids = df.select("*", X.ids_column(df, "text", lexicon_words=100).alias("ids"))
    got = ids.select("text", "ids", X.text_column(ids, "ids").alias("back")).collect()
    for r in got:
        assert r.ids == BYTES.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "")
    missing = spark.createDataFrame([(None,), ([],), ([None, 262],)], "ids array<int>")
    assert [r.t for r in missing.select(X.text_column(missing, "ids").alias("t")).collect()] == ["", "", " the"]
    none = df.limit(0)
    assert none.select(X.ids_column(none, "text").alias("n")).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_queries(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op2_token_counts(spark, sf).collect():
        n = len(PIECES.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    for r in Q.op4_bpe(spark, sf).collect():
        ids = BYTES.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = BYTES.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
