"""Token counts of whole texts by a two-tier lookup on the map side.

The tokenizer never merges across the start of a run of spaces (no piece of a
supported vocabulary has a space mark after another character), so a text's
count is the sum over its pre-tokens: a run of spaces and what follows up to
the next.  Tier one is a table of the lengths of frequent pre-tokens, broadcast
to all tasks (at most ``TABLE_WORDS`` entries of at most 64 characters).  What
misses it is encoded once per worker and kept in a second, bounded tier.
The table is chosen by exact counts of the pre-tokens of all texts, which are
exchanged once, added up.

A null text counts as empty (0 bytes, 0 tokens); repeated rows, nulls in other
columns and clashing names change nothing, as one text is read and columns are
appended under names of the caller's choice.  Texts of any length are taken
whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import ship, top_words

MODEL = "piece_bpe_32k.model"
TABLE_WORDS = 32_768
CACHE_WORDS = 250_000
CACHE_CHARS = 64
SPACE = "▁"  # the vocabulary's mark for a space
_PRE = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")


def split(text: str) -> list[str]:
    """Pre-tokens of a text, the first with the space the tokenizer puts before it."""
    return _PRE.findall(" " + text) if text else []


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The processor, after a check that its pieces allow the split."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    if any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in range(n)):
        raise ValueError("a piece goes across the start of a word; pre-tokens can't be counted alone")
    return sp


def length(sp, word: str) -> int:
    """Tokens of one pre-token; the processor puts its first space back."""
    return len(sp.encode(word[1:])) if len(word) > 1 else 1  # a space alone is one piece


class Lookup(dict):
    """Pre-token to length: the broadcast table, then the worker's own cache."""

    def __init__(self, table: dict[str, int], model: bytes):
        super().__init__(table)
        self._sp, self._full = load(model), len(table) + CACHE_WORDS

    def __missing__(self, word: str) -> int:
        n = length(self._sp, word)
        if len(word) <= CACHE_CHARS and len(self) < self._full:
            self[word] = n
        return n


_LOOKUPS: dict[int, Lookup] = {}


def _worker_lookup(sent) -> Lookup:
    """This worker's lookup for a broadcast (kept between its tasks)."""
    if sent.id not in _LOOKUPS:
        _LOOKUPS.clear()
        table, model = sent.value.values()
        _LOOKUPS[sent.id] = Lookup(table, model)
    return _LOOKUPS[sent.id]


class _Sent:
    """A broadcast with an id that tasks can key their cache by."""

    def __init__(self, broadcast):
        self._broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}

    @property
    def value(self):
        return self._broadcast.value


def count_column(df: DataFrame, text_col: str, model_path: str | None = None,
                 table_words: int = TABLE_WORDS) -> F.Column:
    """Column: tokens of each whole text, without begin, end or added tokens."""
    spark = df.sparkSession
    ship(spark)
    with open(model_path or public_tokenizers.path(MODEL), "rb") as f:
        model = f.read()
    sp = load(model)
    table = {w: length(sp, w) for w in top_words(df, text_col, split, table_words)}
    sent = _Sent(spark.sparkContext.broadcast({"table": table, "model": model}))

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        get = _worker_lookup(sent).__getitem__
        return pa.array([sum(map(get, split(t))) if t else 0 for t in texts.to_pylist()], pa.int64())

    return tokens(F.col(f"`{text_col}`"))
