"""Documents that every operator must take: nulls, empty and long texts, repeats, odd columns."""

import random

LONG = " ".join(f"word{i % 977}" for i in range(60_000))

TEXTS = [
    "The quick brown fox jumps over the lazy dog.\nIt barks at 10.0.0.1 and a.b@c.org today.",
    "The quick brown fox jumps over the lazy dog.\nIt barks at 10.0.0.1 and a.b@c.org today.",
    "", None, " ", "\n\n", "a", LONG, "Ünïcödé ﬁn 中文 🎉 <|endoftext|> <s> ▁x", "x" * 5000,
]


def documents(spark, texts=None, extra=True):
    """(doc_id, text) with a repeated row, a null id and columns whose names clash with results."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t, f"s{i % 3}", 1.5, "k") for i, t in enumerate(texts)]
    if texts:
        rows += [rows[0], (None, texts[0], None, None, None)]
    schema = "doc_id bigint, text string, source string, score double, fp string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text")


def sentence(rng: random.Random, n: int, words: int = 4000) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]
