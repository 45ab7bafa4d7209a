"""Substring search through a table of trigrams.

``build`` lists, for every three letters in a row (lower case) of the searched
columns, the ids of the rows that have them.  The list is sorted by trigram
over all files, so a search reads only the row groups of its own trigrams, and
a common trigram is spread over as many files as it fills.  ``search`` takes
the trigrams that any match must have, keeps the ids listed under all of them
and puts the exact case-insensitive test to those rows only.

The text is a pattern as in the scan: ``%`` and ``_`` stay wildcards, so
trigrams are taken from the plain stretches between them.  A text without a
plain stretch of three letters is answered by the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_for_join, store
from . import filters as FL

S = F.col
GRAM = 3


def build(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Stored (gram, id), sorted by gram; rows with a NULL id are left to the scan."""
    def grams(c: str):
        text = F.lower(S(c))
        at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
        return F.when(F.length(text) >= GRAM, F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))

    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*[F.coalesce(grams(c), none) for c in cols]))
    listed = df.filter(S(id_col).isNotNull()).select(F.explode(every).alias("gram"), S(id_col).alias("id"))
    return store(listed.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"))


def needed(text: str) -> list[str]:
    """Trigrams that every match of the pattern has (from plain ASCII stretches)."""
    plain = re.split(r"\\.|[%_\\]", text)
    return sorted({g for run in plain for k in range(len(run) - GRAM + 1)
                   if (g := run[k:k + GRAM].lower()).isascii() and len(g) == GRAM})


def search(df: DataFrame, id_col: str, cols: list[str], text: str | None, postings: DataFrame) -> DataFrame:
    """The rows ``filters.search`` gives, found through ``postings`` of the same table."""
    grams = needed(text or "")
    if not grams:
        return FL.search(df, cols, text)
    ids = (postings.filter(S("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("n"))
           .filter(S("n") == len(grams)).select(S("id").alias("__id")))
    found = df.join(cut_for_join(ids), S(id_col) == S("__id"), "left_semi")
    return FL.search(found.unionByName(df.filter(S(id_col).isNull())), cols, text)
