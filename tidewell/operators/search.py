"""Text search over table rows: exact (words, prefixes, substrings) and fuzzy (trigrams and edit distance)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[^\p{L}\p{Nd}]+"
#: Least similarity of a fuzzy match. Fixed value.
FUZZY_LEAST = 0.3


def text_of(columns: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def trigrams(token: Column) -> Column:
    padded = F.concat(F.lit("$"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))


def search_exact(df: DataFrame, columns: list[str], query: str, key: str, k: int = 100) -> DataFrame:
    """Rows in which every word of the query is a token, a token's prefix or a substring, or the whole query is a substring."""
    text = text_of(columns)
    want = query.lower()
    words = [w for w in re.split(r"[\W_]+", want) if w]
    match = F.instr(text, want) > 0
    if words:
        every = F.lit(True)
        for w in words:
            every = every & (F.instr(text, w) > 0)  # a token or its prefix is a substring too
        match = match | every
    return df.filter(match).withColumn("_score", F.lit(1.0)).orderBy(key).limit(k)


def search_fuzzy(df: DataFrame, columns: list[str], query: str, key: str, k: int = 100, least: float = FUZZY_LEAST) -> DataFrame:
    """The k best rows by their best token: the larger of trigram Jaccard and 1 - edit distance / longer length.

    A token is looked at if it shares a trigram with the query.
    """
    want = F.lit(query.lower())
    mine = trigrams(want)

    def score(t: Column) -> Column:
        own = trigrams(t)
        both = F.size(F.array_intersect(own, mine))
        jaccard = both / F.size(F.array_union(own, mine))
        edit = 1 - F.levenshtein(t, want) / F.greatest(F.length(t), F.length(want))
        return F.when(both > 0, F.greatest(jaccard, edit)).otherwise(0.0)

    best = F.array_max(F.transform(F.array_distinct(tokens(text_of(columns))), score))
    return df.withColumn("_score", best).filter(F.col("_score") >= least).orderBy(F.desc("_score"), key).limit(k)
