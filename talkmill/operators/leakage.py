"""Leakage gate: talks or texts that share a run of words with held-out texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkmill.functions.metrics import ngrams, words

#: Rows of held-out grams that may be broadcast; above it the join shuffles on the gram.
BROADCAST_GRAMS = 200_000


def benchmark_grams(texts: DataFrame, column: str, n: int = 6) -> DataFrame:
    """Distinct n-word runs (gram) of the held-out texts."""
    return texts.select(words(F.col(column)).alias("w")).select(F.explode(ngrams("w", n)).alias("gram")).distinct()


def flagged(rows: DataFrame, ident: str, text: str, grams: DataFrame, n: int = 6) -> DataFrame:
    """(ident, first_gram, n_hits) of rows that hold a held-out run; runs may cross turn ends.

    The gram set is broadcast only after a count has shown it to be small.
    """
    each = rows.select(ident, words(F.col(text)).alias("w")).select(ident, F.posexplode(ngrams("w", n)).alias("pos", "gram"))
    small = grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    hit = each.join(F.broadcast(grams) if small else grams, "gram")
    return hit.groupBy(ident).agg(F.min_by("gram", "pos").alias("first_gram"), F.count(F.lit(1)).alias("n_hits"))


def without_leaks(rows: DataFrame, ident: str, text: str, grams: DataFrame, n: int = 6) -> DataFrame:
    return rows.join(flagged(rows, ident, text, grams, n).select(ident), ident, "left_anti")


def gate(rows: DataFrame, ident: str, text: str, grams: DataFrame, n: int = 6) -> None:
    """Fail closed: raise if any row leaks."""
    first = flagged(rows, ident, text, grams, n).select(ident).head()
    if first is not None:
        raise ValueError(f"held-out text found, first in {first[0]}")
