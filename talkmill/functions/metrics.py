"""Text metrics as column expressions; words are runs of a-z and apostrophes in lower case."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from talkmill.functions import lexicons as lex


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def ngrams(seq: str, n: int) -> Column:
    """All runs of ``n`` words of the array column ``seq``, joined by a space. Materialize ``seq`` first."""
    return F.expr(
        f"if(size({seq}) >= {n}, transform(sequence(1, size({seq}) - {n - 1}), i -> array_join(slice({seq}, i, {n}), ' ')), cast(array() as array<string>))"
    )


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def repeated_ratio(grams: Column) -> Column:
    """Share of n-grams that repeat an earlier one of the same text."""
    return ratio(F.size(grams) - F.size(F.array_distinct(grams)), F.size(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common.cast("double") / F.size(F.array_union(a, b)))


def copy_ratio(said: str, asked: str) -> Column:
    """Share of the words of ``said`` that stand in ``asked`` too."""
    return ratio(F.size(F.expr(f"filter({said}, w -> array_contains({asked}, w))")), F.size(said))


def contains_any(low: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def hits(low: Column, phrases) -> Column:
    """How many of the phrases stand in the text."""
    return reduce(add, [F.contains(low, F.lit(p)).cast("int") for p in phrases])


def ungrammatical(text: Column, seq: str) -> Column:
    """Signs of broken language: no words, a word twice in a row, no vowels, few distinct words, a letter five times."""
    size = F.size(seq)
    twice = F.expr(f"exists(sequence(1, greatest(size({seq}) - 1, 1)), i -> get({seq}, i) = get({seq}, i - 1))")
    mute = F.size(F.expr(f"filter({seq}, w -> not w rlike '[aeiouy]')"))
    return (
        (size == 0)
        | (twice & (size > 2))
        | (mute / size > 0.35)
        | ((size > 4) & (F.size(F.array_distinct(seq)) / size < 0.45))
        | text.rlike(r"(?s)(.)\1{4,}")
    )


def wilson(passed: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a pass rate."""
    p = passed.cast("double") / total
    mid = p + z * z / (2 * total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    whole = 1 + z * z / total
    return F.greatest(F.lit(0.0), (mid - half) / whole), F.least(F.lit(1.0), (mid + half) / whole)


def valence(low: Column) -> Column:
    bad, good = hits(low, lex.NEGATIVE_CUES), hits(low, lex.POSITIVE_CUES)
    return F.when(bad > good, "negative").when(good > bad, "positive").otherwise("neutral")


def topic(low: Column) -> Column:
    """The topic with most keywords in the text, the first one on a tie; null without any."""
    scores = F.array(*[F.struct(hits(low, v).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("topic")) for i, (k, v) in enumerate(lex.TOPIC_KEYWORDS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["topic"])


def mood(low: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(low, v), F.lit(k)) for k, v in lex.MOOD_WORDS.items()])


def learning_rate(step: Column, base: float, warmup: int, total: int, least: float = 0.1, kind: str = "cosine") -> Column:
    """Warm-up, then cosine, linear or constant decay down to ``least`` of the base rate."""
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    falls = {
        "cosine": F.lit(least) + (1 - least) * 0.5 * (1 + F.cos(F.pi() * done)),
        "linear": F.lit(least) + (1 - least) * (1 - done),
        "constant": F.lit(1.0),
    }
    return F.when(step < warmup, base * (step + 1) / float(max(1, warmup))).otherwise(base * falls[kind])


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))
