"""Scoring candidates and choosing the best one: heuristic and precomputed scores, rejection sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.functions import lexicons as lex
from talkmill.functions.metrics import contains_any, copy_ratio, hits, jaccard, ngrams, repeated_ratio, ungrammatical, valence, words


def clip(x: Column) -> Column:
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), x.cast("double"))), 3)


def candidates(conversations: DataFrame) -> DataFrame:
    """(id, place, text, asked, earlier): one row per candidate with its context."""
    context = F.expr("if(element_at(messages, -1).role = 'assistant', slice(messages, 1, size(messages) - 1), messages)")
    staged = conversations.select("id", context.alias("c"), F.posexplode("candidates").alias("place", "candidate"))
    users = F.expr("filter(c, m -> m.role = 'user')")
    replies = F.expr("transform(filter(c, m -> m.role = 'assistant'), m -> coalesce(m.content, ''))")
    return staged.select(
        "id", "place", F.trim(F.coalesce("candidate.content", F.lit(""))).alias("text"),
        F.coalesce(F.get(users, F.size(users) - 1)["content"], F.lit("")).alias("asked"),
        F.slice(replies, F.greatest(F.size(replies) - 3, F.lit(1)), 4).alias("earlier"),
        F.col("candidate.scores").alias("given"), F.col("candidate.score").alias("given_score"),
    )


def heuristic_scores(rows: DataFrame, low: int = 3, high: int = 25, hard_max: int = 45) -> DataFrame:
    """Adds the eight dimensions (1 to 5) of each candidate."""
    s = rows.withColumn("low", F.lower("text")).withColumn("w", words(F.col("text"))).withColumn("u", words(F.col("asked")))
    s = s.withColumn("g3", ngrams("w", 3)).withColumn("n", F.size("w")).withColumn("copy", copy_ratio("w", "u"))
    s = s.withColumn("back", contains_any(F.col("low"), lex.BACKCHANNEL)).withColumn("q", F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit(""))))
    s = s.withColumn("mood", valence(F.lower("asked")))
    n, l = F.col("n"), F.col("low")
    brevity = F.when(n < low, 2.5 + n * 0.5).when(n <= high, 5.0).otherwise(F.greatest(F.lit(1.0), 5.0 - (n - high) * 0.15))
    essay = F.col("text").rlike(r"^\p{Lu}") & F.col("text").rlike(r"[.!?]$") & (n > 20)
    natural = (
        4.0 - F.when(ungrammatical(F.col("text"), "w"), 2.5).otherwise(0.0)
        + F.when(l.rlike(r"\b(?:i'?m|it'?s|that'?s|don'?t|yeah|nah|lol|haha|kinda)\b"), 0.75).otherwise(0.0) - F.when(essay, 0.25).otherwise(0.0)
    )
    hook = clip(2.0 + 6.0 * F.least(jaccard(F.col("w"), F.col("u")), F.lit(0.4)))
    relevance = F.when((F.col("copy") > 0.85) & (n >= 4), F.lit(1.0)).otherwise(hook)
    relevance = F.when(F.col("back"), clip(relevance + 0.5)).otherwise(relevance)
    kind, cheer = contains_any(l, lex.EMPATHY), contains_any(l, lex.CELEBRATION)
    emotion = (
        F.when(F.col("mood") == "negative", F.when(cheer, 1.5).when(kind, 4.75).otherwise(2.5))
        .when(F.col("mood") == "positive", F.when(kind, 1.5).when(cheer, 4.75).otherwise(3.0))
        .otherwise(3.0)
    )
    goes_on = F.when(F.col("q") == 1, 4.75).when(F.col("q") > 2, 2.0).when((F.col("q") == 0) & F.col("back"), 3.75).otherwise(3.0)
    goes_on = F.when(F.regexp_replace(l, r"[.!]+$", "").isin("ok", "yes", "no", "sure"), 1.5).otherwise(goes_on)
    fresh = clip(5.0 - 12.0 * repeated_ratio(F.col("g3")))
    echoed = F.exists("earlier", lambda e: jaccard(words(e), F.col("w")) > 0.6)
    fresh = F.when(echoed, F.least(fresh, F.lit(1.5))).otherwise(fresh)
    digits = F.regexp_count("text", F.lit(r"\p{Nd}"))
    facts = clip(5.0 - 2.0 * hits(l, lex.CONFIDENT_FACTS) - 0.15 * digits)
    facts = F.when(contains_any(l, lex.GRACEFUL_IGNORANCE) & F.contains("asked", F.lit("?")), 5.0).otherwise(facts)
    style = clip(5.0 - 2.5 * hits(l, lex.AI_STYLE_MARKERS) - F.when(n > hard_max, 1.0).otherwise(0.0))
    style = F.when(F.col("text").rlike(r"(?m)^\s*(?:1\.|-|\*)\s"), F.least(style, F.lit(1.5))).otherwise(style)
    values = {
        "naturalness": clip(natural), "brevity": brevity, "relevance": relevance, "emotional_appropriateness": clip(emotion),
        "continuation": clip(goes_on), "non_repetition": fresh, "no_unnecessary_facts": facts, "non_assistant_style": style,
    }
    blank = F.col("text") == ""
    return s.select(*rows.columns, *[F.when(blank, F.lit(1.0)).otherwise(v.cast("double")).alias(k) for k, v in values.items()])


def weighted(value_of) -> Column:
    """Weighted mean over the dimensions; ``value_of`` gives a dimension's column, null counting as 3."""
    total = sum(lex.DIMENSION_WEIGHTS.values())
    mean = None
    for name, w in lex.DIMENSION_WEIGHTS.items():
        term = F.coalesce(value_of(name), F.lit(3.0)) * F.lit(w)
        mean = term if mean is None else mean + term
    return F.round(mean / F.lit(total), 4)


def precomputed(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores keyed by ``id#candidate`` (the last row of a key holds) over a fallback of 3 per dimension."""
    last = scores.groupBy("key").agg(F.max_by("scores", "line").alias("__scores"))
    keyed = rows.withColumn("key", F.concat("id", F.lit("#"), F.col("place").cast("string")))
    return keyed.join(last, "key", "left").withColumn("score", weighted(lambda d: F.col("__scores")[d])).drop("__scores", "key")


def best_of(rows: DataFrame, score: str = "score") -> DataFrame:
    """The best candidate of each talk, the first one on a tie; an aggregate, so no talk is sorted."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct(F.coalesce(score, F.lit(-1e9)), -F.col("place")))
    return rows.groupBy("id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_candidates")).select("id", "b.*", "n_candidates")


def outcome(best: DataFrame, least: float = 3.0) -> DataFrame:
    """Adds ``outcome``: kept, rejected_low_score or rejected_floor."""
    floor = None
    for name, bound in lex.HARD_FLOORS.items():
        low = F.coalesce(F.col(name) < bound, F.lit(False))
        floor = low if floor is None else floor | low
    return best.withColumn("outcome", F.when(F.coalesce("score", F.lit(0.0)) < least, "rejected_low_score").when(floor, "rejected_floor").otherwise("kept"))


def top_p(rows: DataFrame, group: str, logit: str, p: float) -> DataFrame:
    """Rows whose probability mass before them is at most ``p`` (softmax over the group)."""
    w = Window.partitionBy(group)
    weight = F.exp(F.col(logit) - F.max(logit).over(w))
    staged = rows.withColumn("prob", weight / F.sum(weight).over(w))
    run = Window.partitionBy(group).orderBy(F.desc(logit)).rowsBetween(Window.unboundedPreceding, -1)
    return staged.withColumn("before", F.coalesce(F.sum("prob").over(run), F.lit(0.0))).where(F.col("before") <= p)
