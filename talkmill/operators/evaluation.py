"""Transcript evaluation: turn facts, talk metrics, prefixes, probes, comparisons, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.functions import lexicons as lex
from talkmill.functions.metrics import contains_any, copy_ratio, jaccard, ngrams, ratio, repeated_ratio, ungrammatical, words
from talkmill.plans.lineage import cut


def reply_pairs(rows: DataFrame) -> DataFrame:
    """(id, n, asked, said): each assistant turn that follows a user turn at once, numbered from 1."""
    w = Window.partitionBy("id").orderBy("turn")
    near = rows.withColumn("__role", F.lag("role").over(w)).withColumn("asked", F.lag("content").over(w))
    only = near.where("role = 'assistant' and __role = 'user'")
    return only.select("id", F.row_number().over(w).alias("n"), "turn", "asked", F.col("content").alias("said"))


def turn_facts(pairs: DataFrame) -> DataFrame:
    """Per reply: length, repetition, copying, flags and the reasons why it is broken."""
    said, asked = F.coalesce("said", F.lit("")), F.coalesce("asked", F.lit(""))
    staged = pairs.withColumn("w", words(said)).withColumn("u", words(asked))
    staged = staged.withColumn("norm", F.array_join("w", " ")).withColumn("g3", ngrams("w", 3))
    staged = staged.withColumn("rep", repeated_ratio(F.col("g3"))).withColumn("copy", copy_ratio("w", "u"))
    staged = staged.withColumn("ungrammatical", ungrammatical(said, "w")).withColumn("ai_style", contains_any(F.lower(said), lex.AI_STYLE_MARKERS))
    again = F.row_number().over(Window.partitionBy("id", "norm").orderBy("n")) > 1
    staged = staged.withColumn("again", again & (F.size("w") > 0))
    reasons = [
        (F.trim(said).isin("", "..."), "empty"),
        (F.size("w") > 60, "too_long"),
        (F.col("rep") > 0.34, "intra_repetition"),
        ((F.col("copy") >= 0.85) & (F.size("w") >= 4), "context_copy"),
        (F.col("ungrammatical"), "ungrammatical"),
        (F.col("ai_style"), "ai_assistant_style"),
        (F.col("again"), "repeats_previous_turn"),
    ]
    broken = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]), lambda r: r.isNotNull())
    return staged.withColumn("question", F.contains(said, F.lit("?"))).withColumn("broken_reasons", broken)


def looped(facts: DataFrame, upto: int | None = None) -> DataFrame:
    """(id, loop): two neighbouring replies (nearly) equal, or one reply three times; over the first ``upto`` replies."""
    part = facts if upto is None else facts.where(F.col("n") <= upto)
    w = Window.partitionBy("id").orderBy("n")
    near = (F.col("norm") != "") & ((F.col("norm") == F.lag("norm").over(w)) | (jaccard(F.col("w"), F.lag("w").over(w)) >= 0.8))
    thrice = (F.col("norm") != "") & (F.row_number().over(Window.partitionBy("id", "norm").orderBy("n")) >= 3)
    return part.select("id", F.coalesce(near, F.lit(False)).alias("near"), thrice.alias("thrice")).groupBy("id").agg(
        (F.max("near") | F.max("thrice")).alias("loop")
    )


def talk_metrics(facts: DataFrame) -> DataFrame:
    """Per talk: counts and ratios of its replies. ``facts`` should be written once (see ``cut``)."""
    base = facts.groupBy("id").agg(
        F.count(F.lit(1)).alias("num_turns"),
        F.sum(F.size("w")).alias("words"),
        F.max(F.size("w")).alias("max_len"),
        F.count_if(F.size("w").between(3, 25)).alias("in_band"),
        F.count_if("question").alias("questions"),
        F.count_if("ai_style").alias("ai_style"),
        F.count_if("ungrammatical").alias("ungrammatical"),
        F.count_if(F.size("broken_reasons") > 0).alias("broken"),
        F.avg("rep").alias("mean_rep_ngram"),
        F.avg("copy").alias("mean_copy_ratio"),
    )
    unigrams = facts.select("id", F.explode("w").alias("g")).groupBy("id").agg(F.countDistinct("g").alias("u1"), F.count("g").alias("t1"))
    bigrams = facts.select("id", F.explode(ngrams("w", 2)).alias("g")).groupBy("id").agg(F.countDistinct("g").alias("u2"), F.count("g").alias("t2"))
    joined = base.join(unigrams, "id", "left").join(bigrams, "id", "left").join(looped(facts), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "id", "num_turns", "words", "max_len", "in_band", "questions", "ai_style", "ungrammatical", "broken", "loop",
        ratio(zero("u1"), zero("t1")).alias("distinct_1"), ratio(zero("u2"), zero("t2")).alias("distinct_2"),
        (F.col("questions") / F.col("num_turns") > 0.8).alias("excessive_questions"), "mean_rep_ngram", "mean_copy_ratio",
    )


def self_overlap(facts: DataFrame) -> DataFrame:
    """(id, overlap_pairs, overlap): mean Jaccard of the bigram sets over the pairs of replies of a talk.

    Only pairs that share a bigram are joined, on (talk, bigram); all others have similarity 0 and are counted by
    arithmetic. So a long talk is spread over its bigrams, and talks of unlike replies cost little.
    """
    sets = facts.select("id", "n", F.array_distinct(ngrams("w", 2)).alias("g")).where("size(g) > 0")
    post = sets.select("id", "n", F.size("g").alias("size"), F.explode("g").alias("g"))
    a, b = post.alias("a"), post.alias("b")
    shared = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.n") < F.col("b.n")))
    common = shared.groupBy(F.col("a.id").alias("id"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(
        F.count(F.lit(1)).alias("c"), F.first("a.size").alias("sa"), F.first("b.size").alias("sb")
    )
    near = common.groupBy("id").agg(F.sum(F.col("c") / (F.col("sa") + F.col("sb") - F.col("c"))).alias("s"))
    counts = sets.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    pairs = (F.col("k") * (F.col("k") - 1) / 2).cast("bigint")
    return counts.join(near, "id", "left").select("id", pairs.alias("overlap_pairs"), (F.coalesce("s", F.lit(0.0)) / pairs).alias("overlap"))


def transcript_metrics(facts: DataFrame) -> DataFrame:
    """The fourteen metrics of each talk. ``facts`` should be written once (see ``cut``)."""
    m = talk_metrics(facts).join(self_overlap(facts).select("id", "overlap"), "id", "left")
    n = F.col("num_turns")
    return m.select(
        "id", "num_turns", "max_len", (F.col("words") / n).alias("mean_len"), ratio(F.col("in_band"), n).alias("len_in_3_25"), "distinct_1", "distinct_2",
        F.col("distinct_1").alias("ttr"), F.coalesce("overlap", F.lit(0.0)).alias("self_overlap"), "mean_rep_ngram", ratio(F.col("questions"), n).alias("question_ratio"),
        "mean_copy_ratio", F.col("loop").cast("double").alias("loop"), ratio(F.col("ai_style"), n).alias("ai_style_rate"), F.col("excessive_questions").cast("double").alias("excessive_questions"),
    )


def clean_prefixes(facts: DataFrame, upto: int) -> DataFrame:
    """(id, clean) of the talks of at least ``upto`` replies: nothing broken and no loop in the first ``upto``."""
    head = facts.where(F.col("n") <= upto)
    long = head.groupBy("id").agg(F.max("n").alias("n"), F.max(F.size("broken_reasons") > 0).alias("bad")).where(F.col("n") >= upto)
    return long.join(looped(facts, upto), "id").select("id", (~F.col("bad") & ~F.col("loop")).alias("clean"))


def summary(facts: DataFrame) -> DataFrame:
    """One row: means of the metrics over the talks, and rates over talks, replies and prefixes of 5 and 10 replies."""
    metrics = transcript_metrics(facts)
    means = [F.avg(c).alias(c) for c in metrics.columns if c not in ("id", "num_turns", "max_len")]
    rates = facts.groupBy("id").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.size("broken_reasons") > 0).alias("b"), F.count_if("ungrammatical").alias("u"))
    whole = rates.agg(
        ratio(F.sum("b"), F.sum("t")).alias("broken_turn_rate"), ratio(F.count_if(F.col("b") == 0), F.count(F.lit(1))).alias("clean_conversation_rate"),
        (1 - F.sum("u") / F.sum("t")).alias("grammatical_rate"),
    )
    out = metrics.agg(F.count(F.lit(1)).alias("scenarios"), F.sum("num_turns").alias("turns"), *means).crossJoin(whole)  # one row each
    for upto in (5, 10):
        out = out.crossJoin(clean_prefixes(facts, upto).agg(ratio(F.count_if("clean"), F.count(F.lit(1))).alias(f"clean_{upto}turn_rate")))
    return out


def length_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, the value at place 0.9 n and band shares of a whole number per key, from counts of its distinct values."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    half = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    share = lambda low, high: ratio(F.sum(F.when(F.col(value).between(low, high), F.col("c")).otherwise(0)), F.first("n"))
    return placed.groupBy(key).agg(
        F.first("n").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.first("n")).alias("mean"), ((at(half[0]) + at(half[1])) / 2).alias("median"),
        at(F.floor(F.col("n") * 0.9)).alias("p90"), share(1, 1).alias("frac_1_word"), share(2, 12).alias("frac_2_12"), share(13, 30).alias("frac_13_30"), share(31, 1 << 30).alias("frac_over_30"),
    )


def run_probes(probes: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds ``passed`` and ``reason`` to probes (id, turn, expect_any, forbid_any, forbid_confident).

    A missing turn fails first, then absent expected content, forbidden content, a confident made-up fact.
    """
    joined = probes.join(replies.select("id", F.col("n").alias("turn"), F.lower("said").alias("__said")), ["id", "turn"], "left")
    has = lambda c: F.exists(c, lambda x: F.contains(F.col("__said"), F.lower(x)))
    none = F.array().cast("array<string>")
    expect, forbid = F.coalesce("expect_any", none), F.coalesce("forbid_any", none)
    made_up = contains_any(F.col("__said"), lex.CONFIDENT_FACTS) & ~contains_any(F.col("__said"), lex.GRACEFUL_IGNORANCE)
    reason = (
        F.when(F.col("__said").isNull(), "missing_turn")
        .when((F.size(expect) > 0) & ~has(expect), "expected_content_absent")
        .when((F.size(forbid) > 0) & has(forbid), "forbidden_content_present")
        .when(F.coalesce("forbid_confident", F.lit(False)) & made_up, "fabricated_fact")
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok").drop("__said")


def pairwise(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same reply place of the same talk in two systems, equal texts left out; which side is A is a hash, for blinding."""
    a = left.select("id", "n", F.col("said").alias("x"))
    b = right.select("id", "n", F.col("said").alias("y"))
    swap = F.substring(F.sha2(F.concat_ws("|", "id", F.col("n").cast("string")), 256), 1, 1).isin(*"89abcdef")
    return a.join(b, ["id", "n"]).where("x <> y").select(
        "id", "n", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), swap.alias("swapped")
    )


def first_crossing(rows: DataFrame, size: str, value: str, threshold: float) -> DataFrame:
    """The smallest size from which on every value reaches the threshold (a short report table)."""
    w = Window.orderBy(size).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("__min", F.min(value).over(w)).where(F.col("__min") >= threshold).agg(F.min(size).alias("first_size"))


def cliff(rows: DataFrame, size: str, value: str) -> DataFrame:
    """The largest gain between neighbouring sizes."""
    gain = F.col(value) - F.lag(value).over(Window.orderBy(size))
    return rows.select(F.lag(size).over(Window.orderBy(size)).alias("from_size"), F.col(size).alias("to_size"), gain.alias("gain")).where(
        "gain is not null"
    ).orderBy(F.desc("gain"), "to_size").limit(1)


def evaluate(rows: DataFrame) -> DataFrame:
    """Turn facts of a corpus of turns, written once for the metrics that read them."""
    return cut(turn_facts(reply_pairs(rows)))


def pass_rate(flag: Column) -> Column:
    return ratio(F.count_if(flag), F.count(F.lit(1)))
