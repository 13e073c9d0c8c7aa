"""Reply benchmarks: variety, elaboration, emotional state, core intents, and the judge's scores and votes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.functions import banks
from talkmill.functions.metrics import ratio, words
from talkmill.functions.normalize import surface


def repeats(replies: DataFrame) -> DataFrame:
    """Adds ``norm`` and ``again``: the reply stood earlier in the same talk and is not trivial. Input (id, n, said)."""
    rows = replies.withColumn("norm", surface(F.coalesce("said", F.lit(""))))
    nth = F.row_number().over(Window.partitionBy("id", "norm").orderBy("n"))
    return rows.withColumn("again", (nth > 1) & ~F.col("norm").isin(*banks.TRIVIAL_REPLIES))


def variety(rows: DataFrame, *keys: str) -> DataFrame:
    """Repeat rate, distinct share and share of the commonest reply per ``keys``; counted by reply first, so no group is collected."""
    per = rows.groupBy(*keys, "norm").agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("again"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("replies"), ratio(F.sum("again"), F.sum("n")).alias("repeat_rate"),
        ratio(F.count(F.lit(1)), F.sum("n")).alias("distinct_ratio"), ratio(F.max("n"), F.sum("n")).alias("top1_share"),
    )


def referents(prompt: Column) -> Column:
    """The content words of a prompt, each once."""
    return F.array_distinct(F.filter(words(prompt), lambda w: (F.length(w) > 2) & ~w.isin(*banks.STOP_WORDS)))


def word_set(text: Column) -> Column:
    """Words with their plain singulars."""
    found = words(text)
    longer = F.filter(found, lambda w: (F.length(w) > 3) & w.endswith("s"))
    return F.array_union(found, F.transform(longer, lambda w: F.substr(w, F.lit(1), F.length(w) - 1)))


def elaboration_class(said: Column, asked: Column, known: Column, forbidden: Column) -> Column:
    """ELABORATION, HEDGE, GENERIC, FALSE_ELABORATION or OTHER; stock phrases first."""
    r = F.regexp_replace(F.lower(F.trim(said)), r"[.!]+$", "")
    meets = lambda a, b: F.arrays_overlap(a, b)
    own = word_set(r)
    return (
        F.when(r == "", "OTHER")
        .when(r.isin(*banks.GENERIC_REPLIES), "GENERIC")
        .when(r.rlike("|".join(f"(?:{p})" for p in banks.HEDGES)), "HEDGE")
        .when(~known & meets(own, forbidden) & ~meets(own, referents(asked)), "FALSE_ELABORATION")
        .when(meets(own, referents(asked)), "ELABORATION")
        .otherwise("OTHER")
    )


def elaboration_score(classes: DataFrame, *keys: str) -> DataFrame:
    """Rates of a table (known, class): elaboration is good everywhere, invention costs double, hedging a quarter."""
    is_ = lambda name: F.col("class") == name
    share = lambda hit, of: ratio(F.count_if(hit & of), F.count_if(of))
    every = F.lit(True)
    rated = classes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share(is_("ELABORATION"), every).alias("elaboration_rate"),
        share(is_("ELABORATION"), F.col("known")).alias("elaboration_known"), share(is_("ELABORATION"), ~F.col("known")).alias("elaboration_unknown"),
        share(is_("FALSE_ELABORATION"), ~F.col("known")).alias("false_elaboration_rate"), share(is_("HEDGE"), every).alias("hedge_rate"),
    )
    return rated.withColumn("composite", F.col("elaboration_rate") - 2.0 * F.col("false_elaboration_rate") - 0.25 * F.col("hedge_rate"))


def state_class(said: Column) -> Column:
    """What a reply commits to: attractor, positive, negative, neutral, in this order, or other."""
    from talkmill.functions.normalize import surface_of

    out = F.lit("other")
    for kind, bank in reversed(banks.STATE_BANKS.items()):
        out = F.when(surface(said).isin(*sorted({surface_of(x) for x in bank})), kind).otherwise(out)
    return out


def state_summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """Rates over counterfactual pairs (positive, negative): the replies to the two sides of one situation."""
    staged = pairs.withColumn("p", state_class(F.col("positive"))).withColumn("q", state_class(F.col("negative")))
    right_p, right_q = F.col("p") == "positive", F.col("q") == "negative"
    differs = F.lower(F.trim("positive")) != F.lower(F.trim("negative"))
    two = 2 * F.count(F.lit(1))
    kind = lambda name: ratio(F.count_if(F.col("p") == name) + F.count_if(F.col("q") == name), two).alias(f"{name}_rate")
    return staged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), ratio(F.count_if(differs), F.count(F.lit(1))).alias("divergence"),
        ratio(F.count_if(right_p & right_q), F.count(F.lit(1))).alias("directional"),
        ratio(F.count_if(right_p) + F.count_if(right_q), two).alias("accuracy"), kind("neutral"), kind("attractor"), kind("other"),
    )


def core_scenarios(intents: DataFrame) -> DataFrame:
    """(intent, tier, prompt, context): held-out paraphrases in six spellings, and as they stand after two preambles; one of each id.

    Equal ids keep the first in the order of place, spelling. ``intents`` is a small fixed table.
    """
    each = intents.where("name is not null").select(F.col("name").alias("intent"), "tier", F.posexplode("held_out").alias("place", "p")).where("p is not null")
    p = F.col("p")
    spellings = (p, F.regexp_replace(p, r"[?!.]+$", ""), F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2))), F.upper(p), F.concat(F.lit("so "), p), F.concat(p, F.lit(" lol")))
    bare = F.lit("")
    made = [F.struct(F.lit(i).alias("kind"), x.alias("prompt"), bare.alias("context")) for i, x in enumerate(spellings)]
    made += [F.struct(F.lit(6 + i).alias("kind"), p.alias("prompt"), F.lit("|".join(c)).alias("context")) for i, c in enumerate(banks.PREAMBLES)]
    rows = each.select("intent", "tier", "place", F.explode(F.array(*made)).alias("s")).select("intent", "tier", "place", "s.*")
    first = F.row_number().over(Window.partitionBy("intent", surface(F.col("prompt")), "context").orderBy("place", "kind")) == 1
    return rows.withColumn("__first", first).where("__first").drop("__first")


def accepted_replies(intents: DataFrame) -> DataFrame:
    """(intent, accepted): the surface forms that count as right, each once."""
    both = F.concat(F.coalesce("targets", F.array().cast("array<string>")), F.coalesce("accept", F.array().cast("array<string>")))
    return intents.select(F.col("name").alias("intent"), F.array_distinct(F.transform(F.filter(both, lambda x: x.isNotNull()), surface)).alias("accepted"))


def tier_gates(rollup: DataFrame) -> DataFrame:
    """(tier, pass_rate, passed) against the reliability bar of each tier."""
    bar = reduce(lambda a, kv: F.when(F.col("tier") == kv[0], kv[1]).otherwise(a), banks.TIER_TARGETS.items(), F.lit(1.0))
    return rollup.withColumn("target", bar).withColumn("passed", F.col("pass_rate") >= F.col("target"))


def adapted_boosts(per_intent: DataFrame, boosts: DataFrame, most: int = 5) -> DataFrame:
    """(intent, boost) of the next round: the few worst misses times 1.5 up to 4, all others decayed by .85 down to 1.

    ``per_intent``: (intent, tier, pass_rate); ``boosts``: (intent, boost) of the round before. Short report tables.
    """
    missed = tier_gates(per_intent).where("not passed")
    worst = missed.orderBy("pass_rate", "intent").limit(most).select("intent", F.lit(True).alias("worst"))
    both = per_intent.select("intent").join(boosts, "intent", "full").join(F.broadcast(worst), "intent", "left")
    now = F.coalesce("boost", F.lit(1.0))
    up = F.when(now < 4.0, F.round(F.least(F.lit(4.0), now * 1.5), 3)).otherwise(now)
    nxt = F.when(F.col("worst"), up).otherwise(F.round(F.greatest(F.lit(1.0), now * 0.85), 3))
    return both.select("intent", nxt.alias("boost")).where("boost > 1.0")


def promotion(champion: dict, incumbent: dict, least: float = 0.30, gain: float = 0.10, drop: float = 0.02) -> list[str]:
    """Why a candidate is not promoted; empty if it is. Both give directional and tier_1 rates."""
    d, reasons = champion.get("directional"), []
    if d is None:
        return ["no directional score"]
    if d < least:
        reasons.append(f"directional {d:.3f} < floor {least}")
    if d < incumbent.get("directional", 0.0) + gain:
        reasons.append(f"directional {d:.3f} < incumbent {incumbent.get('directional', 0.0):.3f} + {gain}")
    t = champion.get("tier_1")
    if t is not None and t < incumbent.get("tier_1", 0.0) - drop:
        reasons.append(f"tier 1 {t:.3f} regressed > {drop} vs {incumbent.get('tier_1', 0.0):.3f}")
    return reasons


def variety_gate(repeat_rate: float, most: float = 0.25) -> bool:
    return repeat_rate <= most


def score_means(scores: DataFrame) -> DataFrame:
    """(criterion, mean, n) of score maps (scores), means to 3 places, and the mean of those means."""
    each = scores.select(F.explode("scores").alias("criterion", "value")).where("value is not null")
    per = each.groupBy("criterion").agg(F.round(F.avg("value"), 3).alias("mean"), F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.lit("mean_all_criteria").alias("criterion"), F.round(F.avg("mean"), 3).alias("mean"), F.sum("n").alias("n")).where("n > 0")
    return per.unionByName(whole)


def vote_rates(votes: DataFrame, key: DataFrame) -> DataFrame:
    """One row: comparisons, ties, wins and win rates of the two systems. ``votes`` (id, choice), ``key`` (id, a, b: who is A and B).

    Votes on unknown ids don't count; any other choice counts as a comparison only.
    """
    joined = votes.join(key, "id").withColumn("__c", F.upper(F.coalesce("choice", F.lit(""))))
    winner = F.when(F.col("__c") == "A", F.col("a")).when(F.col("__c") == "B", F.col("b"))
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    wins = lambda who: F.count_if(winner == who)
    return joined.agg(
        F.count(F.lit(1)).alias("comparisons"), F.count_if(F.col("__c") == "TIE").alias("ties"), wins("left").alias("wins_left"), wins("right").alias("wins_right"),
        F.round(wins("left") / total, 4).alias("rate_left"), F.round(wins("right") / total, 4).alias("rate_right"),
    )


def context_prefixes(talks: DataFrame) -> DataFrame:
    """(id, k, context): the messages before the k-th reply of each talk (0-based), the system's left out. Input (id, messages)."""
    spoken = talks.select("id", F.expr("filter(messages, m -> coalesce(m.role, '') <> 'system')").alias("m"))
    places = spoken.withColumn("places", F.expr("filter(transform(m, (x, i) -> if(x.role = 'assistant', i, -1)), i -> i >= 0)"))
    each = places.select("id", "m", F.posexplode("places").alias("k", "at"))
    return each.select("id", "k", F.expr("slice(m, 1, at)").alias("context"))


def any_match(column: Column, patterns) -> Column:
    return reduce(or_, [column.rlike(p) for p in patterns])
