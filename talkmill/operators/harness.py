"""Per-turn signals of a reply harness as columns: features, policies, validation, confidence, ranking, recall, topic history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.functions import banks, lexicons as lex
from talkmill.functions.metrics import contains_any, mood, ngrams, tokens, topic, words

FEATURES = (
    "n_words", "has_question_mark", "has_greeting", "has_goodbye", "has_thanks", "has_apology", "has_correction", "has_negation", "has_emoji",
    "all_caps", "repeated_punct", "prev_assistant_was_question", "consecutive_assistant_questions",
)


def user_features(rows: DataFrame) -> DataFrame:
    """The signals of each user turn of turns (id, turn, role, content); questions before it are the assistant's run just before."""
    asks = F.coalesce(F.rtrim("content").endswith("?"), F.lit(False))
    w = Window.partitionBy("id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    spoke = F.col("role") == "assistant"
    counted = rows.withColumn("__k", F.sum(F.when(spoke, 1).otherwise(0)).over(Window.partitionBy("id").orderBy("turn")))
    broken = F.coalesce(F.max(F.when(spoke & ~asks, F.col("__k"))).over(w), F.lit(0))
    run = F.coalesce(F.max(F.when(spoke, F.col("__k"))).over(w), F.lit(0)) - broken
    text = F.trim(F.coalesce("content", F.lit("")))
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    flags = {k: text.rlike(p) for k, p in lex.TURN_FLAGS.items()}
    flags |= {
        "has_question_mark": F.contains(text, F.lit("?")), "has_emoji": text.rlike(banks.EMOJI),
        "all_caps": (F.length(letters) >= 4) & ~letters.rlike(r"[^\p{Lu}]"),
    }
    users = counted.withColumn("consecutive_assistant_questions", run).where("role = 'user'")
    return users.select(
        "id", "turn", text.alias("text"), F.length(text).alias("n_chars"), F.size(tokens(text)).alias("n_words"), *[c.alias(k) for k, c in flags.items()],
        (F.col("consecutive_assistant_questions") > 0).alias("prev_assistant_was_question"), "consecutive_assistant_questions",
    )


def feature_vector() -> Column:
    """Thirteen numbers of about unit scale from the columns of ``user_features``."""
    scale = {"n_words": 30.0, "consecutive_assistant_questions": 3.0}
    value = lambda k: F.least(F.col(k).cast("double"), F.lit(scale[k])) / scale[k] if k in scale else F.col(k).cast("double")
    return F.array(*[value(k) for k in FEATURES])


def shortcut() -> Column:
    """Policy of an unmistakable message (farewell, thanks, greeting), else null."""
    few = lambda n: F.col("n_words") <= n
    plain = ~F.col("has_question_mark")
    return F.when(F.col("has_goodbye") & few(6), "P06").when(F.col("has_thanks") & few(5) & plain, "P04").when(F.col("has_greeting") & few(3) & plain, "P01")


def of_policy(policy: Column, field: int) -> Column:
    """A field of the policy table; null for an unknown policy."""
    arms = [F.when(policy == pid, F.lit(row[field])) for pid, row in banks.POLICIES.items()]
    return F.coalesce(*arms)


def token_cap(policy: Column) -> Column:
    return F.coalesce(*[F.when(policy == pid, F.lit(banks.LENGTH_TOKENS[row[2]])) for pid, row in banks.POLICIES.items()])


def internal_loop(seq: str) -> Column:
    """A run of three words stands twice in a reply of at least six."""
    grams = ngrams(seq, 3)
    return (F.size(seq) >= 6) & (F.size(grams) != F.size(F.array_distinct(grams)))


def exact_repeat(text: Column, earlier: Column) -> Column:
    """The reply, trimmed and in lower case, stands among earlier ones; short acknowledgements may recur."""
    plain = F.lower(F.trim(text))
    return ~plain.isin(*banks.FREE_REPEATS) & F.exists(earlier, lambda x: F.lower(F.trim(x)) == plain)


def shares_long_ngram(seq: str, earlier: Column, n: int = 4) -> Column:
    """A run of ``n`` words stands in an earlier reply too."""
    return F.exists(earlier, lambda x: F.arrays_overlap(ngrams(seq, n), _grams(words(x), n)))


def _grams(seq: Column, n: int) -> Column:
    """n-grams of an array expression; short ones give none."""
    starts = F.when(F.size(seq) >= n, F.sequence(F.lit(1), F.size(seq) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(seq, i, F.lit(n)), " "))


def failures(text: Column, seq: str, policy: Column, earlier: Column, closing: Column) -> Column:
    """The codes for which a reply fails, in order: form, boilerplate, repetition, length and questions against its policy."""
    ask = F.trim(text).endswith("?")
    size, cap = F.size(tokens(text)), token_cap(policy)
    rules = [
        (F.trim(text) == "", F.lit("empty")),
        (text.rlike(lex.SPECIAL_TOKEN), F.lit("special_token_leak")),
        (text.rlike(lex.BOILERPLATE), F.lit("ai_boilerplate")),
        (exact_repeat(text, earlier), F.lit("exact_repeat")),
        (internal_loop(seq), F.lit("internal_loop")),
        (size > cap * 2, F.concat(F.lit("length_"), size.cast("string"), F.lit(">"), (cap * 2).cast("string"))),
        ((of_policy(policy, 1) == "NO_QUESTION") & ask, F.lit("question_when_forbidden")),
        ((of_policy(policy, 0) == "CLOSE") & ask, F.lit("question_while_closing")),
        (closing & ask, F.lit("question_after_farewell")),
    ]
    return F.filter(F.array(*[F.when(c, code) for c, code in rules]), lambda x: x.isNotNull())


def consistency(seq: Column, policy: Column) -> Column:
    """Best word-set F1 of a reply with the example replies of its policy, 0 without any common word."""

    def f1(example: str) -> Column:
        import re

        e = F.array(*[F.lit(w) for w in sorted(set(re.findall(r"[a-z']+", example)))])
        own = F.array_distinct(seq)
        common = F.size(F.array_intersect(own, e))
        # 2pr / (p + r) of p = common / own, r = common / example
        return F.when(common > 0, 2.0 * common / (F.size(own) + F.size(e))).otherwise(F.lit(0.0))

    best = lambda row: F.greatest(*[f1(x) for x in row[3]]) if len(row[3]) > 1 else f1(row[3][0])
    return F.coalesce(*[F.when(policy == pid, best(row)) for pid, row in banks.POLICIES.items()], F.lit(0.0))


def confidence(probs: Column, min_top1: float, min_margin: float) -> Column:
    """(top1, margin, entropy, status) of a distribution; entropy as a share of the greatest possible one."""
    ordered = F.reverse(F.array_sort(probs))
    top1, top2 = F.get(ordered, F.lit(0)), F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))
    entropy = F.aggregate(F.filter(probs, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.ln(p))
    whole = F.when(F.size(probs) > 1, F.ln(F.size(probs))).otherwise(F.lit(1.0))
    status = (
        F.when((top1 >= min_top1) & (top1 - top2 >= min_margin), "HIGH")
        .when((top1 >= min_top1 * 0.75) & (top1 - top2 >= min_margin * 0.5), "MEDIUM")
        .otherwise("LOW")
    )
    some = F.size(probs) > 0
    return F.struct(
        F.when(some, top1).otherwise(0.0).alias("top1"), F.when(some, top1 - top2).otherwise(0.0).alias("margin"),
        F.when(some, entropy / whole).otherwise(1.0).alias("entropy"), F.when(some, status).otherwise("LOW").alias("status"),
    )


def reranked(rows: DataFrame) -> DataFrame:
    """The candidate of each talk with the least (repeats, asks against the policy, tokens over, -consistency, place).

    Input (id, place, text, policy, earlier). Without a policy only repetition counts before the place. An aggregate:
    no talk's candidates are sorted.
    """
    staged = rows.withColumn("w", words(F.col("text")))
    known = F.col("policy").isNotNull()
    repeats = (exact_repeat(F.col("text"), F.col("earlier")) | internal_loop("w")).cast("int")
    bad = ((of_policy(F.col("policy"), 1) == "NO_QUESTION") & F.trim("text").endswith("?")).cast("int")
    over = F.greatest(F.lit(0), F.size(tokens(F.col("text"))) - token_cap(F.col("policy")))
    match = F.round(consistency(F.col("w"), F.col("policy")), 2)
    key = F.struct(repeats, F.when(known, F.coalesce(bad, F.lit(0))).otherwise(0), F.when(known, F.coalesce(over, F.lit(0))).otherwise(0), F.when(known, -match).otherwise(0.0), F.col("place"))
    return staged.groupBy("id").agg(F.min_by(F.struct("place", "text", "policy", match.alias("match")), key).alias("b")).select("id", "b.*")


def recent_repeats(replies: DataFrame, window: int = 8) -> DataFrame:
    """Adds ``seen_recently`` (the reply stands among the ``window`` replies before it) and ``long_ngram`` (shares four words in a row with one)."""
    w = Window.partitionBy("id").orderBy("n").rowsBetween(-window, -1)
    plain = F.lower(F.trim(F.coalesce("said", F.lit(""))))
    staged = replies.withColumn("plain", plain).withColumn("earlier", F.collect_list("plain").over(w)).withColumn("w", words(F.col("plain")))
    return staged.withColumn("seen_recently", F.array_contains("earlier", F.col("plain"))).withColumn("long_ngram", shares_long_ngram("w", F.col("earlier")))


def app_state(rows: DataFrame) -> DataFrame:
    """Per talk: the topics in the order of change, and the last topic, mood and name of its user. Turns (id, turn, role, content)."""
    users = rows.where("role = 'user' and content is not null").withColumn("low", F.lower("content"))
    staged = users.withColumn("topic", topic(F.col("low"))).withColumn("mood", mood(F.col("low")))
    name = F.regexp_extract("content", banks.USER_NAME, 1)
    staged = staged.withColumn("name", F.when((name != "") & ~F.lower(name).isin(*banks.NOT_A_NAME), F.initcap(F.lower(name))))
    before = F.last("topic", ignorenulls=True).over(Window.partitionBy("id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    changed = staged.withColumn("change", F.when(F.col("topic").isNotNull() & ~F.col("topic").eqNullSafe(before), F.col("topic")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c)
    history = F.array_sort(F.collect_list(F.when(F.col("change").isNotNull(), F.struct("turn", "change"))))
    return changed.groupBy("id").agg(F.transform(history, lambda x: x["change"]).alias("topics"), latest("topic"), latest("mood"), latest("name"))


def user_details(rows: DataFrame, most: int = 5) -> DataFrame:
    """(id, details): the last ``most`` things users tell of themselves, each where it first stands."""
    users = rows.where("role = 'user' and content is not null")
    found = users.select("id", "turn", F.posexplode(F.regexp_extract_all("content", F.lit(banks.USER_FACT), F.lit(0))).alias("place", "fact"))
    plain = found.withColumn("fact", F.trim(F.regexp_replace("fact", r"\s+", " "))).where("fact <> ''")
    first = plain.groupBy("id", "fact").agg(F.min(F.struct("turn", "place")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))
    kept = first.withColumn("rank", rank).where(F.col("rank") <= most)
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "fact"))), lambda x: x["fact"]).alias("details"))


def recalled(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, turn, slot, value): the remembered facts (id, turn, slot, value) that a later user turn (id, turn, content) asks about."""
    cues = reduce(lambda a, kv: a.when(F.col("slot") == kv[0], contains_any(F.col("low"), kv[1])), list(banks.RECALL_CUES.items())[1:], F.when(F.col("slot") == "name", contains_any(F.col("low"), banks.RECALL_CUES["name"])))
    a = asked.select("id", F.col("turn").alias("asked_at"), F.lower("content").alias("low"))
    known = facts.withColumn("until", F.lead("turn").over(Window.partitionBy("id", "slot").orderBy("turn")))
    joined = known.join(a, "id").where("asked_at > turn and (until is null or asked_at <= until)")
    return joined.where(F.coalesce(cues, F.lit(False))).select("id", F.col("asked_at").alias("turn"), "slot", "value")


def referent_weights(text: Column, most: int = 3) -> Column:
    """The last ``most`` content words of a message with weights rising to 1."""
    found = F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*banks.STOP_WORDS))
    kept = F.slice(found, F.greatest(F.size(found) - (most - 1), F.lit(1)), F.lit(most))
    return F.transform(kept, lambda w, i: F.struct(w.alias("word"), F.round(0.6 + 0.4 * (i + 1) / F.size(kept), 6).alias("weight")))
