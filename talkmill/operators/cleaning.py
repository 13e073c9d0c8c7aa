"""Cleaning a corpus: first reject reason, exact and near duplicates, weights, splits, reports."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.functions import lexicons as lex
from talkmill.functions.metrics import contains_any, ngrams, ratio, tokens, words
from talkmill.functions.normalize import nfkc_each, tidy
from talkmill.operators.conversations import alternates, body, merge_runs, spoken
from talkmill.plans.lineage import cut


@dataclass(frozen=True)
class FilterConfig:
    """Limits and switches of the reject rules."""

    min_turns: int = 2
    max_turns: int = 40
    min_chars: int = 1
    max_turn_words: int = 60
    max_assistant_words: int = 45
    max_mean_assistant_words: float = 30.0
    band: tuple[int, int] = (1, 25)
    max_list_lines: int = 2
    max_non_ascii: float = 0.05
    min_alpha: float = 0.5
    require_alternating: bool = False
    assistant_style: bool = True
    factual: bool = True
    code: bool = True
    math: bool = True
    instructions: bool = True
    lists: bool = True
    downweight: bool = False

    def permissive(self) -> FilterConfig:
        """The control without style rules and with loose limits."""
        return replace(
            self, max_turn_words=1000, max_assistant_words=1000, max_mean_assistant_words=1e9, max_non_ascii=1.0, min_alpha=0.0,
            assistant_style=False, factual=False, code=False, math=False, instructions=False, lists=False,
        )


def with_parts(conversations: DataFrame) -> DataFrame:
    """Adds the arrays and texts that the rules read, each computed once."""
    staged = conversations.withColumn("spoken", F.coalesce(spoken(), F.array().cast("array<struct<role:string,content:string>>")))
    staged = staged.withColumn("full", F.array_join(F.transform("spoken", lambda m: m["content"]), " "))
    said = F.expr("transform(filter(spoken, m -> m.role = 'assistant'), m -> m.content)")
    sizes = F.transform("spoken", lambda m: F.struct(m["role"].alias("role"), F.size(tokens(m["content"])).alias("n")))
    return staged.withColumn("said", F.array_join(said, " ")).withColumn("sizes", sizes)


def reject_reason(cfg: FilterConfig = FilterConfig(), extra: list[Column] = ()) -> Column:
    """The first rule a talk fails, in a fixed order; null if it passes. Needs ``with_parts``.

    ``extra`` are further reasons as columns: the first that is not null counts, after the rules.
    """
    n = F.size("spoken")
    length = F.greatest(F.length("full"), F.lit(1))
    letters = F.length(F.regexp_replace("full", r"[^\p{L}\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85.,!?']", ""))
    foreign = F.length(F.regexp_replace(F.regexp_replace("full", r"[\p{So}\x{1F300}-\x{1FAFF}]", ""), r"[\x00-\x7F]", ""))
    replies = F.expr("filter(sizes, s -> s.role = 'assistant')")
    long = F.expr(
        "get(filter(transform(sizes, s -> case"
        f" when s.role = 'assistant' and s.n > {cfg.max_assistant_words} then 'assistant_turn_too_long'"
        f" when s.n > {cfg.max_turn_words} then 'turn_too_long' end), r -> r is not null), 0)"
    )
    total = F.expr("aggregate(filter(sizes, s -> s.role = 'assistant'), 0, (a, s) -> a + s.n)")
    low_said, low_full = F.lower("said"), F.lower("full")
    rules = [
        (n < cfg.min_turns, "too_few_turns"),
        (n > cfg.max_turns, "too_many_turns"),
        (F.size(replies) == 0, "no_assistant_turn"),
        (~alternates("spoken") if cfg.require_alternating else None, "not_alternating"),
        (F.regexp_replace("full", r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85]", "") == "", "empty"),
        (F.length("full") < cfg.min_chars, "too_short"),
        (letters / length < cfg.min_alpha, "low_alpha_ratio"),
        (foreign / length > cfg.max_non_ascii, "non_english"),
        (long.isNotNull(), long),
        ((F.size(replies) > 0) & (total / F.size(replies) > cfg.max_mean_assistant_words), "assistant_too_verbose"),
        (contains_any(low_said, lex.AI_ASSISTANT_PHRASES) if cfg.assistant_style else None, "ai_assistant_style"),
        (F.col("full").rlike("(?m)" + "|".join(lex.CODE_PATTERNS)) if cfg.code else None, "code"),
        (low_said.rlike("|".join(lex.MATH_PATTERNS)) if cfg.math else None, "math"),
        (contains_any(low_full, lex.INSTRUCTION_MARKERS) if cfg.instructions else None, "instruction_following"),
        (contains_any(low_said, lex.FACTUAL_QA_MARKERS) if cfg.factual else None, "factual_qa"),
        (F.regexp_count("full", F.lit(lex.LIST_LINE)) > cfg.max_list_lines if cfg.lists else None, "list_formatting"),
    ]
    case = None
    for condition, reason in rules:
        if condition is not None:
            value = F.lit(reason) if isinstance(reason, str) else reason
            case = F.when(condition, value) if case is None else case.when(condition, value)
    return F.coalesce(case, *extra) if extra else case


def weight(cfg: FilterConfig = FilterConfig()) -> Column:
    """.35 + .65 times the share of assistant turns inside the length band; a tenth of it if rejected."""
    low, high = cfg.band
    band = F.expr(f"size(filter(sizes, s -> s.role = 'assistant' and s.n between {low} and {high}))")
    all_ = F.expr("size(filter(sizes, s -> s.role = 'assistant'))")
    return F.round(F.when(all_ > 0, 0.35 + 0.65 * ratio(band, all_)).otherwise(F.lit(1.0)) * F.when(F.col("reason").isNotNull(), 0.1).otherwise(1.0), 4)


def flagged(rows: DataFrame) -> DataFrame:
    """Adds the reject reason to ``meta`` as filter_flag, for rejected talks that stay with a lower weight."""
    flag = F.create_map(F.lit("filter_flag"), F.col("reason"))
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("meta", none), lambda k, v: k != "filter_flag")
    return rows.withColumn("meta", F.when(F.col("reason").isNotNull(), F.map_concat(kept, flag)).otherwise(kept))


def exact_key(text: Column, marks: str = r"\p{M}") -> Column:
    """Lower case, runs of other than word characters as one space, as SHA-256; without ``marks`` as Python's ``re`` has it."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{L}}{marks}\p{{N}}_]+", " ")), 256)


def deduplicate(rows: DataFrame, text: Column, order: str, n: int = 8, marks: str = r"\p{M}") -> DataFrame:
    """Adds ``duplicate``: exact_duplicate, near_duplicate or null.

    Exact: an equal key stands earlier. Near: more than three distinct ``n``-word shingles, all of
    which stand in earlier survivors of the exact rule; equivalently each shingle's first place is
    before the row. ``order`` must be unique. The first place of a key or shingle is an aggregate
    (combined before the shuffle) joined back, so that a key of a third of all rows is no one task.
    """
    keyed = cut(rows.select(order, text.alias("__text")).withColumn("__key", exact_key(F.col("__text"), marks)).withColumn("__words", words(F.col("__text"))).drop("__text"))
    first = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    exact = keyed.join(first.where("__first is not null"), "__key").select(order, (F.col("__first") < F.col(order)).alias("__exact"))
    grams = F.when(F.size("__words") < n, F.filter(F.array(F.array_join("__words", " ")), lambda s: s != "")).otherwise(ngrams("__words", n))
    alive = keyed.join(exact.where("not __exact"), order).select(order, F.array_distinct(grams).alias("__grams"))
    # Sixteen bytes stand for a shingle in both shuffles, not its eight words.
    marks_of = F.transform("__grams", lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit("shingle"), g).alias("b")))
    each = alive.select(order, F.explode(marks_of).alias("__g")).select(order, F.col("__g.a").alias("__a"), F.col("__g.b").alias("__b"))
    seen = each.groupBy("__a", "__b").agg(F.min(order).alias("__first"))
    near = (
        each.join(seen, ["__a", "__b"]).groupBy(order)
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__first").alias("__last"))
        .where(F.col("__n") > 3).where(F.col("__last") < F.col(order)).select(order, F.lit(True).alias("__near"))
    )
    joined = rows.join(exact, order, "left").join(near, order, "left")
    label = F.when(F.col("__exact"), "exact_duplicate").when(F.col("__near"), "near_duplicate")
    return joined.withColumn("duplicate", label).drop("__exact", "__near")


def prepared(conversations: DataFrame) -> DataFrame:
    """Normalized messages without empty ones, same-role runs merged; null messages stay null."""
    texts = F.transform("messages", lambda m: F.coalesce(m["content"], F.lit("")))
    staged = conversations.withColumn("__texts", nfkc_each(texts))
    normal = F.transform(F.col("__texts"), lambda t: tidy(t, wide=True))
    zipped = F.zip_with("messages", normal, lambda m, t: F.struct(m["role"].alias("role"), t.alias("content")))
    return staged.withColumn("__messages", F.filter(zipped, lambda m: m["content"] != "")).withColumn("messages", merge_runs(F.col("__messages"))).drop("__texts", "__messages")


def clean(conversations: DataFrame, order: str, cfg: FilterConfig = FilterConfig(), extra: list[Column] = ()) -> DataFrame:
    """Adds ``reason`` (null: kept) and ``weight``: messages prepared, rules, then duplicates among the talks that pass them."""
    judged = cut(with_parts(prepared(conversations)).withColumn("reason", reject_reason(cfg, extra)))
    judged = judged.withColumn("weight", weight(cfg) if cfg.downweight else F.lit(1.0))
    live = judged if cfg.downweight else judged.where("reason is null")
    marked = deduplicate(live.select(order, "messages"), body(), order, marks="").select(order, "duplicate")
    keep = judged.drop("spoken", "full", "said", "sizes")
    return keep.join(marked, order, "left").withColumn("reason", F.coalesce("duplicate", "reason")).drop("duplicate")


def split_by_family(rows: DataFrame, family: Column, val: float = 0.15, test: float = 0.15, seed: int = 1337) -> DataFrame:
    """Adds ``part``: train, val or test by a hash of seed and family alone, so that appends move nothing."""
    if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
        raise ValueError("shares must be non-negative and sum to less than 1")
    name = F.coalesce(F.when(family != "", family), F.lit("unknown"))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return rows.withColumn("part", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def split_stratified(rows: DataFrame, source: str, ident: str, share: float = 0.02, least: int = 1) -> DataFrame:
    """Adds ``part``: the first share of each source by hash of the id is val; sources of up to two rows are all train.

    The hash order needs no sort of a whole source: a row's rank comes from counts per hash
    prefix, and only rows of one prefix are ranked together.
    """
    from talkmill.plans.skew import bucketed_rank

    hashed = rows.withColumn("__h", F.sha2(ident, 256))
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    ranked = bucketed_rank(hashed, [source], [F.col("__h"), F.col(ident)], F.substring("__h", 1, 3), "__rank")
    s = sizes.withColumnRenamed(source, "__source")
    joined = ranked.join(s, F.col(source).eqNullSafe(F.col("__source")))
    k = F.when(F.col("__n") > 2, F.greatest(F.lit(least), F.rint(F.col("__n") * share))).otherwise(0)
    return joined.withColumn("part", F.when(F.col("__rank") < k, "val").otherwise("train")).drop("__h", "__n", "__rank", "__source")


def corpus_stats(conversations: DataFrame, by: list[str]) -> DataFrame:
    """Talks, turns and assistant lengths per group, percentiles by index as in a sorted list.

    Percentiles come from counts per length (at most a few hundred rows a group), not from a list of all lengths.
    """
    parts = with_parts(conversations)
    talks = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("conversations"), F.sum(F.size("spoken")).alias("turns"))
    sizes = parts.select(*by, F.explode("sizes").alias("s")).where("s.role = 'assistant'").groupBy(*by, F.col("s.n").alias("n")).count()
    per = sizes.groupBy(*by).agg(
        F.sum("count").alias("assistant_turns"),
        F.sum(F.col("n") * F.col("count")).alias("assistant_words"),
        F.sum(F.when(F.col("n").between(3, 25), F.col("count")).otherwise(0)).alias("in_3_25"),
    )
    run = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    upto = sizes.withColumn("upto", F.sum("count").over(run)).withColumn("all", F.sum("count").over(Window.partitionBy(*by)))
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * p)), F.col("n")))
    cuts = upto.groupBy(*by).agg(pick(0.5).alias("p50"), pick(0.9).alias("p90"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    a = talks.join(per, same(talks, per), "left").select(talks["*"], *[per[c] for c in per.columns if c not in by])
    return a.join(cuts, same(a, cuts), "left").select(a["*"], cuts["p50"], cuts["p90"])
