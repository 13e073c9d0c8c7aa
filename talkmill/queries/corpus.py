"""Corpus queries: statistics, reject reasons, duplicates, splits, leakage, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import lexicons as lex
from talkmill.functions.metrics import wilson, words
from talkmill.functions.normalize import normalize, surface, tidy
from talkmill.operators import cleaning, conversations as conv, leakage, selection
from talkmill.plans.lineage import cut
from talkmill.sources.tables import table

SPACE = r"\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85"
SPOKEN = "list_filter(coalesce(messages, []), lambda m: coalesce(m.role, '') <> 'system')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, {q(p)})" for p in phrases) + ")"


def longs(df):
    """Whole numbers as bigint, so that both engines agree."""
    return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])


def corpus_stats(spark, d):
    return longs(cleaning.corpus_stats(table(spark, d, "example_conversations"), ["source"]))


SIZES = f"""
with p as (select id, source, {SPOKEN} as spoken from example_conversations),
s as (select id, source, spoken, list_transform(spoken, lambda m: {{'role': m.role, 'n': len(regexp_extract_all(coalesce(m.content, ''), '\\S+'))}}) as sizes from p)
"""
CORPUS_STATS = f"""{SIZES},
t as (select source, count(*) as conversations, sum(len(spoken))::bigint as turns from s group by source),
e as (select source, unnest(sizes) as z from s),
a as (select source, z.n as n from e where z.role = 'assistant'),
g as (select source, count(*) as assistant_turns, sum(n)::bigint as assistant_words, count(*) filter (n between 3 and 25) as in_3_25, list_sort(list(n)) as l from a group by source)
select t.source, conversations, turns, assistant_turns, assistant_words, in_3_25,
  l[least(len(l) - 1, floor(len(l) * 0.5)::bigint) + 1]::bigint as p50, l[least(len(l) - 1, floor(len(l) * 0.9)::bigint) + 1]::bigint as p90
from t left join g on t.source is not distinct from g.source
"""


def cleaned_talks(spark, d):
    """The reference's whole preparation: normalize, drop empty turns, merge runs, rules, duplicates among talks that pass.

    No SQL: DuckDB has no NFKC; tested against a loop. Talks come in the order of their ids.
    """
    kept = cleaning.clean(table(spark, d, "example_conversations").select("id", "source", "messages"), "id")
    return kept.select("id", "source", "reason", F.size("messages").cast("bigint").alias("n_messages"), F.sha2(conv.body(), 256).alias("digest"))


def reject_reasons(spark, d):
    """The rules on raw messages, as the SQL has them; ``cleaned_talks`` normalizes and merges first."""
    parts = cleaning.with_parts(table(spark, d, "example_conversations"))
    strict = parts.select("source", cleaning.reject_reason().alias("reason"), cleaning.reject_reason(cleaning.FilterConfig().permissive()).alias("loose"))
    return strict.groupBy("source", "reason", "loose").agg(F.count(F.lit(1)).alias("n"))


def reason_sql(strict: bool) -> str:
    turn, reply, mean, foreign, alpha = (60, 45, 30, 0.05, 0.5) if strict else (1000, 1000, 1e9, 1.0, 0.0)
    style = f"""
    when {any_of("lower(said)", lex.AI_ASSISTANT_PHRASES)} then 'ai_assistant_style'
    when regexp_matches("full", {q("(?m)" + "|".join(lex.CODE_PATTERNS))}) then 'code'
    when regexp_matches(lower(said), {q("|".join(lex.MATH_PATTERNS))}) then 'math'
    when {any_of('lower("full")', lex.INSTRUCTION_MARKERS)} then 'instruction_following'
    when {any_of("lower(said)", lex.FACTUAL_QA_MARKERS)} then 'factual_qa'
    when len(regexp_extract_all("full", {q(lex.LIST_LINE)})) > 2 then 'list_formatting'""" if strict else ""
    return f"""case when len(spoken) < 2 then 'too_few_turns' when len(spoken) > 40 then 'too_many_turns' when len(replies) = 0 then 'no_assistant_turn'
    when regexp_replace("full", '[{SPACE}]', '', 'g') = '' then 'empty' when length("full") < 1 then 'too_short'
    when length(regexp_replace("full", {q(f"[^{chr(92)}p{{L}}{SPACE}.,!?']")}, '', 'g'))::double / greatest(length("full"), 1) < {alpha} then 'low_alpha_ratio'
    when length(regexp_replace(regexp_replace("full", '[\\p{{So}}\\x{{1F300}}-\\x{{1FAFF}}]', '', 'g'), '[\\x00-\\x7F]', '', 'g'))::double / greatest(length("full"), 1) > {foreign} then 'non_english'
    when len(list_filter(sizes, lambda z: (z.role = 'assistant' and z.n > {reply}) or z.n > {turn})) > 0 then
      list_transform(list_filter(sizes, lambda z: (z.role = 'assistant' and z.n > {reply}) or z.n > {turn}), lambda z: case when z.role = 'assistant' and z.n > {reply} then 'assistant_turn_too_long' else 'turn_too_long' end)[1]
    when list_sum(list_transform(replies, lambda z: z.n))::double / len(replies) > {mean} then 'assistant_too_verbose'{style} end"""


REJECT_REASONS = f"""{SIZES},
f as (select source, spoken, sizes, list_filter(sizes, lambda z: z.role = 'assistant') as replies,
  array_to_string(list_transform(spoken, lambda m: coalesce(m.content, '')), ' ') as "full",
  array_to_string(list_transform(list_filter(spoken, lambda m: m.role = 'assistant'), lambda m: coalesce(m.content, '')), ' ') as said from s),
r as (select source, {reason_sql(True)} as reason, {reason_sql(False)} as loose from f)
select source, reason, loose, count(*) as n from r group by all
"""


def duplicates(spark, d):
    """Copies among all raw talks, as the SQL has them; ``cleaned_talks`` looks among normalized talks that pass the rules."""
    rows = table(spark, d, "example_conversations").select("id", "messages")
    return cleaning.deduplicate(rows, conv.body(), "id").where("duplicate is not null").select("id", "duplicate")


BODY = "array_to_string(list_transform(coalesce(messages, []), lambda m: coalesce(m.role, '') || ': ' || coalesce(m.content, '')), chr(10))"
GRAMS = "case when len(w) < 8 then list_filter([array_to_string(w, ' ')], lambda s: s <> '') else list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) end"
DUPLICATES = f"""
with b as (select id, messages is null as none, {BODY} as body from example_conversations),
k as (select id, trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')) as key, regexp_extract_all(lower(body), '[a-z'']+') as w from b where not none),
x as (select *, min(id) over (partition by key) < id as exact from k),
g as (select id, unnest({GRAMS}) as gram from x where not exact),
n as (select id, gram, min(id) over (partition by gram) as first from g),
near as (select id from n group by id having count(*) > 3 and max(first) < id)
select id, 'exact_duplicate' as duplicate from x where exact union all select id, 'near_duplicate' from near
"""


def family_parts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("family", "source").alias("fam"))
    return cleaning.split_by_family(rows, F.col("fam")).groupBy("fam", "part").agg(F.count(F.lit(1)).alias("n"))


FAMILY_PARTS = """
with f as (select coalesce(family, source) as fam, coalesce(nullif(coalesce(family, source), ''), 'unknown') as name from documents),
u as (select fam, ('0x' || substr(sha256('1337:' || name), 1, 8))::bigint / 4294967296.0 as u from f)
select fam, case when u < 0.15 then 'test' when u < 0.15 + 0.15 then 'val' else 'train' end as part, count(*) as n from u group by all
"""


def stratified_val(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("ident"))
    return cleaning.split_stratified(rows, "source", "ident").where("part = 'val'").select("source", "ident")


STRATIFIED_VAL = """
with r as (select source, doc_id::varchar as ident, row_number() over (partition by source order by sha256(doc_id::varchar), doc_id::varchar) - 1 as rank, count(*) over (partition by source) as n from documents)
select source, ident from r where rank < case when n > 2 then greatest(1, round_even(n * 0.02, 0)) else 0 end
"""


def leakage_flagged(spark, d):
    frozen = table(spark, d, "elaboration_frozen").select(F.coalesce("known", "unknown").alias("text"))
    grams = cut(leakage.benchmark_grams(frozen, "text"))
    return leakage.flagged(table(spark, d, "documents"), "doc_id", "text", grams)


def gram_sql(n: int) -> str:
    return f"unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))"


LEAKAGE_FLAGGED = f"""
with b as (select regexp_extract_all(lower(coalesce(known, "unknown")), '[a-z'']+') as w from elaboration_frozen),
g as (select distinct {gram_sql(6)} as gram from b),
x as (select doc_id, regexp_extract_all(lower(text), '[a-z'']+') as w from documents where text is not null),
e as (select doc_id, {gram_sql(6)} as gram, unnest(range(0, len(w) - 5)) as pos from x where len(w) >= 6)
select doc_id, arg_min(gram, pos) as first_gram, count(*) as n_hits from e join g using (gram) group by doc_id
"""


def leakage_rates(spark, d):
    frozen = table(spark, d, "elaboration_frozen").select(F.coalesce("known", "unknown").alias("text"))
    documents = table(spark, d, "documents")
    hit = leakage.flagged(documents, "doc_id", "text", cut(leakage.benchmark_grams(frozen, "text"))).select("doc_id", F.lit(1).alias("hit"))
    per = documents.select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_flagged"))
    low, high = wilson(F.col("n_flagged"), F.col("n"))
    return per.select("source", "n", "n_flagged", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


WILSON = """round(greatest(0.0, ((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) as low,
  round(least(1.0, ((p + 3.8416 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) as high"""
LEAKAGE_RATES = f"""
with f as ({LEAKAGE_FLAGGED}), s as (select source, count(*) as n, count(f.doc_id) as n_flagged from documents left join f using (doc_id) group by source),
p as (select *, n_flagged::double / n as p from s) select source, n, n_flagged, {WILSON} from p
"""


def best_candidates(spark, d):
    rows = selection.candidates(table(spark, d, "example_teacher_candidates"))
    scored = rows.withColumn("score", selection.weighted(lambda k: F.col("given")[k]))
    return longs(selection.best_of(scored).select("id", "place", "score", "n_candidates"))


TOTAL = sum(lex.DIMENSION_WEIGHTS.values())
BEST_CANDIDATES = f"""
with e as (select id, unnest(candidates) as c, unnest(range(0, len(candidates))) as place from example_teacher_candidates),
s as (select id, place, round(({" + ".join(f"coalesce(c.scores['{k}'], 3.0) * {w}" for k, w in lex.DIMENSION_WEIGHTS.items())}) / {TOTAL}, 4) as score from e)
select id, arg_max(place, (score, -place))::bigint as place, max(score) as score, count(*) as n_candidates from s group by id
"""


def candidate_scores(spark, d):
    """The eight heuristic dimensions of every candidate and their weighted mean."""
    scored = selection.heuristic_scores(selection.candidates(table(spark, d, "example_teacher_candidates")))
    return longs(scored.withColumn("score", selection.weighted(F.col)).select("id", "place", *[F.round(k, 3).alias(k) for k in lex.DIMENSION_WEIGHTS], "score"))


def rejection_outcomes(spark, d):
    """Heuristic scores of all candidates, the best of each talk, and what becomes of it."""
    scored = selection.heuristic_scores(selection.candidates(table(spark, d, "example_teacher_candidates")))
    scored = scored.withColumn("score", selection.weighted(F.col)).drop("given", "earlier")
    return selection.outcome(selection.best_of(scored)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def _hits(column: str, phrases) -> str:
    return "(" + " + ".join(f"contains({column}, {q(p)})::int" for p in phrases) + ")"


_clip = lambda x: f"round(greatest(1.0::double, least(5.0::double, {x})), 3)"
_near = lambda a, b: f"case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect(list_distinct({a}), list_distinct({b})))::double / len(list_distinct(list_concat({a}, {b}))) end"
LOW = "low"
_DIMENSIONS = {
    "naturalness": _clip("4.0::double - case when bad then 2.5 else 0 end + case when regexp_matches(low, '\\b(?:i''?m|it''?s|that''?s|don''?t|yeah|nah|lol|haha|kinda)\\b') then 0.75 else 0 end - case when regexp_matches(text, '^\\p{Lu}') and regexp_matches(text, '[.!?]$') and n > 20 then 0.25 else 0 end"),
    "brevity": "case when n < 3 then 2.5 + n * 0.5 when n <= 25 then 5.0 else greatest(1.0::double, 5.0 - (n - 25) * 0.15::double) end",
    "relevance": f"case when back then {_clip('rel + 0.5')} else rel end",
    "emotional_appropriateness": f"case mood when 'negative' then case when {any_of('low', lex.CELEBRATION)} then 1.5 when {any_of('low', lex.EMPATHY)} then 4.75 else 2.5 end when 'positive' then case when {any_of('low', lex.EMPATHY)} then 1.5 when {any_of('low', lex.CELEBRATION)} then 4.75 else 3.0 end else 3.0 end",
    "continuation": "case when regexp_replace(low, '[.!]+$', '') in ('ok', 'yes', 'no', 'sure') then 1.5 when asks = 1 then 4.75 when asks > 2 then 2.0 when asks = 0 and back then 3.75 else 3.0 end",
    "non_repetition": f"case when echoed then least({_clip('5.0 - 12.0 * rep')}, 1.5) else {_clip('5.0 - 12.0 * rep')} end",
    "no_unnecessary_facts": f"case when {any_of('low', lex.GRACEFUL_IGNORANCE)} and contains(asked, '?') then 5.0 else {_clip(f'5.0 - 2.0 * {_hits(LOW, lex.CONFIDENT_FACTS)} - 0.15::double * digits')} end",
    "non_assistant_style": f"case when regexp_matches(text, '(?m)^\\s*(?:1\\.|-|\\*)\\s') then least({_clip(f'5.0 - 2.5 * {_hits(LOW, lex.AI_STYLE_MARKERS)} - case when n > 45 then 1.0 else 0.0 end')}, 1.5) else {_clip(f'5.0 - 2.5 * {_hits(LOW, lex.AI_STYLE_MARKERS)} - case when n > 45 then 1.0 else 0.0 end')} end",
}
SCORED = f"""
m as (select id, if(messages[len(messages)].role = 'assistant', messages[1:len(messages) - 1], messages) as c, candidates from example_teacher_candidates),
k as (select id, coalesce(list_filter(c, lambda x: x.role = 'user')[-1].content, '') as asked, list_transform(list_filter(c, lambda x: x.role = 'assistant'), lambda x: coalesce(x.content, ''))[-4:] as earlier, unnest(candidates) as cand, unnest(range(0, len(candidates))) as place from m),
t as (select id, place, asked, earlier, trim(coalesce(cand.content, ''), ' ') as text from k),
w as (select *, lower(text) as low, regexp_extract_all(lower(text), '[a-z'']+') as w, regexp_extract_all(lower(asked), '[a-z'']+') as u from t),
g as (select *, len(w) as n, case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end as g3 from w),
f as (select *, case when len(g3) > 0 then (len(g3) - len(list_distinct(g3)))::double / len(g3) else 0.0 end as rep, case when n > 0 then len(list_filter(w, lambda x: list_contains(u, x)))::double / n else 0.0 end as copied, {any_of("low", lex.BACKCHANNEL)} as back,
  length(text) - length(replace(text, '?', '')) as asks, len(regexp_extract_all(text, '\\p{{Nd}}')) as digits, case when {_hits("lower(asked)", lex.NEGATIVE_CUES)} > {_hits("lower(asked)", lex.POSITIVE_CUES)} then 'negative' when {_hits("lower(asked)", lex.POSITIVE_CUES)} > {_hits("lower(asked)", lex.NEGATIVE_CUES)} then 'positive' else 'neutral' end as mood,
  n = 0 or (n > 2 and len(list_filter(range(1, n), lambda i: w[i] = w[i + 1])) > 0) or len(list_filter(w, lambda x: not regexp_matches(x, '[aeiouy]')))::double / greatest(n, 1) > 0.35 or (n > 4 and len(list_distinct(w))::double / n < 0.45)
    or coalesce(list_bool_or(list_transform(list_distinct(string_split(text, '')), lambda c: c <> '' and contains(text, repeat(c, 5)))), false) as bad,
  coalesce(list_bool_or(list_transform(earlier, lambda e: {_near("regexp_extract_all(lower(e), '[a-z'']+')", "w")} > 0.6)), false) as echoed from g),
r as (select *, case when copied > 0.85 and n >= 4 then 1.0 else {_clip("2.0 + 6.0 * least(" + _near("w", "u") + ", 0.4)")} end as rel from f),
d as (select id, place, {", ".join(f"case when text = '' then 1.0::double else ({v})::double end as {k}" for k, v in _DIMENSIONS.items())} from r),
s as (select *, round(({" + ".join(f"{k} * {v}::double" for k, v in lex.DIMENSION_WEIGHTS.items())}) / {TOTAL}::double, 4) as score from d)
"""
CANDIDATE_SCORES = f"with {SCORED} select id, place, {', '.join(f'round({k}, 3) as {k}' for k in lex.DIMENSION_WEIGHTS)}, score from s"
REJECTION_OUTCOMES = f"""
with {SCORED},
b as (select *, row_number() over (partition by id order by score desc, place) as rank from s),
o as (select case when score < 3 then 'rejected_low_score' when {" or ".join(f"{k} < {v}" for k, v in lex.HARD_FLOORS.items())} then 'rejected_floor' else 'kept' end as outcome, score from b where rank = 1)
select outcome, count(*) as n, round(avg(score), 4) as mean_score from o group by outcome
"""


def token_lift(spark, d):
    """Add-one smoothed lift of a word in a language's documents: support of at least 25, lift of at least 1.5, best eight each."""
    from pyspark.sql import Window

    texts = table(spark, d, "documents").where("lang is not null").select(F.lower(F.substring("lang", 1, 2)).alias("skill"), "text")
    each = texts.select("skill", F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    both = each.groupBy("skill", "token").agg(F.count(F.lit(1)).alias("n"))
    per_token = both.groupBy("token").agg(F.sum("n").alias("nt"))
    per_skill = both.groupBy("skill").agg(F.sum("n").alias("ns"))
    whole = both.agg(F.sum("n").alias("total"), F.countDistinct("token").alias("v"))
    joined = both.join(per_token, "token").join(F.broadcast(per_skill), "skill").crossJoin(F.broadcast(whole))  # one row of totals
    lift = ((F.col("n") + 1).cast("double") / (F.col("ns") + F.col("v"))) / ((F.col("nt") + 1).cast("double") / (F.col("total") + F.col("v")))
    kept = joined.withColumn("lift", F.round(lift, 6)).where("nt >= 25 and lift >= 1.5")
    rank = F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("lift"), "token"))
    return longs(kept.withColumn("rank", rank).where("rank <= 8").select(F.col("skill").alias("lang"), "token", "n", "lift", "rank"))


TOKEN_LIFT = """
with f as (select lower(substr(lang, 1, 2)) as skill, text as fact from documents where lang is not null),
e as (select skill, unnest(list_distinct(regexp_extract_all(lower(fact), '[a-z'']+'))) as token from f where fact is not null),
b as (select skill, token, count(*) as n from e group by all),
j as (select *, sum(n) over (partition by token) as nt, sum(n) over (partition by skill) as ns, (select sum(n) from b) as total, (select count(distinct token) from b) as v from b),
l as (select skill, token, n, round(((n + 1)::double / (ns + v)) / ((nt + 1)::double / (total + v)), 6) as lift, nt from j),
r as (select skill, token, n, lift, row_number() over (partition by skill order by lift desc, token) as rank from l where nt >= 25 and lift >= 1.5)
select skill as lang, token, n, lift, rank from r where rank <= 8
"""


def rollups(spark, d):
    """Specs by skill, setting, both and all: grouping sets."""
    return table(spark, d, "latent_specs").groupingSets(
        [["skill"], ["setting"], ["skill", "setting"], []], "skill", "setting"
    ).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("sarcasm").alias("n_sarcasm"), F.sum("target_turns").alias("turns"))


ROLLUPS = """select skill, setting, grouping(skill, setting)::bigint as level, count(*) as n, count(*) filter (sarcasm) as n_sarcasm, sum(target_turns)::bigint as turns
from latent_specs group by grouping sets ((skill), (setting), (skill, setting), ())"""


def tidy_texts(spark, d):
    """The part of ``normalized_texts`` that its SQL follows: no NFKC, ``head`` is the first line's surface form alone."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", tidy(F.col("text")).alias("t"), surface(F.substring_index("text", "\n", 1)).alias("head"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("digest"), F.contains("t", F.lit("<link>")).alias("link"), F.contains("t", F.lit("<email>")).alias("email"), F.sha2("head", 256).alias("head"))


def _tidy_sql(t: str) -> str:
    for a, b in (("‘", "'"), ("’", "'"), ("‚", "'"), ("‛", "'"), ("“", '"'), ("”", '"'), ("„", '"'), ("–", "-"), ("—", "-"), ("…", "..."), (" ", " ")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    steps = [(r"https?://\S+|www\.\S+", "<link>"), (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "<email>"), (r"(?i)^\s*(?:user|assistant|human|ai|bot|a|b)\s*[:>]\s*", ""),
             (r"(?i)\b(\w+)\s+'\s*(s|t|re|ve|ll|d|m)\b", r"\1'\2"), (r"\s+([,.!?;:%])", r"\1"), (r"[!]{4,}", "!!!"), (r"[?]{4,}", "???"), (r"[.]{4,}", "..."), (r"[,]{4,}", ",,,"),
             (r"\n{2,}", "\n"), (r"[ \t\xa0]+", " "), (rf"^[{SPACE}]+|[{SPACE}]+$", "")]
    for a, b in steps:
        t = f"regexp_replace({t}, {q(a)}, {q(b)}, 'g')"
    return t


TIDY_TEXTS = f"""with t as (select doc_id, {_tidy_sql("text")} as t, trim(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+', ' ', 'g')) as head from documents where text is not null)
select doc_id, length(t) as n, sha256(t) as digest, contains(t, '<link>') as link, contains(t, '<email>') as email, sha256(head) as head from t"""


def normalized_texts(spark, d):
    """Whole texts in normalized and in surface form. No SQL: DuckDB has no NFKC; tested against a loop."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", normalize(F.col("text")).alias("t"), surface(F.col("text")).alias("s"))
    return rows.select(
        "doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("digest"), F.contains("t", F.lit("<link>")).alias("link"),
        F.contains("t", F.lit("<email>")).alias("email"), F.length("s").cast("bigint").alias("n_surface"), F.sha2("s", 256).alias("surface"),
    )


def source_sets(spark, d):
    """Set operations on sources: targeted and present, targeted only, present only."""
    have = table(spark, d, "documents").where("source is not null").select("source").distinct()
    want = table(spark, d, "mix_targets").select("source")
    label = lambda df, name: df.select("source", F.lit(name).alias("kind"))
    return label(have.intersect(want), "both").unionByName(label(want.exceptAll(have), "target_only")).unionByName(label(have.exceptAll(want), "document_only"))


SOURCE_SETS = """with h as (select distinct source from documents where source is not null), w as (select source from mix_targets)
select source, 'both' as kind from (select * from h intersect select * from w) union all select source, 'target_only' from (select * from w except all select * from h)
union all select source, 'document_only' from (select * from h except all select * from w)"""


def line_fields(spark, d):
    """Dumped JSON lines: validity and fields per writer file."""
    v = table(spark, d, "candidate_lines").select("source_file", F.try_parse_json("line").alias("v"))
    score = F.expr("try_variant_get(v, '$.score', 'double')")
    return v.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.count(score).alias("n_scored"),
        F.sum(F.round(score * 100).cast("bigint")).alias("score_cents"),
    )


LINE_FIELDS = """with v as (select source_file, json_valid(line) as ok, case when json_valid(line) then try_cast(line ->> '$.score' as double) end as score from candidate_lines)
select source_file, count(*) as n, count(*) filter (ok) as n_valid, count(score) as n_scored, sum(round(score * 100)::bigint)::bigint as score_cents from v group by source_file"""


def sample_every(spark, d, step: int = 50):
    """Systematic sample: every fiftieth document in the order of ids."""
    from talkmill.plans.skew import bucketed_rank

    rows = table(spark, d, "documents").select("doc_id", "lang", F.lit(1).alias("one"))
    ranked = bucketed_rank(rows, ["one"], [F.col("doc_id")], F.floor(F.col("doc_id") / 10_000), "place")
    return ranked.where(F.col("place") % step == 0).select("doc_id", "lang", "place")


SAMPLE_EVERY = "with r as (select doc_id, lang, row_number() over (order by doc_id) - 1 as place from documents) select doc_id, lang, place from r where place % 50 = 0"

QUERIES = {
    "corpus_stats": (corpus_stats, CORPUS_STATS), "cleaned_talks": (cleaned_talks, None), "reject_reasons": (reject_reasons, REJECT_REASONS), "duplicates": (duplicates, DUPLICATES),
    "family_parts": (family_parts, FAMILY_PARTS), "stratified_val": (stratified_val, STRATIFIED_VAL), "leakage_flagged": (leakage_flagged, LEAKAGE_FLAGGED),
    "leakage_rates": (leakage_rates, LEAKAGE_RATES), "best_candidates": (best_candidates, BEST_CANDIDATES), "candidate_scores": (candidate_scores, CANDIDATE_SCORES), "rejection_outcomes": (rejection_outcomes, REJECTION_OUTCOMES),
    "token_lift": (token_lift, TOKEN_LIFT), "rollups": (rollups, ROLLUPS), "tidy_texts": (tidy_texts, TIDY_TEXTS), "normalized_texts": (normalized_texts, None), "source_sets": (source_sets, SOURCE_SETS),
    "line_fields": (line_fields, LINE_FIELDS), "sample_every": (sample_every, SAMPLE_EVERY),
}
