"""Queries of the reply benchmarks, the evaluation summary, and the judge flow."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from talkmill.functions import banks, lexicons as lex
from talkmill.functions.metrics import ngrams, ratio, words
from talkmill.functions.normalize import surface, surface_of
from talkmill.operators import benches, evaluation as ev, selection
from talkmill.plans.lineage import cut
from talkmill.queries.corpus import longs, q
from talkmill.queries.dialogue import FACTS, LOOP, TURNS, conversation_turns
from talkmill.sources.tables import table

SURFACE = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
PAIRS = f"{TURNS}, l as (select id, source, turn, m.role as role, m.content as said, lag(m.role) over w as before, lag(m.content) over w as asked from t window w as (partition by id order by turn)), p as (select id, source, row_number() over (partition by id order by turn) as n, asked, said from l where role = 'assistant' and before = 'user')"
listed = lambda xs: ", ".join(q(x) for x in xs)


def rounded(df, places: int = 6):
    """Doubles to six places, whole numbers as bigint."""
    return longs(df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def replies_of(spark, d):
    """(id, source, n, asked, said) of the replies of all talks."""
    rows = conversation_turns(spark, d)
    sources = table(spark, d, "example_conversations").select("id", "source")
    return ev.reply_pairs(rows).join(sources, "id")


def variety_scores(spark, d):
    """Repeat rate, distinct share and commonest reply per source."""
    return rounded(benches.variety(benches.repeats(replies_of(spark, d)), "source"))


VARIETY = f"""
with {PAIRS}, s as (select *, {SURFACE.format("coalesce(said, '')")} as norm from p),
a as (select *, row_number() over (partition by id, norm order by n) > 1 and norm not in ({listed(banks.TRIVIAL_REPLIES)}) as again from s),
r as (select source, norm, count(*) as n, count(*) filter (again) as again from a group by source, norm)
select source, sum(n)::bigint as replies, round(sum(again)::double / sum(n), 6) as repeat_rate, round(count(*)::double / sum(n), 6) as distinct_ratio, round(max(n)::double / sum(n), 6) as top1_share from r group by source
"""


def variety_talks(spark, d):
    """Share of repeated replies of each talk, and whether it passes the variety gate."""
    per = benches.repeats(replies_of(spark, d)).groupBy("id").agg(ratio(F.count_if("again"), F.count(F.lit(1))).alias("repeat_rate"))
    return rounded(per.withColumn("passed", F.col("repeat_rate") <= 0.25))


VARIETY_TALKS = f"""
with {PAIRS}, s as (select *, {SURFACE.format("coalesce(said, '')")} as norm from p),
a as (select *, row_number() over (partition by id, norm order by n) > 1 and norm not in ({listed(banks.TRIVIAL_REPLIES)}) as again from s)
select id, round(count(*) filter (again)::double / count(*), 6) as repeat_rate, count(*) filter (again)::double / count(*) <= 0.25 as passed from a group by id
"""


def elaborations(spark, d):
    """(id, n, source, known, class): replies at odd places play the known half, those at even places the unknown one."""
    rows = replies_of(spark, d)
    known = F.col("n") % 2 == 1
    forbidden = F.array(*[F.lit(x) for x in banks.NOT_TO_INVENT])
    kind = benches.elaboration_class(F.coalesce("said", F.lit("")), F.coalesce("asked", F.lit("")), known, forbidden)
    return rows.select("id", "n", "source", known.alias("known"), kind.alias("class"))


def elaboration_classes(spark, d):
    return longs(elaborations(spark, d).groupBy("known", "class").agg(F.count(F.lit(1)).alias("n")))


def elaboration_scores(spark, d):
    return rounded(benches.elaboration_score(elaborations(spark, d), "source"))


ELABORATIONS = f"""
{PAIRS}, r as (select id, n, source, n % 2 = 1 as known, regexp_replace(lower(trim(coalesce(said, ''), ' ')), '[.!]+$', '') as r, list_distinct(list_filter(regexp_extract_all(lower(coalesce(asked, '')), '[a-z'']+'), lambda w: length(w) > 2 and w not in ({listed(banks.STOP_WORDS)}))) as ref from p),
v as (select *, regexp_extract_all(r, '[a-z'']+') as w0 from r),
w as (select *, list_concat(w0, list_transform(list_filter(w0, lambda x: length(x) > 3 and x like '%s'), lambda x: x[:-2])) as w from v),
c as (select id, n, source, known, case when r = '' then 'OTHER' when r in ({listed(banks.GENERIC_REPLIES)}) then 'GENERIC' when regexp_matches(r, {q("|".join(f"(?:{p})" for p in banks.HEDGES))}) then 'HEDGE'
  when not known and list_has_any(w, [{listed(banks.NOT_TO_INVENT)}]) and not list_has_any(w, ref) then 'FALSE_ELABORATION' when list_has_any(w, ref) then 'ELABORATION' else 'OTHER' end as class from w)
"""
ELABORATION_CLASSES = f"with {ELABORATIONS} select known, class, count(*) as n from c group by all"
ELABORATION_SCORES = f"""
with {ELABORATIONS}, a as (select source, count(*) as n, count(*) filter (class = 'ELABORATION')::double / count(*) as e,
  coalesce(count(*) filter (class = 'ELABORATION' and known)::double / nullif(count(*) filter (known), 0), 0) as ek, coalesce(count(*) filter (class = 'ELABORATION' and not known)::double / nullif(count(*) filter (not known), 0), 0) as eu,
  coalesce(count(*) filter (class = 'FALSE_ELABORATION' and not known)::double / nullif(count(*) filter (not known), 0), 0) as f, count(*) filter (class = 'HEDGE')::double / count(*) as h from c group by source)
select source, n, round(e, 6) as elaboration_rate, round(ek, 6) as elaboration_known, round(eu, 6) as elaboration_unknown, round(f, 6) as false_elaboration_rate, round(h, 6) as hedge_rate, round(e - 2.0::double * f - 0.25::double * h, 6) as composite from a
"""


def state_scores(spark, d):
    """Candidates 0 and 1 of each talk as the replies to the two sides of a counterfactual pair, per source."""
    rows = table(spark, d, "example_teacher_candidates").where("size(candidates) >= 2")
    said = lambda k: F.trim(F.coalesce(F.get("candidates", F.lit(k))["content"], F.lit("")))
    return rounded(benches.state_summary(rows.select("source", said(0).alias("positive"), said(1).alias("negative")), "source"))


def _state_sql(column: str) -> str:
    seen, arms = set(), []
    for kind, bank in banks.STATE_BANKS.items():
        arms.append(f"when {column} in ({listed(sorted({surface_of(x) for x in bank}))}) then '{kind}'")
    return f"case {' '.join(arms)} else 'other' end"


STATE_SCORES = f"""
with c as (select source, trim(coalesce(candidates[1].content, ''), ' ') as a, trim(coalesce(candidates[2].content, ''), ' ') as b from example_teacher_candidates where len(candidates) >= 2),
n as (select *, {SURFACE.format("a")} as na, {SURFACE.format("b")} as nb from c), k as (select *, {_state_sql("na")} as p, {_state_sql("nb")} as q from n)
select source, count(*) as pairs, round(avg((lower(a) <> lower(b))::int), 6) as divergence, round(avg((p = 'positive' and q = 'negative')::int), 6) as directional,
  round((sum((p = 'positive')::int) + sum((q = 'negative')::int))::double / (2 * count(*)), 6) as accuracy, {", ".join(f"round((sum((p = '{k}')::int) + sum((q = '{k}')::int))::double / (2 * count(*)), 6) as {k}_rate" for k in ("neutral", "attractor", "other"))}
from k group by source
"""


def core_scenarios(spark, d):
    return longs(benches.core_scenarios(table(spark, d, "intents")))


_SPELLINGS = ("p", "regexp_replace(p, '[?!.]+$', '')", "upper(p[1]) || substr(p, 2)", "upper(p)", "'so ' || p", "p || ' lol'")
CORE = f"""
e as (select name as intent, tier, unnest(held_out) as p, unnest(range(0, len(held_out))) as place from intents where name is not null),
s as ({" union all ".join([f"select intent, tier, place, {i} as kind, {x} as prompt, '' as context from e where p is not null" for i, x in enumerate(_SPELLINGS)] + [f"select intent, tier, place, {6 + i}, p, {q('|'.join(c))} from e where p is not null" for i, c in enumerate(banks.PREAMBLES)])}),
k as (select *, row_number() over (partition by intent, {SURFACE.format("prompt")}, context order by place, kind) as nth from s),
sc as (select intent, tier, place, kind, prompt, context from k where nth = 1)
"""
CORE_SCENARIOS = f"with {CORE} select intent, tier::bigint as tier, place, kind::bigint as kind, prompt, context from sc"


def core_results(spark, d):
    """Scenarios with a reply each: the intent's first target at even places, the scenario's own prompt at odd ones."""
    intents = table(spark, d, "intents")
    replies = intents.select(F.col("name").alias("intent"), F.get("targets", F.lit(0)).alias("target"))
    rows = benches.core_scenarios(intents).join(F.broadcast(replies), "intent").join(F.broadcast(benches.accepted_replies(intents)), "intent")  # a fixed table of 40 rows
    reply = F.when(F.col("place") % 2 == 0, F.col("target")).otherwise(F.col("prompt"))
    return rows.withColumn("correct", F.coalesce(F.array_contains("accepted", surface(reply)), F.lit(False)))


def core_rollup(spark, d):
    """Pass rates by intent, tier, context and over all, with the tier's gate."""
    rows = core_results(spark, d).withColumn("setting", F.when(F.col("context") == "", "bare").otherwise("with_context"))
    rolled = rows.groupingSets([["intent", "tier"], ["tier"], ["setting"], []], "intent", "tier", "setting").agg(
        F.count(F.lit(1)).alias("n"), ratio(F.count_if("correct"), F.count(F.lit(1))).alias("pass_rate")
    )
    return rounded(benches.tier_gates(rolled).withColumn("passed", F.when(F.col("tier").isNotNull(), F.col("passed"))).drop("target"))


CORE_RESULTS = f"""
{CORE}, ac as (select name as intent, targets[1] as target, list_transform(list_filter(list_concat(coalesce(targets, []), coalesce(accept, [])), lambda x: x is not null), lambda x: {SURFACE.format("x")}) as accepted from intents),
cr as (select sc.*, coalesce(list_contains(accepted, {SURFACE.format("case when place % 2 = 0 then target else prompt end")}), false) as correct, case when context = '' then 'bare' else 'with_context' end as setting from sc join ac using (intent))
"""
CORE_ROLLUP = f"""
with {CORE_RESULTS}, r as (select intent, tier, setting, count(*) as n, count(*) filter (correct)::double / count(*) as pass_rate from cr group by grouping sets ((intent, tier), (tier), (setting), ()))
select intent, tier::bigint as tier, setting, n, round(pass_rate, 6) as pass_rate, case when tier is not null then pass_rate >= case tier when 1 then 0.99::double when 2 then 0.95::double when 3 then 0.9::double else 1 end end as passed from r
"""


def next_boosts(spark, d):
    """Boosts of the next round after a round without any, the rate of each intent being its share of correct replies."""
    per = core_results(spark, d).groupBy("intent", "tier").agg(ratio(F.count_if("correct"), F.count(F.lit(1))).alias("pass_rate"))
    start = table(spark, d, "intents").where("tier > 1").select(F.col("name").alias("intent"), F.lit(2.0).alias("boost"))
    return rounded(benches.adapted_boosts(per, start))


NEXT_BOOSTS = f"""
with {CORE_RESULTS}, r as (select intent, tier, count(*) filter (correct)::double / count(*) as pass_rate from cr group by all),
m as (select intent, true as worst from r where pass_rate < case tier when 1 then 0.99::double when 2 then 0.95::double when 3 then 0.9::double else 1 end order by pass_rate, intent limit 5),
b as (select name as intent, 2.0::double as boost from intents where tier > 1), j as (select intent, coalesce(boost, 1.0::double) as now, worst from r full join b using (intent) left join m using (intent)),
x as (select intent, case when worst then case when now < 4 then round(least(4.0, now * 1.5), 3) else now end else round(greatest(1.0, now * 0.85), 3) end as boost from j) select intent, boost::double as boost from x where boost > 1
"""


def judge_requests(spark, d):
    """One packet per talk for a judge: id from model and talk, category, the transcript without system turns."""
    rows = table(spark, d, "example_conversations").where("id is not null and messages is not null")
    spoken = F.expr("filter(messages, m -> coalesce(m.role, '') <> 'system')")
    lines = F.transform(spoken, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return longs(rows.select(
        F.substr(F.sha2(F.concat(F.lit("model|"), "id"), 256), F.lit(1), F.lit(16)).alias("id"), F.col("id").alias("scenario_id"),
        F.coalesce(F.col("meta")["topic"], F.lit("unknown")).alias("category"), F.size(spoken).alias("n_messages"), F.sha2(F.array_join(lines, "\n"), 256).alias("transcript"),
        F.lit(len(banks.JUDGE_CRITERIA)).alias("n_criteria"),
    ))


JUDGE_REQUESTS = f"""
with r as (select id, meta, list_filter(messages, lambda m: coalesce(m.role, '') <> 'system') as s from example_conversations where id is not null and messages is not null)
select sha256('model|' || id)[1:16] as id, id as scenario_id, coalesce(meta['topic'], 'unknown') as category, len(s) as n_messages,
  sha256(array_to_string(list_transform(s, lambda m: coalesce(m.role, '') || ': ' || coalesce(m.content, '')), chr(10))) as transcript, {len(banks.JUDGE_CRITERIA)}::bigint as n_criteria from r
"""


def score_means(spark, d):
    """Mean of every criterion over all scored candidates, and the mean of the means."""
    each = table(spark, d, "example_teacher_candidates").select(F.explode("candidates").alias("c")).select("c.scores")
    return longs(benches.score_means(each))


SCORE_MEANS = """
with c as (select unnest(candidates) as c from example_teacher_candidates), e as (select unnest(map_entries(c.scores)) as e from c where c.scores is not null),
p as (select e.key as criterion, round(avg(e.value), 3) as mean, count(*) as n from e where e.value is not null group by 1)
select * from p union all select 'mean_all_criteria', round(avg(mean), 3), sum(n)::bigint from p having sum(n) > 0
"""


def vote_rates(spark, d):
    """Votes drawn from the talks' hashes, on the blind pairs of their first two candidates."""
    c = selection.candidates(table(spark, d, "example_teacher_candidates"))
    side = lambda place: c.where(F.col("place") == place).select("id", F.lit(1).alias("n"), F.col("text").alias("said"))
    name = lambda swapped: F.when(F.col("swapped") == swapped, "right").otherwise("left")
    key = ev.pairwise(side(0), side(1)).select("id", name(True).alias("a"), name(False).alias("b"))
    first = F.substr(F.sha2(F.concat(F.lit("vote|"), "id"), 256), F.lit(1), F.lit(1))
    choice = F.when(first < "6", "a").when(first < "b", "B").when(first < "e", "tie").otherwise("x")
    return longs(benches.vote_rates(table(spark, d, "example_teacher_candidates").select("id", choice.alias("choice")), key))


VOTE_RATES = """
with c as (select id, trim(coalesce(candidates[1].content, ''), ' ') as x, trim(coalesce(candidates[2].content, ''), ' ') as y, sha256('vote|' || id)[1] as f, contains('89abcdef', substr(sha256(id || '|1'), 1, 1)) as swapped from example_teacher_candidates where len(candidates) >= 2),
v as (select case when f < '6' then 'A' when f < 'b' then 'B' when f < 'e' then 'TIE' else 'X' end as choice, swapped from c where x <> y),
w as (select choice, case when choice in ('A', 'B') then case when (choice = 'A') = swapped then 'right' else 'left' end end as winner from v)
select count(*) as comparisons, count(*) filter (choice = 'TIE') as ties, count(*) filter (winner = 'left') as wins_left, count(*) filter (winner = 'right') as wins_right,
  round(count(*) filter (winner = 'left')::double / greatest(count(*), 1), 4) as rate_left, round(count(*) filter (winner = 'right')::double / greatest(count(*), 1), 4) as rate_right from w
"""


def prefix_contexts(spark, d):
    rows = benches.context_prefixes(table(spark, d, "example_conversations").where("id is not null and messages is not null").select("id", "messages"))
    text = F.array_join(F.transform("context", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    return longs(rows.select("id", "k", F.size("context").alias("n_context"), F.sha2(text, 256).alias("context")))


PREFIX_CONTEXTS = """
with s as (select id, list_filter(messages, lambda m: coalesce(m.role, '') <> 'system') as m from example_conversations where id is not null and messages is not null),
p as (select id, m, list_filter(range(0, len(m)), lambda i: m[i + 1].role = 'assistant') as places from s),
e as (select id, m, unnest(places) as place, unnest(range(0, len(places))) as k from p)
select id, k, place as n_context, sha256(array_to_string(list_transform(m[1:place], lambda x: coalesce(x.role, '') || ': ' || coalesce(x.content, '')), chr(10))) as context from e
"""


def transcript_metrics(spark, d):
    """The fourteen metrics of each talk."""
    return rounded(ev.transcript_metrics(ev.evaluate(conversation_turns(spark, d))), 4)


METRICS = f"""
{FACTS}, {LOOP},
u as (select id, unnest(w) as g from f), u1 as (select id, count(distinct g)::double / count(*) as d1 from u group by id),
b as (select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from f), u2 as (select id, count(distinct g)::double / count(*) as d2 from b group by id),
ov as (select id, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from f where len(w) >= 2),
o as (select a.id, avg(len(list_intersect(a.g, c.g))::double / len(list_distinct(list_concat(a.g, c.g)))) as overlap from ov a join ov c on a.id = c.id and a.n < c.n group by a.id),
a as (select id, count(*) as num_turns, avg(len(w)) as mean_len, max(len(w)) as max_len, count(*) filter (len(w) between 3 and 25)::double / count(*) as len_in_3_25, avg(rep) as mean_rep_ngram,
  count(*) filter (question)::double / count(*) as question_ratio, avg("copy") as mean_copy_ratio, count(*) filter (ai_style)::double / count(*) as ai_style_rate,
  count(*) filter (len(broken_reasons) > 0) as broken, count(*) filter (ungrammatical) as ungrammatical from f group by id),
tm as (select id, num_turns, mean_len, max_len, len_in_3_25, coalesce(d1, 0) as distinct_1, coalesce(d2, 0) as distinct_2, coalesce(d1, 0) as ttr, coalesce(overlap, 0) as self_overlap, mean_rep_ngram, question_ratio, mean_copy_ratio,
  "loop"::int::double as "loop", ai_style_rate, (question_ratio > 0.8)::int::double as excessive_questions, broken, ungrammatical from a left join u1 using (id) left join u2 using (id) left join o using (id) left join lp using (id))
"""
RATES = ("mean_len", "len_in_3_25", "distinct_1", "distinct_2", "ttr", "self_overlap", "mean_rep_ngram", "question_ratio", "mean_copy_ratio", "loop", "ai_style_rate", "excessive_questions")
TRANSCRIPT_METRICS = f"with {METRICS} select id, num_turns, max_len, {', '.join(f'round({q_}, 4) as {q_}' for q_ in [chr(34) + c + chr(34) for c in RATES])} from tm"


def evaluation_summary(spark, d):
    """Means of all metrics over the talks, broken, clean, loop and grammar rates, and the clean rates of prefixes of 5 and 10."""
    facts = ev.evaluate(conversation_turns(spark, d))
    return rounded(ev.summary(facts), 4)


EVALUATION_SUMMARY = f"""
with {METRICS},
cp as (select id, n, len(broken_reasons) > 0 as bad, w, norm, lag(norm) over (partition by id order by n) as pn, lag(w) over (partition by id order by n) as pw, nth from f),
px as (select k, id, max(n) as turns, bool_or(bad) or bool_or(norm <> '' and coalesce(norm = pn or (len(pw) > 0 and len(list_intersect(list_distinct(w), list_distinct(pw)))::double / len(list_distinct(list_concat(w, pw))) >= 0.8), false)) or bool_or(norm <> '' and nth >= 3) as dirty
  from cp, (values (5), (10)) v(k) where n <= k group by k, id having max(n) >= k)
select count(*) as scenarios, sum(num_turns)::bigint as turns, {", ".join(f'round(avg("{c}"), 4) as "{c}"' for c in RATES)}, round(sum(broken)::double / sum(num_turns), 4) as broken_turn_rate, round(count(*) filter (broken = 0)::double / count(*), 4) as clean_conversation_rate,
  round(1 - sum(ungrammatical)::double / sum(num_turns), 4) as grammatical_rate, (select round(coalesce(count(*) filter (not dirty)::double / nullif(count(*), 0), 0), 4) from px where k = 5) as clean_5turn_rate, (select round(coalesce(count(*) filter (not dirty)::double / nullif(count(*), 0), 0), 4) from px where k = 10) as clean_10turn_rate
from tm
"""


def clean_by_source(spark, d):
    """Share of talks without any broken reply per source, and the difference by which weak sources are found."""
    facts = ev.evaluate(conversation_turns(spark, d))
    per = facts.groupBy("id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.size("broken_reasons") > 0).alias("broken"))
    both = per.join(table(spark, d, "example_conversations").select("id", "source"), "id")
    rated = both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("broken") == 0), F.count(F.lit(1))).alias("clean"), ratio(F.sum("broken"), F.sum("turns")).alias("broken"))
    return rounded(rated.withColumn("margin", F.col("clean") - F.col("broken")))


CLEAN_BY_SOURCE = f"""
with {FACTS}, g1 as (select id, count(*) as turns, count(*) filter (len(broken_reasons) > 0) as b from f group by id), j as (select g1.*, c.source from g1 join example_conversations c using (id))
select source, count(*) as n, round(count(*) filter (b = 0)::double / count(*), 6) as clean, round(sum(b)::double / sum(turns), 6) as broken, round(count(*) filter (b = 0)::double / count(*) - sum(b)::double / sum(turns), 6) as margin from j group by source
"""


def reply_diversity(spark, d):
    """Distinct words, word pairs and replies over all replies of a source."""
    rows = replies_of(spark, d).withColumn("w", words(F.coalesce("said", F.lit(""))))
    grams = lambda c, name: rows.select("source", F.explode(c).alias("g")).groupBy("source", "g").count().groupBy("source").agg(ratio(F.count(F.lit(1)), F.sum("count")).alias(name))
    said = rows.groupBy("source", F.coalesce("said", F.lit("")).alias("said")).count().groupBy("source").agg(F.sum("count").alias("replies"), ratio(F.count(F.lit(1)), F.sum("count")).alias("unique_reply_frac"))
    out = said
    for part in (grams("w", "distinct_1"), grams(ngrams("w", 2), "distinct_2")):
        out = out.join(part.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return rounded(out)


REPLY_DIVERSITY = f"""
with {PAIRS}, w as (select source, coalesce(said, '') as said, regexp_extract_all(lower(coalesce(said, '')), '[a-z'']+') as w from p),
a as (select source, count(*) as replies, count(distinct said)::double / count(*) as u from w group by source),
x as (select source, unnest(w) as g from w), y as (select source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w),
d1 as (select source, count(distinct g)::double / count(*) as d1 from x group by source), d2 as (select source, count(distinct g)::double / count(*) as d2 from y group by source)
select a.source, replies, round(u, 6) as unique_reply_frac, round(d1, 6) as distinct_1, round(d2, 6) as distinct_2 from a left join d1 on a.source is not distinct from d1.source left join d2 on a.source is not distinct from d2.source
"""


def length_summary(spark, d):
    """Mean, median (interpolated), the value at place 0.9 n, and band shares of reply lengths per source.

    Order statistics come from running sums over the distinct lengths, so no group is sorted or collected.
    """
    rows = replies_of(spark, d).select("source", F.size(words(F.coalesce("said", F.lit("")))).alias("x"))
    return rounded(ev.length_summary(rows, "source", "x"))


LENGTH_SUMMARY = f"""
with {PAIRS}, w as (select source, len(regexp_extract_all(lower(coalesce(said, '')), '[a-z'']+')) as x from p), g as (select source, list_sort(list(x)) as l, avg(x) as m, median(x) as md, count(*) as n, count(*) filter (x = 1) as a, count(*) filter (x between 2 and 12) as b, count(*) filter (x between 13 and 30) as c, count(*) filter (x > 30) as e from w group by source)
select source, n, round(m, 6) as mean, md::double as median, l[floor(0.9 * n)::bigint + 1]::bigint as p90, round(a::double / n, 6) as frac_1_word, round(b::double / n, 6) as frac_2_12, round(c::double / n, 6) as frac_13_30, round(e::double / n, 6) as frac_over_30 from g
"""

QUERIES = {
    "variety_scores": (variety_scores, VARIETY), "variety_talks": (variety_talks, VARIETY_TALKS), "elaboration_classes": (elaboration_classes, ELABORATION_CLASSES), "elaboration_scores": (elaboration_scores, ELABORATION_SCORES),
    "state_scores": (state_scores, STATE_SCORES), "core_scenarios": (core_scenarios, CORE_SCENARIOS), "core_rollup": (core_rollup, CORE_ROLLUP), "next_boosts": (next_boosts, NEXT_BOOSTS),
    "judge_requests": (judge_requests, JUDGE_REQUESTS), "score_means": (score_means, SCORE_MEANS), "vote_rates": (vote_rates, VOTE_RATES), "prefix_contexts": (prefix_contexts, PREFIX_CONTEXTS),
    "transcript_metrics": (transcript_metrics, TRANSCRIPT_METRICS), "evaluation_summary": (evaluation_summary, EVALUATION_SUMMARY), "clean_by_source": (clean_by_source, CLEAN_BY_SOURCE),
    "reply_diversity": (reply_diversity, REPLY_DIVERSITY), "length_summary": (length_summary, LENGTH_SUMMARY),
}
