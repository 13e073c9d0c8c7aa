"""Queries of the reply harness."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from talkmill.functions import banks, lexicons as lex
from talkmill.functions.metrics import tokens, words
from talkmill.operators import evaluation as ev, harness as h, selection
from talkmill.queries.benches import PAIRS, listed, rounded
from talkmill.queries.corpus import any_of, longs, q
from talkmill.queries.dialogue import TURNS, _topic_sql, conversation_turns
from talkmill.sources.tables import table


def user_features(spark, d):
    """All fourteen signals of each user turn."""
    return longs(h.user_features(conversation_turns(spark, d)).drop("text"))


def feature_vectors(spark, d):
    """The thirteen-number vector of each user turn, summed with its place to check its order."""
    v = h.user_features(conversation_turns(spark, d)).withColumn("v", h.feature_vector())
    dot = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rounded(v.select("id", "turn", F.size("v").alias("n"), dot.alias("dot")))


_FLAGS = ", ".join(f"regexp_matches(text, {q(p)}) as {k}" for k, p in lex.TURN_FLAGS.items())
FEATURES = f"""
{TURNS}, r as (select id, turn, m.role as role, m.content as content, coalesce(rtrim(m.content, ' ') like '%?', false) as asks from t),
k as (select *, sum((role = 'assistant')::int) over (partition by id order by turn) as k from r),
b as (select *, coalesce(max(case when role = 'assistant' then k end) over w, 0) - coalesce(max(case when role = 'assistant' and not asks then k end) over w, 0) as run from k window w as (partition by id order by turn rows between unbounded preceding and 1 preceding)),
x as (select id, turn, run, trim(coalesce(content, ''), ' ') as text from b where role = 'user'),
uf as (select id, turn, text, length(text) as n_chars, len(regexp_extract_all(text, '\\S+')) as n_words, {_FLAGS}, contains(text, '?') as has_question_mark, regexp_matches(text, {q(banks.EMOJI)}) as has_emoji,
  length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 4 and not regexp_matches(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Lu}}]') as all_caps, run > 0 as prev_assistant_was_question, run::bigint as consecutive_assistant_questions from x)
"""
USER_FEATURES = f"with {FEATURES} select * exclude (text) from uf"
_VECTOR = " + ".join(f"{i + 1} * " + {"n_words": "least(n_words, 30)::double / 30.0::double", "consecutive_assistant_questions": "least(consecutive_assistant_questions, 3)::double / 3.0::double"}.get(k, f"{k}::int::double") for i, k in enumerate(h.FEATURES))
FEATURE_VECTORS = f"with {FEATURES} select id, turn, {len(h.FEATURES)}::bigint as n, round({_VECTOR}, 6) as dot from uf"


def shortcut_policies(spark, d):
    rows = h.user_features(conversation_turns(spark, d)).withColumn("policy", h.shortcut())
    return longs(rows.where("policy is not null").select("id", "turn", "policy", h.of_policy(F.col("policy"), 0).alias("action"), h.token_cap(F.col("policy")).alias("cap")))


_SHORTCUT = "case when has_goodbye and n_words <= 6 then 'P06' when has_thanks and n_words <= 5 and not has_question_mark then 'P04' when has_greeting and n_words <= 3 and not has_question_mark then 'P01' end"
_field = lambda column, k: f"case {column} " + " ".join(f"when '{p}' then {q(r[k])}" for p, r in banks.POLICIES.items()) + " end"
_cap = lambda column: f"case {column} " + " ".join(f"when '{p}' then {banks.LENGTH_TOKENS[r[2]]}" for p, r in banks.POLICIES.items()) + " end"
SHORTCUT_POLICIES = f"with {FEATURES}, p as (select id, turn, {_SHORTCUT} as policy from uf) select id, turn, policy, {_field('policy', 0)} as action, ({_cap('policy')})::bigint as cap from p where policy is not null"


def reply_validation(spark, d):
    """The failure codes of each reply under the policy that its question's shortcut gives, P18 for other questions of up to three words."""
    rows = conversation_turns(spark, d)
    users = h.user_features(rows).withColumn("policy", F.coalesce(h.shortcut(), F.when(F.col("n_words") <= 3, "P18"))).select("id", (F.col("turn") + 1).alias("turn"), "policy", "has_goodbye")
    replies = ev.reply_pairs(rows).join(users, ["id", "turn"])
    w = Window.partitionBy("id").orderBy("n").rowsBetween(-8, -1)
    text = F.coalesce("said", F.lit(""))
    staged = replies.withColumn("text", text).withColumn("earlier", F.collect_list("text").over(w)).withColumn("w", words(text))
    codes = h.failures(F.col("text"), "w", F.col("policy"), F.col("earlier"), F.col("has_goodbye"))
    return longs(staged.withColumn("codes", codes).where("size(codes) > 0").select("id", "n", "policy", F.array_join("codes", ",").alias("failures")))


REPLY_VALIDATION = f"""
with {FEATURES}, po as (select id, turn + 1 as turn, coalesce({_SHORTCUT}, case when n_words <= 3 then 'P18' end) as policy, has_goodbye from uf),
ll as (select id, turn, role, coalesce(content, '') as said, lag(role) over (partition by id order by turn) as before from r),
rp as (select id, turn, said as text, row_number() over (partition by id order by turn) as n from ll where role = 'assistant' and before = 'user'),
j as (select rp.*, policy, has_goodbye, list(lower(trim(text, ' '))) over (partition by rp.id order by n rows between 8 preceding and 1 preceding) as earlier, regexp_extract_all(lower(text), '[a-z'']+') as w from rp join po using (id, turn)),
c as (select id, n, policy, list_filter([case when trim(text, ' ') = '' then 'empty' end, case when regexp_matches(text, {q(lex.SPECIAL_TOKEN)}) then 'special_token_leak' end, case when regexp_matches(text, {q(lex.BOILERPLATE)}) then 'ai_boilerplate' end,
  case when lower(trim(text, ' ')) not in ({listed(banks.FREE_REPEATS)}) and list_contains(coalesce(earlier, []), lower(trim(text, ' '))) then 'exact_repeat' end,
  case when len(w) >= 6 and len(w) - 2 <> len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) then 'internal_loop' end,
  case when len(regexp_extract_all(text, '\\S+')) > 2 * {_cap('policy')} then 'length_' || len(regexp_extract_all(text, '\\S+')) || '>' || 2 * {_cap('policy')} end,
  case when {_field('policy', 1)} = 'NO_QUESTION' and trim(text, ' ') like '%?' then 'question_when_forbidden' end, case when {_field('policy', 0)} = 'CLOSE' and trim(text, ' ') like '%?' then 'question_while_closing' end,
  case when has_goodbye and trim(text, ' ') like '%?' then 'question_after_farewell' end], lambda x: x is not null) as codes from j)
select id, n, policy, array_to_string(codes, ',') as failures from c where len(codes) > 0
"""


def policy_confidence(spark, d):
    """Confidence of the distribution that a softmax over the word counts of a talk's candidates gives."""
    c = table(spark, d, "example_teacher_candidates").where("size(candidates) > 0")
    logits = F.transform("candidates", lambda x: F.size(words(F.coalesce(x["content"], F.lit("")))).cast("double") / 4)
    staged = c.select("id", logits.alias("l")).withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    staged = staged.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)))
    return rounded(staged.select("id", h.confidence(F.col("p"), 0.6, 0.2).alias("c")).select("id", "c.*"))


POLICY_CONFIDENCE = """
with c as (select id, list_transform(candidates, lambda x: len(regexp_extract_all(lower(coalesce(x.content, '')), '[a-z'']+'))::double / 4) as l from example_teacher_candidates where len(candidates) > 0),
e as (select id, list_transform(l, lambda x: exp(x - list_max(l))) as e from c), p as (select id, list_transform(e, lambda x: x / list_sum(e)) as p from e),
s as (select id, p, list_reverse_sort(p) as o from p), m as (select id, o[1] as top1, o[1] - coalesce(o[2], 0) as margin, (0.0::double - list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * ln(x)))) / case when len(p) > 1 then ln(len(p)) else 1 end as entropy from s)
select id, round(top1, 6) as top1, round(margin, 6) as margin, round(entropy, 6) as entropy, case when top1 >= 0.6 and margin >= 0.2 then 'HIGH' when top1 >= 0.6 * 0.75 and margin >= 0.2 * 0.5 then 'MEDIUM' else 'LOW' end as status from m
"""


def reranked(spark, d):
    """The candidate a harness would pick under a policy: P18 for talks whose id ends on 0 to 4, none for the others."""
    c = selection.candidates(table(spark, d, "example_teacher_candidates"))
    rows = c.select("id", "place", "text", F.when(F.substr(F.reverse("id"), F.lit(1), F.lit(1)) < "5", "P18").alias("policy"), "earlier")
    return rounded(h.reranked(rows).select("id", "place", "policy", "match"))


def _f1(words_: str, pid: str) -> str:
    sets = [sorted(set(re.findall(r"[a-z']+", x))) for x in banks.POLICIES[pid][3]]
    parts = [f"case when len(list_intersect({words_}, [{listed(s)}])) > 0 then 2.0::double * len(list_intersect({words_}, [{listed(s)}])) / (len({words_}) + {len(s)}) else 0 end" for s in sets]
    return f"greatest({', '.join(parts)})"


RERANKED = f"""
with m as (select id, if(messages[len(messages)].role = 'assistant', messages[1:len(messages) - 1], messages) as c, candidates from example_teacher_candidates),
k as (select id, list_transform(list_filter(c, lambda x: x.role = 'assistant'), lambda x: lower(trim(coalesce(x.content, ''), ' ')))[-4:] as earlier, candidates from m),
e as (select id, earlier, unnest(candidates) as c, unnest(range(0, len(candidates))) as place from k),
t as (select id, earlier, place, trim(coalesce(c.content, ''), ' ') as text, case when id[-1] < '5' then 'P18' end as policy from e),
w as (select *, regexp_extract_all(lower(text), '[a-z'']+') as w, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) as s from t),
s as (select *, (lower(text) not in ({listed(banks.FREE_REPEATS)}) and list_contains(earlier, lower(text))) or (len(w) >= 6 and len(w) - 2 <> len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))))) as rep,
  case when policy is not null then round({_f1("s", "P18")}, 2) else 0.0::double end as match from w),
r as (select *, row_number() over (partition by id order by rep, case when policy is not null and text like '%?' then 1 else 0 end, case when policy is not null then greatest(0, len(regexp_extract_all(text, '\\S+')) - 4) else 0 end, -match, place) as k from s)
select id, place, policy, match from r where k = 1
"""


def recent_repeats(spark, d):
    """Replies that stand among the eight before them, or share four words in a row with one."""
    rows = h.recent_repeats(ev.reply_pairs(conversation_turns(spark, d)))
    return longs(rows.where("seen_recently or long_ngram").select("id", "n", "seen_recently", "long_ngram"))


RECENT_REPEATS = f"""
with {PAIRS}, s as (select id, n, lower(trim(coalesce(said, ''), ' ')) as plain from p), w as (select *, regexp_extract_all(plain, '[a-z'']+') as w from s),
g as (select *, case when len(w) < 4 then [] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end as g from w),
near as (select *, coalesce(list(plain) over x, []) as earlier, coalesce(flatten(list(g) over x), []) as eg from g window x as (partition by id order by n rows between 8 preceding and 1 preceding)),
f as (select id, n, list_contains(earlier, plain) as seen_recently, list_has_any(g, eg) as long_ngram from near) select * from f where seen_recently or long_ngram
"""


def talk_states(spark, d):
    """Topics in the order of change, last topic, mood and name of each talk."""
    return h.app_state(conversation_turns(spark, d)).select("id", F.array_join("topics", ",").alias("topics"), "topic", "mood", "name")


TALK_STATES = f"""
with {TURNS}, u as (select id, turn, m.content as text, lower(m.content) as low from t where m.role = 'user' and m.content is not null), s as (select *, {_topic_sql()} as best from u),
f as (select id, turn, case when best.n > 0 then best.topic end as topic, case {" ".join(f"when {any_of('low', v)} then {q(k)}" for k, v in lex.MOOD_WORDS.items())} end as mood, regexp_extract(text, {q(banks.USER_NAME)}, 1) as name from s),
b as (select *, last_value(topic ignore nulls) over (partition by id order by turn rows between unbounded preceding and 1 preceding) as prev from f)
select id, coalesce(string_agg(topic, ',' order by turn) filter (topic is not null and topic is distinct from prev), '') as topics, arg_max(topic, turn) filter (topic is not null) as topic, arg_max(mood, turn) filter (mood is not null) as mood,
  arg_max(upper(name[1]) || lower(name[2:]), turn) filter (name <> '' and lower(name) not in ({listed(banks.NOT_A_NAME)})) as name from b group by id
"""


def user_details(spark, d):
    """The last five things each user tells of themselves."""
    return h.user_details(conversation_turns(spark, d)).select("id", F.array_join("details", " | ").alias("details"))


USER_DETAILS = f"""
with {TURNS}, u as (select id, turn, regexp_extract_all(m.content, {q(banks.USER_FACT)}) as f from t where m.role = 'user' and m.content is not null),
e as (select id, turn, unnest(f) as fact, unnest(range(0, len(f))) as place from u), p as (select id, turn, place, trim(regexp_replace(fact, '\\s+', ' ', 'g'), ' ') as fact from e),
a as (select id, fact, min({{'t': turn, 'p': place}}) as pos from p where fact <> '' group by id, fact), r as (select *, row_number() over (partition by id order by pos desc) as k from a)
select id, string_agg(fact, ' | ' order by pos) as details from r where k <= 5 group by id
"""


def recalled_facts(spark, d):
    """Remembered pets and homes that a later message of the talk asks about."""
    rows = conversation_turns(spark, d).where("role = 'user' and content is not null")
    found = F.array(*[F.struct(F.lit(k).alias("slot"), F.lower(F.trim(F.regexp_extract("content", p, 1))).alias("value")) for k, p in lex.MEMORY_SLOTS.items()])
    facts = rows.select("id", "turn", F.explode(found).alias("s")).select("id", "turn", "s.slot", "s.value").where("value <> ''")
    return longs(h.recalled(facts, rows))


RECALLED = f"""
with {TURNS}, u as (select id, turn, m.content as text from t where m.role = 'user' and m.content is not null),
e as ({" union all ".join(f"select id, turn, {q(k)} as slot, lower(trim(regexp_extract(text, {q(p)}, 1))) as value from u" for k, p in lex.MEMORY_SLOTS.items())}),
k as (select *, lead(turn) over (partition by id, slot order by turn) as until from e where value <> ''),
j as (select k.id, u.turn, slot, value, lower(u.text) as low from k join u on u.id = k.id and u.turn > k.turn and (until is null or u.turn <= until))
select id, turn, slot, value from j where {" or ".join(f"(slot = {q(k)} and {any_of('low', v)})" for k, v in banks.RECALL_CUES.items() if k != "job")}
"""


def referent_words(spark, d):
    """The last three content words of each user turn with their weights."""
    rows = conversation_turns(spark, d).where("role = 'user' and content is not null")
    return rows.select("id", F.col("turn").cast("bigint").alias("turn"), F.posexplode(h.referent_weights(F.col("content"))).alias("place", "r")).select("id", "turn", F.col("place").cast("bigint").alias("place"), "r.word", "r.weight")


REFERENT_WORDS = f"""
with {TURNS}, u as (select id, turn, list_filter(regexp_extract_all(lower(m.content), '[a-z'']+'), lambda w: length(w) > 2 and w not in ({listed(banks.STOP_WORDS)}))[-3:] as k from t where m.role = 'user' and m.content is not null),
e as (select id, turn, len(k) as n, unnest(k) as word, unnest(range(0, len(k))) as place from u) select id, turn, place, word, round(0.6 + 0.4 * (place + 1)::double / n, 6)::double as weight from e
"""

QUERIES = {
    "user_features": (user_features, USER_FEATURES), "feature_vectors": (feature_vectors, FEATURE_VECTORS), "shortcut_policies": (shortcut_policies, SHORTCUT_POLICIES), "reply_validation": (reply_validation, REPLY_VALIDATION),
    "policy_confidence": (policy_confidence, POLICY_CONFIDENCE), "reranked": (reranked, RERANKED), "recent_repeats": (recent_repeats, RECENT_REPEATS), "talk_states": (talk_states, TALK_STATES),
    "user_details": (user_details, USER_DETAILS), "recalled_facts": (recalled_facts, RECALLED), "referent_words": (referent_words, REFERENT_WORDS),
}
