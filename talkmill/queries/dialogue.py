"""Queries on turns: layouts, merging, reply metrics, prefixes, probes, features, memory, context windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from talkmill.functions import lexicons as lex
from talkmill.functions.metrics import mood, ratio, tokens, topic
from talkmill.operators import conversations as conv, evaluation as ev, packing, selection
from talkmill.queries.corpus import any_of, longs, q
from talkmill.sources.readers import transcript
from talkmill.sources.tables import table

TURNS = "t as (select id, source, unnest(messages) as m, unnest(range(0, len(messages))) as turn from example_conversations)"


def conversation_turns(spark, d):
    return conv.turns(table(spark, d, "example_conversations"))


def turn_rows(spark, d):
    return longs(conversation_turns(spark, d))


TURN_ROWS = f"with {TURNS} select id, source, turn, m.role as role, m.content as content from t"


def merged_turns(spark, d):
    """Same-role runs of message rows in the order of their ids as one turn; only runs of two or more."""
    rows = table(spark, d, "message_rows").select(F.col("conv_id").alias("id"), F.col("msg_id").alias("turn"), F.lower(F.trim("role")).alias("role"), "content")
    return longs(conv.merge_consecutive(rows).where("n_merged > 1"))


MERGED_TURNS = """
with t as (select conv_id as id, msg_id as turn, lower(trim(role, ' ')) as role, content from message_rows),
l as (select id, turn, role, coalesce(content, '') as content, lag(role) over w as before, lag(content) over w as prev from t window w as (partition by id order by turn)),
f as (select *, coalesce(role <> before or role = 'system', true) as fresh from l),
i as (select *, case when fresh then '' when regexp_matches(prev, '[.!?,]$') then ' ' else '. ' end as sep, sum(fresh::int) over (partition by id order by turn) as island from f)
select id, min(turn) as turn, arg_min(role, turn) as role, string_agg(sep || content, '' order by turn) as content, count(*) as n_merged from i group by id, island having count(*) > 1
"""


def turn_shape(spark, d):
    """Turn counts, alternation and the length of the truncated head of each talk."""
    talks = table(spark, d, "example_conversations").where("size(messages) > 0").withColumn("spoken", conv.spoken())
    return talks.select(
        "id", conv.num_turns().cast("bigint").alias("n_turns"), conv.alternates("spoken").alias("alternates"),
        F.size(conv.truncate(6)).cast("bigint").alias("n_head"), F.length(conv.body()).cast("bigint").alias("n_body"),
    )


TURN_SHAPE = """
with s as (select id, messages, list_filter(messages, lambda m: coalesce(m.role, '') <> 'system') as spoken, messages[1:6] as head from example_conversations where len(messages) > 0)
select id, len(spoken) as n_turns,
  len(list_filter(range(1, len(spoken)), lambda i: spoken[i].role is not distinct from spoken[i + 1].role)) = 0 as alternates,
  case when head[len(head)].role = 'user' then len(head) - 1 else len(head) end as n_head,
  length(array_to_string(list_transform(messages, lambda m: coalesce(m.role, '') || ': ' || coalesce(m.content, '')), chr(10))) as n_body
from s
"""


def with_chosen(spark, d):
    """The last turn of each talk after the winning candidate has replaced it."""
    talks = table(spark, d, "example_teacher_candidates").withColumn("chosen", F.lit(None).cast("int"))
    return conv.apply_chosen(talks).select("id", F.size("messages").cast("bigint").alias("n"), F.get("messages", F.size("messages") - 1)["content"].alias("reply"))


WITH_CHOSEN = """
with p as (select id, messages, candidates, list_max(list_transform(range(1, len(candidates) + 1), lambda i: {'s': coalesce(candidates[i].score, -1e9), 'i': i})).i as place from example_teacher_candidates),
w as (select id, messages, candidates, trim(candidates[place].content, ' ') as win from p)
select id, case when coalesce(len(candidates), 0) = 0 then len(messages) when messages[len(messages)].role = 'assistant' then len(messages) else len(messages) + 1 end as n,
  case when coalesce(len(candidates), 0) = 0 then messages[len(messages)].content else win end as reply
from w where coalesce(len(candidates), 0) = 0 or win <> ''
"""

W = "regexp_extract_all(lower(coalesce({}, '')), '[a-z'']+')"
FACTS = f"""
{TURNS},
l as (select id, turn, m.role as role, m.content as said, lag(m.role) over w as before, lag(m.content) over w as asked from t window w as (partition by id order by turn)),
p as (select id, turn, row_number() over (partition by id order by turn) as n, asked, said from l where role = 'assistant' and before = 'user'),
w as (select *, {W.format("said")} as w, {W.format("asked")} as u from p),
g as (select *, array_to_string(w, ' ') as norm, case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end as g3 from w),
r as (select *, case when len(g3) > 0 then (len(g3) - len(list_distinct(g3)))::double / len(g3) else 0.0 end as rep,
  case when len(w) > 0 then len(list_filter(w, lambda x: list_contains(u, x)))::double / len(w) else 0.0 end as "copy",
  len(w) = 0 or (len(w) > 2 and len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0)
    or len(list_filter(w, lambda x: not regexp_matches(x, '[aeiouy]')))::double / greatest(len(w), 1) > 0.35
    or (len(w) > 4 and len(list_distinct(w))::double / len(w) < 0.45)
    or coalesce(list_bool_or(list_transform(list_distinct(string_split(coalesce(said, ''), '')), lambda c: c <> '' and contains(coalesce(said, ''), repeat(c, 5)))), false) as ungrammatical,
  {any_of("lower(coalesce(said, ''))", lex.AI_STYLE_MARKERS)} as ai_style,
  row_number() over (partition by id, array_to_string(w, ' ') order by n) as nth from g),
f as (select *, len(w) > 0 and nth > 1 as again, contains(coalesce(said, ''), '?') as question,
  list_filter([case when trim(coalesce(said, ''), ' ') in ('', '...') then 'empty' end, case when len(w) > 60 then 'too_long' end, case when rep > 0.34 then 'intra_repetition' end,
    case when "copy" >= 0.85 and len(w) >= 4 then 'context_copy' end, case when ungrammatical then 'ungrammatical' end, case when ai_style then 'ai_assistant_style' end,
    case when len(w) > 0 and nth > 1 then 'repeats_previous_turn' end], lambda x: x is not null) as broken_reasons from r)
"""


def reply_facts(spark, d):
    f = ev.turn_facts(ev.reply_pairs(conversation_turns(spark, d)))
    return longs(f.select("id", "n", F.size("w").alias("n_words"), F.round("rep", 6).alias("rep"), F.round("copy", 6).alias("copy"), "question", F.concat_ws(",", "broken_reasons").alias("broken")))


REPLY_FACTS = f"""with {FACTS} select id, n, len(w) as n_words, round(rep, 6) as rep, round("copy", 6) as "copy", question, array_to_string(broken_reasons, ',') as broken from f"""


def broken_counts(spark, d):
    f = ev.turn_facts(ev.reply_pairs(conversation_turns(spark, d)))
    return f.select(F.explode("broken_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


BROKEN_COUNTS = f"with {FACTS}, e as (select unnest(broken_reasons) as reason from f) select reason, count(*) as n from e group by reason"


def talk_metrics(spark, d):
    """The metrics of its SQL; ``talk_averages`` has the two averages."""
    m = ev.talk_metrics(ev.evaluate(conversation_turns(spark, d))).drop("mean_rep_ngram", "mean_copy_ratio")
    return longs(m.withColumn("distinct_1", F.round("distinct_1", 6)).withColumn("distinct_2", F.round("distinct_2", 6)))


def talk_averages(spark, d):
    """Per talk: mean repeated and mean copied share of its replies."""
    m = ev.talk_metrics(ev.evaluate(conversation_turns(spark, d)))
    return m.select("id", F.round("mean_rep_ngram", 6).alias("mean_rep_ngram"), F.round("mean_copy_ratio", 6).alias("mean_copy_ratio"))


TALK_AVERAGES = f"""with {FACTS} select id, round(avg(rep), 6) as mean_rep_ngram, round(avg("copy"), 6) as mean_copy_ratio from f group by id"""
LOOP = """
k as (select id, n, norm, w, lag(norm) over (partition by id order by n) as pn, lag(w) over (partition by id order by n) as pw, nth from f),
lp as (select id, bool_or(norm <> '' and coalesce(norm = pn or (len(pw) > 0 and len(list_intersect(list_distinct(w), list_distinct(pw)))::double / len(list_distinct(list_concat(w, pw))) >= 0.8), false)) or bool_or(norm <> '' and nth >= 3) as "loop" from k group by id)
"""
TALK_METRICS = f"""
with {FACTS}, {LOOP},
u as (select id, unnest(w) as g from f), u1 as (select id, count(distinct g) as u1, count(*) as t1 from u group by id),
b as (select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from f), u2 as (select id, count(distinct g) as u2, count(*) as t2 from b group by id),
a as (select id, count(*) as num_turns, sum(len(w))::bigint as words, max(len(w)) as max_len, count(*) filter (len(w) between 3 and 25) as in_band, count(*) filter (question) as questions,
  count(*) filter (ai_style) as ai_style, count(*) filter (ungrammatical) as ungrammatical, count(*) filter (len(broken_reasons) > 0) as broken from f group by id)
select id, num_turns, words, max_len, in_band, questions, ai_style, ungrammatical, broken, "loop",
  round(case when coalesce(t1, 0) > 0 then u1::double / t1 else 0.0 end, 6) as distinct_1, round(case when coalesce(t2, 0) > 0 then u2::double / t2 else 0.0 end, 6) as distinct_2,
  questions::double / num_turns > 0.8 as excessive_questions
from a left join u1 using (id) left join u2 using (id) left join lp using (id)
"""


def clean_prefixes(spark, d):
    """Prefixes of 3 and 5 replies; ``clean_prefixes_long`` has the reference's 5 and 10."""
    return _clean(spark, d, (3, 5))


def clean_prefixes_long(spark, d):
    """Prefixes of 5 and 10 replies, as the reference reports them."""
    return _clean(spark, d, (5, 10))


def _clean(spark, d, prefixes):
    """Talks of at least n replies whose first n are sound and don't loop, for each n."""
    facts = ev.evaluate(conversation_turns(spark, d))
    out = None
    for n in prefixes:
        head = facts.where(F.col("n") <= n).groupBy("id").agg(F.count_if(F.size("broken_reasons") > 0).alias("broken"), F.max("n").alias("m"))
        rows = head.where(F.col("m") >= n).join(ev.looped(facts, n), "id")
        part = rows.agg(F.lit(n).cast("bigint").alias("prefix"), F.count(F.lit(1)).alias("n_talks"), F.count_if((F.col("broken") == 0) & ~F.col("loop")).alias("n_clean"))
        out = part if out is None else out.unionByName(part)
    return out


def _prefix(n: int) -> str:
    return f"""select {n} as prefix, count(*) as n_talks, count(*) filter (broken = 0 and not "loop") as n_clean from
(select id, count(*) filter (len(broken_reasons) > 0) as broken from f where n <= {n} group by id having max(n) >= {n}) h join
(select id, bool_or(norm <> '' and coalesce(norm = pn or (len(pw) > 0 and len(list_intersect(list_distinct(w), list_distinct(pw)))::double / len(list_distinct(list_concat(w, pw))) >= 0.8), false)) or bool_or(norm <> '' and nth >= 3) as "loop" from k where n <= {n} group by id) l using (id)"""


CLEAN_PREFIXES = f"with {FACTS}, {LOOP} select prefix::bigint as prefix, n_talks, n_clean from ({_prefix(3)} union all {_prefix(5)})"

CLEAN_PREFIXES_LONG = f"with {FACTS}, {LOOP} select prefix::bigint as prefix, n_talks, n_clean from ({_prefix(5)} union all {_prefix(10)})"


def reply_overlap(spark, d):
    """Mean bigram overlap between the replies of one talk."""
    return ev.self_overlap(ev.evaluate(conversation_turns(spark, d))).select("id", "overlap_pairs", F.round("overlap", 6).alias("overlap"))


REPLY_OVERLAP = f"""
with {FACTS}, s as (select id, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from f where len(w) >= 2)
select a.id, count(*) as overlap_pairs, round(avg(len(list_intersect(a.g, b.g))::double / len(list_distinct(list_concat(a.g, b.g)))), 6) as overlap from s a join s b on a.id = b.id and a.n < b.n group by a.id
"""


def probe_results(spark, d):
    """Probes on the second reply: something expected, something forbidden, no confident made-up fact."""
    replies = ev.reply_pairs(conversation_turns(spark, d))
    ids = table(spark, d, "example_conversations").where("id is not null").select("id")
    probes = ids.withColumn("turn", F.lit(2)).withColumn("expect_any", F.array(F.lit("the"), F.lit("A"), F.lit("e"))).withColumn("forbid_any", F.array(F.lit("sorry"))).withColumn("forbid_confident", F.lit(True))
    return ev.run_probes(probes, replies).groupBy("reason", "passed").agg(F.count(F.lit(1)).alias("n"))


PROBE_RESULTS = f"""
with {TURNS}, l as (select id, turn, m.role as role, m.content as said, lag(m.role) over (partition by id order by turn) as before from t),
p as (select id, lower(said) as said, row_number() over (partition by id order by turn) as n from l where role = 'assistant' and before = 'user'),
j as (select c.id, p.said from example_conversations c left join p on p.id = c.id and p.n = 2),
r as (select case when said is null then 'missing_turn' when not (contains(said, 'the') or contains(said, 'a') or contains(said, 'e')) then 'expected_content_absent' when contains(said, 'sorry') then 'forbidden_content_present'
  when {any_of("said", lex.CONFIDENT_FACTS)} and not {any_of("said", lex.GRACEFUL_IGNORANCE)} then 'fabricated_fact' else 'ok' end as reason from j)
select reason, reason = 'ok' as passed, count(*) as n from r group by all
"""


def blind_pairs(spark, d):
    """First against second candidate of each talk as blind pairs."""
    c = selection.candidates(table(spark, d, "example_teacher_candidates"))
    side = lambda place: c.where(F.col("place") == place).select("id", F.lit(1).alias("n"), F.col("text").alias("said"))
    return longs(ev.pairwise(side(0), side(1)))


BLIND_PAIRS = """
with c as (select id, trim(coalesce(candidates[1].content, ''), ' ') as x, trim(coalesce(candidates[2].content, ''), ' ') as y from example_teacher_candidates where len(candidates) >= 2),
s as (select *, contains('89abcdef', substr(sha256(id || '|1'), 1, 1)) as swapped from c where x <> y)
select id, 1::bigint as n, case when swapped then y else x end as a, case when swapped then x else y end as b, swapped from s
"""


def turn_features(spark, d):
    text = F.coalesce("content", F.lit(""))
    rows = conversation_turns(spark, d).where("role = 'user'")
    flags = [text.rlike(p).alias(k) for k, p in lex.TURN_FLAGS.items()]
    return longs(rows.select("id", "turn", F.size(tokens(text)).alias("n_words"), F.contains(text, F.lit("?")).alias("has_question_mark"), *flags, topic(F.lower(text)).alias("topic"), mood(F.lower(text)).alias("mood")))


def _topic_sql() -> str:
    scores = ", ".join(f"{{'n': {' + '.join(f'contains(low, {q(w)})::int' for w in v)}, 'i': {-i}, 'topic': {q(k)}}}" for i, (k, v) in enumerate(lex.TOPIC_KEYWORDS.items()))
    return f"list_max([{scores}])"


TURN_FEATURES = f"""
with {TURNS}, u as (select id, turn, coalesce(m.content, '') as text, lower(coalesce(m.content, '')) as low from t where m.role = 'user'), s as (select *, {_topic_sql()} as best from u)
select id, turn, len(regexp_extract_all(text, '\\S+')) as n_words, contains(text, '?') as has_question_mark, {", ".join(f"regexp_matches(text, {q(p)}) as {k}" for k, p in lex.TURN_FLAGS.items())},
  case when best.n > 0 then best.topic end as topic, case {" ".join(f"when {any_of('low', v)} then {q(k)}" for k, v in lex.MOOD_WORDS.items())} end as mood from s
"""


def memory_slots(spark, d):
    """The memory slots that SQL can follow; ``memory_slots_all`` has the job slot too."""
    return _memory(spark, d, lex.MEMORY_SLOTS)


def memory_slots_all(spark, d):
    """All five memory slots. No SQL: the job pattern looks ahead; tested on a fixture."""
    return _memory(spark, d, lex.MEMORY_SLOTS | {"job": lex.JOB})


def _memory(spark, d, slots):
    """The last value of each memory slot of a talk and its confidence (.9 if restated, .75 if new)."""
    users = conversation_turns(spark, d).where("role = 'user' and content is not null")
    found = F.array(*[F.struct(F.lit(k).alias("slot"), F.lower(F.trim(F.regexp_extract("content", p, 1))).alias("value")) for k, p in slots.items()])
    each = users.select("id", "turn", F.explode(found).alias("s")).select("id", "turn", "s.slot", "s.value").where("value <> ''")
    each = each.where((F.col("slot") != "job") | ~F.split("value", r"\s").getItem(0).isin(*lex.NOT_JOBS))
    w = Window.partitionBy("id", "slot").orderBy("turn")
    conf = each.withColumn("confidence", F.when(F.lag("value").over(w) == F.col("value"), 0.9).otherwise(0.75))
    return longs(conf.groupBy("id", "slot").agg(F.max("turn").alias("turn"), F.max_by("value", "turn").alias("value"), F.max_by("confidence", "turn").alias("confidence")))


MEMORY_SLOTS = f"""
with {TURNS}, u as (select id, turn, m.content as text from t where m.role = 'user' and m.content is not null),
e as ({" union all ".join(f"select id, turn, {q(k)} as slot, lower(trim(regexp_extract(text, {q(p)}, 1))) as value from u" for k, p in lex.MEMORY_SLOTS.items())}),
c as (select *, case when lag(value) over (partition by id, slot order by turn) = value then 0.9::double else 0.75::double end as confidence from e where value <> '')
select id, slot, max(turn) as turn, arg_max(value, turn) as value, arg_max(confidence, turn) as confidence from c group by id, slot
"""


def context_windows(spark, d):
    """The turns of each talk that fit twelve turns and a budget of sixty words."""
    rows = conversation_turns(spark, d).drop("source")
    kept = packing.context_window(rows, F.size(tokens(F.coalesce("content", F.lit("")))), 12, 60)
    return longs(kept.select("id", "turn", "tokens", "upto"))


CONTEXT_WINDOWS = f"""
with {TURNS}, r as (select id, turn, m.role as role, len(regexp_extract_all(coalesce(m.content, ''), '\\S+')) as tokens from t where m.role <> 'system'),
l as (select *, max(case when role = 'user' then turn end) over (partition by id) as last from r),
b as (select *, row_number() over (partition by id order by turn desc) as back, sum(tokens) over (partition by id order by turn desc) as upto from l where turn <= last)
select id, turn, tokens, upto::bigint as upto from b where back <= 12 and (upto <= 60 or back = 1)
"""


def question_runs(spark, d):
    """Longest run of replies that end with a question mark."""
    replies = ev.reply_pairs(conversation_turns(spark, d)).withColumn("q", F.coalesce(F.rtrim("said").endswith("?"), F.lit(False)))
    run = F.col("n") - F.coalesce(F.max(F.when(~F.col("q"), F.col("n"))).over(Window.partitionBy("id").orderBy("n")), F.lit(0))
    return longs(replies.withColumn("run", run).groupBy("id").agg(F.max("run").alias("longest_run")))


QUESTION_RUNS = f"""
with {TURNS}, l as (select id, turn, m.role as role, m.content as said, lag(m.role) over (partition by id order by turn) as before from t),
p as (select id, row_number() over (partition by id order by turn) as n, coalesce(rtrim(said, ' ') like '%?', false) as q from l where role = 'assistant' and before = 'user'),
r as (select id, n - coalesce(max(case when not q then n end) over (partition by id order by n), 0) as run from p)
select id, max(run)::bigint as longest_run from r group by id
"""


def transcript_turns(spark, d):
    """Labels and continuation lines of a transcript as one expression."""
    rows = table(spark, d, "example_transcript_format").where("conversation is not null")
    return longs(rows.select("id", F.posexplode(transcript(F.col("conversation"))).alias("turn", "m")).select("id", "turn", "m.role", "m.content"))


_LABEL = r"(?i)^\s*(user|assistant|human|ai|a|b|speaker\s*1|speaker\s*2|me|them|you|bot)\s*[:>-]\s*"
TRANSCRIPT_TURNS = f"""
with t as (select id, list_filter(list_transform(regexp_split_to_array(conversation, '\\r\\n|[\\n\\x0B\\x0C\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, ' ')), lambda x: x <> '') as lines from example_transcript_format where conversation is not null),
l as (select id, unnest(lines) as line, unnest(range(0, len(lines))) as pos from t),
r as (select id, pos, case when regexp_matches(line, '{_LABEL}') then case when regexp_replace(lower(regexp_extract(line, '{_LABEL}', 1)), '\\s+', ' ', 'g') in ('assistant', 'ai', 'bot', 'b', 'speaker 2', 'speaker2', 'them') then 'assistant' else 'user' end end as role, trim(regexp_replace(line, '{_LABEL}', ''), ' ') as text from l),
n as (select *, sum((role is not null)::int) over (partition by id order by pos) as k from r), g as (select id, k, max(role) as role, trim(string_agg(text, ' ' order by pos), ' ') as content from n where k > 0 group by id, k)
select id, row_number() over (partition by id order by k) - 1 as turn, role, content from g where content <> ''
"""


def reply_lengths(spark, d):
    """Replies by length band with their share of questions."""
    replies = ev.reply_pairs(conversation_turns(spark, d)).withColumn("n", F.size(tokens(F.coalesce("said", F.lit("")))))
    band = F.when(F.col("n") <= 1, "1").when(F.col("n") <= 12, "2-12").when(F.col("n") <= 30, "13-30").otherwise("over 30")
    asks = F.contains(F.coalesce("said", F.lit("")), F.lit("?"))
    return replies.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(ratio(F.count_if(asks), F.count(F.lit(1))), 6).alias("question_share"))


REPLY_LENGTHS = f"""
with {TURNS}, l as (select id, turn, m.role as role, coalesce(m.content, '') as said, lag(m.role) over (partition by id order by turn) as before from t),
p as (select said, len(regexp_extract_all(said, '\\S+')) as n from l where role = 'assistant' and before = 'user')
select case when n <= 1 then '1' when n <= 12 then '2-12' when n <= 30 then '13-30' else 'over 30' end as band, count(*) as n, round(count(*) filter (contains(said, '?'))::double / count(*), 6) as question_share from p group by 1
"""

QUERIES = {
    "turn_rows": (turn_rows, TURN_ROWS), "merged_turns": (merged_turns, MERGED_TURNS), "turn_shape": (turn_shape, TURN_SHAPE), "with_chosen": (with_chosen, WITH_CHOSEN),
    "reply_facts": (reply_facts, REPLY_FACTS), "broken_counts": (broken_counts, BROKEN_COUNTS), "talk_metrics": (talk_metrics, TALK_METRICS), "talk_averages": (talk_averages, TALK_AVERAGES),
    "clean_prefixes": (clean_prefixes, CLEAN_PREFIXES), "clean_prefixes_long": (clean_prefixes_long, CLEAN_PREFIXES_LONG), "reply_overlap": (reply_overlap, REPLY_OVERLAP), "probe_results": (probe_results, PROBE_RESULTS),
    "blind_pairs": (blind_pairs, BLIND_PAIRS), "turn_features": (turn_features, TURN_FEATURES), "memory_slots": (memory_slots, MEMORY_SLOTS), "memory_slots_all": (memory_slots_all, None),
    "context_windows": (context_windows, CONTEXT_WINDOWS), "question_runs": (question_runs, QUESTION_RUNS), "transcript_turns": (transcript_turns, TRANSCRIPT_TURNS),
    "reply_lengths": (reply_lengths, REPLY_LENGTHS),
}
