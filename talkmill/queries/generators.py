"""Queries of the generators, on small banks, and the pieces of corpus preparation that they feed."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from talkmill.functions import lexicons as lex
from talkmill.functions.metrics import ratio
from talkmill.operators import cleaning, conversations as conv, evaluation as ev, generate
from talkmill.plans.skew import bucketed_rank
from talkmill.queries.benches import PAIRS, listed, rounded
from talkmill.queries.corpus import SIZES, longs, q, reason_sql
from talkmill.queries.dialogue import conversation_turns
from talkmill.sources.tables import table

FRAMES = (
    ("bought", ("kettle", "ladder", "violin", "bicycle", "teapot", "curtain"), ("i bought a {n}", "we found a {n} at the market"), ("is the {n} any good?", "what is the {n} like?", "where does the {n} go?", "a {n}, nice")),
    ("visited", ("harbour", "castle", "island", "museum", "valley"), ("we went to the {n}", "i saw the {n} at last"), ("how was the {n}?", "is the {n} far?", "who came to the {n}?")),
)
ACKS, FILLERS = ("mm", "right", "i see"), ("yeah", "not bad", "early days")
OPENERS = {"work": {"positive": ("the shift went well", "i got the raise"), "negative": ("the shift was long", "i lost the client")}, "home": {"positive": ("the roof is mended", "the garden blooms"), "negative": ("the roof leaks", "the garden is dry")}, "sport": {"positive": ("we won", "a new record"), "negative": ("we lost", "my knee hurts")}}
TARGETS = {"positive": ("good to hear", "lovely", "nice one", "well done", "great news"), "negative": ("that is rough", "sorry to hear it", "oh no", "hang in there", "poor you")}
CORRECTIONS = {"positive": ("no wait, it fell through",), "negative": ("no wait, it got sorted", "turns out it is fine")}
PROBES = ("yeah", "mm", "anyway")
SHAPES = (("plain", 0.55), ("corrected", 0.25), ("drifted", 0.20))
SKILLS = (("memory_state", 3.0), ("epistemic", 2.0), ("coherence_callback", 2.0), ("casual", 5.0))
LENGTHS = (("short", 4, 7), ("medium", 8, 14), ("long", 15, 30))
SPEC_BANKS = {"topic": ("rain", "soup", "trains", "paint"), "user_mood": ("calm", "tense", "glad")}
FACTS = (("my cat is called Pip", "what is my cat called?", "Pip"), ("i live in Rome", "where do i live?", "in Rome"), ("i work as a baker", "what is my job?", "you are a baker"))


TALK_OPENERS = {"bad": ("the {t} was awful", "i am done with the {t}"), "good": ("the {t} was lovely", "finally some good {t}"), "plain": ("about the {t}", "so, the {t}")}
TALK_REPLIES = {"bad": ("that is rough", "sorry to hear it", "oh no"), "good": ("lovely", "nice one"), "plain": ("mm", "right", "go on")}
TOPICS = ("work", "garden", "bus", "soup", "choir")
PARTS = {
    "switch": (0.18, (("anyway, did you see the rain?", "yeah, all day"), ("so, new shoes", "nice, which ones?"))),
    "unknown": (0.10, (("who won in 1911?", "no idea"), ("what is my shoe size?", "you never told me"))),
    "boundary": (0.08, (("tell me a secret", "i would rather not"),)),
}
ENDINGS = (("got to go", "see you"), ("night", "sleep well"), ("talk later", "sure"))


def u(name: str, ident: str) -> str:
    return f"(('0x' || sha256('1337:{name}:' || {ident})[1:8])::bigint / 4294967296.0::double)"


def one_of(bank, name: str, ident: str) -> str:
    return f"([{listed(bank)}])[floor({u(name, ident)} * {len(bank)})::int + 1]"


def frame_examples(spark, d, n: int = 2_000):
    rows = generate.frame_examples(spark, n, FRAMES, ACKS, FILLERS)
    return longs(rows.select("k", "frame", "noun", F.size("messages").alias("n"), F.array_join("messages", " / ").alias("messages")))


def _frames_sql() -> str:
    case = lambda make: "case f " + " ".join(f"when {i} then {make(fr)}" for i, fr in enumerate(FRAMES)) + " end"
    nth = lambda step: case(lambda fr: f"([{listed(fr[3])}])[(r + {step}) % {len(fr[3])} + 1]")
    again = [f"({u(f'again {s}', 'k')} < 0.45)::int" for s in (1, 2)]
    more = ", ".join(
        f"case when turns >= {s} then {one_of(FILLERS, f'filler {s}', 'k')} end, case when turns >= {s} then case when {again[s - 1]} = 1 then {nth(' + '.join(again[:s]))} else {one_of(ACKS, f'ack {s}', 'k')} end end"
        for s in (1, 2)
    )
    return f"""
with b as (select k, floor({u("frame", "k")} * {len(FRAMES)})::int as f, 1 + floor({u("turns", "k")} * 2) as turns from (select unnest(range(0, 2000)) as k)),
c as (select *, {case(lambda fr: q(fr[0]))} as frame, {case(lambda fr: one_of(generate.train_part(fr[1]), "noun", "k"))} as noun, {case(lambda fr: f"floor({u('reply', 'k')} * {len(fr[3])})::int")} as r from b),
m as (select k, frame, noun, list_filter([{case(lambda fr: one_of(fr[2], "user", "k"))}, {nth("0")}, {more}], lambda x: x is not null) as m from c)
select k, frame, noun, len(m) as n, replace(array_to_string(m, ' / '), '{{n}}', noun) as messages from m
"""


def state_pairs(spark, d, n: int = 1_000):
    rows = generate.state_pairs(spark, n, OPENERS, TARGETS, CORRECTIONS, PROBES, SHAPES)
    return rows.select("pair", "valence", "family", "shape", "final_valence", F.array_join("messages", " / ").alias("messages"))


def _pairs_sql() -> str:
    topics = sorted(OPENERS)
    opener = lambda t, name: "case " + " ".join(f"when {t} = {i} and valence = '{v}' then {one_of(OPENERS[x][v], name, 'pair')}" for i, x in enumerate(topics) for v in ("positive", "negative")) + " end"
    side = lambda column, make: f"case when {column} = 'positive' then {make('positive')} else {make('negative')} end"
    target = lambda column, step: side(column, lambda v: f"([{listed(TARGETS[v])}])[(floor({u('target', 'pair')} * {len(TARGETS[v])})::int + {step}) % {len(TARGETS[v])} + 1]")
    probes = ", ".join(f"case when n > {i} then {one_of(PROBES, f'probe {i}', 'pair')} end, case when n > {i} then {target('final_valence', 2 + i)} end" for i in range(3))
    return f"""
with p as (select pair, unnest(['positive', 'negative']) as valence from (select unnest(range(0, 1000)) as pair)),
s as (select *, case when {u("shape", "pair")} < 0.55::double then 'plain' when {u("shape", "pair")} < 0.55::double + 0.25::double then 'corrected' else 'drifted' end as shape, floor({u("topic", "pair")} * {len(topics)})::int as t, 1 + floor({u("probes", "pair")} * 3) as n from p),
o as (select *, (t + 1 + floor({u("other topic", "pair")} * {len(topics) - 1})::int) % {len(topics)} as o, case when shape = 'corrected' then case when valence = 'positive' then 'negative' else 'positive' end else valence end as final_valence from s)
select pair, valence, 'state:' || ([{listed(topics)}])[t + 1] || ':' || shape || ':' || lpad(pair::varchar, 5, '0') as family, shape, final_valence,
  array_to_string(list_filter([{opener("t", "opener")}, {target("valence", 0)}, case shape when 'corrected' then {side("valence", lambda v: one_of(CORRECTIONS[v], "correction", "pair"))} when 'drifted' then {opener("o", "other opener")} end, case when shape <> 'plain' then {target("final_valence", 1)} end, {probes}], lambda x: x is not null), ' / ') as messages from o
"""


def planned_specs(spark, d, n: int = 2_000):
    return longs(generate.latent_specs(spark, n, SKILLS, LENGTHS, ("memory_state", "coherence_callback"), SPEC_BANKS))


def _specs_sql() -> str:
    upto, arms, whole = 0.0, [], sum(w for _, w in SKILLS)
    for name, w in SKILLS[:-1]:
        upto += w / whole
        arms.append(f"when {u('skill', 'k')} < {upto!r}::double then '{name}'")
    field = lambda j: f"([{', '.join(q(x[j]) if isinstance(x[j], str) else str(x[j]) for x in LENGTHS)}])[l + 1]"
    two = lambda a, b: f"case when {u('distance', 'k')} < 0.5 then '{a}' else '{b}' end"
    return f"""
with a as (select k, case {" ".join(arms)} else '{SKILLS[-1][0]}' end as skill from (select unnest(range(0, 2000)) as k)),
b as (select *, skill || ':' || lpad(floor({u("family", "k")} * 400)::int::varchar, 3, '0') as family, case when skill in ('memory_state', 'coherence_callback') and {u("long", "k")} < 0.55 then {len(LENGTHS) - 1} else floor({u("length", "k")} * {len(LENGTHS)})::int end as l from a),
c as (select *, {field(0)} as length_profile, ({field(1)} + floor({u("turns", "k")} * ({field(2)} - {field(1)} + 1)))::bigint as target_turns, (('0x' || sha256(family)[1:12])::bigint % 10000) / 10000.0::double as at_ from b)
select 'q-' || lpad(k::varchar, 7, '0') as id, family, case when at_ < 0.12 then 'validation' when at_ < 0.24 then 'test' else 'train' end as split, skill, length_profile, target_turns,
  (case when {u("people", "k")} < 0.5 then 1 when {u("people", "k")} < 0.85 then 2 else 3 end)::bigint as n_people,
  case when target_turns <= 7 then '0-128' when target_turns <= 11 then {two("0-128", "129-256")} when target_turns <= 16 then {two("129-256", "257-512")} when target_turns <= 22 then {two("257-512", "513-768")} else {two("513-768", "769-1024")} end as reference_distance,
  {", ".join(f"{one_of(bank, name, 'k')} as {name}" for name, bank in SPEC_BANKS.items())} from c
"""


def exchange_pool(spark, d):
    """(place, asked, said): the exchanges of all talks, numbered over hash buckets."""
    rows = ev.reply_pairs(conversation_turns(spark, d)).where("asked is not null and said is not null")
    keyed = rows.select("asked", "said", F.sha2(F.concat_ws("|", "id", F.col("n").cast("string")), 256).alias("h"), F.lit(1).alias("one"))
    return bucketed_rank(keyed, ["one"], [F.col("h")], F.substring("h", 1, 3), "place").select("place", "asked", "said")


def spliced_talks(spark, d, n: int = 500):
    rows = generate.spliced(spark, n, exchange_pool(spark, d), FACTS)
    return longs(rows.select("k", "fact", "gap", F.size("messages").alias("n"), F.sha2(F.array_join("messages", "\n"), 256).alias("digest")))


SPLICED = f"""
with {PAIRS}, ex as (select asked, said, row_number() over (order by sha256(id || '|' || n)) - 1 as place, count(*) over () as m from p where asked is not null and said is not null),
g as (select k, (2 + floor({u("gap", "k")} * 13) + case when {u("far", "k")} < 0.35 then floor({u("more", "k")} * 13) else 0 end)::bigint as gap, floor({u("fact", "k")} * {len(FACTS)})::bigint as fact from (select unnest(range(0, 500)) as k)),
i as (select *, unnest(range(1, gap + 1)) as i from g), j as (select k, fact, gap, i, asked, said from i join ex on place = ('0x' || sha256('1337:turn:' || k || ':' || i)[1:12])::bigint % m)
select k, fact, gap, 2 * gap + 3 as n, sha256(([{listed(f[0] for f in FACTS)}])[fact + 1] || chr(10) || string_agg(asked || chr(10) || said, chr(10) order by i) || chr(10) || ([{listed(f[1] for f in FACTS)}])[fact + 1] || chr(10) || ([{listed(f[2] for f in FACTS)}])[fact + 1]) as digest from j group by k, fact, gap
"""


def offline_talks(spark, d, n: int = 2_000):
    rows = generate.offline_talks(spark, n, TOPICS, TALK_OPENERS, TALK_REPLIES, FILLERS)
    return longs(rows.select("k", "topic", "valence", F.array_join("messages", " / ").alias("messages"), F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates")))


def _by_valence(make) -> str:
    return "case valence " + " ".join(f"when '{v}' then {make(v)}" for v in sorted(TALK_OPENERS)) + " end"


def _offline_sql() -> str:
    more = ", ".join(f"case when n > {i} then {one_of(FILLERS, f'follow {i}', 'k')} end, case when n > {i} then {_by_valence(lambda v, i=i: one_of(TALK_REPLIES[v], f'reply {i}', 'k'))} end" for i in (1, 2, 3))
    return f"""
with a as (select k, ([{listed(TOPICS)}])[k % {len(TOPICS)} + 1] as topic, {one_of(sorted(TALK_OPENERS), "valence", "k")} as valence, 2 + floor({u("exchanges", "k")} * 3) as n from (select unnest(range(0, 2000)) as k))
select k, topic, valence, replace(array_to_string(list_filter([{_by_valence(lambda v: one_of(TALK_OPENERS[v], "opener", "k"))}, {_by_valence(lambda v: one_of(TALK_REPLIES[v], "reply 0", "k"))}, {more}], lambda x: x is not null), ' / '), '{{t}}', topic) as messages,
  (case when {u("candidates", "k")} < 0.3 then case valence {" ".join(f"when '{v}' then {len(x)}" for v, x in TALK_REPLIES.items())} end else 0 end)::bigint as n_candidates from a
"""


def combined_talks(spark, d, n: int = 2_000):
    """Talks of optional parts; the bad valence is the heavy one."""
    rows = generate.combined_talks(spark, n, TALK_OPENERS, TALK_REPLIES, PARTS, (0.22, FACTS), (0.55, ENDINGS), "bad")
    return rows.select("k", "valence", F.array_join("used", ",").alias("used"), F.array_join("messages", " / ").alias("messages"))


def _combined_sql() -> str:
    pair = lambda bank, name, j: one_of([x[j] for x in bank], name, "k")
    on = {"memory": f"{u('memory', 'k')} < 0.22", **{name: f"({u(name, 'k')} < {share}" + ("" if name == "unknown" else " and valence <> 'bad'") + ")" for name, (share, _) in PARTS.items()}, "closer": f"{u('closer', 'k')} < 0.55"}
    said = [_by_valence(lambda v: one_of(TALK_OPENERS[v], "opener", "k")), _by_valence(lambda v: one_of(TALK_REPLIES[v], "reply", "k"))]
    said += [f"case when {on['memory']} then {x} end" for x in (pair(FACTS, "fact", 0), _by_valence(lambda v: one_of(TALK_REPLIES[v], "noted", "k")))]
    said += [f"case when {on[name]} then {pair(bank, f'which {name}', j)} end" for name, (_, bank) in PARTS.items() for j in (0, 1)]
    said += [f"case when {on['memory']} then {pair(FACTS, 'fact', j)} end" for j in (1, 2)] + [f"case when {on['closer']} then {pair(ENDINGS, 'which closer', j)} end" for j in (0, 1)]
    solid = lambda xs, sep: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x is not null), '{sep}')"
    return f"with a as (select k, {one_of(sorted(TALK_OPENERS), 'valence', 'k')} as valence from (select unnest(range(0, 2000)) as k)) select k, valence, {solid([f'case when {c} then {q(name)} end' for name, c in on.items()], ',')} as used, {solid(said, ' / ')} as messages from a"


def with_given_choice(spark, d):
    """The last turn of each stored talk after its chosen candidate, or else its best one, has replaced it."""
    talks = conv.apply_chosen(table(spark, d, "example_conversations").where("messages is not null"))
    return talks.select("id", F.size("messages").cast("bigint").alias("n"), F.get("messages", F.size("messages") - 1)["content"].alias("reply"))


WITH_GIVEN_CHOICE = """
with p as (select id, messages, candidates, coalesce(chosen, list_max(list_transform(range(1, len(candidates) + 1), lambda i: {'s': coalesce(candidates[i].score, -1e9), 'i': i})).i - 1) as place from example_conversations where messages is not null),
w as (select id, messages, candidates, trim(candidates[place + 1].content, ' ') as win from p)
select id, case when coalesce(len(candidates), 0) = 0 then len(messages) when messages[len(messages)].role = 'assistant' then len(messages) else len(messages) + 1 end as n, case when coalesce(len(candidates), 0) = 0 then messages[len(messages)].content else win end as reply
from w where coalesce(len(candidates), 0) = 0 or win <> ''
"""


def downweighted(spark, d):
    """Rejected talks stay with a tenth of their weight and the reason as a flag."""
    parts = cleaning.with_parts(table(spark, d, "example_conversations")).withColumn("reason", cleaning.reject_reason(cleaning.FilterConfig(downweight=True)))
    flagged = cleaning.flagged(parts.withColumn("weight", cleaning.weight()))
    return rounded(flagged.groupBy("source", F.col("meta")["filter_flag"].alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight")), 3)


DOWNWEIGHTED = f"""{SIZES},
f as (select source, spoken, sizes, list_filter(sizes, lambda z: z.role = 'assistant') as replies, array_to_string(list_transform(spoken, lambda m: coalesce(m.content, '')), ' ') as "full", array_to_string(list_transform(list_filter(spoken, lambda m: m.role = 'assistant'), lambda m: coalesce(m.content, '')), ' ') as said from s),
r as (select source, {reason_sql(True)} as flag, replies from f),
w as (select source, flag, round(case when len(replies) > 0 then 0.35 + 0.65 * len(list_filter(replies, lambda z: z.n between 1 and 25))::double / len(replies) else 1.0 end * case when flag is not null then 0.1 else 1.0 end, 4) as weight from r)
select source, flag, count(*) as n, round(sum(weight), 3)::double as weight from w group by all
"""


def corpus_means(spark, d):
    """Mean turns of a talk and mean words of a reply per source, and the share of replies of 3 to 25 words."""
    p = cleaning.with_parts(table(spark, d, "example_conversations"))
    replies = F.expr("filter(sizes, s -> s.role = 'assistant')")
    per = p.select("source", F.size("spoken").alias("t"), F.size(replies).alias("r"), F.aggregate(replies, F.lit(0), lambda s, x: s + x["n"]).alias("w"), F.size(F.filter(replies, lambda x: x["n"].between(3, 25))).alias("b"))
    return rounded(per.groupBy("source").agg(F.avg("t").alias("mean_turns"), ratio(F.sum("w"), F.sum("r")).alias("mean_words"), ratio(F.sum("b"), F.sum("r")).alias("in_3_25")))


CORPUS_MEANS = f"""{SIZES}, f as (select source, len(spoken) as t, list_filter(sizes, lambda z: z.role = 'assistant') as r from s),
g as (select source, t, len(r) as r, coalesce(list_sum(list_transform(r, lambda z: z.n)), 0) as w, len(list_filter(r, lambda z: z.n between 3 and 25)) as b from f)
select source, round(avg(t), 6) as mean_turns, round(sum(w)::double / sum(r), 6) as mean_words, round(sum(b)::double / sum(r), 6) as in_3_25 from g group by source"""

#: The reply policy of each skill; skills without one drop out.
SKILL_POLICIES = {"casual": "TOPIC_STATEMENT", "emotional": "VENTING", "epistemic": "UNKNOWN", "humor_sarcasm": "JOKE", "repair_ambiguity": "CONFUSION"}


def skill_policies(spark, d):
    """Specs by the policy that their skill maps to."""
    maps = spark.createDataFrame(sorted(SKILL_POLICIES.items()), "skill string, policy string")
    return table(spark, d, "latent_specs").join(F.broadcast(maps), "skill").groupBy("skill", "policy").agg(F.count(F.lit(1)).alias("n"))  # a fixed table


SKILL_POLICIES_SQL = f"select skill, case skill {' '.join(f'when {q(k)} then {q(v)}' for k, v in SKILL_POLICIES.items())} end as policy, count(*) as n from latent_specs where skill in ({listed(SKILL_POLICIES)}) group by skill"


def weakest(spark, d, most: int = 5):
    """The sources and topics whose talks are least clean: clean share minus broken share, the five smallest."""
    facts = ev.evaluate(conversation_turns(spark, d))
    per = facts.groupBy("id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.size("broken_reasons") > 0).alias("broken"))
    talks = table(spark, d, "example_conversations").select("id", F.explode(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("topic:"), F.col("meta")["topic"]))).alias("category")).where("category is not null")
    rated = per.join(talks, "id").groupBy("category").agg((ratio(F.count_if(F.col("broken") == 0), F.count(F.lit(1))) - ratio(F.sum("broken"), F.sum("turns"))).alias("score"))
    return rounded(rated.orderBy(F.round("score", 6), "category").limit(most))


def measure_composite(spark, d):
    """Per source: pass rate of a probe (no broken reply), share of distinct replies, mean words; and the composite of all."""
    f = ev.evaluate(conversation_turns(spark, d)).join(table(spark, d, "example_conversations").select("id", "source"), "id")
    texts = f.groupBy("source", F.coalesce("said", F.lit("")).alias("said")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("w")).alias("w"), F.count_if(F.size("broken_reasons") == 0).alias("ok"))
    per = texts.groupBy("source").agg(ratio(F.sum("ok"), F.sum("n")).alias("pass_rate"), ratio(F.count(F.lit(1)), F.sum("n")).alias("unique_rate"), ratio(F.sum("w"), F.sum("n")).alias("mean_words"))
    band = F.when(F.avg("mean_words").between(4.0, 14.0), 1.0).otherwise(0.6)
    return rounded(per.agg(F.avg("pass_rate").alias("pass_rate"), F.avg("unique_rate").alias("unique_rate"), F.avg("mean_words").alias("mean_words"), (0.6 * F.avg("pass_rate") + 0.3 * F.avg("unique_rate") + 0.1 * band).alias("composite")), 4)


def _facts_sql() -> str:
    from talkmill.queries.dialogue import FACTS as TURN_FACTS

    return TURN_FACTS


WEAKEST = f"""
with {_facts_sql()}, g1 as (select id, count(*) as turns, count(*) filter (len(broken_reasons) > 0) as b from f group by id),
tk as (select id, unnest(['source:' || source, 'topic:' || meta['topic']]) as category from example_conversations), j as (select * from g1 join tk using (id) where category is not null)
select category, round(count(*) filter (b = 0)::double / count(*) - sum(b)::double / sum(turns), 6) as score from j group by category order by 2, 1 limit 5
"""
MEASURE = f"""
with {_facts_sql()}, j as (select f.*, c.source as src from f join example_conversations c using (id)),
s as (select src, count(*) filter (len(broken_reasons) = 0)::double / count(*) as p, count(distinct coalesce(said, ''))::double / count(*) as u, sum(len(w))::double / count(*) as m from j group by src)
select round(avg(p), 4) as pass_rate, round(avg(u), 4) as unique_rate, round(avg(m), 4) as mean_words, round(0.6 * avg(p) + 0.3 * avg(u) + 0.1 * case when avg(m) between 4 and 14 then 1.0 else 0.6 end, 4)::double as composite from s
"""

QUERIES = {
    "frame_examples": (frame_examples, _frames_sql()), "state_pairs": (state_pairs, _pairs_sql()), "planned_specs": (planned_specs, _specs_sql()), "spliced_talks": (spliced_talks, SPLICED), "offline_talks": (offline_talks, _offline_sql()), "combined_talks": (combined_talks, _combined_sql()),
    "with_given_choice": (with_given_choice, WITH_GIVEN_CHOICE), "downweighted": (downweighted, DOWNWEIGHTED), "corpus_means": (corpus_means, CORPUS_MEANS), "skill_policies": (skill_policies, SKILL_POLICIES_SQL),
    "weakest": (weakest, WEAKEST), "measure_composite": (measure_composite, MEASURE),
}
