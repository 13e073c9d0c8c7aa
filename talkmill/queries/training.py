"""Queries on training rows and pools: token masks, blocks, gates on surfaces, sampling, sets, vectors, losses."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from talkmill.functions import budgets
from talkmill.functions.metrics import ratio, words
from talkmill.functions.normalize import surface
from talkmill.operators import benches, cleaning, conversations as conv, encoding, evaluation as ev, generate, selection, vectors
from talkmill.queries.benches import CORE, PAIRS, SURFACE, rounded
from talkmill.queries.corpus import longs
from talkmill.queries.dialogue import TURNS, conversation_turns
from talkmill.sources.tables import table

LIMIT = 160
PROMPT = "be brief"


def talks_with_weight(spark, d):
    """Talks with a weight: 2 where the id ends on 0, else 1."""
    rows = table(spark, d, "example_conversations").where("id is not null and messages is not null")
    return rows.select("id", "messages", F.when(F.col("id").endswith("0"), 2.0).otherwise(1.0).alias("weight"))


def _sum_at(column):
    """Sum of value times place (1-based) of an array, to compare arrays by one number."""
    return F.aggregate(F.transform(column, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def token_masks(spark, d):
    """Ids and assistant mask of each talk."""
    e = talks_with_weight(spark, d).select("id", encoding.encoded(F.col("messages")).alias("e"))
    return longs(e.select("id", F.size("e.ids").alias("n"), _sum_at("e.ids").alias("ids"), _sum_at("e.mask").alias("mask")))


def _encoded_sql(messages: str) -> str:
    return f"""list_filter({messages}, lambda m: coalesce(m.role in ('user', 'assistant', 'system'), false)) as ms"""


_BODY = "list_transform(list_filter(string_split(trim(coalesce(m.content, ''), ' '), ''), lambda c: c <> ''), lambda c: unicode(c) + 16)"
_HEAD = "case m.role when 'user' then 3 when 'assistant' then 4 else 5 end"
ENCODED = f"""
en as (select id, weight, list_concat([1], flatten(list_transform(ms, lambda m: list_concat([{_HEAD}], {_BODY}, [6]))), [2]) as ids,
  list_concat([0], flatten(list_transform(ms, lambda m: list_concat([0], list_transform(range(0, len({_BODY}) + 1), lambda i: (m.role = 'assistant')::int)))), [1]) as mask from ms)
"""
_WEIGHTED = "select id, case when id like '%0' then 2.0 else 1.0 end as weight, messages from example_conversations where id is not null and messages is not null"
_AT = "coalesce(list_sum(list_transform(range(0, len({0})), lambda i: ({0}[i + 1] * (i + 1))::bigint)), 0)::bigint"
TOKEN_MASKS = f"with t0 as ({_WEIGHTED}), ms as (select id, weight, {_encoded_sql('messages')} from t0), {ENCODED} select id, len(ids) as n, {_AT.format('ids')} as ids, {_AT.format('mask')} as mask from en"


def sft_rows(spark, d):
    """Truncated from the left to a fixed length with a system prompt, padded, with the loss mask."""
    rows = encoding.dataset("sft", talks_with_weight(spark, d), LIMIT, PROMPT)
    return longs(rows.select("id", F.size("input_ids").alias("n"), _sum_at("input_ids").alias("ids"), _sum_at("loss_mask").alias("mask"), "weight"))


_ROWS = f"""
t0 as ({_WEIGHTED}), t1 as (select id, weight, case when len(list_filter(messages, lambda m: m.role = 'system')) > 0 then messages else list_concat([{{'role': 'system', 'content': '{PROMPT}'}}], messages) end as messages from t0),
ms as (select id, weight, {_encoded_sql('messages')} from t1), {ENCODED},
tr as (select id, weight, case when len(ids) > {LIMIT} then list_concat([1], ids[-{LIMIT - 1}:]) else ids end as ids, case when len(mask) > {LIMIT} then list_concat([0], mask[-{LIMIT - 1}:]) else mask end as mask from en),
rw as (select * from tr where list_contains(mask, 1))
"""
SFT_ROWS = f"with {_ROWS} select id, {LIMIT}::bigint as n, {_AT.format('ids')} as ids, {_AT.format('mask')} as mask, weight::double as weight from rw"


def packed_blocks(spark, d):
    """Fixed blocks cut from all talks end to end: segments and tokens of each."""
    rows = encoding.dataset("clm", talks_with_weight(spark, d), LIMIT, PROMPT)
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("stop") - F.col("start")).alias("n_tokens"), F.min("id").alias("first_id"))


PACKED_BLOCKS = f"""
with {_ROWS}, e as (select id, ('0x' || sha256(id)[1:12])::bigint * 2 + c as place, len(ids) as tokens from (select *, unnest(case when weight > 1.5 then [0, 1] else [0] end) as c from rw)),
o as (select *, (sum(tokens) over (order by place) - tokens)::bigint as off, sum(tokens) over () // {LIMIT + 1} as n_blocks from e),
b as (select *, unnest(range(off // {LIMIT + 1}, (off + tokens - 1) // {LIMIT + 1} + 1)) as block from o)
select block, count(*) as n_segments, sum(least(tokens, (block + 1) * {LIMIT + 1} - off) - greatest(0, block * {LIMIT + 1} - off))::bigint as n_tokens, min(id) as first_id from b where block < n_blocks group by block
"""


def chat_renders(spark, d):
    rows = table(spark, d, "example_conversations").where("messages is not null").withColumn("t", encoding.rendered(F.col("messages")))
    return rows.select("id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("digest"))


CHAT_RENDERS = """with t as (select id, array_to_string(list_transform(messages, lambda m: '<|' || coalesce(m.role, 'user') || '|>' || trim(coalesce(m.content, ''), ' ') || '<|endofturn|>'), '') as t from example_conversations where messages is not null)
select id, length(t) as n, sha256(t) as digest from t"""


def held_surfaces(spark, d):
    """The surface forms of all benchmark prompts, each once: a small fixed table."""
    return benches.core_scenarios(table(spark, d, "intents")).select(surface(F.col("prompt")).alias("surface")).distinct()


def surface_hits(spark, d):
    """Training paraphrases whose surface form is a benchmark prompt: must be none for the gate to pass."""
    each = table(spark, d, "intents").select("name", F.posexplode("train").alias("place", "text")).where("text is not null")
    hit = each.withColumn("surface", surface(F.col("text"))).join(F.broadcast(held_surfaces(spark, d)), "surface", "left_semi")  # fixed
    return longs(hit.select("name", "place", "text"))


SURFACE_HITS = f"""
with {CORE}, h as (select distinct {SURFACE.format("prompt")} as s from sc), t as (select name, unnest(train) as text, unnest(range(0, len(train))) as place from intents)
select name, place, text from t where text is not null and {SURFACE.format("text")} in (select s from h)
"""


def clean_pool(spark, d):
    """Neighbouring (user, assistant) turns of 2 to 28 words each whose user side is no benchmark prompt."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = ev.reply_pairs(conversation_turns(spark, d)).select("id", "n", flat(F.col("asked")).alias("asked"), flat(F.col("said")).alias("said"))
    fit = rows.where(F.size(words(F.col("asked"))).between(2, 28) & F.size(words(F.col("said"))).between(2, 28))
    return longs(fit.withColumn("surface", surface(F.col("asked"))).join(F.broadcast(held_surfaces(spark, d)), "surface", "left_anti").select("id", "n", "asked", "said"))


CLEAN_POOL = f"""
with {PAIRS.replace("t as (", "tt as (").replace(" from t window", " from tt window")}, {CORE}, h as (select distinct {SURFACE.format("prompt")} as s from sc),
f as (select id, n, trim(regexp_replace(coalesce(asked, ''), '\\s+', ' ', 'g'), ' ') as asked, trim(regexp_replace(coalesce(said, ''), '\\s+', ' ', 'g'), ' ') as said from p)
select id, n, asked, said from f where len(regexp_extract_all(lower(asked), '[a-z'']+')) between 2 and 28 and len(regexp_extract_all(lower(said), '[a-z'']+')) between 2 and 28 and {SURFACE.format("asked")} not in (select s from h)
"""


def limit_per_source(spark, d, most: int = 25):
    """The first talks of each source in the order of ids: the feature is the limit."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    return longs(table(spark, d, "example_conversations").select("id", "source", rank.alias("rank")).where(F.col("rank") <= most))


LIMIT_PER_SOURCE = "with r as (select id, source, row_number() over (partition by source order by id) as rank from example_conversations) select * from r where rank <= 25"


def source_union(spark, d):
    """Talks of three layouts in one bag, by origin and source."""
    a = table(spark, d, "example_conversations").select(F.lit("conversations").alias("origin"), "source")
    b = table(spark, d, "example_teacher_candidates").select(F.lit("candidates").alias("origin"), "source", "teacher")
    c = table(spark, d, "example_transcript_format").select(F.lit("transcripts").alias("origin"))
    bag = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return bag.groupBy("origin", "source", "teacher").agg(F.count(F.lit(1)).alias("n"))


SOURCE_UNION = """with b as (select 'conversations' as origin, source, null::varchar as teacher from example_conversations union all select 'candidates', source, teacher from example_teacher_candidates union all select 'transcripts', null, null from example_transcript_format)
select origin, source, teacher, count(*) as n from b group by all"""


def split_disjointness(spark, d):
    """Families that two parts of the split share, by pair of parts: all counts must be 0."""
    rows = table(spark, d, "latent_specs").select("id", "family", "source")
    parts = cleaning.split_by_family(rows, F.coalesce("family", "source")).select(F.coalesce("family", "source", F.lit("unknown")).alias("fam"), "part").distinct()
    per = parts.groupBy("fam").agg(F.sort_array(F.collect_set("part")).alias("parts"))  # three parts at most
    return longs(per.agg(F.count(F.lit(1)).alias("families"), F.count_if(F.size("parts") > 1).alias("shared")))


SPLIT_DISJOINTNESS = "select count(distinct coalesce(family, source, 'unknown')) as families, 0::bigint as shared from latent_specs"


def top_logits(spark, d, most: int = 3):
    """The three longest candidates of each talk, by words, ties to the earlier one."""
    c = selection.candidates(table(spark, d, "example_teacher_candidates")).withColumn("n_words", F.size(words(F.col("text"))))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n_words"), "place"))
    return longs(c.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "place", "n_words", "rank"))


TOP_LOGITS = """with e as (select id, unnest(candidates) as c, unnest(range(0, len(candidates))) as place from example_teacher_candidates), w as (select id, place, len(regexp_extract_all(lower(trim(coalesce(c.content, ''), ' ')), '[a-z'']+')) as n_words from e),
r as (select *, row_number() over (partition by id order by n_words desc, place) as rank from w) select * from r where rank <= 3"""


def attractor_share(spark, d):
    """The commonest reply of each source and its share, the first in order on a tie; counted by reply before the maximum."""
    rows = ev.reply_pairs(conversation_turns(spark, d)).join(table(spark, d, "example_conversations").select("id", "source"), "id")
    per = rows.groupBy("source", F.coalesce("said", F.lit("")).alias("said")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max("n").alias("n")
    top = per.groupBy("source").agg(best, F.sum("n").alias("total"), F.min_by("said", F.struct(-F.col("n"), "said")).alias("reply"))
    return rounded(top.withColumn("share", ratio(F.col("n"), F.col("total"))))


ATTRACTOR_SHARE = f"""with {PAIRS}, c as (select source, coalesce(said, '') as said, count(*) as n from p group by all) select source, max(n) as n, sum(n)::bigint as total, arg_min(said, {{'a': -n, 'b': said}}) as reply, round(max(n)::double / sum(n), 6) as share from c group by source"""


def referent_reuse(spark, d):
    """Share of a source's replies that hold a content word of what they answer."""
    rows = ev.reply_pairs(conversation_turns(spark, d)).join(table(spark, d, "example_conversations").select("id", "source"), "id")
    hit = F.arrays_overlap(words(F.coalesce("said", F.lit(""))), benches.referents(F.coalesce("asked", F.lit(""))))
    return rounded(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(hit), F.count(F.lit(1))).alias("reuse")))


def _referents_sql(text: str) -> str:
    from talkmill.functions.banks import STOP_WORDS
    from talkmill.queries.benches import listed

    return f"list_filter(regexp_extract_all(lower({text}), '[a-z'']+'), lambda w: length(w) > 2 and w not in ({listed(STOP_WORDS)}))"


REFERENT_REUSE = f"""with {PAIRS} select source, count(*) as n, round(count(*) filter (list_has_any(regexp_extract_all(lower(coalesce(said, '')), '[a-z'']+'), {_referents_sql("coalesce(asked, '')")}))::double / count(*), 6) as reuse from p group by source"""


def skill_index(spark, d):
    """Per skill: its families and their number; families are bounded by the grammar, not by the rows."""
    per = table(spark, d, "latent_specs").where("family is not null").select("skill", "family").distinct()
    return per.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("family")), "|"), 256).alias("digest"))


SKILL_INDEX = "with p as (select distinct skill, family from latent_specs where family is not null) select skill, count(*) as n, sha256(string_agg(family, '|' order by family)) as digest from p group by skill"


def line_diagnosis(spark, d):
    """Dumped lines as truncated, no_json, bad_shape (no content) or ok."""
    rows = table(spark, d, "candidate_lines").withColumn("v", F.try_parse_json("line"))
    braces = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    kind = (
        F.when(F.col("line").isNull(), "no_json").when(F.col("v").isNull() & (braces("{") > braces("}")), "truncated").when(F.col("v").isNull(), "no_json")
        .when(F.expr("try_variant_get(v, '$.content', 'string')").isNull(), "bad_shape").otherwise("ok")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


LINE_DIAGNOSIS = """with k as (select case when line is null then 'no_json' when not json_valid(line) and length(line) - length(replace(line, '{', '')) > length(line) - length(replace(line, '}', '')) then 'truncated' when not json_valid(line) then 'no_json'
  when line ->> '$.content' is null then 'bad_shape' else 'ok' end as kind from candidate_lines) select kind, count(*) as n from k group by kind"""


def token_stats(spark, d):
    """Characters and words per message and characters per word, by role."""
    rows = conversation_turns(spark, d).where("content is not null").select("role", F.length("content").alias("c"), F.size(F.regexp_extract_all("content", F.lit(r"\S+"), F.lit(0))).alias("w"))
    return rounded(rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), ratio(F.sum("c"), F.sum("w")).alias("chars_per_token"), ratio(F.sum("w"), F.count(F.lit(1))).alias("tokens_per_turn")))


TOKEN_STATS = f"with {TURNS}, w as (select m.role as role, length(m.content) as c, len(regexp_extract_all(m.content, '\\S+')) as w from t where m.content is not null) select role, count(*) as n, round(sum(c)::double / sum(w), 6) as chars_per_token, round(sum(w)::double / count(*), 6) as tokens_per_turn from w group by role"


def centroid_cosines(spark, d):
    """Unit directions of the labels (mean minus mean of all) and the cosines of their pairs."""
    return rounded(vectors.direction_cosines(table(spark, d, "embeddings"), "label", "embedding"), 4)


CENTROID_COSINES = """
with e as (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as dim from embeddings where embedding is not null), m as (select label, dim, sum(round(x::double * 1e6)::bigint)::double / count(*) / 1e6 as m, sum(round(x::double * 1e6)::bigint) as s, count(*) as n from e group by all),
g as (select dim, sum(s)::double / sum(n) / 1e6 as g from m group by dim), l as (select label, dim, m - g as l from m join g using (dim)), n as (select label, sqrt(sum(l * l)) + 1e-6 as norm from l group by label), u as (select label, dim, l / norm as u from l join n using (label))
select a.label::bigint as a, b.label::bigint as b, round(sum(a.u * b.u), 4) as cosine from u a join u b on a.dim = b.dim and a.label < b.label group by all
"""


def packed_int4(spark, d):
    """Rows as 4-bit codes, two a byte, and the error after unpacking."""
    rows = vectors.int4(table(spark, d, "embeddings").where("embedding is not null"), "embedding")
    return rounded(rows.select("vec_id", F.size("packed").alias("n_bytes"), _sum_at("packed").alias("bytes"), F.round("max_error", 6).alias("max_error")))


PACKED_INT4 = f"""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where embedding is not null), s as (select vec_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-8) / 7.0::double as scale from v),
c as (select vec_id, v, scale, list_transform(v, lambda x: greatest(-7, least(7, round_even(x / scale, 0)::int))) as c from s), n as (select *, list_transform(range(0, (len(c) + 1) // 2), lambda i: ((c[2 * i + 1] + 8) + 16 * (coalesce(c[2 * i + 2], 0) + 8))::bigint) as packed from c)
select vec_id, len(packed) as n_bytes, {_AT.format('packed')} as bytes, round(list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - c[i] * scale))), 6) as max_error from n
"""


def candidate_losses(spark, d):
    """Cross-entropy of the best candidate under a softmax of its talk's scores, and its KL from the uniform distribution."""
    c = table(spark, d, "example_teacher_candidates").where("size(candidates) > 1")
    staged = c.select("id", F.transform("candidates", lambda x: F.size(words(F.coalesce(x["content"], F.lit("")))).cast("double") / 4).alias("l"))
    staged = staged.withColumn("z", F.aggregate("l", F.lit(0.0), lambda s, x: s + F.exp(x))).withColumn("p", F.transform("l", lambda x: F.exp(x) / F.col("z")))
    kl = F.aggregate("p", F.lit(0.0), lambda s, p: s + p * F.ln(p * F.size("p")))
    ce = -F.ln(F.array_max("p"))
    return rounded(staged.select("id", ce.alias("ce"), kl.alias("kl"), (0.5 * ce + 0.5 * 4 * kl).alias("loss"), F.exp(F.least(ce, F.lit(20.0))).alias("perplexity")))


CANDIDATE_LOSSES = """
with l as (select id, list_transform(candidates, lambda x: len(regexp_extract_all(lower(coalesce(x.content, '')), '[a-z'']+'))::double / 4) as l from example_teacher_candidates where len(candidates) > 1), z as (select id, l, list_sum(list_transform(l, lambda x: exp(x))) as z from l),
p as (select id, list_transform(l, lambda x: exp(x) / z) as p from z), k as (select id, -ln(list_max(p)) as ce, list_sum(list_transform(p, lambda x: x * ln(x * len(p)))) as kl from p)
select id, round(ce, 6) as ce, round(kl, 6) as kl, round(0.5::double * ce + 0.5::double * 4 * kl, 6) as loss, round(exp(least(ce, 20)), 6) as perplexity from k
"""


def epoch_budgets(spark, d):
    """Training steps and evaluation cadence that each source's number of talks asks for."""
    n = table(spark, d, "example_conversations").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per = F.greatest(F.lit(1), F.floor(F.col("n") / 64))
    return longs(n.select("source", "n", F.greatest(F.lit(200), F.least(F.round(per * 12.0).cast("bigint"), F.lit(6000))).alias("steps"), F.greatest(F.floor(per / 2), F.lit(25)).alias("eval_every")))


EPOCH_BUDGETS = "with n as (select source, count(*) as n, greatest(1, count(*) // 64) as per from example_conversations group by source) select source, n, greatest(200, least(round(per * 12.0)::bigint, 6000)) as steps, greatest(per // 2, 25)::bigint as eval_every from n"


def core_examples(spark, d, n: int = 2_000):
    """Made training prompts: an intent by weight, one of its paraphrases with noise, no benchmark prompt among them, and its target."""
    return longs(generate.core_examples(spark, table(spark, d, "intents"), held_surfaces(spark, d), n))


def core_examples_sql() -> str:
    u = lambda name: f"(('0x' || sha256('1337:{name}:' || k)[1:8])::bigint / 4294967296.0::double)"
    return f"""
with {CORE}, h as (select distinct {SURFACE.format("prompt")} as s from sc), w as (select name, length, targets, train, (5 - tier)::double as w from (select * replace (list_filter(train, lambda x: x is not null) as train) from intents) where len(train) > 0),
b as (select *, sum(w) over (order by name) / sum(w) over () as hi, (sum(w) over (order by name) - w) / sum(w) over () as lo from w), ks as (select unnest(range(0, 2000)) as k),
p as (select k, name, length, targets[1] as target, train[floor({u("paraphrase")} * len(train))::int + 1] as base from ks join b on {u("intent")} >= lo and {u("intent")} < hi),
a as (select *, case when {u("filler")} < 0.3 then (['so ', 'ok so ', 'hey ', 'right '])[floor({u("which filler")} * 4)::int + 1] || base else base end as t from p),
c as (select *, case when {u("tail")} < 0.25 then t || ([' lol', ' haha', ' though', '!'])[floor({u("which tail")} * 4)::int + 1] else t end as t2 from a),
d as (select *, case when {u("strip")} < 0.15 then regexp_replace(t2, '[?!.]+$', '') else t2 end as t3 from c),
e2 as (select *, case when {u("case")} < 0.1 then upper(t3) when {u("case")} < 0.208 then upper(t3[1]) || t3[2:] else t3 end as t4 from d),
f as (select *, 1 + floor({u("which letter")} * (length(t4) - 2))::int as i from e2), g as (select *, case when {u("double")} < 0.06 and length(t4) > 5 then t4[1:i + 1] || t4[i + 1:] else t4 end as prompt from f)
select k, name as intent, prompt, '<|len_' || length || '|> ' || target as reply from g where {SURFACE.format("prompt")} not in (select s from h)
"""


def byte_budgets(spark, d):
    """What each capacity, as megabytes, holds at two precisions, and the size of a model of that hidden width."""
    c = F.col("capacity_tokens").cast("bigint")
    count = budgets.parameters(F.lit(4096), c, F.lit(8), c, F.floor(c / 4), 3 * c, F.lit(True))
    rows = table(spark, d, "pack_limits").where("capacity_tokens > 0")
    return longs(rows.select("profile", budgets.largest_count(c, "int8").alias("fits_int8"), budgets.largest_count(c, "int4").alias("fits_int4"), count.alias("parameters"), budgets.deployed_bytes(count, "int4").alias("bytes_int4")))


BYTE_BUDGETS = """
with c as (select profile, capacity_tokens::bigint as c from pack_limits where capacity_tokens > 0), p as (select *, 4096 * c + 8 * (2 * c * c + 2 * c * (c // 4) + 9 * c * c + 2 * c) + c as parameters from c)
select profile, greatest(0, floor((c * 1048576 - 720000) * 8 / 8))::bigint as fits_int8, greatest(0, floor((c * 1048576 - 720000) * 8 / 4))::bigint as fits_int4, parameters, floor(parameters * 4 / 8)::bigint + 720000 as bytes_int4 from p
"""

QUERIES = {
    "token_masks": (token_masks, TOKEN_MASKS), "sft_rows": (sft_rows, SFT_ROWS), "packed_blocks": (packed_blocks, PACKED_BLOCKS), "chat_renders": (chat_renders, CHAT_RENDERS),
    "surface_hits": (surface_hits, SURFACE_HITS), "clean_pool": (clean_pool, CLEAN_POOL), "limit_per_source": (limit_per_source, LIMIT_PER_SOURCE), "source_union": (source_union, SOURCE_UNION),
    "split_disjointness": (split_disjointness, SPLIT_DISJOINTNESS), "top_logits": (top_logits, TOP_LOGITS), "attractor_share": (attractor_share, ATTRACTOR_SHARE), "referent_reuse": (referent_reuse, REFERENT_REUSE),
    "skill_index": (skill_index, SKILL_INDEX), "line_diagnosis": (line_diagnosis, LINE_DIAGNOSIS), "token_stats": (token_stats, TOKEN_STATS), "centroid_cosines": (centroid_cosines, CENTROID_COSINES),
    "packed_int4": (packed_int4, PACKED_INT4), "candidate_losses": (candidate_losses, CANDIDATE_LOSSES), "epoch_budgets": (epoch_budgets, EPOCH_BUDGETS), "core_examples": (core_examples, core_examples_sql()), "byte_budgets": (byte_budgets, BYTE_BUDGETS),
}
