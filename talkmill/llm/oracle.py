"""SQL for the found-queries that SQL can express, written from the statement of each problem."""

from __future__ import annotations

# Fixed values, written from the problems' statements and not taken from the code that the SQL checks.
USER_NAMES = ("user", "human", "a", "speaker1", "me", "you")
ASSISTANT_NAMES = ("assistant", "ai", "bot", "b", "speaker2", "them")
LABEL = r"(?i)^\s*(user|assistant|human|ai|a|b|speaker\s*1|speaker\s*2|me|them|you|bot|system)\s*[:>-]\s*"
LISTS = ("known_facts", "unknown_facts", "state_mutations", "contradictions", "callbacks")
TRAIN = ("train", "training", "trn")
VALIDATION = ("validation", "valid", "val", "dev")
TEST = ("test", "testing", "tst", "heldout", "eval")
EVALUATION = VALIDATION + TEST
VIS = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
names = lambda xs: ", ".join(f"'{x}'" for x in xs)


def role(column: str) -> str:
    plain = f"lower(regexp_replace({column}, '[\\s\\p{{Z}}]+', '', 'g'))"
    return f"case when {plain} in ({names(USER_NAMES)}) then 'user' when {plain} in ({names(ASSISTANT_NAMES)}) then 'assistant' when {plain} = 'system' then 'system' end"


def facts(rows: str, ident: str) -> str:
    spoken = "coalesce(role <> 'system', true)"
    return f"""select {ident} as conv_id, bool_or(visible and {spoken}) as any_text, arg_min(coalesce(role, '?'), k) filter ({spoken}) as first_role,
  bool_or(coalesce(role = 'assistant', false) and not visible) as blank, bool_or(coalesce(role = 'assistant', false)) as reply, arg_max(coalesce(role, '?'), k) filter (visible) as last_role,
  bool_or(role is null) as bad from {rows} group by {ident}"""


P1_FOUND = f"""
with m as (select conv_id, turn, msg_id, sent_at, ingested_at, {role("role")} as role, coalesce(regexp_matches(content, '{VIS}'), false) as visible from message_rows where conv_id is not null),
d as (select * from m qualify row_number() over (partition by conv_id, turn, case when turn is null then sent_at end, case when turn is null and sent_at is null then msg_id end order by ingested_at desc nulls last, msg_id desc) = 1),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, sent_at nulls first, msg_id) as k from d),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 > count(turn), false) or (count(turn) > 0 and count(turn) < count(*)) as gap from d group by conv_id),
f as (select f.*, gap, null::boolean as raw from ({facts("o", "conv_id")}) f join g using (conv_id)),
x as (select id, regexp_split_to_array(coalesce(conversation, ''), '{LINE_END}') as lines from example_transcript_format where id is not null),
l as (select id, unnest(lines) as line, unnest(range(0, len(lines))) as pos from x),
r as (select id, pos, case when regexp_matches(line, '{LABEL}') then {role(f"regexp_extract(line, '{LABEL}', 1)")} end as label, regexp_matches(regexp_replace(line, '{LABEL}', ''), '{VIS}') as visible from l),
n as (select *, sum((label is not null)::int) over (partition by id order by pos) as k from r),
t as (select id, k, max(label) as role, bool_or(visible) as visible from n where k > 0 group by id, k),
w as (select id, max(k) as labels, bool_or(visible) as raw from n group by id),
y as (select w.id as conv_id, case when labels = 0 then raw else coalesce(any_text, false) end as any_text, first_role, coalesce(blank, false) as blank, coalesce(reply, false) as reply, last_role, labels = 0 as bad, false as gap from w left join ({facts("t", "id")}) q on q.conv_id = w.id),
z as (select conv_id, any_text, first_role, blank, reply, last_role, bad, gap from f union all select conv_id, any_text, first_role, blank, reply, last_role, bad, gap from y),
v as (select conv_id, case when not any_text then 'empty' when gap or bad or coalesce(first_role = 'assistant', false) then 'broken' when blank or not reply or coalesce(last_role = 'user', false) then 'no_reply' end as reason from z)
select conv_id, reason from v where reason is not null
"""

P3_FOUND = f"""
with s as (select id, lower(regexp_replace(split, '[^\\p{{L}}]', '', 'g')) as part, list_distinct(regexp_extract_all(lower(concat_ws(' ', {", ".join(f"array_to_string({c}, ' ')" for c in LISTS)})), '[a-z0-9]+')) as w from latent_specs where id is not null),
t as (select id, w from s where part in ({names(TRAIN)}) and len(w) > 0), e as (select id, w from s where part in ({names(EVALUATION)}) and len(w) > 0),
p as (select distinct least(e.id, t.id) as left_key, greatest(e.id, t.id) as right_key from e join t on e.id <> t.id and 4 * len(t.w) >= 3 * len(e.w) and 4 * len(e.w) >= 3 * len(t.w)
  and 4 * len(list_intersect(e.w, t.w)) >= 3 * (len(e.w) + len(t.w) - len(list_intersect(e.w, t.w)))),
i as (select name || '#train#' || lpad(k::varchar, 2, '0') as id, 't' as side, x from (select name, unnest(train) as x, unnest(range(0, len(train))) as k from intents)
  union all select name || '#held_out#' || lpad(k::varchar, 2, '0'), 'e', x from (select name, unnest(held_out) as x, unnest(range(0, len(held_out))) as k from intents)),
j as (select id, side, regexp_extract_all(regexp_replace(regexp_replace(lower(x), '[-‐‑]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s\\p{{Z}}]', '', 'g'), '[^\\s\\p{{Z}}]+') as w from i where x is not null),
q as (select distinct least(a.id, b.id) as left_key, greatest(a.id, b.id) as right_key from j a join j b on a.side = 't' and b.side = 'e' and len(a.w) > 0 and len(b.w) > 0 and abs(len(a.w) - len(b.w)) <= 1 and (
  a.w = b.w or (len(a.w) = len(b.w) and len(list_filter(range(1, len(a.w) + 1), lambda k: a.w[k] <> b.w[k])) = 1)
  or (len(a.w) = len(b.w) + 1 and coalesce(list_bool_or(list_transform(range(1, len(a.w) + 1), lambda k: list_concat(a.w[1:k - 1], a.w[k + 1:]) = b.w)), false))
  or (len(b.w) = len(a.w) + 1 and coalesce(list_bool_or(list_transform(range(1, len(b.w) + 1), lambda k: list_concat(b.w[1:k - 1], b.w[k + 1:]) = a.w)), false))))
select 'latent_specs' as tbl, left_key, right_key from p union all select 'intents', left_key, right_key from q
"""

CANON = "lower(upper(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')))"
P5_FOUND = f"""
with c as (select 'example_conversations' as tbl, id as ident, len(coalesce(messages, []))::varchar || chr(2) || coalesce(array_to_string(list_transform(messages, lambda m: coalesce({CANON.format("m.role")}, '') || chr(1) || coalesce({CANON.format("m.content")}, '')), chr(2)), '') as key from example_conversations where id is not null),
u as (select id, unnest(candidates) as c, unnest(range(0, len(candidates))) as pos from example_teacher_candidates where id is not null),
t as (select 'example_teacher_candidates' as tbl, id || '#' || pos as ident, id || chr(1) || {CANON.format("c.content")} as key from u where {CANON.format("c.content")} <> ''),
j as (select rec_id, line::json as o from candidate_lines where rec_id is not null and json_valid(line) and json_type(line) = 'OBJECT'),
l as (select 'candidate_lines' as tbl, rec_id as ident, concat_ws(chr(3), coalesce({CANON.format("o ->> '$.content'")}, chr(4)), coalesce({CANON.format("o ->> '$.source'")}, chr(4)), coalesce(try_cast(o ->> '$.score' as double)::varchar, o ->> '$.score', chr(4)),
  coalesce(array_to_string(list_sort(list_filter(list_transform(json_keys(o -> '$.scores'), lambda k: k || chr(1) || try_cast(json_extract_string(o -> '$.scores', '$."' || k || '"') as double)::varchar), lambda x: x is not null)), chr(2)), chr(4))) as key from j),
a as (select * from c union all select * from t union all select * from l), f as (select tbl, ident, min(ident) over (partition by tbl, key) as first_key from a)
select tbl, first_key, ident as copy_key from f where ident <> first_key
"""

# Problem 4: the letters whose compatibility form differs in these tables are the full-width ones, the quarter and the trade mark.
WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
HIDDEN = r"['`´‘’‚‛ʹʻʼʽˈˊˋ′‵\x{FF07}\x{AD}\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}]"


def word_list(text: str) -> str:
    clean = f"regexp_replace({text}, '{HIDDEN.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"regexp_extract_all(lower(translate(replace(replace({clean}, '¼', '1⁄4'), '™', 'TM'), '{WIDE}', '{PLAIN}')), '[\\p{{L}}\\p{{N}}]+')"


EIGHT = "unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))"
P4_FOUND = f"""
with i as (select item_id, unnest([known, "unknown"]) as t from elaboration_frozen where item_id is not null), iw as (select item_id, {word_list("t")} as w from i where t is not null),
ig as (select distinct item_id, {EIGHT} as g from iw where len(w) >= 8),
r as (select 'documents' as tbl, doc_id::varchar as rec_id, text as t from documents where doc_id is not null and text is not null
  union all select 'example_conversations', id, unnest(list_transform(messages, lambda m: m.content)) from example_conversations where id is not null and messages is not null),
rw as (select tbl, rec_id, {word_list("t")} as w from r where t is not null), rg as (select tbl, rec_id, {EIGHT} as g from rw where len(w) >= 8)
select distinct tbl, rec_id, item_id from rg join ig using (g)
"""

_HEAD = P1_FOUND[: P1_FOUND.rindex("select conv_id, reason")]
P1_TALKS = _HEAD.replace("select conv_id, turn, msg_id, sent_at, ingested_at,", "select conv_id, turn, msg_id, sent_at, ingested_at, content,").rstrip() + f""",
good as (select conv_id from v where reason is null),
a1 as (select conv_id, case when turn is not null then turn - min(turn) over (partition by conv_id) else row_number() over (partition by conv_id order by sent_at nulls first, msg_id) - 1 end as pos, role, content from o),
tl as (select id, k, pos, max(label) over (partition by id, k) as role, trim(regexp_replace(line, '{LABEL}', ''), ' ') as part from (select n.*, l.line from n join l using (id, pos)) where k > 0),
a2 as (select id as conv_id, k - 1 as pos, role, trim(string_agg(part, ' ' order by pos), ' ') as content from tl group by id, k, role)
select conv_id, pos::bigint as pos, role, content from a1 where conv_id in (select conv_id from good) union all select conv_id, pos::bigint, role, content from a2 where conv_id in (select conv_id from good)
"""

P1_SESSIONS = f"""
with m as (select msg_id, conv_id, user_id, turn, sent_at, ingested_at, {role("role")} as role, coalesce(regexp_matches(content, '{VIS}'), false) as visible from message_rows),
d as (select * from m where conv_id is not null qualify row_number() over (partition by conv_id, turn, case when turn is null then sent_at end, case when turn is null and sent_at is null then msg_id end order by ingested_at desc nulls last, msg_id desc) = 1),
x as (select * from d union all select * from m where conv_id is null),
g as (select floor(epoch_us(sent_at) / 1e6 - lag(epoch_us(sent_at)) over (partition by conv_id order by sent_at) / 1e6) as gap, (epoch_us(sent_at) - lag(epoch_us(sent_at)) over (partition by conv_id order by sent_at)) // 1000000 as s from x where conv_id is not null and sent_at is not null),
h as (select s, count(*) as n from g where s is not null group by s), c as (select s, sum(n) over (order by s) as upto, sum(n) over () as total from h), lim as (select min(s) as limit_s from c where upto >= ceil(total * 0.999)),
u as (select *, coalesce((epoch_us(sent_at) - lag(epoch_us(sent_at)) over w > (select limit_s from lim) * 1000000)::int, 0) as fresh from x where user_id is not null and sent_at is not null window w as (partition by user_id order by sent_at, msg_id)),
z as (select *, sum(fresh) over (partition by user_id order by sent_at, msg_id) as session_no, case when visible then role end as said from u)
select user_id, session_no::bigint as session_no, min(sent_at) as first_at, max(sent_at) as last_at, count(*) as n_messages,
  coalesce(bool_or(said = 'user'), false) and coalesce(bool_or(said = 'assistant'), false) and coalesce(arg_max(said, {{'a': sent_at, 'b': msg_id}}) filter (said is not null) = 'assistant', false) as reciprocal from z group by user_id, session_no
"""

_P3 = P3_FOUND[: P3_FOUND.rindex("select 'latent_specs'")].rstrip()
P3_OVERLAPS = _P3 + f""",
sp as (select distinct id, case when lower(regexp_replace(split, '[^\\p{{L}}]', '', 'g')) in ({names(VALIDATION)}) then 'validation' else 'test' end as split, source from latent_specs where lower(regexp_replace(split, '[^\\p{{L}}]', '', 'g')) in ({names(EVALUATION)})),
r1 as (select 'latent_specs' as tbl, e.id as eval_id, case when e.id = left_key then right_key else left_key end as train_id from p join e on e.id in (left_key, right_key)),
r2 as (select distinct 'latent_specs' as tbl, eval_id, train_id, split, source from r1 join sp on sp.id = eval_id where train_id in (select id from t)),
r3 as (select 'intents' as tbl, case when contains(left_key, '#held_out#') then left_key else right_key end as eval_id, case when contains(left_key, '#held_out#') then right_key else left_key end as train_id, 'held_out' as split from q),
r4 as (select * from r2 union all select tbl, eval_id, train_id, split, split_part(eval_id, '#', 1) from r3)
select tbl, split, source, count(distinct (eval_id, train_id)) as n_pairs, count(distinct eval_id) as n_records from r4 group by tbl, split, source
"""

_P5 = P5_FOUND[: P5_FOUND.rindex(", f as (select tbl, ident, min(ident)")]
P5_COLLAPSED = _P5 + """
select tbl, min(ident) as rec_key, count(*) as n_copies from a group by tbl, key
"""

SQL = {
    "p1_found": P1_FOUND, "p1_talks": P1_TALKS, "p1_sessions": P1_SESSIONS, "p3_found": P3_FOUND, "p3_overlaps": P3_OVERLAPS, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_collapsed": P5_COLLAPSED,
}
