"""The pN operators against brute force on small fixtures: nulls, blanks, ties, repeats, empty tables, extra columns."""

import datetime as dt
import itertools
import json
import random
import re

import numpy as np
import pytest

from talkmill.llm import p1_talks, p2_defects, p3_splits, p4_leaks, p5_copies, p6_packing, p7_mixing, p8_quality
from talkmill.llm.crf import LinearChain, Sparse, groups
from talkmill.llm.flat import Flat, blocks, word_hashes

MSG = "array<struct<role:string,content:string>>"
CAND = "array<struct<content:string,scores:map<string,double>,score:double,source:string>>"
SCHEMAS = {
    "message_rows": "msg_id bigint, conv_id string, user_id string, turn int, role string, content string, source string, sent_at timestamp, ingested_at timestamp, key string",
    "example_transcript_format": "id string, conversation string, lines string",
    "example_conversations": f"id string, source string, messages {MSG}, meta map<string,string>, candidates {CAND}, chosen int, key string",
    "example_teacher_candidates": f"id string, source string, teacher string, messages {MSG}, candidates {CAND}, tbl string",
    "candidate_lines": "rec_id string, line string, source_file string, v string",
    "latent_specs": "id string, split string, source string, " + ", ".join(f"{c} array<string>" for c in p3_splits.LISTS) + ", skey string",
    "intents": "name string, train array<string>, held_out array<string>, side string",
    "elaboration_frozen": "item_id bigint, known string, unknown string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, row_no string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "pack_limits": "profile string, capacity_tokens int",
    "common_words": "lang string, word string, rank_no int",
}
COMMON = {"en": "the and you i a to of is was it that", "de": "und ich der die das ist nicht wir", "fr": "le la et je tu est pas que", "es": "el los y que con yo muy", "it": "il di che non per", "pt": "os um uma não com"}


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables (missing ones empty) and returns the folder."""

    def make(**tables):
        for name, schema in SCHEMAS.items():
            rows = tables.get(name, [(k, w, i) for k, v in COMMON.items() for i, w in enumerate(v.split())] if name == "common_words" else [])
            spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_empty_tables(spark, folder):
    d = folder()
    from talkmill.llm import queries

    for name, query in queries().items():
        assert query(spark, d).count() == 0, name


def test_p1(spark, folder):
    t0 = dt.datetime(2030, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    n = itertools.count(1)

    def row(conv, turn, role, content, sent=0, got=None):
        return (next(n), conv, None, turn, role, content, None, at(sent), at(sent if got is None else got), "x")

    rows = [
        row("ok", 1, "User ", "hi"), row("ok", 2, "BOT", "yo"),
        row("late", 0, "user", "q"), row("late", 1, "ai", "", got=5), row("late", 1, "ai", "a", got=9),
        row("gap", 0, "user", "q"), row("gap", 2, "bot", "a"),
        row("part", 0, "user", "q"), row("part", None, "bot", "a", 3),
        row("role", 0, "user", "q"), row("role", 1, None, "a"),
        row("start", 0, "system", "s"), row("start", 1, "Speaker 2", "a"), row("start", 2, "me", "b"), row("start", 3, "them", "c"),
        row("blank", 0, "user", "​﻿ "), row("blank", 1, "bot", None), row("blank", 2, "system", "text"),
        row("open", None, "user", "q", 1), row("open", None, "bot", "a", 2), row("open", None, "user", "r", 3),
        row("mute", 0, "user", "q"), row("mute", 1, "bot", " \xa0"), row("mute", 2, "bot", "a"),
        row("timed", None, "bot", "a", 9), row("timed", None, "user", "q", 1),
        row(None, 0, "bot", "lost"),
    ]
    texts = [("t1", "note\nUser: hi\nmore\r\nAI - yo", "x"), ("t2", "just text", "x"), ("t3", None, "x"), ("t4", " \n", "x"), ("t5", "Bot: hi\nMe: q", "x"),
             ("t6", "User: q\nBot:\nUser: r\nBot: s", "x"), ("t7", "User: q\nBot:\n later", "x"), ("t8", "pre\nUser:\nBot> ", "x"), ("t9", "A: q\nB: a\nA: r", "x")]
    d = folder(message_rows=rows, example_transcript_format=texts)
    got = {r.conv_id: r.reason for r in p1_talks.p1_found(spark, d).collect()}
    assert got == {"gap": "broken", "part": "broken", "role": "broken", "start": "broken", "blank": "empty", "open": "no_reply", "mute": "no_reply",
                   "t2": "broken", "t3": "empty", "t4": "empty", "t5": "broken", "t6": "no_reply", "t8": "empty", "t9": "no_reply"}
    talks = {}
    for r in p1_talks.p1_talks(spark, d).collect():
        talks.setdefault(r.conv_id, {})[r.pos] = (r.role, r.content)
    assert talks["late"] == {0: ("user", "q"), 1: ("assistant", "a")} and talks["timed"] == {0: ("user", "q"), 1: ("assistant", "a")}
    assert talks["t1"] == {0: ("user", "hi more"), 1: ("assistant", "yo")} and set(talks) == {"ok", "late", "timed", "t1", "t7"}


def test_p1_sessions(spark, folder):
    """Gaps across midnight move the limit, repeated deliveries are neither gaps nor messages; against a loop."""
    t0 = dt.datetime(2030, 1, 1, 23, 0)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = []
    for k in range(6):  # talks of one user, a pause over midnight in each, three days apart
        for turn, s in enumerate((0, 60, 120, 7200 + k, 7260 + k)):
            rows.append((len(rows), f"c{k}", "u", turn, "user" if turn % 2 == 0 else "bot", "hi", None, at(k * 259_200 + s), at(k * 259_200 + s), "x"))
        rows.append((len(rows), f"c{k}", "u", 4, "bot", "hi", None, at(k * 259_200 + 7260 + k), at(k * 259_200 + 9000), "x"))  # delivered again with another role
    rows += [(100 + i, None, "v", None, role, "hi", None, at(s), at(s), "x") for i, (role, s) in enumerate([("user", 0), ("bot", 9), ("user", 90_000)])]
    rows += [(200, "c9", None, 0, "user", "hi", None, at(0), at(0), "x"), (201, "c9", "w", None, "user", "hi", None, None, at(0), "x")]
    d = folder(message_rows=rows)
    latest = {}
    for r in rows:
        key = (r[1], r[3], r[7] if r[3] is None else None, r[0] if r[1] is None else None)
        if key not in latest or (r[8], r[0]) > (latest[key][8], latest[key][0]):
            latest[key] = r
    kept = [r for r in latest.values() if r[7]]
    talks = {}
    for r in kept:
        talks.setdefault(r[1], []).append(r[7])
    gaps = sorted(int((b - a).total_seconds()) for c, ts in talks.items() if c for ts in [sorted(ts)] for a, b in zip(ts, ts[1:]))
    for share in (0.5, 0.8, 0.999):
        limit = next(g for g in gaps if sum(x <= g for x in gaps) >= np.ceil(len(gaps) * share))
        want = []
        for user in ("u", "v"):
            session = []
            for r in sorted((r for r in kept if r[2] == user), key=lambda r: (r[7], r[0])) + [None]:
                if session and (r is None or (r[7] - session[-1][7]).total_seconds() > limit):
                    said = ["assistant" if x[4] == "bot" else "user" for x in session]
                    want.append((user, session[0][7], session[-1][7], len(session), set(said) == {"user", "assistant"} and said[-1] == "assistant"))
                    session = []
                session.append(r)
        got = p1_talks.p1_sessions(spark, d, share).select("user_id", "first_at", "last_at", "n_messages", "reciprocal").collect()
        assert sorted(map(tuple, got)) == sorted(want), share


def test_p2(spark, folder):
    clean = ["i'd bring the apricot jam, nobody says no to plum cake", "go on then, what did your aunt say?", "you said Anna had it at noon, so ask there", "sounds cosy. i'd walk past the market and clear my head"]
    ask = ["the lantern broke on Monday and my uncle just laughed", "is it odd that i keep soup next to the lamp at work?", "we had hail in the valley so the race got cancelled"]
    german = ["ich bin nicht sicher und wir warten auf den Regen", "das ist der Schlüssel und nicht die Lampe", "wir sind heute in der Stadt und das ist schön"]
    rows = []
    for k in range(120):
        rows.append((f"c{k}", None, [("user", ask[k % 3]), ("assistant", clean[k % 4])], None, None, None, "x"))
        rows.append((f"g{k}", None, [("user", german[k % 3]), ("assistant", german[(k + 1) % 3])], None, None, None, "x"))
    bad = {"b0": (None, "empty"), "b1": ("[no reply]", "empty"), "b2": (ask[0].upper() + "!", "copy"), "b3": ("sorry, i can't answer that question", "refusal"),
           "b4": (german[0], "other_language"), "b5": ("you said Anna had it at noon, so ask there because the", "truncated"), "b6": ("i'd bring the apricot jam, nobo", "truncated")}
    rows += [(k, None, [("user", ask[0]), ("assistant", a)], None, None, None, "x") for k, (a, _) in bad.items()]
    rows += [("null", None, None, None, None, None, "x"), ("only", None, [("assistant", clean[0])], None, None, None, "x"), ("one", None, [("user", None)], None, None, None, "x")]
    teach = [("t0", None, None, [("user", ask[1])], [(clean[1], None, None, None), (None, None, None, None), ("my rules keep me from answering this", None, 1.0, None)], "x"), ("t1", None, None, None, None, "x")]
    d = folder(example_conversations=rows, example_teacher_candidates=teach)
    got = {(r.tbl, r.rec_id, r.pos): r.defect for r in p2_defects.p2_found(spark, d).collect()}
    want = {("example_conversations", k, 1): v for k, (_, v) in bad.items()} | {("example_teacher_candidates", "t0", 1): "empty", ("example_teacher_candidates", "t0", 2): "refusal"}
    assert got == want


def test_p3(spark, folder):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    specs, base = [], None
    for i in range(90):
        if base is None or rng.random() < 0.4:
            base = rng.sample(vocabulary, rng.randint(1, 24))
        words = [w for w in base if rng.random() > 0.08] + rng.sample(vocabulary, rng.randint(0, 2))
        lists = [[" ".join(words[:5]).upper(), None], None, [], [" ".join(words[5:12])], [" ".join(words[12:])]]
        specs.append((f"q{i:03d}", rng.choice(["train", "Train ", "training", "TEST", "valid", "held_out", None, "other"]), None, *lists, "x"))
    specs += [specs[0], ("e1", "train", None, None, None, None, None, None, "x"), ("e2", "test", None, [""], None, None, None, None, "x"), (None, "test", None, ["w1"], None, None, None, None, "x")]
    phrases = ["say hi to Bo", "say hi to Bo!", "please say hi to Bo", "say hi", "well-known tune", "well known", "hi", "", None, "a b c d e", "a x c d f", "b c d e"]
    intents = [("n1", phrases, phrases[::-1], "x"), ("n2", None, ["say, hi; to bo..."], "x"), (None, ["hi"], ["hi"], "x")]
    d = folder(latent_specs=specs, intents=intents)
    bag = lambda r: set(re.findall("[a-z0-9]+", " ".join(x for c in r[3:8] for x in c or [] if x).lower()))
    side = lambda r: {"train": "t", "training": "t", "test": "e", "valid": "e", "heldout": "e"}.get(re.sub("[^a-z]", "", (r[1] or "").lower()))
    want = set()
    for a, b in itertools.product(specs, specs):
        if a[0] and b[0] and a[0] != b[0] and side(a) == "t" and side(b) == "e":
            x, y = bag(a), bag(b)
            if x and y and 4 * len(x & y) >= 3 * len(x | y):
                want.add(("latent_specs", min(a[0], b[0]), max(a[0], b[0])))
    seq = lambda t: re.sub(r"[^\w\s]", "", t.lower().replace("-", " ")).split()

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
        return row[-1] <= 1

    held = [(f"{n}#held_out#{i:02d}", seq(t)) for n, _, h, _ in intents if n for i, t in enumerate(h or []) if t]
    train = [(f"{n}#train#{i:02d}", seq(t)) for n, t_, _, _ in intents if n for i, t in enumerate(t_ or []) if t]
    want |= {("intents", min(i, j), max(i, j)) for i, a in held for j, b in train if a and b and near(a, b)}
    got = [tuple(r) for r in p3_splits.p3_found(spark, d).select("tbl", "left_key", "right_key").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 30


def test_p3_cuts_are_disjoint_and_cheapest():
    rng = np.random.default_rng(1)
    sizes = np.arange(4, 15)
    rarity = np.full((len(sizes), 14), np.inf)
    for i, size in enumerate(sizes):
        rarity[i, :size] = rng.random(size)
    for n in (2 * sizes // 7 + 1, sizes // 3 + 1):
        row, place, length = p3_splits.cheapest_cuts(rarity, sizes, n, p3_splits.SIZES)
        for i, size in enumerate(sizes):
            cuts = sorted(zip(place[row == i], length[row == i]))
            assert len(cuts) == n[i] and all(a + x <= b for (a, x), (b, _) in zip(cuts, cuts[1:] + [(size, 0)]))

            def best(at, left):
                if left == 0:
                    return 0.0
                return min((rarity[i, p : p + x].prod() + best(p + x, left - 1) for p in range(at, size) for x in p3_splits.SIZES if p + x <= size), default=np.inf)

            assert abs(sum(rarity[i, p : p + x].prod() for p, x in cuts) - best(0, n[i])) < 1e-9


def test_p3_banded_matches_table():
    rng = random.Random(8)
    pairs = [([rng.randint(1, 4) for _ in range(rng.randint(0, 9))], [rng.randint(1, 4) for _ in range(rng.randint(0, 9))]) for _ in range(300)]
    for change in (1, 2):
        k = np.array([rng.randint(0, 6) for _ in pairs])
        got = p3_splits.banded([np.array(a, np.int64) for a, _ in pairs], [np.array(b, np.int64) for _, b in pairs], k, change)
        for (a, b), limit, d in zip(pairs, k, got):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j - 1] + (0 if x == y else change), row[j] + 1, new[-1] + 1))
                row = new
            assert d == min(row[-1], limit + 1)


def test_p3_hot_group_is_salted_without_loss(spark, folder):
    """A third of all specs are near copies of each other; salts split their keys and lose no pair."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(20)]
    words = lambda: [w for w in base if rng.random() > 0.06] if rng.random() < 0.34 else [f"v{rng.randint(0, 400)}" for _ in range(20)]
    specs = [(f"q{i:03d}", rng.choice(["train", "train", "test", "dev"]), None, [" ".join(words())], None, None, None, None, "x") for i in range(240)]
    d = folder(latent_specs=specs)
    bags = {s[0]: (s[1], set(s[3][0].split())) for s in specs}
    want = {(min(a, b), max(a, b)) for a, (s, x) in bags.items() for b, (t, y) in bags.items() if s == "train" and t != "train" and 4 * len(x & y) >= 3 * len(x | y)}
    rows = p3_splits.spec_rows(spark.read.parquet(f"{d}/latent_specs.parquet"))
    sets = p3_splits.classes_of(rows, ordered=True)
    for salt_rows in (5, 10**6):
        pairs = p3_splits.spread(p3_splits.spec_pairs(sets, salt_rows), sets, rows, "latent_specs").collect()
        assert {(min(r.eval_id, r.train_id), max(r.eval_id, r.train_id)) for r in pairs} == want and len(want) > 500
    splits = {(r.split, r.n_records) for r in p3_splits.p3_overlaps(spark, d).groupBy("split").agg({"n_records": "sum"}).toDF("split", "n_records").collect()}
    assert {s for s, _ in splits} == {"test", "validation"}


def test_p4(spark, folder):
    item = "the vet's blamed old rhubarb crumble for Anna sneezing; our teammate swapped rooms"
    items = [(1, item, None, "x"), (2, None, "one two three four five six seven", "x"), (3, None, None, "x"), (4, item, None, "x"), (None, item, None, "x")]
    docs = [(10, "so THE vets​ blamed old-rhubarb crumble for anna!", None, None, "x"), (11, "the vet's blamed old rhubarb cake crumble for Anna sneezing", None, None, "x"), (12, None, None, None, "x"),
            (13, "", None, None, "x"), (14, "ｔｈｅ vet’s blamed old rhubarb crumble for Anna", None, None, "x"), (15, "one two three four five six seven", None, None, "x"), (None, item, None, None, "x"), (16, "x " * 50_000 + item, None, None, "x")]
    talks = [("a", None, [("user", "the vets blamed old rhubarb"), ("user", "crumble for Anna sneezing our teammate")], None, None, None, "x"), ("b", None, [("user", None), ("user", item)], None, None, None, "x"), ("c", None, None, None, None, None, "x")]
    d = folder(elaboration_frozen=items, documents=docs, example_conversations=talks)
    got = sorted(tuple(r) for r in p4_leaks.p4_found(spark, d).select("tbl", "rec_id", "item_id").collect())
    assert got == sorted((t, r, i) for t, r in [("documents", "10"), ("documents", "14"), ("documents", "16"), ("example_conversations", "b")] for i in (1, 4))
    loose = {(r.rec_id, r.item_id): r.errors for r in p4_leaks.p4_leaks(spark, d).collect()}
    assert loose["11", 1] == 1 and loose["10", 4] == 0


def test_p4_edits_do_not_cross_messages_or_columns(spark, folder):
    item = "one two three four five six seven eight"
    items = [(1, item, None, "x"), (2, "alpha beta gamma delta", "epsilon zeta eta theta", "x"), (3, item, "red lamp under nine old green garden chairs", "x")]
    talks = [("split", None, [("user", "one two three four"), ("user", "five six seven eight")], None, None, None, "x"), ("whole", None, [("user", "so one two three cake five six seven eight")], None, None, None, "x"),
             ("both", None, [("user", "alpha beta gamma delta epsilon zeta eta theta")], None, None, None, "x"), ("second", None, [("user", "x"), ("user", "red lamp under nine old green garden chairs")], None, None, None, "x")]
    d = folder(elaboration_frozen=items, example_conversations=talks)
    got = {(r.rec_id, r.item_id, r.errors) for r in p4_leaks.p4_leaks(spark, d).collect()}
    assert got == {("whole", 1, 1), ("whole", 3, 1), ("second", 3, 0)}


def test_p4_blocks_of_items_give_the_same_rows(spark, folder, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(words[k : k + 9]), " ".join(words[k + 1 : k + 12]), "x") for k in range(20)]
    docs = [(k, " ".join(words[k : k + 10 + k % 3]), None, None, "x") for k in range(30)]
    d = folder(elaboration_frozen=items, documents=docs)
    read = lambda: sorted(map(tuple, p4_leaks.p4_leaks(spark, d).select("tbl", "rec_id", "item_id", "errors").collect()))
    whole = read()
    monkeypatch.setattr(p4_leaks, "ITEM_BLOCK", 7)
    assert read() == whole and len(whole) > 30


def test_p4_myers_matches_table():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ([rng.choice("abc") for _ in range(rng.randint(1, 8))] for _ in range(2))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert p4_leaks.myers(p, t) == min(row)


def test_p5(spark, folder):
    c = lambda *m: list(m)
    talks = [("b", None, c(("user", "Hi, there!"), ("assistant", "Yo")), None, None, None, "x"), ("a", "s", c(("user", "hi  THERE"), ("assistant", "yo...")), None, None, None, "x"), ("c", None, c(("user", "hithere")), None, None, None, "x"),
             ("n1", None, None, None, None, None, "x"), ("n2", None, [], None, None, None, "x"), ("z", None, c(("user", None)), None, None, None, "x"), ("y", None, c(("user", "?!")), None, None, None, "x"), (None, None, c(("user", "hithere")), None, None, None, "x")]
    teach = [("t", None, None, None, [("A b.", None, None, None), (None, None, None, None), ("ab", None, None, None), ("...", None, None, None), ("AB", None, 2.0, None)], "x"), ("u", None, None, None, [("ab", None, None, None)], "x"), ("v", None, None, None, None, "x")]
    o = {"content": "Hi you", "scores": {"x": 1.5, "y": 2}, "score": 3.0, "source": None}
    lines = [json.dumps(o), json.dumps({"score": 3, "content": "hi, YOU", "scores": {"y": 2.0, "x": 1.50, "z": None}}), json.dumps(o | {"score": 3.1}), json.dumps(o)[:-9], "[1]", None, "", json.dumps(o | {"source": "s"})]
    d = folder(example_conversations=talks, example_teacher_candidates=teach, candidate_lines=[(f"l{i}", x, None, "x") for i, x in enumerate(lines)])
    got = {tuple(r) for r in p5_copies.p5_found(spark, d).select("tbl", "first_key", "copy_key").collect()}
    assert got == {("example_conversations", "a", "b"), ("example_conversations", "n1", "n2"), ("example_conversations", "y", "z"),
                   ("example_teacher_candidates", "t#0", "t#2"), ("example_teacher_candidates", "t#0", "t#4"), ("candidate_lines", "l0", "l1")}
    counts = {(r.tbl, r.rec_key): r.n_copies for r in p5_copies.p5_collapsed(spark, d).collect()}
    assert counts["example_teacher_candidates", "t#0"] == 3 and counts["candidate_lines", "l7"] == 1 and len(counts) == 9


def test_p6(spark, folder):
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.randint(1, 70)), None, None, "x") for i in range(150)] + [(900, None, None, None, "x"), (901, "", None, None, "x"), (5, "word word", None, None, "x"), (902, "word " * 500, None, None, "x")]
    d = folder(documents=docs, pack_limits=[("small", 64), ("none", None), ("big", 200)])
    rows = p6_packing.p6_pack(spark, d).collect()
    for profile, capacity in (("small", 64), ("big", 200)):
        mine = [r for r in rows if r.profile == profile]
        fill = {}
        for r in mine:
            if r.container_no is not None:
                fill[r.container_no] = fill.get(r.container_no, 0) + r.tokens
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert len({r.doc_id for r in mine}) == len({x[0] for x in docs}) and sum(r.container_no is None for r in mine) == 2
        assert len(fill) <= 1.05 * sum(fill.values()) / capacity + 1
        parts = [(r.doc_id, r.part) for r in mine if r.tokens < capacity and r.doc_id not in (5, 902)]
        assert len(parts) == len(set(parts))  # nothing short is split
    assert {r.profile for r in rows} == {"small", "big"}


def test_p6_fullest_is_fullest():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 40)
        best = max(sum(k * n for k, n in zip(counts, pick)) for pick in itertools.product(*[range(v + 1) for v in counts.values()]) if sum(k * n for k, n in zip(counts, pick)) <= room)
        chosen = p6_packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


def test_p7(spark, folder):
    rng = random.Random(6)
    docs = [(i, " ".join(["word"] * rng.randint(1, 40)), None, rng.choice(["a", "a", "a", "b", "c", None, "loose"]), "x") for i in range(1500)] + [(7, None, None, "a", "x"), (3, "word", None, "b", "x")]
    d = folder(documents=docs, mix_targets=[("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2), ("gone", 0.05, 9)])
    shares = {r.source: r for r in p7_mixing.p7_shares(spark, d).collect()}
    for s, goal in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(shares[s].actual_share - goal / 0.95) < 0.005 and shares[s].most_repeats <= shares[s].max_repeats
    assert shares["gone"].actual_share == 0
    mix = p7_mixing.p7_mix(spark, d)
    assert mix.where("repeats < 1").count() == 0 and {r.source for r in mix.select("source").distinct().collect()} == {"a", "b", "c"}
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, p7_mixing.p7_mix(spark, d).collect()))


def test_p7_flight_keeps_balance():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 500, 400)
    p = p7_mixing.flight(np.full(400, 0.3), tokens, rng)
    assert abs(p.sum() - 120) < 1e-6 and abs((p * tokens).sum() - 0.3 * tokens.sum()) < 1e-4 and ((p > 0) & (p < 1)).sum() <= 2


def test_p7_heavy_tail_reaches_its_shares(spark, folder):
    """Two documents far larger than the others are decided in flight; what is left is balanced to a document."""
    rng = random.Random(11)
    for seed in range(12):
        sizes = np.array([rng.randint(20, 800) for _ in range(302)] + [7000, 9000])
        p = p7_mixing.flight(np.full(304, 0.5), sizes, np.random.default_rng(seed), p7_mixing.LANDING)
        inside = np.flatnonzero((p > 0) & (p < 1))
        assert len(inside) <= p7_mixing.LANDING and sizes[inside].max() < 900
        assert abs((p * sizes).sum() - sizes.sum() / 2) < 1e-3 and abs(p.sum() - 152) < 1e-6
    docs = [(i, " ".join(["word"] * (3000 if i % 100 == 0 else rng.randint(5, 60))), None, "ab"[i % 2], "x") for i in range(600)]
    d = folder(documents=docs, mix_targets=[("a", 0.35, 1), ("b", 0.65, 1)])
    shares = {r.source: r.actual_share for r in p7_mixing.p7_shares(spark, d).collect()}
    assert abs(shares["a"] - 0.35) < 0.001 and abs(shares["b"] - 0.65) < 0.001


def test_p8(spark, folder, monkeypatch):
    words = "soup lamp anna bus cake tent rope tile plum oven lane boat pear sofa mug kite door rice hat pie wall".split()
    prose = "It was a quiet day and we talked about the rain. Nobody knew why the lamp was on, but it is fine. " * 3
    kinds = {
        1: (prose, None), 2: ("User: did you see the lamp that I left?\nBot: yes, it was on the table and I took it\n" * 3, None), 3: ("- soup\n- old lamp\n- call Anna\n- bus pass", "list"),
        4: ("soup, old lamp, call Anna, bus pass, plum cake, tent", "list"), 5: ("name,town,food\nAnna,Rome,soup\nBo,Oslo,cake", "table"), 6: ("| a | b |\n| soup | lamp |\n| cake | tent |", "table"),
        7: ("ha ha ha ha ha ha ha ha ha ha ha ha", "junk"), 8: ("q7Zk9vLw3XyT0bN5cM8dF2gH4jK6lP1rS==" * 4, "junk"), 9: (None, "junk"), 10: (" \n​", "junk"), 11: ("[1] INFO q=1 rt=0x12ab34 d=2\n[2] WARN q=3 rt=0x99ab34 d=1", "junk"),
        12: ("phone stool paint suitcase plant deck latch machine mower library toolbox plant bread grater fern cover", "junk"), 13: (prose * 40, None), 14: ("\n".join(f"- {a} {b}" for a in words for b in words), "list"),
        15: ("<table><tr><td>food</td><td>count</td></tr>\n" + "<tr><td>plum cake</td><td>14</td></tr>\n" * 4, "table"),
        16: ("la lampada del corridoio (40), la bici arrugginita / Anna, un cesto di ciliegie, la chiave della cantina, il cappotto pesante", "list"),
        17: ("x" * 40_000 + "\r\n" + "\u0100\U0001F600 \U00020000 '", "junk"),
    }
    d = folder(documents=[(k, t, None, None, "x") for k, (t, _) in kinds.items()] + [(3, kinds[3][0], None, None, "x"), (None, None, None, None, "x")])
    want = sorted([(k, v) for k, (_, v) in kinds.items() if v] + [(3, "list"), (None, "junk")], key=str)
    got = sorted(((r.doc_id, r.kind) for r in p8_quality.p8_found(spark, d).collect()), key=str)
    assert got == want
    columns = ("chars", "words", "letters", "lines", "common", "ends", "solid", "tokens")
    read = lambda: sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in p8_quality.text_counts(spark, d).where("doc_id in (1, 2, 13, 14)").collect()))
    whole = read()
    monkeypatch.setattr(p8_quality, "CHUNK", 97)  # the same sums whatever the chunks
    assert read() == whole
    row = next(r for r in whole if r[0] == 13)
    assert row[1] == len(prose * 40) and row[2] == len(re.findall(r"[A-Za-z]+", prose * 40))


def test_p8_sums_do_not_depend_on_chunks(spark, folder, monkeypatch):
    """Every sum and the word hashes, with lines and tokens longer than a chunk; closed and bullet lines against a loop."""
    prose = "it wasn't a quiet day and we talked about the rain. nobody knew why, but it is fine; "
    texts = [
        prose * 6 + "done.", "- " + prose * 5, "\n" + prose * 5 + "\n\n- soup\n- lamp.\n", " " * 300 + "late start.\n" + "x" * 250 + "'" + "y" * 120 + ". end",
        "a=1 b=2 " + prose * 3 + "<td>" + "\r" + prose * 2 + "\r\n" + prose, "| soup " * 40 + "\n" + "soup,lamp," * 30, "Ÿ€ Ã© " * 40 + "\n" + "Ÿ€" * 90 + "Ã©" * 90, "%41%42" * 60 + " " + "ab " * 90 + "0f" * 70,
        "anna, bus, cake, tent, " * 12, ("no end here\n" + prose * 2 + "done!\n") * 5, "one line after another " * 9 + "\u2028" + "- next " * 30,
    ]
    d = folder(documents=[(k, t, None, None, "x") for k, t in enumerate(texts)])
    read = lambda: {r.doc_id: r.asDict() for r in p8_quality.text_counts(spark, d).collect()}
    stats = lambda: {r.doc_id: r.asDict() for r in p8_quality.p8_stats(spark, d).collect()}
    whole, figures = read(), stats()
    for k, t in enumerate(texts):
        lines = t.splitlines()
        assert whole[k]["lines"] == sum(bool(x.strip()) for x in lines)
        assert whole[k]["closed_lines"] == sum(bool(re.search(r"[.!?…][\"'”»)]*\s*$", x)) for x in lines)
        assert whole[k]["bullet_lines"] == sum(x.startswith("- ") for x in lines)
    for chunk in (41, 97, 200):
        monkeypatch.setattr(p8_quality, "CHUNK", chunk)
        assert read() == whole and stats() == figures


def test_crf_learns_order():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 2, rng.integers(2, 6)) for _ in range(300)]
    lengths = np.array([len(s) for s in seqs])
    symbols = np.concatenate(seqs)
    y = np.concatenate([np.r_[0, s[:-1]] for s in seqs])  # the label is the symbol before
    before = np.concatenate([np.r_[2, s[:-1]] for s in seqs])
    place = np.arange(len(symbols))
    x = np.eye(2)[symbols]
    field = LinearChain(2, 2, 3).fit(x, before, place, y, lengths)
    assert (field.decode(field.scores(x, before, place), lengths) == y).mean() > 0.95


def test_crf_gradient_and_best_path_match_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    n = lengths.sum()
    x, y = rng.normal(size=(n, 3)), rng.integers(0, 2, n)
    bucket, place = rng.integers(0, 4, 12), np.sort(rng.integers(0, n, 12))
    field = LinearChain(2, 3, 4)
    for p in field.parts():
        p += rng.normal(size=p.shape)
    paths = lambda size: itertools.product((0, 1), repeat=int(size))

    def value(scores, z):
        return field.start[z[0]] + field.end[z[-1]] + sum(scores[i, k] for i, k in enumerate(z)) + sum(field.move[i, j] for i, j in zip(z, z[1:]))

    def likelihood():
        scores, total, at = field.scores(x, bucket, place), 0.0, 0
        for size in lengths:
            part = scores[at : at + size]
            total += value(part, y[at : at + size]) - np.log(sum(np.exp(value(part, z)) for z in paths(size)))
            at += size
        return total

    for p, g in zip(field.parts(), field.gradient(x, Sparse(bucket, place, n, 4), y, lengths, list(groups(lengths)))):
        for at in np.ndindex(p.shape):
            low = likelihood()
            p[at] += 1e-5
            assert abs((likelihood() - low) / 1e-5 - g[at]) < 1e-2
            p[at] -= 1e-5
    scores, at = field.scores(x, bucket, place), 0
    tags = field.decode(scores, lengths)
    for size in lengths:
        best = max(paths(size), key=lambda z: value(scores[at : at + size], z))
        assert tuple(tags[at : at + size]) == best
        at += size


def test_flat_words_and_hashes_match_a_loop():
    rng = random.Random(5)
    alphabet = "ab'’É1 .\n\t-ß\U00020000\u200b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "x" * 300_000]
    seen = []
    for low, high in blocks(texts, 100):
        flat = Flat(texts[low:high])
        first, last = flat.words()
        hashes = flat.hashes(first, last)
        owner = np.searchsorted(flat.stops, first)
        for i, text in enumerate(texts[low:high]):
            words = re.findall(r"[abÉß\U00020000x]+(?:['’][abÉß\U00020000x]+)*", text)
            mine = owner == i
            assert [flat.text[f : e + 1] for f, e in zip(first[mine], last[mine])] == words
            if words:
                assert list(hashes[mine]) == list(word_hashes(words)) == list(word_hashes([w.lower() for w in words]))
        seen += list(range(low, high))
    assert seen == list(range(len(texts)))


def test_p2_field_needs_its_words_and_its_chain(spark, folder):
    """Phrases, words and statistics are learnt: made defects kept out of training are told from sound answers."""
    rng = random.Random(12)
    sound = ["we walked to the {} before noon", "my aunt keeps a {} in the garden", "i think the {} was fine. did you see it?", "that sounds lovely, a {} is never wrong"]
    nouns = "lantern kettle ladder blanket basket violin cupboard suitcase curtain bicycle pancake teapot".split()
    pairs = [(rng.choice(sound).format(rng.choice(nouns)), rng.choice(sound).format(rng.choice(nouns)), 0) for _ in range(400)]
    made = p2_defects.made_defects(pairs)
    assert {m[3] for m in made} >= {0, 1, 2, 4, 5} and made == p2_defects.made_defects(pairs)
    held, train = made[::4], [m for i, m in enumerate(made) if i % 4]
    langs = np.zeros((p2_defects.BUCKETS, 6), np.float32)
    counts = {}
    for text in [t for q, a, _ in pairs for t in (q, a)]:
        words = re.findall(r"\w+", text)
        for i, h in enumerate(word_hashes(words).view(np.int64)):
            was = counts.get(int(h), (0, 0, 0))
            counts[int(h)] = (was[0] + (i + 1 < len(words)), was[1] + (i + 1 == len(words)), was[2])
        for w in words:
            for k in range(1, len(w)):
                h = int(word_hashes([w[:k]]).view(np.int64)[0])
                was = counts.get(h, (0, 0, 0))
                counts[h] = (*was[:2], was[2] + 1)
    field = p2_defects.trained(pairs, train, counts, langs)
    given = [p2_defects.plain(m[1]) for m in held]
    ending = np.array([counts.get(h, (0, 0, 0)) for h in p2_defects.last_hashes(given)], float)
    clauses = p2_defects.Clauses([p2_defects.plain(m[0]) for m in held], given, np.zeros(len(held), int), ending, langs)
    found, _ = p2_defects.tagged(field, clauses, given)
    want = [(None, "refusal", "copy", "other_language", "truncated", "empty")[m[3]] for m in held]
    assert sum(a == b for a, b in zip(found, want)) > 0.85 * len(want)
