"""Core operators against literal loops and the fixtures of the survey."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from talkmill.functions import metrics, normalize
from talkmill.operators import cleaning, conversations as conv, evaluation as ev, generate, leakage, packing, selection
from talkmill.plans import sessions, skew
from talkmill.sources import readers

TALK = "id string, source string, messages array<struct<role:string,content:string>>"


def talk(i, *texts, source="s"):
    return (i, source, [("user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)])


def test_reject_reasons(spark):
    rows = [
        talk("ok", "hey, how was your day?", "pretty good, went for a walk"),
        talk("style", "hey there", "As an AI I cannot feel, but hello"),
        talk("code", "hey there friend", "try def foo(x): and run it"),
        talk("fact", "where is it?", "paris is the capital of france"),
        talk("inst", "please write an essay for me now", "no way, too tired for that"),
        talk("long", "hey there", " ".join(["word"] * 50)),
        talk("few", "hey there"),
        ("null", "s", None),
        ("empty", "s", []),
        talk("noreply", "hey there")[:2] + ([("user", "hey"), ("user", "there")],),
    ]
    df = cleaning.with_parts(spark.createDataFrame(rows, TALK))
    got = {r.id: (r.a, r.b) for r in df.select("id", cleaning.reject_reason().alias("a"), cleaning.reject_reason(cleaning.FilterConfig().permissive()).alias("b")).collect()}
    assert got["ok"] == (None, None)
    assert got["style"][0] == "ai_assistant_style" and got["code"][0] == "code" and got["fact"][0] == "factual_qa"
    assert got["inst"][0] == "instruction_following" and got["long"] == ("assistant_turn_too_long", None)
    assert got["few"][0] == got["null"][0] == got["empty"][0] == "too_few_turns"
    assert got["noreply"][0] == "no_assistant_turn"


def test_deduplicate_matches_loop(spark):
    base = [f"w{chr(97 + k % 7)} x{chr(97 + k % 3)}".replace("w", "q") for k in range(40)]
    texts = [" ".join(base[s : s + n]) for s, n in [(0, 12), (0, 12), (1, 8), (5, 20), (0, 30), (2, 9), (2, 9), (30, 3), (30, 3)]] + ["", "!!", None]
    rows = list(enumerate(texts))
    got = {r.k: r.duplicate for r in cleaning.deduplicate(spark.createDataFrame(rows, "k int, t string"), F.col("t"), "k").collect()}
    exact, shingles, want = set(), set(), {}
    for k, t in rows:
        if t is None:
            want[k] = None
            continue
        key = re.sub(r"\W+", " ", t.lower()).strip()
        if key in exact:
            want[k] = "exact_duplicate"
            continue
        exact.add(key)
        w = re.findall("[a-z']+", t.lower())
        sh = ({" ".join(w)} if w else set()) if len(w) < 8 else {" ".join(w[i : i + 8]) for i in range(len(w) - 7)}
        want[k] = "near_duplicate" if len(sh) > 3 and sh <= shingles else None
        if want[k] is None:
            shingles |= sh
    assert got == want


def test_merge_and_chosen(spark):
    rows = [("a", 0, "user", "hi"), ("a", 1, "user", "you there?"), ("a", 2, "user", "ok"), ("a", 3, "system", "x"), ("a", 4, "system", "y"), ("a", 5, "assistant", "yes")]
    got = [(r.turn, r.content) for r in conv.merge_consecutive(spark.createDataFrame(rows, "id string, turn int, role string, content string")).orderBy("turn").collect()]
    assert got == [(0, "hi. you there? ok"), (3, "x"), (4, "y"), (5, "yes")]
    schema = "id string, messages array<struct<role:string,content:string>>, candidates array<struct<content:string,score:double>>, chosen int"
    rows = [("t", [("user", "q"), ("assistant", "old")], [("a", 2.0), ("b", 2.0)], None), ("n", [("user", "q")], None, None), ("o", [("user", "q")], [("a", 1.0)], 5), ("b", [("user", "q")], [(" ", 1.0)], 0)]
    got = {r.id: r.messages[-1].content for r in conv.apply_chosen(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"t": "b", "n": "q"}


def test_normalize(spark):
    cases = {
        "hey   there  !": "hey there!", "don ' t  worry": "don't worry", "“hi” – ok…": '"hi" - ok...', "see https://x.y/z now": "see <link> now",
        "User: hey": "hey", "wow!!!!!!!": "wow!!!", "ﬁne": "fine", "": "", "mail a.b@c.de please": "mail <email> please",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", normalize.normalize(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases | {None: None}
    got = spark.createDataFrame([('x {"a": "}", "b": {"c": 1}} y',), ("none",)], "t string").select(normalize.first_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in got] == ['{"a": "}", "b": {"c": 1}}', None]


def normalized(text):
    """A literal loop over the reference's steps."""
    text = unicodedata.normalize("NFKC", text)
    for a, b in normalize.QUOTES.items():
        text = text.replace(a, b)
    for pattern, new in [
        (r"https?://\S+|www\.\S+", "<link>"), (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "<email>"), (r"(?i)^\s*(?:user|assistant|human|ai|bot|a|b)\s*[:>]\s*", ""),
        (r"(?i)\b(\w+)\s+'\s*(s|t|re|ve|ll|d|m)\b", r"\1'\2"), (r"\s+([,.!?;:%])", r"\1"), (r"([!?.,])\1{3,}", r"\1\1\1"), (r"\n{2,}", "\n"), (r"[ \t\xa0]+", " "),
    ]:
        text = re.sub(pattern, new, text)
    return text.strip()


def test_normalized_texts_reads_the_whole_text(spark, tmp_path):
    from talkmill import catalog

    texts = ["one\ntwo  lines\n\n\nthree", "one\nother lines", "ﬁne ½ ｈｅｙ…", "été 's  rain\u2028!", "café 's", "é@ü.de www.ä.x\u2028y", "User: ok\nBot: a.b@c.de", "", " \n", "\x85hm ,\u2003so", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.digest, r.link, r.email, r.n_surface, r.surface) for r in catalog.queries()["normalized_texts"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for k, t in enumerate(texts):
        if t is not None:
            n, s = normalized(t), re.sub(r"\s+", " ", re.sub(r"[^a-z0-9' ]+", " ", t.lower())).strip()
            want[k] = (len(n), sha(n), "<link>" in n, "<email>" in n, len(s), sha(s))
    assert got == want and got[0][5] != got[1][5]


def test_reply_facts(spark):
    rows = [("a", 0, "user", "what a day"), ("a", 1, "assistant", "i i think think so"), ("a", 2, "user", "ok then my friend"), ("a", 3, "assistant", "ok then my friend"),
            ("a", 4, "user", "x"), ("a", 5, "assistant", "ok then my friend"), ("b", 0, "user", None), ("b", 1, "assistant", "")]
    facts = ev.turn_facts(ev.reply_pairs(spark.createDataFrame(rows, "id string, turn int, role string, content string")))
    got = {(r.id, r.n): list(r.broken_reasons) for r in facts.collect()}
    assert got["a", 1] == ["ungrammatical"] and got["a", 2] == ["context_copy"] and got["a", 3] == ["repeats_previous_turn"]
    assert got["b", 1] == ["empty", "ungrammatical"]
    assert {r.id: r.loop for r in ev.looped(facts).collect()} == {"a": True, "b": False}


def test_probes(spark):
    replies = spark.createDataFrame([("a", 1, "Your dog is Rex"), ("a", 2, "it was invented by bob")], "id string, n int, said string")
    schema = "id string, turn int, expect_any array<string>, forbid_any array<string>, forbid_confident boolean"
    probes = [("a", 1, ["rex"], None, False), ("a", 1, ["tom"], None, False), ("a", 1, None, ["dog"], None), ("a", 2, [], [], True), ("a", 9, None, None, None)]
    got = {(r.turn, str(r.expect_any), str(r.forbid_any)): r.reason for r in ev.run_probes(spark.createDataFrame(probes, schema), replies).collect()}
    assert sorted(got.values()) == ["expected_content_absent", "fabricated_fact", "forbidden_content_present", "missing_turn", "ok"]


def test_heuristic_scores_prefer_the_natural(spark):
    schema = "id string, messages array<struct<role:string,content:string>>, candidates array<struct<content:string,scores:map<string,double>,score:double,source:string>>"
    ask = [("user", "i'm so tired today, work was brutal")]
    say = [("oof, that sounds rough. did you get any rest?", None, None, None), ("As an AI, furthermore, in conclusion it's important to rest. Step 1 sleep.", None, None, None), (None, None, None, None)]
    rows = selection.heuristic_scores(selection.candidates(spark.createDataFrame([("x", ask, say)], schema))).withColumn("score", selection.weighted(F.col))
    score = {r.place: r.score for r in rows.collect()}
    assert score[0] > 4 > score[1] > score[2] == 1.0
    assert selection.best_of(rows.drop("given", "earlier")).head().place == 0


def test_leakage_fails_closed(spark):
    grams = leakage.benchmark_grams(spark.createDataFrame([("one two three four five six seven",)], "t string"), "t")
    rows = spark.createDataFrame([(1, "well, one two three four five six!"), (2, "one two three"), (3, None)], "k int, t string")
    assert [r.k for r in leakage.flagged(rows, "k", "t", grams).collect()] == [1]
    assert sorted(r.k for r in leakage.without_leaks(rows, "k", "t", grams).collect()) == [2, 3]
    with pytest.raises(ValueError):
        leakage.gate(rows, "k", "t", grams)


def test_skew_helpers_match_plain_windows(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 101, i) for i in range(300)] + [(None, None, 1000), ("k1", None, 1001)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r.i: r.rank for r in skew.bucketed_rank(df, ["k"], [F.col("v"), F.col("i")], F.floor(F.col("v") / 10)).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] if r[1] is not None else -1, r[2]))):
            want[r[2]] = n
    assert got == want
    copies = skew.copies_with_first(df.where("k is not null"), "k", "i", hot_share=4)
    assert {(r.k, r.first_ident, r.n_copies) for r in copies.collect()} == {(k, min(r[2] for r in rows if r[0] == k), sum(r[0] == k for r in rows)) for k in {r[0] for r in rows if r[0]} if sum(r[0] == k for r in rows) > 1}


def test_gap_sessions(spark):
    import datetime as dt

    at = [0, 10, 5000, 90000, 90010, 180000]
    rows = [("u", dt.datetime(2030, 1, 1) + dt.timedelta(seconds=s), i) for i, s in enumerate(at)] + [(None, None, 9)]
    df = spark.createDataFrame(rows, "u string, at timestamp, i int")
    limit = spark.createDataFrame([(3600,)], "limit_s bigint")
    assert [r.session_no for r in sessions.gap_sessions(df, "u", "at", "i", limit).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3]


def test_pack_offsets(spark):
    rows = spark.createDataFrame([(i * 3, i % 5) for i in range(50)], "k int, n int")
    got = {r.k: r.offset for r in packing.token_offsets(rows, "k", "n", buckets=7).collect()}
    upto, want = 0, {}
    for i in range(50):
        want[i * 3] = upto
        upto += i % 5
    assert got == want


def test_readers(spark, tmp_path):
    (tmp_path / "dialogues_x.txt").write_text("hi __eou__ hello __eou__ bye __eou__\nalone __eou__\n__eou__ a __eou__ b\n")
    got = {r.id: [(m.role, m.content) for m in r.messages] for r in readers.read_eou(spark, str(tmp_path / "dialogues_x.txt")).collect()}
    assert got == {"dd-dialogues_x-000000": [("user", "hi"), ("assistant", "hello"), ("user", "bye")], "dd-dialogues_x-000002": [("assistant", "a"), ("user", "b")]}
    (tmp_path / "u.csv").write_text("conv_id,utterance_idx,context,prompt,utterance\nc1,2,sad,p,no_comma_ really\nc1,1,sad,p,hi\nc2,1,joy,q,one\n")
    row = readers.read_utterances(spark, str(tmp_path / "u.csv")).collect()
    assert [(r.id, [m.content for m in r.messages], r.meta["emotion"]) for r in row] == [("ed-c1", ["hi", "no, really"], "sad")]
    lines = [
        '{"id": "m", "messages": [{"role": "Human", "content": "q"}, {"role": "bot", "content": "a"}, {"role": "tool", "content": "x"}], "topic": "t", "candidates": ["c ", {"response": "d", "score": 4}]}',
        '{"conversation": "noise\\nUser: hi\\nmore\\n\\nAI> yo"}', '{"dialog": ["a", "", "b"]}', '{"turns": [{"role": "me", "content": "x"}, {"role": "them", "content": "y"}]}', '{"text": "nothing"}', "",
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = {r.id: r for r in readers.read_tolerant_jsonl(spark, str(tmp_path / "t.jsonl"), "src").collect()}
    text = {k: [(m.role, m.content) for m in r.messages] for k, r in got.items()}
    assert text == {"m": [("user", "q"), ("assistant", "a")], "src-000001": [("user", "hi more"), ("assistant", "yo")], "src-000002": [("user", "a"), ("user", "b")], "src-000003": [("user", "x"), ("assistant", "y")]}
    assert [(c.content, c.score) for c in got["m"].candidates] == [("c", None), ("d", 4.0)] and got["m"].meta == {"topic": "t"}


def test_split_is_append_stable(spark):
    make = lambda n: cleaning.split_by_family(spark.createDataFrame([(f"f{i}",) for i in range(n)] + [(None,)], "f string"), F.col("f"))
    few, many = ({r.f: r.part for r in make(n).collect()} for n in (40, 80))
    assert all(many[f] == p for f, p in few.items()) and len(set(many.values())) == 3
    with pytest.raises(ValueError):
        cleaning.split_by_family(spark.range(1), F.lit("x"), 0.6, 0.5)


def test_generators(spark):
    a = generate.teacher_requests(spark, 50, ["t1", "t2", "t3"], ["sad", "glad"], ["s1", "s2"], [4, 6])
    assert a.collect() == a.repartition(7).orderBy("id").collect()
    assert {r.topic for r in a.collect()} == {"t1", "t2", "t3"}
    v = generate.prompt_variants(spark.createDataFrame([("n", "hi")], "name string, prompt string"), [("plain", "{}"), ("again", "{}"), ("mark", "{}!")])
    assert {(r.text, r.form) for r in v.collect()} == {("hi", "plain"), ("hi!", "mark")}
    u = spark.range(4000).select(generate.pick_weighted(generate.uniform(F.col("id"), "x"), [("a", 3), ("b", 1)]).alias("p")).groupBy("p").count()
    assert abs({r.p: r["count"] for r in u.collect()}["a"] - 3000) < 150


def test_wilson_and_rates(spark):
    low, high = metrics.wilson(F.lit(8), F.lit(10))
    row = spark.range(1).select(low.alias("l"), high.alias("h"), metrics.perplexity(F.lit(50.0)).alias("p")).head()
    assert 0.49 < row.l < 0.5 and 0.94 < row.h < 0.95 and abs(row.p - 485165195.4) < 1


def test_streams(spark, tmp_path):
    from talkmill.streaming import pipelines

    spark.createDataFrame([("a", 0, "my name is Anna"), ("a", 2, "call me Anna"), ("b", 0, "i live in Rome"), ("b", 1, None)], "id string, turn int, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, turn int, content string").parquet(str(tmp_path / "in"))
    query = pipelines.talk_memory(stream).writeStream.format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.id, r.slot, r.value, r.confidence) for r in spark.table("memory_out").collect()}
    assert got == {("a", "name", "anna", 0.75), ("a", "name", "anna", 0.9), ("b", "location", "rome", 0.75)}


def test_entry_without_llm(spark):
    from talkmill import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 40


def cleaned(talks):
    """A literal loop over the reference's preparation: (reason, messages) of each talk; lists as in ``lexicons``."""
    from talkmill.functions import lexicons as lex

    has = lambda text, needles: any(n in text.lower() for n in needles)
    emoji = lambda c: unicodedata.category(c) == "So" or 0x1F300 <= ord(c) <= 0x1FAFF

    def reason(m):
        m = [x for x in m if x[0] != "system"]
        full, said = " ".join(t for _, t in m), " ".join(t for r, t in m if r == "assistant")
        sizes = [(r, len(t.split())) for r, t in m]
        replies = [n for r, n in sizes if r == "assistant"]
        if len(m) < 2:
            return "too_few_turns"
        if len(m) > 40:
            return "too_many_turns"
        if not replies:
            return "no_assistant_turn"
        if sum(c.isalpha() or c.isspace() or c in ".,!?'" for c in full) / len(full) < 0.5:
            return "low_alpha_ratio"
        if sum(ord(c) > 127 and not emoji(c) for c in full) / len(full) > 0.05:
            return "non_english"
        for r, n in sizes:
            if r == "assistant" and n > 45:
                return "assistant_turn_too_long"
            if n > 60:
                return "turn_too_long"
        if sum(replies) / len(replies) > 30:
            return "assistant_too_verbose"
        if has(said, lex.AI_ASSISTANT_PHRASES):
            return "ai_assistant_style"
        if re.search("|".join(lex.CODE_PATTERNS), full, re.M):
            return "code"
        if re.search("|".join(lex.MATH_PATTERNS), said.lower()):
            return "math"
        if has(full, lex.INSTRUCTION_MARKERS):
            return "instruction_following"
        if has(said, lex.FACTUAL_QA_MARKERS):
            return "factual_qa"
        return "list_formatting" if len(re.findall(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+", full)) > 2 else None

    exact, shingles, out = set(), set(), {}
    for i, messages in talks:
        m = []
        for role, content in messages or []:
            text = normalized(content or "")
            if text and m and m[-1][0] == role and role != "system":
                m[-1] = (role, m[-1][1] + (" " if m[-1][1].endswith((".", "!", "?", ",")) else ". ") + text)
            elif text:
                m.append((role, text))
        why = reason(m)
        if why is None:
            body = "\n".join(f"{r}: {t}" for r, t in m)
            key, w = re.sub(r"\W+", " ", body.lower()).strip(), re.findall("[a-z']+", body.lower())
            grams = ({" ".join(w)} if w else set()) if len(w) < 8 else {" ".join(w[k : k + 8]) for k in range(len(w) - 7)}
            if key in exact:
                why = "exact_duplicate"
            elif len(grams) > 3 and grams <= shingles:
                why = "near_duplicate"
            else:
                shingles |= grams
            exact.add(key)
        out[i] = (why, m)
    return out


def test_cleaned_talks_match_loop(spark, tmp_path):
    from talkmill import catalog

    a = ("hey, how was your long day at the lake?", "pretty good, went for a walk with my old friend Anna")
    rows = [
        talk("a0", a[0], "As an AI I cannot feel, but hello"), talk("a1", *a), talk("a2", *(t.upper().replace(",", "  ,") for t in a)),
        ("b0", "s", [("user", "hey"), ("user", "you"), ("assistant", " \x85"), ("user", "there")]), ("b1", "s", [("user", "ok."), ("user", "you?"), ("assistant", "yes"), ("assistant", "ﬁne")]),
        ("c0", "s", [("system", "x"), ("system", "y"), ("user", "„so“ … – ’ ’ ’ ’"), ("assistant", "ja „so“")]), talk("c1", "see https://x.y/def z", "User: mail a@b.c !"), talk("c2", "❤ hi there my very good old friend", "❤\ufe0f so nice to see you"), talk("c3", "❤\ufe0f hi there my very good old friend", "❤ so nice to see you"),
        talk("d0", *a, "and what did she tell you then?", "As an AI I cannot feel"), talk("d1", "and what did she tell you then?", "nothing much to be honest with you"), ("e0", "s", None), ("e1", "s", []),
        talk("f0", "é 's late", "word " * 46), talk("f1", "so", "a b " * 24), talk("f2", "hm", "été = 3"),
    ]
    spark.createDataFrame(rows, TALK).write.parquet(f"{tmp_path}/example_conversations.parquet")
    got = {r.id: (r.reason, r.n_messages or 0, r.digest) for r in catalog.queries()["cleaned_talks"](spark, str(tmp_path)).collect()}
    sha = lambda m: hashlib.sha256("\n".join(f"{r}: {t}" for r, t in m).encode()).hexdigest()
    want = {i: (why, len(m), sha(m)) for i, (why, m) in cleaned([(r[0], r[2]) for r in rows]).items()}
    assert {k: v for k, v in got.items() if k != "e0"} == {k: v for k, v in want.items() if k != "e0"} and got["e0"][0] == want["e0"][0]
    assert got["a1"][0] is None and got["a2"][0] == "exact_duplicate" and got["b0"][0] == "too_few_turns" and got["b1"][0] is None and got["c3"][0] == "exact_duplicate"


def test_memory_slots_all_has_jobs(spark, tmp_path):
    from talkmill import catalog

    rows = [talk("a", "I'm a nurse.", "ok", "i am an night owl, my dog is called rex", "ok", "i'm a nurse!"), talk("b", "i'm a bit tired", "ok", "am i a baker? i am a baker?")]
    spark.createDataFrame(rows, TALK).write.parquet(f"{tmp_path}/example_conversations.parquet")
    got = {(r.id, r.slot): (r.turn, r.value, r.confidence) for r in catalog.queries()["memory_slots_all"](spark, str(tmp_path)).collect()}
    assert got == {("a", "job"): (4, "nurse", 0.9), ("a", "pet_name"): (2, "rex", 0.75)}


def test_clean_prefixes_long(spark, tmp_path):
    from talkmill import catalog

    said = "we ate soup|rain came late|anna took our boat|nice lamp there|you were asleep|he made plum cake|she read alone|they went home|no bus tonight|maybe tomorrow then".split("|")
    long = [t for s in said for t in ("so?", s)]
    rows = [talk("a", *long), talk("b", *long[:19], "..."), talk("c", *long[:10])]
    spark.createDataFrame(rows, TALK).write.parquet(f"{tmp_path}/example_conversations.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["clean_prefixes_long"](spark, str(tmp_path)).collect())
    assert got == [(5, 3, 3), (10, 2, 1)]


def test_talk_averages(spark, tmp_path):
    from talkmill import catalog

    rows = [talk("a", "what a day", "go on go on go on", "so we ate", "we ate soup"), talk("b", "hm", "")]
    spark.createDataFrame(rows, TALK).write.parquet(f"{tmp_path}/example_conversations.parquet")
    got = {r.id: (r.mean_rep_ngram, r.mean_copy_ratio) for r in catalog.queries()["talk_averages"](spark, str(tmp_path)).collect()}
    assert got == {"a": (0.25, 0.333333), "b": (0.0, 0.0)}


def test_reply_and_topic_state_match_batch(spark, tmp_path):
    """The streaming forms, fed in two batches, give what the batch operators give."""
    from talkmill.operators import harness
    from talkmill.streaming import pipelines

    said = ["how are you?", "and work?", "hm", "how are you?", "the boss called", "we ate pizza", "pizza again?", "hm", "school starts", None]
    rows = [(i, t, x) for i in ("a", "b") for t, x in enumerate(said)]
    (tmp_path / "in").mkdir()
    schema = "id string, turn int, content string"
    out = {}
    for name, make in (("replies", pipelines.reply_state), ("topics", pipelines.topic_state)):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        out[name] = query
    for part in (lambda t: t < 5, lambda t: t >= 5):
        spark.createDataFrame([r for r in rows if part(r[1])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for query in out.values():
            query.processAllAvailable()
    for query in out.values():
        query.stop()
    batch = harness.recent_repeats(spark.createDataFrame(rows, "id string, n int, said string")).select("id", "n", "seen_recently").collect()
    assert {(r.id, r.turn, r.seen_recently) for r in spark.table("replies").collect()} == {tuple(r) for r in batch}
    runs = {(r.turn, r.consecutive_questions) for r in spark.table("replies").where("id = 'a'").collect()}
    assert {(0, 1), (1, 2), (2, 0), (3, 1), (6, 1)} <= runs
    turns = spark.createDataFrame([(i, t, "user", x) for i, t, x in rows], "id string, turn int, role string, content string")
    want = {r.id: r.topics for r in harness.app_state(turns).collect()}
    got = {i: [r.topic for r in sorted(spark.table("topics").where(f"id = '{i}'").collect(), key=lambda r: r.turn)] for i in ("a", "b")}
    assert got == want and want["a"] == ["work", "food", "school"]


def test_writers_and_manifests(spark, tmp_path):
    from talkmill.sources import sinks

    rows = spark.createDataFrame([("a", "x", "hi"), ("b", "x", None), ("c", "y", "yo")], "id string, category string, text string")
    assert sinks.write_jsonl(rows, str(tmp_path / "rows")) == 3
    manifest = str(tmp_path / "m" / "frozen.json")
    info = sinks.freeze(rows, "category", ("id", "text"), manifest)
    assert info["n"] == 3 and info["categories"] == {"x": 2, "y": 1}
    sinks.verify_frozen(rows.repartition(3).orderBy(F.desc("id")), manifest)
    for other in (rows.where("id <> 'c'"), rows.withColumn("text", F.coalesce("text", F.lit(""))), rows.unionByName(rows)):
        with pytest.raises(RuntimeError):
            sinks.verify_frozen(other, manifest)
    with pytest.raises(FileNotFoundError):
        sinks.verify_frozen(rows, manifest + ".gone")
    runs = spark.createDataFrame([("m1", 100, 0.25, None), ("m2", 400, 0.5, 1.5)], "model string, params long, clean double, loss double")
    text = sinks.scaling_report(runs, "params", ("clean", "loss"), str(tmp_path / "report.md"))
    assert "| m2 | 400 | 0.5000 | 1.5000 |" in text and "#" * 40 + " 0.5000" in text and (tmp_path / "report.md").read_text().startswith("| model")
    won = spark.createDataFrame([("t", "s", [("user", "q"), ("assistant", "old")], "new")], TALK + ", text string")
    assert sinks.write_selected(won, str(tmp_path / "won")) == 1
    assert [m.content for m in spark.read.json(str(tmp_path / "won")).head().messages] == ["q", "new"]


def test_readers_of_reports_and_long_files(spark, tmp_path):
    (tmp_path / "d" / "deep").mkdir(parents=True)
    (tmp_path / "d" / "dialogues_a.txt").write_text("hi __eou__ yo __eou__\n\n __eou__ a __eou__ b\n")
    (tmp_path / "d" / "deep" / "dialogues_b.txt").write_text("\n".join(f"q{i} __eou__ r{i}" for i in range(3000)))
    (tmp_path / "d" / "other.txt").write_text("x __eou__ y\n")
    read = readers.ADAPTERS["dailydialog"]
    got = {r.id: [(m.role, m.content) for m in r.messages] for r in read(spark, str(tmp_path / "d")).collect()}
    assert len(got) == 3002 and got["dd-dialogues_a-000002"] == [("user", "a"), ("assistant", "b")] and got["dd-dialogues_b-002999"] == [("user", "q2999"), ("assistant", "r2999")]
    assert read(spark, str(tmp_path / "d"), limit=5).count() == 5
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits of one file
    try:
        lines = readers.numbered_lines(spark, str(tmp_path / "d" / "deep" / "dialogues_b.txt"))
        assert lines.rdd.getNumPartitions() > 1
        assert [(r.line, r.value) for r in lines.orderBy("line").collect()] == [(i, f"q{i} __eou__ r{i}") for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "s.jsonl").write_text('{"id": "a", "scores": {"x": 1, "y": "no"}}\n\n{"id": "a", "scores": {"x": 2.5}}\n')
    assert [(r.id, r.scores) for r in readers.read_scores(spark, str(tmp_path / "s.jsonl")).collect()] == [("a", {"x": 2.5})]
    assert readers.read_scenarios(spark, str(tmp_path / "none.jsonl"), [("d", "c", ["hi"], None)]).count() == 1
    (tmp_path / "p.json").write_text('{"GREETING": [{"token": "hey", "lift": 2.5}], "BYE": []}')
    assert [tuple(r) for r in readers.read_prefix_map(spark, str(tmp_path / "p.json")).collect()] == [("GREETING", "hey", 2.5)]
    assert readers.read_prefix_map(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "summary.json").write_text('{"model": "m1",\n "clean": 0.5}')
    assert [r.model for r in readers.read_summaries(spark, str(tmp_path / "runs")).collect()] == ["m1"]
    (tmp_path / "runs" / "all_models.json").write_text('[{"model": "m1"}, {"model": "m2"}]')
    assert sorted(r.model for r in readers.read_summaries(spark, str(tmp_path / "runs")).collect()) == ["m1", "m2"]


def test_token_rows_and_stages(spark):
    from talkmill.operators import encoding

    talks = spark.createDataFrame([("a", None, [("user", " hi "), ("assistant", "yo")]), ("b", None, [("user", "x" * 50)]), ("c", None, None), ("d", None, [("tool", "z"), ("assistant", None)])], TALK).withColumn("weight", F.lit(2.0))
    e = {r.id: r.e for r in talks.where("messages is not null").select("id", encoding.encoded(F.col("messages")).alias("e")).collect()}
    ids = lambda t: [ord(c) + encoding.FIRST_ID for c in t]
    assert list(e["a"].ids) == [1, 3, *ids("hi"), 6, 4, *ids("yo"), 6, 2] and list(e["a"].mask) == [0] * 6 + [1, 1, 1, 1] and list(e["d"].ids) == [1, 4, 6, 2]
    rows = {r.id: r for r in encoding.dataset("sft", talks, 12, "be nice").collect()}
    assert len(rows["a"].input_ids) == 12 == len(rows["a"].loss_mask) and rows["a"].input_ids[0] == encoding.BOS and rows["a"].input_ids[-4:] == [*ids("yo"), 6, 2]
    assert "b" in rows  # the end mark of every talk counts as the assistant's
    for stage in ("clm", "distill"):
        if stage == "clm":
            blocks = encoding.dataset(stage, talks.where("messages is not null"), 12).collect()
            per = {}
            for r in blocks:
                per[r.block] = per.get(r.block, 0) + r.stop - r.start
            assert per and set(per.values()) == {13} and {r.copy for r in blocks} == {0, 1}
    with pytest.raises(ValueError):
        encoding.dataset("other", talks, 12)
    assert encoding.packed(encoding.training_rows(talks.where("id = 'd'"), 12, None), 500).count() == 0  # under one block


def test_gates(spark):
    from talkmill.operators import benches, harness

    assert benches.promotion({"directional": 0.5, "tier_1": 0.9}, {"directional": 0.2, "tier_1": 0.91}) == []
    assert len(benches.promotion({"directional": 0.25, "tier_1": 0.5}, {"directional": 0.2, "tier_1": 0.9})) == 3 and benches.promotion({}, {}) == ["no directional score"]
    assert benches.variety_gate(0.25) and not benches.variety_gate(0.26)
    per = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.995), ("c", 3, 0.1)], "intent string, tier int, pass_rate double")
    boosts = spark.createDataFrame([("a", 3.0), ("b", 1.1), ("gone", 2.0), ("c", 4.0)], "intent string, boost double")
    got = {r.intent: r.boost for r in benches.adapted_boosts(per, boosts).collect()}
    assert got == {"a": 4.0, "gone": 1.7, "c": 4.0}
    rows = spark.createDataFrame([("it was good. it was good. it was good", ["x"]), ("Yo?", ["yo? "]), ("yeah", ["yeah"]), ("<|len_short|> as an AI", [])], "t string, e array<string>").withColumn("w", metrics.words(F.col("t")))
    codes = [r.c for r in rows.select(harness.failures(F.col("t"), "w", F.lit("P06"), F.col("e"), F.lit(True)).alias("c")).collect()]
    assert codes == [["internal_loop"], ["exact_repeat", "question_when_forbidden", "question_while_closing", "question_after_farewell"], [], ["special_token_leak", "ai_boilerplate"]]
    probs = spark.createDataFrame([([0.9, 0.1],), ([0.5, 0.3, 0.2],), ([0.25] * 4,), ([],)], "p array<double>").select(harness.confidence(F.col("p"), 0.6, 0.2).alias("c")).collect()
    assert [r.c.status for r in probs] == ["HIGH", "MEDIUM", "LOW", "LOW"] and abs(probs[2].c.entropy - 1) < 1e-9
