"""Every core query on dirty tables (nulls anywhere, blank and very long texts, ties, repeats, extra columns) against its SQL, and on empty ones."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from talkmill import catalog

MSG = "array<struct<role:string,content:string>>"
CAND = "array<struct<content:string,scores:map<string,double>,score:double,source:string>>"
SCHEMAS = {
    "message_rows": "msg_id bigint, conv_id string, user_id string, turn int, role string, content string, source string, sent_at timestamp_ntz, ingested_at timestamp_ntz, tbl string",
    "example_transcript_format": "id string, conversation string, turns string",
    "example_conversations": f"id string, source string, messages {MSG}, meta map<string,string>, candidates {CAND}, chosen int, n string",
    "example_teacher_candidates": f"id string, source string, teacher string, messages {MSG}, candidates {CAND}, place string",
    "candidate_lines": "rec_id string, line string, source_file string, loaded_at timestamp_ntz, v string",
    "latent_specs": "id string, family string, split string, skill string, setting string, topic string, sarcasm boolean, target_turns int, source string, fam string",
    "intents": "name string, length string, targets array<string>, train array<string>, held_out array<string>, accept array<string>, tier int, intent string",
    "elaboration_frozen": "item_id bigint, sid string, known string, unknown string, relevant array<string>, forbidden array<string>, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, family string, added_at timestamp_ntz, part string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "pack_limits": "profile string, capacity_tokens int",
    "common_words": "lang string, word string, rank_no int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string, k string",
    "embeddings": "vec_id bigint, embedding array<float>, label int, l string",
    "region": "r_regionkey bigint, r_name string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint",
    "customer": "c_custkey bigint, c_name string, c_nationkey bigint, c_mktsegment string, c_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_shipmode string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size bigint, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double",
}
#: Queries whose tables are the relational ones; they have tests of their own on clean data.
RELATIONAL = {name for name in catalog.queries() if name in __import__("talkmill.queries.relational", fromlist=["QUERIES"]).QUERIES}
SAID = ["hey", "Hey!", "", " ", None, "how's that going?", "that's great", "i got a new dog", "what's the dog called?", "as an AI i cannot say", "my name is Ida and i live in Oslo", "see you later", "thanks",
        "yeah", "yeah", "No way, 40 days is long", "<|len_short|> hm", "one two three one two three one two three", "¿qué tal? ñandú 😀", "SHOUTING NOW", "i just love rain. i hate snow", "word " * 400, "?"]
ROLES = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", None]


def dirty(seed: int) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    at = lambda: None if r.random() < 0.1 else dt.datetime(2030, 1, 1) + dt.timedelta(hours=r.randint(0, 90))
    messages = lambda n: [(ROLES[i % 2] if r.random() < 0.8 else r.choice(ROLES), r.choice(SAID)) for i in range(n)]
    cand = lambda: (r.choice(SAID), r.choice([None, {"naturalness": 2.0}, {"relevance": 4.5, "brevity": None}]), r.choice([None, 1.0, 3.5]), None)
    words = "rain soup train paint lamp the a of and it is was tree boat".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    some = lambda xs: r.choice([None, *xs])
    docs = [(k, r.choice([None, "", " ", text(9), text(40), text(9) + "\n\n" + text(5)]), some(["en", "EN", "fr"]), some(["s1", "s2"]), None, some(["f1", "f2", ""]), at(), "x") for k in range(60)]
    return {
        "example_conversations": [(f"c{k}", some(["s1", "s2"]), r.choice([None, [], messages(r.randint(1, 9)), messages(6), messages(4)]), r.choice([None, {}, {"topic": "rain"}]), None, None, "x") for k in range(60)],
        "example_teacher_candidates": [(f"t{k}", some(["s1"]), some(["w"]), messages(r.choice([1, 3, 5])), [cand() for _ in range(r.randint(1, 5))], "x") for k in range(40)],
        "example_transcript_format": [(f"x{k}", r.choice([None, "", "User: hi\nBot: yo", "note\nA: x\nmore\n\nB: y"]), "x") for k in range(20)],
        "candidate_lines": [(f"l{k}", r.choice([None, "", "[1]", '{"content": "a", "score": 1.5}', '{"content": "a", "sc', '{"score": 2}', "plain"]), some(["f"]), at(), "x") for k in range(40)],
        "latent_specs": [(f"q{k}", some(["g1", "g2", "g3"]), some(["train", "test"]), some(["casual", "epistemic", "memory_state"]), some(["home"]), None, r.choice([None, True, False]), some([3, 9]), some(["p"]), "x") for k in range(60)],
        "intents": [("hello", "short", ["Hey there!"], ["hey you", None, "yo so"], ["hi there?", "Hi, there", None, "yo."], ["hey there"], 1, "x"), ("bye", "vshort", ["see you"], ["off now", "night"], ["bye now!"], None, 2, "x"), ("none", None, None, None, None, None, 3, "x")],
        "elaboration_frozen": [(1, "a", text(12), None, None, None, "x"), (2, "b", None, text(12), None, None, "x"), (3, "c", None, None, None, None, "x")],
        "documents": docs + [(900, docs[3][1], "en", None, None, None, None, "x"), (901, "word " * 30_000, "fr", "s1", None, "f1", None, "x")],
        "mix_targets": [("s1", 0.5, 2), ("gone", 0.5, 1)], "pack_limits": [("small", 8), ("big", 64), ("none", None)],
        "common_words": [("en", "the", 1)],
        "embeddings": [(k, [r.uniform(-1, 1) for _ in range(6)], k % 3, "x") for k in range(20)],
        "message_rows": [(k, some([f"m{k % 7}"]), some(["u"]), some([k % 5]), r.choice([*ROLES, "User "]), r.choice(SAID), None, at(), at(), "x") for k in range(80)],
        "events": [(k, at() or dt.datetime(2030, 1, 1), r.choice([1, 1, 1, 2, 3]), r.choice(["a", "b", "c"]), None, None, "x") for k in range(120)],
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind, tables in (("dirty", dirty(3)), ("empty", {})):
        path = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(tables.get(name, []), schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
        made[kind] = str(path)
    return made


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, np.generic):
        return plain(v.item())
    return round(v, 5) if isinstance(v, float) else v


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def database(folder):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - RELATIONAL | {"type_runs"}))
def test_dirty_tables(spark, folders, name):
    got = catalog.queries()[name](spark, folders["dirty"]).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = database(folders["dirty"]).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - RELATIONAL))
def test_empty_tables(spark, folders, name):
    """No rows, or a row or two of totals; made examples don't need tables."""
    n = catalog.queries()[name](spark, folders["empty"]).count()
    assert n <= 2 or name in {"frame_examples", "state_pairs", "planned_specs", "offline_talks", "combined_talks"}
