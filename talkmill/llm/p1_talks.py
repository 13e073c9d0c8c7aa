"""Problem 1: rebuilding talks from message rows and labelled transcripts.

Sessionizing by channel: the channel of a message row is its ``conv_id``, which
TESTDATA.md makes the talk, so no gap may split it; ``p1_sessions`` splits the
channels without such a key (a user's messages) at a calibrated inactivity gap.
Roles are inferred from the alias list; talks without reciprocal replies drop out.

Defined results
- Deliveries of one message (equal conv_id and turn, or equal sent_at where turn is
  null) count once: the one ingested last, a null ``ingested_at`` counting as earliest,
  ties going to the larger ``msg_id``. Rows with neither turn nor sent_at stay apart.
- Rows with a null conv_id belong to no talk of ``p1_found``; null ids of transcripts too.
- The conversation null or blank: ``empty``. Null content: no visible text.
- Order is (turn, sent_at, msg_id), nulls first. Empty tables give no rows.
All per-talk facts are associative aggregates (counts, extremes, min_by/max_by), so a
talk holding a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkmill.functions.text import LINE_END, VISIBLE, visible
from talkmill.plans.sessions import calibrated_gap, gap_histogram, gap_sessions
from talkmill.plans.skew import bucketed_rank
from talkmill.sources.tables import table

# Role spellings (case and spaces aside) and transcript labels.
USER_NAMES = ("user", "human", "a", "speaker1", "me", "you")
ASSISTANT_NAMES = ("assistant", "ai", "bot", "b", "speaker2", "them")
SYSTEM_NAMES = ("system",)
LABEL = r"(?i)^\s*(user|assistant|human|ai|a|b|speaker\s*1|speaker\s*2|me|them|you|bot|system)\s*[:>-]\s*"


def role_of(spelling: Column) -> Column:
    """user, assistant, system, or null for a missing or unknown role."""
    name = F.lower(F.regexp_replace(spelling, r"(?U)\s+", ""))
    return (
        F.when(name.isin(*USER_NAMES), F.lit("user"))
        .when(name.isin(*ASSISTANT_NAMES), F.lit("assistant"))
        .when(name.isin(*SYSTEM_NAMES), F.lit("system"))
    )


def delivered(messages: DataFrame, *extra: str) -> DataFrame:
    """One row per message (conv_id, turn, sent_at, msg_id, role, visible, *extra)."""
    at = F.when(F.col("turn").isNull(), F.col("sent_at"))
    lone = F.when(F.col("turn").isNull() & F.col("sent_at").isNull(), F.col("msg_id"))
    kept = F.struct(
        F.col("sent_at"),
        F.col("msg_id"),
        role_of(F.col("role")).alias("role"),
        visible(F.col("content")).alias("visible"),
        *extra,
    )
    one = (
        messages.where("conv_id is not null")
        .groupBy("conv_id", "turn", at.alias("__at"), lone.alias("__lone"))
        .agg(F.max_by(kept, F.struct("ingested_at", "msg_id")).alias("m"))
    )
    return one.select("conv_id", "turn", "m.*")


def reason_of(facts: DataFrame, ident: str) -> DataFrame:
    """(ident, reason): the first reason that applies, from the facts of a talk."""
    reason = (
        F.when(~F.col("any_text"), F.lit("empty"))
        .when(F.col("gap") | F.col("part_numbered") | F.col("bad_role") | F.coalesce(F.col("first_role") == "assistant", F.lit(False)), F.lit("broken"))
        .when(F.col("blank_reply") | ~F.col("any_reply") | F.coalesce(F.col("last_role") == "user", F.lit(False)), F.lit("no_reply"))
    )
    return facts.select(F.col(ident).alias("conv_id"), reason.alias("reason"))


def message_facts(one: DataFrame) -> DataFrame:
    """Facts of each talk from its delivered messages."""
    order = F.struct("turn", "sent_at", "msg_id")
    spoken = F.coalesce(F.col("role") != "system", F.lit(True))
    numbered = F.count("turn")
    return (
        one.groupBy("conv_id")
        .agg(
            F.max(spoken & F.col("visible")).alias("any_text"),
            F.coalesce(F.max("turn").cast("bigint") - F.min("turn") + 1 > numbered, F.lit(False)).alias("gap"),
            ((numbered > 0) & (numbered < F.count(F.lit(1)))).alias("part_numbered"),
            F.max(F.col("role").isNull()).alias("bad_role"),
            F.min_by(F.when(spoken, F.coalesce("role", F.lit("?"))), F.when(spoken, order)).alias("first_role"),
            F.max((F.coalesce(F.col("role") == "assistant", F.lit(False))) & ~F.col("visible")).alias("blank_reply"),
            F.max(F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("any_reply"),
            F.max_by(F.when(F.col("visible"), F.coalesce("role", F.lit("?"))), F.when(F.col("visible"), order)).alias("last_role"),
        )
    )


def transcript_lines(transcripts: DataFrame) -> DataFrame:
    """Adds ``lines``: array of (role, text) per line; role null without a label."""
    lines = F.split(F.coalesce("conversation", F.lit("")), LINE_END)
    labelled = F.transform(
        lines,
        lambda x: F.struct(
            F.when(x.rlike(LABEL), role_of(F.regexp_extract(x, LABEL, 1))).alias("role"),
            F.regexp_replace(x, LABEL, "").alias("text"),
        ),
    )
    return transcripts.withColumn("lines", labelled)


def transcript_facts(transcripts: DataFrame) -> DataFrame:
    """Facts of each transcript by one fold over its lines; no shuffle."""
    lines = transcript_lines(transcripts.where("id is not null").select("id", "conversation"))
    seen = F.transform("lines", lambda x: F.struct(x["role"].alias("role"), visible(x["text"]).alias("vis")))
    lines = lines.select("id", seen.alias("lines"))
    fold = """aggregate(lines,
      named_struct('role', cast(null as string), 'open', false, 'labels', 0, 'raw', false, 'any_text', false,
                   'first_role', cast(null as string), 'blank', false, 'reply', false, 'last_role', cast(null as string)),
      (s, x) -> named_struct(
        'role', coalesce(x.role, s.role),
        'open', if(x.role is null, s.open and not x.vis, not x.vis),
        'labels', s.labels + if(x.role is null, 0, 1),
        'raw', s.raw or x.vis,
        'any_text', s.any_text or (x.vis and coalesce(coalesce(x.role, s.role) <> 'system', false)),
        'first_role', coalesce(s.first_role, if(x.role <> 'system', x.role, null)),
        'blank', s.blank or (x.role is not null and s.open and coalesce(s.role = 'assistant', false)),
        'reply', s.reply or coalesce(x.role = 'assistant', false),
        'last_role', if(x.vis and coalesce(x.role, s.role) is not null, coalesce(x.role, s.role), s.last_role)))"""
    s = lines.select("id", F.expr(fold).alias("s"))
    unlabelled = F.col("s.labels") == 0
    return s.select(
        "id",
        F.when(unlabelled, F.col("s.raw")).otherwise(F.col("s.any_text")).alias("any_text"),
        F.lit(False).alias("gap"),
        F.lit(False).alias("part_numbered"),
        unlabelled.alias("bad_role"),
        F.col("s.first_role").alias("first_role"),
        (F.col("s.blank") | (F.col("s.open") & F.coalesce(F.col("s.role") == "assistant", F.lit(False)))).alias("blank_reply"),
        F.col("s.reply").alias("any_reply"),
        F.col("s.last_role").alias("last_role"),
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, reason) of every talk of both tables; reason null for talks that are kept."""
    rows = reason_of(message_facts(delivered(table(spark, folder, "message_rows"))), "conv_id")
    texts = reason_of(transcript_facts(table(spark, folder, "example_transcript_format")), "id")
    return rows.unionByName(texts)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, reason): each talk to be dropped."""
    return verdicts(spark, folder).where("reason is not null")


def p1_talks(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, pos, role, content): the messages of every kept talk in order.

    The place in a numbered talk is turn minus its first turn, since kept talks have no
    gaps; that of a talk without numbers is its rank by time, found over time buckets so
    that a hot talk is not sorted by one task. Transcripts give their turns likewise.
    """
    one = delivered(table(spark, folder, "message_rows"), "content")
    kept = reason_of(message_facts(one), "conv_id").where("reason is null").select("conv_id")
    first = one.groupBy("conv_id").agg(F.min("turn").alias("__first"))
    live = one.join(kept, "conv_id", "left_semi")
    numbered = live.where("turn is not null").join(first, "conv_id")
    timed = bucketed_rank(
        live.where("turn is null"), ["conv_id"], [F.col("sent_at"), F.col("msg_id")], F.date_trunc("day", "sent_at"), "pos"
    )
    texts = table(spark, folder, "example_transcript_format")
    good = reason_of(transcript_facts(texts), "id").where("reason is null").select(F.col("conv_id").alias("id"))
    turns = (
        transcript_lines(texts.select("id", "conversation"))
        .withColumn("starts", F.expr(STARTS))
        .select("id", F.expr(TURNS).alias("turns"))
    )
    spoken = turns.join(good, "id", "left_semi").select(F.col("id").alias("conv_id"), F.posexplode("turns").alias("pos", "t"))
    return (
        numbered.select("conv_id", (F.col("turn") - F.col("__first")).cast("bigint").alias("pos"), "role", "content")
        .unionByName(timed.select("conv_id", "pos", "role", "content"))
        .unionByName(spoken.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "t.role", F.trim("t.content").alias("content")))
    )


#: Turns of a transcript: a label opens one, lines without a label continue it.
STARTS = "filter(sequence(0, size(lines) - 1), i -> lines[i].role is not null)"
TURNS = """transform(starts, (st, k) -> named_struct('role', lines[st].role, 'content', array_join(
  transform(slice(lines, st + 1, coalesce(get(starts, k + 1), size(lines)) - st), x -> trim(x.text)), ' ')))"""


def p1_sessions(spark: SparkSession, folder: str, share: float = 0.999) -> DataFrame:
    """Sessions of each user's messages across talks, split at a calibrated gap.

    The limit is the gap that ``share`` of the gaps inside known talks stay within.
    ``reciprocal`` tells whether user and assistant both speak with visible text and
    the user isn't left without a last reply; sessions that fail it are the ones to drop.
    A message delivered again counts once, as ``delivered`` keeps it; rows without conv_id
    can't be told to be repeats and each count. Rows without user_id or sent_at are in no session.
    """
    messages = table(spark, folder, "message_rows")
    columns = ("msg_id", "user_id", "conv_id", "sent_at", "role", "visible")
    loose = messages.where("conv_id is null").withColumn("role", role_of(F.col("role"))).withColumn("visible", visible(F.col("content")))
    rows = delivered(messages, "user_id").select(*columns).unionByName(loose.select(*columns))
    limit = calibrated_gap(gap_histogram(rows, "conv_id", F.col("sent_at")), share)
    numbered = gap_sessions(rows, "user_id", "sent_at", "msg_id", limit)
    said = F.when(F.col("visible"), F.col("role"))
    order = F.struct("sent_at", "msg_id")
    return numbered.groupBy("user_id", "session_no").agg(
        F.min("sent_at").alias("first_at"),
        F.max("sent_at").alias("last_at"),
        F.count(F.lit(1)).alias("n_messages"),
        (
            F.coalesce(F.max(said == "user"), F.lit(False))
            & F.coalesce(F.max(said == "assistant"), F.lit(False))
            & F.coalesce(F.max_by(said, F.when(said.isNotNull(), order)) == "assistant", F.lit(False))
        ).alias("reciprocal"),
    )
