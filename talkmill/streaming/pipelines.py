"""Structured Streaming forms: tumbling counts, sessions, duplicates, per-talk memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkmill.functions import lexicons as lex


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; rows later than the watermark are dropped by Spark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def without_repeats(rows: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key inside the watermark: the incremental form of the exact duplicate rule."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def talk_memory(turns: DataFrame) -> DataFrame:
    """Last value of each memory slot per talk, kept as state: (id, slot, value, confidence, turn) on every change."""
    import re

    patterns = [(k, re.compile(p)) for k, p in lex.MEMORY_SLOTS.items()] + [("job", re.compile(lex.JOB))]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        out = []
        for turn, text in sorted((t, c) for f in frames for t, c in zip(f["turn"], f["content"]) if c):
            for slot, pattern in patterns:
                m = pattern.search(text)
                value = m.group(1).strip().lower() if m else None
                if value and not (slot == "job" and value.split()[0] in lex.NOT_JOBS):
                    out.append((key[0], slot, value, 0.9 if known.get(slot) == value else 0.75, int(turn)))
                    known[slot] = value
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["id", "slot", "value", "confidence", "turn"])

    return turns.groupBy("id").applyInPandasWithState(
        update, "id string, slot string, value string, confidence double, turn int", "slots array<string>, slot_values array<string>", "append", GroupStateTimeout.NoTimeout
    )


def reply_state(replies: DataFrame, window: int = 8) -> DataFrame:
    """What a harness remembers of each talk's replies, kept as state: (id, turn, is_question, consecutive_questions, seen_recently).

    Replies (id, turn, content) come in order; the last ``window`` of them, trimmed and in lower case, tell whether one was
    said before. Only their hashes are kept, so the state of a talk is bounded.
    """
    import hashlib

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, run = state.get if state.exists else ([], 0)
        recent, out = list(recent), []
        for turn, text in sorted((t, c or "") for f in frames for t, c in zip(f["turn"], f["content"])):
            mark = hashlib.sha1(text.strip().lower().encode()).hexdigest()[:12]
            ask = text.strip().endswith("?")
            run = run + 1 if ask else 0
            out.append((key[0], int(turn), ask, run, mark in recent))
            recent = [*recent, mark][-window:]
        state.update((recent, run))
        yield pd.DataFrame(out, columns=["id", "turn", "is_question", "consecutive_questions", "seen_recently"])

    return replies.groupBy("id").applyInPandasWithState(
        update, "id string, turn int, is_question boolean, consecutive_questions int, seen_recently boolean", "recent array<string>, run int", "append", GroupStateTimeout.NoTimeout
    )


def topic_state(turns: DataFrame) -> DataFrame:
    """(id, turn, topic) on every change of a talk's topic, the last topic kept as state. Turns (id, turn, content) of users."""

    def topic_of(text: str) -> str | None:
        hits = {k: sum(w in text.lower() for w in words) for k, words in lex.TOPIC_KEYWORDS.items()}
        best = max(hits, key=hits.get)  # the first one on a tie
        return best if hits[best] else None

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,), out = state.get if state.exists else ("",), []
        for turn, text in sorted((t, c) for f in frames for t, c in zip(f["turn"], f["content"]) if c):
            now = topic_of(text)
            if now and now != last:
                out.append((key[0], int(turn), now))
                last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["id", "turn", "topic"])

    return turns.groupBy("id").applyInPandasWithState(update, "id string, turn int, topic string", "last string", "append", GroupStateTimeout.NoTimeout)
