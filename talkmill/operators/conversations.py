"""The nested conversation record and its two layouts (one row per talk, one per turn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SCHEMA = (
    "id string, source string, messages array<struct<role:string,content:string>>, meta map<string,string>, "
    "candidates array<struct<content:string,scores:map<string,double>,score:double,source:string>>, chosen int"
)


def spoken() -> Column:
    """Messages other than the system's, texts never null."""
    return F.expr("transform(filter(messages, m -> coalesce(m.role, '') <> 'system'), m -> named_struct('role', m.role, 'content', coalesce(m.content, '')))")


def num_turns() -> Column:
    return F.coalesce(F.size(F.expr("filter(messages, m -> coalesce(m.role, '') <> 'system')")), F.lit(0))


def body(messages: str = "messages") -> Column:
    """``role: content`` of all messages, one per line."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def alternates(turns: str) -> Column:
    """No two neighbouring turns of an array have the same role."""
    return F.expr(f"forall(sequence(1, greatest(size({turns}) - 1, 1)), i -> get({turns}, i) is null or not (get({turns}, i).role <=> get({turns}, i - 1).role))")


def turns(conversations: DataFrame) -> DataFrame:
    """(id, source, turn, role, content): one row per message."""
    return conversations.select("id", "source", F.posexplode("messages").alias("turn", "m")).select(
        "id", "source", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def nested(rows: DataFrame) -> DataFrame:
    """One row per id with the messages in turn order."""
    return rows.groupBy("id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
        ).alias("messages")
    )


def merge_consecutive(rows: DataFrame) -> DataFrame:
    """Runs of one role become one turn; system turns never merge and end a run.

    The separator depends on the text before alone: a space after ``. ! ? ,``, else ``. ``.
    """
    w = Window.partitionBy("id").orderBy("turn")
    before = F.lag("role").over(w)
    fresh = F.coalesce((F.col("role") != before) | (F.col("role") == "system"), F.lit(True))
    sep = F.when(fresh, F.lit("")).when(F.lag("content").over(w).rlike(r"[.!?,]$"), F.lit(" ")).otherwise(F.lit(". "))
    marked = rows.withColumn("__sep", sep).withColumn("__island", F.sum(fresh.cast("int")).over(w))
    pieces = F.array_sort(F.collect_list(F.struct("turn", F.concat("__sep", F.coalesce("content", F.lit(""))).alias("t"))))
    return marked.groupBy("id", "__island").agg(
        F.min("turn").cast("bigint").alias("turn"), F.first("role").alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("content"), F.count(F.lit(1)).alias("n_merged"),
    ).drop("__island")


def merge_runs(messages: Column) -> Column:
    """``merge_consecutive`` inside an array of messages."""
    return F.aggregate(
        messages,
        F.array().cast("array<struct<role:string,content:string>>"),
        lambda out, m: _appended(out, m, F.get(out, F.size(out) - 1)),
    )


def _appended(out: Column, m: Column, last: Column) -> Column:
    same = (F.size(out) > 0) & last["role"].eqNullSafe(m["role"]) & (F.coalesce(m["role"], F.lit("")) != "system")
    sep = F.when(last["content"].rlike(r"[.!?,]\z"), F.lit(" ")).otherwise(F.lit(". "))
    merged = F.struct(m["role"].alias("role"), F.concat(last["content"], sep, m["content"]).alias("content"))
    return F.when(same, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(F.struct(m["role"].alias("role"), m["content"].alias("content")))))


def truncate(limit: int = 6) -> Column:
    """The first messages, never ending on the user's."""
    return F.expr(
        f"if(element_at(slice(messages, 1, {limit}), -1).role = 'user', slice(messages, 1, least(size(messages), {limit}) - 1), slice(messages, 1, {limit}))"
    )


def apply_chosen(conversations: DataFrame) -> DataFrame:
    """Replace the last assistant turn by the chosen candidate; talks without candidates pass through.

    Without ``chosen`` the best scored candidate wins, the last one on a tie; a chosen place
    beyond the list or a blank winner drops the talk.
    """
    best = F.expr("array_max(transform(candidates, (c, i) -> named_struct('s', coalesce(c.score, -1e9D), 'i', i))).i")
    some = F.coalesce(F.size("candidates") > 0, F.lit(False))
    place = F.coalesce("chosen", best)
    win = F.trim(F.expr("get(candidates, __place).content"))
    head = F.expr("if(element_at(messages, -1).role = 'assistant', slice(messages, 1, size(messages) - 1), messages)")
    added = F.expr("concat(__head, array(named_struct('role', 'assistant', 'content', __win)))")
    staged = conversations.withColumn("__some", some).withColumn("__place", F.when(some, place)).withColumn("__win", win).withColumn("__head", head)
    return (
        staged.where("not __some or (__win is not null and __win <> '')")
        .withColumn("messages", F.when(F.col("__some"), added).otherwise(F.col("messages")))
        .drop("__some", "__place", "__win", "__head")
    )
