"""Token rows of talks: ids with the assistant mask, truncation, padding, packing into blocks. The tokenizer is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Ids of the marks; the tokenizer's own ids lie above.
PAD, BOS, EOS, USER, ASSISTANT, SYSTEM, END = range(7)
FIRST_ID = 16
HEADS = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}


def code_points(text: Column) -> Column:
    """The simplest tokenizer: one id per character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) + FIRST_ID)


def with_system(messages: Column, prompt: str) -> Column:
    """The messages with a system prompt before them unless they have one."""
    has = F.exists(messages, lambda m: F.coalesce(m["role"] == "system", F.lit(False)))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return F.when(has, messages).otherwise(F.concat(first, messages))


def encoded(messages: Column, encode: Callable[[Column], Column] = code_points) -> Column:
    """(ids, mask) of a talk: BOS, then role mark, content and end mark of each message, then EOS.

    The mask is 1 on the assistant's content and end marks and on EOS, 0 elsewhere. Messages of unknown roles are left out.
    """
    role = lambda m: F.coalesce(*[F.when(m["role"] == k, F.lit(v)) for k, v in HEADS.items()])
    known = F.filter(messages, lambda m: F.coalesce(m["role"].isin(*HEADS), F.lit(False)))
    parts = F.transform(known, lambda m: F.struct(role(m).alias("head"), (m["role"] == "assistant").cast("int").alias("own"), encode(F.trim(F.coalesce(m["content"], F.lit("")))).alias("body")))
    ids = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p["head"]), p["body"], F.array(F.lit(END)))))
    mask = F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lit(0)), F.array_repeat(p["own"], F.size(p["body"]) + 1))))
    one = lambda x: F.array(F.lit(x))
    return F.struct(F.concat(one(BOS), ids, one(EOS)).alias("ids"), F.concat(one(0), mask, one(1)).alias("mask"))


def truncated(ids: str, mask: str, limit: int, left: bool = True) -> tuple[Column, Column]:
    """At most ``limit`` tokens: the last ones with BOS in front, or the first ones."""
    i, m, long = F.col(ids), F.col(mask), F.size(ids) > limit
    if not left:
        return F.slice(i, 1, limit), F.slice(m, 1, limit)
    cut = lambda x, first: F.when(long, F.concat(F.array(F.lit(first)), F.slice(x, F.size(x) - limit + 2, F.lit(limit - 1)))).otherwise(x)
    return cut(i, BOS), cut(m, 0)


def training_rows(talks: DataFrame, limit: int, system: str | None, encode: Callable[[Column], Column] = code_points) -> DataFrame:
    """(id, ids, mask, weight) of talks (id, messages, weight), truncated from the left; those without assistant tokens drop out."""
    messages = F.col("messages") if system is None else with_system(F.col("messages"), system)
    rows = talks.where("messages is not null").select("id", "weight", encoded(messages, encode).alias("e")).select("id", "weight", "e.*")
    i, m = truncated("ids", "mask", limit)
    return rows.select("id", i.alias("ids"), m.alias("mask"), "weight").where(F.array_contains("mask", 1))


def padded_rows(rows: DataFrame, length: int, mask_others: bool = True) -> DataFrame:
    """(id, input_ids, loss_mask, weight): rows filled up to one length; the loss is on the assistant's tokens or on all."""
    fill = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), length - F.size(x)))
    own = F.col("mask") if mask_others else F.array_repeat(F.lit(1), F.size("ids"))
    return rows.select("id", fill(F.col("ids"), PAD).alias("input_ids"), fill(own, 0).alias("loss_mask"), "weight")


def dataset(stage: str, talks: DataFrame, length: int, system: str | None = None, encode: Callable[[Column], Column] = code_points) -> DataFrame:
    """Rows of a training stage: ``clm`` segments of blocks, ``sft`` padded rows, ``distill`` padded rows of the chosen candidates."""
    from talkmill.operators.conversations import apply_chosen

    if stage == "distill":
        talks = apply_chosen(talks)
    elif stage not in ("clm", "sft"):
        raise ValueError(f"unknown stage {stage!r} (expected clm, sft or distill)")
    rows = training_rows(talks, length, system, encode)
    return packed(rows, length) if stage == "clm" else padded_rows(rows, length)


def packed(rows: DataFrame, length: int) -> DataFrame:
    """(block, segment_id, start, stop): blocks of ``length`` + 1 tokens cut from all rows end to end in the order of their ids' hashes.

    Rows of weight above 1.5 stand twice; what does not fill a block at the end is dropped. A corpus under one block is an error
    for the caller to raise, as the result is then empty.
    """
    from talkmill.operators.packing import blocks, token_offsets

    place = F.conv(F.substring(F.sha2("id", 256), 1, 12), 16, 10).cast("bigint")
    each = rows.select("id", place.alias("place"), F.size("ids").cast("bigint").alias("tokens"), F.explode(F.when(F.col("weight") > 1.5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    laid = token_offsets(each.withColumn("place", F.col("place") * 2 + F.col("copy")), "place", "tokens")
    whole = laid.agg(F.floor(F.sum("tokens") / (length + 1)).alias("n_blocks"))
    cut = blocks(laid, length + 1).crossJoin(F.broadcast(whole)).where(F.col("block") < F.col("n_blocks"))  # one row
    return cut.select("block", "id", "copy", "start", "stop")


def rendered(messages: Column) -> Column:
    """A talk in its chat template, for reading."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("user")), F.lit("|>"), F.trim(F.coalesce(m["content"], F.lit(""))), F.lit("<|endofturn|>"))), "")
