"""Problem 7: mixing sources to target shares of tokens.

The total is the largest at which every source that has documents reaches its share (shares
are scaled to those sources) without repeating any document more than ``max_repeats`` times.
Each source then needs its documents ``rate`` times: all of them floor(rate) times, and a
balanced sample once more. The sample is drawn by the cube method: inclusion probabilities
move through the null space of the balance constraints (number of documents, tokens) until all
but a few per group are 0 or 1. The flight runs in blocks of about ``BLOCK`` documents of one
source, then over what the blocks leave, level by level, so that a source with a third of all
documents is many tasks; at most two documents per source reach the landing, which takes
the rounding nearest to the source's token target.

Defined results: documents of no targeted source (a null source among them) and documents
without tokens are not chosen; a source without documents has actual share 0; null shares
and repeats count as 0; equal ids are separate documents; extra columns are not read;
empty tables give no chosen rows.
"""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.tokens import document_tokens
from talkmill.plans.lineage import cut
from talkmill.sources.tables import table

BLOCK = 2_000
LANDING = 12
POOL = 64
MOST_SOURCES = 10_000
STATE = "row_no bigint, doc_id bigint, source string, tokens bigint, base int, chance double, block bigint"


def rates(sums: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """Source -> how often its tokens are needed for the largest feasible total."""
    live = [(s, share, most) for s, share, most in targets if share > 0 and most > 0 and sums.get(s, 0) > 0]
    whole = sum(share for _, share, _ in live)
    if not live:
        return {}
    total = min(most * sums[s] * whole / share for s, share, most in live)
    return {s: min(float(most), share / whole * total / sums[s]) for s, share, most in live}


def moved(x: np.ndarray, u: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Chances one random step along direction ``u``, as far as one of them reaches 0 or 1; the expectation stays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
        down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
    step = up if draw.random() * (up + down) < down else -down
    x = np.clip(x + step * u, 0, 1)
    return np.where(x < 1e-9, 0.0, np.where(x > 1 - 1e-9, 1.0, x))


def in_threes(p: np.ndarray, t: np.ndarray, inside: list[int], draw: np.random.Generator, keep: int) -> None:
    """Move three documents of ``inside`` (largest first) at a time, the two largest left and the smallest, until ``keep`` are left."""
    left = collections.deque(i for i in inside if 0 < p[i] < 1)
    top = [left.popleft() for _ in range(min(2, len(left)))]
    low = [left.pop()] if left else []
    while len(top) + len(low) + len(left) > keep:
        hold = top + low
        if len(hold) == 3:
            a, b, c = (t[i] for i in hold)
            u = np.array([c - b, a - c, b - a])
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
        elif len(hold) == 2 and t[hold[0]] == t[hold[1]]:
            u = np.array([1.0, -1.0])
        else:
            break
        p[hold] = moved(p[hold], u, draw)
        top, low = ([i for i in some if 0 < p[i] < 1] for some in (top, low))
        while len(top) < 2 and left:
            top.append(left.popleft())
        if not low and left:
            low.append(left.pop())


def flight(chance: np.ndarray, tokens: np.ndarray, draw: np.random.Generator, keep: int = 2) -> np.ndarray:
    """Move chances along the null space of (documents, tokens) until at most ``keep`` (two or more) lie inside (0, 1).

    Documents far above the middling size move first, among themselves while they can, then each balanced by
    ``POOL`` others together, so that they move far and are decided; where the others can't balance both
    totals, they balance the tokens. Those left over at last are of middling size, which a landing can balance.
    """
    p = chance.astype(float).copy()
    t = tokens.astype(float)
    inside = [i for i in np.argsort(-t, kind="stable") if 1e-9 < p[i] < 1 - 1e-9]
    middle = np.median(t[inside]) if inside else 0.0
    large = [i for i in inside if t[i] > 4 * middle]
    in_threes(p, t, large, draw, 2)
    for big in large:
        while 0 < p[big] < 1:
            others = np.array([i for i in inside if 0 < p[i] < 1 and t[i] < t[big]])
            if len(others) < 3:
                break
            pool = draw.permutation(others)[:POOL]
            side = np.stack([t[pool], np.ones(len(pool))])
            if 2 * len(others) < len(inside) or np.linalg.matrix_rank(side) < 2:
                side = side[:1]  # too few are left to hold both totals: tokens count
            hold = np.concatenate([[big], pool])
            p[hold] = moved(p[hold], np.concatenate([[1.0], np.linalg.lstsq(side, -np.array([t[big], 1.0])[: len(side)], rcond=None)[0]]), draw)
    in_threes(p, t, inside, draw, keep)
    return p


def fly(frame: pd.DataFrame) -> pd.DataFrame:
    """One group's flight; the seed depends on the group alone."""
    frame = frame.sort_values(["tokens", "row_no"])
    seed = zlib.crc32(f"{frame['source'].iat[0]}|{frame['block'].iat[0]}|{len(frame)}".encode())
    return frame.assign(chance=flight(frame["chance"].to_numpy(), frame["tokens"].to_numpy(), np.random.default_rng(seed), LANDING))


def land(frame: pd.DataFrame) -> pd.DataFrame:
    """The last flight of a source and its landing: whole decisions with its tokens nearest to their expectation.

    Of all roundings of the at most ``LANDING`` chances left, the one nearest in tokens is taken (to a thousandth of
    the mean length), and of those the one nearest in documents. If a large document stayed open, because the others
    are too few to balance it, single decisions are turned round as long as that brings the tokens nearer.
    """
    aim, texts = (frame["chance"] * frame["tokens"]).sum(), frame["chance"].sum()
    frame = fly(frame)
    p, t = frame["chance"].to_numpy().copy(), frame["tokens"].to_numpy()
    inside = np.flatnonzero((p > 0) & (p < 1))
    decided = p * t
    picks = (np.arange(1 << len(inside))[:, None] >> np.arange(len(inside))) & 1
    tokens_off = np.abs(picks @ t[inside] - (aim - decided.sum() + decided[inside].sum()))
    texts_off = np.abs(picks.sum(1) - (texts - p.sum() + p[inside].sum()))
    near = np.floor(tokens_off / max(1.0, t.mean() / 1000))
    p[inside] = picks[np.lexsort((tokens_off, texts_off, near))[0]]
    off = (p * t).sum() - aim
    for _ in range(len(p)):
        turned = off + (1 - 2 * p) * t
        best = int(np.abs(turned).argmin())
        if abs(turned[best]) >= abs(off):
            break
        off, p[best] = turned[best], 1 - p[best]
    return frame.assign(chance=p)


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the chosen documents."""
    targets = [
        (r.source, float(r.target_share or 0), int(r.max_repeats or 0))
        for r in table(spark, folder, "mix_targets").where("source is not null").limit(MOST_SOURCES + 1).collect()
    ]
    if len(targets) > MOST_SOURCES:
        raise ValueError(f"mix_targets is a fixed table of at most {MOST_SOURCES} sources")
    sizes = document_tokens(spark, folder).where("tokens > 0 and source is not null")
    wanted = sizes.where(F.col("source").isin([s for s, _, _ in targets])) if targets else sizes.limit(0)
    facts = {r["source"]: (r["tokens"], r["n"]) for r in wanted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    rate = rates({s: v[0] for s, v in facts.items()}, targets)
    parts = [(s, int(math.floor(r + 1e-12)), max(0.0, r - math.floor(r + 1e-12)), max(1, facts[s][1] // BLOCK)) for s, r in rate.items()]
    plan = spark.createDataFrame(parts or [("", 0, 0.0, 1)], "source string, base int, chance double, blocks bigint")
    rows = wanted.join(F.broadcast(plan), "source").withColumn("block", F.pmod(F.xxhash64("row_no"), F.col("blocks")))
    left = rows.select("row_no", "doc_id", "source", "tokens", "base", "chance", "block")
    decided = left.where("chance <= 0")
    left = left.where("chance > 0")
    blocks = max([b for *_, b in parts], default=1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # As many tasks as there are blocks, not as few as their few bytes suggest: the flight is all computing.
        spread = left.repartition(max(1, min(tasks, blocks * len(parts))), "source", "block").groupBy("source", "block")
        if blocks == 1:
            decided = decided.unionByName(spread.applyInPandas(land, STATE))
            break
        state = cut(spread.applyInPandas(fly, STATE))
        decided = decided.unionByName(state.where("chance <= 0 or chance >= 1"))
        left = state.where("chance > 0 and chance < 1")
        blocks = -(-blocks // (BLOCK // LANDING))
        left = left.withColumn("block", F.floor(F.col("block") / (BLOCK // LANDING)).cast("bigint"))
    return (
        decided.select("doc_id", "source", "tokens", (F.col("base") + F.when(F.col("chance") >= 1, 1).otherwise(0)).cast("int").alias("repeats"))
        .where("repeats > 0")
    )


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, repeats): the chosen documents and how often each is used."""
    return mixed(spark, folder).select("doc_id", "source", "repeats")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target_share, actual_share, n_documents, tokens, most_repeats, max_repeats) per targeted source."""
    per = mixed(spark, folder).groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    total = per.agg(F.sum("tokens").alias("total"))
    goal = table(spark, folder, "mix_targets").select("source", "target_share", "max_repeats")
    return goal.join(per, "source", "left").crossJoin(F.broadcast(total)).select(  # one row of totals
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )
