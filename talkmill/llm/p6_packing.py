"""Problem 6: filling containers of fixed capacity with documents, measured in tokens.

Minimum bin slack: for each container the largest remaining length is set, a bitset
subset-sum over the remaining lengths finds the fullest combination that still fits, and
the combination is removed. Lengths are all that matters, so the search runs on the
histogram of lengths, which has at most ``capacity`` rows whatever the number of documents,
and a combination is removed as often as its lengths last: the number of searches is
bounded by the number of lengths, not of documents. Documents then take their places by
rank within their length, ranks being found over hash buckets so that a length that a third
of all documents have stays split.

Defined results: a document longer than the capacity fills whole containers alone and its
rest is an item; no other document is split. A null or empty text has no tokens: one row
with no container. Equal ids are told apart; a profile with a null or non-positive capacity
takes nothing; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.tokens import document_tokens
from talkmill.plans.skew import bucketed_rank
from talkmill.sources.tables import table

MOST_PROFILES = 64


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """Length -> times of the fullest combination within ``room``: subset sums as bits of an integer."""
    reach, steps, goal = 1, [], 1 << room
    full = (1 << room + 1) - 1
    for length in order:
        if length > room:
            continue
        left = min(counts[length], room // length)
        size = 1
        while left > 0:  # binary splitting of the available pieces
            n = min(size, left)
            steps.append((length, n, reach))
            reach |= reach << n * length & full
            left -= n
            size *= 2
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:  # not reachable without this step
            taken[length] = taken.get(length, 0) + n
            total -= n * length
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times) of all containers for the lengths of a histogram, none above the capacity."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(counts, reverse=True)
    made = []
    while order:
        largest = order[0]
        counts[largest] -= 1
        chosen = fullest(counts, order, capacity - largest)
        counts[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * times
        made.append((chosen, times))
        order = [k for k in order if counts[k]]
    return made


def places(made: list[tuple[dict[int, int], int]], first: int) -> tuple[dict[int, list[np.ndarray]], int]:
    """Length -> (start ranks, container of each start, items per container); and the next free number."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for chosen, times in made:
        for length, n in chosen.items():
            rows.setdefault(length, []).append((used.get(length, 0), first, n))
            used[length] = used.get(length, 0) + n * times
        first += times
    return {k: [np.array(c, np.int64) for c in zip(*v)] for k, v in rows.items()}, first


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """(profile, container_no, doc_id, part, tokens): the place of every document or piece, for every capacity.

    ``container_no`` counts from 0 in each profile and is null for a document without tokens.
    """
    limits = [(r.profile, int(r.capacity_tokens)) for r in table(spark, folder, "pack_limits").where("capacity_tokens > 0").limit(MOST_PROFILES + 1).collect()]
    if len(limits) > MOST_PROFILES:
        raise ValueError(f"pack_limits is a fixed table of at most {MOST_PROFILES} profiles")
    sizes = document_tokens(spark, folder)
    out = sizes.limit(0).select(
        F.lit("").alias("profile"), F.col("row_no").alias("container_no"), "doc_id", F.col("row_no").alias("part"), "tokens"
    )
    for profile, capacity in limits:
        out = out.unionByName(packed(sizes, profile, capacity))
    return out


def packed(sizes: DataFrame, profile: str, capacity: int) -> DataFrame:
    """The places of all documents in containers of one capacity."""
    whole = F.floor(F.col("tokens") / F.lit(capacity)).cast("bigint")
    rest = F.col("tokens") - whole * capacity
    items = sizes.select("row_no", "doc_id", whole.alias("whole"), rest.alias("size"))
    histogram = {r["size"]: r["count"] for r in items.where("size > 0").groupBy("size").count().toLocalIterator()}  # < capacity rows
    at, used = places(plan(histogram, capacity), 0)
    buckets = max(64, sum(histogram.values()) // 1_000_000)
    ranked = bucketed_rank(
        items.where("size > 0"), ["size"], [F.col("row_no")], F.pmod(F.xxhash64("row_no"), F.lit(buckets)), "rank"
    )

    def place(batches):
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            number = np.empty(len(size), np.int64)
            for length in np.unique(size):
                here = size == length
                starts, first, n = at[int(length)]
                k = np.searchsorted(starts, rank[here], "right") - 1
                number[here] = first[k] + (rank[here] - starts[k]) // n[k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), batch.column("doc_id"), batch.column("whole"), batch.column("size")],
                names=["container_no", "doc_id", "part", "tokens"],
            )

    fitted = ranked.select("doc_id", "whole", "size", "rank").mapInArrow(
        place, "container_no bigint, doc_id bigint, part bigint, tokens bigint"
    )
    # Whole containers of long documents: numbered after the packed ones, by a running count over hash buckets.
    long = items.where("whole > 0").withColumn("b", F.pmod(F.xxhash64("row_no"), F.lit(buckets)))
    alone = whole_containers(long, used, capacity)
    empty = items.where("whole = 0 and size = 0").select(
        F.lit(None).cast("bigint").alias("container_no"), "doc_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("tokens")
    )
    rows = fitted.unionByName(alone).unionByName(empty)
    return rows.select(F.lit(profile).alias("profile"), "container_no", "doc_id", "part", "tokens")


def whole_containers(long: DataFrame, first: int, capacity: int) -> DataFrame:
    """One row per full container of a document longer than the capacity."""
    from pyspark.sql import Window

    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = long.groupBy("b").agg(F.sum("whole").alias("n")).select("b", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    local = Window.partitionBy("b").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = long.withColumn("inside", F.coalesce(F.sum("whole").over(local), F.lit(0))).join(totals, "b")
    return placed.select(
        "doc_id", (F.lit(first) + F.col("before") + F.col("inside")).alias("start"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("part")
    ).select((F.col("start") + F.col("part")).alias("container_no"), "doc_id", "part", F.lit(capacity).cast("bigint").alias("tokens"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """(profile, n_containers, n_items, tokens, fill_share): how full the containers of each capacity are."""
    limits = table(spark, folder, "pack_limits").select("profile", "capacity_tokens")
    rows = p6_pack(spark, folder).where("container_no is not null")
    per = rows.groupBy("profile", "container_no").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    total = per.groupBy("profile").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(F.broadcast(limits), "profile").select(
        "profile", "n_containers", "n_items", "tokens", "fullest",
        (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill_share"),
    )
