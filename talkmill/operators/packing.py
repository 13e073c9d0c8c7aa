"""Context windows and token blocks by prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def context_window(rows: DataFrame, size: Column, max_turns: int, budget: int) -> DataFrame:
    """The last turns of each talk up to its last user turn: at most ``max_turns``, then as many as fit the budget.

    The last user turn always stays.
    """
    back = Window.partitionBy("id").orderBy(F.desc("turn"))
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("id"))
    live = rows.where("role <> 'system'").withColumn("__last", last).where(F.col("turn") <= F.col("__last"))
    sized = live.withColumn("tokens", size).withColumn("back", F.row_number().over(back))
    run = sized.withColumn("upto", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("back") <= max_turns) & ((F.col("upto") <= budget) | (F.col("back") == 1))).drop("__last")


def token_offsets(rows: DataFrame, order: str, size: str, buckets: int = 64, per_range: int = 50_000) -> DataFrame:
    """Adds ``offset``: tokens of all rows before a row in the order of a number column.

    Two passes: running sums inside ranges of the order, plus the sums of the ranges before. There are at least
    ``buckets`` ranges and as many as ``per_range`` rows each need, so a range does not grow with the data; no window runs over all rows,
    only over one row per range. Rows of equal order should be few.
    """
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("__n"))
    ranges = F.greatest(F.lit(buckets), F.ceil(F.col("__n") / per_range))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / ranges))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("__b", F.floor((F.col(order) - F.col("lo")) / width))  # one row
    totals = placed.groupBy("__b").agg(F.sum(size).alias("n"))
    run = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__b", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("__before"))
    local = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("__inside", F.coalesce(F.sum(size).over(local), F.lit(0)))
    return inside.join(base, "__b").withColumn("offset", F.col("__before") + F.col("__inside")).drop("__b", "__n", "lo", "hi", "__before", "__inside")


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """(block, segment, first, last): which tokens of each row fall into which block of fixed length."""
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("tokens") - 1) / block)
    each = rows.where("tokens > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("offset"))
    stop = F.least(F.col("tokens"), (F.col("block") + 1) * block - F.col("offset"))
    return each.withColumn("start", start).withColumn("stop", stop)
