"""Sessions by inactivity gap, without one task per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def gap_histogram(rows: DataFrame, key: str, at: Column) -> DataFrame:
    """(gap_s, n): whole seconds between neighbouring rows of a key, counted.

    Neighbours are sought within (key, day), a small group even for a hot key; the gaps
    between a key's neighbouring days come from the days' first and last times.
    """
    timed = rows.select(F.col(key), at.alias("__at")).where(F.col(key).isNotNull() & F.col("__at").isNotNull()).withColumn("__day", F.to_date("__at"))
    seconds = lambda later, earlier: F.floor((micros(later) - micros(earlier)) / F.lit(1_000_000)).cast("bigint").alias("gap_s")
    w = Window.partitionBy(key, "__day").orderBy("__at")
    inside = timed.select(seconds(F.col("__at"), F.lag("__at").over(w)))
    days = timed.groupBy(key, "__day").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    between = days.select(seconds(F.col("__first"), F.lag("__last").over(Window.partitionBy(key).orderBy("__day"))))
    gaps = inside.unionByName(between).where("gap_s is not null")
    return gaps.groupBy("gap_s").count().withColumnRenamed("count", "n")


def calibrated_gap(histogram: DataFrame, share: float) -> DataFrame:
    """One row (limit_s): the smallest gap that at least ``share`` of all gaps don't exceed.

    The running sum is in two levels: over the gaps' whole days, as many rows as the longest
    gap has days, and over the distinct whole seconds of one such day, at most 86,400 rows.
    No gaps at all give a null limit.
    """
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.withColumn("days", F.floor(F.col("gap_s") / 86_400))
    by_days = placed.groupBy("days").agg(F.sum("n").alias("in_days"))
    before = by_days.select("days", (F.sum("in_days").over(upto("days")) - F.col("in_days")).alias("before"))
    total = histogram.agg(F.sum("n").alias("total"))
    cum = placed.join(before, "days").select("gap_s", (F.col("before") + F.sum("n").over(upto("days", "gap_s"))).alias("upto"))
    return (
        cum.join(F.broadcast(total), F.col("upto") >= F.ceil(F.col("total") * F.lit(share)), "inner")
        .agg(F.min("gap_s").cast("bigint").alias("limit_s"))
    )


def micros(at: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(at.cast("timestamp"))


def gap_sessions(rows: DataFrame, key: str, at: str, ident: str, limit: DataFrame) -> DataFrame:
    """Number the sessions of each ``key``: a new one starts after a gap above ``limit.limit_s`` seconds.

    Two levels keep a hot key split: starts are found inside (key, day) groups, then
    the day groups' edges are compared and their start counts summed over the key's
    days, which are few. Adds ``session_no`` (0-based). Rows without key or time are
    left out; ties in time follow ``ident``; a null limit never splits.
    """
    timed = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__day", F.to_date(at))
    limited = timed.crossJoin(F.broadcast(limit))  # one row
    w = Window.partitionBy(key, "__day").orderBy(at, ident)
    gap = micros(F.col(at)) - micros(F.lag(at).over(w))
    inside = limited.withColumn("__start", F.coalesce((gap > F.col("limit_s") * 1_000_000).cast("int"), F.lit(0)))
    local = inside.withColumn("__local", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = local.groupBy(key, "__day").agg(
        F.min(at).alias("__first"), F.max(at).alias("__last"), F.sum("__start").alias("__starts"), F.first("limit_s").alias("__limit")
    )
    by_day = Window.partitionBy(key).orderBy("__day")
    edge = F.coalesce(
        (micros(F.col("__first")) - micros(F.lag("__last").over(by_day)) > F.col("__limit") * 1_000_000).cast("int"), F.lit(0)
    )
    base = (
        days.withColumn("__edge", edge)
        .withColumn("__before", F.coalesce(F.sum("__starts").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__edges", F.sum("__edge").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
        .select(key, "__day", (F.col("__before") + F.col("__edges")).alias("__base"))
    )
    joined = local.join(base, [key, "__day"])
    return joined.select(*[joined[c] for c in rows.columns], (F.col("__base") + F.col("__local")).cast("bigint").alias("session_no"))
