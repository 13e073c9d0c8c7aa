"""Window-like results without one task per key: ranks and runs over hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def bucketed_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str = "rank"
) -> DataFrame:
    """0-based rank of each row within ``keys`` under ``order``; hot keys stay split.

    ``bucket`` is a coarse, order-preserving value of the first order column (a
    day, a range of ids). Ranks inside (keys, bucket) come from a window over that
    small group; what lies before the bucket comes from a running sum over the
    bucket counts, which are few. Rows with a null bucket come first, as nulls
    do in an ascending Spark order. Null keys form one group, as in a window.
    """
    b, n, before = "__bucket", "__n", "__before"
    rows = df.withColumn(b, bucket)
    counts = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    run = Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, b, F.coalesce(F.sum(n).over(run), F.lit(0)).alias(before))
    local = Window.partitionBy(*keys, b).orderBy(*order)
    ranked = rows.withColumn("__local", F.row_number().over(local) - 1)
    same = [ranked[c].eqNullSafe(starts[c]) for c in (*keys, b)]
    joined = ranked.join(starts, same, "inner")
    return joined.select(
        *[ranked[c] for c in df.columns], (F.col("__local") + F.col(before)).cast("bigint").alias(out)
    )


def copies_with_first(rows: DataFrame, key: str, ident: str, hot_share: int = 1000, salts: int = 64) -> DataFrame:
    """Rows whose ``key`` occurs more than once, with the key's count and smallest ``ident``.

    1. Partial counts per key (combined before the shuffle) find the hot keys
       exactly: those with more than 1/``hot_share`` of all rows. Fewer than
       ``hot_share`` keys can be hot whatever the size of the data, so that list
       is broadcast.
    2. Rows of hot keys aggregate in two levels: per (key, salt), then per key.
    3. All other rows aggregate in one level, by one shuffle on the key.
    4. The summaries of repeated keys go back to the rows: by broadcast for hot
       keys, by a shuffle join for the rest, where no key is hot.

    ``rows`` should be a written table (see ``cut``): it is read three times.
    Rows with a null key are no copies of anything and are left out. Adds the
    columns ``n_copies`` and ``first_ident``; ties of ``ident`` count as rows.
    """
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_copies"))
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    hot = (
        counts.join(F.broadcast(total), F.col("n_copies") * hot_share > F.col("n_rows"))
        .where("n_copies > 1")
        .select(key)
    )
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi")
    cold_rows = rows.join(F.broadcast(hot), key, "left_anti")
    salted = (
        hot_rows.withColumn("__salt", F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int"))
        .groupBy(key, "__salt")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min(ident).alias("first_ident"))
    )
    hot_summary = salted.groupBy(key).agg(
        F.sum("n_copies").alias("n_copies"), F.min("first_ident").alias("first_ident")
    )
    cold_summary = (
        cold_rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min(ident).alias("first_ident"))
        .where("n_copies > 1")
    )
    return hot_rows.join(F.broadcast(hot_summary), key).unionByName(cold_rows.join(cold_summary, key))
