"""Queries on vectors, events and the order tables: what an engine for corpora needs besides texts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from talkmill.functions.metrics import learning_rate, tokens
from talkmill.operators import evaluation as ev, packing, selection, vectors
from talkmill.plans.sessions import gap_sessions
from talkmill.queries.corpus import longs
from talkmill.sources.tables import table


def label_centroids(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return longs(c.select("label", "dim", F.round("mean", 9).alias("mean"), F.round("lift", 9).alias("lift")))


LABEL_CENTROIDS = """
with e as (select label, unnest(range(0, len(embedding))) as dim, round(unnest(embedding)::double * 1e6)::bigint as x from embeddings where embedding is not null),
p as (select label, dim, sum(x)::bigint as s, count(*) as n from e group by all), w as (select dim, sum(s)::bigint as ts, sum(n)::bigint as tn from p group by dim)
select label::bigint as label, dim, round(s::double / n / 1e6, 9) as mean, round(s::double / n / 1e6 - ts::double / tn / 1e6, 9) as lift from p join w using (dim)
"""


def quantized_rows(spark, d):
    scale, codes = vectors.quantized("embedding")
    rows = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.round(scale, 12).alias("scale"), codes.alias("codes"))
    return rows.select("vec_id", "scale", F.aggregate("codes", F.lit(0), lambda s, x: s + F.abs(x)).cast("bigint").alias("code_sum"), F.array_max("codes").cast("bigint").alias("most"))


QUANTIZED_ROWS = """
with s as (select vec_id, embedding, greatest(list_max(list_transform(embedding, lambda x: abs(x::double))), 1e-8) / 127.0 as scale from embeddings where embedding is not null),
c as (select vec_id, scale, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::double / scale, 0)::int))) as codes from s)
select vec_id, round(scale, 12) as scale, list_sum(list_transform(codes, lambda x: abs(x)))::bigint as code_sum, list_max(codes)::bigint as most from c
"""


def user_sessions(spark, d):
    """Sessions of each user's events, split at gaps of more than an hour; hot users stay split by day."""
    limit = spark.range(1).select(F.lit(3600).cast("bigint").alias("limit_s"))
    rows = gap_sessions(table(spark, d, "events").select("event_id", "ts", "user_id"), "user_id", "ts", "event_id", limit)
    return rows.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


USER_SESSIONS = """
with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 3600000000 then 1 else 0 end as start from events where user_id is not null and ts is not null),
s as (select *, sum(start) over (partition by user_id order by ts, event_id) as session_no from g)
select user_id, session_no::bigint as session_no, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts from s group by all
"""


def hourly_counts(spark, d):
    """Tumbling hours by event type."""
    rows = table(spark, d, "events").where("ts is not null")
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return rows.groupBy(w["start"].cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


HOURLY_COUNTS = "select date_trunc('hour', ts) as hour, event_type, count(*) as n, count(distinct user_id) as n_users from events where ts is not null group by all"


def type_runs(spark, d):
    """Longest run of one event type per user, and the number of runs.

    Runs are found inside (user, day), a small group even for a user with a third of all events; only the first and
    last run of a day can go on over its edges, so two rows a day meet in a user's window.
    """
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    fresh = F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1))
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy("user_id", "day", "run", "event_type").agg(F.count(F.lit(1)).alias("n"))
    edge = lambda pick: pick(F.struct("event_type", "n"), "run")
    days = runs.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("r"), edge(F.min_by).alias("first"), edge(F.max_by).alias("last"))
    inner = runs.join(days.select(F.col("user_id").alias("u"), F.col("day").alias("d"), "r"), F.col("user_id").eqNullSafe(F.col("u")) & F.col("day").eqNullSafe(F.col("d")))
    inner = inner.where("run > 1 and run < r").groupBy("user_id").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("n_runs"))
    # A day of one run gives one edge; the last run of a longer day never joins its first.
    edges = days.select("user_id", "day", F.explode(F.when(F.col("r") == 1, F.array(F.struct(F.lit(0).alias("k"), F.col("first").alias("e")))).otherwise(
        F.array(F.struct(F.lit(0).alias("k"), F.col("first").alias("e")), F.struct(F.lit(1).alias("k"), F.col("last").alias("e"))))).alias("x"))
    flat = edges.select("user_id", "day", "x.k", F.col("x.e.event_type").alias("event_type"), F.col("x.e.n").alias("n"))
    over_days = Window.partitionBy("user_id").orderBy("day", "k")
    breaks = F.coalesce(((F.lag("event_type").over(over_days) != F.col("event_type")) | (F.col("k") == 1)).cast("int"), F.lit(1))
    merged = flat.withColumn("fresh", breaks).withColumn("run", F.sum("fresh").over(over_days)).groupBy("user_id", "run").agg(F.sum("n").alias("n"))
    outer = merged.groupBy("user_id").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("n_runs"))
    return outer.unionByName(inner).groupBy("user_id").agg(F.max("longest").alias("longest"), F.sum("n_runs").alias("n_runs"))


TYPE_RUNS = """
with f as (select *, coalesce((lag(event_type) over w <> event_type)::int, 1) as fresh from events window w as (partition by user_id order by ts, event_id)),
r as (select user_id, event_type, sum(fresh) over (partition by user_id order by ts, event_id) as run from f), c as (select user_id, run, event_type, count(*) as n from r group by all)
select user_id, max(n) as longest, count(*) as n_runs from c group by user_id
"""


def pack_offsets(spark, d):
    """Where each document's words fall in blocks of 512: offsets by a two-pass prefix sum."""
    rows = table(spark, d, "documents").select("doc_id", F.size(tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("tokens"))
    return packing.blocks(packing.token_offsets(rows, "doc_id", "tokens"), 512).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("stop") - F.col("start")).alias("n_words"), F.min("doc_id").alias("first_doc")
    )


PACK_OFFSETS = """
with r as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+')) as tokens from documents),
o as (select *, (sum(tokens) over (order by doc_id) - tokens)::bigint as off from r),
b as (select doc_id, tokens, off, unnest(range(off // 512, (off + tokens - 1) // 512 + 1)) as block from o where tokens > 0)
select block, count(*) as n_segments, sum(least(tokens, (block + 1) * 512 - off) - greatest(0, block * 512 - off))::bigint as n_words, min(doc_id) as first_doc from b group by block
"""


def capacity_cliff(spark, d):
    """Share of documents that fit each capacity; where the largest gain lies and from where three quarters fit."""
    sizes = table(spark, d, "documents").select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("n"))
    limits = table(spark, d, "pack_limits").select("capacity_tokens")
    fits = sizes.join(F.broadcast(limits), F.col("n") <= F.col("capacity_tokens")).groupBy("capacity_tokens").count()  # four limits
    whole = sizes.agg(F.count(F.lit(1)).alias("total"))
    rows = fits.crossJoin(F.broadcast(whole)).select("capacity_tokens", (F.col("count") / F.col("total")).alias("share"))
    gain = ev.cliff(rows, "capacity_tokens", "share")
    return longs(gain.crossJoin(ev.first_crossing(rows, "capacity_tokens", "share", 0.75)).withColumn("gain", F.round("gain", 6)))  # one row each


CAPACITY_CLIFF = """
with s as (select len(regexp_extract_all(coalesce(text, ''), '\\S+')) as n from documents),
r as (select capacity_tokens, count(*)::double / (select count(*) from s) as share from s join pack_limits on n <= capacity_tokens group by 1),
g as (select lag(capacity_tokens) over (order by capacity_tokens) as from_size, capacity_tokens as to_size, share - lag(share) over (order by capacity_tokens) as gain from r),
m as (select capacity_tokens, min(share) over (order by capacity_tokens rows between current row and unbounded following) as least from r)
select from_size::bigint as from_size, to_size::bigint as to_size, round(gain, 6) as gain, (select min(capacity_tokens) from m where least >= 0.75)::bigint as first_size from g where gain is not null order by gain desc, to_size limit 1
"""


def nucleus(spark, d):
    """Dimensions of each vector inside its top-p mass of one half."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return selection.top_p(rows, "vec_id", "x", 0.5).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n_dims"))


NUCLEUS = """
with e as (select vec_id, unnest(embedding)::double as x from embeddings), w as (select vec_id, x, exp(x - max(x) over (partition by vec_id)) as w from e),
p as (select vec_id, x, w / sum(w) over (partition by vec_id) as p from w), b as (select vec_id, coalesce(sum(p) over (partition by vec_id order by x desc rows between unbounded preceding and 1 preceding), 0) as before from p)
select vec_id, count(*) as n_dims from b where before <= 0.5 group by vec_id
"""


def schedule(spark, d):
    """Learning rate of a thousand steps: warm-up, then linear decay."""
    return spark.range(1000).select(F.col("id").alias("step"), F.round(learning_rate(F.col("id"), 0.001, 100, 1000, kind="linear"), 12).alias("rate"))


SCHEDULE = "select range as step, round(case when range < 100 then 0.001 * (range + 1) / 100.0::double else 0.001 * (0.1 + 0.9 * (1 - least(1.0, (range - 100) / 900.0::double))) end, 12) as rate from range(1000)"


def pricing_summary(spark, d):
    money = lambda c: F.col(c).cast("decimal(18,2)")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"), F.count(F.lit(1)).alias("n")
    )


PRICING_SUMMARY = "select l_returnflag, l_linestatus, sum(l_quantity::decimal(18,2))::double as sum_qty, sum(l_extendedprice::decimal(18,2))::double as sum_price, count(*) as n from lineitem group by all"


def nation_revenue(spark, d):
    """Order value per region and nation of the customer."""
    t = lambda n: table(spark, d, n)
    orders = t("orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count(F.lit(1)).alias("n"))
    joined = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("v").cast("double").alias("revenue"), F.sum("n").alias("n_orders"))


NATION_REVENUE = """select r_name, n_name, sum(o_totalprice::decimal(18,2))::double as revenue, count(*) as n_orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"""

QUERIES = {
    "label_centroids": (label_centroids, LABEL_CENTROIDS), "quantized_rows": (quantized_rows, QUANTIZED_ROWS), "user_sessions": (user_sessions, USER_SESSIONS),
    "hourly_counts": (hourly_counts, HOURLY_COUNTS), "type_runs": (type_runs, TYPE_RUNS), "pack_offsets": (pack_offsets, PACK_OFFSETS),
    "capacity_cliff": (capacity_cliff, CAPACITY_CLIFF), "nucleus": (nucleus, NUCLEUS), "schedule": (schedule, SCHEDULE),
    "pricing_summary": (pricing_summary, PRICING_SUMMARY), "nation_revenue": (nation_revenue, NATION_REVENUE),
}
