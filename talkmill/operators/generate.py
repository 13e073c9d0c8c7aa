"""Generators: rows from banks by hashed randomness, the same whatever the partitioning.

Banks (topics, prompts, replies) are parameters. Every draw is a hash of a seed, a row's
number and the draw's name, so any row can be made alone and appends change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def uniform(ident: Column, name: str, seed: int = 1337) -> Column:
    """A number in [0, 1) from the first 32 bits of a SHA-256."""
    text = F.concat(F.lit(f"{seed}:{name}:"), ident.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(u: Column, bank: Sequence[str]) -> Column:
    """One entry of a bank, all equally likely."""
    return F.get(F.array(*[F.lit(x) for x in bank]), F.floor(u * len(bank)).cast("int"))


def pick_weighted(u: Column, bank: Sequence[tuple[str, float]]) -> Column:
    """One entry of a bank by weight: the first whose cumulative share exceeds the draw."""
    whole = sum(w for _, w in bank)
    bounds, upto = [], 0.0
    for name, w in bank:
        upto += w / whole
        bounds.append((upto, name))
    return reduce(lambda c, b: c.when(u < b[0], b[1]), bounds[1:-1], F.when(u < bounds[0][0], bounds[0][1])).otherwise(bounds[-1][1]) if len(bank) > 1 else F.lit(bank[0][0])


def noised(text: Column, ident: Column, fillers: Sequence[str], tails: Sequence[str], seed: int = 1337) -> Column:
    """A prompt with a filler before it (.30), a tail after it (.25), its end mark off (.15), in capitals (.10) or with a capital (.12)."""
    u = lambda name: uniform(ident, name, seed)
    text = F.when(u("filler") < 0.30, F.concat_ws(" ", pick(u("which filler"), fillers), text)).otherwise(text)
    text = F.when(u("tail") < 0.25, F.concat_ws(" ", text, pick(u("which tail"), tails))).otherwise(text)
    text = F.when(u("strip") < 0.15, F.regexp_replace(text, r"[.!?]+$", "")).otherwise(text)
    return F.when(u("case") < 0.10, F.upper(text)).when(u("case") < 0.22, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))).otherwise(text)


def teacher_requests(spark: SparkSession, n: int, topics: Sequence[str], emotions: Sequence[str], scenarios: Sequence[str], turns: Sequence[int], seed: int = 1337) -> DataFrame:
    """Requests whose topics go round, with hashed scenario, emotion and length."""
    rows = spark.range(n)
    u = lambda name: uniform(F.col("id"), name, seed)
    return rows.select(
        F.format_string("req-%06d", "id").alias("id"), F.get(F.array(*[F.lit(t) for t in topics]), (F.col("id") % len(topics)).cast("int")).alias("topic"),
        pick(u("emotion"), emotions).alias("emotion"), pick(u("scenario"), scenarios).alias("scenario"), pick(u("turns"), [str(t) for t in turns]).cast("int").alias("num_turns"),
    )


def prompt_variants(prompts: DataFrame, forms: Sequence[tuple[str, str]]) -> DataFrame:
    """Each held-out prompt (name, prompt) in every form, one row per resulting text.

    ``forms`` are (form, pattern) with ``{}`` for the prompt; the first form that gives a text keeps it.
    """
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("form"), F.lit(p).alias("pattern")) for i, (f, p) in enumerate(forms)])
    each = prompts.select("name", "prompt", F.explode(table).alias("f"))
    made = each.withColumn("text", F.replace(F.col("f.pattern"), F.lit("{}"), F.col("prompt")))
    return made.groupBy("name", "text").agg(F.min_by("f.form", "f.i").alias("form"))


def partition_pool(pool: DataFrame, column: str) -> DataFrame:
    """Thirds of a bank by place in sorted order (a bank is short)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(column)) - 1
    return pool.select(column, F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (place % 3 + 1).cast("int")).alias("part"))


def core_examples(spark: SparkSession, intents: DataFrame, held: DataFrame, n: int, seed: int = 1337) -> DataFrame:
    """(k, intent, prompt, reply): an intent by weight (5 - tier), one of its paraphrases with noise, and its target behind a length mark.

    Prompts whose surface form is in ``held`` (surface) are left out, so that no benchmark prompt is trained on.
    ``intents`` and ``held`` are small fixed tables.
    """
    from pyspark.sql import Window

    from talkmill.functions.normalize import surface

    u = lambda name: uniform(F.col("k"), name, seed)
    known = intents.withColumn("train", F.filter("train", lambda x: x.isNotNull()))
    weighted = known.where("size(train) > 0").select("name", "length", "targets", "train", (5 - F.col("tier")).cast("double").alias("w"))
    upto = F.sum("w").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("w").over(Window.partitionBy(F.lit(1)))
    bounds = weighted.withColumn("hi", upto / whole).withColumn("lo", (upto - F.col("w")) / whole)
    rows = spark.range(n).withColumnRenamed("id", "k").withColumn("__u", u("intent"))
    drawn = rows.join(F.broadcast(bounds), (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi")))  # an interval join with a fixed table
    text = F.get("train", F.floor(u("paraphrase") * F.size("train")).cast("int"))
    drawn = drawn.withColumn("t", text)
    for column in noise_steps(u):
        drawn = drawn.withColumn("t", column)
    reply = F.concat(F.lit("<|len_"), "length", F.lit("|> "), F.get("targets", F.lit(0)))
    made = drawn.withColumn("surface", surface(F.col("t"))).join(F.broadcast(held), "surface", "left_anti")
    return made.select("k", F.col("name").alias("intent"), F.col("t").alias("prompt"), reply.alias("reply"))


def noise_steps(u, fillers: Sequence[str] = ("so ", "ok so ", "hey ", "right "), tails: Sequence[str] = (" lol", " haha", " though", "!")) -> list[Column]:
    """Noise on column ``t``, one step after another: filler .30, tail .25, end marks off .15, capitals .10 or .12 of the rest, a letter doubled .06."""
    t = F.col("t")
    at = 1 + F.floor(u("which letter") * (F.length(t) - 2)).cast("int")
    return [
        F.when(u("filler") < 0.30, F.concat(pick(u("which filler"), fillers), t)).otherwise(t),
        F.when(u("tail") < 0.25, F.concat(t, pick(u("which tail"), tails))).otherwise(t),
        F.when(u("strip") < 0.15, F.regexp_replace(t, r"[?!.]+$", "")).otherwise(t),
        F.when(u("case") < 0.10, F.upper(t)).when(u("case") < 0.208, F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), F.substr(t, F.lit(2)))).otherwise(t),
        F.when((u("double") < 0.06) & (F.length(t) > 5), F.concat(F.substr(t, F.lit(1), at + 1), F.substr(t, at + 1))).otherwise(t),
    ]


def train_part(bank: Sequence[str], held: float = 0.25, seed: int = 1337) -> list[str]:
    """The entries of a bank that are not held out, by a hash of each entry: appends to the bank move nothing. Never empty."""
    import hashlib

    share = lambda x: int(hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()[:8], 16) / 2**32
    kept = [x for x in bank if share(x) >= held]
    return kept or sorted(bank)[:1]


def frame_examples(spark: SparkSession, n: int, frames: Sequence[tuple[str, Sequence[str], Sequence[str], Sequence[str]]], acks: Sequence[str], fillers: Sequence[str], held: float = 0.25) -> DataFrame:
    """(k, frame, noun, messages): a user sentence with a noun, a reply that takes it up, and one or two turns more.

    ``frames``: (name, nouns, user sentences, replies), ``{n}`` for the noun; held-out nouns never occur. A later turn takes up
    the noun again with .45, by a reply not used before, else it acknowledges.
    """
    u = lambda name: uniform(F.col("k"), name)
    rows = spark.range(n).withColumnRenamed("id", "k").withColumn("f", F.floor(u("frame") * len(frames)).cast("int"))
    by_frame = lambda make: F.coalesce(*[F.when(F.col("f") == i, make(fr)) for i, fr in enumerate(frames)])
    rows = rows.withColumn("frame", by_frame(lambda fr: F.lit(fr[0]))).withColumn("noun", by_frame(lambda fr: pick(u("noun"), train_part(fr[1], held))))
    first = by_frame(lambda fr: F.floor(u("reply") * len(fr[3])).cast("int"))
    nth = lambda step: by_frame(lambda fr: F.get(F.array(*[F.lit(x) for x in fr[3]]), F.pmod(F.col("r") + step, F.lit(len(fr[3])))))
    rows = rows.withColumn("r", first)
    turns = 1 + F.floor(u("turns") * 2)
    messages = [by_frame(lambda fr: pick(u("user"), fr[2])), nth(0)]
    used = F.lit(0)
    for step in (1, 2):
        again = u(f"again {step}") < 0.45
        used = used + again.cast("int")
        here = turns >= step
        messages += [F.when(here, pick(u(f"filler {step}"), fillers)), F.when(here, F.when(again, nth(used)).otherwise(pick(u(f"ack {step}"), acks)))]
    text = F.transform(F.filter(F.array(*messages), lambda m: m.isNotNull()), lambda m: F.replace(m, F.lit("{n}"), F.col("noun")))
    return rows.select("k", "frame", "noun", text.alias("messages"))


def state_pairs(spark: SparkSession, n: int, openers: dict[str, dict[str, Sequence[str]]], targets: dict[str, Sequence[str]], corrections: dict[str, Sequence[str]], probes: Sequence[str], shapes: Sequence[tuple[str, float]]) -> DataFrame:
    """(pair, valence, family, shape, final_valence, messages): counterfactual pairs, alike in every draw but the valence.

    Both sides share pair and family. ``corrected`` talks flip the valence, ``drifted`` ones take another topic's opener. Probes
    (one to three) are answered by targets of the final valence, none twice in a talk.
    """
    topics, flip = sorted(openers), {"positive": "negative", "negative": "positive"}
    u = lambda name: uniform(F.col("pair"), name)
    rows = spark.range(n).withColumnRenamed("id", "pair").withColumn("valence", F.explode(F.array(F.lit("positive"), F.lit("negative"))))
    rows = rows.withColumn("shape", pick_weighted(u("shape"), shapes)).withColumn("t", F.floor(u("topic") * len(topics)).cast("int"))
    other = F.pmod(F.col("t") + 1 + F.floor(u("other topic") * (len(topics) - 1)).cast("int"), F.lit(len(topics)))
    final = F.when(F.col("shape") == "corrected", F.when(F.col("valence") == "positive", "negative").otherwise("positive")).otherwise(F.col("valence"))
    rows = rows.withColumn("o", other).withColumn("final_valence", final)
    opener = lambda t, name: F.coalesce(*[F.when((F.col(t) == i) & (F.col("valence") == v), pick(u(name), openers[x][v])) for i, x in enumerate(topics) for v in flip])
    by_valence = lambda column, make: F.when(F.col(column) == "positive", make("positive")).otherwise(make("negative"))
    target = lambda column, step: by_valence(column, lambda v: F.get(F.array(*[F.lit(x) for x in targets[v]]), F.pmod(F.floor(u("target") * len(targets[v])).cast("int") + step, F.lit(len(targets[v])))))
    corrected, drifted = F.col("shape") == "corrected", F.col("shape") == "drifted"
    turn = by_valence("valence", lambda v: pick(u("correction"), corrections[v]))
    messages = [opener("t", "opener"), target("valence", 0), F.when(corrected, turn).when(drifted, opener("o", "other opener")), F.when(corrected | drifted, target("final_valence", 1))]
    count = 1 + F.floor(u("probes") * 3)
    for i in range(3):
        messages += [F.when(count > i, pick(u(f"probe {i}"), probes)), F.when(count > i, target("final_valence", 2 + i))]
    text = F.filter(F.array(*messages), lambda m: m.isNotNull())
    name = F.get(F.array(*[F.lit(x) for x in topics]), F.col("t"))
    return rows.select("pair", "valence", F.concat_ws(":", F.lit("state"), name, "shape", F.format_string("%05d", "pair")).alias("family"), "shape", "final_valence", text.alias("messages"))


def latent_specs(spark: SparkSession, n: int, skills: Sequence[tuple[str, float]], lengths: Sequence[tuple[str, int, int]], long_skills: Sequence[str], banks: dict[str, Sequence[str]]) -> DataFrame:
    """Specs of talks to write: skill by weight, family, split by a hash of the family (.12 and .12), length, people, distance of reference.

    ``lengths``: (profile, least, most) turns; ``long_skills`` take the last profile with .55. ``banks`` give the other fields.
    """
    u = lambda name: uniform(F.col("k"), name)
    rows = spark.range(n).withColumnRenamed("id", "k").withColumn("skill", pick_weighted(u("skill"), skills))
    rows = rows.withColumn("family", F.concat("skill", F.lit(":"), F.format_string("%03d", F.floor(u("family") * 400))))
    at = F.pmod(F.conv(F.substring(F.sha2("family", 256), 1, 12), 16, 10).cast("bigint"), F.lit(10_000)) / 10_000.0
    split = F.when(at < 0.12, "validation").when(at < 0.24, "test").otherwise("train")
    which = F.when(F.col("skill").isin(*long_skills) & (u("long") < 0.55), len(lengths) - 1).otherwise(F.floor(u("length") * len(lengths)).cast("int"))
    rows = rows.withColumn("split", split).withColumn("l", which)
    of = lambda field: F.get(F.array(*[F.lit(x[field]) for x in lengths]), F.col("l"))
    rows = rows.withColumn("length_profile", of(0)).withColumn("target_turns", (of(1) + F.floor(u("turns") * (of(2) - of(1) + 1))).cast("int"))
    n_people = F.when(u("people") < 0.5, 1).when(u("people") < 0.85, 2).otherwise(3)
    two = lambda a, b: F.when(u("distance") < 0.5, a).otherwise(b)
    turns = F.col("target_turns")
    reach = (
        F.when(turns <= 7, "0-128").when(turns <= 11, two("0-128", "129-256")).when(turns <= 16, two("129-256", "257-512"))
        .when(turns <= 22, two("257-512", "513-768")).otherwise(two("513-768", "769-1024"))
    )
    return rows.select(
        F.format_string("q-%07d", "k").alias("id"), "family", "split", "skill", "length_profile", "target_turns", n_people.alias("n_people"), reach.alias("reference_distance"),
        *[pick(u(name), bank).alias(name) for name, bank in banks.items()],
    )


def spliced(spark: SparkSession, n: int, pool: DataFrame, facts: Sequence[tuple[str, str, str]], least: int = 2, most: int = 14, far: float = 0.35, more: int = 12) -> DataFrame:
    """(k, fact, gap, messages): a fact, a gap of real exchanges, and a question that needs the fact, with its answer.

    ``pool`` (place, asked, said) holds numbered exchanges, places 0 to m - 1; ``facts`` are (statement, question, answer). A gap has
    ``least`` to ``most`` exchanges, with probability ``far`` up to ``more`` beyond. Exchanges are drawn by place and joined on it.
    """
    u = lambda name: uniform(F.col("k"), name)
    size = pool.agg(F.count(F.lit(1)).alias("m"))
    gap = least + F.floor(u("gap") * (most - least + 1)) + F.when(u("far") < far, F.floor(u("more") * (more + 1))).otherwise(0)
    rows = spark.range(n).withColumnRenamed("id", "k").crossJoin(F.broadcast(size)).withColumn("gap", gap.cast("int")).where("m > 0")  # one row
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("1337:turn"), "k", "i"), 256), 1, 12), 16, 10).cast("bigint")
    each = rows.select("k", "gap", "m", F.explode(F.sequence(F.lit(1), F.col("gap"))).alias("i")).withColumn("place", F.pmod(draw, F.col("m")))
    joined = each.join(pool, "place").groupBy("k", "gap").agg(F.array_sort(F.collect_list(F.struct("i", "asked", "said"))).alias("g"))  # gaps are short
    f = F.floor(u("fact") * len(facts)).cast("int")
    text = lambda j: F.get(F.array(*[F.lit(x[j]) for x in facts]), f)
    middle = F.flatten(F.transform("g", lambda x: F.array(x["asked"], x["said"])))
    return joined.select("k", f.cast("bigint").alias("fact"), F.col("gap").cast("bigint").alias("gap"), F.concat(F.array(text(0)), middle, F.array(text(1), text(2))).alias("messages"))


def offline_talks(spark: SparkSession, n: int, topics: Sequence[str], openers: dict[str, Sequence[str]], replies: dict[str, Sequence[str]], follow: Sequence[str], with_candidates: float = 0.3) -> DataFrame:
    """(k, topic, valence, messages, candidates): topics go round, replies fit the valence of the opener; some talks carry candidates.

    ``{t}`` in a text is the topic. Two to four exchanges; candidates are all replies of the valence, the best one marked by its
    score, so that selection has something to choose from.
    """
    u = lambda name: uniform(F.col("k"), name)
    kinds = sorted(openers)
    rows = spark.range(n).withColumnRenamed("id", "k").withColumn("topic", F.get(F.array(*[F.lit(t) for t in topics]), F.pmod("k", F.lit(len(topics))).cast("int")))
    rows = rows.withColumn("valence", pick(u("valence"), kinds))
    of = lambda make: F.coalesce(*[F.when(F.col("valence") == v, make(v)) for v in kinds])
    count = 2 + F.floor(u("exchanges") * 3)
    messages = [of(lambda v: pick(u("opener"), openers[v])), of(lambda v: pick(u("reply 0"), replies[v]))]
    for i in (1, 2, 3):
        messages += [F.when(count > i, pick(u(f"follow {i}"), follow)), F.when(count > i, of(lambda v, i=i: pick(u(f"reply {i}"), replies[v])))]
    text = F.transform(F.filter(F.array(*messages), lambda m: m.isNotNull()), lambda m: F.replace(m, F.lit("{t}"), F.col("topic")))
    scored = of(lambda v: F.array(*[F.struct(F.lit(x).alias("content"), F.lit(round(5.0 - i, 1)).alias("score")) for i, x in enumerate(replies[v])]))
    return rows.select("k", "topic", "valence", text.alias("messages"), F.when(u("candidates") < with_candidates, scored).alias("candidates"))


def combined_talks(spark: SparkSession, n: int, openers: dict[str, Sequence[str]], replies: dict[str, Sequence[str]], parts: dict[str, tuple[float, Sequence[tuple[str, str]]]], memory: tuple[float, Sequence[tuple[str, str, str]]], closers: tuple[float, Sequence[tuple[str, str]]], heavy: str) -> DataFrame:
    """(k, valence, used, messages): an opener and its reply, then optional parts, each with its own probability, and a closer.

    ``parts``: name -> (probability, exchanges), in order (a new topic, a question nobody can answer, a boundary); ``memory``:
    a fact stated after the opener and asked for before the closer. A ``heavy`` valence takes no new topic and no boundary:
    the talk stays with it. ``used`` names the parts of a talk.
    """
    u = lambda name: uniform(F.col("k"), name)
    kinds = sorted(openers)
    rows = spark.range(n).withColumnRenamed("id", "k").withColumn("valence", pick(u("valence"), kinds))
    of = lambda make: F.coalesce(*[F.when(F.col("valence") == v, make(v)) for v in kinds])
    pair = lambda bank, name, j: pick(u(name), [x[j] for x in bank])
    remembers = u("memory") < memory[0]
    messages = [of(lambda v: pick(u("opener"), openers[v])), of(lambda v: pick(u("reply"), replies[v]))]
    messages += [F.when(remembers, pair(memory[1], "fact", 0)), F.when(remembers, of(lambda v: pick(u("noted"), replies[v])))]
    used = [F.when(remembers, F.lit("memory"))]
    for name, (share, bank) in parts.items():
        here = (u(name) < share) & ((F.col("valence") != heavy) | F.lit(name == "unknown"))
        messages += [F.when(here, pair(bank, f"which {name}", j)) for j in (0, 1)]
        used.append(F.when(here, F.lit(name)))
    messages += [F.when(remembers, pair(memory[1], "fact", j)) for j in (1, 2)]
    ends = u("closer") < closers[0]
    messages += [F.when(ends, pair(closers[1], "which closer", j)) for j in (0, 1)]
    used.append(F.when(ends, F.lit("closer")))
    solid = lambda xs: F.filter(F.array(*xs), lambda m: m.isNotNull())
    return rows.select("k", "valence", solid(used).alias("used"), solid(messages).alias("messages"))
