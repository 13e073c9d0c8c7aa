"""Readers of the dialogue layouts: canonical and tolerant JSONL, __eou__ text, utterance CSV, transcripts, score files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from talkmill.operators.conversations import SCHEMA

# Role spellings and transcript labels.
ALIASES = {
    "user": "user", "human": "user", "a": "user", "speaker 1": "user", "speaker1": "user", "me": "user", "you": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "b": "assistant", "speaker 2": "assistant",
    "speaker2": "assistant", "them": "assistant", "system": "system",
}
LABEL = r"(?i)^\s*(user|assistant|human|ai|a|b|speaker\s*1|speaker\s*2|me|them|you|bot)\s*[:>-]\s*"
META = ("topic", "emotion", "scenario", "style", "split")
PAIR = "array<struct<role:string,content:string>>"


def alias(name: Column) -> Column:
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.create_map(*pairs)[F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")]


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records; a bad line fails the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def alternating(utterances: str, first: str = "user") -> Column:
    """Roles by place in the list; blank utterances are dropped but keep their place."""
    other = "assistant" if first == "user" else "user"
    return F.filter(
        F.transform(utterances, lambda u, i: F.struct(F.when(i % 2 == 0, first).otherwise(other).alias("role"), F.trim(u).alias("content"))),
        lambda m: m["content"] != "",
    )


def transcript(text: Column) -> Column:
    """Turns of a labelled transcript; lines without a label continue the turn above, those before the first are dropped."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(
        lines,
        lambda x: F.struct(
            F.when(x.rlike(LABEL), F.coalesce(alias(F.regexp_extract(x, LABEL, 1)), F.lit("user"))).alias("role"),
            F.trim(F.regexp_replace(x, LABEL, "")).alias("text"),
        ),
    )
    start = F.filter(F.transform(marked, lambda x, i: F.when(x["role"].isNotNull(), i)), lambda i: i.isNotNull())
    turns = F.transform(
        start,
        lambda s, k: F.struct(
            F.get(marked, s)["role"].alias("role"),
            F.trim(F.array_join(F.transform(F.slice(marked, s + 1, F.coalesce(F.get(start, k + 1), F.size(marked)) - s), lambda x: x["text"]), " ")).alias("content"),
        ),
    )
    return F.filter(turns, lambda t: t["content"] != "")


def numbered_lines(spark: SparkSession, path: str | list[str], name: str | None = None) -> DataFrame:
    """(file, line, value): every line with its number in its file, from 0.

    Files are read in splits like any text, whatever their size: a line's place in its split plus the lines of the
    splits before it. Splits are few rows; no file is one string and no window runs over lines. With ``name``, a
    pattern of file names, folders are searched at all depths.
    """
    reader = spark.read
    if name:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__m"), "value"
    )
    splits = rows.groupBy("file", "__start").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    bases = splits.select("file", "__start", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__base"))
    return rows.join(F.broadcast(bases), ["file", "__start"]).select("file", (F.col("__m") + F.col("__base")).alias("line"), "value")


def stem(file: str = "file") -> Column:
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_eou(spark: SparkSession, path: str, split: str = "train", limit: int | None = None, keep_places: bool = True) -> DataFrame:
    """One dialogue per line, utterances parted by ``__eou__``; fewer than two utterances are dropped.

    ``path`` is a file, or a folder whose ``dialogues_*.txt`` are read at any depth. ``limit`` keeps the first talks
    in the order of files and lines. Blank utterances are dropped; with ``keep_places`` they still count when roles
    alternate, without it (as the registry reads, and the reference does) roles alternate over what is left.
    """
    folder = not path.rstrip("/").rsplit("/", 1)[-1].count(".")
    lines = numbered_lines(spark, path, "dialogues_*.txt" if folder else None)
    said = F.transform(F.split("value", "__eou__"), lambda u: F.trim(u))
    rows = lines.withColumn("utterances", said if keep_places else F.filter(said, lambda u: u != "")).withColumn("messages", alternating("utterances")).where(F.size("messages") >= 2)
    if limit is not None:
        rows = rows.orderBy("file", "line").limit(limit)
    meta = F.create_map(F.lit("split"), F.lit(split))
    return rows.select(F.format_string("dd-%s-%06d", stem(), "line").alias("id"), F.lit("dailydialog").alias("source"), "messages", meta.alias("meta"))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """CSV with one utterance per row, to one talk per conv_id; ``_comma_`` stands for a comma."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    at = F.coalesce(F.expr("try_cast(utterance_idx as double)"), F.lit(0.0)).cast("int")
    text = F.trim(F.replace("utterance", F.lit("_comma_"), F.lit(",")))
    per = rows.withColumn("__at", at).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), text.alias("text")))).alias("u"),
        F.min_by("context", "__at").alias("emotion"), F.min_by("prompt", "__at").alias("situation"),
    )
    staged = per.withColumn("utterances", F.transform("u", lambda x: x["text"])).withColumn("messages", alternating("utterances"))
    meta = F.create_map(F.lit("emotion"), F.col("emotion"), F.lit("situation"), F.col("situation"))
    return staged.where(F.size("messages") >= 2).select(F.concat(F.lit("ed-"), F.col("conv_id")).alias("id"), F.lit("empathetic_dialogues").alias("source"), "messages", meta.alias("meta"))


def normalize_records(lines: DataFrame, source: str) -> DataFrame:
    """Tolerant JSON lines (line, value) to records: messages, a transcript, or a list of utterances.

    A line that is no JSON fails the read, as does the strict reader. Fewer than two turns drop the record.
    """
    v = lines.where(F.trim("value") != "").withColumn("v", F.parse_json("value"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    given = F.filter(
        F.transform(get("messages", PAIR), lambda m: F.struct(alias(m["role"]).alias("role"), F.trim(m["content"]).alias("content"))),
        lambda m: m["role"].isNotNull() & (m["content"] != ""),
    )
    text = F.coalesce(get("conversation", "string"), get("text", "string"))
    said = F.coalesce(*[get(k, "array<string>") for k in ("dialog", "turns", "utterances", "dialogue")])
    listed = F.coalesce(*[get(k, PAIR) for k in ("dialog", "turns", "utterances", "dialogue")])
    staged = v.withColumn("said", said)
    messages = (
        F.when(get("messages", PAIR).isNotNull(), given)
        .when(text.isNotNull(), transcript(text))
        .when(F.expr("exists(said, s -> s like '{%')"), F.transform(listed, lambda m: F.struct(alias(m["role"]).alias("role"), F.trim(m["content"]).alias("content"))))
        .otherwise(alternating("said"))
    )
    words = F.transform(get("candidates", "array<string>"), lambda c: F.when(~c.startswith("{"), F.trim(c)))
    full = get("candidates", "array<struct<content:string,response:string,text:string,scores:map<string,double>,score:double,source:string>>")
    candidates = F.filter(
        F.transform(
            F.arrays_zip(words.alias("w"), full.alias("f")),
            lambda z: F.struct(
                F.coalesce(z["w"], F.trim(F.coalesce(z["f"]["content"], z["f"]["response"], z["f"]["text"]))).alias("content"),
                z["f"]["scores"].alias("scores"), z["f"]["score"].alias("score"), F.coalesce(z["f"]["source"], get("teacher", "string")).alias("source"),
            ),
        ),
        lambda c: c["content"] != "",
    )
    meta = F.map_filter(F.create_map(*[x for k in META for x in (F.lit(k), get(k, "string"))]), lambda k, x: x.isNotNull())
    return staged.select(
        F.coalesce(get("id", "string"), F.format_string(f"{source}-%06d", "line")).alias("id"),
        F.coalesce(get("source", "string"), F.lit(source)).alias("source"), messages.alias("messages"), meta.alias("meta"),
        candidates.alias("candidates"), get("chosen", "int").alias("chosen"),
    ).where(F.size("messages") >= 2)


def read_tolerant_jsonl(spark: SparkSession, path: str, source: str, limit: int | None = None) -> DataFrame:
    """Third-party JSONL; line numbers per file. ``limit`` counts lines, not records."""
    lines = numbered_lines(spark, path)
    return normalize_records(lines if limit is None else lines.where(F.col("line") < limit), source)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, scores): numeric scores only; a later line of an id wins."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    v = lines.withColumn("v", F.parse_json("value"))
    raw = F.expr("try_variant_get(v, '$.scores', 'map<string,string>')")
    numeric = F.map_filter(F.transform_values(raw, lambda k, x: x.try_cast("double")), lambda k, x: x.isNotNull())
    rows = v.select(F.expr("try_variant_get(v, '$.id', 'string')").alias("id"), F.struct("file", "line").alias("at"), numeric.alias("scores"))
    return rows.groupBy("id").agg(F.max_by("scores", "at").alias("scores"))


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of runs: the list in ``all_models.json`` if it is there, else ``*/summary.json`` below a folder."""
    from pyspark.errors import AnalysisException

    reader = spark.read.option("multiLine", True)
    try:
        found = reader.json(f"{folder}/all_models.json")
    except AnalysisException:
        found = reader.json(f"{folder}/*/summary.json")
    return found.withColumn("file", F.col("_metadata.file_path"))


SCENARIO = "id string, category string, user_turns array<string>, probes array<struct<turn:int,type:string,expect_any:array<string>,forbid_any:array<string>,forbid_confident:boolean,note:string>>"


def read_scenarios(spark: SparkSession, path: str, default: list[tuple] = ()) -> DataFrame:
    """Scenario lines; the given default rows where the file is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCENARIO).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        return spark.createDataFrame(list(default), SCENARIO)


def read_prefix_map(spark: SparkSession, path: str) -> DataFrame:
    """(policy, token, lift) of a mined map {policy: [{token, lift}]}; no rows where the file is missing."""
    from pyspark.errors import AnalysisException

    kind = "map<string,array<struct<token:string,lift:double>>>"
    try:
        text = spark.read.text(path, wholetext=True)  # a short report file
    except AnalysisException:
        return spark.createDataFrame([], "policy string, token string, lift double")
    return text.select(F.explode(F.from_json("value", kind)).alias("policy", "items")).select("policy", F.inline("items"))


#: Readers by the name of a layout.
ADAPTERS = {"dailydialog": functools.partial(read_eou, keep_places=False), "empathetic_dialogues": read_utterances, "jsonl": read_tolerant_jsonl, "synthetic": read_tolerant_jsonl}
