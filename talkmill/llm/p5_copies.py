"""Problem 5: records that are the same but for spacing, case, marks or order of fields.

A record's canonical key is a SHA-256 of its letters and digits (and, for dumped
candidates, of its numbers in value and its fields in one order). Copies are
grouped by ``copies_with_first``: hot keys are found exactly by partial counts and
aggregated in two salted levels, the rest by one shuffle; the representative is
the smallest identifier.

Defined results: a null content or role counts as an empty text in a talk; talks
with null or empty ``messages`` are equal to one another (no message differs); rows
with a null identifier are no records; a candidate without a letter or digit has no
copies; a line that is not one valid JSON object is no record; an empty ``scores``
object is like an absent one. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.functions.text import letters_digits
from talkmill.plans.lineage import cut
from talkmill.plans.skew import copies_with_first
from talkmill.sources.tables import table


def conversation_keys(conversations: DataFrame) -> DataFrame:
    """(tbl, ident, key) of each talk: its messages' roles and contents, canonical."""
    parts = F.transform(
        "messages",
        lambda m: F.concat(
            F.coalesce(letters_digits(m["role"]), F.lit("")), F.lit("\x01"), F.coalesce(letters_digits(m["content"]), F.lit(""))
        ),
    )
    text = F.concat(
        F.coalesce(F.size("messages"), F.lit(0)).cast("string"),
        F.lit("\x02"),
        F.coalesce(F.array_join(parts, "\x02"), F.lit("")),
    )
    fixed = F.when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, F.lit("0\x02")).otherwise(text)
    return conversations.where("id is not null").select(
        F.lit("example_conversations").alias("tbl"), F.col("id").alias("ident"), digest("c", fixed).alias("key")
    )


def candidate_keys(teacher: DataFrame) -> DataFrame:
    """(tbl, ident, key) of each candidate; the key holds the record's id, as copies count within a record."""
    each = teacher.where("id is not null").select("id", F.posexplode("candidates").alias("pos", "candidate"))
    text = letters_digits(F.col("candidate.content"))
    return (
        each.select("id", "pos", text.alias("text"))
        .where("text <> ''")
        .select(
            F.lit("example_teacher_candidates").alias("tbl"),
            F.concat("id", F.lit("#"), F.col("pos").cast("string")).alias("ident"),
            digest("t", F.concat(F.length("id").cast("string"), F.lit("\x01"), F.col("id"), F.lit("\x01"), F.col("text"))).alias("key"),
        )
    )


def line_keys(lines: DataFrame) -> DataFrame:
    """(tbl, ident, key) of each dumped line that is a JSON object."""
    parsed = lines.where("rec_id is not null").select("rec_id", F.try_parse_json("line").alias("v"))
    number = "coalesce(cast(try_variant_get({0}, '{1}', 'double') + 0.0D as string), 's' || try_variant_get({0}, '{1}', 'string'))"
    fields = parsed.where("schema_of_variant(v) like 'OBJECT<%'").select(
        "rec_id",
        letters_digits(F.expr("try_variant_get(v, '$.content', 'string')")).alias("content"),
        letters_digits(F.expr("try_variant_get(v, '$.source', 'string')")).alias("source"),
        F.expr(number.format("v", "$.score")).alias("score"),
        F.expr(
            "array_join(array_sort(transform(filter(map_entries(try_variant_get(v, '$.scores', 'map<string,string>')),"
            " e -> e.value is not null), e -> concat(e.key, '\x01', coalesce(cast(try_cast(e.value as double) + 0.0D as string), 's' || e.value)))), '\x02')"
        ).alias("scores"),
    )
    absent = F.lit("\x04")  # canonical texts and numbers hold no control characters
    scores = F.when(F.col("scores") != "", F.col("scores"))
    text = F.concat_ws("\x03", *[F.coalesce(c, absent) for c in (F.col("content"), F.col("source"), F.col("score"), scores)])
    return fields.select(F.lit("candidate_lines").alias("tbl"), F.col("rec_id").alias("ident"), digest("l", text).alias("key"))


def digest(kind: str, text):
    """32 bytes that stand for a canonical text; ``kind`` keeps the tables' keys apart."""
    return F.unhex(F.sha2(F.concat(F.lit(kind), text), 256))


def record_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all records of the three tables, written once."""
    keys = (
        conversation_keys(table(spark, folder, "example_conversations"))
        .unionByName(candidate_keys(table(spark, folder, "example_teacher_candidates")))
        .unionByName(line_keys(table(spark, folder, "candidate_lines")))
    )
    return cut(keys)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, first_key, copy_key): each group's smallest key with every other key."""
    copies = copies_with_first(record_keys(spark, folder), "key", "ident")
    return copies.where("ident <> first_ident").select(
        "tbl", F.col("first_ident").alias("first_key"), F.col("ident").alias("copy_key")
    )


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, rec_key, n_copies): one row for each distinct record with how many copies it had."""
    keys = record_keys(spark, folder)
    copies = copies_with_first(keys, "key", "ident")
    dropped = copies.where("ident <> first_ident").select("tbl", "ident")
    counted = copies.where("ident = first_ident").groupBy("tbl", "ident").agg(F.max("n_copies").alias("n_copies"))
    kept = keys.join(dropped, ["tbl", "ident"], "left_anti").select("tbl", "ident").distinct()
    return kept.join(counted, ["tbl", "ident"], "left").select(
        "tbl", F.col("ident").alias("rec_key"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies")
    )
