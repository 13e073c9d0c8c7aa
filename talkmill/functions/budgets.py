"""Sizes of models and artifacts: parameters from shapes, bytes from parameters, what a byte budget holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Bits a weight, and the bytes that any artifact has besides its weights.
BITS = {"fp32": 32, "bf16": 16, "fp16": 16, "int8": 8, "int4": 4}
TOKENIZER_BYTES = 560_000
METADATA_BYTES = 160_000


def parameters(vocab: Column, hidden: Column, layers: Column, q_width: Column, kv_width: Column, inner: Column, tied: Column) -> Column:
    """Parameters of a decoder with gated feed-forward layers and shared key and value heads."""
    attention = 2 * hidden * q_width + 2 * hidden * kv_width
    layer = attention + 3 * hidden * inner + 2 * hidden
    return vocab * hidden + layers * layer + hidden + F.when(tied, F.lit(0)).otherwise(vocab * hidden)


def overhead(tokenizer: bool = True) -> int:
    return METADATA_BYTES + (TOKENIZER_BYTES if tokenizer else 0)


def deployed_bytes(count: Column, precision: str, tokenizer: bool = True) -> Column:
    return F.floor(count * BITS[precision] / 8) + overhead(tokenizer)


def largest_count(budget_mb: Column, precision: str, tokenizer: bool = True) -> Column:
    """How many parameters fit a budget; none if it does not hold what comes besides."""
    return F.greatest(F.lit(0), F.floor((budget_mb * 1_048_576 - overhead(tokenizer)) * 8 / BITS[precision]))


def artifact_bytes(spark: SparkSession, path: str, leave: str = "trainer_state.pt") -> DataFrame:
    """One row: files and bytes below a folder, one kind of file left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(~F.col("path").endswith(leave)).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
