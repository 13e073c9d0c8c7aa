"""Token counts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.plans.lineage import cut
from talkmill.sources.tables import table

#: Folder of the tokenizer files on every executor.
FOLDER = os.environ.get("TALKMILL_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern by which this byte-level vocabulary splits a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    """The encoder of a rank file; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """(row_no, doc_id, source, tokens); null text has no tokens. ``row_no`` tells repeated ids apart."""

    def count(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_no"), batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())],
                names=["row_no", "doc_id", "source", "tokens"],
            )

    rows = documents.select("doc_id", "source", "text").withColumn("row_no", F.monotonically_increasing_id())
    return rows.select("row_no", "doc_id", "source", "text").mapInArrow(count, "row_no bigint, doc_id bigint, source string, tokens bigint")


def document_tokens(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """Token counts of all documents, written once."""
    return cut(token_counts(table(spark, folder, "documents"), path or os.path.join(FOLDER, FILE)))
