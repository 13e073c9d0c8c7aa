"""Problem 8: statistics of each text and what kind of text it is.

A document longer than ``CHUNK`` characters is split into chunks, and the chunks are spread
over the cluster. Every cut is after a newline, so a chunk holds whole lines, and words,
tokens and lines are all judged whole; a line longer than ``CHUNK`` is a chunk of its own.
Every statistic is an associative count, the same sum whatever the chunks. Chunk counts
merge through a two-level tree (chunk group, document). Shorter documents are one chunk
and need no shuffle. Ratios and rules follow from the sums.

The counts take some forty looks at every character, which as JVM regular expressions cost
3 microseconds a character; they are taken over flat character arrays of whole Arrow batches
(see ``flat``), and only lines with a rare mark are tried against a pattern. Each line gives
its characters to one of four shapes (row of cells, log line, item, running text).

Defined results: a null or blank text has zero counts and null ratios and is ``junk``; the
same for every row of a repeated doc_id, whose rows are counted apart (a row number inside
the scan tells them apart); a null doc_id stays null. Extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkmill.llm.flat import BREAK, CLOSER, DIGIT, HEX, HIDDEN, LETTER, MARK, PLAIN, RARE, SPACE, UPPER, VOWEL, Flat, blocks, runs, word_hashes
from talkmill.sources.tables import table

CHUNK = 16_384
#: Words kept to tell how many distinct ones a text has: exact below this number.
KEEP = 32

# Tried only on lines that hold a mark of theirs.
LOG_LINE = re.compile(
    r"(?:\b\w+=\S+\s*){2}|\b(?:INFO|WARN|WARNING|ERROR|DEBUG|DBG|TRACE|FATAL)\b|0x[0-9a-fA-F]{4,}"
    r"|^\s*at [\w.$]+\(|\"\w+\"\s*:\s*[\"{\[\d]|^\s*[{}\[\]],?\s*$"
)
MARKUP_ROW = re.compile(r"</?t[dhr][ >]")
BULLETS = np.array([ord(c) for c in "-*•+·–—>"], np.uint32)
SUMS = (
    "chars", "solid", "letters", "vowels", "digits", "symbols", "mojibake", "words", "common", "tokens", "hex_pairs",
    "escapes", "long_chars", "ends", "lines", "closed_lines", "bullet_lines", "table_chars", "log_chars", "item_chars", "text_chars", "markup_chars",
)


def common_words(spark: SparkSession, folder: str) -> list[str]:
    """The frequent words of all languages: a fixed list of about 200 rows, checked to be small."""
    rows = table(spark, folder, "common_words").where("word is not null").select(F.lower("word").alias("word")).distinct()
    words = [r.word for r in rows.limit(20_001).collect()]
    if len(words) > 20_000:
        raise ValueError("common_words is a fixed list of at most 20,000 words")
    return sorted(words)


def chunked(documents: DataFrame) -> DataFrame:
    """(row_no, doc_id, chunk_no, text): one row per chunk of the documents above ``CHUNK``, cut after newlines only."""
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}(?:\n|\z)|[^\n]+(?:\n|\z)|\n"), F.lit(0))
    return documents.select("row_no", "doc_id", F.posexplode(parts).alias("chunk_no", "text"))


def counts(rows: DataFrame, common: list[str]) -> DataFrame:
    """Replaces ``text`` by its associative counts (see ``SUMS``) and ``kept``, its smallest word hashes."""
    keys = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*[f"{c} bigint" for c in keys], *[f"{c} bigint" for c in SUMS], "kept array<bigint>"])

    def count(batches):
        known = np.sort(word_hashes(common)) if common else np.zeros(1, np.uint64)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
            for first, stop in blocks(texts):
                sums, kept, offsets = text_sums(texts[first:stop], known)
                arrays = [batch.column(k).slice(first, stop - first) for k in range(len(keys))]
                arrays += [pa.array(sums[c].astype(np.int64)) for c in SUMS]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(kept.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *SUMS, "kept"])

    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in keys], "text").mapInArrow(count, schema)


def text_sums(texts: list[str], known: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The sums of each text, its ``KEEP`` + 1 smallest word hashes end to end, and their offsets."""
    flat = Flat(texts)
    codes, at = flat.codes, flat.flags
    space = flat.has(SPACE)
    solid = ~space
    out = {"chars": flat.stops - flat.starts, "vowels": flat.sums(flat.has(VOWEL)), "digits": flat.sums(flat.has(DIGIT))}
    out["symbols"] = flat.sums((at & (LETTER | DIGIT | SPACE | PLAIN | HIDDEN)) == 0)

    first, last = flat.words()
    hashes = flat.hashes(first, last)
    slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    out["letters"] = flat.spread(last - first + 1, first)
    out["words"] = flat.spread(np.ones(len(first), np.int64), first)
    out["common"] = flat.spread((known[slot] == hashes).astype(np.int64), first)
    kept, offsets = smallest(hashes, out["words"])

    begin, end = runs(solid)  # tokens
    size = end - begin + 1
    out["tokens"] = flat.spread(np.ones(len(begin), np.int64), begin)
    out["long_chars"] = flat.spread(np.where(size >= 30, size, 0), begin)
    out["hex_pairs"] = flat.spread(((size == 2) & ((at[begin] & HEX) != 0) & ((at[end] & HEX) != 0)).astype(np.int64), begin)

    # Lines: [start, stop), their first and last token.
    stop = np.flatnonzero(flat.has(BREAK))
    start = np.concatenate([[0], stop[:-1] + 1])
    low, high = np.searchsorted(begin, start), np.searchsorted(begin, stop)
    filled = high > low
    head = np.where(filled, begin[np.minimum(low, max(0, len(begin) - 1))], start) if len(begin) else start
    tail = np.where(filled, end[np.maximum(high - 1, 0)], start) if len(begin) else start
    weight = np.add.reduceat(solid, start, dtype=np.int64)
    by_text = lambda values: flat.sums_of_lines(values, stop)
    line_of = lambda places: np.searchsorted(stop, places)

    # Sentence marks, with closing quotes and brackets looked through from both sides.
    closing = flat.has(CLOSER)
    place = np.arange(len(codes), dtype=np.int32)
    following = np.minimum.accumulate(np.where(closing, np.int32(len(codes)), place)[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(closing, np.int32(-1), place))
    marks = np.flatnonzero(flat.has(MARK))
    out["ends"] = flat.spread(space[following[marks + 1]].astype(np.int64), marks)
    core = preceding[tail]
    closed = filled & (core >= start) & ((at[np.maximum(core, 0)] & MARK) != 0)
    broken = marks[space[marks + 1]]  # a mark before white space

    # Bullets, then the bare line without them.
    padded = np.concatenate([codes, np.full(6, 10, np.uint32)])
    kinds = np.concatenate([at, np.full(6, BREAK | SPACE, np.uint16)])
    gap = lambda k: (kinds[head + k] & (SPACE | BREAK)) == SPACE
    c = [padded[head + k] for k in range(5)]
    number = [(x >= 48) & (x <= 57) for x in c]
    point = [(x == 46) | (x == 41) for x in c]
    mark_size = np.zeros(len(start), np.int64)
    for length, here in (
        (4, number[0] & number[1] & number[2] & point[3] & gap(4)),
        (3, (number[0] & number[1] & point[2] | (c[0] == 91) & np.isin(c[1], [32, 88, 120]) & (c[2] == 93)) & gap(3)),
        (2, ((number[0] | ((kinds[head] & LETTER) != 0)) & point[1] | (c[0] == 91) & (c[1] == 93)) & gap(2)),
        (1, np.isin(c[0], BULLETS) & gap(1)),
    ):
        mark_size[here & filled & (mark_size == 0)] = length
    bare_token = np.searchsorted(begin, head + mark_size)
    bare = np.where(bare_token < high, begin[np.minimum(bare_token, max(0, len(begin) - 1))], tail) if len(begin) else start
    between = lambda places: np.searchsorted(places, tail) - np.searchsorted(places, bare)

    # Rare marks: found once, then counted by line.
    rare = np.flatnonzero(flat.has(RARE))
    which, after = codes[rare], padded[rare + 1]
    lines = len(start)
    tally = lambda chosen: np.bincount(line_of(rare[chosen]), minlength=lines)
    comma, semi, bar, box, tab, angle = (which == ord(x) for x in ",;|│\t<")
    after_gap = (kinds[rare + 1] & SPACE) != 0
    separators = rare[(comma | semi) & after_gap]
    commas, semis = tally(comma), tally(semi)
    loose_commas, loose_semis = tally(comma & (after == 32)), tally(semi & (after == 32))
    before = codes[np.maximum(rare - 1, 0)]
    solid_before = (rare > 0) & solid[np.maximum(rare - 1, 0)]
    tabs = tally(tab & (solid_before | ~after_gap))
    single = np.zeros(lines, np.int64)
    np.maximum.at(single, line_of(rare[comma]), rare[comma])
    two_cells = (commas == 1) & (single - start <= 25) & (single > start) & (stop - single - 1 <= 25) & (stop - single > 1) & (head == start)
    two_cells &= solid[np.minimum(single + 1, len(codes) - 1)]
    wide = np.flatnonzero((begin[1:] - end[:-1] > 4) & (line_of(begin[1:]) == line_of(end[:-1]))) if len(begin) > 1 else np.zeros(0, np.int64)
    gaps = np.bincount(line_of(begin[wide]), minlength=lines)
    markup = tally(angle & ((after == ord("t")) | (after == ord("/")))) > 0
    markup[markup] = [bool(MARKUP_ROW.search(flat.text[s:e])) for s, e in zip(start[markup], stop[markup])]
    row = (
        (tally(box) >= 2) | (tally(bar) >= 2) | (tabs > 0) | (gaps > 0) | (filled & (head - start >= 8)) | markup
        | (semis > 0) & (loose_semis == 0) | (loose_commas == 0) & ((commas >= 2) | two_cells)
    )

    capital = flat.has(UPPER)
    shout = np.flatnonzero(capital[:-2] & capital[1:-1] & capital[2:])
    quoted = (which == 34) & ((after == 58) | after_gap & (padded[rare + 2] == 58))
    log = (tally(which == 61) >= 2) | (tally((which == ord("x")) & (before == 48)) > 0) | (tally(quoted) > 0)
    log |= np.bincount(line_of(shout), minlength=lines) > 0
    log |= (c[0] == ord("a")) & (c[1] == ord("t")) & (c[2] == 32) | np.isin(c[0], [91, 93, 123, 125]) & (tail - head <= 1)
    log &= filled
    log[log] = [bool(LOG_LINE.search(flat.text[s:e])) for s, e in zip(start[log], stop[log])]

    tokens = np.maximum(high - bare_token, 1)
    parts = between(separators) + 1
    item = (tokens <= 6) | (parts >= 4) & (tokens <= parts * 6) & (between(broken) == 0)
    shape = np.where(log, 1, np.where(row, 0, np.where(closed & (core >= bare), 3, np.where(item, 2, 3))))
    for k, name in enumerate(("table", "log", "item", "text")):
        out[f"{name}_chars"] = by_text(np.where(shape == k, weight, 0))
    out["markup_chars"] = by_text(np.where(markup, weight, 0))
    out["solid"] = by_text(weight)
    out["lines"], out["closed_lines"], out["bullet_lines"] = by_text(filled), by_text(closed), by_text(mark_size > 0)

    # Encodings read wrongly, and characters written as %41.
    odd = np.isin(which, [0xFFFD, 0xC3, 0xC2]) | np.isin(which, [0xE2, 0xF0, 0x178]) & (((after >= 0x80) & (after <= 0xBF)) | np.isin(after, [ord(x) for x in "€™©¼œž¢Ÿ"]))
    out["mojibake"] = flat.spread(odd.astype(np.int64), rare)
    percent = (which == 37) & ((kinds[rare + 1] & HEX) != 0) & ((kinds[rare + 2] & HEX) != 0)
    out["escapes"] = flat.spread(percent.astype(np.int64), rare)
    return out, kept, offsets


def smallest(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``KEEP`` + 1 smallest distinct 47-bit hashes of each text, and their offsets."""
    owner = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((hashes >> np.uint64(17), owner))
    value, owner = (hashes >> np.uint64(17))[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    begin = np.searchsorted(owner, np.arange(len(words)))
    keep = np.arange(len(value)) - begin[owner] <= KEEP
    sizes = np.bincount(owner[keep], minlength=len(words))
    return value[keep], np.concatenate([[0], np.cumsum(sizes)])


def merged(chunks: DataFrame) -> DataFrame:
    """Chunk counts to document counts: first per group of 64 chunks, then per document."""
    union = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, KEEP + 1)
    level = chunks.withColumn("part", F.floor(F.col("chunk_no") / 64))
    for keys in (("row_no", "doc_id", "part"), ("row_no", "doc_id")):
        level = level.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], union("kept").alias("kept"))
    return level


def text_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, counts): the sums of every document, huge ones by chunks."""
    documents = table(spark, folder, "documents").select("doc_id", "text").withColumn("row_no", F.monotonically_increasing_id())
    common = common_words(spark, folder)
    long = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    small = counts(documents.where(~long), common)
    spread = chunked(documents.where(long)).repartition("row_no", "chunk_no")
    large = merged(counts(spread, common))
    return small.select("doc_id", *SUMS, "kept").unionByName(large.select("doc_id", *SUMS, "kept"))


def kind_of() -> Column:
    """list, table, junk, or null for running prose and talk, from the sums."""
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    shaped = F.col("table_chars") + F.col("log_chars") + F.col("item_chars") + F.col("text_chars")
    share = lambda c: F.try_divide(F.col(c).cast("double"), shaped.cast("double"))
    few = (F.size("kept") <= 10) & (F.col("words") >= 8) & (F.col("words") >= 4 * F.size("kept"))
    cells = yes(share("table_chars") > 0.5)
    noise = (
        (F.col("solid") == 0)
        | yes(ratio("mojibake", "solid") > 0.1)
        | yes(ratio("escapes", "solid") * 3 > 0.3)
        | yes(ratio("hex_pairs", "tokens") > 0.5)
        | yes(ratio("long_chars", "solid") > 0.5)
        | yes(share("log_chars") > 0.5)
        | few
        | ((F.col("letters") >= 20) & yes(ratio("vowels", "letters") < 0.27) & yes(ratio("common", "words") < 0.1))
    )
    marks = yes(ratio("symbols", "solid") > 0.35) | yes(ratio("letters", "solid") < 0.3)
    salad = (
        (F.col("words") >= 12) & yes(ratio("common", "words") < 0.03) & (F.col("ends") * 40 < F.col("words"))
        & yes(ratio("words", "lines") > 12)
    )
    return (
        F.when(share("markup_chars") > 0.5, "table")  # its tags are long and have few vowels, and aren't noise
        .when(noise & ~(cells & ~few & (F.col("solid") > 0) & yes(ratio("long_chars", "solid") <= 0.5) & yes(ratio("vowels", "letters") >= 0.27)), "junk")
        .when(cells & yes(ratio("letters", "solid") + ratio("digits", "solid") >= 0.3), "table")
        .when(marks, "junk")
        .when(yes(share("item_chars") > 0.5), "list")
        .when(salad, "junk")
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, kind): documents that are for the most part a list, a table or junk."""
    return text_counts(spark, folder).select("doc_id", kind_of().alias("kind")).where("kind is not null")


def p8_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document with its kind (``prose`` for running prose and talk)."""
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return text_counts(spark, folder).select(
        "doc_id",
        F.col("chars").alias("n_chars"),
        F.col("words").alias("n_words"),
        F.col("lines").alias("n_lines"),
        part("letters", "words").alias("mean_word_length"),
        part("symbols", "solid").alias("symbol_ratio"),
        part("digits", "solid").alias("digit_ratio"),
        part("closed_lines", "lines").alias("closed_line_share"),
        part("bullet_lines", "lines").alias("bullet_line_share"),
        part("common", "words").alias("common_word_share"),
        F.coalesce(kind_of(), F.lit("prose")).alias("kind"),
    )
