"""Problem 3: the same or nearly the same record on both sides of the split.

Edit-distance segment join. A record is a sequence of words (a spec's word set in one
fixed order, an intent's words as they stand). The evaluation sequence is cut into
k+1 segments, k being the distance allowed; of two sequences within distance k at
least one segment stands unchanged in the other, shifted by at most k places. So the
segments are joined with the training substrings on a hash, pairs whose lengths or
places cannot fit are dropped inside the join, and the rest is verified by banded
dynamic programming and an exact check on the words.

For sets the distance counts words added and left out: Jaccard >= 3/4 is the same as a
symmetric difference of at most (a + b) / 7 for sets of a and b words. Measures that keep
the join small at any size:
- segments of a set have two or three words (one where a set is too small for that), placed
  by dynamic programming so that the expected number of hits is least (from word counts in a
  fixed number of hash buckets); words may stay outside all segments;
- every row carries a 128-bit parity sketch whose distance is never above the true one;
- a run whose words all stand in buckets of more than ``SALT_ROWS`` sets may be hot, so its key
  gets a salt: training rows take one salt, evaluation rows all of them. Both sides read the
  number of salts off the same bucket counts, so no pass over the keys is needed.
Equal sets are joined once and spread to their ids afterwards.

Defined results: a null or unknown split is no split; null lists and null entries are
empty; spellings of one split count as that split; a spec without any word and an intent paraphrase without any word match nothing;
rows with a null id are skipped; an id delivered again counts once per pair; an id is
never paired with itself. Extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkmill.plans.lineage import cut
from talkmill.sources.tables import table

LISTS = ("known_facts", "unknown_facts", "state_mutations", "contradictions", "callbacks")
TRAIN = ("train", "training", "trn", "trainset", "trainsplit")
VALIDATION = ("validation", "valid", "val", "dev", "devel", "development", "validate")
TEST = ("test", "testing", "tst", "testset", "testsplit", "eval", "evaluation", "heldout", "holdout")
SHARE = (3, 4)  # the least Jaccard similarity as a fraction
BUCKETS = 1 << 16
SIZES = (2, 3)  # words in a segment; k + 1 of two words fit into every set of more than SMALL words
SMALL = 3
SALT_ROWS = 50_000
MOST_SALTS = 1_024
KEYS = "key bigint, cid bigint, band int, pos int, size int, sketch_a bigint, sketch_b bigint"


def split_of(split: Column) -> Column:
    """train, validation or test under any spelling; null for no split."""
    name = F.lower(F.regexp_replace(split, r"[^\p{L}]", ""))
    return (
        F.when(name.isin(*TRAIN), F.lit("train")).when(name.isin(*VALIDATION), F.lit("validation")).when(name.isin(*TEST), F.lit("test"))
    )


def side_of(split: Column) -> Column:
    """train or eval from a split; null for no split."""
    return F.when(split == "train", F.lit("train")).when(split.isNotNull(), F.lit("eval"))


def spec_rows(specs: DataFrame) -> DataFrame:
    """(side, id, split, source, words, skey) of the specs with a split. No filter on the words here: it would compute them twice."""
    text = F.lower(F.concat_ws(" ", *LISTS))
    words = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))))
    part = split_of(F.col("split"))
    live = specs.where("id is not null").withColumn("__part", part).where("__part is not null")
    skey = F.unhex(F.md5(F.array_join(words, " ")))
    return live.select(side_of(F.col("__part")).alias("side"), "id", F.col("__part").alias("split"), "source", words.alias("words"), skey.alias("skey"))


def intent_rows(intents: DataFrame) -> DataFrame:
    """(side, id, split, source, words, skey) of the paraphrases with a word."""
    parts = []
    for side, column in (("train", "train"), ("eval", "held_out")):
        each = intents.where("name is not null").select("name", F.posexplode(column).alias("pos", "text"))
        plain = F.regexp_replace(F.regexp_replace(F.lower("text"), "[-‐‑]", " "), r"(?U)[^\p{L}\p{N}\s]", "")
        parts.append(
            each.select(
                F.lit(side).alias("side"),
                F.format_string(f"%s#{column}#%02d", "name", "pos").alias("id"),
                F.lit(column).alias("split"),
                F.col("name").alias("source"),
                F.regexp_extract_all(plain, F.lit(r"(?U)\S+"), F.lit(0)).alias("words"),
            )
        )
    rows = parts[0].unionByName(parts[1])
    return rows.where("size(words) > 0").withColumn("skey", F.unhex(F.md5(F.array_join("words", " "))))


def hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def spans(seq: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words of a flat array by the place of its first word."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    run = np.zeros(max(0, len(seq) - size + 1), np.uint64)
    for k in range(size):
        run = ((run * mix) ^ (seq[k : k + len(run)] + np.uint64(k + 1))) * mix
        run ^= run >> np.uint64(29)
    return run + np.uint64(size)


def sketches(seq: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each set: a word flips one, so sketches differ in at most as many bits as sets in words."""
    cell = owner * 128 + (seq & np.uint64(127)).astype(np.int64)
    bits = (np.bincount(cell, minlength=n * 128) & 1).astype(np.uint8).reshape(n, 128)
    packed = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    return packed[:, 0], packed[:, 1]


def cheapest_cuts(rarity: np.ndarray, sizes: np.ndarray, n: np.ndarray, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place ``n[i]`` disjoint runs in each sequence so that the sum of the runs' chances is least.

    ``rarity`` is one padded row a sequence. Gives (row, place, length) of all runs, by dynamic
    programming over the places of all rows at once.
    """
    rows, longest = rarity.shape
    most = int(n.max())
    best = np.full((longest + 1, rows, most + 1), np.inf)
    back = np.zeros((longest + 1, rows, most + 1), np.int8)
    best[:, :, 0] = 0.0
    for i in range(1, longest + 1):
        best[i, :, 1:] = best[i - 1, :, 1:]
        for length in lengths:
            if length > i:
                continue
            cost = best[i - length, :, :-1] + rarity[:, i - length : i].prod(1)[:, None]
            better = cost < best[i, :, 1:]
            best[i, :, 1:][better] = cost[better]
            back[i, :, 1:][better] = length
    at, left = sizes.copy(), n.copy()
    every = np.arange(rows)
    found = []
    while (left > 0).any():
        step = back[at, every, left].astype(np.int64)
        step[left == 0] = 0
        taken = (step > 0) & (left > 0)
        found.append((every[taken], (at - step)[taken], step[taken]))
        at = np.where(left > 0, np.where(taken, at - step, at - 1), at)
        left = left - taken
        assert (at >= 0).all()
    return tuple(np.concatenate(c) for c in zip(*found))


def set_keys(batches: Iterator[pa.RecordBatch], train: bool, share: np.ndarray, counts: np.ndarray, salt_rows: int) -> Iterator[pa.RecordBatch]:
    """Join keys of word sets (cid, seq): substrings of training sets, or segments of evaluation sets.

    ``band`` 0 holds for training sets no larger than the evaluation set (k = 2a/7),
    band 1 for larger ones (k = a/3); training substrings carry -1.
    """
    for batch in batches:
        for first in range(0, batch.num_rows, 2_000):
            part = batch.slice(first, 2_000)
            cid = part.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            seq = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            marks = sketches(seq, owner, len(sizes))
            bucket = (seq & np.uint64(BUCKETS - 1)).astype(np.int64)
            hashed = {k: spans(seq, k) for k in (1, *SIZES)}
            common = counts[bucket]  # a run stands in no more sets than the rarest of its words
            heat = {1: common, 2: np.minimum(common[:-1], common[1:])}
            heat[3] = np.minimum(heat[2][:-1], common[2:])
            places = np.arange(len(seq))
            chosen = []  # (band, place in the flat array, length)
            if train:
                inside = places - start[owner]
                for length in (1, *SIZES):
                    fits = inside + length <= sizes[owner]
                    if length == 1:  # only sets that a small evaluation set can be near to
                        fits &= sizes[owner] * SHARE[0] <= SMALL * SHARE[1]
                    at = places[fits]
                    chosen.append((np.full(len(at), -1), at, np.full(len(at), length)))
            else:
                order = np.argsort(sizes, kind="stable")
                for low in range(0, len(order), 200):  # of like sizes, so that padding stays small
                    rows = order[low : low + 200]
                    longest = int(sizes[rows].max())
                    rarity = np.full((len(rows), longest), np.inf)
                    filled = np.arange(longest)[None] < sizes[rows][:, None]
                    rarity[filled] = share[bucket[(start[rows][:, None] + np.arange(longest))[filled]]]
                    for band, n in ((0, 2 * sizes[rows] // 7 + 1), (1, sizes[rows] // 3 + 1)):
                        for small in (True, False):
                            these = np.flatnonzero((sizes[rows] <= SMALL) == small)
                            if len(these):
                                row, place, length = cheapest_cuts(rarity[these], sizes[rows[these]], n[these], (1,) if small else SIZES)
                                chosen.append((np.full(len(row), band), start[rows[these[row]]] + place, length))
            band, at, length = (np.concatenate(c) for c in zip(*chosen))
            key, warm = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
            for k in hashed:
                here = length == k
                key[here], warm[here] = hashed[k][at[here]], heat[k][at[here]]
            salts = np.minimum(warm // salt_rows + 1, MOST_SALTS)
            if train:
                salt = cid[owner[at]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) % salts.astype(np.uint64)
            else:
                total = int(salts.sum())
                salt = (np.arange(total) - np.repeat(np.cumsum(salts) - salts, salts)).astype(np.uint64)
                key, at, band = (np.repeat(c, salts) for c in (key, at, band))
            key = key + salt * np.uint64(0xA0761D6478BD642F)
            who = owner[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)), pa.array(cid[who]), pa.array(band.astype(np.int32)), pa.array((at - start[who]).astype(np.int32)),
                    pa.array(sizes[who].astype(np.int32)), pa.array(marks[0][who]), pa.array(marks[1][who]),
                ],
                names=["key", "cid", "band", "pos", "size", "sketch_a", "sketch_b"],
            )


def sequence_keys(batches: Iterator[pa.RecordBatch], train: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Join keys of word sequences for at most ``k`` words changed, added or left out."""
    for batch in batches:
        rows = []
        for cid, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
            seq = np.asarray(seq.values).view(np.uint64)
            a = len(seq)
            if train:
                wanted = set()
                for other in range(max(1, a - k), a + k + 1):
                    for place, length in even_cuts(other, k + 1):
                        for at in range(max(0, place - k), min(a - length, place + k) + 1):
                            wanted.add((at, length))
            else:
                wanted = set(even_cuts(a, k + 1))
            for place, length in sorted(wanted):  # the empty segment of a sequence shorter than k + 1 has one key for all
                rows.append((int(spans(seq[place : place + length], length).view(np.int64)[0]) if length else 7, cid, 0, place, a, 0, 0))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "cid", "band", "pos", "size", "sketch_a", "sketch_b"])


def even_cuts(size: int, n: int) -> list[tuple[int, int]]:
    """(place, length) of ``n`` segments of as equal length as can be."""
    base, more = divmod(size, n)
    cuts, at = [], 0
    for s in range(n):
        length = base + (1 if s >= n - more else 0)
        cuts.append((at, length))
        at += length
    return cuts


def banded(a: list[np.ndarray], b: list[np.ndarray], k: np.ndarray, change: int) -> np.ndarray:
    """Edit distances of pairs of sequences, or k + 1 where above k, all pairs row by row at once.

    ``change`` is the cost of a changed word: 1, or 2 to count it as one left out and one added.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band, far = int(k.max()), int(k.max()) + 1
    width = int(m.max())
    x, y = np.zeros((len(a), max(1, int(n.max()))), np.int64), np.zeros((len(a), max(1, width)), np.int64)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, : len(p)], y[i, : len(q)] = p, q
    steps = np.arange(width + 1)
    row = np.broadcast_to(np.where(steps <= band, steps, far), (len(a), width + 1)).copy()
    out = np.where(n == 0, row[np.arange(len(a)), m], far)
    for i in range(1, int(n.max()) + 1):
        low, high = max(1, i - band), min(width, i + band)
        new = np.full_like(row, far)
        if i <= band:
            new[:, 0] = i
        if low <= high:
            cells = np.minimum(row[:, low - 1 : high] + np.where(y[:, low - 1 : high] == x[:, i - 1 : i], 0, change), row[:, low : high + 1] + 1)
            cells = np.concatenate([new[:, low - 1 : low], cells], 1) - steps[low - 1 : high + 1]
            new[:, low : high + 1] = (np.minimum.accumulate(cells, 1) + steps[low - 1 : high + 1])[:, 1:]
        row = np.minimum(new, far)
        done = n == i
        out[done] = row[done, m[done]]
    return np.where(np.abs(n - m) > k, k + 1, np.minimum(out, k + 1))


def near(batches: Iterator[pa.RecordBatch], change: int) -> Iterator[pa.RecordBatch]:
    """The pairs (eval_cid, train_cid, k, e_seq, t_seq, e_words, t_words) within distance k, without k and the sequences."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            k = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            a, b = ([np.asarray(v.values) for v in part.column(c)] for c in (3, 4))
            fits = pa.array(banded(a, b, k, change) <= k)
            yield pa.RecordBatch.from_arrays([part.column(c).filter(fits) for c in (0, 1, 5, 6)], names=["eval_cid", "train_cid", "e_words", "t_words"])


def classes_of(rows: DataFrame, ordered: bool) -> DataFrame:
    """(cid, side, skey, words, seq) of the distinct word sets (``ordered``: in one fixed order) or sequences of each side, written, so that ids hold."""
    one = rows.where("size(words) > 0").select("side", "skey", "words").dropDuplicates(["side", "skey"])
    seq = F.sort_array(hashes("words")) if ordered else hashes("words")
    return cut(one.withColumn("cid", F.monotonically_increasing_id()).withColumn("seq", seq))


def joined(sets: DataFrame, cutter, fits: Column) -> DataFrame:
    """Distinct (eval_cid, train_cid) that share a segment hash and may fit. ``cutter(batches, train)`` gives the keys."""
    side = lambda name: sets.where(F.col("side") == name).select("cid", "seq").mapInArrow(lambda batches: cutter(batches, name == "train"), KEYS)
    e, t = side("eval").alias("e"), side("train").drop("band").alias("t")
    return (
        e.join(t.hint("merge"), (F.col("e.key") == F.col("t.key")) & fits)
        .select(F.col("e.cid").alias("eval_cid"), F.col("t.cid").alias("train_cid"))
        .distinct()
    )


def shift() -> Column:
    """Words that must have been added or left out before and after the shared segment."""
    return F.abs(F.col("e.pos") - F.col("t.pos")) + F.abs(
        (F.col("e.size") - F.col("e.pos")) - (F.col("t.size") - F.col("t.pos"))
    )


def verified(pairs: DataFrame, sets: DataFrame, k: Column, change: int) -> DataFrame:
    """Pairs within distance k by banded dynamic programming, with the words of both (eval_cid, train_cid, e_words, t_words)."""
    e = sets.where("side = 'eval'").select(F.col("cid").alias("eval_cid"), F.col("seq").alias("e_seq"), F.col("words").alias("e_words"))
    t = sets.where("side = 'train'").select(F.col("cid").alias("train_cid"), F.col("seq").alias("t_seq"), F.col("words").alias("t_words"))
    both = pairs.join(e.hint("merge"), "eval_cid").join(t.hint("merge"), "train_cid")
    both = both.select("eval_cid", "train_cid", k.alias("k"), "e_seq", "t_seq", "e_words", "t_words")
    return both.mapInArrow(lambda b: near(b, change), "eval_cid bigint, train_cid bigint, e_words array<string>, t_words array<string>")


def spec_pairs(classes: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(eval_cid, train_cid) of word sets with at least 3/4 of their union in common."""
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts, total = np.zeros(BUCKETS, np.int64), max(1, classes.count())
    for row in classes.select(F.explode("seq").alias("h")).groupBy(bucket.alias("b")).count().toLocalIterator():  # at most BUCKETS rows
        counts[row["b"]] = row["count"]
    share = np.clip(counts / total, 1.0 / total, 1.0)
    limit = F.floor((F.col("e.size") + F.col("t.size")) / F.lit(7))
    num, den = SHARE
    fits = (
        F.when(F.col("e.band") == 0, F.col("t.size") <= F.col("e.size")).otherwise(F.col("t.size") > F.col("e.size"))
        & (F.col("t.size") * den >= F.col("e.size") * num)
        & (F.col("e.size") * den >= F.col("t.size") * num)
        & (shift() <= limit)
        & (
            F.bit_count(F.col("e.sketch_a").bitwiseXOR(F.col("t.sketch_a")))
            + F.bit_count(F.col("e.sketch_b").bitwiseXOR(F.col("t.sketch_b")))
            <= limit
        )
    )
    k = F.floor((F.size("e_seq") + F.size("t_seq")) / F.lit(7)).cast("int")
    close = verified(joined(classes, lambda batches, train: set_keys(batches, train, share, counts, salt_rows), fits), classes, k, change=2)
    common = F.size(F.array_intersect("e_words", "t_words"))  # exact, on the words themselves
    union = F.size("e_words") + F.size("t_words") - common
    return close.where(common * den >= union * num).select("eval_cid", "train_cid")


def intent_pairs(classes: DataFrame, k: int = 1) -> DataFrame:
    """(eval_cid, train_cid) of word sequences at most ``k`` words apart."""
    fits = (F.abs(F.col("e.size") - F.col("t.size")) <= k) & (shift() <= k)
    pairs = joined(classes, lambda batches, train: sequence_keys(batches, train, k), fits)
    return verified(pairs, classes, F.lit(k), change=1).select("eval_cid", "train_cid")


def spread(pairs: DataFrame, classes: DataFrame, rows: DataFrame, tbl: str) -> DataFrame:
    """Pairs of ids from pairs of classes, with the evaluation side's split and source."""
    key = lambda side, name: classes.where(F.col("side") == side).select(F.col("cid").alias(f"{name}_cid"), F.col("skey").alias(f"{name}_key"))
    train = rows.where("side = 'train'").select(F.col("skey").alias("train_key"), F.col("id").alias("train_id")).distinct()
    held = rows.where("side = 'eval'").select(F.col("skey").alias("eval_key"), F.col("id").alias("eval_id"), "split", "source").distinct()
    keyed = pairs.join(key("eval", "eval"), "eval_cid").join(key("train", "train"), "train_cid").select("eval_key", "train_key")
    both = keyed.join(held, "eval_key").join(train, "train_key").where("train_id <> eval_id")
    return both.select(F.lit(tbl).alias("tbl"), "eval_id", "train_id", "split", "source")


def overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, eval_id, train_id, split, source) of all cross-split overlaps."""
    specs = cut(spec_rows(table(spark, folder, "latent_specs")))
    intents = intent_rows(table(spark, folder, "intents"))
    sets, sequences = classes_of(specs, ordered=True), classes_of(intents, ordered=False)
    return spread(spec_pairs(sets), sets, specs, "latent_specs").unionByName(spread(intent_pairs(sequences), sequences, intents, "intents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, left_key, right_key): each pair of a training and an evaluation record once, smaller key first."""
    return (
        overlaps(spark, folder)
        .select("tbl", F.least("eval_id", "train_id").alias("left_key"), F.greatest("eval_id", "train_id").alias("right_key"))
        .distinct()
    )


def p3_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, split, source, n_pairs, n_records): overlaps per split (validation, test, held_out) and source of the evaluation record."""
    return overlaps(spark, folder).groupBy("tbl", "split", "source").agg(
        F.countDistinct("eval_id", "train_id").alias("n_pairs"), F.countDistinct("eval_id").alias("n_records")
    )
