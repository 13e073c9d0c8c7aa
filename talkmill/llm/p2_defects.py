"""Problem 2: broken prompt and response pairs.

Every answer is cut into clauses, a linear-chain conditional random field tags each clause as
answer, refusal, echo, foreign, unfinished or blank, and the share of the answer's words that each
tag covers gives the pair's defect. ``empty`` and ``copy`` are confirmed by an exact check after the
tags; an answer without any word has no clause and is ``empty``.

What the tagger sees of a clause: its words and word pairs (hashed), the last open word and the
marks around it, its place and size, how many of its words stand in the question, and two kinds of
statistics of all texts:
- languages: word counts per language in a fixed number of hash buckets, the language of a
  talk being seeded by its common words;
- endings: how often a word stands inside, ends a text, or begins a longer word (counted by
  shuffles; joined to the answers on their last word, never collected).

The tables hold no labels. The field is trained on a bounded sample, ``SAMPLE`` pairs of at most
``SAMPLE_CHARS`` characters with the smallest hashes of their place, out of ``SAMPLE`` records
of each table, and on defects made from them:
the question given back, a text of another language, a phrase that declines (``phrases``), a marker, the
answer cut inside a word or after a word that must go on. Untouched answers are labelled sound,
whatever they look like, unless a field that did not see them finds them defective: those are left out.
No label is computed from the features. Statistics, candidates and tagging cover all rows.

Defined results: a null or blank answer is ``empty``; a missing or wordless question makes no
copy and no foreign answer; messages of other roles than the assistant's are no answers; null
arrays and null ids give no rows; equal rows each count; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.crf import LinearChain
from talkmill.llm.flat import CLOSER, PAUSE, SPACE, Flat, blocks, word_hashes
from talkmill.llm.phrases import DANGLING, DECLINE, FRAMES, GO_ON, MARKERS
from talkmill.plans.lineage import cut
from talkmill.sources.tables import table

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished", "blank")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, BLANK = range(6)
LANGS = ("en", "fr", "de", "es", "it", "pt")
BUCKETS = 1 << 16
SAMPLE = 4_000
SAMPLE_CHARS = 1_500
STEPS = (60, 30, 30)
DENSE = 34
WORDS = 1 << 17  # buckets of words and word pairs; those of last words lie beyond
HASHED = WORDS + (1 << 16)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SHIFT, _LAST = np.uint64(64 - 17), np.uint64(64 - 16)

MARKER = re.compile(r"[\W_]*(?:(?:" + "|".join(re.escape(m).replace("/", r"\W?") for m in MARKERS) + r")[\W_]*)+", re.I)


def plain(text: str | None) -> str:
    """Text with common letter forms and without apostrophes."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    for c in "'’‘`":
        text = text.replace(c, "")
    return text.replace("_", " ")


def words_of(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash, text) of every word."""
    first, last = flat.words(digits=True)
    return first, last, flat.hashes(first, last), np.searchsorted(flat.stops, first)


def open_ends(flat: Flat, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, open, core) of each text: its last word, whether no final mark closes it, and the place of its last solid character."""
    n = len(flat.stops)
    word = np.searchsorted(first, flat.stops) - 1
    held = (word >= 0) & (owner[np.maximum(word, 0)] == np.arange(n)) if len(first) else np.zeros(n, bool)
    place = np.arange(len(flat.codes))
    core = np.maximum.accumulate(np.where((flat.flags & (CLOSER | SPACE)) != 0, -1, place))[flat.stops]
    mark, before = flat.codes[np.maximum(core, 0)], flat.codes[np.maximum(core - 1, 0)]
    final = np.isin(mark, [ord(c) for c in "!?？！。"]) | ((mark == 46) & ~np.isin(before, [46, 0x2026]))
    return np.where(held, word, -1), held & ~(final & (core >= flat.starts)), core


def reduced(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ascending ``owner``."""
    out = np.zeros((n, values.shape[1]))
    if len(owner):
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[at]] = np.add.reduceat(values, at, axis=0, dtype=np.float64)
    return out


class CommonWords:
    """Votes for languages by a fixed list of common words."""

    def __init__(self, words: list[tuple[str, str]]):
        known = sorted({plain(w).lower() for _, w in words})
        hashes = word_hashes(known) if known else np.zeros(1, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {w: k for k, w in enumerate(known)}
        votes = np.zeros((max(1, len(known)), len(LANGS)))
        for lang, w in words:
            if lang in LANGS:
                votes[place[plain(w).lower()], LANGS.index(lang)] = 1
        self.votes = votes[order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.votes[at] * (self.hashes[at] == hashes)[:, None]

    def by_text(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(LANGS)))
        for low, high in blocks(texts):
            _, _, h, owner = words_of(Flat(texts[low:high]))
            out[low:high] = reduced(self.of(h), owner, high - low)
        return out


def elected(votes: np.ndarray) -> np.ndarray:
    """The language with most votes; -1 for a tie or none."""
    order = np.sort(votes, axis=1)
    return np.where(order[:, -1] > order[:, -2], votes.argmax(1), -1)


def common_words(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(lang, word) of the fixed list of common words, about 200, checked to be small."""
    rows = table(spark, folder, "common_words").where("word is not null and lang is not null").limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("common_words is a fixed list of at most 20,000 words")
    return [(r.lang, r.word) for r in rows]


def sources(spark: SparkSession, folder: str):
    """(tbl, frame) of the two nested tables: ids, roles and texts only."""
    roles = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    answers = F.transform("candidates", lambda c: c["content"])
    none = F.lit(None).cast("array<string>")
    for tbl, candidates in (("example_conversations", none), ("example_teacher_candidates", answers)):
        frame = table(spark, folder, tbl).where("id is not null")
        yield tbl, frame.select("id", roles.alias("messages"), candidates.alias("candidates"))


def messages_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list, pa.Array]:
    """(record, role, content) of all messages of a batch."""
    column = batch.column("messages")
    role, content = column.flatten().flatten()
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False), pc.utf8_lower(pc.utf8_trim_whitespace(role)), content


def vocabulary(spark: SparkSession, folder: str, common: list[tuple[str, str]]) -> DataFrame:
    """(h, word, inside, ends, open, c0..c5) of every word of all texts.

    ``inside`` counts the word before another word, ``ends`` as the last of a text, ``open`` tells that
    a text without a final mark ends on it, ``c0``.. count it in talks of each language. Each batch
    is counted before the shuffle, so a word that holds a third of all places is few rows.
    """
    langs = len(LANGS)
    schema = "h bigint, word string, inside bigint, ends bigint, open boolean, " + ", ".join(f"c{k} bigint" for k in range(langs))

    def count(batches):
        seeds = CommonWords(common)
        for batch in batches:
            record, _, content = messages_of(batch)
            texts = [plain(t) for t in content.to_pylist()]
            talk = elected(reduced(seeds.by_text(texts), record, batch.num_rows))[record] if len(texts) else np.zeros(0, int)
            more = [plain(t) for t in batch.column("candidates").flatten().to_pylist()]
            texts, talk = texts + more, np.concatenate([talk, np.full(len(more), -1)])
            for low, high in blocks(texts, 1 << 20):
                flat = Flat(texts[low:high])
                first, last, h, owner = words_of(flat)
                if not len(first):
                    continue
                word, is_open, _ = open_ends(flat, first, owner)
                final = np.zeros(len(first), bool)
                final[word[word >= 0]] = True
                opened = np.zeros(len(first), bool)
                opened[word[is_open]] = True
                kinds, at, slot = np.unique(h, return_index=True, return_inverse=True)
                tally = lambda mask: np.bincount(slot[mask], minlength=len(kinds)).astype(np.int64)
                lang = talk[low:high][owner]
                columns = [kinds.view(np.int64), pa.array([flat.text[first[i] : last[i] + 1].lower() for i in at]), tally(~final), tally(final), tally(opened) > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*columns, *(tally(lang == k) for k in range(langs)))], names=["h", "word", "inside", "ends", "open", *(f"c{k}" for k in range(langs))]
                )

    parts = [frame.mapInArrow(count, schema) for _, frame in sources(spark, folder)]
    sums = [F.sum(c).alias(c) for c in ("inside", "ends")] + [F.max("open").alias("open")] + [F.sum(f"c{k}").alias(f"c{k}") for k in range(langs)]
    return cut(parts[0].unionByName(parts[1]).groupBy("h").agg(F.min("word").alias("word"), *sums))


def language_table(words: DataFrame) -> np.ndarray:
    """Log likelihood of each hash bucket below its best language, at most 4: at most ``BUCKETS`` rows reach the driver."""
    counts = np.zeros((BUCKETS, len(LANGS)))
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")
    for r in words.groupBy(bucket).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(LANGS))]).toLocalIterator():
        counts[r["b"]] = r[1:]
    log = np.log((counts + 0.3) / (counts.sum(0) + 0.3 * BUCKETS))
    # Names and numbers are as common in all languages and so tell nothing.
    return (np.maximum(log - log.max(1, keepdims=True), -4.0) * (counts.sum(1) >= 3)[:, None]).astype(np.float32)


def endings(spark: SparkSession, words: DataFrame, made: list[int]) -> DataFrame:
    """(h, inside, ends, longer) of the words that end some open text, and of the hashes ``made`` for training.

    ``longer`` counts the places of longer words that begin with the word and are known (some place inside
    a text, or five ends).
    """

    def prefixes(batches):
        for batch in batches:
            texts, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for low, high in blocks(texts):
                flat = Flat(texts[low:high])
                sizes = np.maximum(flat.stops - flat.starts - 1, 0)  # proper prefixes of each word
                owner = np.repeat(np.arange(len(sizes)), sizes)
                start = flat.starts[owner]
                stop = start + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
                h, slot = np.unique(flat.hashes(start, stop), return_inverse=True)
                n = np.bincount(slot, counts[low:high][owner], minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    known = words.where("inside > 0 or ends >= 5").select("word", (F.col("inside") + F.col("ends")).alias("n"))
    longer = known.mapInArrow(prefixes, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("longer"))
    wanted = words.where("open").select("h").unionByName(spark.createDataFrame([(h,) for h in made], "h bigint")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cut(wanted.join(words.select("h", "inside", "ends"), "h", "left").join(longer, "h", "left").select("h", zero("inside"), zero("ends"), zero("longer")))


def answers(spark: SparkSession, folder: str, common: list[tuple[str, str]], records: int | None = None) -> DataFrame:
    """(tbl, rec_id, pos, question, answer, talk, last) of every answer; ``last`` is the hash of an open last word.

    ``records`` keeps those of each table with the smallest hashes of their ids, for the training sample only.
    """
    out = None
    for tbl, frame in sources(spark, folder):
        if records is not None:
            frame = frame.orderBy(F.xxhash64("id"), "id").limit(records)

        def unfold(batches, tbl=tbl):
            seeds = CommonWords(common)
            for batch in batches:
                record, role, content = messages_of(batch)
                said = content.to_pylist()
                asks = np.asarray(pc.fill_null(pc.equal(role, "user"), False))
                users = np.flatnonzero(asks)
                votes = np.zeros((batch.num_rows, len(LANGS)))
                if len(users):
                    votes = reduced(seeds.by_text([plain(said[i]) for i in users]), record[users], batch.num_rows)
                talk = elected(votes)
                first = np.searchsorted(record, np.arange(batch.num_rows))
                if tbl == "example_conversations":
                    chosen = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(role, "assistant"), False)))
                    whose, pos = record[chosen], chosen - first[record[chosen]]
                    near = np.maximum.accumulate(np.where(asks, np.arange(len(asks)), -1))[chosen] if len(chosen) else chosen
                    asked = [said[q] if q >= f else None for q, f in zip(near, first[whose])]
                    given = [said[i] for i in chosen]
                else:
                    column = batch.column("candidates")
                    given, whose = column.flatten().to_pylist(), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
                    pos = np.arange(len(whose)) - np.searchsorted(whose, whose)
                    final = np.searchsorted(record, np.arange(batch.num_rows), "right") - 1
                    asked = [said[q] if q >= f else None for q, f in zip(final[whose], first[whose])]
                last = np.zeros(len(given), np.int64)
                is_open = np.zeros(len(given), bool)
                texts = [plain(t) for t in given]
                for low, high in blocks(texts):
                    flat = Flat(texts[low:high])
                    start, _, h, owner = words_of(flat)
                    word, is_open[low:high], _ = open_ends(flat, start, owner)
                    if len(h):
                        last[low:high] = h.view(np.int64)[np.maximum(word, 0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tbl] * len(given), pa.string()), batch.column("id").take(pa.array(whose)), pa.array(pos.astype(np.int32)), pa.array(asked, pa.string()),
                        pa.array(given, pa.string()), pa.array(talk[whose].astype(np.int32)), pa.array(last, mask=~is_open),
                    ],
                    names=["tbl", "rec_id", "pos", "question", "answer", "talk", "last"],
                )

        part = frame.mapInArrow(unfold, "tbl string, rec_id string, pos int, question string, answer string, talk int, last bigint")
        out = part if out is None else out.unionByName(part)
    return out


class Clauses:
    """The clauses of a block of answers and their features.

    ``x`` are dense features of each clause, ``bucket`` hashed ones of the clauses ``place``; ``lengths``
    counts the clauses of each answer, ``weight`` the words of each clause, ``copied`` tells that all words
    of the question stand in the answer with at most three others.
    """

    def __init__(self, questions: list[str], given: list[str], talk: np.ndarray, ending: np.ndarray, langs: np.ndarray):
        n = len(given)
        a, q = Flat(given), Flat(questions)
        first, last, h, owner = words_of(a)
        _, _, qh, q_owner = words_of(q)
        n_said, n_asked = np.bincount(owner, minlength=n), np.bincount(q_owner, minlength=n)
        segment = np.cumsum(a.has(PAUSE))[first]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
        clause = np.cumsum(fresh) - 1
        self.owner = owner[fresh]
        self.lengths = np.bincount(self.owner, minlength=n)
        count = len(self.owner)
        self.weight = np.bincount(clause, minlength=count)

        # Words of the question given back.
        mine = h + owner.astype(np.uint64) * _ODD[0]
        theirs, at, asked_n = np.unique(qh + q_owner.astype(np.uint64) * _ODD[0], return_index=True, return_counts=True)
        said, said_n = np.unique(mine, return_counts=True)
        back, matched = np.zeros(len(h), bool), np.zeros(n)
        if len(said) and len(theirs):
            slot = np.minimum(np.searchsorted(said, theirs), len(said) - 1)
            both = np.where(said[slot] == theirs, np.minimum(asked_n, said_n[slot]), 0)
            matched = np.bincount(q_owner[at], both, minlength=n)
            slot = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            back = theirs[slot] == mine
        covered = matched / np.maximum(n_asked, 1)
        self.copied = (n_asked > 0) & (matched == n_asked) & (n_said - n_asked <= 3)
        echo = np.bincount(clause, back, minlength=count) / np.maximum(self.weight, 1)

        # Languages: how far behind its best one the clause and the answer are in the question's.
        mask = np.uint64(BUCKETS - 1)
        here = reduced(langs[(h & mask).astype(np.int64)], clause, count)
        whole = reduced(here, self.owner, n)
        asked = reduced(langs[(qh & mask).astype(np.int64)], q_owner, n)
        order = np.sort(asked, axis=1)
        home = np.where(order[:, -1] - order[:, -2] > 2, asked.argmax(1), talk)
        gap = lambda s, of: np.where(of >= 0, s.max(1) - np.take_along_axis(s, np.maximum(of, 0)[:, None], 1)[:, 0], 0.0)
        clause_away, away = gap(here, home[self.owner]), gap(whole, home)[self.owner]

        word, is_open, core = open_ends(a, first, owner)
        closing = np.concatenate([self.owner[1:] != self.owner[:-1], [True]]) if count else np.zeros(0, bool)
        opening = np.concatenate([[True], self.owner[1:] != self.owner[:-1]]) if count else np.zeros(0, bool)
        end = np.flatnonzero(closing)
        of = self.owner[end]
        end, of = end[is_open[of]], of[is_open[of]]  # last clauses of open answers
        x = self.x = np.zeros((count, DENSE))
        x[:, 0], x[:, 1], x[:, 2], x[:, 3] = 1, opening, closing, opening & closing
        x[:, 4], x[:, 5], x[:, 6], x[:, 7] = echo, echo > 0.999, covered[self.owner] > 0.8, self.copied[self.owner]
        for k, limit in enumerate((1, 3)):
            x[:, 8 + k] = clause_away > limit
        for k, limit in enumerate((1, 2, 4, 8, 16)):
            x[:, 10 + k] = away > limit
        x[:, 15] = np.minimum(away / np.maximum(n_said[self.owner], 1), 2)
        x[:, 16], x[:, 17] = self.weight <= 2, n_said[self.owner] <= 3
        x[end, 18] = 1
        inside, ends, longer = ending[of].T
        rarer, inner = np.log2((inside + ends + 0.5) / (longer + 0.5)), np.log2((ends + 0.5) / (inside + 0.5))
        begins = longer >= 3
        for k, seen in enumerate((rarer < -1.5, rarer < -4, rarer < -6.6)):
            x[end, 19 + k] = begins & seen
            x[end, 22 + k] = begins & seen & (inside == 0)
        for k, limit in enumerate((-1, -3, -5, -7, -9)):
            x[end, 25 + k] = inner < limit
        quotes = a.sums(a.codes == 34)
        x[end, 30] = quotes[of] % 2
        w = word[of]
        x[end, 31] = core[of] > last[w] if len(last) else 0
        x[:, 32] = np.minimum(self.lengths[self.owner], 8) / 8

        marks = lambda codes, odd: (codes.astype(np.uint64) * odd + odd) * _ODD[0] >> _SHIFT
        pair = np.flatnonzero(~fresh)
        parts = [(h * _ODD[1] >> _SHIFT, clause), ((h[pair - 1] * _ODD[2] + h[pair]) * _ODD[1] >> _SHIFT, clause[pair])]
        if len(end):
            tail = np.where(core[of] > last[w], a.codes[np.maximum(core[of], 0)], 0)
            lead = np.where(first[w] > a.starts[of], a.codes[np.maximum(first[w] - 1, 0)], 0)
            parts += [((h[w] * _ODD[3] >> _LAST) + np.uint64(WORDS), end), (marks(tail, _ODD[4]), end), (marks(lead, _ODD[3]), end)]
        self.bucket = np.concatenate([b for b, _ in parts]).astype(np.int64)
        self.place = np.concatenate([p for _, p in parts])


def tagged(field: LinearChain, clauses: Clauses, given: list[str]) -> tuple[list[str | None], np.ndarray]:
    """(defect or null, share of words by tag) of each answer of a block."""
    n = len(given)
    tags = field.decode(field.scores(clauses.x, clauses.bucket, clauses.place), clauses.lengths).astype(np.int64)
    cover = np.bincount(clauses.owner * len(LABELS) + tags, clauses.weight, minlength=n * len(LABELS)).reshape(n, -1)
    cover /= np.maximum(cover.sum(1, keepdims=True), 1)
    final = np.zeros(n, bool)
    closing = np.cumsum(clauses.lengths) - 1
    some = clauses.lengths > 0
    final[some] = tags[closing[some]] == UNFINISHED
    defect: list[str | None] = [None] * n
    for i in np.flatnonzero(~some | final | (cover[:, REFUSAL:] >= 0.3).any(1)):
        if not some[i] or cover[i, BLANK] >= 0.5 and MARKER.fullmatch(given[i].strip()):
            defect[i] = "empty"
        elif cover[i, ECHO] >= 0.5 and clauses.copied[i]:
            defect[i] = "copy"
        elif cover[i, REFUSAL] >= 0.3:
            defect[i] = "refusal"
        elif cover[i, FOREIGN] >= 0.5:
            defect[i] = "other_language"
        elif final[i]:
            defect[i] = "truncated"
    return defect, cover


def made_defects(sample: list[tuple[str, str, int]]) -> list[tuple[str, str, int, int, int]]:
    """(question, answer, talk, label, pair) of defects, and some sound answers, made from the sample's pairs; label 4 holds for the last clause only."""
    by_lang: dict[int, list[str]] = {}
    asked: dict[int, list[str]] = {}
    for q, a, talk in sample:
        by_lang.setdefault(talk, []).append(a)
        asked.setdefault(talk, []).append(q)
    word = re.compile(r"[^\W_]+")
    out = []
    for i, (q, a, talk) in enumerate(sample):
        draw = np.random.default_rng(zlib.crc32(f"{i}\x00{q}\x00{a}".encode()))
        pick = lambda xs: xs[draw.integers(len(xs))]
        kind = draw.integers(8)
        lang = LANGS[talk] if talk >= 0 else "en"
        if kind == 0:
            echo = (q, f"{q}.", f"question: {q}", q.upper(), q.title(), f"{q} ok", f"you said {q}", f"{q} ?")
            out.append((q, pick(echo), talk, ECHO, i))
        elif kind == 1 and talk >= 0:
            out.append((q, pick(asked[talk]), talk, ANSWER, i))  # beside the point, but no defect
            others = [k for k in by_lang if k >= 0 and k != talk]
            if others:
                out.append((q, pick(by_lang[pick(others)]), talk, FOREIGN, i))
        elif kind in (2, 3):
            found = list(word.finditer(a))
            deep = [m for m in found[1:] if len(m.group()) >= 4]
            if deep:
                m = pick(deep)
                out.append((q, a[: m.start() + draw.integers(2, len(m.group()))], talk, UNFINISHED, i))
            # Closing dots, numbers or no final mark alone are no defect.
            out.append((q, a.rstrip(" .!?…") + pick(("", "...", "…", " …", f" {draw.integers(1, 99)}", "!")), talk, ANSWER, i))
            if len(found) >= 2:
                m = pick(found[1:])
                for more in (1, 2) if lang == "en" else (1, 2, 1, 2):
                    tail = " ".join(pick(GO_ON[lang]) for _ in range(draw.integers(1, more + 1)))
                    out.append((q, f"{a[: m.end()]} {tail}{pick(('', '', ' ', '...'))}", talk, UNFINISHED, i))
                body = a[: m.end()] if draw.random() < 0.5 else a.rstrip(" .!?…")
                out.append((q, body + pick(DANGLING).replace("{}", pick(found).group()), talk, UNFINISHED, i))
        elif kind == 4:
            mark = pick(FRAMES).format(pick(MARKERS))
            out.append((q, pick((mark, mark.upper(), mark.title())), talk, BLANK, i))
        elif kind >= 5:
            before, acts, sentences, openers, closers = (part.split("|") for part in DECLINE[lang])
            topic = [m.group() for m in word.finditer(q)] or ["that"]
            for _ in range(2 if lang == "en" else 3):  # languages with few pairs get more of them
                core = f"{pick(before)} {pick(acts)}" if draw.random() < 0.5 else pick(sentences)
                text = pick(openers) + core + pick(closers)
                out.append((q, text.replace("{}", pick(topic)), talk, REFUSAL, i))
    return out


def trained(sample: list[tuple[str, str, int]], made: list[tuple[str, str, int, int, int]], look: dict[int, tuple[int, int, int]], langs: np.ndarray) -> LinearChain:
    """Fit the field: untouched pairs as sound, made ones by their label, in three rounds."""
    pairs = [(q, a, talk, ANSWER, i) for i, (q, a, talk) in enumerate(sample)] + made
    given, asked = [plain(p[1]) for p in pairs], [plain(p[0]) for p in pairs]
    label, origin = np.array([p[3] for p in pairs]), np.array([p[4] for p in pairs])
    ending = np.array([look.get(h, (0, 0, 0)) for h in last_hashes(given)], float)
    ending[len(sample) :, 1] = np.maximum(ending[len(sample) :, 1], 1)  # it ends its own text
    clauses = Clauses(asked, given, np.array([p[2] for p in pairs]), ending, langs)
    truth = label[clauses.owner]
    closing = np.zeros(len(truth), bool)
    closing[np.cumsum(clauses.lengths)[clauses.lengths > 0] - 1] = True
    truth[(truth == UNFINISHED) & ~closing] = ANSWER
    # The first round sees half of the untouched pairs and judges the others, the second sees those found sound and judges
    # the first half, the third sees all found sound: no unlabelled defect, nor anything made from it, speaks for itself.
    # An answer given word for word to three different questions is not cut off, whatever a field says.
    askers: dict[str, set[str]] = {}
    for q, a in zip(asked[: len(sample)], given):
        askers.setdefault(a.lower(), set()).add(q.lower())
    stock = np.array([len(askers[a.lower()]) >= 3 for a in given[: len(sample)]], bool)
    half = np.arange(len(sample)) % 2 == 0
    sound = np.ones(len(sample), bool)
    field = LinearChain(len(LABELS), DENSE, HASHED)
    for steps, seen in zip(STEPS, (half, ~half, half | ~half)):
        keep = (label != ANSWER) | (seen & sound)[origin]
        rows = keep[clauses.owner]
        place = np.cumsum(rows) - 1
        used = rows[clauses.place]
        field.fit(clauses.x[rows], clauses.bucket[used], place[clauses.place[used]], truth[rows], clauses.lengths[keep], steps, loose=WORDS)
        defect, _ = tagged(field, clauses, given)
        sound = np.where(seen, sound, [d is None or d == "truncated" and s for d, s in zip(defect, stock)])
    return field


def last_hashes(texts: list[str]) -> list[int]:
    """Hash of each text's open last word; 0 for closed texts."""
    out = []
    for low, high in blocks(texts):
        flat = Flat(texts[low:high])
        first, _, h, owner = words_of(flat)
        word, is_open, _ = open_ends(flat, first, owner)
        out += [int(h.view(np.int64)[w]) if o else 0 for w, o in zip(word, is_open)]
    return out


def sampled(pairs: DataFrame) -> list[tuple[str, str, int]]:
    """The ``SAMPLE`` pairs with the smallest hashes among those of bounded length that have words on both sides."""
    short = pairs.where(rf"question rlike '\\w' and answer rlike '\\w' and length(question) + length(answer) <= {SAMPLE_CHARS}")
    best = short.orderBy(F.xxhash64("tbl", "rec_id", "pos"), "tbl", "rec_id", "pos").limit(SAMPLE)
    return [(r.question, r.answer, r.talk) for r in best.select("question", "answer", "talk").collect()]


def with_endings(pairs: DataFrame, known: DataFrame, hot_share: int = 1000) -> DataFrame:
    """Adds (inside, ends, longer) of the open last word; null for closed answers.

    Words that end more than 1/``hot_share`` of the open texts are fewer than ``hot_share`` and are
    broadcast. One shuffle join serves the other words; rows that need nothing from it (closed
    answers, hot words) get keys of their own, so that no task takes them all.
    """
    total = known.agg(F.sum("ends").alias("total"))
    stats = F.struct("inside", "ends", "longer")
    hot = known.join(F.broadcast(total), F.col("ends") * hot_share > F.col("total")).select(F.col("h").alias("last"), stats.alias("hot"))
    first = pairs.join(F.broadcast(hot), "last", "left")
    apart = F.col("last").isNull() | F.col("hot").isNotNull()
    keyed = first.withColumn("h", F.when(apart, F.xxhash64("tbl", "rec_id", "pos")).otherwise(F.col("last")))
    both = keyed.join(known.select("h", stats.alias("cold")).hint("merge"), "h", "left")
    e = F.when(F.col("last").isNotNull(), F.coalesce("hot", "cold"))
    return both.withColumn("e", e).select("tbl", "rec_id", "pos", "question", "answer", "talk", "e.inside", "e.ends", "e.longer")


def field_of(spark: SparkSession, folder: str):
    """(field, language table, endings, pairs): the trained tagger and what it needs."""
    common = common_words(spark, folder)
    words = vocabulary(spark, folder, common)
    langs = language_table(words)
    pairs = answers(spark, folder, common)
    sample = sampled(answers(spark, folder, common, SAMPLE))
    made = made_defects(sample)
    wanted = {h for h in last_hashes([plain(a) for _, a, *_ in sample + made]) if h}
    known = endings(spark, words, sorted(wanted))
    look = {}
    if wanted:  # no more than a few for each pair of the sample
        asked = F.broadcast(spark.createDataFrame([(h,) for h in sorted(wanted)], "h bigint"))
        look = {r.h: (r.inside, r.ends, r.longer) for r in known.join(asked, "h", "left_semi").collect()}
    field = trained(sample, made, look, langs) if sample else LinearChain(len(LABELS), DENSE, HASHED)
    return field, langs, known, pairs


def p2_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, rec_id, pos, defect, n_clauses, refusal, echo, foreign, unfinished): every answer with the share of its words under each tag."""
    field, langs, known, pairs = field_of(spark, folder)
    names = ("refusal", "echo", "foreign", "unfinished")

    def tag(batches):
        for batch in batches:
            asked, given = ([plain(t) for t in batch.column(c).to_pylist()] for c in ("question", "answer"))
            talk = batch.column("talk").to_numpy()
            ending = np.stack([batch.column(c).fill_null(0).to_numpy() for c in ("inside", "ends", "longer")], 1).astype(float)
            found, parts, shares = [], [], []
            for low, high in blocks([*map(str.__add__, asked, given)]):
                clauses = Clauses(asked[low:high], given[low:high], talk[low:high], ending[low:high], langs)
                defect, cover = tagged(field, clauses, given[low:high])
                found += defect
                parts.append(clauses.lengths)
                shares.append(cover)
            if not found:
                continue
            cover = np.concatenate(shares)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("tbl", "rec_id", "pos")), pa.array(found, pa.string()), pa.array(np.concatenate(parts).astype(np.int32)),
                    *(pa.array(cover[:, LABELS.index(k)]) for k in names),
                ],
                names=["tbl", "rec_id", "pos", "defect", "n_clauses", *names],
            )

    schema = "tbl string, rec_id string, pos int, defect string, n_clauses int, " + ", ".join(f"{k} double" for k in names)
    return with_endings(pairs, known).mapInArrow(tag, schema)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, rec_id, pos, defect): each defective answer with its type."""
    return p2_tagged(spark, folder).where("defect is not null").select("tbl", "rec_id", "pos", "defect")
