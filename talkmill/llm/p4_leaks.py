"""Problem 4: passages of held-out items inside documents and talks.

Pigeonhole edit matching on words. An item leaks where ``run`` successive words of it
stand in a text with at most ``budget`` word edits. A window of ``run`` words with at
most ``budget`` edits keeps one of ``budget + 1`` pieces whole, so every item is cut
into pieces that each such window holds entirely, the pieces' exact hits are found by one
Aho-Corasick pass over each text, and each hit is verified by Myers' bit-parallel
distance between the item's windows around the piece and the text around the hit.

The texts are never shuffled: the items (a fixed set, 300 here) go to every task in
blocks of at most ``ITEM_BLOCK`` items and ``ITEM_CHARS`` characters (an item above that is a
block alone); more items mean more passes, not a larger broadcast. The driver holds one block
at a time: with more than one, each pass is written before the next block is read.

Defined results: words are runs of letters and digits after NFKC, lower case, and removal
of apostrophes and invisible characters; a null or blank text or item has no words; items
with fewer than ``run`` words can't leak; null identifiers are skipped; equal items each
count; a run crosses neither messages nor the two columns of an item, with or without edits; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.plans.lineage import cut
from talkmill.sources.tables import table

ITEM_BLOCK = 20_000
ITEM_CHARS = 32_000_000
#: Stands between messages; a word of its own that no item can hold.
BREAK = "\x00"
#: Removed before words are cut: apostrophes of all shapes.
APOSTROPHES = "'`´‘’‚‛ʹʻʼʽˈˊˋ′‵＇"

_ASCII = bytes(c if c == 0 or chr(c).isalnum() else 32 for c in range(128)).lower() + bytes([32]) * 128
_GAP = re.compile(r"[\W_]+")
_APOSTROPHE = re.compile(f"[{APOSTROPHES}]")
#: Apostrophes and invisible characters (soft hyphen, joiners, marks of direction and variation).
_HIDDEN = re.compile(f"[{APOSTROPHES}­؀-؅؜۝܏᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿￹-￻]")


def word_text(text: str) -> str:
    """The words of a text with one space before and after each; ``BREAK`` stays a word."""
    if text.isascii():
        plain = text.encode().translate(_ASCII, b"'`").decode()
    else:
        plain = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))  # may bring up new apostrophes
        plain = _APOSTROPHE.sub("", plain).lower()
        plain = f" {BREAK} ".join(_GAP.sub(" ", part) for part in plain.split(BREAK)) if BREAK in plain else _GAP.sub(" ", plain)
    return f" {' '.join(plain.split())} "


def pieces(words: list[str], run: int, budget: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: any ``run``-word window holds ``budget + 1`` of them whole."""
    # Aligned pieces of length p, one every p words: a window of (b + 2) * p - 1 words holds b + 1.
    size = max(1, (run + 1) // (budget + 2))
    for start in range(0, len(words) - size + 1, size):
        yield start, size


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of the pattern to any part of the text (words as letters)."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for w in text:
        x = eq.get(w, 0)
        d0 = (((x & pv) + pv) ^ pv) | x | mv
        ph, mh = mv | ~(d0 | pv) & mask, pv & d0
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask  # a match may begin anywhere in the text
        pv, mv = mh | ~(d0 | ph) & mask, ph & d0
        best = min(best, score)
    return best


class Matcher:
    """Finds the items that stand in a text; built once per task."""

    def __init__(self, items: list[tuple[int, str]], run: int, budget: int):
        import ahocorasick

        self.run, self.budget = run, budget
        self.items = [i for i, _ in items]
        self.words = [word_text(text).split() for _, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(self.words):
            if len(words) >= run:
                for start, size in pieces(words, run, budget):
                    places.setdefault(f" {' '.join(words[start : start + size])} ", []).append((i, start))
        self.automaton = None
        if places:
            self.automaton = ahocorasick.Automaton()
            for piece, at in places.items():
                self.automaton.add_word(piece, (len(piece), piece.count(" ") - 1, at))
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Item -> least number of word edits, over the items within the budget."""
        found: dict[int, int] = {}
        if not self.automaton:
            return found
        plain = word_text(text)
        run, budget = self.run, self.budget
        for end, (chars, size, at) in self.automaton.iter(plain):
            around = None
            for entry, start in at:
                item = self.items[entry]
                if found.get(item) == 0:
                    continue
                if around is None:  # the words of the text that a window with the piece can reach
                    first = end + 1 - chars
                    reach = run + budget - size
                    left, right = before(plain, first + 1, reach), after(plain, end, reach)
                    if BREAK in left:
                        left = left[len(left) - left[::-1].index(BREAK) :]
                    if BREAK in right:
                        right = right[: right.index(BREAK)]
                    around = [*left, *plain[first + 1 : end].split(" "), *right]
                words = self.words[entry]
                if budget == 0 and run > size:  # an exact longer run also has the word on one side of the piece
                    stop = start + size
                    if not (
                        start > 0 and left and words[start - 1] == left[-1] or stop < len(words) and right and words[stop] == right[0]
                    ):
                        continue
                for s in range(max(0, start + size - run), min(start, len(words) - run) + 1):
                    errors = myers(words[s : s + run], around)
                    if errors <= budget and errors < found.get(item, budget + 1):
                        found[item] = errors
        return found


def before(plain: str, at: int, n: int) -> list[str]:
    """Up to ``n`` words that end just before position ``at``."""
    p = at - 1
    for _ in range(n):
        q = plain.rfind(" ", 0, p)
        if q < 0:
            break
        p = q
    return plain[p:at].split()


def after(plain: str, at: int, n: int) -> list[str]:
    """Up to ``n`` words that begin just after position ``at``."""
    p = at
    for _ in range(n):
        q = plain.find(" ", p + 1)
        if q < 0:
            break
        p = q
    return plain[at:p].split()


def leaks(records: DataFrame, items: list[tuple[int, str]], run: int, budget: int) -> DataFrame:
    """(tbl, rec_id, item_id, errors) of records (tbl, rec_id, text) that hold an item of the list."""
    schema = pa.schema([("tbl", pa.string()), ("rec_id", pa.string()), ("item_id", pa.int64()), ("errors", pa.int32())])

    def search(batches):
        matcher = Matcher(items, run, budget)
        for batch in batches:
            rows = []
            for tbl, rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for item, errors in matcher.find(text.as_py()).items():
                    rows.append((tbl, rec, item, errors))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return records.mapInArrow(search, "tbl string, rec_id string, item_id bigint, errors int")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, rec_id, text) of documents and talks; a talk's messages are kept apart by ``BREAK``."""
    documents = table(spark, folder, "documents").where("doc_id is not null and text is not null")
    talks = table(spark, folder, "example_conversations").where("id is not null and messages is not null")
    texts = F.transform("messages", lambda m: F.translate(F.coalesce(m["content"], F.lit("")), BREAK, " "))
    return documents.select(
        F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), F.translate("text", BREAK, " ").alias("text")
    ).unionByName(
        talks.select(F.lit("example_conversations").alias("tbl"), F.col("id").alias("rec_id"), F.array_join(texts, f" {BREAK} ").alias("text"))
    )


def held_out(spark: SparkSession, folder: str) -> Iterator[list[tuple[int, str]]]:
    """The held-out passages (item_id, text) in blocks; an item with both columns gives two."""
    frozen = table(spark, folder, "elaboration_frozen").where("item_id is not null")
    texts = frozen.select("item_id", F.explode(F.array("known", "unknown")).alias("text")).where("text is not null")
    rows = texts.select("item_id", F.translate("text", BREAK, " ").alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and (len(block) == ITEM_BLOCK or size + len(row.text) > ITEM_CHARS):
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield block


def p4_leaks(spark: SparkSession, folder: str, run: int = 8, budget: int = 1) -> DataFrame:
    """(tbl, rec_id, item_id, errors): records with a run of an item under at most ``budget`` word edits."""
    blocks = held_out(spark, folder)
    out, block = None, next(blocks)
    while block is not None:
        following = next(blocks, None)
        part = leaks(records(spark, folder), block, run, budget)
        if out is not None or following is not None:
            part = cut(part)
        out = part if out is None else out.unionByName(part)
        block = following
    return out if out is part else out.groupBy("tbl", "rec_id", "item_id").agg(F.min("errors").alias("errors"))  # an item's columns may be in two blocks


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, rec_id, item_id): records where eight or more successive words of an item stand without any edit."""
    return p4_leaks(spark, folder, budget=0).select("tbl", "rec_id", "item_id")
