"""Texts of an Arrow batch as flat arrays of characters.

Counts that need many looks at a text take them over whole blocks of texts at once: a table gives
every character its classes, words and tokens are runs found by comparing neighbours, and a word's
hash is a difference of two prefix sums. Blocks hold about ``BLOCK`` characters, so memory does not
depend on the batch, and one text is never split.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 1 << 18
#: Characters from here on (rare ideographs) share one table entry and count as letters.
TOP = 0x1FFFF

LETTER, DIGIT, SPACE, BREAK, VOWEL, PLAIN, MARK, CLOSER, APOSTROPHE, UPPER, HEX, RARE, HIDDEN, PAUSE = (1 << k for k in range(14))

_ROOT = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table() -> tuple[np.ndarray, np.ndarray]:
    """(classes, lower-case form) of every character up to ``TOP``."""
    flags, lower = np.zeros(TOP + 1, np.uint16), np.arange(TOP + 1, dtype=np.uint32)
    for code in range(TOP):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind[0] == "L":
            flags[code] |= LETTER
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
            if kind == "Lu":
                flags[code] |= UPPER
        elif kind[0] == "N":
            flags[code] |= DIGIT
        elif char.isspace():
            flags[code] |= SPACE
        elif kind == "Cf":
            flags[code] |= HIDDEN
    flags[TOP] = LETTER
    for chars, flag in (
        ("\n\r\x0b\x0c\x1c\x1d\x1e\x85  ", BREAK | SPACE),
        ("aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿıAEIOUYÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØŒÙÚÛÜÝŸ", VOWEL),
        (".,!?;:'’\"“”«»()¿¡…-–—", PLAIN),
        (".!?…。？！", MARK),
        ("\"'”’»)]*", CLOSER),
        ("'’", APOSTROPHE),
        ("0123456789abcdefABCDEF", HEX),
        (".!?…;:,\n—–？！。", PAUSE),
        (",;=|│\t<x%\"�ÃÂâðŸ", RARE),
    ):
        for c in chars:
            flags[ord(c)] |= flag
    return flags, lower


_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and lower-case tables, made once a process."""
    if not _tables:
        _tables.extend(_table())
    return _tables[0], _tables[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash root and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        for k, root in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            steps = np.full(size, root, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def blocks(texts: Sequence[str], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, stop) of successive texts of about ``limit`` characters, one text at least."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


class Flat:
    """Some texts laid end to end, a line end after each."""

    def __init__(self, texts: Sequence[str]):
        self.text = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stops = np.cumsum(sizes + 1) - 1  # place of each text's own line end
        self.starts = self.stops - sizes
        classes, self.lower_table = tables()
        self.flags = classes[np.minimum(self.codes, TOP)]

    def has(self, flag: int) -> np.ndarray:
        return (self.flags & flag) != 0

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How often a mask holds in each text."""
        return np.add.reduceat(mask, self.starts, dtype=np.int64)

    def spread(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Sum of ``values`` at ascending ``places`` by text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[np.searchsorted(places, self.stops)] - total[np.searchsorted(places, self.starts)]

    def sums_of_lines(self, values: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Sum by text of values of lines that end at ``stop``; every text ends with a line end of its own."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        upto = total[np.searchsorted(stop, self.stops) + 1]
        return np.diff(upto, prepend=0)

    def words(self, digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) places of the words: letters (and digits), single apostrophes between them."""
        inner = self.has(LETTER | DIGIT if digits else LETTER)
        ticks = np.flatnonzero(self.has(APOSTROPHE))
        ticks = ticks[(ticks > 0) & (ticks + 1 < len(inner))]
        ticks = ticks[inner[ticks - 1] & inner[ticks + 1]]
        inner[ticks] = True
        return runs(inner)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the lower-case characters of runs, wherever the runs stand."""
        up, down = powers(len(self.codes))
        lower = self.lower_table[np.minimum(self.codes, TOP)].astype(np.uint64)
        lower *= up[: len(lower)]
        total = np.cumsum(lower, dtype=np.uint64)
        h = total[last] - np.where(first > 0, total[first - 1], np.uint64(0))
        h *= down[first]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places of the runs of True."""
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after)


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """Hashes of single words, as ``Flat.hashes`` gives them inside texts."""
    flat = Flat(list(words))
    return flat.hashes(flat.starts, np.maximum(flat.stops - 1, flat.starts))
