"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A character other than white space and invisible ones (zero-width, joiners, blanks).
VISIBLE = r"(?U)[^\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ⠀ㅤ︀-️ﾠ]"
#: The line ends that Python's ``splitlines`` knows.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def visible(text: Column) -> Column:
    """True if the text has a visible character; false for null."""
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def letters_digits(text: Column) -> Column:
    """Letters and digits of the text in their order, without regard to case; null stays null."""
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")))
