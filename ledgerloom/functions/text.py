"""Description clean-up and text keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import settings as s


# All code points that Unicode calls white space.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end. A pattern would be tried at every blank of the text, not only at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalize_noise(description: Column) -> Column:
    """Drop reference-code-like words and squeeze blanks (case is kept)."""
    without_digits = F.regexp_replace(description, s.DIGIT_RUN, " ")
    without_codes = F.regexp_replace(without_digits, s.SHORT_MIXED_WORD, " ")
    return F.trim(F.regexp_replace(without_codes, s.WHITESPACE_RUN, " "))


def pattern_key(description: Column) -> Column:
    """Upper-cased description without one trailing reference number."""
    return strip(F.regexp_replace(F.upper(strip(description)), s.TRAILING_REFERENCE, ""))


def token_key(text: Column) -> Column:
    """Blank-separated words in sorted order: the text that token-sort scoring compares."""
    words = F.filter(F.split(text, s.WHITESPACE_RUN), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def is_balance_line(description: Column) -> Column:
    return matches_any(description, s.BALANCE_LINES)


def is_unordered_line(description: Column) -> Column:
    return matches_any(description, s.UNORDERED_LINES)


def valid_label(answer: Column, whitelist: Column) -> Column:
    """The trimmed answer if it is on the whitelist, else UNSURE."""
    label = strip(answer)
    return F.when(F.array_contains(whitelist, label), label).otherwise(F.lit(s.UNSURE))
