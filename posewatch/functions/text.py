"""Lines, whitespace and numbers in the input texts.

The inputs follow the text rules of Unicode strings: all Unicode whitespace
separates and strips, not only blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace, line ends and number syntax.
SPACE_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
LINE_END_CODES = [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]
SPACE_CHARS = "".join(map(chr, SPACE_CODES))
SPACE = "[" + "".join(rf"\x{{{code:x}}}" for code in SPACE_CODES) + "]"
ASCII_SPACE = r"[\t-\r\x1c- ]"
FILE_LINE_END = r"\r\n|\n|\r"
TEXT_LINE_END = r"\r\n|[" + "".join(rf"\x{{{code:x}}}" for code in LINE_END_CODES) + "]"
DIGITS = r"[0-9]+(?:_[0-9]+)*"
FLOAT_CHARS = r"^[0-9.eE+-]+\z"
FLOAT = rf"^[+-]?(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?\z"
NON_FINITE = r"^(?i:[+-]?(?:inf|infinity|nan))\z"
INTEGER = rf"^[+-]?{DIGITS}\z"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE_CHARS))


def words(stripped: Column) -> Column:
    """Whitespace-separated words of an already stripped, non-empty text.

    Plain ASCII text, which is the rule, needs only the short character class.
    """
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.split(stripped, ASCII_SPACE + "+")).otherwise(
        F.split(stripped, SPACE + "+")
    )


def parse_float(value: Column) -> Column:
    """The double a number text stands for, null for anything that is no number text.

    A plain cast also takes ``1d`` and ``0x1p3``; words made only of these characters
    are cast by the right syntax. Digit groups with ``_`` are checked in full.
    """
    grouped = F.replace(value, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(value.rlike(FLOAT_CHARS), value.try_cast("double")).when(
        value.contains("_") & value.rlike(FLOAT), grouped
    )


def parse_int(value: Column) -> Column:
    return F.when(value.rlike(INTEGER), F.replace(value, F.lit("_"), F.lit("")).try_cast("bigint"))


def is_finite(value: Column) -> Column:
    return ~(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))


def is_comment(stripped: Column) -> Column:
    """Blank lines and lines led by ``#`` or ``@`` carry no sample."""
    return (stripped == "") | stripped.startswith("#") | stripped.startswith("@")


def sample_reason(n: Column, first: Column, second: Column, t: Column, r: Column) -> Column:
    """Why a data line is no valid sample, null when it is one.

    Takes the word count, the two words and their parsed values. Time order is
    checked apart because it needs the line before.
    """

    def numeric(word: Column, value: Column) -> Column:
        return value.isNotNull() | word.rlike(NON_FINITE)

    return (
        F.when(n != 2, "column_count")
        .when(~(numeric(first, t) & numeric(second, r)), "non_numeric")
        .when(t.isNull() | r.isNull(), "non_finite")
        .when(~(is_finite(t) & is_finite(r)), "non_finite")
        .when(r < 0, "negative_rmsd")
    )
