"""Column builders for text that is spelled unevenly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands in for a value that nobody filled in, without its punctuation.
STAND_INS = ("", "na", "none", "null", "nil", "todo", "tbd", "unknown", "notavailable", "notapplicable")

OUTER_SPACE = r"(?U)^[\s​﻿]+|[\s​﻿]+$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, OUTER_SPACE, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def letters_digits(c: Column) -> Column:
    """Lower case, and nothing but letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def words(c: Column) -> Column:
    """The distinct runs of letters or digits, case ignored; an empty array for null."""
    return F.array_distinct(F.filter(F.split(F.coalesce(F.lower(c), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def is_filled(c: Column) -> Column:
    """True unless the text is null, blank or a mere stand-in such as n/a."""
    return F.coalesce(~letters_digits(c).isin(*STAND_INS), F.lit(False))


def rust_lines(c: Column) -> Column:
    """Lines without terminators; a final newline begins no further line."""
    return F.split(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"\n\z", ""), "\n")
