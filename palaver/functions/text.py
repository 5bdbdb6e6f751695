"""Column expressions over text. All are JVM built-ins (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokeniser and sentence splitter patterns.
WORD_PATTERN = r"[\p{L}]+"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
# Python's str.strip() removes Unicode white space; (?U) makes Java's \s do so.
_OUTER_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: outer Unicode white space removed."""
    return F.regexp_replace(c, _OUTER_SPACE, "")


def words(c: Column) -> Column:
    """Lower-cased letter runs, in order (array<string>)."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), 0)


def sentences(c: Column) -> Column:
    """Sentences in order: a run without terminator plus its terminators."""
    return F.regexp_extract_all(c, F.lit(SENTENCE_PATTERN), 0)


def has_any_word(c: Column, vocabulary: list[str]) -> Column:
    """True when any token of ``c`` is in ``vocabulary``.

    The vocabulary is a literal array folded into the expression, so the
    check runs per row inside whole-stage codegen with no shuffle and no join.
    """
    if not vocabulary:
        return F.lit(False)
    return F.coalesce(
        F.arrays_overlap(words(c), F.array(*[F.lit(w.lower()) for w in vocabulary])),
        F.lit(False))
