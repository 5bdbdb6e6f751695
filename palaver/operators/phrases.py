"""V3 with lists of any size: one automaton over words and phrases, with the places of its hits.

A term is a run of words (letter runs, lower case) and hits wherever its words stand
one after the other, whatever stands between them. A text is brought to its words in
the JVM, joined by single blanks; an Aho-Corasick automaton of all terms then reads it
once, a batch of texts at a time, so the cost does not grow with the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import words
from palaver.operators.verification import HATE_SPEECH_WORDS, PII_PATTERNS, PROFANITY_WORDS, has_pii
from palaver.plans.staging import once

LIST_BYTES = 16 << 20  # size of the lists that one pass carries to its tasks; longer lists take further passes


class Term(NamedTuple):
    category: str
    phrase: str
    language: str | None = None  # null: texts of every language


# Default phrases beside the word lists of the plain verdict (public, general usage).
PHRASES = [
    Term("PROFANITY", "son of a bitch"), Term("PROFANITY", "piece of shit"), Term("PROFANITY", "go to hell", "en"),
    Term("PROFANITY", "shut up", "en"), Term("PROFANITY", "hijo de puta", "es"), Term("PROFANITY", "vete a la mierda", "es"),
    Term("PROFANITY", "fils de pute", "fr"), Term("PROFANITY", "ta gueule", "fr"),
    Term("PROFANITY", "leck mich am arsch", "de"), Term("PROFANITY", "halt die fresse", "de"),
    Term("HATE_SPEECH", "go back to your country", "en"), Term("HATE_SPEECH", "gas the", "en"),
]
DEFAULT_TERMS = ([Term("PROFANITY", w) for w in PROFANITY_WORDS] + [Term("HATE_SPEECH", w) for w in HATE_SPEECH_WORDS]
                 + PHRASES)
HITS = "array<struct<category string, phrase string, first_word int>>"


def spelled(phrase: str) -> str:
    """A phrase as its words, the way texts are read."""
    import regex
    return " ".join(regex.findall(r"\p{L}+", phrase.lower()))


def _passes(terms: Iterable[Term]) -> list[list[tuple[str, str, frozenset]]]:
    """(category, phrase, languages) of the terms with a word, in lists of at most ``LIST_BYTES``."""
    languages: dict[tuple[str, str], set] = {}
    for t in terms:
        languages.setdefault((t.category, spelled(t.phrase)), set()).add(t.language)
    out, size = [[]], 0
    for (category, phrase), own in sorted(languages.items(), key=lambda x: x[0]):
        if not phrase:
            continue
        n = len(category.encode()) + len(phrase.encode()) + sum(len(x or "") for x in own)
        if out[-1] and size + n > LIST_BYTES:
            out.append([])
            size = 0
        out[-1].append((category, phrase, frozenset(own)))
        size += n
    return out


def _scan(terms: list[tuple[str, str, frozenset]]):
    """Adds the hits of ``terms`` to the column ``hits`` of Arrow batches."""
    def run(batches):
        import ahocorasick
        import pyarrow as pa
        automaton, by_phrase = ahocorasick.Automaton(), {}
        for category, phrase, own in terms:
            by_phrase.setdefault(phrase, []).append((category, own))
        for phrase, kinds in by_phrase.items():
            automaton.add_word(f" {phrase} ", (phrase, kinds))
        automaton.make_automaton()
        for b in batches:
            at = b.schema.get_field_index("hits")
            found = []
            for text, lang, old in zip(b.column("__words").to_pylist(), b.column("language").to_pylist(),
                                       b.column("hits").to_pylist()):
                hits, seen, word = list(old or ()), 0, 0
                for end, (phrase, kinds) in automaton.iter(text or ""):
                    # ends never go back: the blank that ends a hit follows as many words as there are blanks before it
                    word += text.count(" ", seen, end)
                    seen = end
                    first = word - phrase.count(" ") - 1
                    hits += [{"category": c, "phrase": phrase, "first_word": first} for c, own in kinds
                             if None in own or lang in own]
                found.append(sorted(hits, key=lambda h: (h["first_word"], h["phrase"], h["category"])))
            yield b.set_column(at, b.schema.field(at), pa.array(found, b.schema.field(at).type))
    return run


def find_phrases(texts: DataFrame, terms: Iterable[Term] = DEFAULT_TERMS, id_col: str = "job_id", text_col: str = "text",
                 language_col: str | None = "language") -> DataFrame:
    """``transcript_id``, ``language``, ``text`` and ``hits`` of every text.

    Hits are all places of all terms, overlapping ones too, by first word (from 0), phrase
    and category; terms that are spelled alike count once per category. A null or empty
    text, and an empty list, give no hits. A text without a language is only held against
    terms for every language. A list over ``LIST_BYTES`` is read in several passes, whole.
    """
    language = F.col(language_col) if language_col else F.lit(None).cast("string")
    out = texts.select(F.col(id_col).alias("transcript_id"), language.alias("language"), F.col(text_col).alias("text"))
    out = out.select("*", F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("__words"),
                     F.array().cast(HITS).alias("hits"))
    for p in _passes(terms):
        if p:
            out = out.mapInArrow(_scan(p), out.schema)
    return out.select("transcript_id", "language", "text", "hits")


def phrase_hits(found: DataFrame) -> DataFrame:
    """One row per hit of ``find_phrases``."""
    return found.select("transcript_id", F.inline("hits"))


def phrase_verdict(found: DataFrame, pii_patterns: list[str] = PII_PATTERNS) -> DataFrame:
    """V3's verdict from the hits of ``find_phrases``: reason by PROFANITY, HATE_SPEECH, PII."""
    kinds = F.col("hits.category")
    flags = once(found, has_profanity=F.array_contains(kinds, "PROFANITY"),
                 has_hate_speech=F.array_contains(kinds, "HATE_SPEECH"),
                 has_pii=has_pii(F.col("text"), pii_patterns))
    reason = (F.when(F.col("has_profanity"), "PROFANITY").when(F.col("has_hate_speech"), "HATE_SPEECH")
              .when(F.col("has_pii"), "PII"))
    return flags.select("transcript_id", "language", reason.isNull().alias("is_safe"), reason.alias("reject_reason"),
                        "has_profanity", "has_hate_speech", "has_pii")
