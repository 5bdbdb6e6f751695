"""License scan by ordered signature rules.

A text is lower-cased (A-Z only) and reduced to its words, runs of digits,
letters and characters beyond ASCII, joined by single spaces. Hundreds of
regexes (``license_rules``) are gated by a keyword prefilter: one Aho-Corasick
pass finds the keywords, and only rules whose keyword occurs are tried.
Overlapping detections are resolved in order of priority, then length, then
rule: a detection that lies inside a kept one is suppressed. Asked (base)
phrases are rules too, found at every place, and are never suppressed.

Rows are independent: one pass without a shuffle. Defined results: a null or
empty text has no words and no detections (score 0); very long texts are
scanned whole, with memory in proportion to one text; detections that start
and end alike go to the higher priority, then to the earlier rule; repeated
rows and ids (null and of any type) are kept as they are; an empty table gives
no rows; only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import slices, whole_text
from palaver.llm.license_rules import Rule, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROWS = 256
DETECTION = "array<struct<rule: string, label: string, start: bigint, end: bigint, base: boolean, weight: double>>"


def words_of(text: str) -> list[str]:
    # lower() of bytes changes A-Z alone
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Scanner:
    """Compiled rules and the automaton of their keywords."""

    def __init__(self, ordered: list[Rule]):
        import ahocorasick
        self.rules = ordered
        # a base phrase is wanted at every place, so it consumes nothing
        self.compiled = [re.compile(rf"(?<!\S)(?=({r.pattern})(?!\S))" if r.base else rf"(?<!\S)({r.pattern})(?!\S)")
                         for r in ordered]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(ordered):
            by_keyword.setdefault(r.keyword, []).append(i)
        self.keywords = ahocorasick.Automaton()
        for keyword, members in by_keyword.items():
            self.keywords.add_word(keyword, members)
        self.keywords.make_automaton()

    def candidates(self, line: str) -> list[int]:
        """Rules whose keyword occurs, in order."""
        found: set[int] = set()
        for _, members in self.keywords.iter(line):
            if members[0] not in found:
                found.update(members)
        return sorted(found)

    def detections(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, rule) in words, of every rule that is tried, in order."""
        line = " ".join(words)
        tried = self.candidates(line)
        if not tried:
            return []
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        return [(bisect_right(starts, m.start(1)) - 1, bisect_right(starts, m.end(1) - 1), i)
                for i in tried for m in self.compiled[i].finditer(line)]

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections that no kept one contains; base ones stay and suppress nothing."""
        base = [d for d in found if self.rules[d[2]].base]
        rest = [d for d in found if not self.rules[d[2]].base]
        rest.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[2], d[0]))
        place = {s: k for k, s in enumerate(sorted({d[0] for d in rest}), 1)}
        reach = [0] * (len(place) + 1)  # Fenwick tree: farthest end of kept detections by start
        kept = []
        for d in rest:
            k, most = place[d[0]], 0
            while k:
                most = max(most, reach[k])
                k &= k - 1
            if most >= d[1]:
                continue
            kept.append(d)
            k = place[d[0]]
            while k < len(reach):
                reach[k] = max(reach[k], d[1])
                k += k & -k
        return sorted(base + kept)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        words = words_of(text)
        return len(words), self.resolve(self.detections(words))


def confidence(found: list[tuple[float, str]]) -> float:
    """1 - product over distinct labels of (1 - the label's highest weight); found: (weight, label)."""
    best: dict[str, float] = {}
    for weight, label in found:
        best[label] = max(weight, best.get(label, 0.0))
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1 - best[label]
    return 1 - doubt


@lru_cache(maxsize=8)
def scanner(ordered: tuple[Rule, ...]) -> Scanner:
    return Scanner(list(ordered))


def scan(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, found (detections left after suppression, by start) and score of every text."""
    ordered = tuple(rules() if ordered is None else ordered)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        own = scanner(ordered)
        kind = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64()), ("base", pa.bool_()), ("weight", pa.float64())]))
        for b in batches:
            for lo, hi in slices(b.num_rows, ROWS):
                part = b.slice(lo, hi - lo)
                n, found, score = [], [], []
                for text in part.column("text").to_pylist():
                    count, hits = own.scan(text)
                    n.append(count)
                    found.append([{"rule": r.name, "label": r.label, "start": s, "end": e, "base": r.base,
                                   "weight": r.weight} for s, e, r in ((s, e, own.rules[i]) for s, e, i in hits)])
                    score.append(confidence([(d["weight"], d["label"]) for d in found[-1]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(score, pa.float64())],
                    names=["doc_id", "n_words", "found", "score"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_words long, found {DETECTION}, score double")


def joined_labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
