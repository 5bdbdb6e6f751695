"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And).

Rules are globs over the canonical URL ``.host/path``: ``*`` matches any run
without ``/``, ``**`` any run, ``?`` one character. All patterns lie side by
side in one bit vector of as many 64-bit words as they need. A pattern of m
literals has m + 1 states; a wildcard is a self-loop on the state before it.
One step over a character c is, for all patterns at once,

    D = ((D << 1, carried over words) & enter[c]) | (D & loop[c])

and a rule fits when its last state is set after the whole URL. Within a task
the URLs of a batch are advanced together, one character position at a time
(longest first, so finished URLs leave the front). The table is the
characters that occur in rules plus one class for all others.

Defined results: a null URL or one without ``://`` has empty host and path,
fits no rule and gets ``default``; the longest fitting rule wins, among
equally long ones a block, then the earlier rule; repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from palaver.llm.common import slices

ALLOW, BLOCK = "allow", "block"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path prefix, as shown in the result

    def glob(self) -> str:
        """The host itself and its subdomains, the path as a prefix."""
        host, _, path = self.text.partition("/")
        return f"*.{host}/{path}**"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


class GlobAutomaton:
    """Shift-And masks of many globs over ``words`` 64-bit words."""

    def __init__(self, globs: list[str]):
        parsed = [self._parse(g) for g in globs]
        alphabet = sorted({c for elements, _ in parsed for c in elements if c != "?"} | {"/"})
        self.codes = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        n_classes, other = len(alphabet) + 1, len(alphabet)
        bits = sum(len(e) + 1 for e, _ in parsed)
        self.words = max(1, -(-bits // 64))
        enter = np.zeros((n_classes, self.words), dtype=np.uint64)
        loop = np.zeros_like(enter)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        slash = alphabet.index("/")
        at = 0
        for elements, loops in parsed:
            self.start[at // 64] |= self._bit(at)
            for i in range(len(elements) + 1):
                state = at + i
                if i:
                    c = elements[i - 1]
                    classes = range(n_classes) if c == "?" else [alphabet.index(c)]
                    for k in classes:
                        enter[k, state // 64] |= self._bit(state)
                kind = loops.get(i)
                for k in range(n_classes):
                    if kind == "**" or (kind == "*" and k != slash):
                        loop[k, state // 64] |= self._bit(state)
            last = at + len(elements)
            self.final.append((last // 64, self._bit(last)))
            at = last + 1
        self.enter, self.loop, self.other = enter, loop, other

    @staticmethod
    def _bit(state: int) -> np.uint64:
        return np.uint64(1) << np.uint64(state % 64)

    @staticmethod
    def _parse(glob: str) -> tuple[list[str], dict[int, str]]:
        """Literals, and the wildcard that loops on the state before each."""
        elements: list[str] = []
        loops: dict[int, str] = {}
        i = 0
        while i < len(glob):
            if glob.startswith("**", i):
                loops[len(elements)] = "**"
                i += 2
            elif glob[i] == "*":
                loops.setdefault(len(elements), "*")
                i += 1
            else:
                elements.append(glob[i])
                i += 1
        return elements, loops

    def fits(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix (text, glob): the glob fits the whole text."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        sorted_len = lengths[order]
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begins = (np.cumsum(lengths) - lengths)[order]
        pos = np.searchsorted(self.codes, flat)
        pos[pos == len(self.codes)] = 0
        classes = np.where(self.codes[pos] == flat, pos, self.other) if len(flat) else flat.astype(np.int64)
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sorted_len[0]) if n else 0):
            live = int(np.searchsorted(-sorted_len, -step, side="left"))  # texts longer than step
            c = classes[begins[:live] + step]
            d = state[:live]
            shifted = d << one
            if self.words > 1:
                shifted[:, 1:] |= d[:, :-1] >> top
            state[:live] = (shifted & self.enter[c]) | (d & self.loop[c])
        out = np.zeros((n, len(self.final)), dtype=bool)
        for r, (word, bit) in enumerate(self.final):
            out[order, r] = (state[:, word] & bit) != 0
        return out


def longest_first(rules: list[Rule]) -> list[Rule]:
    return [r for _, r in sorted(enumerate(rules), key=lambda x: (-len(x[1].text), x[1].verdict != BLOCK, x[0]))]


def judge(pages: DataFrame, rules: list[Rule], default: str = ALLOW, key: str = "page_id") -> DataFrame:
    """key, host, path, rule (null without a fit) and verdict per row of ``pages``."""
    ranked = longest_first(rules)
    canonical = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    schema = StructType([*canonical.schema.fields, StructField("rule", StringType()),
                         StructField("verdict", StringType())])
    names_out = schema.names

    def run(batches):
        import pyarrow as pa
        automaton = GlobAutomaton([r.glob() for r in ranked])
        names = [r.text for r in ranked] + [None]
        verdicts = [r.verdict for r in ranked] + [default]
        for b in batches:
            for lo, hi in slices(b.num_rows, 2048):
                part = b.slice(lo, hi - lo)
                urls = ["." + h + p for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist())]
                fits = automaton.fits(urls)
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if ranked \
                    else np.zeros(len(urls), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([names[i] for i in best], pa.string()),
                     pa.array([verdicts[i] for i in best], pa.string())], names=names_out)

    return canonical.mapInArrow(run, schema)
