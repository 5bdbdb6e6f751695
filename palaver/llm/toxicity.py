"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common letter subsequences of length
``ORDER``, gaps allowed up to a span of ``REACH`` letters, each weighted
``DECAY ** span`` in both words, and is scaled to 1 for equal words; so
``idiot`` stays close to ``i.d-iot`` or ``idiotic``. A sentence is a bag of words
and a document a bag of sentences; both are judged by their highest words
(multiple-instance learning). Words of any length are judged whole, and so are
their parts between marks and the letters that stay when marks are dropped, so
that an insult stretched by any number of marks is seen.

Training, from a bounded sample of labelled documents (``per_class`` of each
label by smallest id hash; this and the other bounds are parameters of ``fit``):

1. collect the words of the sample's sentences by label;
2. witnesses are the words that explain the toxic texts in a greedy cover, far
   more frequent there than in clean ones; variants with inserted characters
   are added, and in a second round the words that the first machine finds;
3. landmarks are chosen far apart among the witnesses and, as many again,
   among the clean words closest to them; words map to
   ``k(word, landmarks) K^-1/2``;
4. a linear squared-hinge machine separates witnesses from clean words; the
   clean words it gets wrong join the training set, a few times;
5. a logistic head over a document's ``TOP`` highest words and its length is
   set on the sample's documents.

Scoring needs no kernel matrix: with landmark weights a, the decision is
``sum_u w_u phi_u(word) / |phi(word)|`` over the word's subsequences u, where
``w_u = sum_l a_l phi_u(l) / |phi(l)|`` is one sparse table for all landmarks
(at most landmarks x their subsequences, whatever the alphabet).

Defined results: a null or empty text, or one without words, scores 0;
without labels of both kinds every score is 0; very long texts and words are
scored whole (time in proportion to their length); ties between words do not
matter, as only values count; repeated rows repeat, repeated ids are learned
from once (the text of smallest hash) and scored each; ids may be null and of
any type; labels with a null take no part; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import slices, stored

ORDER = 4
DECAY = 0.6
REACH = 24  # longest span of a counted subsequence; longer ones would weigh below 3e-6
START = "^"  # stands before a word, so that where a subsequence begins counts
TOP = 3
LOWEST = -2.0  # floor of a word decision; also stands for a word that is not there
CACHE_WORDS = 300_000
ROWS = 4096
DENSE = 1 << 22
SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
SENTENCE = re.compile(r"[.!?]+\s+|\n+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")


def chunks(text: str | None) -> list[str]:
    """Lower-case chunks between white space; letters spelled apart also as one chunk."""
    if not text:
        return []
    low = text.lower()
    return low.split() + ["".join(m.split()) for m in SPELLED.findall(low)]


def words_of(chunk: str) -> list[str]:
    """The words a chunk is judged by: itself without outer marks, its parts, and the parts joined."""
    core = EDGES.sub("", chunk)
    out = [core] if core else []
    parts = INNER.split(core)
    if len(parts) > 1:
        out += [p for p in parts if p] + ["".join(parts)]
    return [START + w for w in out]


@lru_cache(maxsize=None)
def picks(n: int) -> np.ndarray:
    """Positions of the subsequences of n letters; of a window's that begin at its start, where n is beyond REACH."""
    if n <= REACH:
        every = itertools.combinations(range(n), ORDER)
    else:
        every = ((0, *rest) for rest in itertools.combinations(range(1, REACH), ORDER - 1))
    return np.array(list(every), dtype=np.int64).reshape(-1, ORDER)


class Subsequences:
    """Explicit subsequence features over the letters of some words."""

    def __init__(self, letters: str):
        self.codes = np.array(sorted(ord(c) for c in set(letters)), dtype=np.uint32)
        self.size = len(self.codes) + 1  # class 0: any other character

    def encode(self, raw: np.ndarray) -> np.ndarray:
        pos = np.searchsorted(self.codes, raw)
        pos[pos == len(self.codes)] = 0
        known = self.codes[pos] == raw if len(self.codes) else np.zeros(raw.shape, dtype=bool)
        return np.where(known, pos + 1, 0)

    def ids(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Feature ids of letter rows; those with a letter of class 0 never have a weight."""
        codes = self.encode(raw)
        if self.size ** ORDER < 1 << 31:
            codes = codes.astype(np.int32)
        out = codes[:, at[:, 0]]
        for c in range(1, ORDER):
            out = out * codes.dtype.type(self.size) + codes[:, at[:, c]]
        return out

    def whole(self, ids: np.ndarray) -> np.ndarray:
        """Which ids have only known letters."""
        good = np.ones(ids.shape, dtype=bool)
        for _ in range(ORDER):
            good &= ids % self.size > 0
            ids = ids // self.size
        return good

    def blocks(self, words: list[str]):
        """(index into words of each row, feature ids, weights, factors, norms) by rows of features.

        A word up to REACH letters is one row; a longer one has a row for each
        distinct window of REACH letters, ``factors`` saying how often it comes.
        """
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, idx in sorted(by_length.items()):
            if n < ORDER:
                continue
            at = picks(n)
            weights = DECAY ** (at[:, -1] - at[:, 0] + 1)
            if n > REACH:
                for i in idx:
                    rows, times = windows(words[i])
                    norm = long_norm(rows, times, at, weights)
                    for lo, hi in slices(len(rows), 200):
                        yield np.full(hi - lo, i), self.ids(rows[lo:hi], at), weights, times[lo:hi], np.full(hi - lo, norm)
                continue
            for lo, hi in slices(len(idx), max(1, 400_000 // len(at))):
                part = np.array(idx[lo:hi])
                raw = letters_of([words[i] for i in part])
                yield part, self.ids(raw, at), weights, np.ones(len(part)), norms_of(raw)


def letters_of(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


def windows(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of REACH letters, one from every letter on (0 beyond the end), and how often each comes."""
    padded = np.concatenate([letters_of([word])[0], np.zeros(REACH - 1, dtype=np.uint32)])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, REACH))
    distinct, times = np.unique(rows.view(f"V{rows.shape[1] * 4}").ravel(), return_counts=True)
    return distinct.view(np.uint32).reshape(len(distinct), REACH), times.astype(np.float64)


def norms_of(raw: np.ndarray) -> np.ndarray:
    """|phi| of equally long words up to REACH letters."""
    n = raw.shape[1]
    ordered = np.sort(raw, axis=1)
    repeats = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)
    # no letter twice: every subsequence is a feature of its own
    plain = sum((n - span + 1) * math.comb(span - 2, ORDER - 2) * DECAY ** (2 * span) for span in range(ORDER, n + 1))
    out = np.full(len(raw), math.sqrt(plain))
    if repeats.any():
        out[repeats] = np.sqrt(self_kernel(raw[repeats]))
    return out


def long_norm(rows: np.ndarray, times: np.ndarray, at: np.ndarray, weights: np.ndarray) -> float:
    """|phi| of a word of any length, from its windows; first letters apart, so that memory stays small."""
    alphabet, codes = np.unique(rows, return_inverse=True)
    codes = codes.reshape(rows.shape).astype(np.int64)
    ends = int(alphabet[0] == 0)  # code 0 then is the end of the word
    total = 0.0
    for first in range(ends, len(alphabet)):
        own = np.flatnonzero(codes[:, 0] == first)
        ids, sums = np.zeros(0, dtype=np.int64), np.zeros(0)
        for lo, hi in slices(len(own), 500):
            c, t = codes[own[lo:hi]], times[own[lo:hi]]
            key = np.zeros((len(c), len(at)), dtype=np.int64)
            inside = np.ones((len(c), len(at)), dtype=bool)
            for k in range(1, ORDER):
                key = key * len(alphabet) + c[:, at[:, k]]
                inside &= c[:, at[:, k]] >= ends
            ids = np.concatenate([ids, key[inside]])
            ids, place = np.unique(ids, return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([sums, (t[:, None] * weights)[inside]]), minlength=len(ids))
        total += float((sums ** 2).sum())
    return math.sqrt(total)


def self_kernel(raw: np.ndarray) -> np.ndarray:
    """K(w, w) of equally long words given as letter rows, by the gap-weighted recursion."""
    k, n = raw.shape
    same = (raw[:, :, None] == raw[:, None, :]) * (DECAY * DECAY)
    gap = np.tril(DECAY ** np.maximum(0, np.subtract.outer(np.arange(n), np.arange(n))))
    ends = np.ones((k, n, n))  # weight of common subsequences that end before the two positions
    for _ in range(ORDER - 1):
        reached = gap @ (ends * same) @ gap.T
        ends = np.zeros((k, n, n))
        ends[:, 1:, 1:] = reached[:, :-1, :-1]
    return (ends * same).sum(axis=(1, 2))


def kernel(words: list[str], landmarks: list[str], space: Subsequences) -> np.ndarray:
    """Scaled kernel matrix (word, landmark), over the subsequences that landmarks have."""
    rows = [(part[r], ids[r], weights * factors[r] / norms[r])
            for part, ids, weights, factors, norms in space.blocks(landmarks) for r in range(len(part))]
    used = np.unique(np.concatenate([ids for _, ids, _ in rows])) if rows else np.zeros(0, dtype=np.int64)
    used = used[space.whole(used)]
    table = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)

    def slots(ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(used, ids), max(0, len(used) - 1))
        return np.where(used[at] == ids, at, len(used)) if len(used) else np.zeros(ids.shape, dtype=np.int64)

    for i, ids, share in rows:
        np.add.at(table[:, i], slots(ids), share)
    table[len(used)] = 0
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for part, ids, weights, factors, norms in space.blocks(words):
        place = slots(ids)
        for r, i in enumerate(part):
            out[i] += weights @ table[place[r]] * (factors[r] / norms[r])
    return out


class Weights:
    """Weight per subsequence, kept for those that have one."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, space: Subsequences):
        self.ids, self.values, self.size = ids, values, space.size ** ORDER

    def __reduce__(self):
        return _weights, (self.ids, self.values, self.size)

    @cached_property
    def dense(self) -> np.ndarray | None:
        """All weights in place, where that is a small array (made in each worker, never sent)."""
        if self.size > DENSE:
            return None
        out = np.zeros(self.size)
        out[self.ids] = self.values
        return out

    def of(self, ids: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[ids]
        if not len(self.ids):
            return np.zeros(ids.shape)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.values[at], 0.0)


def _weights(ids: np.ndarray, values: np.ndarray, size: int) -> Weights:
    out = Weights.__new__(Weights)
    out.ids, out.values, out.size = ids, values, size
    return out


@dataclass
class Model:
    letters: str = ""
    weights: Weights | None = None
    bias: float = 0.0
    head: tuple = ()  # weights of a document's TOP highest words, its length, and 1
    known: dict = field(default_factory=dict)  # chunks, and below the words they are judged by
    values: dict = field(default_factory=dict)

    def decide(self, words: list[str]) -> np.ndarray:
        space = Subsequences(self.letters)
        out = np.full(len(words), self.bias)
        for part, ids, weights, factors, norms in space.blocks(words):
            # a long word has several rows, so parts may name it again
            np.add.at(out, part, self.weights.of(ids) @ weights * factors / norms)
        return out

    def highest(self, texts: list[str | None]) -> list[list[float]]:
        """The TOP highest word decisions of each text (floored) and ln(1 + words)."""
        bags = [set(chunks(t)) for t in texts]
        fresh = list(set().union(*bags) - self.known.keys())
        pieces = [words_of(c) for c in fresh]
        values = self.values
        flat = list({w for p in pieces for w in p if w not in values})
        new = dict(zip(flat, self.decide(flat).tolist())) if flat else {}
        if len(values) + len(new) <= CACHE_WORDS:
            values.update(new)
        scores = {c: max([new[w] if w in new else values[w] for w in p], default=-math.inf)
                  for c, p in zip(fresh, pieces)}
        if len(self.known) + len(scores) <= CACHE_WORDS:
            self.known.update(scores)
        known, out = self.known, []
        for bag in bags:
            values = [known[c] if c in known else scores[c] for c in bag]
            top = sorted((max(LOWEST, v) for v in values), reverse=True)[:TOP]
            out.append([*top, *[LOWEST] * (TOP - len(top)), math.log1p(len(values))])
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        return [0.0 if f[-1] == 0 else logistic(sum(a * b for a, b in zip(self.head, [*f, 1.0])))
                for f in self.highest(texts)]


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-min(700.0, max(-700.0, z))))


def sample_labelled(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> DataFrame:
    """(toxic, text) of the ``per_class`` documents of each label with the smallest id hashes."""
    spread_ = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    marked = stored(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
                    .filter(F.coalesce(learn, F.lit(False)) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
                    .distinct().withColumn("h", spread_), "toxic-labels")
    found = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    parts = []
    for toxic, n in sorted(found.items()):
        own, share = marked.filter(F.col("toxic") == toxic), 4 * per_class / n
        # hashes are even, so a small range of them holds the smallest per_class: no task ranks a whole label
        while share < 1 and own.filter(F.col("h") < int(share * (1 << 40))).count() < per_class:
            share *= 2
        near = own.filter(F.col("h") < int(share * (1 << 40))) if share < 1 else own
        parts.append(near.orderBy("h", "doc_id").limit(per_class).select("doc_id", "toxic"))
    if not parts:
        return docs.select(F.lit(0).alias("toxic"), "text").limit(0)
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    # at most 2 * per_class ids; of repeated ids one text counts
    return (docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            .select("toxic", "text"))


def sentence_words(text: str) -> set[str]:
    """The words of a text's sentences."""
    return {w for sentence in SENTENCE.split(text) for c in set(chunks(sentence)) for w in words_of(c)
            if len(w) >= ORDER}


def toxic_bags(sample: DataFrame) -> list[set[str]]:
    """One set of words per distinct toxic text of the (bounded) sample."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(sentence_words(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))],
                names=["words"])

    rows = sample.filter("toxic = 1").select("text").distinct().mapInArrow(run, "words array<string>").collect()
    return [set(r["words"]) for r in rows]


def clean_counts(sample: DataFrame) -> dict[str, int]:
    """Documents per word over the distinct clean texts of the (bounded) sample."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            rows: dict[str, int] = {}
            for text in b.column("text").to_pylist():
                for w in sentence_words(text):
                    rows[w] = rows.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array(rows.values(), pa.int64())],
                                             names=["word", "n"])

    rows = sample.filter("toxic = 0").select("text").distinct().mapInArrow(run, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def witnesses(bags: list[set[str]], clean: dict[str, int], n_clean: int, ratio: float, need: int) -> dict[str, int]:
    """Words that explain the toxic texts, with how many texts support each.

    Words found in many toxic texts, and a greedy cover of the rest: the word
    found in most texts not yet explained comes next.
    Texts are counted by their least word hash among rare words, so that near
    copies of one text count once and their chance words explain nothing.
    """
    where: dict[str, list[int]] = {}
    for i, bag in enumerate(bags):
        for w in bag:
            where.setdefault(w, []).append(i)
    rare = max(20, len(bags) // 50)
    family = [min((zlib.crc32(w.encode()) for w in bag if len(where[w]) <= rare), default=-i - 1)
              for i, bag in enumerate(bags)]
    support = lambda docs: len({family[i] for i in docs})
    rate = lambda w: (len(where[w]) / len(bags)) / ((clean.get(w, 0) + 0.5) / n_clean)
    queue = [(-support(d), w) for w, d in where.items() if len(d) >= need and rate(w) >= ratio]
    heapq.heapify(queue)
    often = max(need + 2, len(bags) // 100)
    open_, found = set(range(len(bags))), {w: -n for n, w in queue if -n >= often}
    while queue:
        _, w = heapq.heappop(queue)
        n = support(open_.intersection(where[w]))
        if n < need:
            continue
        if queue and n < -queue[0][0]:
            heapq.heappush(queue, (-n, w))
            continue
        found.setdefault(w, n)
        open_.difference_update(where[w])
    return found


def variants(word: str) -> list[str]:
    """The word with characters put in, as people do to hide it."""
    word = word.removeprefix(START)
    out = [m.join(word) for m in (".", "-", "*")]
    half = len(word) // 2
    return [START + v for v in out + [word[:half] + m + word[half:] for m in ("-", "_", "*")]]


def spread(words: list[str], k: int, space: Subsequences) -> list[str]:
    """Up to k words far apart under the kernel (farthest first)."""
    if len(words) <= k:
        return list(words)
    chosen, nearest = [words[0]], kernel(words, words[:1], space)[:, 0]
    while len(chosen) < k and nearest.min() < 0.95:
        w = words[int(np.argmin(nearest))]
        chosen.append(w)
        nearest = np.maximum(nearest, kernel(words, [w], space)[:, 0])
    return chosen


def train_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4,
                 rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the rows inside the margin."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = penalty * np.eye(a.shape[1])
    ridge[-1, -1] = 1e-9
    active = np.ones(len(a), dtype=bool)
    for _ in range(rounds):
        b = a[active] * weight[active, None]
        w = np.linalg.solve(b.T @ a[active] + ridge, b.T @ y[active])
        now = y * (a @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2500, landmarks: int = 96,
        ratio: float = 8.0, need: int = 3, rounds: int = 4, hard: int = 2000, pool: int = 600, fresh: int = 500) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of the documents where ``learn`` (on doc_id) holds.

    Bounds of the training set, which concern only what is learned from the
    sample and nothing that is scored: ``per_class`` documents of a label;
    ``landmarks`` toxic and as many clean landmarks, chosen from the first
    ``pool`` witnesses and the ``pool`` closest clean words; ``hard`` clean words
    by closeness and as many evenly over all; in each of ``rounds`` rounds the
    ``fresh`` clean words that the machine gets most wrong; and at most ``pool``
    words that the first machine finds.
    """
    sample = stored(sample_labelled(docs, labels, learn, per_class), "toxic-sample")
    bags, counts = toxic_bags(sample), clean_counts(sample)
    n_clean = sample.filter("toxic = 0").select("text").distinct().count()
    if not bags or not n_clean:
        return Model()
    model = learn_words(bags, counts, n_clean, landmarks, ratio, need, rounds, hard, pool, fresh)
    return calibrated(model, sample) if model.weights is not None else model


def learn_words(bags: list[set[str]], counts: dict[str, int], n_clean: int, landmarks: int = 96, ratio: float = 8.0,
                need: int = 3, rounds: int = 4, hard: int = 2000, pool: int = 600, fresh: int = 500) -> Model:
    """The machine over words, without a document head."""
    cover = witnesses(bags, counts, n_clean, ratio, need)
    if not cover:
        return Model()
    positive, clean = list(cover), sorted(counts)
    often: dict[str, int] = {}
    for bag in bags:
        for w in bag:
            often[w] = often.get(w, 0) + 1
    model = Model()
    for step in range(2):  # the second time with the words that the first machine finds
        space = Subsequences("".join(positive))
        letters = space_letters(positive)
        near = spread(positive[:pool], landmarks, space)
        closeness = Model(letters, landmark_weights(near, np.ones(len(near)), space)).decide(clean)
        by_closeness = np.argsort(-closeness, kind="stable")
        close = [clean[i] for i in by_closeness[:hard]]
        marks = near + spread([w for w in close[:pool] if w not in set(near)], landmarks, space)
        k = kernel(marks, marks, space).astype(np.float64)
        values, vectors = np.linalg.eigh(k)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        hidden = [v for w in near for v in variants(w)]
        negative = list(dict.fromkeys(w for w in close + clean[:: max(1, len(clean) // hard)] if w not in set(positive)))
        plus = np.array([math.sqrt(often[w]) for w in positive])
        for _ in range(rounds):
            x = np.vstack([kernel(positive + hidden, marks, space), kernel(negative, marks, space)]) @ root
            y = np.array([1.0] * (len(positive) + len(hidden)) + [-1.0] * len(negative))
            minus = np.array([math.sqrt(counts[w]) for w in negative])
            weight = np.concatenate([plus / plus.sum(), np.full(len(hidden), 0.25 / max(1, len(hidden))),
                                     minus / minus.sum()])
            w_, bias = train_linear(x, y, weight)
            model = Model(letters, landmark_weights(marks, root @ w_, space), bias)
            value = model.decide(clean)
            known = set(negative) | set(positive)
            wrong = [clean[i] for i in np.argsort(-value, kind="stable")[:fresh]
                     if value[i] > -0.5 and clean[i] not in known]
            if not wrong:
                break
            negative += wrong
        if step == 0:
            found = sorted(w for w, n in often.items() if n >= 2 and w not in cover
                           and (n / len(bags)) / ((counts.get(w, 0) + 0.5) / n_clean) >= ratio)
            value = model.decide(found) if found else np.zeros(0)
            positive += [found[i] for i in np.argsort(-value, kind="stable")[:pool] if value[i] > 0]
    return model


def space_letters(words: list[str]) -> str:
    return "".join(sorted(set("".join(words))))


def landmark_weights(marks: list[str], a: np.ndarray, space: Subsequences) -> Weights:
    """One weight per subsequence: the sum over landmarks of a_l phi_u(l) / |phi(l)|."""
    ids, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for part, rows, weights, factors, norms in space.blocks(marks):
        good = space.whole(rows)
        ids.append(rows[good].astype(np.int64))
        values.append((weights * (a[part] * factors / norms)[:, None])[good])
    used, place = np.unique(np.concatenate(ids), return_inverse=True)
    return Weights(used, np.bincount(place, weights=np.concatenate(values), minlength=len(used)), space)


def per_text(docs: DataFrame, schema: str, name: str, value_type: str, rule) -> DataFrame:
    """``docs`` with ``text`` replaced by ``rule(texts)``."""
    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.float64()) if value_type == "array<double>" else pa.float64()
        for b in batches:
            for lo, hi in slices(b.num_rows, ROWS):
                part = b.slice(lo, hi - lo)
                value = rule(part.column("text").to_pylist())
                keep = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(value, kind)],
                                                 names=[*keep, name])

    return docs.mapInArrow(run, f"{schema}, {name} {value_type}")


def calibrated(model: Model, sample: DataFrame, penalty: float = 1e-3, rounds: int = 50) -> Model:
    """The model with a logistic head learned on the sample's documents (Newton steps)."""
    rows = per_text(sample, "toxic int", "f", "array<double>", model.highest).collect()
    head = fit_head(np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float),
                    penalty, rounds)
    return Model(model.letters, model.weights, model.bias, head)


def fit_head(features: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50,
             prior: float = 0.2) -> tuple:
    """Logistic weights, with ``prior`` as the weight of the toxic texts."""
    x = np.hstack([features, np.ones((len(y), 1))])
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge,
                               x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return per_text(docs.select("doc_id", "text"), f"doc_id {id_type}", "score", "double", model.score)
