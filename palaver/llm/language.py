"""Language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams (n = 1 to 3, lower case, runs
of other characters as one blank), weighted ``ln(1 + tf) * idf`` and scaled to
length 1. Each language has several centroids, found by spherical k-means on a
bounded sample of its labelled texts (``per_language`` rows, a documented
parameter; the smallest hashes of the ids). Inverse document frequencies come
from all labelled texts, whole. A text gets the language of the centroid with
the largest cosine; it is rejected where even that cosine is below a limit.

The limit belongs to the language and to the text's size (powers of two of its
distinct n-grams), since cosines of true texts grow with their size. It is
learned from the same sample: parts of a text of ``PARTS`` characters, and the
whole of it, are held against centroids learned without it (``FOLDS`` folds), and
the limit is ``MARGIN`` times their ``LOW`` quantile, ``min_cosine`` at least. Larger
sizes than the sample has take the limit of its largest. With ``DIMS`` slots, texts
in unlearned letters meet few slots of the centroids by collision.

Defined results: a null text, or one without a letter, is ``und`` with score
0 and rejected; ties go to the first language by name; without any labelled
text everything is ``und``; rows with a null language or null id are predicted
but not learned from; repeated rows repeat.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS_BITS = 14
DIMS = 1 << DIMS_BITS
UND = "und"
MAX_LANGUAGES = 2_000
PARTS = (8, 32, 128, 512, 2048, 8192)
FOLDS = 4
LOW = 0.01
MARGIN = 0.8
PREDICTION = "lang_pred string, score double, rejected boolean"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def term_counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None where it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a blank
    c = np.concatenate(([np.uint32(32)], np.where(letter, codes, np.uint32(32))[keep], [np.uint32(32)]))
    mix = np.uint32(2654435761)
    h1 = c[1:-1] * mix
    h2 = (c[:-1] * np.uint32(40503) + c[1:] + np.uint32(7)) * mix
    h3 = ((c[:-2] * np.uint32(40503) + c[1:-1]) * np.uint32(40503) + c[2:] + np.uint32(13)) * mix
    return np.bincount(np.concatenate((h1, h2, h3)) >> np.uint32(32 - DIMS_BITS), minlength=DIMS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / np.sqrt((v * v).sum())).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids; starts far apart, so the same rows give the same result."""
    centres = [x[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(centres) < min(k, len(x)):
        nearest = np.max(x @ np.array(centres).T, axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centres.append(x[int(np.argmin(nearest))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / np.sqrt((m * m).sum())
    return c


def size_class(counts: np.ndarray) -> int:
    return int(np.count_nonzero(counts)).bit_length() - 1


def limits(texts: list[str], idf: np.ndarray, clusters: int, min_cosine: float) -> np.ndarray:
    """The least cosine of each size class, from texts held against centroids of the other folds."""
    texts = [t for t in sorted(set(texts)) if term_counts(t) is not None]
    out = np.full(DIMS_BITS + 1, min_cosine)
    if len(texts) < 2:
        return out
    x = np.array([vector(term_counts(t), idf) for t in texts])
    fold = np.arange(len(texts)) % FOLDS
    seen: dict[int, list[float]] = {}
    for f in range(min(FOLDS, len(texts))):
        c = spherical_kmeans(x[fold != f], clusters)
        for i in np.flatnonzero(fold == f):
            for n in {min(p, len(texts[i])) for p in (*PARTS, len(texts[i]))}:
                counts = term_counts(texts[i][:n])
                if counts is not None:
                    seen.setdefault(size_class(counts), []).append(float((c @ vector(counts, idf)).max()))
    for k in range(DIMS_BITS + 1):
        if len(seen.get(k, [])) >= min(20, len(texts)):
            out[k] = max(min_cosine, MARGIN * np.quantile(seen[k], LOW))
        elif k:
            out[k] = out[k - 1]
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid, in order of name
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # of each centroid's language, by size class

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = term_counts(text)
        if counts is None or not self.languages:
            return UND, 0.0, True
        slots = np.flatnonzero(counts)
        cosine = self.centroids[:, slots] @ vector(counts[slots], self.idf[slots])
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[best], score, bool(score < self.limits[best, size_class(counts)])

    def column(self, text: Column) -> Column:
        """A struct (lang_pred, score, rejected) of a text column."""
        model = self

        @F.pandas_udf(PREDICTION)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

        return run(text)


def inverse_frequencies(labelled: DataFrame) -> np.ndarray:
    """idf over all rows of ``labelled`` (text); each task sends at most one row per slot."""
    def run(batches):
        import pyarrow as pa
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                counts = term_counts(text)
                if counts is not None:
                    df += counts > 0
                    n += 1
        slots = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(df[slots], n), pa.int64())],
            names=["slot", "df"])

    sums = labelled.select("text").mapInArrow(run, "slot int, df long") \
        .groupBy("slot").agg(F.sum("df").alias("df")).collect()  # at most DIMS + 1 rows
    df, n = np.zeros(DIMS), 0
    for r in sums:
        if r["slot"] < 0:
            n = r["df"]
        else:
            df[r["slot"]] = r["df"]
    return np.log((1 + n) / (1 + df)) + 1


def fit(docs: DataFrame, learn: Column, per_language: int = 400, clusters: int = 4,
        min_cosine: float = 0.08) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds."""
    labelled = docs.select("doc_id", "text", "lang", F.coalesce(learn, F.lit(False)).alias("learn")) \
        .filter(F.col("learn") & F.col("text").isNotNull() & F.col("lang").isNotNull()).drop("learn")
    idf = inverse_frequencies(labelled)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("r", F.row_number().over(order)) \
        .filter(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    # at most per_language ids for each language; a second cut bounds repeated ids
    again = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = labelled.join(F.broadcast(ids), ["doc_id", "lang"]).withColumn("r", F.row_number().over(again)) \
        .filter(F.col("r") <= per_language).select("lang", "text")

    def centroids(rows):
        import pyarrow as pa
        texts = rows.column("text").to_pylist()
        counts = [c for c in map(term_counts, texts) if c is not None]
        c = spherical_kmeans(np.array([vector(x, idf) for x in counts]), clusters) if counts else np.zeros((0, DIMS))
        least = limits(texts, idf, clusters, min_cosine).tolist()
        return pa.table({"lang": pa.array(rows.column("lang").to_pylist()[:1] * len(c), pa.string()),
                         "centroid": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary()),
                         "limits": pa.array([least] * len(c), pa.list_(pa.float64()))})

    rows = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary, limits array<double>") \
        .limit(MAX_LANGUAGES * clusters + 1).collect()
    if len(rows) > MAX_LANGUAGES * clusters:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    matrix = np.frombuffer(b"".join(r["centroid"] for r in rows), dtype="<f4").reshape(len(rows), DIMS)
    least = np.array([r["limits"] for r in rows]).reshape(len(rows), DIMS_BITS + 1)
    return Model([r["lang"] for r in rows], matrix, idf, least)
