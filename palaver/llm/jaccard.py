"""N-gram Jaccard join with Bayesian candidate pruning.

A text is its set of shingles of ``WORDS`` words (lower-case runs of letters and
digits; a shorter text is one shingle). All pairs of different texts with
Jaccard likeness of ``threshold`` or more are found:

1. equal word sequences form one copy class, so copies are never compared;
2. each class has ``HASHES`` MinHash values; classes that agree in all
   ``ROWS`` values of one of ``BANDS`` bands share a bucket (a pair at 0.8
   shares none with probability 3e-5);
3. the members of a bucket meet in blocks of at most ``CHUNK``. MinHash values
   are compared 16 at a time, and a pair is dropped once the posterior
   probability (uniform prior) that it reaches the threshold falls below
   ``tolerance``;
4. what is left is verified exactly on the whole shingle sets.

A block returns no pairs but, per member, its number of links and the smallest
member that its links lead to; so a group of thousands of near copies costs rows
in proportion to its size. A pair is looked at once: buckets with the same
members are merged; a pair counts in the first band it shares; and buckets over
``CHUNK`` members that share members are joined to one group, whose blocks meet
pairwise, while small buckets leave out pairs inside such a group.

Groups are the connected components of the links. Defined results: a text
without a word is a copy only of equal non-empty texts; null and empty texts are
alone in their group; a null id is larger than any other when the smallest id of
a group is taken; a row repeated whole is a copy like any other.
"""

from __future__ import annotations

import functools
import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import slices, stored, whole_text

WORDS = 5
HASHES, BANDS, ROWS = 128, 20, 4
STEP = 16
CHUNK = 1024
SEED = 20240229


@functools.cache
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    one = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, dtype=np.uint64))))
    return one(base), one(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word of the whole text, in order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, dtype=bool)
    inside[1:-1] = _word_chars()[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(1 << max(12, (len(codes) - 1).bit_length()))
    total = np.concatenate(([np.uint64(0)], np.cumsum(codes.astype(np.uint64) * up[:len(codes)], dtype=np.uint64)))
    return _mix((total[end] - total[start]) * down[start])


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of WORDS words."""
    k = min(WORDS, len(words))
    if not k:
        return words
    h = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + words[i:len(words) - k + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), \
        rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minhash(sh: np.ndarray) -> np.ndarray:
    a, b = _functions()
    out = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for lo, hi in slices(len(sh), 1024):
        values = (sh[lo:hi, None] * a[None, :] + b[None, :]) >> np.uint64(32)
        out = np.minimum(out, values.min(axis=0).astype(np.uint32))
    return out


def content_key(text: str, words: np.ndarray) -> bytes | None:
    """Equal for texts with the same words (without words: for equal texts)."""
    if len(words):
        return hashlib.blake2b(words.tobytes(), digest_size=16, person=b"words").digest()
    return hashlib.blake2b(text.encode("utf-8"), digest_size=16, person=b"raw").digest() if text else None


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, .. the fewest matches that keep P(likeness >= threshold) >= tolerance.

    With a uniform prior that probability, after m of n matches, is that of
    at most m successes in n + 1 trials.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def survivors(sig: np.ndarray, ask: np.ndarray, left: np.ndarray, right: np.ndarray, need: list[int]):
    """Index pairs (of left x right, where ``ask`` holds) that pruning leaves."""
    same = np.zeros((len(left), len(right)), dtype=np.uint8)
    for i in range(STEP):
        same += sig[left, i][:, None] == sig[right, i][None, :]
    a, b = np.nonzero(ask & (same >= need[0]))
    kept_a, kept_b = [], []
    for lo, hi in slices(len(a), 100_000):
        x, y = a[lo:hi], b[lo:hi]
        m = same[x, y].astype(np.int64)
        for k in range(1, len(need)):
            cols = slice(k * STEP, (k + 1) * STEP)
            m = m + (sig[left[x], cols] == sig[right[y], cols]).sum(axis=1)
            ok = m >= need[k]
            x, y, m = x[ok], y[ok], m[ok]
        kept_a.append(left[x])
        kept_b.append(right[y])
    return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (a, b)


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which index pairs reach the threshold, on the whole sets."""
    size = np.array([len(s) for s in sets])
    ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    common = np.zeros(len(a))
    live = np.flatnonzero(ok)
    if len(live) <= 4 * len(sets):
        for i in live:
            common[i] = len(np.intersect1d(sets[a[i]], sets[b[i]], assume_unique=True))
    else:  # many pairs of few members: intersections by incidence matrices, a slice of shingles at a time
        rows, cols = np.unique(a[live]), np.unique(b[live])
        row_at, col_at = np.searchsorted(rows, a[live]), np.searchsorted(cols, b[live])
        terms = np.unique(np.concatenate([sets[i] for i in np.union1d(rows, cols)]))
        for lo, hi in slices(len(terms), 8192):
            part = terms[lo:hi]

            def incidence(members, part=part):
                m = np.zeros((len(members), len(part)), dtype=np.float32)
                for r, i in enumerate(members):
                    s = sets[i]
                    s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                    m[r, np.searchsorted(part, s)] = 1
                return m

            common[live] += (incidence(rows) @ incidence(cols).T)[row_at, col_at]
    return ok & (common / np.maximum(1, size[a] + size[b] - common) >= threshold)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each index."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_block(keys, sig, sets, copies, part, group, band: int, threshold: float, need: list[int]):
    """(key, links in documents, smallest linked key) of the members of one block that have links.

    ``part``: chunk of each member (all equal inside one chunk); ``band``: the
    bucket's band, or -1 inside a group, where every pair counts.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, sig, sets = [keys[i] for i in order], sig[order], [sets[i] for i in order]
    copies, part, group = copies[order], part[order], [group[i] for i in order]
    lo, hi = part.min(), part.max()
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    ask = left[:, None] < right[None, :] if lo == hi else np.ones((len(left), len(right)), dtype=bool)
    for e in range(max(0, band)):
        cols = sig[:, e * ROWS:(e + 1) * ROWS]
        _, same = np.unique(cols, axis=0, return_inverse=True)
        same = same.reshape(-1)
        ask &= same[left][:, None] != same[right][None, :]
    if band >= 0 and any(g is not None for g in group):
        code = {g: i for i, g in enumerate({g for g in group if g is not None})}
        own = np.array([code.get(g, -1) for g in group])
        ask &= (own[left][:, None] != own[right][None, :]) | (own[left][:, None] < 0)
    a, b = survivors(sig, ask, left, right, need)
    if len(a):
        good = verified(sets, a, b, threshold)
        a, b = a[good], b[good]
    if not len(a):
        return
    links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
    label = least_labels(len(keys), a, b)
    for i in np.flatnonzero(links):
        yield keys[i], int(links[i]), keys[label[i]]


def _grouped(batches: Iterator, key: list[str]) -> Iterator:
    """Tables of equal ``key`` from record batches sorted by it."""
    import pyarrow as pa
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = list(zip(*[b.column(k).to_pylist() for k in key]))
        start = 0
        for i, c in enumerate(cols):
            if c != last:
                if held or i > start:
                    yield last, pa.Table.from_batches([*held, b.slice(start, i - start)])
                held, start, last = [], i, c
        held.append(b.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), key, n_shingles, sig per row."""
    keyed = docs.select("doc_id", whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for lo, hi in slices(b.num_rows, 256):
                part = b.slice(lo, hi - lo)
                key, n, sig = [], [], []
                for text in part.column("text").to_pylist():
                    words = word_hashes(text)
                    sh = shingles(words)
                    key.append(content_key(text, words))
                    n.append(len(sh))
                    sig.append(minhash(sh).astype("<u4").tobytes() if len(sh) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(key, pa.binary()), pa.array(n, pa.int64()),
                     pa.array(sig, pa.binary())], names=["doc_id", "th", "key", "n_shingles", "sig"])

    return keyed.mapInArrow(run, f"doc_id {id_type}, th long, key binary, n_shingles long, sig binary")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node of its component), for edges that join two different nodes.

    Large-star and small-star steps in turn (every node's neighbours move to the
    smallest of them) until all edges lead to a root; each round is written
    to the shared scratch folder.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # written, so that both sides of the join are plain exchanges and a hub can be split
        low = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        moved = near.join(low, "u")
        moved = moved.filter("v > u") if large else moved
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    state = None
    while now.take(1):
        now = stored(star(star(now, True), False), "cc")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    # every edge now leads to a root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _band_rows(classes: DataFrame) -> DataFrame:
    """key, band, h for every band of every class that has shingles."""
    each = [F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]
    return classes.filter("n_shingles > 0").select("key", F.posexplode(F.array(*each)).alias("band", "h"))


def near_links(classes: DataFrame, docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """key, links (in documents), label per class with links; a class may have several rows.

    ``classes``: key, doc_id and th of one of its documents, copies, n_shingles, sig.
    """
    need = least_matches(threshold, tolerance)
    bands = _band_rows(classes)
    buckets = stored(bands.groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x1"),
        F.sum(F.shiftright(F.xxhash64("key", F.lit(1)), 20)).alias("x2"), F.min("key").alias("first"))
        .filter("n > 1"), "buckets")
    # small buckets with the same members are one; the lowest band stands for them
    small = buckets.filter(F.col("n") <= CHUNK).groupBy("n", "x1", "x2") \
        .agg(F.min(F.struct("band", "h")).alias("b")).select("b.band", "b.h")
    large = buckets.filter(F.col("n") > CHUNK).select("band", "h", "first")
    groups = components(bands.join(large, ["band", "h"]).select("key", "first"), "key", "first")
    groups = stored(groups.select(F.col("node").alias("key"), F.col("root").alias("grp")), "groups")
    chunk_count = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))

    in_small = bands.join(small, ["band", "h"]).join(groups, "key", "left") \
        .select("key", F.col("grp"), "band", "h", F.lit(0).alias("part"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    in_large = groups.join(chunk_count, "grp") \
        .withColumn("part", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .select("key", "grp", F.lit(-1).alias("band"), F.xxhash64("grp").alias("h"), "part",
                F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    members = stored(in_small.unionByName(in_large), "members")

    # whole shingle sets of the members alone, from one document of each class
    wanted = classes.join(members.select("key").distinct(), "key", "left_semi") \
        .select("key", "doc_id", "th", "copies", "sig")
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    with_text = wanted.join(texts, (wanted["th"] == texts["th"]) & wanted["doc_id"].eqNullSafe(texts["doc_id"])) \
        .select("key", "copies", "sig", "text")

    def to_sets(batches):
        import pyarrow as pa
        for b in batches:
            for lo, hi in slices(b.num_rows, 256):
                part = b.slice(lo, hi - lo)
                sets = [shingles(word_hashes(t)).astype("<u8").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())],
                                                 names=["key", "copies", "sig", "sh"])

    sets = with_text.mapInArrow(to_sets, "key binary, copies long, sig binary, sh binary").dropDuplicates(["key"])
    group_key = ["band", "h", "lo", "hi"]
    dealt = members.join(sets, "key").repartition(*group_key).sortWithinPartitions(*group_key)

    def run(batches):
        import pyarrow as pa
        for (band, *_), t in _grouped(batches, group_key):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u4").reshape(-1, HASHES)
            sh = [np.frombuffer(s, dtype="<u8") for s in t.column("sh").to_pylist()]
            found = list(link_block(t.column("key").to_pylist(), sig, sh,
                                    np.array(t.column("copies").to_pylist(), dtype=float),
                                    np.array(t.column("part").to_pylist()), t.column("grp").to_pylist(),
                                    band, threshold, need))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()),
                     pa.array([f[2] for f in found], pa.binary())], names=["key", "links", "label"])

    return dealt.mapInArrow(run, "key binary, links long, label binary")


def near_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-4) -> DataFrame:
    """doc_id, th, class_id, class_th, n_links per row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest id of the row's group (``class_th`` the hash of
    that document's text), ``n_links`` the number of other documents with a
    likeness of ``threshold`` or more.
    """
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = stored(signed.filter("key is not null").groupBy("key").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"),
        F.min("sig").alias("sig"))
        .select("key", "first.doc_id", "first.th", "copies", "n_shingles", "sig"), "classes")
    found = stored(near_links(classes, docs, threshold, tolerance), "links")
    roots = components(found, "key", "label")
    linked = classes.select("key", "doc_id", "th", "copies") \
        .join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left") \
        .join(roots.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    least = linked.groupBy("root").agg(F.min(first).alias("first"))
    result = stored(linked.join(least, "root").select(
        "key", F.col("first.doc_id").alias("class_id"), F.col("first.th").alias("class_th"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    slim = signed.select("doc_id", "th", "key")
    alone = slim.filter("key is null").select("doc_id", "th", F.col("doc_id").alias("class_id"),
                                              F.col("th").alias("class_th"), F.lit(0).cast("long").alias("n_links"))
    return slim.filter("key is not null").join(result, "key") \
        .select("doc_id", "th", "class_id", "class_th", "n_links").unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-4) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each group.

    The document with the smallest id stays. A row repeated whole stays once. Null
    and empty texts have no group and all stay.
    """
    full = docs.filter(whole_text() != "")
    found = near_classes(full, threshold, tolerance)
    stay = found.select(F.col("class_id").alias("__id"), F.col("class_th").alias("__th")).distinct()
    marked = full.withColumn("__own", F.xxhash64(whole_text()))
    kept = marked.join(stay, (F.col("__own") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__own"]).drop("__own").unionByName(docs.filter(whole_text() == ""))
