"""Source divergence audit by a minimal-perfect-hash recount.

How far do the term frequencies of a source lie from those of the other
sources of its language, and which terms stand out against the language?

1. Exact frequency filter: documents per (language, term), counted in every
   task and summed; terms of ``least`` documents or more are kept.
2. A minimal perfect hash over the kept terms, in shards by (language, crc32
   of the term): terms are thrown into buckets, largest buckets first find a
   displacement that sends them to free slots, single terms get the next free
   one. Every slot stores its term (a SHA-256 of terms over ``KEY_BYTES``), so
   a term that is not kept never passes for one that is.
3. The shards are broadcast in waves of at most ``wave_bytes``, which is
   checked. The second pass counts each task's terms per (language, source),
   finds slots by arithmetic on whole arrays and increments dense slots of
   each group; what it sends on are (slot, count) numbers, not terms. With
   more than one wave the terms are counted once, written by wave, and every
   wave reads its own.
4. Per (language, shard), all sources of the language lie in one matrix of
   bounded size: partial sums of divergences between sources, and each
   source's highest terms of the shard. Sums and ranks follow.

With c occurrences, N the group's sum over kept terms, V kept terms:
p = 1 + floor(SCALE * (c + 1) / (N + V)), value floor((p - q) * (p - q) / q),
all in integers (Python's beyond 64 bits).

Defined results: null text, language or source count as ''; a group without
kept terms has p of zero counts; a language without kept terms has values 0
and no term rows; very long texts and terms are counted whole; ties go to the
smaller item by UTF-8 bytes; repeated rows are documents of their own; an empty
table gives no rows; only ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import stored, whole_text
from palaver.session import scratch_path

SCALE = 1_000_000_000
KEY_BYTES = 64
WAVE_BYTES = 64 << 20
SHARD_TERMS = 4096
MATRIX_CELLS = 1 << 20
HELD_TERMS = 400_000  # distinct terms a task holds before it sends its counts on
HELD_TOKENS = 8 << 20  # and occurrences
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def stored_key(term: bytes) -> bytes:
    return term if len(term) <= KEY_BYTES else hashlib.sha256(term).digest()


# -- minimal perfect hash

def hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    raw = b"".join([hashlib.blake2b(k, digest_size=16).digest() for k in keys])
    return np.frombuffer(raw, dtype="<u8").reshape(-1, 2)


def slot(low: np.ndarray, move: np.ndarray, n) -> np.ndarray:
    """Slot of a hash after ``move`` displacements among n slots."""
    z = low ^ (move.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) % np.uint64(n) if np.isscalar(n) else (z ^ (z >> np.uint64(31))) % n


def bucket_count(n: int) -> int:
    return max(1, -(-n // 4))


def perfect_hash(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacement per bucket, key index per slot) over distinct keys.

    A displacement below 0 names the slot of a bucket's only key: -1 - slot.
    """
    n = len(keys)
    both = hashes(keys)
    bucket = (both[:, 0] % np.uint64(bucket_count(n))).astype(np.int64)
    moves = np.zeros(bucket_count(n), dtype=np.int64)
    owner = np.full(n, -1, dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(len(moves) + 1))
    free = 0
    for b in np.argsort(edges[:-1] - edges[1:], kind="stable"):
        members = order[edges[b]:edges[b + 1]]
        if not len(members):
            break
        if len(members) == 1:
            while owner[free] >= 0:
                free += 1
            moves[b], owner[free] = -1 - free, members[0]
            continue
        low = both[members, 1][:, None]
        for start in itertools.count(0, 256):
            tried = np.arange(start, start + 256)
            at = slot(low, tried[None, :], n).astype(np.int64)
            ranked = np.sort(at, axis=0)
            fits = (owner[at] < 0).all(axis=0) & (ranked[1:] != ranked[:-1]).all(axis=0)
            if fits.any():
                pick = int(np.argmax(fits))
                moves[b] = start + pick
                owner[at[:, pick]] = members
                break
    return moves, owner


class Shards:
    """Lookup over the shards of one wave, in flat arrays; a language's slots lie side by side."""

    def __init__(self, rows: list[tuple[str, int, list[int], list[bytes]]], n_shards: int):
        """rows: (language, shard, displacements, stored keys by slot)."""
        rows = sorted(rows, key=lambda r: r[:2])
        self.n_shards = n_shards
        self.shard = np.array([r[1] for r in rows], dtype=np.int64)
        self.size = np.array([len(r[3]) for r in rows], dtype=np.uint64)
        self.buckets = np.array([len(r[2]) for r in rows], dtype=np.uint64)
        self.moves = np.concatenate([np.asarray(r[2], dtype=np.int64) for r in rows])
        self.first_move = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int64)
        self.first_key = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int64)
        self.rows_of: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            self.rows_of.setdefault(r[0], []).append(i)
        keys = [k for r in rows for k in r[3]]
        self.edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        self.keys = b"".join(keys)

    def find(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """Slot of each term among all slots of the wave, -1 for a term that has none."""
        out = np.full(len(terms), -1, dtype=np.int64)
        rows = self.rows_of.get(lang)
        if rows is None:
            return out
        row = np.full(self.n_shards, -1, dtype=np.int64)
        row[self.shard[rows]] = rows
        own = row[np.fromiter(map(zlib.crc32, terms), dtype=np.int64, count=len(terms)) % self.n_shards]
        there = np.flatnonzero(own >= 0)
        own = own[there]
        keys = [k if len(k) <= KEY_BYTES else stored_key(k) for k in (terms if len(there) == len(terms) else
                                                                       [terms[i] for i in there.tolist()])]
        both = hashes(keys)
        move = self.moves[self.first_move[own] + (both[:, 0] % self.buckets[own]).astype(np.int64)]
        at = np.where(move < 0, -1 - move, slot(both[:, 1], np.maximum(move, 0), self.size[own]).astype(np.int64))
        place = self.first_key[own] + at
        lo, hi, blob = self.edges[place].tolist(), self.edges[place + 1].tolist(), self.keys
        same = np.array([blob[a:b] == k for a, b, k in zip(lo, hi, keys)], dtype=bool)
        out[there[same]] = place[same]
        return out


# -- passes over the documents

def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n: documents that hold the term, summed by task only."""
    def run(batches):
        import pyarrow as pa

        def rows(held):
            for lang, seen in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()),
                     pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())],
                    names=["lang", "term", "n"])

        held: dict[str, Counter] = {}
        n = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                own = held.setdefault(lang, Counter())
                n -= len(own)
                own.update(set(terms_of(text)))
                n += len(own)
                if n > HELD_TERMS:
                    yield from rows(held)
                    held, n = {}, 0
        yield from rows(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")


Counted = tuple[str, list[bytes], dict[str, tuple[np.ndarray, np.ndarray | None]]]


def group_terms(batches) -> Iterator[Counted]:
    """(lang, distinct terms, {source: (indices into the terms, one per occurrence; None)}) of a task's documents."""
    numbers: dict[str, defaultdict] = {}  # lang -> term -> index
    seen: dict[str, dict[str, list[np.ndarray]]] = {}
    terms = tokens = 0

    def rows():
        for lang, index in numbers.items():
            yield lang, list(index), {s: (np.concatenate(parts), None) for s, parts in seen[lang].items()}

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            if lang not in numbers:
                numbers[lang], seen[lang] = defaultdict(itertools.count().__next__), {}
            index = numbers[lang]
            terms -= len(index)
            ids = np.array([index[t] for t in terms_of(text)], dtype=np.int32)
            terms += len(index)
            tokens += len(ids)
            seen[lang].setdefault(source, []).append(ids)
            if terms > HELD_TERMS or tokens > HELD_TOKENS:
                yield from rows()
                numbers, seen, terms, tokens = {}, {}, 0, 0
    yield from rows()


def slot_rows(counted: Iterator[Counted], shards: Shards):
    """Record batches (lang, source, shard, cells): each group's dense slots, incremented, then those above 0."""
    import pyarrow as pa
    for lang, terms, groups in counted:
        place = shards.find(lang, terms)
        own = shards.rows_of.get(lang)
        if own is None:
            continue
        first, last = int(shards.first_key[own[0]]), int(shards.first_key[own[-1] + 1])
        for source, (ids, weight) in groups.items():
            at = place[ids]
            known = at >= 0
            at = at[known] - first
            weight = None if weight is None else weight[known]
            dense = np.bincount(at, weights=weight, minlength=last - first)  # sums below 2^53: exact
            used = np.flatnonzero(dense)
            row = np.searchsorted(shards.first_key, used + first, side="right") - 1
            edges = np.flatnonzero(np.diff(row, prepend=-1, append=len(shards.shard)))
            if not len(used):
                continue
            cells = pa.StructArray.from_arrays([pa.array(used + first - shards.first_key[row], pa.int32()),
                                                pa.array(dense[used].astype(np.int64))], names=["slot", "n"])
            heads = row[edges[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(heads), pa.string()), pa.array([source] * len(heads), pa.string()),
                 pa.array(shards.shard[heads], pa.int32()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), cells)],
                names=["lang", "source", "shard", "cells"])


CELLS = "lang string, source string, shard int, cells array<struct<slot: int, n: bigint>>"


def waves(shards: DataFrame, wave_bytes: int) -> tuple[DataFrame, int]:
    """``shards`` with a wave each, so that no wave holds more than ``wave_bytes`` of keys and displacements."""
    size = F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + F.octet_length(k) + 8) + 8 * F.size("moves")
    sized = shards.withColumn("bytes", size)
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-total // wave_bytes))
    while True:
        dealt = sized.withColumn("wave", wave_of(F.col("lang"), F.col("shard"), n))
        largest = dealt.groupBy("wave").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")) \
            .filter((F.col("b") > wave_bytes) & (F.col("n") > 1)).limit(1).count()
        if not largest:
            return dealt.drop("bytes"), n
        n *= 2


def wave_of(lang, shard, n: int):
    return F.pmod(F.xxhash64(lang, shard.cast("int")), F.lit(n)).cast("int")


def recount(docs: DataFrame, shards: DataFrame, n_shards: int, wave_bytes: int) -> DataFrame:
    """lang, source, shard, slot, n: occurrences of every kept term that a group has."""
    spark = docs.sparkSession
    dealt, n_waves = waves(shards, wave_bytes)
    path = None
    if n_waves > 1:
        def run_counts(batches):
            import pyarrow as pa
            for lang, terms, groups in group_terms(batches):
                shard = np.fromiter(map(zlib.crc32, terms), dtype=np.int64, count=len(terms)) % n_shards
                words = pa.array(terms, pa.binary())
                for source, (ids, _) in groups.items():
                    used, n = np.unique(ids, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(used), pa.string()), pa.array([source] * len(used), pa.string()),
                         words.take(pa.array(used)), pa.array(n, pa.int64()), pa.array(shard[used], pa.int32())],
                        names=["lang", "source", "term", "n", "shard"])

        path = scratch_path(spark, "divergence-terms")
        docs.mapInArrow(run_counts, "lang string, source string, term binary, n long, shard int") \
            .withColumn("wave", wave_of(F.col("lang"), F.col("shard"), n_waves)) \
            .write.partitionBy("wave").parquet(path)
    parts = []
    for w in range(n_waves):
        rows = [(r["lang"], r["shard"], r["moves"], [bytes(k) for k in r["keys"]])
                for r in dealt.filter(F.col("wave") == w).select("lang", "shard", "moves", "keys").collect()]
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Shards(rows, n_shards))
        if path is None:
            parts.append(docs.mapInArrow(lambda batches, sent=sent: slot_rows(group_terms(batches), sent.value), CELLS))
            continue

        def run_wave(batches, sent=sent):
            def counted():
                for b in batches:
                    numbers, seen = {}, {}
                    for lang, source, term, n in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "term", "n"))):
                        index = numbers.setdefault(lang, {})
                        seen.setdefault(lang, {}).setdefault(source, []).append((index.setdefault(term, len(index)), n))
                    for lang, index in numbers.items():
                        yield lang, list(index), {s: tuple(np.array(c, dtype=np.int64) for c in zip(*pairs))
                                                  for s, pairs in seen[lang].items()}
            return slot_rows(counted(), sent.value)

        mine = spark.read.schema("lang string, source string, term binary, n long, wave int").parquet(path) \
            .filter(F.col("wave") == w).drop("wave").mapInArrow(run_wave, CELLS)
        # written before the next wave, so that one broadcast is held at a time
        parts.append(stored(mine, "divergence-wave"))
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "lang string, source string, shard int, slot int, n long")
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    return cells.select("lang", "source", "shard", F.inline("cells")) \
        .groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


# -- divergences

def scaled(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact; no count exceeds its total."""
    c = counts + 1
    if int(c.max(initial=0)) > np.iinfo(np.int64).max // SCALE:
        return np.asarray(1 + SCALE * c.astype(object) // total.astype(object)).astype(np.int64)
    return 1 + SCALE * c // total


def shard_rows(sources: list[str], n: np.ndarray, v: int, src: np.ndarray, at: np.ndarray, counts: np.ndarray,
               terms: list[str], most: int) -> Iterator[tuple[str, str, str, int]]:
    """(source, part, item, value): this shard's part of each pair's sum, and its highest terms of each source."""
    matrix = np.zeros((len(sources), len(terms)), dtype=np.int64)
    matrix[src, at] = counts
    p = scaled(matrix, (n + v)[:, None]) if v else matrix
    q = scaled(matrix.sum(axis=0), np.array([n.sum() + v])) if v else None
    for a, source in enumerate(sources):
        total = ((p[a] - p) ** 2 // p).sum(axis=1).tolist() if v else [0] * len(sources)
        for b, other in enumerate(sources):
            if a != b:
                yield source, "pair", other, total[b]
        if not v:
            continue
        high = np.flatnonzero((matrix[a] > 0) & (p[a] > q))
        value = (p[a, high] - q[high]) ** 2 // q[high]
        if len(high) > most:  # those below the most-th value cannot rank
            floor = np.partition(value, len(value) - most)[len(value) - most]
            high, value = high[value >= floor], value[value >= floor]
        for f, term in sorted((-f, terms[i]) for f, i in zip(value.tolist(), high))[:most]:
            yield source, "term", term, -f


def audit(docs: DataFrame, least: int = 3, most: int = 200, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every (lang, source)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       whole_text().alias("text"))
    kept = stored(document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"))
                  .filter(F.col("n") >= least).select("lang", "term"), "divergence-kept")
    groups = stored(docs.select("lang", "source").distinct(), "divergence-groups")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    largest = vocabulary.agg(F.max("v")).first()[0] or 0
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    per_shard = max(64, min(SHARD_TERMS, MATRIX_CELLS // max(1, widest)))
    n_shards = max(1, -(-largest // per_shard))

    def build(key, rows):
        import pyarrow as pa
        terms = [t.encode("utf-8", "surrogatepass") for t in rows.column("term").to_pylist()]
        moves, owner = perfect_hash([stored_key(t) for t in terms])
        ordered = [terms[i] for i in owner]
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int32()),
                         "moves": pa.array([moves.tolist()], pa.list_(pa.int64())),
                         "keys": pa.array([[stored_key(t) for t in ordered]], pa.list_(pa.binary())),
                         "terms": pa.array([[t.decode("utf-8", "surrogatepass") for t in ordered]], pa.list_(pa.string()))})

    shard = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(n_shards)).cast("int")
    shards = stored(kept.withColumn("shard", shard).groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard int, moves array<bigint>, keys array<binary>, terms array<string>"),
        "divergence-shards")
    cells = stored(recount(docs, shards, n_shards, wave_bytes), "divergence-cells")

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    heads = (groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
             .join(shards.select("lang", "shard"), "lang", "left")
             .select("lang", "source", F.coalesce("shard", F.lit(0)).alias("shard"), F.lit(-1).alias("slot"),
                     F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    rows = heads.unionByName(cells.withColumn("v", F.lit(None).cast("long")))

    def compare(key, left, right):
        import pyarrow as pa
        slots = left.column("slot").to_numpy()
        head = left.filter(pa.array(slots < 0)).sort_by("source")
        body = left.filter(pa.array(slots >= 0))
        sources = head.column("source").to_pylist()
        place = {s: i for i, s in enumerate(sources)}
        src = np.array([place[s] for s in body.column("source").to_pylist()], dtype=np.int64)
        terms = right.column("terms").to_pylist()[0] if right.num_rows else []
        out = list(shard_rows(sources, head.column("n").to_numpy(), head.column("v").to_pylist()[0], src,
                              body.column("slot").to_numpy(), body.column("n").to_numpy(), terms, most))
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()),
                         **{c: pa.array(columns[i], pa.string()) for i, c in enumerate(("source", "part", "item"))},
                         "value": pa.array(columns[3], pa.int64())})

    found = stored(rows.groupBy("lang", "shard").cogroup(shards.select("lang", "shard", "terms").groupBy("lang", "shard"))
                   .applyInArrow(compare, "lang string, source string, part string, item string, value long"),
                   "divergence-parts")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")) \
        .withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return pairs.unionByName(terms)
