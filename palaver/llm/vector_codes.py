"""Vector code compression with per-dimension value dictionaries.

Vectors of integers ``floor(1024 * x)`` are cut into ``parts`` equal
consecutive parts; each part is coded by the nearest entry of its codebook.
Rows are stored once in blocks of at most ``BLOCK`` rows: per dimension the
sorted distinct integers of the block (its dictionary) and one dictionary code
per row. An assignment tabulates, per dimension, the squared difference of
every dictionary value to all entries; a part's distances to all entries are
then gathers of table rows by code and adds, without a product per row.

A round assigns all parts, sums each entry's parts within a task and across
tasks (at most entries x dimensions numbers reach the driver) and replaces the
entries by floor(sum / count). Codebooks travel in the task closure; their size
is entries x dimensions, whatever the table's.

Defined results: a null vector, or one holding a null, NaN or infinity, takes
no part; shorter vectors, and dimensions that do not divide by ``parts``, are
padded with zeros; integers beyond +-2^28 count as +-2^28, so that distances
stay exact in 64 bits; the first codebook takes the smallest ids (ties by
vector; null ids last), fewer entries where there are fewer rows; ties go to
the lower entry; unused entries stay; repeated rows and null ids keep their
rows, null labels are one label; an empty table gives no rows; columns other
than the key, the vector and the label are not read, so names never clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import slices, stored

SCALE = 1024.0
LARGEST = float(1 << 28)
BLOCK = 4096
STEP = 512
MOST = int(np.iinfo(np.int64).max)


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """id, label and v, the array of floor(1024 x), of the rows that take part."""
    x = F.col(column)
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(
        F.lit(SCALE) * e.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(key).alias("id"), F.col(label).alias("label"),
                                                                 whole.alias("v"))


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """One row per block: ids, labels, dictionary sizes and values, and codes (uint16, dimension by dimension)."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for lo, hi in slices(b.num_rows, BLOCK):
                part = b.slice(lo, hi - lo)
                matrix = np.zeros((dims, hi - lo), dtype=np.int64)
                lists = part.column("v")
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(hi - lo), lengths)
                matrix[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
                values, codes = zip(*(np.unique(d, return_inverse=True) for d in matrix)) if dims else ((), ())
                packed = np.stack(codes).astype("<u2").tobytes() if dims else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id").to_pylist()], pa.list_(part.schema.field("id").type)),
                     pa.array([part.column("label").to_pylist()], pa.list_(part.schema.field("label").type)),
                     pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                     pa.array([np.concatenate(values) if dims else []], pa.list_(pa.int64())),
                     pa.array([packed], pa.binary())],
                    names=["ids", "labels", "sizes", "words", "codes"])

    return rows.select("id", "label", "v").mapInArrow(
        run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, sizes array<int>, words array<bigint>, codes binary")


def unpacked(n: int, sizes: list[int], words: np.ndarray, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """(dictionary per dimension, codes as a matrix of dimension x row) of a block."""
    edges = np.cumsum(sizes)[:-1] if len(sizes) else []
    return (np.split(words, edges) if len(sizes) else [],
            np.frombuffer(codes, dtype="<u2").reshape(len(sizes), n))


def nearest(dictionary: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance (part x row) of every part; books: part x entry x position."""
    parts, entries, width = books.shape
    n = codes.shape[1]
    best, far = np.zeros((parts, n), dtype=np.int64), np.zeros((parts, n), dtype=np.int64)
    for p in range(parts):
        tables = [(dictionary[p * width + d][:, None] - books[p, :, d][None, :]) ** 2 for d in range(width)]
        small = sum(int(t.max()) for t in tables) < np.iinfo(np.int32).max  # half the bytes to gather, still exact
        tables = [t.astype(np.int32) for t in tables] if small else tables
        for lo, hi in slices(n, STEP):
            total = np.zeros((hi - lo, entries), dtype=np.int32 if small else np.int64)
            for d, t in enumerate(tables):
                total += t[codes[p * width + d, lo:hi]]
            best[p, lo:hi] = total.argmin(axis=1)  # the first of equal distances
            far[p, lo:hi] = total[np.arange(hi - lo), best[p, lo:hi]]
    return best, far


def _of_blocks(batches):
    for b in batches:
        for ids, labels, sizes, words, codes in zip(*(b.column(c) for c in ("ids", "labels", "sizes", "words", "codes"))):
            n = len(ids.values)
            yield ids.values, labels.values, *unpacked(n, sizes.as_py(), words.values.to_numpy(), codes.as_py())


def entry_sums(stored_blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, pos, total, n: componentwise sums of the parts assigned to each used entry."""
    parts, entries, width = books.shape

    def run(batches):
        import pyarrow as pa
        total, count = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, _, dictionary, codes in _of_blocks(batches):
            best, _ = nearest(dictionary, codes, books)
            for p in range(parts):
                count[p] += np.bincount(best[p], minlength=entries)
                for d in range(width):
                    # exact: at most 4096 integers up to 2^28 in a double
                    values = dictionary[p * width + d][codes[p * width + d]].astype(np.float64)
                    total[p, :, d] += np.bincount(best[p], weights=values, minlength=entries).astype(np.int64)
        p, e = np.nonzero(count)
        at = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(a, pa.int32()) for a in at), pa.array(total[at[0], at[1], at[2]], pa.int64()),
             pa.array(count[at[0], at[1]], pa.int64())], names=["part", "entry", "pos", "total", "n"])

    return stored_blocks.mapInArrow(run, "part int, entry int, pos int, total long, n long") \
        .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(stored_blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        books = books.copy()
        for r in entry_sums(stored_blocks, books.copy()).collect():
            books[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error of every vector; the codebooks). ``vectors`` is as from ``quantised``."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    rows = stored(vectors, "vector-rows")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((parts, len(first), width), dtype=np.int64)
    for e, r in enumerate(first):
        line = np.zeros(parts * width, dtype=np.int64)
        line[:len(r["v"])] = r["v"]
        books[:, e] = line.reshape(parts, width)
    coded = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not first:
        return rows.sparkSession.createDataFrame([], coded), books
    packed = stored(blocks(rows, parts * width), "vector-blocks")
    books = train(packed, books, rounds)

    def run(batches):
        import pyarrow as pa
        for ids, labels, dictionary, codes in _of_blocks(batches):
            best, far = nearest(dictionary, codes, books)
            names = ["".join(f"{e:02x}" for e in row) for row in best.T.tolist()]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(names, pa.string()), pa.array(far.sum(axis=0), pa.int64())],
                                             names=["id", "label", "code", "error"])

    return packed.mapInArrow(run, coded), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels (clipped to a long), nulls as one label."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
