"""Packing by power-of-two decomposition.

A document's token ids (its tokens and a closing id) are cut into pieces whose
lengths are powers of two: as many of the longest length as fit, then the
binary digits of the rest, longest first. Pieces of one length form a bucket
and every piece is a sequence of its own, so no sequence crosses documents,
none needs padding, and a batch drawn from one bucket has one length.

Sequence ids number the buckets from the longest length down, without gaps:
the pieces are written once with their task and their place among the task's
pieces of that length, and per (length, task) offsets turn these into one
numbering. Written rows keep their numbers whichever executor is lost later.

Words are encoded once per task: the tokenizer treats the text between white
space on its own, so the ids of a chunk are kept (up to ``CACHE_WORDS``) and
joined as bytes.

Defined results: a null or empty text is the closing id alone (one piece of
length 1); repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from codecs import charmap_decode

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import slices, stored, whole_text

CACHE_WORDS = 300_000  # entries of each of a task's two caches
ROWS = 512
# Fixed values, as in the tokenizer's file: how it cuts lower-case text without white space. Over
# LATIN characters a word character is a letter, a digit or "_", and "_" counts as a mark; the one
# that becomes a letter and a mark in lower case (U+0130) is left to the tokenizer.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # its pre-tokenizer's pattern
LATIN = frozenset(map(chr, (*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250))))
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[\W_]+")
ID_BYTES = 4
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"
# Fixed rule of byte-level vocabularies: printable Latin-1 bytes show as themselves, the others, in
# order, as the characters from U+0100 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
HIDDEN = [b for b in range(0x100) if b not in PRINTED]
SHOWN = "".join(chr(b) if b in PRINTED else chr(0x100 + HIDDEN.index(b)) for b in range(0x100))


def cuts_by_words(tok) -> bool:
    """Whether a tokenizer has the rules that the fast path follows: composed, lower case, cut as above."""
    def rules(part) -> dict:
        return {} if part is None else json.loads(part.__getstate__())

    steps = rules(tok.normalizer).get("normalizers", [])
    before = rules(tok.pre_tokenizer).get("pretokenizers", [])
    return ([x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and before[0]["pattern"] == {"Regex": CUT} and before[0]["behavior"] == "Removed" and before[0]["invert"]
            and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
            and type(tok.model).__name__ == "BPE" and not tok.model.dropout)


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; ``longest`` is a power of two."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    size = longest >> 1
    while size:
        if (n - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


class Chunks(dict):
    """Ids of chunks as bytes, found on first use and kept while there is room."""

    def __init__(self, find):
        super().__init__({"": b""})
        self.find = find

    def __missing__(self, chunk: str) -> bytes:
        ids = self.find(chunk)
        if len(self) < CACHE_WORDS:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    ``chunks`` keeps the ids of what stands between white space, ``parts`` those
    of the words and marks that the tokenizer cuts a chunk into. Only chunks of
    Latin characters are cut here (composed already, with one lower case); the
    tokenizer gets any other chunk, and any part not seen before, itself. For a
    file with other rules (``cuts_by_words``) the tokenizer gets the whole texts.
    """

    def __init__(self, model_path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(model_path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.chunks = Chunks(self._chunk)
        self.parts = Chunks(self._part)
        self.by_words = cuts_by_words(self.tok)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_words = any(t.isalpha() for t in special)  # others are never inside letters alone

    def _part(self, part: str) -> bytes:
        """Ids of one lower-case word or run of marks, by the tokenizer's model."""
        if not part.isascii():
            part = charmap_decode(part.encode("utf-8"), "strict", SHOWN)[0]
        return array.array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk, from its parts or by the tokenizer."""
        letters = chunk.isalpha()
        latin = (letters or chunk.isprintable()) if chunk.isascii() else LATIN.issuperset(chunk)
        if not latin or self.special and (self.special_words or not letters) and self.special.search(chunk):
            return array.array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()
        low = chunk.lower()
        return self.parts[low] if letters else b"".join(map(self.parts.__getitem__, PART.findall(low)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [array.array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        # blank and line feed only: other white space stays inside a chunk
        return [b"".join(map(self.chunks.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def pieces(docs: DataFrame, model_path: str, longest: int = 2048, closing_id: int = 1) -> DataFrame:
    """One row per piece, with the task and its place among the task's pieces of that length."""
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        task = TaskContext.get().partitionId()
        encoder, places = ChunkEncoder(model_path), {}
        close = closing_id.to_bytes(ID_BYTES, "little")
        for b in batches:
            for lo, hi in slices(b.num_rows, ROWS):
                part = b.slice(lo, hi - lo)
                cols = [[] for _ in range(6)]
                texts = part.column("text").to_pylist()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    ids += close
                    n = len(ids) // ID_BYTES
                    view = memoryview(ids)
                    for start, length in cuts(n, longest):
                        place = places.get(length, 0)
                        places[length] = place + 1
                        crc = zlib.crc32(view[start * ID_BYTES:(start + length) * ID_BYTES])
                        for col, v in zip(cols, (doc_id, start, length, crc, n, place)):
                            col.append(v)
                arrays = [pa.array(cols[0], part.schema.field("doc_id").type)]
                arrays += [pa.array(c, pa.int64()) for c in cols[1:5]]
                arrays += [pa.array([task] * len(cols[0]), pa.int32()), pa.array(cols[5], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, model_path: str, longest: int = 2048, closing_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    cut = stored(pieces(docs, model_path, longest, closing_id), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # at most log2(longest) + 1 rows
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    base = lengths.select("length", F.coalesce(F.sum("n").over(
        Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = per_task.select("length", "task", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before"))
    offsets = within.join(base, "length").select("length", "task", (F.col("base") + F.col("before")).alias("first"))
    return cut.join(offsets, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
