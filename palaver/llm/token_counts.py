"""Token counts through a digest cache.

The key of the cache is (SHA-256 of the normalised content, digest of the
tokenizer). Normalising means only "null is the empty text": anything further
could change a count. A run

1. keeps one text per digest (partial aggregate before the shuffle, so a
   text copied millions of times leaves each map task once),
2. drops the digests that the cache already holds (anti join),
3. encodes the rest, whole, and appends the counts to the cache,
4. joins every document's digest to the cache.

The cache has one writer at a time. Defined results: null or empty text has
0 tokens and 0 bytes; repeated rows give repeated rows; a null ``doc_id`` is
kept as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import read_if_exists, slices, whole_text

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
ENCODE_ROWS = 64


def tokenizer_version(model_path: str) -> str:
    """Digest of the model file and the library release that reads it."""
    with open(model_path, "rb") as f:
        h = hashlib.sha256(f.read())
    if model_path.endswith(".model"):
        import sentencepiece
        h.update(f"sentencepiece {sentencepiece.__version__}".encode())
    else:
        import tokenizers
        h.update(f"tokenizers {tokenizers.__version__}".encode())
    return h.hexdigest()


def counter(model_path: str):
    """A function from a list of texts to their token counts."""
    if model_path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(model_path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def encode_misses(misses: DataFrame, model_path: str, version: str) -> DataFrame:
    def run(batches):
        import os

        import pyarrow as pa
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        count = counter(model_path)
        for b in batches:
            for lo, hi in slices(b.num_rows, ENCODE_ROWS):
                part = b.slice(lo, hi - lo)
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                    names=["digest", "version", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) per row."""
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    keyed = docs.select("doc_id", whole_text().alias("text")) \
        .withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = read_if_exists(spark, cache_path, CACHE_SCHEMA).filter(F.col("version") == version)
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]) \
        .join(known.select("digest"), "digest", "left_anti")
    encode_misses(misses, model_path, version).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) \
        .filter(F.col("version") == version).select("digest", "n_tokens")
    return (keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
            .join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
