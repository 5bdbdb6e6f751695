"""Registered queries of the training-data operators, one per operator.

Each applies its operator, with production parameters, to its whole table and
derives the result columns asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import (divergence, jaccard, language, license_scan, mixing, packing, pii, simhash, token_counts, topk,
                         toxicity, url_filter, vector_codes)
from palaver.llm.common import id_crc, table, tokenizer_path
from palaver.session import scratch_path

URL_RULES = [
    url_filter.Rule(url_filter.BLOCK, "net/"),
    url_filter.Rule(url_filter.ALLOW, "example.net/en/"),
    url_filter.Rule(url_filter.BLOCK, "example.com/de/"),
    url_filter.Rule(url_filter.ALLOW, "org/fr/"),
]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_documents(table(spark, sf_dir, "documents"), radius=3)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", simhash.shown(F.col("fp")).alias("fingerprint"),
        simhash.shown(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near", "n_same",
        simhash.shown(F.col("class_fp")).alias("class_fingerprint"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"),
                        longest=2048, closing_id=1)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    model = language.fit(docs, learn=id_crc() % 4 != 2)
    seen = docs.select("doc_id", held_out.alias("held_out"), model.column(F.col("text")).alias("p"))
    return seen.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("id") % 50 == 0), k=5)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_classes(table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", "class_id", "n_links")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"),
                                     scratch_path(spark, "token-cache"), limit=4096)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=id_crc() % 5 != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), license_scan.joined_labels(base).alias("base_labels"),
        license_scan.joined_labels(F.col("found")).alias("labels"), "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, most=200)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(vector_codes.quantised(table(spark, sf_dir, "embeddings")),
                                         parts=4, entries=256, rounds=4)
    return vector_codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_exact_topk": op6_exact_topk,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_license_scans": op11_license_scans,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}
