"""Corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.

1. language_id: learn centroids from the rows with a language and drop the
   documents that the method rejects (no letter, or too far from all centroids);
2. near_duplicates: one document of each group of near copies stays (smallest id);
3. personal_data: every span of personal data becomes its kind, as ``<email>``;
4. mixing: rows repeated or left out so that sources come to their target weights;
5. packing: pieces of power-of-two length, one row each.

There is no SQL for the whole (centroids, expectation-maximisation, tokens);
the tests hold the stages against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import jaccard, language, mixing, packing, pii
from palaver.llm.common import table, tokenizer_path
from palaver.session import scratch_path, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known by distance. A null text, or one without a letter, goes; rows with a null
    language or id are judged like others; long texts are judged whole; repeated rows stay or go together."""
    ship_package(spark)
    model = language.fit(docs, learn=F.lit(True))
    return docs.withColumn("__language", model.column(F.col("text"))) \
        .filter(~F.col("__language.rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the smallest id (nulls last); rows without a word stay as they are.
    Texts of any length are compared by all of their five-word shingles."""
    ship_package(spark)
    return jaccard.keep_one(docs, threshold=0.8).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its spans of personal data replaced and ``n_chars`` counted anew; a null text stays null."""
    out = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows, each 0 to 2 times, so that sources come to their targets; a null source is a source, rows
    without words take nothing and come as often as the flow's rounds say."""
    return mixing.repeat_rows(docs, F.array("source")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; a null or empty text is one piece of the closing id; repeated rows are packed each."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), longest=2048, closing_id=1)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
