"""Typed readers (S1-S3) for submissions, transcripts and few-shot examples."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver import schemas as S
from palaver.plans.staging import once

EXAMPLES_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "examples.json")

EXAMPLES_SCHEMA = T.StructType([T.StructField("examples", T.ArrayType(T.StructType([
    T.StructField("transcript", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("conversation_type", T.StringType()),
        T.StructField("topics", T.ArrayType(S.TOPIC)),
        T.StructField("key_points", T.ArrayType(T.StringType())),
        T.StructField("speakers", T.ArrayType(S.SPEAKER)),
        T.StructField("duration", T.DoubleType()),
    ])),
])))])


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """JSON batch requests -> one row per URL, order kept, priority MEDIUM by default."""
    raw = spark.read.schema(S.SUBMISSION).json(path)
    return raw.select(
        "request_id",
        F.posexplode("urls").alias("pos", "url"),
        F.coalesce(F.col("priority"), F.lit("MEDIUM")).alias("priority"))


BAD_RECORD = "bad_record"


def split_submissions(lines: DataFrame, line_col: str = "line", keep: tuple[str, ...] = ()):
    """(accepted, rejected) frames of request lines, a batch or a stream alike.

    Every non-blank line is a request or a rejected record; none ends the job or is lost.
    ``reason`` is ``malformed`` (not a JSON object, cut off, or a field of a wrong type),
    ``missing_request_id``, ``missing_urls`` (absent or null), ``null_url`` or
    ``unknown_priority``; the first that fits counts. Accepted requests give one row per URL
    with its position; an empty list is a valid request without URLs and gives no row. A
    number among the URLs is read as text, as Spark's reader does; what stands behind the
    object is not read. ``keep`` names further columns to carry.
    """
    line = F.col(line_col)
    schema = T.StructType([*S.SUBMISSION.fields, T.StructField(BAD_RECORD, T.StringType())])
    parsed = lines.where(F.length(F.trim(line)) > 0).select(
        line.alias("line"), *keep,
        F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD}).alias("r"))
    reason = (F.when(F.col("r").isNull() | F.col(f"r.{BAD_RECORD}").isNotNull(), "malformed")
              .when(F.col("r.request_id").isNull(), "missing_request_id")
              .when(F.col("r.urls").isNull(), "missing_urls")
              .when(F.exists("r.urls", lambda u: u.isNull()), "null_url")
              .when(~F.coalesce(F.col("r.priority"), F.lit("MEDIUM")).isin(S.JOB_PRIORITIES), "unknown_priority"))
    judged = once(parsed, reason=reason)
    accepted = judged.where(F.col("reason").isNull()).select(
        *keep, F.col("r.request_id").alias("request_id"), F.posexplode("r.urls").alias("pos", "url"),
        F.coalesce(F.col("r.priority"), F.lit("MEDIUM")).alias("priority"))
    return accepted, judged.where(F.col("reason").isNotNull()).select(*keep, "line", "reason")


def read_submission_lanes(spark: SparkSession, path: str):
    """``split_submissions`` of the JSON-lines files below ``path``."""
    return split_submissions(spark.read.text(path).withColumnRenamed("value", "line"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON transcripts with typed nested speakers; language defaults to "en"."""
    raw = spark.read.schema(S.TRANSCRIPT).json(path)
    return raw.withColumn("language", F.coalesce(F.col("language"), F.lit("en")))


def read_examples(spark: SparkSession, path: str | None = None, n: int = 2) -> DataFrame:
    """S3: the first ``n`` few-shot examples of a multi-line JSON file.

    A ``path`` must be readable by the executors (shared storage). The
    packaged default exists only where the package is installed, so it is
    read on the driver (a few examples) and parsed by Spark's JSON reader.
    """
    reader = spark.read.schema(EXAMPLES_SCHEMA)
    if path is None:
        with open(EXAMPLES_PATH, encoding="utf-8") as f:
            raw = reader.json(spark.sparkContext.parallelize([f.read()], 1))
    else:
        raw = reader.option("multiLine", True).json(path)
    return (raw.select(F.posexplode("examples").alias("pos", "ex"))
            .where(F.col("pos") < n)
            .select("pos", "ex.*"))


def examples_prefix(spark: SparkSession, path: str | None = None, n: int = 2,
                    header: str = "Example transcripts with their summaries:") -> str:
    """The few-shot block of the summary prompt, built once on the driver.

    At most ``n`` rows reach the driver (the examples, not the data).
    """
    rows = read_examples(spark, path, n).orderBy("pos").select("transcript", "summary").collect()
    blocks = [f"Transcript: {r['transcript']}\nSummary: {r['summary']}\n" for r in rows]
    return "\n".join([header, *blocks])
