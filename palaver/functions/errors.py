"""Error taxonomy (J12) and client-error mapping (P7) as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Error class, parent class, status code.
TAXONOMY = [
    ("LLMError", None, 500),
    ("LLMTimeoutError", "LLMError", 504),
    ("LLMRateLimitError", "LLMError", 429),
    ("LLMConnectionError", "LLMError", 503),
    ("InvalidResponseError", "LLMError", 502),
    ("TokenLimitError", "LLMError", 400),
    ("TranscriptionError", None, 500),
    ("InvalidURLError", "TranscriptionError", 400),
    ("FileTooLargeError", "TranscriptionError", 400),
    ("UnsupportedAudioFormatError", "TranscriptionError", 400),
    ("TranscriptionTimeoutError", "TranscriptionError", 504),
    ("SummaryError", None, 500),
    ("ContentTooLongError", "SummaryError", 400),
    ("InvalidMetadataError", "SummaryError", 500),
    ("VerificationError", None, 500),
    ("JobError", None, 500),
    ("JobNotFoundError", "JobError", 404),
    ("InvalidJobStateError", "JobError", 400),
    ("InvalidPriorityError", "JobError", 400),
    ("JobQueueError", "JobError", 503),
]

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("error_class", T.StringType(), False),
    T.StructField("parent_class", T.StringType(), True),
    T.StructField("status_code", T.IntegerType(), False),
])


def taxonomy(spark: SparkSession) -> DataFrame:
    """20-row table; its size is fixed, so broadcasting it is always safe."""
    return spark.createDataFrame(TAXONOMY, TAXONOMY_SCHEMA)


def client_error_class(kind: Column, text: Column) -> Column:
    """First match wins, timeout before connection; context length by text."""
    k = F.lower(kind)
    ctx = F.lower(F.coalesce(text, F.lit(""))).contains("maximum context length")
    return (F.when(kind.isNull(), F.lit(None))
            .when(k == "timeout", "LLMTimeoutError")
            .when(k == "rate_limit", "LLMRateLimitError")
            .when(k == "connection", "LLMConnectionError")
            .when((k == "api_error") & ctx, "TokenLimitError")
            .otherwise("LLMError"))


def client_error_message(kind: Column, text: Column) -> Column:
    k = F.lower(kind)
    t = F.coalesce(text, F.lit(""))
    ctx = F.lower(t).contains("maximum context length")
    return (F.when(kind.isNull(), F.lit(None))
            .when(k == "timeout", "Request to language model timed out")
            .when(k == "rate_limit", "Rate limit exceeded for language model")
            .when(k == "connection", "Failed to connect to language model service")
            .when((k == "api_error") & ctx, "Input exceeds maximum token limit")
            .when(k == "api_error", F.concat(F.lit("Language model error: "), t))
            .when(k == "client_error", F.concat(F.lit("Unexpected language model error: "), t))
            .otherwise(F.concat(F.lit("Unexpected error: "), t)))
