"""Record types and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original service's for matching results)
# ---------------------------------------------------------------------------
JOB_STATUSES = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]
JOB_PRIORITIES = ["LOW", "MEDIUM", "HIGH"]          # definition order
PRIORITY_RANK = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}  # documented dispatch rank
CONVERSATION_TYPES = ["EDUCATIONAL", "FORMAL", "COMEDY", "PROFESSIONAL",
                      "CASUAL", "INTERVIEW"]
REJECT_REASONS = ["PROFANITY", "HATE_SPEECH", "PII"]

SUPPORTED_SCHEMES = ["http", "https"]
SUPPORTED_FORMATS = [".m4a", ".mp3", ".mp4", ".wav", ".webm"]  # printed sorted
MAX_FILE_SIZE_MB = 100
MIN_TRANSCRIPT_LENGTH = 50
MAX_SUMMARY_TOKENS = 1000
DEFAULT_MAX_TOKENS = 4096
DEFAULT_TEMPERATURE = 0.7
JOB_TIMEOUT_MINUTES = 30
RETENTION_HOURS = 1
REQUIRED_METADATA_FIELDS = ["conversation_type", "key_points", "topics"]

MSG_TIMED_OUT = "Job timed out during forced cleanup"
MSG_EMPTY_TRANSCRIPT = "Empty transcript text"
MSG_SHORT_TRANSCRIPT = ("Transcript too short. Minimum length: "
                        f"{MIN_TRANSCRIPT_LENGTH} characters")
MSG_SYSTEM_ERROR_PREFIX = "System error: "
# ---------------------------------------------------------------------------

SPEAKER = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("speaking_time", T.DoubleType(), False),
])

TOPIC = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("confidence_score", T.DoubleType(), False),
])

TRANSCRIPT = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("duration", T.DoubleType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("speakers", T.ArrayType(SPEAKER), True),
    T.StructField("language", T.StringType(), True),
])

JOB = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("started_at", T.TimestampNTZType(), True),
    T.StructField("completed_at", T.TimestampNTZType(), True),
    T.StructField("error_message", T.StringType(), True),
])

SUMMARY = T.StructType([
    T.StructField("transcript_id", T.StringType(), False),
    T.StructField("conversation_type", T.StringType(), True),
    T.StructField("summary_text", T.StringType(), True),
    T.StructField("topics", T.ArrayType(TOPIC), True),
    T.StructField("speakers", T.ArrayType(SPEAKER), True),
    T.StructField("duration", T.DoubleType(), True),
    T.StructField("key_points", T.ArrayType(T.StringType()), True),
])

SUBMISSION = T.StructType([
    T.StructField("request_id", T.LongType(), True),
    T.StructField("urls", T.ArrayType(T.StringType()), True),
    T.StructField("priority", T.StringType(), True),
])

COMPLETION_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("job_id", T.StringType(), False),
    T.StructField("task", T.StringType(), False),
    T.StructField("system_prompt", T.StringType(), False),
    T.StructField("user_content", T.StringType(), True),
    T.StructField("max_tokens", T.IntegerType(), False),
    T.StructField("temperature", T.DoubleType(), False),
    T.StructField("expect_json", T.BooleanType(), False),
])

COMPLETION_RESULT = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("job_id", T.StringType(), False),
    T.StructField("task", T.StringType(), False),
    T.StructField("model", T.StringType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("prompt_tokens", T.LongType(), True),
    T.StructField("completion_tokens", T.LongType(), True),
    T.StructField("total_tokens", T.LongType(), True),
    T.StructField("error_kind", T.StringType(), True),
    T.StructField("error_text", T.StringType(), True),
])
