"""Model replies (P4-P7, E1-E5): cleaning, JSON check, metadata checks, typing.

The checks run in the service's order: JSON, object with the three
required fields, conversation type, topics; then the typed record. Every
row comes out with ``ok``, and failures carry ``error_class`` (the root
class), ``message`` (the text the service would report) and ``detail``
(the root cause's text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions import errors as E
from palaver.functions import replies as R
from palaver.plans.staging import once
from palaver.session import ship_package

_META_FAIL = "Unexpected error during metadata extraction"
_META_LLM_FAIL = "Failed to extract conversation metadata"
_TYPE_FAIL = "topic names and key points must be strings"
# failures the service raises as plain exceptions, not InvalidMetadataError
_NOT_METADATA_ERRORS = ["reply is not a JSON object", "topics is not a list",
                        "confidence_score is not a number", _TYPE_FAIL]


def clean_replies(replies: DataFrame, raw_col: str = "raw", strip_bare_fence: bool = False) -> DataFrame:
    """P5: adds ``cleaned``."""
    return replies.withColumn("cleaned", R.clean_reply(F.col(raw_col), strip_bare_fence))


def check_json(cleaned: DataFrame, mode: str = "exact", col: str = "cleaned") -> DataFrame:
    """Adds ``is_json``, ``parsed`` (the text to read), ``value`` (its variant) and, when false, ``InvalidResponseError``.

    ``mode='exact'`` reads as the service does: in the JVM where both readers
    agree, else in Python. ``mode='sql'`` stays in the JVM and refuses what only
    Python reads (duplicate keys, NaN, infinities).
    """
    text = F.col(col)
    read = once(cleaned, _pair=R.guarded(text))
    if mode == "sql":
        read = once(read, value=R.unguarded(F.col("_pair"), text)) \
            .withColumn("parsed", F.when(F.col("value").isNotNull(), text)).drop("_pair")
    else:
        ship_package(cleaned.sparkSession)
        read = once(read, _fast=F.when(~R.has_surrogate_escape(text), R.unguarded(F.col("_pair"), text))) \
            .withColumn("_again", R.canonical_json(F.when(F.col("_fast").isNull(), text)))
        read = once(read, value=F.coalesce("_fast", F.try_parse_json("_again")),
                    parsed=F.when(F.col("_fast").isNotNull(), text).otherwise(F.col("_again"))) \
            .drop("_pair", "_fast", "_again")
    return (read.withColumn("is_json", F.col("parsed").isNotNull())
            .withColumn("error_class", F.when(~F.col("is_json"), F.lit("InvalidResponseError")))
            .withColumn("message", F.when(~F.col("is_json"), F.lit("LLM did not return valid JSON"))))


def map_client_errors(df: DataFrame, kind_col: str = "error_kind", text_col: str = "error_text") -> DataFrame:
    """Error class and message per (kind, text) row."""
    k, t = F.col(kind_col), F.col(text_col)
    return df.withColumn("error_class", E.client_error_class(k, t)).withColumn(
        "message", E.client_error_message(k, t))


def metadata_checks(replies: DataFrame, id_col: str = "transcript_id", raw_col: str = "raw",
                    mode: str = "exact") -> DataFrame:
    """E1-E4 in order over raw metadata replies; one row per reply."""
    c = check_json(clean_replies(replies.select(F.col(id_col).alias("transcript_id"),
                                                F.col(raw_col).alias("raw"))), mode)
    c = c.select("transcript_id", "cleaned", "parsed", "is_json", F.col("value").alias("_v"))
    is_obj = F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False))
    missing = R.missing_fields(F.col("parsed"))
    ctype = R.conversation_type(F.col("_v"))
    # the service iterates whatever "topics" holds: an empty string or object
    # gives no topics, a non-empty one yields non-object items (bad
    # structure), and null, numbers and booleans cannot be iterated
    tv = F.try_variant_get(F.col("_v"), "$.topics", "variant")
    tkind = F.schema_of_variant(tv)
    empty_other = (((tkind == "STRING") & (F.try_variant_get(tv, "$", "string") == ""))
                   | (tkind == "OBJECT<>"))
    iterable = tkind.startswith("ARRAY") | (tkind == "STRING") | tkind.startswith("OBJECT")
    problem = (F.when(tkind.startswith("ARRAY"), R.first_topic_problem(F.col("_v")))
               .when(iterable & ~empty_other, F.lit(1)))
    topics_arr = F.when(iterable, F.coalesce(F.try_variant_get(F.col("_v"), "$.topics", "array<variant>"),
                                             F.array().cast("array<variant>")))
    kp = F.try_variant_get(F.col("_v"), "$.key_points", "array<variant>")
    names_ok = F.forall(topics_arr, lambda t: F.schema_of_variant(
        F.try_variant_get(t, "$.name", "variant")) == "STRING")
    kp_ok = F.coalesce(F.forall(kp, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    missing_text = F.concat(F.lit("Missing required fields: {"),
                            F.array_join(F.transform("_missing", lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", "),
                            F.lit("}"))
    c = once(c, _missing=missing, _ctype=ctype, _problem=problem, _object=is_obj)
    missing, ctype, problem, is_obj = (F.col(x) for x in ("_missing", "_ctype", "_problem", "_object"))
    detail = (F.when(~F.col("is_json"), F.lit("LLM did not return valid JSON"))
              .when(~is_obj, F.lit("reply is not a JSON object"))
              .when(F.size(missing) > 0, missing_text)
              .when(~F.coalesce(ctype.isin(*S.CONVERSATION_TYPES), F.lit(False)),
                    F.concat(F.lit("Invalid conversation type: "), F.coalesce(ctype, F.lit("None"))))
              .when(topics_arr.isNull(), F.lit("topics is not a list"))
              .when(problem == 1, F.lit("Invalid topic structure in metadata"))
              .when(problem == 2, F.lit("Topic confidence score must be between 0 and 1"))
              .when(problem == 3, F.lit("confidence_score is not a number"))
              .when(~names_ok | ~kp_ok, F.lit(_TYPE_FAIL)))
    c = once(c, detail=detail)
    # the root class follows from the first failing check
    error_class = (F.when(~F.col("is_json"), F.lit("InvalidResponseError"))
                   .when(F.col("detail").isin(*_NOT_METADATA_ERRORS), F.lit("SummaryError"))
                   .otherwise(F.lit("InvalidMetadataError")))
    message = (F.when(~F.col("is_json"), F.lit(_META_LLM_FAIL))
               .when(F.col("detail") == _TYPE_FAIL, F.lit("Failed to generate summary: invalid field type"))
               .otherwise(F.lit(_META_FAIL)))
    out = c.select("transcript_id", "cleaned", "is_json", "_v",
                   F.when(is_obj, F.array_join(missing, ",")).alias("missing_fields"),
                   ctype.alias("conversation_type"), problem.alias("topic_problem"), "detail")
    ok = F.col("detail").isNull()
    return out.select("transcript_id", "cleaned", "is_json", "_v", "missing_fields",
                      "conversation_type", "topic_problem", ok.alias("ok"),
                      F.when(~ok, error_class).alias("error_class"),
                      F.when(~ok, message).alias("message"), "detail")


def parse_metadata(checked: DataFrame) -> DataFrame:
    """Typed ``conversation_type``, ``topics`` and ``key_points`` of passing replies."""
    v = F.col("_v")
    return checked.where("ok").select(
        "transcript_id", "conversation_type",
        F.coalesce(F.try_variant_get(v, "$.topics", "array<struct<name:string,confidence_score:double>>"),
                   F.array().cast("array<struct<name:string,confidence_score:double>>")).alias("topics"),
        F.try_variant_get(v, "$.key_points", "array<string>").alias("key_points"))


def explode_topics(parsed: DataFrame) -> DataFrame:
    """E5: one row per transcript and topic, with its position from 0."""
    return parsed.select("transcript_id", F.posexplode("topics").alias("pos", "t")).select(
        "transcript_id", "pos", F.col("t.name").alias("name"),
        F.col("t.confidence_score").alias("confidence_score"))
