"""Completion requests (P1, P2): prompts and the three tasks per transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S

# Own wording of the three system prompts.
SUMMARY_SYSTEM = ("Summarise the transcript below. Cover the main points, the themes and "
                  "what was decided, briefly but completely.")
METADATA_SYSTEM = (
    "Read the transcript below and answer with one JSON object only: "
    '{"conversation_type": one of "EDUCATIONAL", "FORMAL", "COMEDY", "PROFESSIONAL", '
    '"CASUAL", "INTERVIEW"; "topics": a list of {"name": text, "confidence_score": number '
    'from 0 to 1}; "key_points": a list of texts}. Choose the type from the tone and content.')
VERIFICATION_SYSTEM = (
    "Check the text below for hate speech, profanity and personal data (PII). Answer with one "
    'JSON object only: {"is_safe": true or false, "reject_reason": null or one of '
    '"PROFANITY", "HATE_SPEECH", "PII"}.')

# Task settings (temperature, token limit; null means default).
TASKS = [
    ("summary", SUMMARY_SYSTEM, 0.7, S.MAX_SUMMARY_TOKENS, False),
    ("metadata", METADATA_SYSTEM, 0.3, None, True),
    ("verification", VERIFICATION_SYSTEM, 0.1, None, True),
]


def summary_prompt(text: Column, prefix: str) -> Column:
    """Few-shot block, then ``\\nTranscript: <text>``."""
    return F.concat(F.lit(prefix), F.lit("\nTranscript: "), text)


def effective(value: Column, default) -> Column:
    """The service's ``x or default``: null and zero both give the default."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(default)).otherwise(value)


def request_id(task: Column, job_id: Column, content: Column, system: Column, temperature: Column,
               max_tokens: Column, model: str = "") -> Column:
    """Hash of all that an answer depends on, so changed settings ask again."""
    return F.sha2(F.concat_ws("|", task, job_id, F.sha2(content, 256), F.sha2(system, 256),
                              temperature.cast("string"), max_tokens.cast("string"), F.lit(model)), 256)


def build_requests(transcripts: DataFrame, prefix: str, tasks: list[str] | None = None,
                   id_col: str = "job_id", text_col: str = "text", model: str = "") -> DataFrame:
    """One request row per transcript and task (``model``: the one the client calls).

    The task table is a literal array exploded per row (no join), and the
    request id is a hash of task, job, content and settings, so a stored result
    can be matched to its request after any re-run.
    """
    chosen = [t for t in TASKS if tasks is None or t[0] in tasks]
    text = F.col(text_col)
    arr = F.array(*[
        F.struct(F.lit(name).alias("task"), F.lit(system).alias("system_prompt"),
                 F.lit(temp).cast("double").alias("temperature"),
                 F.lit(max_tok).cast("int").alias("max_tokens"),
                 F.lit(expect_json).alias("expect_json"),
                 (summary_prompt(text, prefix) if name == "summary" else text).alias("user_content"))
        for name, system, temp, max_tok, expect_json in chosen])
    r = transcripts.select(F.col(id_col).cast("string").alias("job_id"), F.explode(arr).alias("r"))
    limit = effective(F.col("r.max_tokens"), S.DEFAULT_MAX_TOKENS).cast("int")
    temperature = effective(F.col("r.temperature"), S.DEFAULT_TEMPERATURE).cast("double")
    return r.select(
        request_id(F.col("r.task"), F.col("job_id"), F.col("r.user_content"), F.col("r.system_prompt"),
                   temperature, limit, model).alias("request_id"),
        "job_id", "r.task", "r.system_prompt", "r.user_content",
        limit.alias("max_tokens"), temperature.alias("temperature"),
        "r.expect_json")
