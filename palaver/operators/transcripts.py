"""Transcripts (T1-T6): assembly from turns, speaker shares, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.text import strip


def assemble_transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         chars_per_second: float = 16.0) -> DataFrame:
    """One text per conversation, ``Label: utterance`` lines in turn order.

    ``listagg .. WITHIN GROUP`` is a partial aggregate, so the lines are
    combined map-side before the shuffle on the conversation key. A null role or
    text is empty, so every turn counted in ``n_turns`` has its line.
    """
    lines = turns.select(
        F.col(conv_col).cast("string").alias("job_id"),
        F.col(turn_col).alias("_turn"),
        F.concat(F.coalesce(role_col, F.lit("")), F.lit(": "), F.coalesce(text_col, F.lit(""))).alias("_line"))
    return (lines.groupBy("job_id")
            .agg(F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY _turn)").alias("_text"),
                 F.count(F.lit(1)).alias("n_turns"))
            .select("job_id", strip(F.col("_text")).alias("text"), "n_turns")
            .withColumn("duration", F.length("text") / F.lit(chars_per_second)))


def speaker_shares(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Share of characters per speaker label, with its position (first turn).

    The per-role aggregate is partial (map-side); the window that follows
    runs over at most one row per (conversation, role), so a hot
    conversation never becomes a large window group. In a conversation without
    any character every share is 0.
    """
    per_role = (turns.groupBy(F.col(conv_col).cast("string").alias("job_id"),
                              F.col(role_col).alias("name"))
                .agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("n_chars"),
                     F.min(turn_col).alias("_first_turn")))
    w = Window.partitionBy("job_id")
    return (per_role
            .withColumn("share", F.coalesce(F.try_divide("n_chars", F.sum("n_chars").over(w)), F.lit(0.0)))
            .withColumn("position", F.row_number().over(w.orderBy("_first_turn", "name")).cast("long"))
            .drop("_first_turn"))


def allocate_speaking_time(transcripts: DataFrame, shares: DataFrame) -> DataFrame:
    """T3 (exploded): ``speaker_<position>`` and ``duration * share`` seconds."""
    return (shares.join(transcripts.select("job_id", "duration"), "job_id")
            .select("job_id", "position",
                    F.concat(F.lit("speaker_"), F.col("position").cast("string")).alias("speaker_id"),
                    "name", "share",
                    (F.col("duration") * F.col("share")).alias("speaking_time")))


def collect_speakers(allocated: DataFrame) -> DataFrame:
    """T3 (nested): ``speakers`` array in position order, one row per transcript."""
    return (allocated.groupBy("job_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                "position", F.col("speaker_id").alias("id"), "name", "speaking_time")))
                 .alias("_s"))
            .select("job_id", F.transform("_s", lambda s: F.struct(
                s["id"].alias("id"), s["name"].alias("name"),
                s["speaking_time"].alias("speaking_time"))).alias("speakers")))


def transcripts_with_speakers(turns: DataFrame, **cols) -> DataFrame:
    """Transcript records (section 1 type) from conversation turns."""
    t = assemble_transcripts(turns, **cols)
    sp = collect_speakers(allocate_speaking_time(t, speaker_shares(turns, **cols)))
    return t.join(sp, "job_id", "left")


def validate_transcripts(transcripts: DataFrame, text_col: str = "text") -> DataFrame:
    """T4: every row with ``ok`` and, when not ok, ``error_class`` and ``message``.

    Length is in code points, as Python's ``len``; no trimming.
    """
    t = F.col(text_col)
    message = (F.when(t.isNull() | (t == ""), F.lit(S.MSG_EMPTY_TRANSCRIPT))
               .when(F.length(t) < S.MIN_TRANSCRIPT_LENGTH, F.lit(S.MSG_SHORT_TRANSCRIPT)))
    return (transcripts
            .withColumn("message", message)
            .withColumn("ok", F.col("message").isNull())
            .withColumn("error_class", F.when(~F.col("ok"), F.lit("SummaryError"))))


def transcripts_for_jobs(jobs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """T5: transcripts of the given jobs, one row per job that has one."""
    return jobs.join(transcripts, "job_id")


def summarizable(jobs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """COMPLETED jobs may be summarised; others get the state error.

    The message names the status the way the service formats its enum.
    """
    j = jobs.select("job_id", "status").join(
        transcripts.select("job_id", F.lit(True).alias("_has_t")), "job_id", "left")
    ok = F.col("status") == "COMPLETED"
    return j.select(
        "job_id", "status",
        F.coalesce(F.col("_has_t"), F.lit(False)).alias("has_transcript"),
        ok.alias("summarizable"),
        F.when(~ok, F.lit("InvalidJobStateError")).alias("error_class"),
        F.when(~ok, F.concat(F.lit("Cannot summarize job in status JobStatus."), F.col("status"),
                             F.lit(". Job must be in COMPLETED state."))).alias("message"))
