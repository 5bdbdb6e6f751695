"""Summaries (E6-E8): assembly, the summarise pipeline, batch runs.

A pipeline returns two frames, ``(summaries, failures)``; failures share
the columns ``transcript_id, error_class, message, detail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.replies import clean_reply
from palaver.operators import offline as M
from palaver.operators import replies as R
from palaver.operators.transcripts import validate_transcripts
from palaver.plans.staging import stored

FAILURE_COLS = ["transcript_id", "error_class", "message", "detail"]


class SummaryError(Exception):
    """Raised by a strict batch run; carries the service's message."""


def assemble_summaries(transcripts: DataFrame, summary_texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """The Summary record from a transcript, its summary text and parsed metadata."""
    speakers = (F.col("speakers") if "speakers" in transcripts.columns
                else F.array().cast(S.SUMMARY["speakers"].dataType))
    t = transcripts.select(F.col("job_id").alias("transcript_id"), speakers.alias("speakers"),
                           F.col("duration").cast("double").alias("duration"))
    return (t.join(summary_texts, "transcript_id").join(metadata, "transcript_id")
            .select("transcript_id", "conversation_type", "summary_text", "topics", "speakers",
                    "duration", "key_points"))


def _rejected_transcripts(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("ok")).select(
        F.col("job_id").alias("transcript_id"), "error_class", "message",
        F.col("message").alias("detail"))


def summarize_with_replies(transcripts: DataFrame, summary_replies: DataFrame,
                           metadata_replies: DataFrame, mode: str = "exact"):
    """E7 over stored model replies (``transcript_id, raw``) for both tasks.

    Order as in the service: transcript check, summary reply (cleaned like
    every reply), then metadata only for transcripts whose summary exists.
    """
    checked = validate_transcripts(transcripts)
    ok_t = checked.where("ok")
    summ = summary_replies.select("transcript_id", clean_reply(F.col("raw")).alias("summary_text"))
    have_summary = ok_t.select(F.col("job_id").alias("transcript_id")).join(summ, "transcript_id")
    no_summary = (ok_t.select(F.col("job_id").alias("transcript_id"))
                  .join(summ, "transcript_id", "left_anti")
                  .select("transcript_id", F.lit("SummaryError").alias("error_class"),
                          F.lit("Failed to generate summary: no summary reply").alias("message"),
                          F.lit("no summary reply").alias("detail")))
    meta = R.metadata_checks(metadata_replies.join(have_summary.select("transcript_id"), "transcript_id",
                                                   "left_semi"), mode=mode)
    bad_meta = meta.where(~F.col("ok")).select(*FAILURE_COLS)
    no_meta = (have_summary.select("transcript_id").join(metadata_replies, "transcript_id", "left_anti")
               .select("transcript_id", F.lit("SummaryError").alias("error_class"),
                       F.lit("Failed to extract conversation metadata").alias("message"),
                       F.lit("no metadata reply").alias("detail")))
    summaries = assemble_summaries(ok_t, have_summary, R.parse_metadata(meta))
    failures = _rejected_transcripts(checked).unionByName(no_summary) \
        .unionByName(bad_meta).unionByName(no_meta)
    return summaries, failures


def summarize_offline(transcripts: DataFrame, k: int = 3, max_tokens: int = S.MAX_SUMMARY_TOKENS):
    """E7 end to end with no model: M1 summary, M2-M4 metadata, E1-E6."""
    checked = validate_transcripts(transcripts)
    ok_t = checked.where("ok")
    docs = ok_t.select("job_id", "text")
    n_points = 5
    picks = stored(M.sentence_picks(docs, max(k, n_points), k, max_tokens), "sentence-picks")  # M1 and M3
    return summarize_with_replies(transcripts, M.summary_of(picks), M.metadata_reply(docs, picks, n_points=n_points))


def batch_summarize(summaries: DataFrame, failures: DataFrame, continue_on_error: bool = True) -> DataFrame:
    """Success and failure counts; strict mode raises for the smallest failed id.

    The strict check reads only the failure frame's minimum id (one
    aggregate), never the frames themselves.
    """
    if not continue_on_error:
        first = failures.agg(F.min_by(F.struct(*FAILURE_COLS), F.col("transcript_id")).alias("f")).first()
        if first is not None and first["f"] is not None:
            f = first["f"]
            raise SummaryError(f"Batch processing failed: Error summarizing transcript "
                               f"{f['transcript_id']}: {f['detail']}")
    s = summaries.agg(F.count(F.lit(1)).alias("n_success"))
    e = failures.agg(F.count(F.lit(1)).alias("n_failed"))
    return s.select("n_success", e.select("n_failed").scalar().alias("n_failed"))


def summarize_with_client(transcripts: DataFrame, client_factory, store: str, prefix: str,
                          concurrency: int = 8, mode: str = "exact"):
    """E7 through the model client: summary calls, then metadata calls only for
    transcripts whose summary call succeeded, then the checks of
    ``summarize_with_replies``. Results of both stages are stored (P3), and so are the
    replies read from them, which have several readers. Texts are shuffled once per task.
    """
    from palaver.operators.completion import complete, replies
    from palaver.operators.prompts import build_requests

    checked = validate_transcripts(transcripts)
    ok_t = checked.where("ok")
    s_rep = stored(replies(complete(build_requests(ok_t, prefix, ["summary"]), client_factory,
                                    f"{store}/summary", concurrency)), "summary-replies")
    s_ok = s_rep.where(F.col("error_class").isNull()).select(F.col("job_id").alias("transcript_id"), "raw")
    s_bad = s_rep.where(F.col("error_class").isNotNull()).select(
        F.col("job_id").alias("transcript_id"),
        F.when(F.col("error_class") == "TokenLimitError", F.lit("ContentTooLongError"))
         .otherwise(F.col("error_class")).alias("error_class"),
        F.when(F.col("error_class") == "TokenLimitError", F.lit("Transcript too long for summarization"))
         .otherwise(F.concat(F.lit("Failed to generate summary: "), F.col("message"))).alias("message"),
        F.col("message").alias("detail"))
    m_rep = stored(replies(complete(build_requests(ok_t, prefix, ["metadata"]), client_factory,
                                    f"{store}/metadata", concurrency,
                                    job_ids=s_ok.select(F.col("transcript_id").alias("job_id")))), "metadata-replies")
    m_ok = m_rep.where(F.col("error_class").isNull()).select(F.col("job_id").alias("transcript_id"), "raw")
    m_bad = m_rep.where(F.col("error_class").isNotNull()).select(
        F.col("job_id").alias("transcript_id"), "error_class",
        F.lit("Failed to extract conversation metadata").alias("message"), F.col("message").alias("detail"))
    answered = ok_t.join(m_ok.select(F.col("transcript_id").alias("job_id")), "job_id", "left_semi")
    summaries, failures = summarize_with_replies(answered, s_ok, m_ok, mode)
    return summaries, (_rejected_transcripts(checked).unionByName(failures)
                       .unionByName(s_bad).unionByName(m_bad))
