"""URL admission (U1-U7): checks in the service's order, then one job per URL.

The HEAD request of the service is not made here; its outcome is an input
table ``probe`` (page key, outcome, http_status, content_length,
content_type). The first failing check wins: scheme, format, transport,
status, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions import urls
from palaver.operators.jobs import job_id_for

_MIB = 1048576.0


def parse_urls(submissions: DataFrame, url_col: str = "url") -> DataFrame:
    """Scheme, path and "extension" (from the last dot, else last character)."""
    p = urls.path(F.col(url_col))
    return submissions.select("*", urls.scheme(F.col(url_col)).alias("scheme"),
                              p.alias("path"), urls.extension(p).alias("extension"))


def _size_message(mib: Column) -> Column:
    return F.concat(F.lit("File size ("), F.format_string("%.1f", F.bround(mib, 1)),
                    F.lit(f"MB) exceeds maximum allowed size of {S.MAX_FILE_SIZE_MB}MB"))


def scheme_check(scheme: Column) -> tuple[Column, Column]:
    """(ok, message)."""
    ok = F.coalesce(scheme.isin(*S.SUPPORTED_SCHEMES), F.lit(False))
    return ok, F.when(~ok, F.concat(F.lit("Unsupported URL scheme: "), F.coalesce(scheme, F.lit(""))))


def format_check(extension: Column) -> tuple[Column, Column]:
    """(ok, message); the formats are printed sorted."""
    ok = F.coalesce(extension.isin(*S.SUPPORTED_FORMATS), F.lit(False))
    formats = ", ".join(S.SUPPORTED_FORMATS)
    return ok, F.when(~ok, F.concat(F.lit("Unsupported audio format: "), F.coalesce(extension, F.lit("")),
                                    F.lit(f". Supported formats: {formats}")))


def probe_check() -> tuple[Column, Column]:
    """U4 over probe columns: (error_class, message), null when it passes.

    Transport first (timeout, then any other failure or a missing probe),
    then a status other than 200 (redirects too), then a size over the
    limit; exactly the limit and an unknown size pass. An answer without a
    status, and a length that is not a number, are errors of the check itself.
    """
    outcome = F.coalesce(F.col("outcome"), F.lit("client_error"))
    mib = F.col("content_length").try_cast("double") / F.lit(_MIB)
    too_large = F.coalesce(mib > S.MAX_FILE_SIZE_MB, F.lit(False))
    status = F.col("http_status")
    bad_length = F.col("content_length").isNotNull() & F.col("content_length").try_cast("double").isNull()
    cls = (F.when(outcome == "timeout", "TranscriptionTimeoutError")
           .when(outcome != "ok", "InvalidURLError")
           .when(status.isNull() | bad_length & (status == 200), "TranscriptionError")
           .when(status != 200, "InvalidURLError")
           .when(too_large, "FileTooLargeError"))
    msg = (F.when(outcome == "timeout", F.lit("Timeout while validating URL"))
           .when(outcome != "ok", F.concat(F.lit("Error accessing URL: "), outcome))
           .when(status.isNull(), F.lit("Error validating URL: no status"))
           .when(bad_length & (status == 200), F.concat(F.lit("Error validating URL: bad content length "),
                                                        F.col("content_length").cast("string")))
           .when(status != 200, F.concat(F.lit("URL returned status code: "), status.cast("string")))
           .when(too_large, _size_message(mib)))
    return cls, msg


def content_type_warning() -> Column:
    """Neither audio/ nor video/ in the content type (missing warns too)."""
    ct = F.coalesce(F.col("content_type"), F.lit(""))
    return ~(ct.contains("audio/") | ct.contains("video/"))


def check_urls(parsed: DataFrame, probe: DataFrame, key: str = "page_id") -> DataFrame:
    """U2-U5 over parsed submissions joined to their probe result.

    Adds ``error_class``, ``message`` (null when admitted) and
    ``content_type_warning`` (only for admitted URLs, as the service warns
    after the last check). The probe table has one row per URL and grows
    with the submissions, so it is joined by key; AQE turns the join into a
    broadcast at run time when the probe side turns out small.
    """
    j = parsed.join(probe, key, "left")
    scheme_ok, scheme_msg = scheme_check(F.col("scheme"))
    format_ok, format_msg = format_check(F.col("extension"))
    probe_cls, probe_msg = probe_check()
    error_class = (F.when(~scheme_ok, F.lit("InvalidURLError"))
                   .when(~format_ok, F.lit("UnsupportedAudioFormatError"))
                   .otherwise(probe_cls))
    message = F.when(~scheme_ok, scheme_msg).when(~format_ok, format_msg).otherwise(probe_msg)
    return j.select(*parsed.columns, "outcome", "http_status", "content_length", "content_type",
                    error_class.alias("error_class"), message.alias("message"),
                    (error_class.isNull() & content_type_warning()).alias("content_type_warning"))


def admit(submissions: DataFrame, probe: DataFrame, now: Column, key: str = "page_id",
          url_col: str = "url", priority_col: str = "priority", id_cols: list[str] | None = None) -> DataFrame:
    """One job per URL (duplicates kept); PENDING, or FAILED with the message.

    The job id is a hash of ``id_cols`` and the URL. They must tell the URLs of
    a batch apart (batch and position, as ``read_submissions`` gives them); by
    default the key alone does.
    """
    checked = check_urls(parse_urls(submissions, url_col), probe, key)
    failed = F.col("error_class").isNotNull()
    return checked.select(
        job_id_for(*[F.col(c) for c in id_cols or [key]], F.col(url_col)).alias("job_id"),
        F.col(key), F.col(url_col).alias("url"),
        F.when(failed, "FAILED").otherwise("PENDING").alias("status"),
        F.coalesce(F.col(priority_col), F.lit("MEDIUM")).alias("priority"),
        now.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.when(failed, now).alias("completed_at"),
        F.col("message").alias("error_message"),
        "error_class", "content_type_warning")


def admission_report(admitted: DataFrame) -> DataFrame:
    """Count per outcome and error class."""
    return (admitted.groupBy("status", "error_class")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("content_type_warning").alias("n_warned")))
