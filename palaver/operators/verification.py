"""Verification (V1-V4): model verdicts, their parsing, and an offline verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver import schemas as S
from palaver.functions.replies import clean_reply
from palaver.functions.text import has_any_word
from palaver.operators.replies import check_json
from palaver.plans.staging import once, stored

# Default word lists of the offline verdict (public, general
# English usage; callers pass their own lists for other languages or rules).
PROFANITY_WORDS = [
    "arse", "arsehole", "asshole", "bastard", "bitch", "bollocks", "bullshit",
    "crap", "damn", "dickhead", "fuck", "fucked", "fucking", "goddamn",
    "motherfucker", "piss", "pissed", "prick", "shit", "shitty", "twat",
    "wanker", "idiot", "moron", "imbecile", "jackass", "scumbag",
]
HATE_SPEECH_WORDS = [
    "subhuman", "subhumans", "untermensch", "vermin", "exterminate",
    "extermination", "degenerates", "mongrels",
]
# Personal-data patterns, used as "found anywhere" tests:
#   e-mail  [A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}
#   IPv4    four groups of 1-3 digits joined by dots, no digit on either side
#   card    16 digits, no digit on either side
#   phone   +1 (ddd) ddd-dddd
# The forms below find the same texts but suit a backtracking engine: one
# character before "@" is enough for a find (a run of them backtracks
# quadratically), and the digit neighbours are look-arounds.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
IPV4_PATTERN = r"(?<![0-9])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?![0-9])"
CARD_PATTERN = r"(?<![0-9])[0-9]{16}(?![0-9])"
PHONE_PATTERN = r"[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"
PII_PATTERNS = [EMAIL_PATTERN, IPV4_PATTERN, CARD_PATTERN, PHONE_PATTERN]
# literals every match contains: a plain substring test skips the regex
# engine for the texts that cannot match
PII_PREFILTERS = {EMAIL_PATTERN: "@", PHONE_PATTERN: "+1 ("}


def has_pii(text: Column, patterns: list[str] = PII_PATTERNS) -> Column:
    hit = F.lit(False)
    for p in patterns:
        test = text.rlike(p)
        if p in PII_PREFILTERS:
            test = text.contains(PII_PREFILTERS[p]) & test
        hit = hit | F.coalesce(test, F.lit(False))
    return hit


def rule_verdict(texts: DataFrame, id_col: str = "job_id", text_col: str = "text",
                 profanity: list[str] = PROFANITY_WORDS,
                 hate_speech: list[str] = HATE_SPEECH_WORDS,
                 pii_patterns: list[str] = PII_PATTERNS) -> DataFrame:
    """V3: offline verdict per text; reason by PROFANITY, HATE_SPEECH, PII.

    Word lists are literal arrays tested with ``arrays_overlap`` on the
    row's tokens, and the patterns are ``rlike`` tests: a narrow map-only
    plan, no shuffle, no join, no Python.
    """
    t = F.col(text_col)
    keep = [c for c in texts.columns if c in ("language",)]
    # flags first, reason from the flag columns: each test runs once per row
    flags = texts.select(
        F.col(id_col).alias("transcript_id"), *keep,
        has_any_word(t, profanity).alias("has_profanity"),
        has_any_word(t, hate_speech).alias("has_hate_speech"),
        has_pii(t, pii_patterns).alias("has_pii"))
    reason = (F.when(F.col("has_profanity"), F.lit("PROFANITY"))
              .when(F.col("has_hate_speech"), F.lit("HATE_SPEECH"))
              .when(F.col("has_pii"), F.lit("PII")))
    return flags.select("transcript_id", *keep, reason.isNull().alias("is_safe"), reason.alias("reject_reason"),
                        "has_profanity", "has_hate_speech", "has_pii")


def verdict_report(verdicts: DataFrame, by: str = "language") -> DataFrame:
    """V4: safe and rejected counts per language and reason, with roll-up totals."""
    reason = F.coalesce(F.col("reject_reason"), F.lit("SAFE")).alias("verdict")
    return (verdicts.select(F.col(by), reason)
            .rollup(by, "verdict").agg(F.count(F.lit(1)).alias("n")))


def _as_bool(v: Column) -> Column:
    """Lenient boolean of a variant: JSON true/false, 0/1 and the usual words."""
    kind = F.schema_of_variant(v)
    s = F.lower(F.try_variant_get(v, "$", "string"))
    return (F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & s.isin("0", "1"), s == "1")
            .when((kind == "STRING") & s.isin("true", "t", "yes", "y", "on", "1"), F.lit(True))
            .when((kind == "STRING") & s.isin("false", "f", "no", "n", "off", "0"), F.lit(False)))


def parse_verdicts(replies: DataFrame, id_col: str = "transcript_id", raw_col: str = "raw",
                   mode: str = "exact") -> DataFrame:
    """V2: typed verdicts; ``is_safe`` required, ``reject_reason`` optional of three.

    Replies are read as in P6 (``mode``). Failures are rows with ``error_class = VerificationError``. A reason with
    ``is_safe = true`` (or none with false) is accepted and flagged.
    """
    base = replies.select(F.col(id_col).alias("transcript_id"), clean_reply(F.col(raw_col)).alias("cleaned"))
    with_v = check_json(base, mode).select("transcript_id", F.col("is_json").alias("_json"), F.col("value").alias("_v"))
    is_obj = F.schema_of_variant(F.col("_v")).startswith("OBJECT")
    safe_v = F.try_variant_get(F.col("_v"), "$.is_safe", "variant")
    reason_v = F.try_variant_get(F.col("_v"), "$.reject_reason", "variant")
    reason_s = F.try_variant_get(reason_v, "$", "string")
    reason_null = reason_v.isNull() | F.is_variant_null(reason_v)
    reason_ok = reason_null | ((F.schema_of_variant(reason_v) == "STRING") & reason_s.isin(*S.REJECT_REASONS))
    safe = _as_bool(safe_v)
    err = (F.when(~F.col("_json"), F.lit("Failed to verify content: LLM did not return valid JSON"))
           .when(~is_obj | safe_v.isNull(), F.lit("Unexpected error during verification: 'is_safe'"))
           .when(safe.isNull(), F.lit("Unexpected error during verification: invalid is_safe"))
           .when(~reason_ok, F.lit("Unexpected error during verification: invalid reject_reason")))
    out = once(with_v, message=err, _safe=safe,
               _reason=F.when(reason_null, F.lit(None).cast("string")).otherwise(reason_s))
    ok = F.col("message").isNull()
    return out.select(
        "transcript_id", ok.alias("ok"),
        F.when(ok, F.col("_safe")).alias("is_safe"),
        F.when(ok, F.col("_reason")).alias("reject_reason"),
        F.when(~ok, F.lit("VerificationError")).alias("error_class"),
        "message",
        (ok & (F.col("_safe") == F.col("_reason").isNotNull())).alias("inconsistent"))


def verify_with_client(summaries: DataFrame, client_factory, store: str, concurrency: int = 8,
                       id_col: str = "transcript_id", text_col: str = "summary_text") -> DataFrame:
    """V1: safety verdict per summary text through the model client.

    Failed calls become ``VerificationError`` rows ("Failed to verify
    content: .."); replies go through V2.
    """
    from palaver.operators.completion import complete, replies
    from palaver.operators.prompts import build_requests

    # requests are read twice, for their ids and for their texts: the summaries are made once
    texts = stored(summaries.select(F.col(id_col).alias("job_id"), F.col(text_col).alias("text")), "to-verify")
    req = build_requests(texts, prefix="", tasks=["verification"])
    rep = replies(complete(req, client_factory, store, concurrency))
    ok_calls = rep.where(F.col("error_class").isNull()).select(
        F.col("job_id").alias("transcript_id"), "raw")
    failed_calls = rep.where(F.col("error_class").isNotNull()).select(
        F.col("job_id").alias("transcript_id"), F.lit(False).alias("ok"),
        F.lit(None).cast("boolean").alias("is_safe"), F.lit(None).cast("string").alias("reject_reason"),
        F.lit("VerificationError").alias("error_class"),
        F.concat(F.lit("Failed to verify content: "), F.col("message")).alias("message"),
        F.lit(False).alias("inconsistent"))
    return parse_verdicts(ok_calls).unionByName(failed_calls)
