"""Derived test inputs, built from the driver's tables with the DataFrame API.

Each frame has the shape of one record type of the original service, so
every operator has an input that grows with the tables. ``checks/oracle.py``
holds the same derivations in DuckDB SQL; the two are compared by the
driver and by ``checks/compare.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.errors import TAXONOMY
from palaver.sources.tables import table

CLOCK = "2024-02-01 00:00:00"   # fixed "now" of every derived fixture

# common phrases of one language each (null: of any), terms beside the default lists
STOCK_PHRASES = [("of the", "en"), ("in the", "en"), ("the", "en"), ("de la", "es"), ("de la", "fr"), ("et les", "fr"),
                 ("und der", "de"), ("der die", "de"), ("a la", None), ("que los", "es"), ("to be in the", "en")]


def ts_ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def minutes_before(t: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", -minutes, t)


def _status(event_type: Column) -> Column:
    return (F.when(event_type == "view", "PROCESSING")
            .when(event_type == "purchase", "COMPLETED")
            .when(event_type == "error", "FAILED")
            .otherwise("PENDING"))


def jobs(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    now = ts_ntz(CLOCK)
    et, eid = F.col("event_type"), F.col("event_id")
    return e.select(
        eid.cast("string").alias("job_id"),
        F.concat(F.lit("https://example.com/audio/"), eid.cast("string"), F.lit(".mp3")).alias("url"),
        _status(et).alias("status"),
        F.when(F.col("user_id") % 3 == 0, "LOW").when(F.col("user_id") % 3 == 1, "MEDIUM")
         .otherwise("HIGH").alias("priority"),
        F.when(et.isin("signup", "click"), F.col("ts"))
         .otherwise(ts_ntz("2024-01-31 18:00:00")).alias("created_at"),
        F.when(et == "view", minutes_before(now, eid % 61))
         .when(et == "purchase", minutes_before(now, eid % 121 + 5)).alias("started_at"),
        F.when(et.isin("purchase", "error"), minutes_before(now, eid % 121)).alias("completed_at"),
        F.when(et == "error", F.lit("Unsupported audio format: .flac")).alias("error_message"),
    )


def jobs_dirty(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    return e.select(
        eid.cast("string").alias("job_id"),
        _status(et).alias("status"),
        F.when(eid % 7 == 0, "boom").when(eid % 7 == 1, "")
         .when((et == "error") & (eid % 7 != 2), "boom").alias("error_message"),
        F.when(eid % 5 == 0, et != "purchase").otherwise(et == "purchase").alias("has_transcript"),
    )


def error_chains(spark: SparkSession, base: str) -> DataFrame:
    """Errors that name the error they were caused by: a user's earlier one, none, or one that is not kept."""
    e = table(spark, base, "events").where("event_type in ('error', 'view')")
    eid = F.col("event_id")
    names = F.array(*[F.lit(c) for c, _, _ in TAXONOMY], F.lit("KeyError"), F.lit("ValueError"), F.lit(None).cast("string"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(eid.alias("error_id"), F.element_at(names, (eid % 23 + 1).cast("int")).alias("error_class"),
                    F.when(eid % 11 == 3, -eid).when(eid % 7 != 0, before).alias("cause_id"))


def job_events(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    et = F.col("event_type")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.substring(F.col("ts").cast("string"), 1, 10)).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.when(et.isin("view", "click"), "start").when(et == "error", "fail")
         .otherwise("complete").alias("kind"),
    )


def url_submissions(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "pages")
    pid = F.col("page_id")
    stem = F.regexp_replace(F.regexp_replace(F.col("url"), r"[?#].*$", ""), r"([.]html|/)$", "")
    suffix = (F.when(pid % 9 == 0, ".mp3").when(pid % 9 == 1, ".WAV").when(pid % 9 == 2, ".m4a")
              .when(pid % 9 == 3, ".mp4").when(pid % 9 == 4, ".webm").when(pid % 9 == 5, ".flac")
              .when(pid % 9 == 6, "").when(pid % 9 == 7, ".mp3?x=1.ogg").otherwise(".d/track"))
    u = F.col("u")
    colon = F.when(u.startswith("https:"), 6).otherwise(5)
    return (p.select(pid, F.concat(stem, suffix).alias("u"))
            .select(pid,
                    F.when(pid % 17 == 0, F.concat(F.lit("ftp"), F.substring(u, colon, 1 << 30)))
                     .otherwise(u).alias("url"),
                    F.when(pid % 4 == 0, "LOW").when(pid % 4 == 1, "HIGH")
                     .otherwise("MEDIUM").alias("priority")))


def submission_lines(spark: SparkSession, base: str) -> DataFrame:
    """Batch requests of up to 8 URLs as JSON lines; some are cut off, mistyped or incomplete."""
    rid = F.col("request_id")
    req = (url_submissions(spark, base).withColumn("request_id", F.floor(F.col("page_id") / 8))
           .groupBy("request_id")
           .agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("u"),
                F.min_by("priority", "page_id").alias("priority"))
           .withColumn("urls", F.transform("u", lambda x: x["url"])))
    plain = F.to_json(F.struct("request_id", "urls", "priority"))
    return req.select(
        F.when(rid % 9 == 1, F.substring(plain, 1, 60))
         .when(rid % 9 == 2, F.to_json(F.struct("request_id", F.col("urls")[0].alias("urls"))))
         .when(rid % 9 == 3, F.to_json(F.struct("request_id", "priority")))
         .when(rid % 9 == 4, F.to_json(F.struct("request_id", "urls", F.lit("URGENT").alias("priority"))))
         .when(rid % 9 == 5, F.to_json(F.struct("urls", "priority")))
         .when(rid % 9 == 6, F.to_json(F.struct("request_id", "urls")))
         .otherwise(plain).alias("line"))


def submission_probe(spark: SparkSession, base: str) -> DataFrame:
    """``url_probe`` by batch and position of the URL."""
    rid = F.floor(F.col("page_id") / 8)
    pos = F.row_number().over(Window.partitionBy("request_id").orderBy("page_id")) - 1
    return (url_probe(spark, base).withColumn("request_id", rid).withColumn("pos", pos)
            .withColumn("submission", F.concat_ws("/", "request_id", "pos")).drop("request_id", "pos", "page_id"))


def url_probe(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "pages")
    pid = F.col("page_id")
    return p.select(
        pid,
        F.when(pid % 19 == 3, "timeout").when(pid % 23 == 4, "client_error")
         .otherwise("ok").alias("outcome"),
        F.when(pid % 11 == 5, 404).when(pid % 11 == 6, 301).otherwise(200).alias("http_status"),
        F.when(pid % 13 == 0, F.lit(None).cast("bigint"))
         .otherwise(pid * 1048576).alias("content_length"),
        F.when(pid % 3 == 0, "audio/mpeg").when(pid % 3 == 1, "video/mp4; codecs=x")
         .otherwise("text/html").alias("content_type"),
    )


def doc_transcripts(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.col("text"),
        F.col("lang").alias("language"),
        (F.length("text") / F.lit(16.0)).alias("duration"),
    )


def json_text(text: Column) -> Column:
    """A text as the inside of a JSON string."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[\x00-\x1f]", " ")


def _cases(by: Column, forms: list[Column]) -> Column:
    out = F.when(by == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        out = out.when(by == i, form)
    return out


def llm_responses(spark: SparkSession, base: str) -> DataFrame:
    """Metadata replies about each document's text: sound, wrapped, wrong, and such as only Python's reader takes."""
    d = table(spark, base, "documents")
    did, lit, cat = F.col("doc_id"), F.lit, F.concat
    name, whole = json_text(F.substring("text", 1, 40)), json_text(F.col("text"))
    topics = cat(lit('[{"name": "'), name, lit('", "confidence_score": 0.'), (did % 10).cast("string"),
                 lit('}, {"name": "all", "confidence_score": 1}]'))
    points = cat(lit(', "key_points": ["'), whole, lit('", "k2"]'))
    good = cat(lit('{"conversation_type": "EDUCATIONAL", "topics": '), topics, points, lit("}"))
    scored = lambda score: cat(
        lit('{"conversation_type": "COMEDY", "topics": [{"name": "a", "confidence_score": ' + score + "}]"), points, lit("}"))
    raw = _cases(did % 24, [
        cat(lit("```json\n"), good, lit("\n```")), good, cat(lit("  "), good, lit("  ")), cat(lit("JSON "), good),
        cat(lit("```\n"), good, lit("\n```")), cat(lit("I cannot answer that: "), F.coalesce("text", lit(""))),
        cat(lit('{"conversation_type": "CASUAL", "topics": '), topics, lit("}")),
        cat(lit('{"conversation_type": "casual", "topics": []'), points, lit("}")),
        cat(lit('{"conversation_type": "FORMAL", "topics": [{"name": "'), name, lit('"}]'), points, lit("}")),
        scored("1.5"), cat(lit('{"conversation_type": "FORMAL", "topics": ["'), name, lit('"]'), points, lit("}")),
        cat(lit('{"conversation_type": "COMEDY", "topics": []'), points, lit("}")),
        cat(lit('{"conversation_type": "FORMAL", "conversation_type": "COMEDY", "topics": '), topics, points, lit("}")),
        scored("NaN"), cat(good, lit(" "), good), cat(good, lit("\nThat is all.")), F.coalesce("text", lit("")),
        cat(lit('{"conversation_type": "INTERVIEW", "topics": '), topics, lit(', "key_points": ["\\ud800 half", "'), whole, lit('"]}')),
        cat(lit('{"conversation_type": "INTERVIEW", "topics": '), topics, lit(', "key_points": ["\\ud83d\\ude00", "'), whole, lit('"]}')),
        scored("1e400"), cat(lit('{"conversation_type": "CASUAL", "topics": ["bad"], "topics": '), topics, points, lit("}")),
        cat(lit('{"conversation_type": "CASUAL", "topics": [], "key_points": ["a\nb", "'), whole, lit('"]}')),
        scored("-Infinity"), cat(lit('"'), whole, lit('"'))])
    return d.select(did.cast("string").alias("transcript_id"), raw.alias("raw"))


def verify_responses(spark: SparkSession, base: str) -> DataFrame:
    """Safety replies with each document's text as a note."""
    d = table(spark, base, "documents")
    lit, cat = F.lit, F.concat
    note = cat(lit(', "note": "'), json_text(F.col("text")), lit('"}'))
    raw = _cases(F.col("doc_id") % 12, [
        cat(lit('{"is_safe": true, "reject_reason": null'), note),
        cat(lit('```json\n{"is_safe": false, "reject_reason": "PII"'), note, lit("\n```")),
        lit('{"is_safe": true}'), cat(lit('{"is_safe": false, "reject_reason": "SPAM"'), note),
        cat(lit('{"reject_reason": "PROFANITY"'), note), cat(lit("unsafe: "), F.coalesce("text", lit(""))),
        cat(lit('{"is_safe": true, "is_safe": false, "reject_reason": "PII"'), note),
        cat(lit('{"score": NaN, "is_safe": true'), note), cat(lit('{"is_safe": true'), note, lit('{"is_safe": false}')),
        cat(lit('{"is_safe": 1, "sign": "\\udfff"'), note), cat(lit('JSON {"is_safe": "no", "reject_reason": "HATE_SPEECH"'), note),
        cat(lit('["is_safe", "'), json_text(F.col("text")), lit('"]'))])
    return d.select(F.col("doc_id").cast("string").alias("transcript_id"), raw.alias("raw"))


def request_log(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    et, uid, eid = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id")
    path = (F.when(et == "view", F.lit("/v1/jobs"))
            .when(et == "click", F.concat(F.lit("/v1/jobs/"), uid))
            .when(et == "signup", F.lit("/v1/transcribe"))
            .when(et == "purchase", F.concat(F.lit("/v1/summarize/"), uid))
            .otherwise(F.lit("/v1/verify")))
    line = F.concat(
        F.substring(F.col("ts").cast("string"), 1, 19),
        F.lit(" - app.app - INFO - app.py:log_requests:166 - Path: "), path,
        F.lit(" Method: "), F.when(et.isin("view", "click"), "GET").otherwise("POST"),
        F.lit(" Status: "), F.when(et == "error", "500").otherwise("200"),
        F.lit(" Duration: "), (eid % 7).cast("string"), F.lit("."), (10 + eid % 90).cast("string"),
        F.lit("s"))
    return e.select(line.alias("line"))
