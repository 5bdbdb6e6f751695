"""Registered queries: derived inputs (``checks.fixtures``) through operators.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB statement of the same key in ``checks.oracle``.
Nested results are flattened and doubles rounded so both engines compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from palaver.operators import phrases as ph
from palaver.operators import transcripts as tr
from palaver.operators import verification as ver
from palaver.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


# -- flagship: who spoke how long in each summarisable transcript, and is it safe

def flagship(spark: SparkSession, base: str) -> DataFrame:
    turns = table(spark, base, "conversations")
    t = tr.assemble_transcripts(turns)
    ok = tr.validate_transcripts(t).where("ok").select("job_id", "text", "duration")
    alloc = tr.allocate_speaking_time(ok, tr.speaker_shares(turns))
    verdict = ver.rule_verdict(ok).select("transcript_id", "is_safe", "reject_reason")
    return (alloc.join(verdict.withColumnRenamed("transcript_id", "job_id"), "job_id")
            .select("job_id", "speaker_id", "name",
                    F.round("speaking_time", 6).alias("speaking_time"),
                    "is_safe", "reject_reason"))


query("flagship_speaking_time_and_safety")(flagship)


# -- T: transcripts

@query("t01_assemble_transcript")
def t01(spark, base):
    return tr.assemble_transcripts(table(spark, base, "conversations")).select(
        "job_id", "text", "n_turns", F.round("duration", 6).alias("duration"))


@query("t02_speaker_shares")
def t02(spark, base):
    return tr.speaker_shares(table(spark, base, "conversations")).select(
        "job_id", "name", "position", "n_chars", F.round("share", 9).alias("share"))


@query("t03_allocate_speaking_time")
def t03(spark, base):
    turns = table(spark, base, "conversations")
    alloc = tr.allocate_speaking_time(tr.assemble_transcripts(turns), tr.speaker_shares(turns))
    return alloc.select("job_id", "speaker_id", "name",
                        F.round("speaking_time", 6).alias("speaking_time"))


@query("t04_validate_transcript")
def t04(spark, base):
    return tr.validate_transcripts(fx.doc_transcripts(spark, base)).select(
        "job_id", "ok", "error_class", "message")


# -- V: verification

@query("v03_rule_verdict")
def v03(spark, base):
    return ver.rule_verdict(fx.doc_transcripts(spark, base)).select(
        "transcript_id", "is_safe", "reject_reason", "has_profanity", "has_hate_speech", "has_pii")


@query("v03_phrase_hits")
def v03h(spark, base):
    """Every place of every term, phrases of single languages among them."""
    terms = [*ph.DEFAULT_TERMS, *[ph.Term("STOCK", p, lang) for p, lang in fx.STOCK_PHRASES]]
    return ph.phrase_hits(ph.find_phrases(fx.doc_transcripts(spark, base), terms))


@query("v03_phrase_verdict")
def v03p(spark, base):
    return ph.phrase_verdict(ph.find_phrases(fx.doc_transcripts(spark, base)))


@query("v04_verdict_report")
def v04(spark, base):
    return ver.verdict_report(ver.rule_verdict(fx.doc_transcripts(spark, base)))


@query("v02_parse_verdict")
def v02(spark, base):
    return ver.parse_verdicts(fx.verify_responses(spark, base)).select(
        "transcript_id", "ok", "is_safe", "reject_reason", "error_class", "inconsistent")


# -- J: job table

from palaver.functions.errors import taxonomy  # noqa: E402
from palaver.operators import jobs as jb  # noqa: E402

def _now():
    return fx.ts_ntz(fx.CLOCK)

_JOB_COLS = ["job_id", "status", "started_at", "completed_at", "error_message"]


def _requested_ids(spark, base):
    """Ids asked for: every job id plus every event-log id (unknown to the table)."""
    return (fx.jobs(spark, base).select("job_id")
            .unionByName(fx.job_events(spark, base).select("job_id")))


@query("j01_create_pending")
def j01(spark, base):
    return jb.create_pending(fx.url_submissions(spark, base), _now(), ["page_id"]).select(
        "job_id", "url", "status", "priority", "created_at")


@query("j02_validate_state")
def j02(spark, base):
    return jb.state_violations(fx.jobs_dirty(spark, base))


@query("j03_mark_processing")
def j03p(spark, base):
    jobs = fx.jobs(spark, base)
    return jb.mark_processing(jobs, jobs.select("job_id"), _now()).select(
        *_JOB_COLS, "rejected_class", "rejected_message")


@query("j03_mark_completed")
def j03c(spark, base):
    jobs = fx.jobs(spark, base)
    docs = fx.doc_transcripts(spark, base).select("job_id", F.lit(True).alias("has_transcript"))
    req = jobs.select("job_id").join(docs, "job_id", "left").fillna(False, ["has_transcript"])
    return jb.mark_completed(jobs, req, _now()).select(
        *_JOB_COLS, "has_transcript", "rejected_class", "rejected_message")


@query("j03_mark_failed")
def j03f(spark, base):
    jobs = fx.jobs(spark, base)
    req = jobs.select("job_id", F.when(F.col("priority") == "LOW", F.lit(""))
                      .otherwise(F.lit("Worker stopped")).alias("error_message"))
    return jb.mark_failed(jobs, req, _now()).select(*_JOB_COLS, "rejected_class", "rejected_message")


@query("j04_fold_transitions")
def j04(spark, base):
    return jb.fold_transitions(fx.job_events(spark, base))


@query("j05_dispatch_order")
def j05(spark, base):
    return jb.dispatch_order(fx.jobs(spark, base)).select(
        "job_id", "priority", "created_at", "dispatch_pos")


@query("j05_dispatch_order_enum")
def j05e(spark, base):
    return jb.dispatch_order(fx.jobs(spark, base), order="enum").select(
        "job_id", "priority", "created_at", "dispatch_pos")


@query("j06_claim_next")
def j06(spark, base):
    return jb.claim_next(fx.jobs(spark, base), 25, _now()).select(
        "job_id", "priority", "created_at", "status", "started_at", "claim_pos")


@query("j07_get_jobs")
def j07(spark, base):
    return jb.get_jobs(fx.jobs(spark, base), _requested_ids(spark, base)).select(
        "requested_id", "found", "status", "error_class", "message")


@query("j08_list_jobs")
def j08(spark, base):
    return jb.list_jobs(fx.jobs(spark, base), "FAILED")


@query("j09_sweep")
def j09(spark, base):
    return jb.sweep(fx.jobs(spark, base), _now()).select(*_JOB_COLS)


@query("j10_sweep_stats")
def j10(spark, base):
    return jb.sweep_stats(fx.jobs(spark, base), _now())


@query("j11_fail_system_error")
def j11(spark, base):
    return jb.fail_system_error(fx.jobs(spark, base), _requested_ids(spark, base),
                                "worker lost", _now())


@query("j13_status_overview")
def j13(spark, base):
    return jb.status_overview(fx.jobs(spark, base))


# -- U: URL admission

from palaver.operators import admission as adm  # noqa: E402


def _parsed(spark, base):
    return adm.parse_urls(fx.url_submissions(spark, base))


@query("u01_parse_url")
def u01(spark, base):
    return _parsed(spark, base).select("page_id", "url", "scheme", "path", "extension")


@query("u02_check_scheme")
def u02(spark, base):
    ok, msg = adm.scheme_check(F.col("scheme"))
    return _parsed(spark, base).select("page_id", ok.alias("ok"), msg.alias("message"))


@query("u03_check_format")
def u03(spark, base):
    ok, msg = adm.format_check(F.col("extension"))
    return _parsed(spark, base).select("page_id", ok.alias("ok"), msg.alias("message"))


@query("u04_check_probe")
def u04(spark, base):
    cls, msg = adm.probe_check()
    return fx.url_probe(spark, base).select("page_id", cls.alias("error_class"), msg.alias("message"))


@query("u05_flag_content_type")
def u05(spark, base):
    return fx.url_probe(spark, base).select(
        "page_id", "content_type", adm.content_type_warning().alias("content_type_warning"))


def _admitted(spark, base):
    return adm.admit(fx.url_submissions(spark, base), fx.url_probe(spark, base), _now())


@query("u06_admit")
def u06(spark, base):
    return _admitted(spark, base).select(
        "job_id", "page_id", "url", "status", "priority", "created_at", "completed_at",
        "error_message", "error_class", "content_type_warning")


@query("u07_admission_report")
def u07(spark, base):
    return adm.admission_report(_admitted(spark, base))


@query("j12_classify_errors")
def j12(spark, base):
    """Errors of admission and transcript validation, by class, parent and code."""
    errors = (_admitted(spark, base).select("error_class")
              .unionByName(tr.validate_transcripts(fx.doc_transcripts(spark, base))
                           .select("error_class")))
    return jb.error_counts(jb.classify_errors(errors, taxonomy(spark)))


@query("j12_root_causes")
def j12_roots(spark, base):
    return jb.root_causes(fx.error_chains(spark, base))


@query("j12_error_rollup")
def j12_rollup(spark, base):
    return jb.error_rollup(jb.root_causes(fx.error_chains(spark, base)), taxonomy(spark))


# -- P / E: replies and metadata

from palaver.functions import replies as rf  # noqa: E402
from palaver.functions import text as tx  # noqa: E402
from palaver.operators import replies as rp  # noqa: E402


def _client_errors(spark, base):
    """(kind, text) rows derived from events, covering every client error kind."""
    e = table(spark, base, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    kind = (F.when(et == "view", "timeout").when(et == "click", "rate_limit")
            .when(et == "signup", "connection").when(et == "purchase", "api_error").otherwise("other"))
    text = (F.when(eid % 4 == 0, F.lit("This model's Maximum Context Length is 8192 tokens"))
            .otherwise(F.concat(F.lit("upstream failure "), eid.cast("string"))))
    return e.select("event_id", kind.alias("error_kind"), text.alias("error_text"))


@query("p04_join_choices")
def p04(spark, base):
    d = table(spark, base, "documents")
    return d.select(F.col("doc_id").cast("string").alias("transcript_id"),
                    rf.join_choices(tx.sentences(F.col("text"))).alias("joined"))


@query("p05_clean_reply")
def p05(spark, base):
    return rp.clean_replies(fx.llm_responses(spark, base)).select("transcript_id", "cleaned")


@query("p06_check_json")
def p06(spark, base):
    return rp.check_json(rp.clean_replies(fx.llm_responses(spark, base)), mode="sql").select(
        "transcript_id", "is_json", "error_class")


@query("p06_check_json_exact")
def p06x(spark, base):
    return rp.check_json(rp.clean_replies(fx.llm_responses(spark, base)), mode="exact").select(
        "transcript_id", "is_json", "error_class")


@query("p07_map_client_error")
def p07(spark, base):
    return rp.map_client_errors(_client_errors(spark, base)).select("event_id", "error_class", "message")


def _meta(spark, base):
    return rp.metadata_checks(fx.llm_responses(spark, base))


@query("e01_check_required_fields")
def e01(spark, base):
    return _meta(spark, base).select("transcript_id", "missing_fields")


@query("e02_check_conversation_type")
def e02(spark, base):
    return _meta(spark, base).select(
        "transcript_id", "conversation_type",
        F.coalesce(F.col("conversation_type").isin(*rp.S.CONVERSATION_TYPES), F.lit(False)).alias("valid"))


@query("e03_check_topics")
def e03(spark, base):
    return _meta(spark, base).select("transcript_id", "topic_problem")


@query("e04_validate_metadata")
def e04v(spark, base):
    return _meta(spark, base).select("transcript_id", "ok", "error_class", "message", "detail")


@query("e04_parse_metadata")
def e04(spark, base):
    p = rp.parse_metadata(_meta(spark, base))
    return p.select("transcript_id", "conversation_type", F.size("topics").alias("n_topics"),
                    F.array_join(F.transform("topics", lambda t: t["name"]), "|").alias("topic_names"),
                    F.array_join("key_points", "|").alias("key_points"))


@query("e05_explode_topics")
def e05(spark, base):
    return rp.explode_topics(rp.parse_metadata(_meta(spark, base)))


# -- M: offline model operators; E6-E8: summaries

from palaver.operators import offline as off  # noqa: E402
from palaver.operators import summaries as sm  # noqa: E402


def _docs(spark, base):
    return fx.doc_transcripts(spark, base).select("job_id", "text")


@query("m01_extractive_summary")
def m01(spark, base):
    return off.extractive_summary(_docs(spark, base)).select(
        "job_id", "rank", F.col("pos").cast("long").alias("pos"), "n_words", "running_words",
        F.round("score", 9).alias("score"))


@query("m01_summary_text")
def m01t(spark, base):
    return off.summary_text(_docs(spark, base))


@query("m02_topics")
def m02(spark, base):
    return off.topics(_docs(spark, base)).select(
        "job_id", "rank", "word", F.round("score", 6).alias("score"),
        F.round("confidence", 6).alias("confidence"))


@query("m03_key_points")
def m03(spark, base):
    return off.key_points(_docs(spark, base))


@query("m04_conversation_type")
def m04(spark, base):
    return off.conversation_type(_docs(spark, base))


@query("e06_assemble_summary")
def e06(spark, base):
    docs = fx.doc_transcripts(spark, base)
    ok = tr.validate_transcripts(docs).where("ok")
    texts = off.summary_text(ok.select("job_id", "text")).withColumnRenamed(
        "job_id", "transcript_id")
    meta = rp.parse_metadata(rp.metadata_checks(fx.llm_responses(spark, base)))
    s = sm.assemble_summaries(ok, texts, meta)
    return s.select("transcript_id", "conversation_type", "summary_text",
                    F.size("topics").alias("n_topics"), F.array_join("key_points", "|").alias("key_points"),
                    F.round("duration", 6).alias("duration"))


@query("e07_summarize_offline")
def e07(spark, base):
    s, _ = sm.summarize_offline(fx.doc_transcripts(spark, base))
    return s.select("transcript_id", "conversation_type", "summary_text",
                    F.size("topics").alias("n_topics"), F.size("key_points").alias("n_key_points"),
                    F.round("duration", 6).alias("duration"))


@query("e08_batch_summarize")
def e08(spark, base):
    docs = fx.doc_transcripts(spark, base)
    texts = off.summary_text(docs.select("job_id", "text"))
    s, f = sm.summarize_with_replies(
        docs, texts.select(F.col("job_id").alias("transcript_id"), F.col("summary_text").alias("raw")),
        fx.llm_responses(spark, base))
    return sm.batch_summarize(s, f)


# -- T5/T6, P1-P3, P8, V1, E7 with a client, L

from checks.stub_client import stub_client_factory  # noqa: E402
from palaver.operators import completion as cp  # noqa: E402
from palaver.operators import logs as lg  # noqa: E402
from palaver.operators import prompts as pr  # noqa: E402
from palaver.session import scratch_path  # noqa: E402
from palaver.sources.readers import examples_prefix  # noqa: E402


@query("t05_create_multiple")
def t05(spark, base):
    t = fx.doc_transcripts(spark, base)
    return tr.transcripts_for_jobs(fx.jobs(spark, base).select("job_id", "status"), t).select(
        "job_id", "status", "language", F.length("text").cast("long").alias("n_chars"))


@query("t06_summarizable")
def t06(spark, base):
    return tr.summarizable(fx.jobs(spark, base), fx.doc_transcripts(spark, base))


@query("p01_build_summary_prompt")
def p01(spark, base):
    prefix = examples_prefix(spark)
    p = fx.doc_transcripts(spark, base).select("job_id", pr.summary_prompt(F.col("text"), prefix).alias("p"))
    return p.select("job_id", F.length("p").cast("long").alias("prompt_chars"),
                    F.sha2("p", 256).alias("prompt_sha256"))


@query("p02_build_requests")
def p02(spark, base):
    r = pr.build_requests(fx.doc_transcripts(spark, base), examples_prefix(spark))
    return r.select("request_id", "job_id", "task", "max_tokens", "temperature", "expect_json",
                    F.length("user_content").cast("long").alias("content_chars"))


def _completed(spark, base):
    req = pr.build_requests(fx.doc_transcripts(spark, base), examples_prefix(spark))
    return cp.complete(req, stub_client_factory, scratch_path(spark, "completions"))


@query("p03_complete")
def p03(spark, base):
    return cp.replies(_completed(spark, base)).select("request_id", "job_id", "task", "raw", "error_class")


@query("p08_usage_report")
def p08(spark, base):
    return cp.usage_report(_completed(spark, base))


@query("v01_verify")
def v01(spark, base):
    s, _ = sm.summarize_offline(fx.doc_transcripts(spark, base))
    return ver.verify_with_client(s, stub_client_factory, scratch_path(spark, "verify"))


@query("e07_summarize_with_client")
def e07c(spark, base):
    s, f = sm.summarize_with_client(fx.doc_transcripts(spark, base), stub_client_factory,
                                    scratch_path(spark, "summarize"), examples_prefix(spark))
    return (s.select("transcript_id", F.lit(None).cast("string").alias("error_class"), "conversation_type")
            .unionByName(f.select("transcript_id", "error_class", F.lit(None).cast("string")
                                  .alias("conversation_type"))))


@query("l01_parse_request_log")
def l01(spark, base):
    parsed, _ = lg.parse_request_log(fx.request_log(spark, base))
    return parsed


@query("l01_rejected_lines")
def l01r(spark, base):
    log = fx.request_log(spark, base)
    bad = F.col("line").contains("Duration: 3.")  # a part of the lines in another layout
    _, rejected = lg.parse_request_log(log.select(
        F.when(bad, F.concat(F.lit("worker: "), F.col("line"))).otherwise(F.col("line")).alias("line")))
    return rejected


@query("l02_request_stats")
def l02(spark, base):
    parsed, _ = lg.parse_request_log(fx.request_log(spark, base))
    return lg.request_stats(parsed).select(
        "route", "method", "n", "n_errors", F.round("mean_seconds", 6).alias("mean_seconds"), "max_seconds")


LATENCY_KEYS = ["window_start", "route", "method"]


def _latencies(sketch, by):
    return lg.sketch_quantiles(sketch, by).select(
        *by, "n", "n_errors", "max_seconds", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("l02_latency_windows")
def l02w(spark, base):
    """Latency quantiles per hour, route and method."""
    parsed, _ = lg.parse_request_log(fx.request_log(spark, base))
    return _latencies(lg.latency_sketch(lg.timed(parsed)), LATENCY_KEYS)


@query("l02_latency_days")
def l02d(spark, base):
    """Hourly sketches merged to days, over all methods of a route."""
    parsed, _ = lg.parse_request_log(fx.request_log(spark, base))
    hours = lg.latency_sketch(lg.timed(parsed))
    return _latencies(hours.withColumn("day", F.to_date("window_start")), ["day", "route"])


@query("l02_latency_stream")
def l02s(spark, base):
    """The log in three parts by time, as a stream: the windows that the watermark has closed."""
    inp, out, ck = (scratch_path(spark, n) for n in ("l02-in", "l02-out", "l02-ck"))
    log = fx.request_log(spark, base)
    second = F.unix_seconds(F.substring("line", 1, 19).cast("timestamp"))
    a, b = log.agg(F.percentile_approx(second, [1 / 3, 2 / 3])).first()[0] or (0, 0)
    for part in (second <= a, (second > a) & (second <= b), second > b):
        log.where(part).select("line").coalesce(4).write.mode("append").text(inp)
    latency_stream(spark, inp, out, ck, max_files_per_trigger=4).awaitTermination()
    return _latencies(read_sketches(spark, out), LATENCY_KEYS)


@query("j03_request_misses")
def j03m(spark, base):
    """Unknown ids and repeats among requests for a part of the jobs."""
    js = fx.jobs(spark, base)
    n = F.col("job_id").cast("long")
    ids = (js.where(n % 3 == 0).select("job_id").unionByName(js.where(n % 6 == 0).select("job_id"))
           .unionByName(js.where(n % 10 == 0).select(F.concat(F.lit("x"), F.col("job_id")).alias("job_id"))))
    return jb.request_misses(js, ids)


# -- S: sources and sinks; W: streams (inputs staged as files under the checkpoint root)

from palaver.sources import readers as rd  # noqa: E402
from palaver.sources import sinks as sk  # noqa: E402
from palaver.streaming.admission import admission_lanes_stream, admission_stream  # noqa: E402
from palaver.streaming.latency import latency_stream, read_sketches  # noqa: E402
from palaver.streaming.lifecycle import final_states, lifecycle_stream  # noqa: E402
from palaver.streaming.sweep import sweep_report, sweep_stream, swept_jobs  # noqa: E402


@query("s01_read_submissions")
def s01(spark, base):
    """Batch requests of up to 8 URLs (every fifth without a priority), written and read back."""
    subs = fx.url_submissions(spark, base).withColumn("request_id", F.floor(F.col("page_id") / 8))
    req = (subs.groupBy("request_id")
           .agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("_u"),
                F.min_by("priority", "page_id").alias("_p"))
           .select("request_id", F.transform("_u", lambda x: x["url"]).alias("urls"),
                   F.when(F.col("request_id") % 5 == 0, F.lit(None)).otherwise(F.col("_p")).alias("priority")))
    path = scratch_path(spark, "submissions")
    req.write.json(path)
    return rd.read_submissions(spark, path)


def _written_lines(spark, base):
    path = scratch_path(spark, "submission-lines")
    fx.submission_lines(spark, base).write.text(path)
    return path


@query("s01_accepted_submissions")
def s01a(spark, base):
    """The requests among good and bad lines, one row per URL."""
    return rd.read_submission_lanes(spark, _written_lines(spark, base))[0]


@query("s01_rejected_submissions")
def s01r(spark, base):
    """The bad records among good and bad lines, with the reason."""
    return rd.read_submission_lanes(spark, _written_lines(spark, base))[1]


def _lanes(spark, base):
    out, bad, ck = (scratch_path(spark, n) for n in ("w01-jobs", "w01-bad", "w01-lanes-ck"))
    admission_lanes_stream(spark, _written_lines(spark, base), fx.submission_probe(spark, base), _now(), out, bad, ck,
                           max_files_per_trigger=2).awaitTermination()
    return out, bad


@query("w01_admission_requests")
def w01q(spark, base):
    """Nested requests as a stream: one job per URL of the accepted ones."""
    return spark.read.parquet(_lanes(spark, base)[0]).select(
        "job_id", "submission", "url", "status", "priority", "error_class", "error_message", "content_type_warning")


@query("w01_rejected_requests")
def w01x(spark, base):
    """Nested requests as a stream: the rejected records."""
    return spark.read.parquet(_lanes(spark, base)[1]).select("line", "reason")


@query("s02_read_transcripts")
def s02(spark, base):
    t = tr.transcripts_with_speakers(table(spark, base, "conversations")).select(
        "job_id", F.lit(None).cast("string").alias("url"), "duration", "text", "speakers",
        F.lit(None).cast("string").alias("language"))
    path = scratch_path(spark, "transcripts")
    t.write.json(path)
    r = rd.read_transcripts(spark, path)
    return r.select("job_id", "language", F.round("duration", 6).alias("duration"),
                    F.size("speakers").alias("n_speakers"), F.sha2("text", 256).alias("text_sha256"))


@query("s04_export_jobs_report")
def s04(spark, base):
    path = scratch_path(spark, "jobs-report")
    sk.export_jobs_report(fx.jobs(spark, base), path)
    lines = spark.read.text(path)
    parsed = spark.read.schema(
        "job_id string, url string, status string, priority string, created_at string, started_at string, "
        "completed_at string, error_message string").json(path)
    no_null = lines.select(F.count_if(~F.col("value").rlike(
        '"started_at":.*"completed_at":.*"error_message":')).alias("n"))  # each field is there, null or not
    return parsed.select("job_id", "url", "status", "priority", "created_at", "started_at", "completed_at",
                         "error_message", (no_null.scalar() == 0).alias("nulls_kept"))


@query("s05_write_job_table")
def s05(spark, base):
    path = scratch_path(spark, "job-table")
    sk.write_job_table(fx.jobs(spark, base), path)
    return sk.read_table(spark, path).select("job_id", "status", "priority")


@query("s05_write_verdicts")
def s05v(spark, base):
    path = scratch_path(spark, "verdicts")
    verdicts = ver.rule_verdict(fx.doc_transcripts(spark, base))
    sk.write_verdicts(verdicts, path)
    return sk.read_table(spark, path, verdicts.schema).select(
        "transcript_id", "is_safe", "reject_reason", "has_profanity", "has_hate_speech", "has_pii")


@query("s05_write_summaries")
def s05s(spark, base):
    """Summaries of the conversations with speakers and topics (T1, T3, E7), written and read back."""
    t = tr.transcripts_with_speakers(table(spark, base, "conversations"))
    summaries, _ = sm.summarize_offline(t)
    path = scratch_path(spark, "summaries")
    sk.write_summaries(summaries, path)
    back = sk.read_table(spark, path, summaries.schema)
    total = lambda c, f: F.round(F.aggregate(
        c, F.lit(0.0), lambda acc, x: acc + x[f]), 6)
    return back.select(
        "transcript_id", "conversation_type", "summary_text",
        F.array_join(F.transform("speakers", lambda x: F.concat_ws(":", x["id"], x["name"])), "|").alias("speakers"),
        total("speakers", "speaking_time").alias("speaking_time"),
        F.array_join(F.transform("topics", lambda x: x["name"]), "|").alias("topics"),
        total("topics", "confidence_score").alias("confidence"), F.size("key_points").alias("n_key_points"))


@query("w01_admission_stream")
def w01(spark, base):
    inp, out, ck = (scratch_path(spark, n) for n in ("w01-in", "w01-out", "w01-ck"))
    fx.url_submissions(spark, base).repartition(4).write.json(inp)
    q = admission_stream(spark, inp, fx.url_probe(spark, base), _now(), out, ck)
    q.awaitTermination()
    return spark.read.parquet(out).select(
        "job_id", "page_id", "url", "status", "priority", "created_at", "completed_at",
        "error_message", "error_class", "content_type_warning")


@query("w02_lifecycle_stream")
def w02(spark, base):
    """Timeout-free run (limits far beyond the data): final states equal the batch fold."""
    inp, out, ck = (scratch_path(spark, n) for n in ("w02-in", "w02-out", "w02-ck"))
    fx.job_events(spark, base).repartition(4).write.parquet(inp)
    q = lifecycle_stream(spark, inp, out, ck, timeout_minutes=10 ** 7, retention_minutes=10 ** 7,
                         state_partitions=2 * spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    return final_states(spark.read.parquet(out)).select(
        "job_id", "status", "started_at", "completed_at", "n_events", "n_illegal")


@query("w02_lifecycle_limits")
def w02_limits(spark, base):
    """The service's limits (30 minutes of work, 60 of keeping): states when all events have come and time has passed.

    A job's events lie within one day, so tombstones of a day see every late one.
    """
    inp, out, ck = (scratch_path(spark, n) for n in ("w02l-in", "w02l-out", "w02l-ck"))
    fx.job_events(spark, base).repartition(4).write.parquet(inp)
    for _ in range(2):  # the second run has no new events: timers up to the last watermark
        lifecycle_stream(spark, inp, out, ck, tombstone_minutes=24 * 60,
                         state_partitions=2 * spark.sparkContext.defaultParallelism).awaitTermination()
    log = spark.read.parquet(out)
    late = log.where("change = 'late'").groupBy("job_id").agg(F.sum("n_events").alias("n_late"))
    return final_states(log).join(late, "job_id", "left").select(
        "job_id", "status", "started_at", "completed_at", "n_events", "n_illegal", "error_message",
        (F.col("change") == "dropped").alias("dropped"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


@query("w03_sweep_job")
def w03(spark, base):
    inp, out, ck = (scratch_path(spark, n) for n in ("w03-in", "w03-out", "w03-ck"))
    fx.jobs(spark, base).repartition(4).write.parquet(inp)
    q = sweep_stream(spark, inp, out, ck, now=_now())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/stats").select(
        "initial_job_count", "final_job_count", "stale_completed_removed", "stale_failed_removed",
        "processing_timed_out")


def _swept(spark, base):
    """Two snapshots of the job table, each in several files, swept a few files at a time."""
    inp, out, ck = (scratch_path(spark, n) for n in ("w03s-in", "w03s-out", "w03s-ck"))
    fx.jobs(spark, base).repartition(4).write.parquet(f"{inp}/whole")
    fx.jobs(spark, base).where("priority <> 'LOW'").repartition(3).write.parquet(f"{inp}/urgent")
    sweep_stream(spark, inp, out, ck, now=_now(), files_per_batch=3).awaitTermination()
    return out


@query("w03_swept_jobs")
def w03_jobs(spark, base):
    return swept_jobs(spark, _swept(spark, base)).select("snapshot", *_JOB_COLS)


@query("w03_sweep_report")
def w03_report(spark, base):
    return sweep_report(spark, _swept(spark, base))
