"""Edge cases of single operators on short hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.fixtures import ts_ntz
from palaver.operators import admission as adm
from palaver.operators import jobs as jb
from palaver.operators import replies as rp
from palaver.operators import transcripts as tr
from palaver.operators import verification as ver

NOW = "2024-02-01 00:00:00"
T0 = dt.datetime(2024, 2, 1)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# -- T4 -------------------------------------------------------------------------

def test_transcript_length_edges(spark):
    df = spark.createDataFrame([("a", "x" * 49), ("b", "x" * 50), ("c", ""), ("d", None), ("e", "é" * 50)],
                               "job_id string, text string")
    out = {r.job_id: (r.ok, r.message) for r in tr.validate_transcripts(df).collect()}
    assert out["a"] == (False, "Transcript too short. Minimum length: 50 characters")
    assert out["b"] == (True, None)
    assert out["c"] == (False, "Empty transcript text")
    assert out["d"] == (False, "Empty transcript text")
    assert out["e"] == (True, None)  # code points, not bytes


# -- U1-U6 ----------------------------------------------------------------------

def test_url_parsing(spark):
    df = spark.createDataFrame([(1, "https://h.org/a/b.MP3?x=1.ogg#f"), (2, "https://h.org/a/track"),
                                (3, "http://h.org/a.d/track"), (4, "ftp://h.org/x.mp3")],
                               "page_id long, url string")
    out = {r.page_id: (r.scheme, r.extension) for r in adm.parse_urls(df).collect()}
    assert out == {1: ("https", ".mp3"), 2: ("https", "k"), 3: ("http", ".d/track"), 4: ("ftp", ".mp3")}


def test_size_limit_and_status(spark):
    mib = 1048576
    subs = spark.createDataFrame([(i, f"https://h.org/{i}.mp3", None) for i in range(1, 6)],
                                 "page_id long, url string, priority string")
    probe = spark.createDataFrame([
        (1, "ok", 200, 100 * mib, "audio/mpeg"),       # exactly the limit: passes
        (2, "ok", 200, 100 * mib + 1, "audio/mpeg"),   # one byte over: fails
        (3, "ok", 200, None, None),                    # unknown size passes, missing type warns
        (4, "ok", 301, 10, "audio/mpeg"),              # redirects are not followed
        (5, "timeout", None, None, None)],
        "page_id long, outcome string, http_status int, content_length long, content_type string")
    out = {r.page_id: r for r in adm.admit(subs, probe, ts_ntz(NOW)).collect()}
    assert out[1].status == "PENDING" and not out[1].content_type_warning
    assert out[2].error_class == "FileTooLargeError"
    assert out[2].error_message == "File size (100.0MB) exceeds maximum allowed size of 100MB"
    assert out[3].status == "PENDING" and out[3].content_type_warning
    assert out[4].error_message == "URL returned status code: 301"
    assert out[5].error_class == "TranscriptionTimeoutError"
    assert all(r.priority == "MEDIUM" for r in out.values())
    assert out[2].completed_at == T0 and out[1].completed_at is None


# -- J9 / J10 -------------------------------------------------------------------

def test_sweep_boundaries_are_strict(spark):
    m = dt.timedelta(minutes=1)
    us = dt.timedelta(microseconds=1)
    jobs = spark.createDataFrame([
        ("p30", "PROCESSING", T0 - 30 * m, None, None),
        ("p31", "PROCESSING", T0 - 30 * m - us, None, None),
        ("c60", "COMPLETED", T0 - 90 * m, T0 - 60 * m, None),
        ("c61", "COMPLETED", T0 - 90 * m, T0 - 60 * m - us, None),
        ("fnull", "FAILED", None, None, "x"),
        ("pend", "PENDING", None, None, None)],
        "job_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, "
        "error_message string")
    swept = {r.job_id: (r.status, r.error_message) for r in jb.sweep(jobs, ts_ntz(NOW)).collect()}
    assert swept["p30"] == ("PROCESSING", None)
    assert swept["p31"] == ("FAILED", "Job timed out during forced cleanup")
    assert "c60" in swept and "c61" not in swept
    assert "fnull" in swept and "pend" in swept
    stats = jb.sweep_stats(jobs, ts_ntz(NOW)).first().asDict()
    assert stats == {"initial_job_count": 6, "final_job_count": 5, "stale_completed_removed": 1,
                     "stale_failed_removed": 0, "processing_timed_out": 1}


def test_state_rules(spark):
    jobs = spark.createDataFrame([("a", "COMPLETED", None, False), ("b", "FAILED", "", False),
                                  ("c", "PENDING", "x", True), ("d", "FAILED", "x", False)],
                                 "job_id string, status string, error_message string, has_transcript boolean")
    got = sorted(rows(jb.state_violations(jobs), "job_id", "rule"))
    assert got == [("a", 1), ("b", 2), ("c", 3), ("c", 4)]


def test_transitions(spark):
    jobs = spark.createDataFrame([("a", "PENDING"), ("b", "PROCESSING"), ("c", "COMPLETED")],
                                 "job_id string, status string").select(
        "job_id", "status", F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("error_message"))
    out = {r.job_id: r for r in jb.mark_processing(jobs, jobs.select("job_id"), ts_ntz(NOW)).collect()}
    assert out["a"].status == "PROCESSING" and out["a"].started_at == T0
    assert out["b"].rejected_message == "Cannot mark job as processing from state JobStatus.PROCESSING"
    req = spark.createDataFrame([("a", ""), ("b", "boom"), ("zz", "boom")], "job_id string, error_message string")
    out = {r.job_id: r for r in jb.mark_failed(jobs, req, ts_ntz(NOW)).collect()}
    assert out["a"].status == "PENDING" and out["a"].rejected_class == "ValueError"
    assert out["b"].status == "FAILED" and out["b"].error_message == "boom"
    assert "zz" not in out


def test_fold_matches_a_plain_python_fold(spark):
    from checks.fixtures import job_events
    from tests.conftest import SF_MID
    ev = job_events(spark, SF_MID)
    moves = {("PENDING", "start"): "PROCESSING", ("PENDING", "fail"): "FAILED",
             ("PROCESSING", "complete"): "COMPLETED", ("PROCESSING", "fail"): "FAILED"}
    expect = {}
    for r in sorted(ev.collect(), key=lambda r: r.seq):
        st, ill = expect.get(r.job_id, ("PENDING", 0))
        new = moves.get((st, r.kind))
        expect[r.job_id] = (new, ill) if new else (st, ill + 1)
    got = {r.job_id: (r.status, r.n_illegal) for r in jb.fold_transitions(ev).collect()}
    assert got == expect


def test_dispatch_order_is_total_and_distributed(spark):
    from checks.fixtures import jobs
    from tests.conftest import SF_MID
    j = jobs(spark, SF_MID)
    got = jb.dispatch_order(j.repartition(7)).select("job_id", "dispatch_pos").collect()
    pos = sorted(r.dispatch_pos for r in got)
    assert pos == list(range(1, len(got) + 1))
    rank = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}
    pend = sorted((rank[r.priority], r.created_at, r.job_id) for r in j.where("status = 'PENDING'").collect())
    by_pos = {r.dispatch_pos: r.job_id for r in got}
    assert [by_pos[i + 1] for i in range(len(pend))] == [p[2] for p in pend]


def test_top_k_per_group_equals_plain_window(spark):
    from pyspark.sql import Window

    from palaver.plans.ordering import top_k_per_group
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).alias("v"),
                                     F.col("id"))
    a = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 4)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    b = df.withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    assert sorted(rows(a, "g", "id", "rank")) == sorted(rows(b, "g", "id", "rank"))


# -- P5 / P6 / P7 / E3 / V2 -------------------------------------------------------

def test_reply_cleaning_and_bare_fence(spark):
    df = spark.createDataFrame([("a", "```json\n{\"x\": 1}\n```"), ("b", "```\n{\"x\": 1}\n```"),
                                ("c", "  JSON {\"x\": 1} "), ("d", "Jsonic text")], "transcript_id string, raw string")
    out = dict(rows(rp.clean_replies(df), "transcript_id", "cleaned"))
    assert out["a"] == "{\"x\": 1}\n"
    assert out["b"].startswith("```")              # the bare fence stays (Q9)
    assert out["c"] == "{\"x\": 1}"
    assert out["d"] == "ic text"                   # a leading "json" is eaten from prose too
    fixed = dict(rows(rp.clean_replies(df, strip_bare_fence=True), "transcript_id", "cleaned"))
    assert fixed["b"] == "{\"x\": 1}\n"


def test_json_modes_differ_where_the_readers_do(spark):
    df = spark.createDataFrame([("a", '{"a": 1} x'), ("b", '{"a": NaN}'), ("c", '{"a": 1, "a": 2}'),
                                ("d", '[1, 2]'), ("e", 'nope')], "transcript_id string, cleaned string")
    sql = dict(rows(rp.check_json(df, "sql"), "transcript_id", "is_json"))
    exact = dict(rows(rp.check_json(df, "exact"), "transcript_id", "is_json"))
    assert exact == {"a": False, "b": True, "c": True, "d": True, "e": False}
    assert sql["a"] is False and sql["d"] is True and sql["e"] is False


def test_client_error_mapping(spark):
    df = spark.createDataFrame([("timeout", ""), ("rate_limit", ""), ("connection", ""),
                                ("api_error", "This model's MAXIMUM CONTEXT LENGTH is 10"),
                                ("api_error", "bad"), ("other", "x")], "error_kind string, error_text string")
    got = [r.error_class for r in rp.map_client_errors(df).collect()]
    assert got == ["LLMTimeoutError", "LLMRateLimitError", "LLMConnectionError", "TokenLimitError",
                   "LLMError", "LLMError"]


@pytest.mark.parametrize("score,ok", [("0", True), ("1", True), ("0.0", True), ("1.5", False),
                                      ('"0.4"', False), ("true", False), ("-0.1", False)])
def test_topic_confidence_edges(spark, score, ok):
    raw = ('{"conversation_type": "FORMAL", "topics": [{"name": "a", "confidence_score": %s}], '
           '"key_points": []}' % score)
    df = spark.createDataFrame([("t", raw)], "transcript_id string, raw string")
    assert rp.metadata_checks(df).first().ok is ok


def test_missing_fields_message_and_null_field(spark):
    df = spark.createDataFrame([("a", '{"conversation_type": "CASUAL"}'),
                                ("b", '{"conversation_type": "CASUAL", "topics": [], "key_points": null}')],
                               "transcript_id string, raw string")
    out = {r.transcript_id: r for r in rp.metadata_checks(df).collect()}
    assert out["a"].detail == "Missing required fields: {'key_points', 'topics'}"
    assert out["a"].error_class == "InvalidMetadataError"
    assert out["b"].missing_fields == ""            # JSON null counts as present
    assert out["b"].ok is False                      # but fails as a typed field


def test_verdict_parsing(spark):
    df = spark.createDataFrame([("a", '{"is_safe": true, "reject_reason": "PII"}'),
                                ("b", '{"is_safe": false}'), ("c", '{"is_safe": "yes"}'),
                                ("d", '{"reject_reason": null}'), ("e", '{"is_safe": true, "reject_reason": "X"}')],
                               "transcript_id string, raw string")
    out = {r.transcript_id: r for r in ver.parse_verdicts(df).collect()}
    assert out["a"].ok and out["a"].inconsistent
    assert out["b"].ok and out["b"].inconsistent and out["b"].reject_reason is None
    assert out["c"].ok and out["c"].is_safe is True
    assert not out["d"].ok and not out["e"].ok


def test_rule_verdict_word_boundaries_and_pii(spark):
    df = spark.createDataFrame([("a", "What a damn day."), ("b", "Damnation is a word."),
                                ("c", "mail me: x.y@mail.example.com"), ("d", "v1.2.3.45 build"),
                                ("e", "card 4111111111111111!"), ("f", "call +1 (555) 123-4567")],
                               "job_id string, text string")
    out = {r.transcript_id: r.reject_reason for r in ver.rule_verdict(df).collect()}
    assert out == {"a": "PROFANITY", "b": None, "c": "PII", "d": "PII", "e": "PII", "f": "PII"}


@pytest.mark.parametrize("topics,ok,detail", [
    ('""', True, None), ("{}", True, None), ('"ab"', False, "Invalid topic structure in metadata"),
    ('{"a": 1}', False, "Invalid topic structure in metadata"), ("null", False, "topics is not a list"),
    ("5", False, "topics is not a list"), ('[{"name": 3, "confidence_score": 0.5}]', False,
                                             "topic names and key points must be strings")])
def test_topics_of_any_json_type(spark, topics, ok, detail):
    raw = '{"conversation_type": "FORMAL", "topics": %s, "key_points": ["k"]}' % topics
    df = spark.createDataFrame([("t", raw)], "transcript_id string, raw string")
    r = rp.metadata_checks(df).first()
    assert (r.ok, r.detail) == (ok, detail)
    if ok:
        assert rp.parse_metadata(rp.metadata_checks(df)).first().topics == []


def test_error_classes_with_cause_chains(spark):
    from palaver.functions.errors import taxonomy
    errs = spark.createDataFrame([("TokenLimitError", ["ctx too long", "Input exceeds maximum token limit"]),
                                  ("SomethingElse", ["boom"]), ("JobNotFoundError", [])],
                                 "error_class string, causes array<string>")
    out = {r.error_class: r for r in jb.classify_errors(errs, taxonomy(spark), causes_col="causes").collect()}
    assert (out["TokenLimitError"].parent_class, out["TokenLimitError"].status_code) == ("LLMError", 400)
    assert out["TokenLimitError"].root_cause == "Input exceeds maximum token limit"
    assert out["SomethingElse"].status_code == 500 and out["SomethingElse"].parent_class is None
    assert out["JobNotFoundError"].status_code == 404 and out["JobNotFoundError"].root_cause is None


def test_split_outcomes(spark):
    from palaver.plans.outcomes import split
    df = spark.createDataFrame([("a", "x" * 60), ("b", "short")], "job_id string, text string")
    ok, rejected = split(tr.validate_transcripts(df), "job_id")
    assert [r.job_id for r in ok.collect()] == ["a"] and "message" not in ok.columns
    assert rows(rejected, "id", "error_class") == [("b", "SummaryError")]


def test_cluster_settings_stay_bounded():
    from palaver.session import cluster_settings
    small, big = cluster_settings(1 << 30), cluster_settings(100 << 40)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(big["spark.sql.shuffle.partitions"]) == 20_000  # map x reduce blocks stay trackable
    assert big["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"


def test_topics_count_letters_of_all_scripts_and_rank_a_stored_score(spark):
    """Latin-1 texts take a path of their own: every character counts as the pattern of words says."""
    import regex

    from palaver.functions.text import WORD_PATTERN
    from palaver.operators import offline as off
    chars = [chr(c) for c in range(1, 0x180)]
    texts = ["".join(f"ab{c}cd{c} " for c in chars[lo:lo + n]) for n in (7, 64) for lo in range(0, len(chars), n)]
    docs = spark.createDataFrame([*enumerate(texts), (9999, None)], "job_id int, text string")
    for least in (1, 4):
        got = {}
        for r in off.term_counts(docs, least).collect():
            got.setdefault(r.id, {})[r.word] = r.f
        for i, t in enumerate(texts):
            want = [w for w in regex.findall(WORD_PATTERN, t.lower()) if len(w) >= least]
            assert got.get(i, {}) == {w: want.count(w) for w in want}
    plan = off.topics(docs)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line or "WindowGroupLimit" in line]
    assert sorts and not any("round(" in line for line in sorts) and "BroadcastHashJoin" not in plan
    assert "MapInArrow" not in plan  # counted once, then read
