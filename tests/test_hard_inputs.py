"""Inputs that the derived fixtures do not hold: nulls, ties, repeats, long texts, many rows."""

import pytest
from pyspark.sql import functions as F

from palaver.operators import admission, jobs, offline, summaries, transcripts
from palaver.plans.ordering import global_row_number


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_positions_are_exact_for_a_million_wide_rows(spark, aqe):
    n = 1_000_000
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        df = spark.range(n).select(
            (F.col("id") % 3).alias("r"), F.xxhash64("id").alias("t"), F.col("id").cast("string").alias("job_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        out = global_row_number(df, [F.col("r"), F.col("t"), F.col("job_id")], "pos")
        got = out.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
        assert tuple(got) == (n, n, 1, n)
        prev = out.where("pos % 1000 < 2").select("pos", "r", "t").orderBy("pos").collect()
        assert [(x.r, x.t) for x in prev] == sorted((x.r, x.t) for x in prev)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_summary_is_cut_not_dropped(spark):
    long = " ".join(["word"] * 1500)
    docs = spark.createDataFrame([("a", long), ("b", "One two. " + long + "."), ("c", "..."), ("d", None), ("e", "")],
                                 "job_id string, text string")
    got = {r.job_id: r.summary_text for r in offline.summary_text(docs).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].split() == ["word"] * 1000
    assert sum(len(t.split()) for t in [got["b"]]) <= 1002 and "word" in got["b"]
    kept = offline.extractive_summary(docs).groupBy("job_id").agg(F.sum("n_words").alias("n")).collect()
    assert all(r.n <= 1000 for r in kept)


def test_document_operators_shuffle_nothing(spark):
    docs = spark.createDataFrame([("a", "One two three.")], "job_id string, text string")
    for df in (offline.summary_text(docs), offline.key_points(docs), offline.conversation_type(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_empty_and_null_turns(spark):
    turns = spark.createDataFrame([(1, 0, "a", ""), (1, 1, "b", None), (2, 0, None, "hi"), (2, 1, "b", "yo yo")],
                                  "conv_id long, turn int, role string, text string")
    shares = {(r.job_id, r.name): r.share for r in transcripts.speaker_shares(turns).collect()}
    assert shares[("1", "a")] == shares[("1", "b")] == 0.0
    assert shares[("2", "b")] == 5 / 7
    t = {r.job_id: r for r in transcripts.assemble_transcripts(turns).collect()}
    assert t["1"].text == "a: \nb:" and t["1"].n_turns == 2
    assert t["2"].text == ": hi\nb: yo yo"
    spent = transcripts.allocate_speaking_time(transcripts.assemble_transcripts(turns),
                                               transcripts.speaker_shares(turns)).collect()
    assert len(spent) == 4


def test_every_transcript_ends_as_summary_or_failure(spark):
    text = "x" * 60
    t = spark.createDataFrame([(str(i), text, 1.0) for i in range(4)] + [("4", "short", 1.0)],
                              "job_id string, text string, duration double")
    reply = '{"conversation_type": "CASUAL", "topics": [], "key_points": []}'
    s_rep = spark.createDataFrame([(str(i), "fine") for i in (0, 1, 2, 4)], "transcript_id string, raw string")
    m_rep = spark.createDataFrame([("0", reply), ("1", "no json"), ("3", reply)], "transcript_id string, raw string")
    ok, failed = summaries.summarize_with_replies(t, s_rep, m_rep)
    assert [r.transcript_id for r in ok.collect()] == ["0"]
    found = {r.transcript_id: r.detail for r in failed.collect()}
    assert set(found) == {"1", "2", "3", "4"}
    assert found["2"] == "no metadata reply" and found["3"] == "no summary reply"
    n = summaries.batch_summarize(ok, failed).first()
    assert n.n_success + n.n_failed == 5


def test_admission_edges(spark):
    mib = 1 << 20
    rows = [(1, "http://h/a.mp3;v=1", "ok", 200, str(mib)), (2, None, "ok", 200, "1"),
            (3, "https://h/a.mp3", "ok", 200, "105119744"), (4, "https://h/a.mp3", "ok", 200, "many"),
            (5, "https://h/a.mp3", "ok", None, "1"), (6, "https://h/a.mp3", "ok", 200, str(100 * mib)),
            (7, "https://h/x;y/a.wav", "ok", 200, None)]
    subs = spark.createDataFrame([(r[0], r[1], "LOW") for r in rows], "page_id long, url string, priority string")
    probe = spark.createDataFrame([(r[0], r[2], r[3], r[4], "audio/mp3") for r in rows],
                                  "page_id long, outcome string, http_status int, content_length string, content_type string")
    got = {r.page_id: r for r in admission.admit(subs, probe, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert [got[i].status for i in range(1, 8)] == ["PENDING", "FAILED", "FAILED", "FAILED", "FAILED", "PENDING", "PENDING"]
    assert got[2].error_class == "InvalidURLError"
    assert "(100.2MB)" in got[3].error_message  # halves round to even
    assert got[4].error_class == got[5].error_class == "TranscriptionError"


def test_the_same_url_twice_in_a_batch_gives_two_jobs(spark):
    subs = spark.createDataFrame([(1, 0, "https://h/a.mp3", None), (1, 1, "https://h/a.mp3", None)],
                                 "request_id long, pos int, url string, priority string")
    probe = spark.createDataFrame([("https://h/a.mp3", "ok", 200, "1", "audio/mp3")],
                                  "url string, outcome string, http_status int, content_length string, content_type string")
    got = admission.admit(subs, probe, F.lit("2024-01-01").cast("timestamp_ntz"), key="url",
                          id_cols=["request_id", "pos"]).collect()
    assert len({r.job_id for r in got}) == 2 and all(r.status == "PENDING" for r in got)


def test_repeated_and_unknown_requests(spark):
    table = spark.createDataFrame([("a", "PENDING"), ("b", "COMPLETED")], "job_id string, status string") \
        .withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("started_at", "completed_at")}) \
        .withColumn("error_message", F.lit(None).cast("string"))
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "job_id string")
    moved = jobs.mark_processing(table, ids, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert sorted((r.job_id, r.status) for r in moved) == [("a", "PROCESSING"), ("b", "COMPLETED")]
    missed = {r.job_id: r.error_class for r in jobs.request_misses(table, ids).collect()}
    assert missed == {"a": "InvalidJobStateError", "zz": "JobNotFoundError"}


def _lifecycle(spark, tmp_path, name, batches):
    from palaver.streaming.lifecycle import final_states, lifecycle_stream
    src, out = f"{tmp_path}/{name}/in", f"{tmp_path}/{name}/out"
    for rows in batches:
        spark.createDataFrame(rows, "job_id string, seq long, at string, kind string") \
            .select("job_id", "seq", F.col("at").cast("timestamp_ntz").alias("ts"), "kind") \
            .coalesce(1).write.mode("append").parquet(src)
        lifecycle_stream(spark, src, out, f"{tmp_path}/{name}/ck").awaitTermination()
    log = spark.read.parquet(out)
    final = final_states(log).select("job_id", "status", "completed_at", "n_events", "n_illegal", "error_message")
    return sorted(tuple(r) for r in final.collect()), log


def test_lifecycle_does_not_depend_on_batches(spark, tmp_path):
    d = "2024-01-01 "
    events = [("a", 1, d + "00:00:00", "start"), ("b", 1, d + "00:05:00", "start"), ("b", 2, d + "00:20:00", "complete"),
              ("a", 2, d + "00:45:00", "complete"), ("c", 1, d + "00:50:00", "fail"), ("d", 1, d + "02:00:00", "start")]
    one, _ = _lifecycle(spark, tmp_path, "one", [events])
    three, _ = _lifecycle(spark, tmp_path, "three", [events[:2], events[2:4], events[4:]])
    assert one == three
    got = {r[0]: r for r in one}
    assert got["a"][1] == "FAILED" and str(got["a"][2]) == "2024-01-01 00:30:00" and got["a"][5]
    assert got["b"][1] == "COMPLETED" and got["b"][5] is None
    assert got["c"][1] == "FAILED" and got["c"][5]


def test_events_after_the_retention_time_are_late(spark, tmp_path):
    d = "2024-01-01 "
    events = [("a", 1, d + "00:00:00", "start"), ("a", 2, d + "00:10:00", "complete"), ("a", 3, d + "03:00:00", "start")]
    one, log = _lifecycle(spark, tmp_path, "late1", [events])
    two, log2 = _lifecycle(spark, tmp_path, "late2", [events[:2], events[2:]])
    assert one == two and one[0][1] == "COMPLETED" and one[0][3] == 2
    assert log.where("change = 'late'").count() == log2.where("change = 'late'").count() == 1


def test_replies_are_read_as_python_reads_them(spark):
    from palaver.operators.replies import metadata_checks, parse_metadata
    good = '"topics": [{"name": "t", "confidence_score": 0.5}], "key_points": ["k"]}'
    rows = [("dup", '{"conversation_type": "FORMAL", "conversation_type": "COMEDY", ' + good),
            ("two", '{"conversation_type": "COMEDY", ' + good + ' {"a": 1}'),
            ("nan", '{"conversation_type": "COMEDY", "topics": [{"name": "t", "confidence_score": NaN}], "key_points": []}'),
            ("ok", '```json\n{"conversation_type": "CASUAL", ' + good + "\n```"), ("none", None)]
    checked = metadata_checks(spark.createDataFrame(rows, "transcript_id string, raw string"))
    got = {r.transcript_id: (r.ok, r.detail) for r in checked.collect()}
    assert got["dup"] == got["ok"] == (True, None)
    assert got["two"] == got["none"] == (False, "LLM did not return valid JSON")
    assert got["nan"] == (False, "Topic confidence score must be between 0 and 1")
    kinds = {r.transcript_id: r.conversation_type for r in parse_metadata(checked).collect()}
    assert kinds == {"dup": "COMEDY", "ok": "CASUAL"}


def test_no_reply_ends_the_job(spark):
    """Half surrogate pairs, deep nesting, long numbers: outcomes of rows, as Python's reader has them."""
    import json

    from palaver.operators.replies import check_json, metadata_checks, parse_metadata
    good = '{"conversation_type": "COMEDY", "topics": [{"name": "%s", "confidence_score": 0.5}], "key_points": ["%s"]}'
    texts = [good % ("\\ud800", "k"), good % ("a", "\\udc00\\ud800"), good % ("\\ud83d\\ude00", "k"), good % ("t", "k" * 200_000),
             "[" * 900 + "]" * 900, "[" * 100_000, '{"a": ' + "9" * 2000 + "}", '{"a": ' + "9" * 5000 + "}", '{"a": 1e999}', "", "null",
             "1]", "1,2", '{"a": 1},{"b": 2}', '"\\ud800"', "﻿1", "01", "1 1", "nul", '{"a": "\x01"}', '{"a": 1,}', "-0", "NaN", "Infinity"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "transcript_id string, cleaned string")

    def python_reads(t):
        try:
            json.loads(t)
            return True
        except (ValueError, RecursionError):
            return False
    got = {r.transcript_id: r.is_json for r in check_json(rows).select("transcript_id", "is_json").collect()}
    assert got == {str(i): python_reads(t) for i, t in enumerate(texts)}
    parsed = {r.transcript_id: r for r in parse_metadata(metadata_checks(rows, raw_col="cleaned")).collect()}
    assert parsed["0"].topics[0].name == "�" and parsed["1"].key_points == ["��"]
    assert parsed["2"].topics[0].name == "\U0001f600" and len(parsed["3"].key_points[0]) == 200_000


def test_verdicts_are_read_as_python_reads_them(spark):
    from palaver.operators.verification import parse_verdicts
    rows = [("dup", '{"is_safe": true, "is_safe": false, "reject_reason": "PII"}'), ("nan", '{"is_safe": true, "x": NaN}'),
            ("two", '{"is_safe": true} {"is_safe": false}'), ("half", '{"is_safe": true, "x": "\\ud800"}'), ("none", None),
            ("key", '{"is_safe": "no", "reject_reason": "\\ud800"}')]
    got = {r.transcript_id: (r.ok, r.is_safe, r.reject_reason) for r in
           parse_verdicts(spark.createDataFrame(rows, "transcript_id string, raw string")).collect()}
    assert got == {"dup": (True, False, "PII"), "nan": (True, True, None), "two": (False, None, None),
                   "half": (True, True, None), "none": (False, None, None), "key": (False, None, None)}


def test_parsed_replies_are_computed_once(spark):
    """The parser stands at most three times in a plan (JVM lane, exact lane), however often its value is used."""
    from palaver.operators.replies import metadata_checks, parse_metadata
    rows = spark.createDataFrame([("a", "{}")], "transcript_id string, raw string")
    plan = parse_metadata(metadata_checks(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") <= 3, plan
