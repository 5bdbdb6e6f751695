"""Model calls, sources, sinks and streams."""

import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.stub_client import stub_client_factory
from palaver.operators import completion as cp
from palaver.operators import jobs as jb
from palaver.operators import prompts as pr
from palaver.operators import summaries as sm
from palaver.operators.completion import CompletionError
from palaver.session import scratch_path
from palaver.sources import readers as rd
from palaver.sources import sinks as sk
from tests.conftest import SF_SMALL

# clients defined here run in Python workers, which cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _failing_factory():
    def client(*_):
        raise RuntimeError("must not be called")
    return client


def test_complete_stores_and_never_calls_twice(spark):
    req = pr.build_requests(fx.doc_transcripts(spark, SF_SMALL), rd.examples_prefix(spark))
    store = scratch_path(spark, "test-complete")
    first = cp.complete(req, stub_client_factory, store)
    n = first.count()
    assert n == req.count()
    # a second run calls the client only where the first failed for a passing reason
    passing = first.where(F.col("error_kind").isin(*cp.RETRY)).count()
    again = cp.complete(req, _failing_factory, store)
    assert again.count() == n
    assert again.where(F.col("error_kind") == "other").count() == passing == again.where("attempt = 2").count()
    # small chunks commit one by one and give the same rows
    parts = cp.complete(req, stub_client_factory, scratch_path(spark, "test-chunks"), concurrency=2, rows_per_task=50)
    assert parts.select("request_id", "error_kind").exceptAll(first.select("request_id", "error_kind")).count() == 0
    rep = cp.replies(first)
    kinds = {r.error_class for r in rep.select("error_class").distinct().collect()}
    assert None in kinds  # most calls succeed
    usage = cp.usage_report(first).collect()
    assert sum(r.n_calls for r in usage) == n


def test_client_errors_become_rows(spark):
    def factory():
        def client(system, user, max_tokens, temperature):
            if len(user) % 2 == 0:
                raise CompletionError("rate_limit", "slow down")
            return {"choices": ["a", "b"], "prompt_tokens": 1, "completion_tokens": 2, "model": "m"}
        return client
    req = pr.build_requests(fx.doc_transcripts(spark, SF_SMALL), "", ["metadata"])
    rep = cp.replies(cp.complete(req, factory, scratch_path(spark, "test-errors")))
    got = {(r.error_class, r.raw) for r in rep.select("error_class", "raw").distinct().collect()}
    assert ("LLMRateLimitError", None) in got and (None, "a b") in got


def test_request_settings_fall_back_on_zero(spark):
    v = spark.createDataFrame([(0,), (None,), (7,)], "x int").select(pr.effective(F.col("x"), 4096).alias("e"))
    assert [r.e for r in v.collect()] == [4096, 4096, 7]


def test_examples_file_first_two(spark):
    ex = rd.read_examples(spark).collect()
    assert [r.pos for r in ex] == [0, 1]
    assert ex[0].metadata.conversation_type == "PROFESSIONAL"


def test_export_report_keeps_nulls(spark):
    path = scratch_path(spark, "test-report")
    sk.export_jobs_report(fx.jobs(spark, SF_SMALL), path)
    text = spark.read.text(path)
    assert text.where(F.col("value").contains('"started_at":null')).count() > 0
    r = spark.read.json(path).where("job_id = '0'").first()
    assert r.created_at == "2024-01-31 18:00:00"


def test_partitioned_table_prunes_by_status(spark):
    path = scratch_path(spark, "test-table")
    sk.write_table(fx.jobs(spark, SF_SMALL), path, ["status"])
    df = sk.read_table(spark, path).where("status = 'FAILED'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    assert df.count() == fx.jobs(spark, SF_SMALL).where("status = 'FAILED'").count()


def test_strict_batch_raises_for_smallest_failed_id(spark):
    docs = fx.doc_transcripts(spark, SF_SMALL)
    texts = docs.select(F.col("job_id").alias("transcript_id"), F.lit("a summary").alias("raw"))
    s, f = sm.summarize_with_replies(docs, texts, fx.llm_responses(spark, SF_SMALL))
    counts = sm.batch_summarize(s, f).first()
    assert counts.n_success + counts.n_failed == docs.count()
    with pytest.raises(sm.SummaryError, match="^Batch processing failed: Error summarizing transcript"):
        sm.batch_summarize(s, f, continue_on_error=False)


def test_lifecycle_timeouts(spark):
    """A job stuck in PROCESSING times out once the watermark passes 30 minutes."""
    from palaver.streaming.lifecycle import final_states, lifecycle_stream
    rows = [("a", 1, "2024-01-01 00:00:00", "start"), ("b", 2, "2024-01-01 00:00:00", "start"),
            ("b", 3, "2024-01-01 00:10:00", "complete"), ("c", 4, "2024-01-01 03:00:00", "start")]
    ev = spark.createDataFrame(rows, "job_id string, seq long, ts string, kind string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    inp, out, ck = (scratch_path(spark, n) for n in ("t-w2-in", "t-w2-out", "t-w2-ck"))
    ev.where("seq < 4").write.parquet(inp)
    q = lifecycle_stream(spark, inp, out, ck)
    q.awaitTermination()
    ev.where("seq = 4").write.mode("append").parquet(inp)   # moves the watermark to 02:50
    q = lifecycle_stream(spark, inp, out, ck)
    q.awaitTermination()
    q = lifecycle_stream(spark, inp, out, ck)                 # a run with no data fires timers
    q.awaitTermination()
    final = {r.job_id: r for r in final_states(spark.read.parquet(out)).collect()}
    assert final["a"].status == "FAILED" and final["a"].error_message == "Job timed out during forced cleanup"
    assert final["c"].status == "PROCESSING"
    changes = {(r.job_id, r.change) for r in spark.read.parquet(out).collect()}
    assert ("b", "dropped") in changes  # finished over an hour before the watermark


def test_sweep_stream_matches_batch(spark):
    from palaver.streaming.sweep import sweep_stream
    inp, out, ck = (scratch_path(spark, n) for n in ("t-w3-in", "t-w3-out", "t-w3-ck"))
    jobs = fx.jobs(spark, SF_SMALL)
    jobs.write.parquet(inp)
    now = fx.ts_ntz(fx.CLOCK)
    sweep_stream(spark, inp, out, ck, now=now).awaitTermination()
    got = spark.read.parquet(f"{out}/stats").drop("batch_id", "batch").first().asDict()
    assert got == jb.sweep_stats(jobs, now).first().asDict()


def test_admission_stream_restarts_without_duplicates(spark):
    """Re-running from the checkpoint admits nothing twice; a new file is admitted once."""
    from palaver.streaming.admission import admission_stream
    subs = fx.url_submissions(spark, SF_SMALL)
    probe = fx.url_probe(spark, SF_SMALL)
    now = fx.ts_ntz(fx.CLOCK)
    inp, out, ck = (scratch_path(spark, n) for n in ("t-w1-in", "t-w1-out", "t-w1-ck"))
    subs.where("page_id % 2 = 0").write.json(inp)
    admission_stream(spark, inp, probe, now, out, ck).awaitTermination()
    first = spark.read.parquet(out).count()
    admission_stream(spark, inp, probe, now, out, ck).awaitTermination()   # restart, no new data
    assert spark.read.parquet(out).count() == first
    subs.where("page_id % 2 = 1").write.mode("append").json(inp)
    admission_stream(spark, inp, probe, now, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == subs.count()
    assert got.select("page_id").distinct().count() == subs.count()


def test_complete_resumes_after_a_partial_run(spark):
    """Requests stored by an earlier (interrupted) run are never sent again."""
    req = pr.build_requests(fx.doc_transcripts(spark, SF_SMALL), "", ["verification"])
    store = scratch_path(spark, "test-resume")
    done_ids = req.where(F.length("user_content") % 2 == 0)
    stored = cp.complete(done_ids, stub_client_factory, store)
    final = F.coalesce(~F.col("error_kind").isin(*cp.RETRY), F.lit(True))  # passing failures are asked again
    marked = {r.request_id for r in stored.where(final).select("request_id").collect()}

    def refusing_factory():
        def client(system, user, max_tokens, temperature):
            if len(user) % 2 == 0:
                raise RuntimeError("called twice")
            return {"choices": ["{}"], "prompt_tokens": 1, "completion_tokens": 1, "model": "m"}
        return client

    full = cp.complete(req, refusing_factory, store)
    assert full.count() == req.count()
    again = full.where(F.col("request_id").isin(list(marked)) & (F.col("error_kind") == "other"))
    assert again.count() == 0


def _noting_factory(folder, fatal_after=None):
    """A client that leaves a file per call, and ends its process from the given call on."""
    def factory():
        def client(system, user, max_tokens, temperature):
            import os
            import uuid
            if fatal_after is not None and len(os.listdir(folder)) >= fatal_after:
                raise SystemExit("the worker is lost")
            with open(f"{folder}/{hash(user)}-{uuid.uuid4().hex}", "w") as f:
                f.write(user)
            return {"choices": [user[:5]], "prompt_tokens": 1, "completion_tokens": 1, "model": "m"}
        return client
    return factory


def test_restart_finishes_open_chunks_only(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"text number {i}") for i in range(60)], "job_id string, text string")
    req = pr.build_requests(docs, "", ["verification"])
    store, calls = scratch_path(spark, "test-restart"), str(tmp_path)
    # the fifth chunk or so meets the end of the worker
    with pytest.raises(Exception, match="lost|SystemExit|Python worker"):
        cp.complete(req, _noting_factory(calls, fatal_after=30), store, concurrency=1, rows_per_task=7)
    log = spark.read.schema(cp.LOG).parquet(f"{store}/log")
    chunks = log.where("kind = 'begun'").first().chunks
    done = {r.chunk for r in log.where("kind = 'done'").collect()}
    left = cp.open_chunks(spark, store)
    assert 0 < len(done) < len(chunks) and [c for _, c in left] == sorted(set(chunks) - done)
    # readers see whole chunks only, and what is open is found in the log alone
    seen = {r.request_id for r in cp.outcomes(spark, store).collect()}
    run = left[0][0]
    whole = {r.request_id for c in done for r in cp.chunk_requests(spark, store, run, c).collect()}
    assert seen == whole
    # a chunk's scan reads its own folder
    files = cp.chunk_requests(spark, store, run, left[0][1]).inputFiles()
    assert files and all(f"run={run}/chunk={left[0][1]}/" in f for f in files)
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    full = cp.complete(req, _noting_factory(str(tmp_path / "a")), store, concurrency=1, rows_per_task=7)
    assert full.count() == 60 and full.where("error_kind is not null").count() == 0
    assert len(list((tmp_path / "a").iterdir())) == 60 - len(whole)  # nothing of a committed chunk again
    assert not cp.open_chunks(spark, store)
    assert cp.complete(req, _noting_factory(str(tmp_path / "b")), store).count() == 60
    assert not list((tmp_path / "b").iterdir())


def test_compaction_keeps_the_last_attempts(spark):
    def factory(kind):
        def make():
            def client(system, user, max_tokens, temperature):
                if len(user) % 3 == 0 and kind:
                    raise CompletionError(kind, "later")
                return {"choices": [user], "prompt_tokens": 1, "completion_tokens": 1, "model": "m"}
            return client
        return make
    docs = spark.createDataFrame([(str(i), "x" * i) for i in range(40)], "job_id string, text string")
    req = pr.build_requests(docs, "", ["verification"])
    store = scratch_path(spark, "test-compact")
    assert cp.compact(spark, store) == []
    cp.complete(req, factory("timeout"), store, concurrency=2, rows_per_task=5)
    before = cp.complete(req, factory(None), store, concurrency=2, rows_per_task=5).orderBy("request_id").collect()
    assert {r.attempt for r in before} == {1, 2}
    gone = cp.compact(spark, store)
    assert len(gone) == 2
    after = cp.outcomes(spark, store)
    assert after.orderBy("request_id").collect() == before
    assert cp.complete(req, _failing_factory, store).orderBy("request_id").collect() == before
    assert len(cp.compact(spark, store)) == 1  # the compacted run itself
    assert cp.outcomes(spark, store).count() == 40


def test_lifecycle_limits_do_not_depend_on_batches(spark, duck):
    """One, three and twenty micro-batches give the batch fold with time limits, whatever the shards."""
    from checks.oracle import ORACLE
    from palaver.streaming.lifecycle import final_states, lifecycle_stream
    events = fx.job_events(spark, SF_SMALL)
    want = sorted(map(str, duck.sql(ORACLE["w02_lifecycle_limits"]).fetchall()))
    for n, buckets in ((1, 1), (3, 64), (20, 7)):
        inp, out, ck = (scratch_path(spark, f"t-w2-{n}-{x}") for x in ("in", "out", "ck"))
        edges = (events.approxQuantile("seq", [k / n for k in range(1, n)], 0.0) if n > 1 else []) + [float("inf")]
        low = float("-inf")
        for high in edges:  # files in order of time, one per micro-batch
            events.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(inp)
            low = high
        for _ in range(2):
            lifecycle_stream(spark, inp, out, ck, tombstone_minutes=24 * 60, buckets=buckets, files_per_batch=1,
                             state_partitions=2).awaitTermination()
        log = spark.read.parquet(out)
        late = log.where("change = 'late'").groupBy("job_id").agg(F.sum("n_events").alias("n_late"))
        got = final_states(log).join(late, "job_id", "left").select(
            "job_id", "status", "started_at", "completed_at", "n_events", "n_illegal", "error_message",
            (F.col("change") == "dropped").alias("dropped"), F.coalesce("n_late", F.lit(0)))
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == want
        numbered = log.where("change != 'late'").groupBy("job_id", "change_no").count().where("count > 1")
        assert numbered.count() == 0


def test_limits_of_one_job_against_its_text():
    from palaver.streaming.lifecycle import FIELDS, FRESH, Limits
    minute = 60_000_000
    limits = Limits(30, 60, 60)
    st = dict(zip(FIELDS, FRESH))
    log = list(limits.events(st, [(1, 0, "start"), (2, 30 * minute, "complete")]))
    assert [(c, s["status"]) for s, c, _ in log] == [("update", "COMPLETED")]  # the limit itself is in time
    st = dict(zip(FIELDS, FRESH))
    log = list(limits.events(st, [(1, 0, "start"), (2, 30 * minute + 1, "complete"), (3, 91 * minute, "start")]))
    assert [(c, us // minute) for _, c, us in log] == [("update", 0), ("timeout", 30), ("update", 30), ("dropped", 90), ("late", 91)]
    assert st["status"] == "FAILED" and st["n_illegal"] == 1 and limits.wakes(st) == 150 * minute
    st = dict(zip(FIELDS, FRESH))
    assert not list(limits.until(st, 10 ** 15)) and limits.wakes(st) is None  # PENDING has no limit


def test_readers_see_published_batches_only(spark, monkeypatch):
    from palaver.streaming import sweep as sw
    out = scratch_path(spark, "t-w3-publish")
    now = fx.ts_ntz(fx.CLOCK)
    jobs = fx.jobs(spark, SF_SMALL).select(*sw.S.JOB.fieldNames()).withColumn("snapshot", F.lit("a"))
    assert sw.swept_jobs(spark, out).count() == 0 and sw.sweep_report(spark, out).count() == 0
    real = sw.sweep_stats

    def lost(*args, **kwargs):
        raise RuntimeError("the driver is lost")
    monkeypatch.setattr(sw, "sweep_stats", lost)
    with pytest.raises(RuntimeError):
        sw.publish(spark, jobs, 0, out, now)  # the swept rows are written, the entry is not
    assert sw.swept_jobs(spark, out).count() == 0
    monkeypatch.setattr(sw, "sweep_stats", real)
    for _ in range(2):  # the second try of a published batch changes nothing
        sw.publish(spark, jobs, 0, out, now)
    sw.publish(spark, jobs.withColumn("snapshot", F.lit("b")).limit(10), 1, out, now)
    want = jb.sweep(jobs.drop("snapshot"), now)
    got = sw.swept_jobs(spark, out, "a").drop("snapshot")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    report = {r.snapshot: r.initial_job_count for r in sw.sweep_report(spark, out).collect()}
    assert report == {"a": jobs.count(), "b": 10}


def test_root_causes_of_long_chains_and_circles(spark):
    rows = [(i, f"C{i}", i - 1 if i else None) for i in range(3000)]  # one chain of 3,000
    rows += [(10_001, "A", 10_002), (10_002, "B", 10_003), (10_003, "A", 10_001), (10_004, "X", 10_002)]  # a circle
    rows += [(20_000, "Y", 99_999), (20_001, None, 20_000), (20_002, "Z", 20_002)]  # unknown cause, no class, itself
    got = {r.error_id: r for r in jb.root_causes(spark.createDataFrame(
        rows, "error_id long, error_class string, cause_id long")).collect()}
    assert len(got) == len(rows)
    assert all((got[i].root_id, got[i].root_class, got[i].depth) == (0, "C0", i) for i in range(3000))
    assert all(got[i].root_id is None and got[i].depth is None for i in (10_001, 10_002, 10_003, 10_004, 20_002))
    assert (got[20_001].root_id, got[20_001].root_class, got[20_001].depth) == (20_000, "Y", 1)


def test_rollup_over_a_deeper_taxonomy(spark):
    taxonomy = spark.createDataFrame([("Top", None, 500), ("Mid", "Top", 501), ("Low", "Mid", 502), ("Odd", "Odd", 503)],
                                     "error_class string, parent_class string, status_code int")
    caused = jb.root_causes(spark.createDataFrame(
        [(1, "Low", None), (2, "Mid", 1), (3, "Alien", 2), (4, "Odd", None)], "error_id long, error_class string, cause_id long"))
    got = {r.error_class: (r.status_code, r.n, r.n_root, r.n_below, r.n_root_below) for r in jb.error_rollup(caused, taxonomy).collect()}
    assert got == {"Top": (500, 0, 0, 2, 3), "Mid": (501, 1, 0, 2, 3), "Low": (502, 1, 3, 1, 3), "Odd": (503, 1, 1, 1, 1),
                   "Alien": (500, 1, 0, 1, 0)}


def test_last_folder_takes_time_in_proportion_to_the_path(spark):
    import time

    from palaver.streaming.sweep import folder_of
    paths = spark.createDataFrame([("file:///a/whole/part-0.parquet",), ("s3://b/x y/p",), ("file:///p",)], "p string")
    assert [r[0] for r in paths.select(folder_of(F.col("p"))).collect()] == ["whole", "x y", ""]
    begun = time.monotonic()
    deep = spark.range(400).select(F.concat(F.lit("/" + "/".join(["d" * 5000] * 4) + "/"), F.col("id").cast("string"),
                                            F.lit("/part-0.parquet")).alias("p"))
    assert deep.select(folder_of(F.col("p")).alias("f")).where("f rlike '^[0-9]+$'").count() == 400
    assert time.monotonic() - begun < 30


def test_requests_are_shuffled_once(spark, monkeypatch):
    """The texts pass one exchange on their way to the callers; equal ids are asked once, whatever the layout."""
    from pyspark.sql import DataFrameWriter
    written, plan_of = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    real = DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        written.append((path, plan_of(self._df)))
        return real(self, path, *args, **kwargs)
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    docs = spark.range(40).select(F.col("id").cast("string").alias("job_id"),
                                  F.concat(F.lit("some words number "), F.col("id").cast("string")).alias("text"))
    req = pr.build_requests(docs.unionByName(docs.where("cast(job_id as int) % 2 = 0")), "p")
    got = cp.complete(req, stub_client_factory, scratch_path(spark, "test-once"), concurrency=2, rows_per_task=20).collect()
    assert len(got) == len({r.request_id for r in got}) == 120
    moved = [line for path, plan in written if "/requests/" in path or "/results/" in path
             for line in plan.splitlines() if "Exchange" in line]
    texts = [line for line in moved if "request_id" not in line or "REPARTITION_BY_NUM" in line]
    assert len(texts) == 2  # the requests and, beside them, the ids to send


def test_client_summaries_shuffle_texts_once_per_task(spark, monkeypatch):
    """Metadata is asked only where a summary came; choosing these jobs moves no text."""
    from pyspark.sql import DataFrameWriter
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved, real = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        nodes = self._df._jdf.queryExecution().explainString(formatted).split("\n\n")
        moved.extend(n for n in nodes if ") Exchange\n" in n and re.search(r"[\[ ](text|user_content)#", n))
        return real(self, path, *args, **kwargs)

    def factory():
        def client(system, user, max_tokens, temperature):
            summary, body = system.startswith("Summarise"), user.rsplit("Transcript: ", 1)[-1]
            if body.startswith("mute") or (body.startswith("half") and not summary):
                raise CompletionError("connection" if summary else "rate_limit", "x")
            reply = "short" if summary else '{"conversation_type": "CASUAL", "topics": [], "key_points": []}'
            return {"choices": [reply], "prompt_tokens": 1, "completion_tokens": 1, "model": "m"}
        return client
    fill = " and some words that make the text long enough to be taken"
    docs = spark.createDataFrame(
        [("1", "good" + fill), ("2", "mute" + fill), ("3", "half" + fill), ("4", "brief"), ("5", None), ("6", "good" + fill),
         ("7", "mute" + fill), ("7", "good" + fill), ("8", "good one" + fill), ("8", "good two" + fill)],
        "job_id string, text string").withColumn("duration", F.lit(1.0))
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        s, f = sm.summarize_with_client(docs, factory, scratch_path(spark, "test-client"), "p", concurrency=1, mode="sql")
        rows = (s.select("transcript_id", F.lit("").alias("error_class")).distinct()
                .unionByName(f.select("transcript_id", "error_class")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.transcript_id for r in rows if not r.error_class) == ["1", "6", "7", "8"]
    # job 7 has two texts, one without a summary: its metadata is asked, for both texts, as the job is
    assert sorted((r.transcript_id, r.error_class) for r in rows if r.error_class) == [
        ("2", "LLMConnectionError"), ("3", "LLMRateLimitError"), ("4", "SummaryError"), ("5", "SummaryError"),
        ("7", "LLMConnectionError"), ("7", "LLMRateLimitError")]
    assert len(moved) == 2
