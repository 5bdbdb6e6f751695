"""S1 and W1 with bad records: reasons, nothing lost, restarts."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from palaver.session import scratch_path
from palaver.sources import readers as rd
from palaver.streaming.admission import admission_lanes_stream

LINES = {
    '{"request_id": 1, "urls": ["https://a.org/x.mp3", "https://a.org/x.mp3"]}': None,
    '{"request_id": 2, "urls": [], "priority": "LOW"}': None,
    '{"request_id": 3, "urls": ["https://a.org/y.wav"], "priority": null, "other": {"line": 1}}': None,
    '{"request_id": 4, "urls": ["https://a.org/z': "malformed",
    '{"request_id": 5, "urls": "https://a.org/z.mp3"}': "malformed",
    '{"request_id": "six", "urls": ["https://a.org/z.mp3"]}': "malformed",
    '["request_id", 7]': "malformed",
    'no json': "malformed",
    '{"request_id": 8}': "missing_urls",
    '{"request_id": 9, "urls": null}': "missing_urls",
    '{"request_id": 10, "urls": ["https://a.org/z.mp3", null]}': "null_url",
    '{"request_id": 11, "urls": ["https://a.org/z.mp3"], "priority": "urgent"}': "unknown_priority",
    '{"urls": ["https://a.org/z.mp3"]}': "missing_request_id",
    '{}': "missing_request_id",
}


def test_every_line_has_one_lane(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate([*LINES, "", "  ", None])], "line string, no int")
    ok, bad = rd.split_submissions(df, keep=("no",))
    assert {r["line"]: r["reason"] for r in bad.collect()} == {k: v for k, v in LINES.items() if v}
    rows = ok.orderBy("request_id", "pos").collect()
    assert [(r["request_id"], r["pos"], r["priority"], r["no"]) for r in rows] == [
        (1, 0, "MEDIUM", 0), (1, 1, "MEDIUM", 0), (3, 0, "MEDIUM", 2)]
    none_ok, none_bad = rd.split_submissions(df.limit(0))
    assert none_ok.count() == 0 and none_bad.count() == 0


def test_stream_restarts_without_losing_or_repeating(spark):
    inp, out, bad, ck = (scratch_path(spark, n) for n in ("l-in", "l-out", "l-bad", "l-ck"))
    probe = spark.createDataFrame(
        [("1/0", "ok", 200, 10, "audio/mpeg"), ("3/0", "timeout", None, None, None)],
        "submission string, outcome string, http_status int, content_length long, content_type string")
    lines = list(LINES)
    for part in (lines[:6], lines[6:], []):  # the last start finds nothing new
        if part:
            spark.createDataFrame([(x,) for x in part], "line string").coalesce(1).write.mode("append").text(inp)
        admission_lanes_stream(spark, inp, probe, fx.ts_ntz(fx.CLOCK), out, bad, ck).awaitTermination()
    jobs = spark.read.parquet(out)
    got = {r["submission"]: r["error_class"] for r in jobs.collect()}
    assert got == {"1/0": None, "1/1": "InvalidURLError", "3/0": "TranscriptionTimeoutError"}
    assert jobs.select("job_id").distinct().count() == jobs.count() == 3
    rejected = spark.read.parquet(bad)
    assert rejected.count() == sum(v is not None for v in LINES.values())
    assert rejected.agg(F.count_distinct("batch_id")).first()[0] == 2
