"""L2 sketches: error bound, merging, late lines, stream against batch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import logs as lg
from palaver.session import scratch_path
from palaver.streaming.latency import latency_stream, read_sketches

LINE = "{} - app.app - INFO - app.py:log_requests:166 - Path: {} Method: GET Status: {} Duration: {}s"


def _parsed(spark, rows):
    lines = spark.createDataFrame([(LINE.format(*r),) for r in rows], "line string")
    return lg.timed(lg.parse_request_log(lines)[0])


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_quantiles_within_the_stated_error(spark, error):
    rnd = random.Random(3)
    values = [round(math.exp(rnd.gauss(0, 3)), 6) for _ in range(3000)] + [0.0] * 40 + [1.0] * 40
    rows = [("2024-01-01 00:00:01", "/v1/jobs", 200, f"{v:.6f}") for v in values]
    values = sorted(float(f"{v:.6f}") for v in values)
    qs = {"q0": 0.0, "q01": 0.01, "p50": 0.5, "p95": 0.95, "q1": 1.0}
    got = lg.sketch_quantiles(lg.latency_sketch(_parsed(spark, rows), error=error), ["route"], qs, error).first()
    assert got["n"] == len(values) and got["max_seconds"] == values[-1]
    for name, q in qs.items():
        want = values[max(1, math.ceil(q * len(values))) - 1]
        assert abs(got[name] - want) <= error * want + 1e-12, name


def test_parts_merge_to_the_whole(spark):
    rnd = random.Random(5)
    rows = [(f"2024-01-01 {rnd.randrange(24):02d}:00:00", "/v1/jobs/" + str(i), rnd.choice([200, 500]),
             f"{rnd.random() * 9:.3f}") for i in range(400)]
    whole = lg.latency_sketch(_parsed(spark, rows), "1 day")
    parts = lg.latency_sketch(_parsed(spark, rows[:150])).unionByName(lg.latency_sketch(_parsed(spark, rows[150:])))
    a = lg.sketch_quantiles(whole, ["route", "method"]).collect()
    assert a == lg.sketch_quantiles(parts, ["route", "method"]).collect()
    assert [r["route"] for r in a] == ["/v1/jobs/{job_id}"] and a[0]["n"] == 400


def test_odd_times_and_empty_logs(spark):
    rows = [("2024-13-45 99:00:00", "/v1/jobs", 200, "1.0"), ("2024-01-01 00:00:00", "/v1/jobs", 500, "0.0")]
    got = lg.sketch_quantiles(lg.latency_sketch(_parsed(spark, rows)), ["window_start"]).collect()
    assert [(r["n"], r["n_errors"], r["p50"], r["p99"]) for r in got] == [(1, 1, 0.0, 0.0)]
    assert lg.sketch_quantiles(lg.latency_sketch(_parsed(spark, rows).limit(0)), ["window_start"]).count() == 0
    with pytest.raises(ValueError):
        lg.latency_sketch(_parsed(spark, rows), error=1.0)


def _stream(spark, batches):
    inp, out, ck = (scratch_path(spark, n) for n in ("lat-in", "lat-out", "lat-ck"))
    for rows in batches:
        (spark.createDataFrame([(LINE.format(*r),) for r in rows], "line string").coalesce(1)
         .write.mode("append").text(inp))
        latency_stream(spark, inp, out, ck).awaitTermination()  # restarts from its checkpoint
    return read_sketches(spark, out)


def test_stream_drops_only_lines_of_written_windows(spark):
    first = [("2024-01-01 00:10:00", "/v1/jobs", 200, "1.0"), ("2024-01-01 00:20:00", "/v1/jobs", 200, "2.0")]
    second = [("2024-01-01 02:30:00", "/v1/jobs", 200, "3.0"), ("2024-01-01 00:30:00", "/v1/jobs", 500, "4.0")]
    late = [("2024-01-01 00:40:00", "/v1/jobs", 200, "9.0"), ("2024-01-01 02:20:00", "/v1/jobs", 200, "5.0"),
            ("2024-01-01 03:10:00", "/v1/jobs", 200, "6.0")]
    got = (_stream(spark, [first, second, late]).groupBy("window_start")
           .agg(F.sum("n").alias("n"), F.max("max_seconds").alias("m")).orderBy("window_start").collect())
    assert [(r["window_start"].hour, r["n"], r["m"]) for r in got] == [(0, 3, 4.0), (2, 2, 5.0)]
