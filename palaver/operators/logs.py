"""Request log (L1, L2): parse the service's request lines, stats and latency quantiles per route."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: layout of a request line ("<time> - <logger> - <level> - <file:func:line> -
# Path: <p> Method: <m> Status: <s> Duration: <d>s").
LINE_PATTERN = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (\S+) - (\S+) - (\S+) - "
                r"Path: (\S+) Method: (\S+) Status: (\d+) Duration: ([0-9]+[.][0-9]+)s$")
ID_SEGMENT = r"^/v1/(jobs|summarize)/[^/]+$"


def parse_request_log(lines: DataFrame, line_col: str = "line"):
    """L1: (parsed, rejected) frames; unmatched lines go to ``rejected``."""
    line = F.col(line_col)
    ok = line.rlike(LINE_PATTERN)

    def part(i):
        return F.regexp_extract(line, LINE_PATTERN, i)
    parsed = lines.where(ok).select(
        part(1).alias("logged_at"), part(5).alias("path"), part(6).alias("method"),
        part(7).cast("int").alias("status"), part(8).cast("double").alias("seconds"))
    rejected = lines.where(~ok | line.isNull()).select(line.alias("line"))
    return parsed, rejected


def route(path: Column) -> Column:
    """The route of a request path: job ids in it become ``{job_id}``."""
    return F.regexp_replace(path, ID_SEGMENT, "/v1/$1/{job_id}")


def request_stats(parsed: DataFrame) -> DataFrame:
    """L2: count, errors (status 500 and above), mean and max seconds per route."""
    return (parsed.withColumn("route", route(F.col("path")))
            .groupBy("route", "method")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("status") >= 500).alias("n_errors"),
                 F.avg("seconds").alias("mean_seconds"),
                 F.max("seconds").alias("max_seconds")))


def _gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def timed(parsed: DataFrame) -> DataFrame:
    """Parsed lines with ``event_time``, their time read as UTC whatever the session's zone
    (watermarks take instants only); a time that no calendar has is null."""
    return parsed.withColumn("event_time", F.concat("logged_at", F.lit("Z")).try_cast("timestamp"))


def _clock(instant: Column) -> Column:
    """The wall clock of an instant in UTC, as the log shows it."""
    return F.timestamp_add("SECOND", F.unix_seconds(instant), F.lit("1970-01-01").cast("timestamp_ntz"))


def latency_sketch(lines: DataFrame, window: str = "60 minutes", error: float = 0.01) -> DataFrame:
    """L2: one row per tumbling window, route, method and latency bucket.

    Bucket b holds seconds in (g^(b-1), g^b] for g = (1 + error) / (1 - error), and a
    null bucket holds zero seconds. Rows of equal keys add up, so sketches of any parts
    of a log merge exactly, and a route has at most some thousand buckets whatever its
    traffic. ``lines`` are the rows of ``timed``, a batch or a stream with a watermark;
    rows without an event time belong to no window.
    """
    seconds = F.col("seconds")
    bucket = F.when(seconds > 0, F.ceil(F.log(seconds) / F.lit(math.log(_gamma(error)))).cast("int"))
    return (lines.groupBy(F.window("event_time", window).alias("w"), route(F.col("path")).alias("route"), "method",
                          bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("n_errors"),
                 F.max("seconds").alias("max_seconds"))
            .select(_clock(F.col("w.start")).alias("window_start"), _clock(F.col("w.end")).alias("window_end"), "route", "method",
                    "bucket", "n", "n_errors", "max_seconds"))


def merge_sketches(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketch rows added up to coarser keys ``by`` (columns of the sketch, or made from them)."""
    return sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors"),
                                             F.max("max_seconds").alias("max_seconds"))


def sketch_quantiles(sketch: DataFrame, by: list[str], quantiles: dict[str, float] | None = None,
                     error: float = 0.01) -> DataFrame:
    """Counts, errors, maximum and quantiles per ``by`` of a sketch (or of several, united).

    A quantile q is the value of rank ceil(q * n), off by at most the share ``error``
    of itself (the error that the sketch was made with). The running count orders a
    key's buckets only, never its requests.
    """
    quantiles = {"p50": 0.5, "p95": 0.95, "p99": 0.99} if quantiles is None else quantiles
    g = _gamma(error)
    key = Window.partitionBy(*by)
    upto = key.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (merge_sketches(sketch, by)
              .withColumn("__upto", F.sum("n").over(upto)).withColumn("__all", F.sum("n").over(key)))
    value = F.coalesce(F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1), F.lit(0.0))

    def at(q: float) -> Column:
        rank = F.greatest(F.ceil(F.lit(q) * F.col("__all")), F.lit(1))
        # the first bucket that reaches the rank has the smallest value of those that do
        return F.min(F.when(F.col("__upto") >= rank, value))
    return ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors"), F.max("max_seconds").alias("max_seconds"),
        *[at(q).alias(name) for name, q in quantiles.items()])
