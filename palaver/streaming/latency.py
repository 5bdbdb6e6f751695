"""L2 as a stream: latency sketches of log files as they arrive.

State is one row per open window, route, method and bucket. A window is written
once the watermark has passed its end; lines of windows already written are late
and dropped. What is written are sketch rows, so windows, days and streams merge
with ``merge_sketches`` and are read with ``sketch_quantiles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.operators.logs import latency_sketch, parse_request_log, timed


def latency_stream(spark: SparkSession, log_dir: str, out_dir: str, checkpoint_dir: str, window: str = "60 minutes",
                   delay: str = "10 minutes", error: float = 0.01, max_files_per_trigger: int = 100,
                   available_now: bool = True):
    """Start the stream over text files of request lines; returns the StreamingQuery."""
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(log_dir)
             .withColumnRenamed("value", "line"))
    parsed, _ = parse_request_log(lines)
    w = (latency_sketch(timed(parsed).withWatermark("event_time", delay), window, error)
         .writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


SKETCH_SCHEMA = ("window_start timestamp_ntz, window_end timestamp_ntz, route string, method string, bucket int, "
                 "n long, n_errors long, max_seconds double")


def read_sketches(spark: SparkSession, out_dir: str) -> DataFrame:
    """The sketch rows that the stream has written (none, if no window has closed)."""
    return spark.read.schema(SKETCH_SCHEMA).parquet(out_dir)
