"""Admission as a stream: new submission files are admitted as they arrive.

Stateless: each micro-batch runs the batch admission plan (U1-U6) joined to
the static probe table, and appends to a parquet sink. The checkpoint makes
a restarted query resume without admitting a file twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.operators.admission import admit
from palaver.sources.readers import split_submissions

SUBMISSION_ROW = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("priority", T.StringType()),
])


def admission_stream(spark: SparkSession, submissions_dir: str, probe: DataFrame, now: Column,
                     out_dir: str, checkpoint_dir: str, schema: T.StructType = SUBMISSION_ROW,
                     max_files_per_trigger: int = 100, available_now: bool = True):
    """Start the stream; returns the StreamingQuery (``availableNow`` by default)."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .json(submissions_dir))
    admitted = admit(src, probe, now)
    w = (admitted.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def submission_key(requests: DataFrame) -> DataFrame:
    """Adds ``submission``, the batch and position of a URL as one key (``<request_id>/<pos>``)."""
    return requests.withColumn("submission", F.concat_ws("/", "request_id", "pos"))


def admission_lanes_stream(spark: SparkSession, requests_dir: str, probe: DataFrame, now: Column, admitted_dir: str,
                           rejected_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 100,
                           available_now: bool = True):
    """W1 over nested batch requests (JSON lines): one job per URL, and bad records apart.

    ``probe`` has one row per ``submission``. Both lanes of a micro-batch go to folders
    of its id, written over when the batch is tried again, so a restart leaves no
    request twice and loses none. Returns the StreamingQuery.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read once for both lanes
        accepted, rejected = split_submissions(batch)
        jobs = admit(submission_key(accepted), probe, now, key="submission")
        jobs.write.mode("overwrite").parquet(f"{admitted_dir}/batch_id={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_dir}/batch_id={batch_id}")
        batch.unpersist()

    w = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(requests_dir)
         .withColumnRenamed("value", "line")
         .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
