"""The sweep (J9 + J10) on a schedule, with published snapshots.

Job-table files that land below ``snapshots_dir`` are swept in a
``foreachBatch``; a snapshot is the folder a file lies in, and as the sweep works
row by row, a snapshot may come in several batches. Each attempt at a batch
writes into a folder of its own; then one manifest entry per batch names that
folder, with the counters of each snapshot. Readers (``swept_jobs``,
``sweep_report``) go through the manifest, so they see a batch whole or not at
all. A batch that is tried again after its entry was written is skipped.

Run with ``availableNow`` once an hour from outside, or with
``processingTime='1 hour'``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver import schemas as S
from palaver.operators.jobs import sweep, sweep_stats
from palaver.plans.staging import stored

COUNTERS = ["initial_job_count", "final_job_count", "stale_completed_removed", "stale_failed_removed",
            "processing_timed_out"]
MANIFEST = ("batch_id long, folder string, swept_at timestamp_ntz, snapshots array<struct<snapshot: string, "
            + ", ".join(f"{c}: bigint" for c in COUNTERS) + ">>")


def published(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest: one row per published batch (empty before the first)."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(spark: SparkSession, batch: DataFrame, batch_id: int, out_dir: str, now: Column | None = None) -> None:
    """Sweep one batch (JOB rows with ``snapshot``) and publish it by one manifest entry."""
    if published(spark, out_dir).where(F.col("batch_id") == batch_id).limit(1).count():
        return
    t = now if now is not None else F.lit(spark.sql("SELECT localtimestamp() AS t").first()["t"]).cast("timestamp_ntz")
    folder = f"batch={batch_id}-{uuid.uuid4().hex}"
    sweep(batch, t).write.parquet(f"{out_dir}/jobs/{folder}")
    by_snapshot = stored(sweep_stats(batch, t, by=["snapshot"]), "sweep-stats")
    (by_snapshot.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]).withColumn("batch_id", F.lit(batch_id))
     .write.parquet(f"{out_dir}/stats/{folder}"))
    (by_snapshot.agg(F.array_sort(F.collect_list(F.struct("snapshot", *COUNTERS))).alias("snapshots"))
     .select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(folder).alias("folder"), t.alias("swept_at"), "snapshots")
     .coalesce(1).write.mode("append").parquet(f"{out_dir}/manifest"))


def swept_jobs(spark: SparkSession, out_dir: str, snapshot: str | None = None) -> DataFrame:
    """Rows of the published swept tables with their ``snapshot``; of one snapshot, if it is named."""
    entries = published(spark, out_dir)
    if snapshot is not None:
        entries = entries.where(F.exists("snapshots", lambda s: s["snapshot"] == snapshot))
    folders = [f"{out_dir}/jobs/{r['folder']}" for r in entries.select("folder").collect()]  # one per scheduled run
    schema = T.StructType([*S.JOB.fields, T.StructField("snapshot", T.StringType())])
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows if snapshot is None else rows.where(F.col("snapshot") == snapshot)


def sweep_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """Counters per published snapshot, over all batches it came in."""
    return (published(spark, out_dir).select(F.inline("snapshots")).groupBy("snapshot")
            .agg(*[F.sum(c).alias(c) for c in COUNTERS]))


def folder_of(path: Column) -> Column:
    """The last folder of a file's path.

    No pattern: one that looks for the end of the path is tried at every place of it, for every row.
    """
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def sweep_stream(spark: SparkSession, snapshots_dir: str, out_dir: str, checkpoint_dir: str,
                 now: Column | None = None, available_now: bool = True, files_per_batch: int | None = None):
    """Start the stream; ``now`` defaults to each batch's processing time."""
    reader = spark.readStream.schema(S.JOB).option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.parquet(snapshots_dir).select(*S.JOB.fieldNames(), folder_of(F.col("_metadata.file_path")).alias("snapshot"))

    def run(batch, batch_id: int):
        publish(batch.sparkSession, batch, batch_id, out_dir, now)

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 hour")
    return w.start()
