"""Sinks (S4, S5): job report as JSON, durable tables as partitioned parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_datetime_text(ts: Column) -> Column:
    """``str(datetime)``: seconds, plus six fraction digits only when non-zero."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    frac = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    micros = F.unix_micros(F.to_timestamp(ts)) % 1000000
    return F.when(ts.isNull(), F.lit(None)).when(micros == 0, whole).otherwise(frac)


def jobs_report(jobs: DataFrame) -> DataFrame:
    """S4 rows: every column, timestamps as text."""
    return jobs.select(*[python_datetime_text(F.col(f.name)).alias(f.name)
                         if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
                         for f in jobs.schema.fields])


def export_jobs_report(jobs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with null fields kept; one file per partition, written in parallel."""
    jobs_report(jobs).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Durable parquet; ``partitionBy('status')`` lets status filters prune files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table back; pass its schema so partition columns keep their types
    (discovery reads ``is_safe=true`` folders as strings)."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path)


def write_job_table(jobs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Job table by status (sweeps and status lists read only their partitions)."""
    write_table(jobs, path, ["status"], mode)


def write_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summary records (nested topics, speakers, key points) by conversation type."""
    write_table(summaries, path, ["conversation_type"], mode)


def write_verdicts(verdicts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Verdicts by safety, so rejected texts are read without the safe ones."""
    write_table(verdicts, path, ["is_safe"], mode)
