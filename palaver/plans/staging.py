"""Tables written once and read by every consumer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Consumers then agree on row order and partition numbers, nothing upstream
    runs twice, and a lost executor costs only the tasks that read from it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row.

    The optimizer copies a projected expression into every place that uses it,
    filters above all, so that a parsed document would be parsed dozens of times.
    A generator of one row is not copied.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
