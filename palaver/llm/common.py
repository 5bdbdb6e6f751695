"""Helpers shared by the training-data operators.

Every operator first selects the columns it needs under names of its own, so
extra columns of the caller never clash, and stores what it reads twice as a
written table below the session's checkpoint folder (never a local folder,
never ``localCheckpoint``), so a lost executor costs one stage and no state.
"""

from __future__ import annotations

import importlib.util
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import scratch_path

TOKENIZER_PACKAGE = "public_tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer file (never copied here)."""
    spec = importlib.util.find_spec(TOKENIZER_PACKAGE)
    return os.path.join(os.path.dirname(spec.origin), name)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def slices(n: int, step: int):
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)
