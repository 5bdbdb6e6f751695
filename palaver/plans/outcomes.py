"""(ok, rejected) frames from an operator's single outcome frame.

Operators that can reject a row return every row with ``ok`` plus
``error_class`` and ``message`` (null when ok). ``split`` gives the two
frames of the build plan: passing rows without the error columns, and
rejected rows with the shared columns ``id, error_class, message``. Both are
filters of the same plan; write the outcome frame once (``write_table``)
before splitting when it is expensive, so it is not computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_COLS = ["error_class", "message"]


def split(outcomes: DataFrame, id_col: str, ok_col: str = "ok") -> tuple[DataFrame, DataFrame]:
    ok = outcomes.where(F.col(ok_col)).drop(ok_col, *[c for c in ERROR_COLS if c in outcomes.columns])
    rejected = outcomes.where(~F.col(ok_col)).select(F.col(id_col).alias("id"), *ERROR_COLS)
    return ok, rejected
