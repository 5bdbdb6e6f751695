"""Every registered query that has a DuckDB statement against it (sf0.001)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import _rows, type_differences
from checks.queries import QUERIES as CORE
from tests.conftest import SF_SMALL

QUERIES = queries()
ORACLE = oracle_sql()


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["job_id", "speaker_id", "name", "speaking_time", "is_safe", "reject_reason"]


def test_every_core_query_has_an_oracle():
    assert set(CORE) <= set(QUERIES) and set(CORE) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols, srows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    assert sorted(cols) == sorted(rel.columns)
    assert type_differences(df.schema, rel.columns, rel.types) == {}
    assert _rows(cols, srows) == _rows(rel.columns, rel.fetchall())
