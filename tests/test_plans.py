"""Plan invariants that the scale work relies on (checked on final AQE plans)."""

import pytest

from __spark_entry__ import queries
from tests.conftest import SF_SMALL

QUERIES = queries()


def _final_plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def _indent(line):
    return len(line) - len(line.lstrip(" :+-"))


def _broadcast_subtrees(lines):
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            level, sub = _indent(line), []
            for nxt in lines[i + 1:]:
                if nxt.strip() and _indent(nxt) <= level:
                    break
                sub.append(nxt)
            yield sub


@pytest.mark.parametrize("name", ["m01_extractive_summary", "m03_key_points", "e07_summarize_offline",
                                  "m02_topics", "v03_rule_verdict"])
def test_exploded_text_is_never_broadcast(spark, name):
    """No explode of tokens or sentences feeds a broadcast directly (an aggregate
    behind a shuffle may, and so may an explode of the <= k picks per document)."""
    for sub in _broadcast_subtrees(_final_plan(spark, name)):
        direct = []
        for line in sub:
            if "Exchange" in line or "QueryStage" in line or "AQEShuffleRead" in line:
                break
            direct.append(line)
        text_explodes = [line for line in direct if "Generate" in line and "regexp_extract_all" in line]
        assert not text_explodes, "\n".join(direct)[:500]


@pytest.mark.parametrize("name", ["j04_fold_transitions", "m04_conversation_type", "e07_summarize_offline",
                                  "t03_allocate_speaking_time"])
def test_aggregates_are_hash_based(spark, name):
    assert not any("SortAggregate" in line for line in _final_plan(spark, name))
