"""Every registered query beside its SQL, and what every plan must not contain."""

import pytest

import __spark_entry__ as entry
import sqlcheck as check
from vendorlens.verify.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, key):
    ok, message = check.compare(spark, con, sf, key)
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith(("src_", "sink_", "stream_"))))
def test_plan_has_no_pair_join_and_no_python(spark, sf, key):
    plan = QUERIES[key](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in plan, word
