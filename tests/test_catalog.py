"""Every registered query on the smallest tables: its plan, and its rows against the oracle."""

import pytest

import __spark_entry__ as contract
from wirelake.catalog import all_entries
from tests.oracle_check import compare, connect

WRITES = ("stream_", "table_", "summary_export", "audit_report_json")
ENTRIES = all_entries()
QUERIES = {name: e.run for name, e in ENTRIES.items()}
ORACLES = {name: e.sql for name, e in ENTRIES.items() if e.sql is not None}


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    if not name.startswith(WRITES):  # those read back what they wrote
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "LocalTableScan") if x in text]
        assert "InPandas" not in text and ("InArrow" in text) == (name == "flow_periodic_patterns")
    ok, message, _, _ = compare(spark, con, small_dir, lambda *_: df, ORACLES.get(name))
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_contract_holds_the_catalog():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and {"window_start", "source_ip", "packet_count"} <= set(df.columns)
