"""Registered queries against the DuckDB oracle at sf0.001, and plan shape checks."""

import duckdb
import pytest

import __spark_entry__ as E
from callscope.plans import registry
from callscope.session import TABLES
from conftest import SMALL

SAMPLE = [
    "c1_validate_calls", "c2_call_status_wide", "c3_first_error", "c13_violation_report_wide",
    "c14_conformance", "b3_merged_param_dictionary", "e2_masked_argmax", "g1_accuracy_report",
    "f2_prefix_table", "a3_definition_rejects", "d2_extractor_prompts", "d3_attach_examples", "e8_over_budget",
    "c4_call_fields", "c7_duplicate_keys_wide",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows),
                  key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _norm(df.columns, df.collect()) == _norm(rel.columns, rel.fetchall())


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLE) <= set(E.oracle_sql())


def test_over_budget_scans_and_shuffles_once(spark):
    df = E.queries()["e8_over_budget"](spark, SMALL)
    plan = _plan(df)
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 5 and sum(r["n"] for r in rows) == 1000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c2_call_status", "c14_conformance", "c13_violation_report", "e2_masked_argmax"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_calls_scan_prunes_columns(spark):
    df = E.queries()["c2_call_status_bench"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


@pytest.mark.parametrize("name", ["c14_conformance", "c13_violation_report", "e2_masked_argmax", "c9_param_type_profile_wide"])
def test_reports_aggregate_before_the_shuffle(spark, name):
    """A hot group is pre-reduced map-side: a partial aggregate precedes every exchange of the report."""
    df = E.queries()[name](spark, SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan
