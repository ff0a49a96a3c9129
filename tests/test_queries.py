"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql
from registry.spark_queries import QUERIES
from sessiongrid.operators.dataset import add_date_splits, make_model_dataset
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    result = QUERIES[name](spark, SF_DIR)
    assert differences(result, connection.execute(oracle_sql()[name])) is None


@pytest.mark.parametrize("name", ["prepare_panel_full", "model_table", "trades", "portfolio_metrics"])
def test_plans_have_no_product_of_tables(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Python never touches rows.
    assert not re.search(r"Python|Pandas|ArrowEval", plan)


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["session_calendar"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert scans and all("l_extendedprice" not in scan and "l_shipdate" in scan for scan in scans)


def test_the_panel_is_evaluated_once(spark, tmp_path):
    """With a scratch table, rows, ranks and purged dates do not build the panel again."""
    panel = QUERIES["prepare_panel_full"](spark, SF_DIR)
    path = str(tmp_path / "panel")
    panel.write.parquet(path)
    kept = make_model_dataset(spark.read.parquet(path), labeled_only=False, scratch=str(tmp_path / "kept"))
    plan = add_date_splits(kept, validate=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Explode" not in plan and "lag(" not in plan


def test_every_branch_of_the_evaluation_is_reached(connection):
    """The rows that the SQL gives hold each status, issue and reason, and short days."""
    sql = oracle_sql()
    medium = duck("/root/testdata/sf0.01")
    values = lambda name, column: {r[0] for r in medium.execute(f"SELECT DISTINCT {column} FROM ({sql[name]})").fetchall()}
    assert values("trades", "status") == {"filled", "cash_no_open", "unresolved"}
    assert values("submission_issues", "issue") == {"missing", "extra", "duplicate", "not_finite"}
    assert values("daily_spearman", "undefined") == {None, "constant", "no_known_target"}
    assert None in values("daily_returns", "net") and None in values("results_csv", "sharpe")
    assert min(values("top10_selection", 'count(*) OVER (PARTITION BY "Date")')) < 10
    assert values("sorted_export", "in_order") == {True}
