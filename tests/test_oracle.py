"""Registered queries against DuckDB on the same parquet files.

A spread over the families runs by default; ``ORACLE_ALL=1`` runs every query that has SQL.
"""

import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from tools.check_oracle import key, loose, plain  # noqa: E402

CHOSEN = [
    "revenue_by_region", "support_summary_region", "monthly_churn_trend", "compare_periods", "validate",
    "numerical_summary_sales", "correlations_spearman", "mann_whitney_test_lines", "churn_snapshot", "backtest_by_region",
    "cost_status", "ranking_quality_by_lang", "chunk_documents", "search_many", "reference_problems",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("ORACLE_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, small, duck, name):
    frame = contract.queries()[name](spark, small)
    columns = sorted(frame.columns)
    got = [plain(tuple(r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [plain(tuple(r[i] for i in order)) for r in result.fetchall()]
    assert sorted(map(loose, got), key=key) == sorted(map(loose, expected), key=key)


def test_entry_has_rows(spark, small):
    assert contract.entry(spark).count() == 5
