"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallygrain.operators import cleaning, contracts, kpis
from tallygrain.operators.scope import Scope
from tallygrain.sources import roles

LIGHT = [
    "revenue_summary", "contribution_summary", "monthly_revenue", "revenue_by_region", "metrics_by_region",
    "compare_periods", "monthly_churn_trend", "contract_owners", "contract_relations", "churn_snapshot",
    "support_before_outcome", "ungrounded_numbers", "local_baseline", "categorical_summary",
]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_nested_loop_joins(spark, small, name):
    text = plan(contract.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_date_filter_and_pruning_reach_the_scan(spark, small):
    scope = Scope("1998-01-01", "1998-12-31")
    text = plan(kpis.monthly_revenue_trend(roles.sales(spark, small), scope))
    lineitem = next(line for line in text.splitlines() if "FileScan parquet" in line and "l_shipdate" in line)
    assert "l_tax" not in lineitem and "l_partkey" not in lineitem
    assert re.search(r"DataFilters: \[.*l_shipdate", lineitem)


def test_deduplication_sums_before_the_shuffle(spark, small):
    text = plan(cleaning.drop_duplicate_events(roles.support_tickets(spark, small), "ticket_id"))
    assert "Window" not in text and text.count("partial_min(ticket_id") == 1


def test_churn_trend_reads_the_facts_once_and_joins_only_months(spark, small):
    frame = kpis.monthly_churn_trend(roles.subscriptions(spark, small))
    text = plan(frame)
    assert "Generate inline" in text
    assert not re.search(r"Join.*start_date", text)


def test_top_values_are_limited_before_the_shuffle(spark, small):
    text = plan(contract.queries()["categorical_summary"](spark, small))
    assert "WindowGroupLimit" in text


def test_monthly_sums_need_no_owner_or_meet_it_summed(spark, small):
    text = plan(contract.queries()["monthly_net_revenue"](spark, small))
    assert "Join" not in text and "o_custkey" not in text
    text = plan(contract.queries()["monthly_net_revenue_by_region"](spark, small))
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "l_shipdate" in line)
    above = "\n".join(lines[:scan])
    # Going up from the line items, a sum comes before the first join.
    assert above.rfind("partial_sum") > above.rfind("Join")


def test_all_rules_of_a_table_come_from_one_scan(spark, small):
    tables = roles.business_tables(spark, small)
    summed, _ = contracts.fact_groups(tables.sales, "sales")
    text = plan(summed)
    assert len(re.findall(r"FileScan parquet .*l_linenumber", text)) == 1 and text.count("Expand") == 1
    # Keys and events are summed within each task before the second shuffle.
    assert text.count("partial_sum(n#") == 1
    assert "l_shipdate" not in plan(contracts.validate(tables))
    text = plan(contracts.fact_groups(tables.support_tickets, "support_tickets")[0])
    assert text.count("FileScan parquet") == 1


def test_skewed_join_is_split_at_run_time(spark):
    """A third of all rows share one key: the sort-merge join splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        facts = spark.range(60_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("v")
        )
        owners = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("region"))
        joined = facts.join(owners, "k").groupBy("region").agg(F.max("v"), F.count("*").alias("n"))
        assert sum(r.n for r in joined.collect()) == 60_000
        assert "skew=true" in plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_names_match_between_queries_and_sql():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 130
    assert contract.entry
