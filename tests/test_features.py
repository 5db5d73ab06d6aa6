import pytest
from pyspark.sql import functions as F

from tallygrain.operators import features
from tallygrain.operators.features import SnapshotConfig
from tests.frames import valid_tables

CONFIG = SnapshotConfig("2024-02-10", "2024-12-31", 30)


def test_config_is_checked():
    with pytest.raises(ValueError):
        SnapshotConfig("2024-02-10", "2024-02-10")
    with pytest.raises(ValueError):
        SnapshotConfig("2024-02-10", "2024-03-10", 0)


def test_snapshot_values(spark):
    rows = {r.customer_id: r for r in features.churn_snapshot(valid_tables(spark), CONFIG).collect()}
    assert set(rows) == {"C1", "C2", "C3", "C4"}
    assert [rows[c].churned_in_horizon for c in ("C1", "C2", "C3", "C4")] == [0, 1, 0, 0]
    c1 = rows["C1"]
    assert c1.historical_renewals == 1 and c1.days_to_renewal == 365 - 396 % 365
    assert c1.historical_net_revenue == 90.0 and c1.trailing_net_revenue == 0.0
    assert rows["C3"].trailing_net_revenue == 810.0 and rows["C3"].is_enterprise == 1
    assert rows["C3"].primary_plan == "Enterprise"
    c4 = rows["C4"]
    assert c4.historical_net_revenue == 0.0 and c4.has_support_history == 0
    assert c4.average_historical_revenue is None and c4.average_resolution_hours is None


def test_nothing_after_the_snapshot_leaks(spark):
    t = valid_tables(spark)
    later = t.with_tables(
        sales=t.sales.unionAll(t.sales.withColumn("sale_date", F.lit("2024-02-11").cast("date"))),
        support_tickets=t.support_tickets.unionAll(
            t.support_tickets.withColumn("created_date", F.lit("2024-02-11").cast("date"))
        ),
    )
    assert features.churn_snapshot(t, CONFIG).collect() == features.churn_snapshot(later, CONFIG).collect()
    names = features.churn_snapshot(t, CONFIG).columns
    assert not {"customer_status", "subscription_status", "end_date"} & set(names)


def test_ending_on_the_snapshot_day_is_out(spark):
    t = valid_tables(spark)
    ids = [r.subscription_id for r in features.active_at(t.subscriptions, __import__("datetime").date(2024, 3, 15)).collect()]
    assert "S2" not in ids and "S1" in ids
