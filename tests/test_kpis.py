from datetime import date

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import kpis, scope as sc
from tallygrain.operators.scope import Scope
from tests.frames import valid_tables


@pytest.fixture(scope="module")
def tables(spark):
    return valid_tables(spark)


YEAR = Scope("2024-01-01", "2024-12-31")
Q1, Q2 = Scope("2024-01-01", "2024-03-31"), Scope("2024-04-01", "2024-06-30")


def test_scope_is_checked():
    with pytest.raises(ValueError):
        Scope("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        Scope("2024-02-01", "2024-03-01", region="Mars", known_regions=("Europe",))
    with pytest.raises(ValueError):
        Scope("2024-02-01", "2024-03-01", plan_type="Gold")
    with pytest.raises(ValueError):
        Scope("not a date", "2024-03-01")


def test_revenue_and_empty_revenue(tables):
    row = kpis.revenue_summary(tables.sales, YEAR).first()
    assert (row.gross_revenue, row.net_revenue, row.revenue_customers, row.sales_observations) == (1400.0, 1289.0, 3, 5)
    assert row.discount_rate == pytest.approx(111 / 1400)
    empty = kpis.revenue_summary(tables.sales, Scope("2030-01-01", "2030-01-02")).first()
    assert empty.gross_revenue == 0.0 and empty.discount_rate is None and empty.average_revenue_per_customer is None


def test_cost_metrics_refuse_plans(tables):
    basic = Scope("2024-01-01", "2024-12-31", plan_type="Basic")
    for call in (
        lambda: kpis.cost_summary(tables.cloud_costs, basic),
        lambda: kpis.contribution_summary(tables.sales, tables.cloud_costs, basic),
        lambda: kpis.monthly_cost_trend(tables.cloud_costs, basic),
        lambda: kpis.support_summary(tables.support_tickets, tables.customers, basic),
        lambda: sc.check_cost_scope(industries=["Retail"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_subscription_summary(tables):
    row = kpis.subscription_summary(tables.subscriptions, tables.customers, Q1).first()
    assert (row.subscriptions_at_risk, row.cancellations, row.renewals_due, row.renewals_retained) == (4, 1, 3, 3)
    assert row.currently_active_subscriptions == 3 and row.churn_rate == 0.25
    nobody = kpis.subscription_summary(
        tables.subscriptions, tables.customers, Scope("2024-01-01", "2024-03-31", region="Mars")
    ).first()
    assert nobody.subscriptions_at_risk is None and nobody.churn_rate is None


def test_support_counts_an_event_once(tables):
    row = kpis.support_summary(tables.support_tickets, tables.customers, YEAR).first()
    assert (row.ticket_count, row.customers_with_tickets, row.open_tickets) == (4, 3, 1)
    assert row.average_resolution_hours == pytest.approx((5 + 20 + 8 + 1) / 4)
    europe = kpis.support_summary(
        tables.support_tickets, tables.customers, Scope("2024-01-01", "2024-12-31", region="Europe")
    ).first()
    assert europe.ticket_count == 3


def test_monthly_growth_skips_absent_months(tables):
    rows = kpis.monthly_revenue(tables.sales).collect()
    assert [str(r.month) for r in rows] == ["2024-01-01", "2024-02-01", "2024-04-01"]
    assert rows[0].net_revenue_growth is None
    assert rows[2].net_revenue_growth == pytest.approx(189 / 810 - 1)


def brute_churn(rows):
    """Months by subscriptions, as the definition reads."""
    starts, ends = [r.start_date for r in rows if r.start_date], [r.end_date for r in rows if r.end_date]
    month, last = min(starts).replace(day=1), max(starts + ends).replace(day=1)
    out = {}
    while month <= last:
        following = date(month.year + month.month // 12, month.month % 12 + 1, 1)
        risk = sum(r.start_date < following and (r.end_date is None or r.end_date >= month) for r in rows)
        gone = sum(
            r.subscription_status == "cancelled" and r.end_date is not None and month <= r.end_date < following
            for r in rows
        )
        out[month] = (risk, gone)
        month = following
    return out


def test_churn_trend_matches_the_definition(spark, tables, small):
    from tallygrain.sources import roles

    for subscriptions in (tables.subscriptions, roles.subscriptions(spark, small)):
        got = {r.month: (r.subscriptions_at_risk, r.cancellations) for r in kpis.monthly_churn_trend(subscriptions).collect()}
        assert got == brute_churn(subscriptions.collect())


def test_churn_trend_has_empty_months_and_null_rates(spark):
    rows = [
        ("S1", date(2024, 1, 5), date(2024, 1, 20), "cancelled"),
        ("S2", date(2024, 4, 5), None, "active"),
        ("S3", date(2024, 4, 5), date(2024, 2, 1), "cancelled"),  # ends before it starts: never exposed
    ]
    frame = spark.createDataFrame(rows, "subscription_id string, start_date date, end_date date, subscription_status string")
    got = [(r.month.month, r.subscriptions_at_risk, r.cancellations, r.churn_rate) for r in kpis.monthly_churn_trend(frame).collect()]
    assert got == [(1, 1, 1, 1.0), (2, 0, 1, None), (3, 0, 0, None), (4, 1, 0, 0.0)]


def test_dimensions(tables):
    rows = {r.region: r for r in kpis.revenue_by_dimension(
        tables.sales, tables.subscriptions, tables.customers, Q1, "region").collect()}
    assert rows["APAC"].net_revenue is None and rows["APAC"].subscriptions_at_risk == 1
    assert rows["Europe"].churn_rate == 0.5
    plans = kpis.dimension_metrics(tables.sales, tables.subscriptions, tables.customers, "plan_type").collect()
    assert [r.plan_type for r in plans] == ["Enterprise", "Basic", "Professional"]
    with pytest.raises(ValueError):
        kpis.dimension_metrics(tables.sales, tables.subscriptions, tables.customers, "country")


def test_period_comparison(tables):
    rows = {r.metric: r for r in kpis.compare_periods(tables.sales, tables.cloud_costs, Q1, Q2).collect()}
    assert rows["net_revenue"].change == 189.0 - 1100.0
    assert rows["gpu_cost"].second_value == 0.0 and rows["gpu_cost"].growth == -1.0
    with pytest.raises(ValueError):
        kpis.compare_periods(tables.sales, tables.cloud_costs, Q1, Scope("2024-04-01", "2024-06-30", region="India"))


def test_business_metrics(tables):
    row = kpis.business_metrics(tables).first()
    assert row.net_revenue == 1289.0 and row.infrastructure_cost == 40.0 and row.customers == 4
    assert row.churn_rate == pytest.approx(1 / 5)
    assert row.renewal_rate == 1.0 and row.active_subscriptions == 3


def test_behavior_fills_only_what_means_zero(tables):
    rows = {r.customer_id: r for r in kpis.customer_behavior(tables.sales, tables.subscriptions, tables.support_tickets).collect()}
    assert rows["C4"].total_net_revenue == 0.0 and rows["C4"].ticket_count == 0
    assert rows["C4"].average_resolution_hours is None and rows["C2"].churned == 1


def test_view_and_metric_rows(tables):
    view = kpis.filtered_view(tables, "2024-01-01", "2024-12-31")
    head = view["headline"].first()
    assert head.net_revenue == 1289.0 and head.revenue_growth == pytest.approx(189 / 290 - 1)
    with pytest.raises(ValueError, match="no rows"):
        kpis.filtered_view(tables, "2030-01-01", "2030-12-31")
    with pytest.raises(ValueError, match="Unknown region"):
        kpis.filtered_view(tables, "2024-01-01", "2024-12-31", ["Mars"])
    rows = {r.metric: r.value for r in kpis.metric_rows(tables, "2024-01-01", "2024-12-31").collect()}
    assert rows["net_revenue"] == 1289.0 and rows["customer_count"] == 3.0 and set(rows) == set(kpis.UNITS)
    with pytest.raises(ValueError):
        kpis.metric_rows(tables, "2024-01-01", "2024-12-31", metrics=["mood"])


def test_scoping(spark, tables):
    ids = spark.createDataFrame([("C1",), ("C3",)], "customer_id string")
    scoped = sc.scope_tables(tables, ["Retail"], ids)
    assert scoped.customers.count() == 2 and scoped.sales.count() == 4 and scoped.cloud_costs.count() == 4
    with pytest.raises(ValueError, match="Unknown"):
        sc.scope_tables(tables, customer_ids=spark.createDataFrame([("C9",)], "customer_id string"))
    with pytest.raises(ValueError, match="No customer"):
        sc.scope_tables(tables, ["Space"])
    averages = kpis.scoped_ticket_averages(tables, "2024-01-01", "2024-12-31", ["Europe"], ["Professional"]).first()
    assert averages.average_resolution_hours == 14.0


def test_contingency_fills_missing_cells(tables):
    rows = {r.plan_type: (r.not_cancelled, r.cancelled) for r in kpis.plan_contingency(tables.subscriptions).collect()}
    assert rows == {"Basic": (2, 0), "Professional": (1, 1), "Enterprise": (1, 0)}


def test_a_hot_customer_reaches_the_join_once(spark, tables):
    """All facts of a customer are one row before an attribute is joined."""
    plan = kpis.subscription_summary(tables.subscriptions, tables.customers, Q1)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "Aggregate [customer_id" in plan[join:]
    assert plan.count("Join") == 1
    hot = tables.subscriptions.unionAll(
        spark.range(500).select(
            F.concat(F.lit("H"), F.col("id").cast("string")), F.lit("C1"), F.lit("Basic"),
            F.lit("2023-01-10").cast("date"), F.lit("2024-01-10").cast("date"), F.lit(None).cast("date"),
            F.lit(100).cast("decimal(14,2)"), F.lit(5), F.lit("active"),
        )
    )
    assert kpis.subscription_summary(hot, tables.customers, Q1).first().subscriptions_at_risk == 504
