"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import contracts, features
from tallygrain.operators.features import SnapshotConfig
from tallygrain.plans.base import Registry
from tallygrain.sources import roles

FEATURES = Registry()

SHIFT = 300  # months from 2024-01 back to 1999-01
CONFIG = SnapshotConfig("1999-03-31", "1999-12-31", 180)
SNAPSHOT_ROLES = ["customers", "subscriptions", "sales", f"support_tickets-{SHIFT}"]

ACTIVE = "start_date <= DATE '1999-03-31' AND (end_date IS NULL OR end_date > DATE '1999-03-31')"
SUBSCRIPTION_SQL = f"""
SELECT customer_id, count(*) AS active_subscription_count,
  arg_max(plan_type, CASE plan_type WHEN 'Basic' THEN 1 WHEN 'Professional' THEN 2 ELSE 3 END) AS primary_plan,
  CAST(sum(monthly_price) AS DOUBLE) AS monthly_contract_value, CAST(sum(seats) AS BIGINT) AS total_seats,
  CAST(sum(age // 365) AS BIGINT) AS historical_renewals, CAST(min(365 - age % 365) AS INTEGER) AS days_to_renewal,
  max(CASE WHEN plan_type = 'Enterprise' THEN 1 ELSE 0 END) AS is_enterprise,
  max(CASE WHEN subscription_status = 'cancelled' AND end_date <= DATE '1999-12-31' THEN 1 ELSE 0 END)
    AS churned_in_horizon
FROM (SELECT *, greatest(date_diff('day', start_date, DATE '1999-03-31'), 0) AS age FROM subscriptions WHERE {ACTIVE})
GROUP BY customer_id"""
SALES_SQL = """
SELECT customer_id, CAST(sum(net_revenue) AS DOUBLE) AS historical_net_revenue,
  coalesce(CAST(sum(CASE WHEN sale_date >= DATE '1999-03-31' - 180 THEN net_revenue END) AS DOUBLE), 0.0)
    AS trailing_net_revenue,
  CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS average_historical_revenue,
  count(*) AS sales_observation_count,
  CAST(sum(discount_amount) AS DOUBLE) / nullif(CAST(sum(gross_revenue) AS DOUBLE), 0) AS historical_discount_rate
FROM sales WHERE sale_date <= DATE '1999-03-31' GROUP BY customer_id"""
TICKET_SQL = """
SELECT customer_id, count(*) AS total_support_tickets,
  count(*) FILTER (WHERE created_date >= DATE '1999-03-31' - 180) AS trailing_support_tickets,
  CAST(sum(resolution_hours) AS DOUBLE) / nullif(count(resolution_hours), 0) AS average_resolution_hours,
  CAST(sum(satisfaction_score) AS DOUBLE) / nullif(count(satisfaction_score), 0) AS average_satisfaction,
  CAST(count(satisfaction_score) AS DOUBLE) / count(*) AS satisfaction_response_rate, 1 AS has_support_history
FROM support_tickets WHERE created_date <= DATE '1999-03-31' GROUP BY customer_id"""
SNAPSHOT_SQL = f"""
SELECT customer_id, region, industry, company_size, acquisition_channel, primary_plan,
  CAST(date_diff('day', signup_date, DATE '1999-03-31') AS INTEGER) AS customer_tenure_days,
  active_subscription_count, monthly_contract_value, total_seats, historical_renewals, days_to_renewal,
  coalesce(historical_net_revenue, 0.0) AS historical_net_revenue,
  coalesce(trailing_net_revenue, 0.0) AS trailing_net_revenue, average_historical_revenue, historical_discount_rate,
  coalesce(sales_observation_count, 0) AS sales_observation_count,
  coalesce(total_support_tickets, 0) AS total_support_tickets,
  coalesce(trailing_support_tickets, 0) AS trailing_support_tickets, average_resolution_hours, average_satisfaction,
  satisfaction_response_rate, coalesce(has_support_history, 0) AS has_support_history, is_enterprise,
  churned_in_horizon
FROM customers JOIN ({SUBSCRIPTION_SQL}) USING (customer_id)
LEFT JOIN ({SALES_SQL}) USING (customer_id) LEFT JOIN ({TICKET_SQL}) USING (customer_id)"""


def snapshot(spark, folder):
    return features.churn_snapshot(roles.business_tables(spark, folder, ticket_months_back=SHIFT), CONFIG)


@FEATURES.add("active_at_snapshot", f"SELECT subscription_id, customer_id FROM subscriptions WHERE {ACTIVE}", ["subscriptions"])
def active_at_snapshot(spark, folder):
    return features.active_at(roles.subscriptions(spark, folder), CONFIG.snapshot).select(
        "subscription_id", "customer_id"
    )


@FEATURES.add("subscription_features", SUBSCRIPTION_SQL, ["subscriptions"])
def subscription_features(spark, folder):
    return features.subscription_features(roles.subscriptions(spark, folder), CONFIG)


@FEATURES.add("sales_features", SALES_SQL, ["sales"])
def sales_features(spark, folder):
    return features.sales_features(roles.sales(spark, folder), CONFIG)


@FEATURES.add("ticket_features", TICKET_SQL, [f"support_tickets-{SHIFT}"])
def ticket_features(spark, folder):
    return features.ticket_features(roles.support_tickets(spark, folder, months_back=SHIFT), CONFIG)


@FEATURES.add("churn_snapshot", SNAPSHOT_SQL, SNAPSHOT_ROLES)
def churn_snapshot(spark, folder):
    return snapshot(spark, folder)


@FEATURES.add(
    "snapshot_identity",
    f"""SELECT count(*) AS rows, count(DISTINCT customer_id) AS distinct_keys,
      count(*) - count(DISTINCT customer_id) AS repeated_rows, count(DISTINCT churned_in_horizon) AS label_classes
    FROM ({SNAPSHOT_SQL})""",
    SNAPSHOT_ROLES,
)
def snapshot_identity(spark, folder):
    return contracts.identity_audit(snapshot(spark, folder), "customer_id", features.LABEL)
