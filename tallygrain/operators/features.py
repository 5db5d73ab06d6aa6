"""Point-in-time customer features and churn labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.exprs import mean, ratio, tally, total
from tallygrain.operators.scope import iso_date
from tallygrain.schemas import PLANS, Tables

# Names of the features and of the label.
CATEGORICAL_FEATURES = ("region", "industry", "company_size", "acquisition_channel", "primary_plan")
NUMERIC_FEATURES = (
    "customer_tenure_days",
    "active_subscription_count",
    "monthly_contract_value",
    "total_seats",
    "historical_renewals",
    "days_to_renewal",
    "historical_net_revenue",
    "trailing_net_revenue",
    "average_historical_revenue",
    "historical_discount_rate",
    "sales_observation_count",
    "total_support_tickets",
    "trailing_support_tickets",
    "average_resolution_hours",
    "average_satisfaction",
    "satisfaction_response_rate",
    "has_support_history",
    "is_enterprise",
)
LABEL = "churned_in_horizon"

# The only features where no history means zero; the others stay null for the model to impute.
ZERO_WITHOUT_HISTORY = (
    "historical_net_revenue",
    "trailing_net_revenue",
    "sales_observation_count",
    "total_support_tickets",
    "trailing_support_tickets",
    "has_support_history",
)


@dataclass(frozen=True)
class SnapshotConfig:
    """When features are known, and until when a cancellation counts."""

    snapshot: date | str = "2024-03-31"
    horizon: date | str = "2024-12-31"
    trailing_days: int = 180
    plan_priority: Sequence[str] = PLANS

    def __post_init__(self) -> None:
        object.__setattr__(self, "snapshot", iso_date(self.snapshot))
        object.__setattr__(self, "horizon", iso_date(self.horizon))
        if self.snapshot >= self.horizon:
            raise ValueError("snapshot must be before horizon")
        if self.trailing_days < 1:
            raise ValueError("trailing_days must be positive")

    @property
    def trailing_start(self) -> date:
        return self.snapshot - timedelta(days=self.trailing_days)


def active_at(subscriptions: DataFrame, day: date) -> DataFrame:
    """Started by the day and not ended by it. An end on the day itself is out."""
    return subscriptions.filter(
        (F.col("start_date") <= F.lit(day)) & (F.col("end_date").isNull() | (F.col("end_date") > F.lit(day)))
    )


def _priority(plan: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in order]), F.col(plan))


def subscription_features(subscriptions: DataFrame, config: SnapshotConfig) -> DataFrame:
    """Contract state per customer at the snapshot, with the label of the horizon."""
    age = F.greatest(F.datediff(F.lit(config.snapshot), "start_date"), F.lit(0))
    cancelled = (F.col("subscription_status") == "cancelled") & (F.col("end_date") <= F.lit(config.horizon))
    return (
        active_at(subscriptions, config.snapshot)
        .withColumn("_age", age)
        .groupBy("customer_id")
        .agg(
            F.count("subscription_id").alias("active_subscription_count"),
            F.max_by("plan_type", _priority("plan_type", config.plan_priority)).alias("primary_plan"),
            total("monthly_price").alias("monthly_contract_value"),
            F.sum("seats").alias("total_seats"),
            F.sum(F.floor(F.col("_age") / 365)).alias("historical_renewals"),
            F.min(365 - F.col("_age") % 365).alias("days_to_renewal"),
            F.max((F.col("plan_type") == config.plan_priority[-1]).cast("int")).alias("is_enterprise"),
            F.max(F.coalesce(cancelled, F.lit(False)).cast("int")).alias(LABEL),
        )
    )


def sales_features(sales: DataFrame, config: SnapshotConfig) -> DataFrame:
    """Revenue known at the snapshot."""
    trailing = F.col("sale_date") >= F.lit(config.trailing_start)
    return (
        sales.filter(F.col("sale_date") <= F.lit(config.snapshot))
        .groupBy("customer_id")
        .agg(
            total("net_revenue").alias("historical_net_revenue"),
            F.coalesce(total(F.when(trailing, F.col("net_revenue"))), F.lit(0.0)).alias("trailing_net_revenue"),
            mean("net_revenue").alias("average_historical_revenue"),
            F.count("sale_id").alias("sales_observation_count"),
            ratio(F.sum("discount_amount"), F.sum("gross_revenue")).alias("historical_discount_rate"),
        )
    )


def ticket_features(tickets: DataFrame, config: SnapshotConfig) -> DataFrame:
    """Support history known at the snapshot."""
    return (
        tickets.filter(F.col("created_date") <= F.lit(config.snapshot))
        .groupBy("customer_id")
        .agg(
            F.count("ticket_id").alias("total_support_tickets"),
            tally(F.col("created_date") >= F.lit(config.trailing_start)).alias("trailing_support_tickets"),
            mean("resolution_hours").alias("average_resolution_hours"),
            mean("satisfaction_score").alias("average_satisfaction"),
            ratio(F.count("satisfaction_score"), F.count("ticket_id")).alias("satisfaction_response_rate"),
            F.lit(1).alias("has_support_history"),
        )
    )


def churn_snapshot(tables: Tables, config: SnapshotConfig | None = None) -> DataFrame:
    """One row per customer with an active subscription: id, features, label, ordered by id.

    Every input is grouped to one row per customer before it is joined.
    """
    config = config or SnapshotConfig()
    return (
        tables.customers.withColumn("customer_tenure_days", F.datediff(F.lit(config.snapshot), "signup_date"))
        .join(subscription_features(tables.subscriptions, config), "customer_id")
        .join(sales_features(tables.sales, config), "customer_id", "left")
        .join(ticket_features(tables.support_tickets, config), "customer_id", "left")
        .na.fill(0, list(ZERO_WITHOUT_HISTORY))
        .select("customer_id", *CATEGORICAL_FEATURES, *NUMERIC_FEATURES, LABEL)
        .orderBy("customer_id")
    )
