"""Table contracts: column types, keys, relations and allowed values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)


_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "money": MONEY,
    "hours": T.DecimalType(12, 2),
    "score": T.DecimalType(2, 1),
}


def _struct(spec: str) -> T.StructType:
    pairs = [item.split() for item in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The columns and types of the five business tables.
SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        "customer_id string, customer_name string, region string, country string, industry string, "
        "company_size string, acquisition_channel string, signup_date date, customer_status string"
    ),
    "subscriptions": _struct(
        "subscription_id string, customer_id string, plan_type string, start_date date, "
        "renewal_date date, end_date date, monthly_price money, seats int, "
        "subscription_status string"
    ),
    "sales": _struct(
        "sale_id string, customer_id string, subscription_id string, sale_date date, region string, "
        "plan_type string, gross_revenue money, discount_amount money, "
        "net_revenue money, sales_channel string"
    ),
    "cloud_costs": _struct(
        "cost_id string, date date, region string, service_type string, compute_cost money, "
        "storage_cost money, network_cost money, gpu_cost money, "
        "total_cost money"
    ),
    "support_tickets": _struct(
        "ticket_id string, customer_id string, created_date date, resolved_date date, "
        "ticket_category string, severity string, resolution_hours hours, "
        "satisfaction_score score, status string"
    ),
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "subscriptions": "subscription_id",
    "sales": "sale_id",
    "cloud_costs": "cost_id",
    "support_tickets": "ticket_id",
}

# Relation name -> (child table, child column, parent table, parent column).
FOREIGN_KEYS = {
    "subscriptions_customer": ("subscriptions", "customer_id", "customers", "customer_id"),
    "sales_customer": ("sales", "customer_id", "customers", "customer_id"),
    "sales_subscription": ("sales", "subscription_id", "subscriptions", "subscription_id"),
    "tickets_customer": ("support_tickets", "customer_id", "customers", "customer_id"),
}

PLANS = ("Basic", "Professional", "Enterprise")

# Members each category column may take.
ALLOWED_VALUES: dict[tuple[str, str], tuple[str, ...]] = {
    ("customers", "region"): ("India", "North America", "Europe", "APAC"),
    ("customers", "company_size"): ("Small", "Medium", "Enterprise"),
    ("customers", "customer_status"): ("active", "inactive"),
    ("subscriptions", "plan_type"): PLANS,
    ("subscriptions", "subscription_status"): ("active", "cancelled", "expired"),
    ("support_tickets", "severity"): ("Low", "Medium", "High", "Critical"),
    ("support_tickets", "status"): ("resolved", "open"),
}

COST_COMPONENTS = ("compute_cost", "storage_cost", "network_cost", "gpu_cost")
COST_COLUMNS = (*COST_COMPONENTS, "total_cost")

DATE_COLUMNS = {
    name: tuple(f.name for f in schema if isinstance(f.dataType, T.DateType))
    for name, schema in SCHEMAS.items()
}


@dataclass(frozen=True)
class Tables:
    """The five business tables as lazy DataFrames."""

    customers: DataFrame
    subscriptions: DataFrame
    sales: DataFrame
    cloud_costs: DataFrame
    support_tickets: DataFrame

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        for name in SCHEMAS:
            yield name, getattr(self, name)

    def with_tables(self, **frames: DataFrame) -> "Tables":
        return replace(self, **frames)
