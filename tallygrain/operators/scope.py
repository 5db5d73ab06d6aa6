"""Filters and scopes shared by the metrics."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.functions.exprs import all_true
from tallygrain.schemas import PLANS, Tables


def iso_date(value: date | str) -> date:
    if isinstance(value, date):
        return value
    try:
        return date.fromisoformat(value)
    except (TypeError, ValueError) as error:
        raise ValueError(f"Not an ISO date: {value!r}") from error


@dataclass(frozen=True)
class Scope:
    """Inclusive date range with an optional region and plan, checked when it is made.

    ``known_regions`` and ``known_plans`` are the members to accept; ``None`` accepts any.
    """

    start: date | str
    end: date | str
    region: str | None = None
    plan_type: str | None = None
    known_regions: Collection[str] | None = field(default=None, compare=False)
    known_plans: Collection[str] | None = field(default=PLANS, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "start", iso_date(self.start))
        object.__setattr__(self, "end", iso_date(self.end))
        if self.start > self.end:
            raise ValueError("start must not be after end")
        for value, known, what in (
            (self.region, self.known_regions, "region"),
            (self.plan_type, self.known_plans, "plan type"),
        ):
            if value is not None and known is not None and value not in known:
                raise ValueError(f"Unknown {what}: {value!r}")

    def covers(self, column: str) -> Column:
        return F.col(column).between(F.lit(self.start), F.lit(self.end))

    def refuse_plan(self, what: str) -> None:
        """Guard for facts that hold no plan."""
        if self.plan_type is not None:
            raise ValueError(f"{what} cannot be split by plan")

    def same_segment(self, other: "Scope") -> bool:
        return (self.region, self.plan_type) == (other.region, other.plan_type)


def sales_in_scope(sales: DataFrame, scope: Scope) -> DataFrame:
    """sales in the period, region and plan."""
    rules = [scope.covers("sale_date")]
    if scope.region is not None:
        rules.append(F.col("region") == scope.region)
    if scope.plan_type is not None:
        rules.append(F.col("plan_type") == scope.plan_type)
    return sales.filter(all_true(rules))


def subscriptions_in_segment(subscriptions: DataFrame, customers: DataFrame, scope: Scope) -> DataFrame:
    """subscriptions of known customers with their region, limited to the region and plan."""
    chosen = subscriptions
    if scope.plan_type is not None:
        chosen = chosen.filter(F.col("plan_type") == scope.plan_type)
    owners = customers.select("customer_id", "region")
    if scope.region is not None:
        owners = owners.filter(F.col("region") == scope.region)
    return chosen.join(owners, "customer_id")


def costs_in_scope(costs: DataFrame, scope: Scope) -> DataFrame:
    rules = [scope.covers("date")]
    if scope.region is not None:
        rules.append(F.col("region") == scope.region)
    return costs.filter(all_true(rules))


def pick_sales(
    sales: DataFrame, start: date | str, end: date | str, regions: Sequence[str] = (), plans: Sequence[str] = ()
) -> DataFrame:
    """sales in a date range; an empty selection means all members."""
    rules = [F.col("sale_date").between(F.lit(iso_date(start)), F.lit(iso_date(end)))]
    if regions:
        rules.append(F.col("region").isin(*regions))
    if plans:
        rules.append(F.col("plan_type").isin(*plans))
    return sales.filter(all_true(rules))


def pick_subscriptions(
    subscriptions: DataFrame, customers: DataFrame, regions: Sequence[str] = (), plans: Sequence[str] = ()
) -> DataFrame:
    """subscriptions of customers in the regions, with one of the plans."""
    chosen = subscriptions
    if plans:
        chosen = chosen.filter(F.col("plan_type").isin(*plans))
    if regions:
        owners = customers.filter(F.col("region").isin(*regions)).select("customer_id")
        chosen = chosen.join(owners, "customer_id", "left_semi")
    return chosen


def pick_costs(costs: DataFrame, start: date | str, end: date | str, regions: Sequence[str] = ()) -> DataFrame:
    """costs in a date range and in the regions."""
    rules = [F.col("date").between(F.lit(iso_date(start)), F.lit(iso_date(end)))]
    if regions:
        rules.append(F.col("region").isin(*regions))
    return costs.filter(all_true(rules))


def scoped_customers(
    customers: DataFrame, industries: Sequence[str] = (), customer_ids: DataFrame | None = None
) -> DataFrame:
    """Customer ids in the industries and in the requested id table."""
    chosen = customers
    if industries:
        chosen = chosen.filter(F.col("industry").isin(*industries))
    if customer_ids is not None:
        chosen = chosen.join(customer_ids.select("customer_id"), "customer_id", "left_semi")
    return chosen.select("customer_id")


def unknown_customers(customers: DataFrame, customer_ids: DataFrame) -> DataFrame:
    """Requested ids that no customer has."""
    return (
        customer_ids.select("customer_id").distinct().join(customers.select("customer_id"), "customer_id", "left_anti")
    )


def scope_tables(
    tables: Tables, industries: Sequence[str] = (), customer_ids: DataFrame | None = None, *, check: bool = True
) -> Tables:
    """limit customers and every table that depends on them. Unknown or no customers are an error."""
    if not industries and customer_ids is None:
        return tables
    if check and customer_ids is not None:
        stray = unknown_customers(tables.customers, customer_ids).limit(10).collect()
        if stray:
            raise ValueError(f"Unknown customer ids, for example {sorted(r.customer_id for r in stray)}")
    ids = scoped_customers(tables.customers, industries, customer_ids)
    if check and ids.isEmpty():
        raise ValueError("No customer is in the requested scope")
    return tables.with_tables(
        **{
            name: getattr(tables, name).join(ids, "customer_id", "left_semi")
            for name in ("customers", "subscriptions", "sales", "support_tickets")
        }
    )


def check_cost_scope(*, plans: Sequence[str] = (), industries: Sequence[str] = (), customer_ids: Any = None) -> None:
    """shared infrastructure cost has no plan, industry or customer."""
    if plans or industries or customer_ids is not None:
        raise ValueError("Infrastructure cost cannot be split by plan, industry or customer")


def select_with(spark: SparkSession, query: str, parameters: Mapping[str, Any] | None = None, **frames: DataFrame):
    """F8: a SELECT with bound parameters; ``frames`` are named in the text as ``{name}``."""
    return spark.sql(query, args=dict(parameters or {}), **frames)


def date_bounds(sales: DataFrame) -> DataFrame:
    """first sale date and the end of the last sale month."""
    return sales.agg(
        F.min("sale_date").alias("start_date"), F.last_day(F.max("sale_date")).alias("end_date")
    )


def members(frame: DataFrame, column: str) -> DataFrame:
    """sorted distinct non-null members of a dimension."""
    return frame.select(column).na.drop().distinct().orderBy(column)
