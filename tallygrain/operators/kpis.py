"""Revenue, cost, churn, renewal and support metrics.

Facts are summed per customer before a customer attribute is joined, so a customer that owns a
large share of the rows reaches the join as one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.functions.exprs import (
    flag_sum,
    long_form,
    mean,
    month_of,
    ratio,
    side_by_side,
    tally,
    total,
    total_or_zero,
)
from tallygrain.operators.cleaning import drop_duplicate_events
from tallygrain.operators.scope import (
    Scope,
    costs_in_scope,
    iso_date,
    pick_costs,
    pick_sales,
    pick_subscriptions,
    sales_in_scope,
    subscriptions_in_segment,
)
from tallygrain.schemas import COST_COLUMNS, Tables
from tallygrain.session import materialize

REVENUE_COLUMNS = ("gross_revenue", "discount_amount", "net_revenue")


def check_dimension(dimension: str) -> None:
    if dimension not in ("region", "plan_type"):
        raise ValueError("dimension must be 'region' or 'plan_type'")


# --- predicates on subscriptions -------------------------------------------------------------


def at_risk(scope: Scope) -> Column:
    """Live on any day of the period, both ends included."""
    return (F.col("start_date") <= F.lit(scope.end)) & (
        F.col("end_date").isNull() | (F.col("end_date") >= F.lit(scope.start))
    )


def cancelled_within(scope: Scope) -> Column:
    return (F.col("subscription_status") == "cancelled") & scope.covers("end_date")


def renewal_kept() -> Column:
    return F.col("end_date").isNull() | (F.col("end_date") >= F.col("renewal_date"))


# --- whole-period summaries ------------------------------------------------------------------


def revenue_summary(sales: DataFrame, scope: Scope) -> DataFrame:
    """K1: revenue totals, distinct customers, discount rate and net revenue per customer."""
    summed = sales_in_scope(sales, scope).agg(
        *[total_or_zero(c).alias(c) for c in REVENUE_COLUMNS],
        F.count_distinct("customer_id").alias("revenue_customers"),
        F.count("sale_id").alias("sales_observations"),
    )
    return summed.withColumns(
        {
            "discount_rate": ratio("discount_amount", "gross_revenue"),
            "average_revenue_per_customer": ratio("net_revenue", "revenue_customers"),
        }
    )


def cost_summary(costs: DataFrame, scope: Scope) -> DataFrame:
    """K2: infrastructure cost by component."""
    scope.refuse_plan("Infrastructure cost")
    return costs_in_scope(costs, scope).agg(
        *[total_or_zero(c).alias(c) for c in COST_COLUMNS], F.count("cost_id").alias("cost_observations")
    )


def contribution_summary(sales: DataFrame, costs: DataFrame, scope: Scope) -> DataFrame:
    """K3: net revenue minus infrastructure cost."""
    scope.refuse_plan("Contribution")
    return side_by_side(revenue_summary(sales, scope), cost_summary(costs, scope)).withColumns(
        {
            "estimated_gross_contribution": F.col("net_revenue") - F.col("total_cost"),
            "cost_to_revenue_ratio": ratio("total_cost", "net_revenue"),
        }
    )


def _subscription_flags(scope: Scope) -> dict[str, Column]:
    due = scope.covers("renewal_date")
    return {
        "subscriptions_at_risk": at_risk(scope),
        "cancellations": cancelled_within(scope),
        "renewals_due": due,
        "renewals_retained": due & renewal_kept(),
        "currently_active_subscriptions": F.col("subscription_status") == "active",
    }


def subscription_summary(subscriptions: DataFrame, customers: DataFrame, scope: Scope) -> DataFrame:
    """K4: period churn and renewals. Sums are null when no subscription is in the segment."""
    flags = _subscription_flags(scope)
    chosen = subscriptions
    if scope.plan_type is not None:
        chosen = chosen.filter(F.col("plan_type") == scope.plan_type)
    per_customer = chosen.groupBy("customer_id").agg(*[flag_sum(rule).alias(name) for name, rule in flags.items()])
    owners = customers.select("customer_id", "region")
    if scope.region is not None:
        owners = owners.filter(F.col("region") == scope.region)
    return (
        per_customer.join(owners, "customer_id")
        .agg(*[F.sum(name).alias(name) for name in flags])
        .withColumns(
            {
                "churn_rate": ratio("cancellations", "subscriptions_at_risk"),
                "renewal_rate": ratio("renewals_retained", "renewals_due"),
            }
        )
    )


def ticket_parts() -> dict[str, Column]:
    """Additive parts of the ticket averages, for summing in two steps."""
    return {
        "ticket_count": F.count("ticket_id"),
        "hours": F.sum("resolution_hours"),
        "hours_count": F.count("resolution_hours"),
        "score": F.sum("satisfaction_score"),
        "score_count": F.count("satisfaction_score"),
    }


def ticket_averages() -> dict[str, Column]:
    """Averages over rows that hold ``ticket_parts``."""
    return {
        "average_resolution_hours": ratio(F.sum("hours"), F.sum("hours_count")),
        "average_satisfaction": ratio(F.sum("score"), F.sum("score_count")),
    }


def support_summary(tickets: DataFrame, customers: DataFrame, scope: Scope) -> DataFrame:
    """K5: ticket metrics over distinct business events."""
    scope.refuse_plan("Ticket metrics")
    events = drop_duplicate_events(tickets.filter(scope.covers("created_date")), "ticket_id")
    per_customer = events.groupBy("customer_id").agg(
        *[part.alias(name) for name, part in ticket_parts().items()],
        tally(F.col("status") == "open").alias("open_tickets"),
    )
    if scope.region is not None:
        owners = customers.filter(F.col("region") == scope.region).select("customer_id")
        per_customer = per_customer.join(owners, "customer_id", "left_semi")
    return per_customer.agg(
        F.coalesce(F.sum("ticket_count"), F.lit(0)).alias("ticket_count"),
        F.count("customer_id").alias("customers_with_tickets"),
        *[average.alias(name) for name, average in ticket_averages().items()],
        F.sum("open_tickets").alias("open_tickets"),
    )


# --- monthly trends --------------------------------------------------------------------------


def monthly_revenue(sales: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """K6: monthly revenue; growth is against the previous month present. Months bound the window."""
    monthly = sales.groupBy(*by, month_of("sale_date").alias("month")).agg(
        *[total(c).alias(c) for c in REVENUE_COLUMNS], F.count_distinct("customer_id").alias("active_customers")
    )
    previous = F.lag("net_revenue").over(Window.partitionBy(*by).orderBy("month"))
    return monthly.withColumns(
        {
            "net_revenue_growth": ratio("net_revenue", previous) - 1,
            "discount_rate": ratio("discount_amount", "gross_revenue"),
        }
    ).orderBy(*by, "month")


def monthly_revenue_trend(sales: DataFrame, scope: Scope) -> DataFrame:
    return monthly_revenue(sales_in_scope(sales, scope))


def monthly_costs(costs: DataFrame) -> DataFrame:
    """K7: monthly cost by component."""
    return (
        costs.groupBy(month_of("date").alias("month")).agg(*[total(c).alias(c) for c in COST_COLUMNS]).orderBy("month")
    )


def monthly_cost_trend(costs: DataFrame, scope: Scope) -> DataFrame:
    scope.refuse_plan("Infrastructure cost")
    return monthly_costs(costs_in_scope(costs, scope))


def monthly_ticket_trend(tickets: DataFrame) -> DataFrame:
    """Monthly tickets."""
    return (
        tickets.groupBy(month_of("created_date").alias("month"))
        .agg(
            F.count("ticket_id").alias("ticket_count"),
            F.count_distinct("customer_id").alias("customers_with_tickets"),
            mean("resolution_hours").alias("average_resolution_hours"),
            mean("satisfaction_score").alias("average_satisfaction"),
        )
        .orderBy("month")
    )


def monthly_churn_trend(subscriptions: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Exposure churn per calendar month, empty months included.

    No range join: a subscription enters the exposure in its start month and leaves it in the month
    after its end. Summing entries and exits by month, then accumulating over the calendar, counts
    the same subscriptions with one pass over the facts.
    """
    start, end = month_of("start_date"), month_of("end_date")
    exposed = F.col("start_month").isNotNull() & (
        F.col("end_month").isNull() | (F.col("end_month") >= F.col("start_month"))
    )
    moves = subscriptions.select(
        *by, start.alias("start_month"), end.alias("end_month"), "subscription_status"
    ).select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("start_month").alias("month"),
                    exposed.cast("int").alias("entered"),
                    F.lit(0).alias("left_after"),
                    F.lit(0).alias("cancelled"),
                ),
                F.struct(
                    F.col("end_month").alias("month"),
                    F.lit(0).alias("entered"),
                    exposed.cast("int").alias("left_after"),
                    (F.col("subscription_status") == "cancelled").cast("int").alias("cancelled"),
                ),
            )
        ),
        F.col("start_month"),
    )
    by_month = (
        moves.filter("month IS NOT NULL")
        .groupBy(*by, "month")
        .agg(
            F.sum("entered").alias("entered"),
            F.sum("left_after").alias("left_after"),
            F.sum("cancelled").alias("cancellations"),
            F.min("start_month").alias("first_start"),
        )
    )
    calendar = (
        by_month.groupBy(*by)
        .agg(F.min("first_start").alias("_first"), F.max("month").alias("_last"))
        .select(*by, F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    )
    so_far = Window.partitionBy(*by).orderBy("month")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    return (
        calendar.join(by_month, [*by, "month"], "left")
        .na.fill(0, ["entered", "left_after", "cancellations"])
        .select(
            *by,
            "month",
            (
                F.sum("entered").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
                - F.coalesce(F.sum("left_after").over(before), F.lit(0))
            ).alias("subscriptions_at_risk"),
            "cancellations",
        )
        .withColumn("churn_rate", ratio("cancellations", "subscriptions_at_risk"))
        .orderBy(*by, "month")
    )


# --- by region or plan -----------------------------------------------------------------------


def _revenue_by(sales: DataFrame, dimension: str) -> DataFrame:
    return sales.groupBy(dimension).agg(
        *[total(c).alias(c) for c in REVENUE_COLUMNS], F.count_distinct("customer_id").alias("revenue_customers")
    )


def _subscription_counts_by(
    subscriptions: DataFrame, owners: DataFrame, dimension: str, counts: Mapping[str, Column], join: str = "inner"
) -> DataFrame:
    """Counts per dimension member, summed per customer before the owner's region is attached."""
    keys = ["customer_id", "plan_type"] if dimension == "plan_type" else ["customer_id"]
    per_customer = subscriptions.groupBy(*keys).agg(*[rule.alias(name) for name, rule in counts.items()])
    return (
        per_customer.join(owners, "customer_id", join)
        .groupBy(dimension)
        .agg(*[F.sum(name).alias(name) for name in counts])
    )


def revenue_by_dimension(
    sales: DataFrame, subscriptions: DataFrame, customers: DataFrame, scope: Scope, dimension: str
) -> DataFrame:
    """K8: revenue and period churn by region or plan, highest net revenue first."""
    check_dimension(dimension)
    chosen = subscriptions
    if scope.plan_type is not None:
        chosen = chosen.filter(F.col("plan_type") == scope.plan_type)
    owners = customers
    if scope.region is not None:
        owners = owners.filter(F.col("region") == scope.region)
    owners = owners.select("customer_id", *(["region"] if dimension == "region" else []))
    churn = _subscription_counts_by(
        chosen,
        owners,
        dimension,
        {"subscriptions_at_risk": flag_sum(at_risk(scope)), "cancellations": flag_sum(cancelled_within(scope))},
    )
    return (
        _revenue_by(sales_in_scope(sales, scope), dimension)
        .join(churn, dimension, "full")
        .withColumns(
            {
                "discount_rate": ratio("discount_amount", "gross_revenue"),
                "churn_rate": ratio("cancellations", "subscriptions_at_risk"),
            }
        )
        .orderBy(F.coalesce("net_revenue", F.lit(0.0)).desc(), dimension)
    )


def dimension_metrics(sales: DataFrame, subscriptions: DataFrame, customers: DataFrame, dimension: str) -> DataFrame:
    """K9: revenue and lifetime churn by region or plan, highest net revenue first."""
    check_dimension(dimension)
    churn = _subscription_counts_by(
        subscriptions,
        customers.select("customer_id", *(["region"] if dimension == "region" else [])),
        dimension,
        {
            "subscriptions": F.count("subscription_id"),
            "cancellations": flag_sum(F.col("subscription_status") == "cancelled"),
        },
        "left",
    ).filter(F.col(dimension).isNotNull())
    return (
        _revenue_by(sales.filter(F.col(dimension).isNotNull()), dimension)
        .join(churn, dimension, "full")
        .withColumns(
            {
                "churn_rate": ratio("cancellations", "subscriptions"),
                "discount_rate": ratio("discount_amount", "gross_revenue"),
            }
        )
        .orderBy(F.col("net_revenue").desc_nulls_last(), dimension)
    )


def by_net_revenue(segments: DataFrame, dimension: str) -> DataFrame:
    """Segment rows for display, lowest net revenue first."""
    check_dimension(dimension)
    return segments.select(dimension, "net_revenue", "churn_rate").orderBy("net_revenue", dimension)


# --- period comparisons ----------------------------------------------------------------------

# The metrics of a period comparison.
COMPARED = ("gross_revenue", "discount_amount", "net_revenue", "gpu_cost", "total_cost", "estimated_gross_contribution")


def _period_totals(frame: DataFrame, column: str, periods: Mapping[str, Scope], names: Sequence[str]) -> DataFrame:
    rules = {tag: scope.covers(column) for tag, scope in periods.items()}
    return frame.filter(reduce(lambda a, b: a | b, rules.values())).agg(
        *[
            total_or_zero(F.when(rule, F.col(name))).alias(f"{tag}_{name}")
            for tag, rule in rules.items()
            for name in names
        ]
    )


def compare_periods(sales: DataFrame, costs: DataFrame, first: Scope, second: Scope) -> DataFrame:
    """Change and growth of six metrics between two periods, with one scan per fact table."""
    if not first.same_segment(second):
        raise ValueError("Both periods need the same region and plan")
    first.refuse_plan("Contribution")
    if first.region is not None:
        sales, costs = (f.filter(F.col("region") == first.region) for f in (sales, costs))
    periods = {"first": first, "second": second}
    row = side_by_side(
        _period_totals(sales, "sale_date", periods, REVENUE_COLUMNS),
        _period_totals(costs, "date", periods, ("gpu_cost", "total_cost")),
    ).withColumns(
        {
            f"{tag}_estimated_gross_contribution": F.col(f"{tag}_net_revenue") - F.col(f"{tag}_total_cost")
            for tag in periods
        }
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"first_{name}").alias("first_value"),
                F.col(f"second_{name}").alias("second_value"),
            )
            for name in COMPARED
        ]
    )
    return row.select(F.inline(pairs)).withColumns(
        {
            "change": F.col("second_value") - F.col("first_value"),
            "growth": ratio("second_value", "first_value") - 1,
        }
    )


def region_investigation(
    subscriptions: DataFrame, customers: DataFrame, tickets: DataFrame, first: Scope, second: Scope
) -> DataFrame:
    """Subscription and support signals of one region in two periods."""
    if first.region is None or not first.same_segment(second):
        raise ValueError("Both periods need the same region")
    rows = [
        side_by_side(
            subscription_summary(subscriptions, customers, scope), support_summary(tickets, customers, scope)
        ).select(F.lit(tag).alias("period"), "*")
        for tag, scope in (("first", first), ("second", second))
    ]
    return rows[0].unionByName(rows[1])


# --- whole data ------------------------------------------------------------------------------


def business_metrics(tables: Tables) -> DataFrame:
    """Thirteen whole-window metrics in one row, with one pass over each table.

    Renewals due depend on the last sale date. They are counted per renewal date first, a list
    bounded by the days of the calendar, so the date need not be known before the scan.
    """
    revenue = tables.sales.agg(
        total("gross_revenue").alias("total_revenue"),
        total("net_revenue").alias("net_revenue"),
        ratio(F.sum("net_revenue"), F.count_distinct("customer_id")).alias("average_revenue_per_customer"),
        ratio(F.sum("discount_amount"), F.sum("gross_revenue")).alias("average_discount_rate"),
        F.max("sale_date").alias("_last_sale"),
    )
    by_renewal = tables.subscriptions.groupBy("renewal_date").agg(
        F.count("*").alias("n"),
        tally(F.col("subscription_status") == "cancelled").alias("cancelled"),
        tally(F.col("subscription_status") == "active").alias("active"),
        tally(renewal_kept()).alias("kept"),
    )
    churn = by_renewal.agg(
        ratio(F.sum("cancelled"), F.sum("n")).alias("churn_rate"),
        F.coalesce(F.sum("active"), F.lit(0)).alias("active_subscriptions"),
        F.collect_list(F.struct("renewal_date", "n", "kept")).alias("_renewals"),
    )
    cost = tables.cloud_costs.agg(total_or_zero("total_cost").alias("infrastructure_cost"))
    support = tables.support_tickets.agg(
        mean("resolution_hours").alias("average_support_resolution_hours"),
        mean("satisfaction_score").alias("average_satisfaction_score"),
    )
    people = tables.customers.agg(F.count_distinct("customer_id").alias("customers"))
    row = side_by_side(revenue, churn, cost, support, people)
    due = F.filter("_renewals", lambda r: r["renewal_date"] <= F.col("_last_sale"))

    def summed(part: str) -> Column:
        return F.aggregate(due, F.lit(0).cast("bigint"), lambda acc, r: acc + r[part])

    return row.withColumns(
        {
            "renewal_rate": ratio(summed("kept"), summed("n")),
            "cost_to_revenue_ratio": ratio("infrastructure_cost", "net_revenue"),
            "estimated_gross_contribution": F.col("net_revenue") - F.col("infrastructure_cost"),
        }
    ).drop("_last_sale", "_renewals")


def customer_behavior(sales: DataFrame, subscriptions: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row per subscribing customer. Averages of customers without tickets stay null."""
    spending = sales.groupBy("customer_id").agg(
        total("net_revenue").alias("total_net_revenue"), mean("discount_amount").alias("average_discount")
    )
    support = tickets.groupBy("customer_id").agg(
        F.count("ticket_id").alias("ticket_count"),
        mean("resolution_hours").alias("average_resolution_hours"),
        mean("satisfaction_score").alias("average_satisfaction"),
    )
    owned = subscriptions.groupBy("customer_id").agg(
        F.count("subscription_id").alias("subscription_count"),
        F.max((F.col("subscription_status") == "cancelled").cast("int")).alias("churned"),
    )
    return (
        owned.join(spending, "customer_id", "left")
        .join(support, "customer_id", "left")
        .na.fill(0, ["total_net_revenue", "average_discount", "ticket_count"])
    )


def growth_over_window(monthly: DataFrame) -> DataFrame:
    """Growth from the first to the last month; null with fewer than two months or a zero start."""
    return monthly.agg(
        F.when(
            F.count("*") >= 2, ratio(F.max_by("net_revenue", "month"), F.min_by("net_revenue", "month")) - 1
        ).alias("revenue_growth")
    )


def latest_rate(monthly: DataFrame) -> DataFrame:
    """Churn rate of the last month that has one."""
    return monthly.filter("churn_rate IS NOT NULL").agg(F.max_by("churn_rate", "month").alias("latest_churn_rate"))


def _require_members(frame: DataFrame, column: str, chosen: Sequence[str]) -> None:
    """Raise for chosen members that do not occur; at most the chosen ones come back."""
    if chosen:
        present = frame.filter(F.col(column).isin(*chosen)).select(column).distinct().collect()
        unknown = set(chosen) - {row[column] for row in present}
        if unknown:
            raise ValueError(f"Unknown {column}: {sorted(unknown)}")


def filtered_view(
    tables: Tables,
    start: date | str,
    end: date | str,
    regions: Sequence[str] = (),
    plans: Sequence[str] = (),
    *,
    check: bool = True,
    cut: bool = False,
) -> dict[str, DataFrame]:
    """Every trend and headline for one selection.

    Segment tables take sales in the dates, and subscriptions by region and plan only. ``cut`` builds
    the monthly trends at once, for callers that read them more than once.
    """
    first, last = iso_date(start), iso_date(end)
    if first > last:
        raise ValueError("start must not be after end")
    if check:
        _require_members(tables.customers, "region", regions)
        _require_members(tables.subscriptions, "plan_type", plans)
    sales = pick_sales(tables.sales, first, last, regions, plans)
    subscriptions = pick_subscriptions(tables.subscriptions, tables.customers, regions, plans)
    costs = pick_costs(tables.cloud_costs, first, last, regions)
    if check:
        empty = [n for n, f in (("sales", sales), ("subscriptions", subscriptions), ("costs", costs)) if f.isEmpty()]
        if empty:
            raise ValueError(f"The selection leaves no rows in: {', '.join(empty)}")
    revenue = monthly_revenue(sales)
    churn = monthly_churn_trend(subscriptions).filter(
        F.col("month").between(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)))
    )
    monthly = monthly_costs(costs)
    if cut:
        revenue, churn, monthly = (materialize(frame) for frame in (revenue, churn, monthly))
    headline = side_by_side(
        sales.agg(
            total("net_revenue").alias("net_revenue"), F.count_distinct("customer_id").alias("revenue_customers")
        ),
        costs.agg(total("total_cost").alias("infrastructure_cost")),
        growth_over_window(revenue),
        latest_rate(churn),
    ).withColumns(
        {
            "contribution": F.col("net_revenue") - F.col("infrastructure_cost"),
            "cost_to_revenue_ratio": ratio("infrastructure_cost", "net_revenue"),
        }
    )
    return {
        "revenue": revenue,
        "churn": churn,
        "costs": monthly,
        "region_metrics": dimension_metrics(sales, subscriptions, tables.customers, "region"),
        "plan_metrics": dimension_metrics(sales, subscriptions, tables.customers, "plan_type"),
        "headline": headline,
    }


def scoped_ticket_averages(
    tables: Tables, start: date | str, end: date | str, regions: Sequence[str] = (), plans: Sequence[str] = ()
) -> DataFrame:
    """Ticket averages in the period, over customers in the regions who hold one of the plans."""
    owners = tables.customers
    if regions:
        owners = owners.filter(F.col("region").isin(*regions))
    owners = owners.select("customer_id")
    if plans:
        holders = tables.subscriptions.filter(F.col("plan_type").isin(*plans)).select("customer_id")
        owners = owners.join(holders.distinct(), "customer_id", "left_semi")
    per_customer = (
        tables.support_tickets.filter(F.col("created_date").between(F.lit(iso_date(start)), F.lit(iso_date(end))))
        .groupBy("customer_id")
        .agg(*[part.alias(name) for name, part in ticket_parts().items()])
    )
    return per_customer.join(owners, "customer_id", "left_semi").agg(
        *[average.alias(name) for name, average in ticket_averages().items()]
    )


def plan_contingency(subscriptions: DataFrame) -> DataFrame:
    """Cancelled and other subscriptions per plan; a missing cell is zero."""
    state = F.when(F.col("subscription_status") == "cancelled", "cancelled").otherwise("not_cancelled")
    return (
        subscriptions.filter("plan_type IS NOT NULL")
        .select("plan_type", state.alias("state"))
        .groupBy("plan_type")
        .pivot("state", ["not_cancelled", "cancelled"])
        .count()
        .na.fill(0)
    )


# Metric names and their units.
UNITS = {
    "gross_revenue": "currency",
    "net_revenue": "currency",
    "revenue_growth": "ratio",
    "discount_rate": "ratio",
    "infrastructure_cost": "currency",
    "gpu_cost": "currency",
    "cost_to_revenue_ratio": "ratio",
    "estimated_gross_contribution": "currency",
    "churn_rate": "ratio",
    "customer_count": "customers",
    "subscription_count": "subscriptions",
    "renewal_rate": "ratio",
    "average_resolution_hours": "hours",
    "average_satisfaction": "score_1_to_5",
}


def metric_rows(
    tables: Tables,
    start: date | str,
    end: date | str,
    regions: Sequence[str] = (),
    plans: Sequence[str] = (),
    metrics: Sequence[str] = tuple(UNITS),
) -> DataFrame:
    """(metric, value, unit) rows for a scope. What cannot be computed stays null."""
    unknown = set(metrics) - set(UNITS)
    if unknown or not metrics:
        raise ValueError(f"Unknown metrics: {sorted(unknown)}" if unknown else "No metric was asked for")
    view = filtered_view(tables, start, end, regions, plans, check=False, cut=True)
    row = side_by_side(
        view["headline"].withColumnsRenamed(
            {
                "contribution": "estimated_gross_contribution",
                "latest_churn_rate": "churn_rate",
                "revenue_customers": "customer_count",
            }
        ),
        view["revenue"].agg(
            F.sum("gross_revenue").alias("gross_revenue"),
            ratio(F.sum("discount_amount"), F.sum("gross_revenue")).alias("discount_rate"),
        ),
        view["costs"].agg(F.sum("gpu_cost").alias("gpu_cost")),
        view["churn"].agg(F.max("subscriptions_at_risk").alias("subscription_count")),
        business_metrics(tables).select("renewal_rate"),
        scoped_ticket_averages(tables, start, end, regions, plans),
    )
    units = F.create_map(*[F.lit(x) for name in metrics for x in (name, UNITS[name])])
    return long_form(row, list(metrics)).withColumn("unit", F.element_at(units, F.col("metric")))


def segment_rows(
    tables: Tables, start: date | str, end: date | str, regions: Sequence[str] = (), plans: Sequence[str] = ()
) -> DataFrame:
    """Net revenue and churn per segment, for each dimension the scope leaves open."""
    view = filtered_view(tables, start, end, regions, plans, check=False)
    open_dimensions = [
        (name, view[key])
        for name, key, chosen in (("region", "region_metrics", regions), ("plan_type", "plan_metrics", plans))
        if not chosen
    ]
    if not open_dimensions:
        raise ValueError("The scope fixes both dimensions, so no segment is left to compare")
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            frame.select(F.lit(name).alias("dimension"), F.col(name).alias("segment"), "net_revenue", "churn_rate")
            for name, frame in open_dimensions
        ],
    )
