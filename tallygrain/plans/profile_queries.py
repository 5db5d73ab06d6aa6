"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import kpis, profiling
from tallygrain.plans.base import Registry, rounded
from tallygrain.plans.kpi_queries import BEHAVIOR_SQL
from tallygrain.sources import roles

PROFILE = Registry()

SALES_NUMBERS = ("gross_revenue", "discount_amount", "net_revenue")
TICKET_NUMBERS = ("resolution_hours", "satisfaction_score")
BEHAVIOR_NUMBERS = (
    "subscription_count", "churned", "total_net_revenue", "average_discount", "ticket_count",
    "average_resolution_hours", "average_satisfaction",
)


def _long(source: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)


def summary_sql(source: str, columns) -> str:
    return f"""
    SELECT "column", count(value) AS count, round(avg(value), 4) AS mean, round(median(value), 6) AS median,
      round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
      round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
    FROM ({_long(source, columns)}) WHERE value IS NOT NULL GROUP BY "column\""""


def _summary(frame, columns):
    summary = profiling.numerical_summary(frame, columns)
    return rounded(rounded(summary, 4, "mean", "std"), 6, "median", "p25", "p50", "p75")


@PROFILE.add(
    "dataset_summary",
    """WITH lines AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity < 10)
    SELECT count(*) AS rows, CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM lineitem)) AS BIGINT) AS columns,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lines)) AS duplicate_rows FROM lines""",
)
def dataset_summary(spark, folder):
    """All columns; the lines of small quantities stand there twice."""
    lines = roles.table(spark, folder, "lineitem")
    return profiling.dataset_summary(lines.unionAll(lines.filter("l_quantity < 10")))


@PROFILE.add(
    "dataset_summary_tickets",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(8 AS BIGINT) AS columns, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM support_tickets GROUP BY customer_id, created_date, resolved_date,
      ticket_category, severity, resolution_hours, satisfaction_score, status)""",
    ["support_tickets"],
)
def dataset_summary_tickets(spark, folder):
    return profiling.dataset_summary(roles.support_tickets(spark, folder).drop("ticket_id"))


TICKET_COLUMNS = (
    "ticket_id", "customer_id", "created_date", "resolved_date", "ticket_category", "severity", "resolution_hours",
    "satisfaction_score", "status",
)


@PROFILE.add(
    "missing_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count,"
        f" (count(*) - count({c})) * 100.0::DOUBLE / greatest(count(*), 1) AS missing_percent FROM support_tickets"
        for c in TICKET_COLUMNS
    ),
    ["support_tickets"],
)
def missing_values(spark, folder):
    return profiling.missing_values(roles.support_tickets(spark, folder))


@PROFILE.add("numerical_summary_sales", summary_sql("sales", SALES_NUMBERS), ["sales"])
def numerical_summary_sales(spark, folder):
    return _summary(roles.sale_lines(spark, folder), SALES_NUMBERS)


@PROFILE.add("numerical_summary_tickets", summary_sql("support_tickets", TICKET_NUMBERS), ["support_tickets"])
def numerical_summary_tickets(spark, folder):
    return _summary(roles.support_tickets(spark, folder), TICKET_NUMBERS)


def top_sql(source: str, columns, top: int) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM {source}" for c in columns)
    return f"""
    SELECT "column", unique_count, CAST(place AS INTEGER) AS place, value, n FROM (
      SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS place,
        count(value) OVER (PARTITION BY "column") AS unique_count
      FROM (SELECT "column", value, count(*) AS n FROM ({long}) GROUP BY ALL))
    WHERE place <= {top}"""


@PROFILE.add(
    "categorical_summary",
    top_sql("customers", ("customer_name", "region", "country", "industry", "company_size"), 10),
    ["customers"],
)
def categorical_summary(spark, folder):
    return profiling.categorical_summary(
        roles.customers(spark, folder), ("customer_name", "region", "country", "industry", "company_size")
    )


def outlier_sql(source: str, columns) -> str:
    return f"""
    WITH long AS (SELECT * FROM ({_long(source, columns)}) WHERE value IS NOT NULL),
    fences AS (SELECT "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound,
        q3 + 1.5 * (q3 - q1) AS upper_bound
      FROM (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM long GROUP BY "column"))
    SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower_bound, 6) AS lower_bound,
      round(upper_bound, 6) AS upper_bound,
      count(*) FILTER (WHERE value < lower_bound OR value > upper_bound) AS outlier_count,
      round(100.0 * count(*) FILTER (WHERE value < lower_bound OR value > upper_bound) / count(*), 6) AS outlier_percent
    FROM long JOIN fences USING ("column") GROUP BY "column", fences.q1, fences.q3, fences.iqr, fences.lower_bound,
      fences.upper_bound"""


@PROFILE.add("iqr_outliers", outlier_sql("customer_totals", ("net", "orders")).replace(
    "WITH long", """WITH customer_totals AS (SELECT customer_id, CAST(sum(net_revenue) AS DOUBLE) AS net,
    count(DISTINCT subscription_id) AS orders FROM sales GROUP BY customer_id), long"""), ["sales"])
def iqr_outliers(spark, folder):
    totals = roles.sales(spark, folder).groupBy("customer_id").agg(
        F.sum("net_revenue").cast("double").alias("net"), F.count_distinct("subscription_id").alias("orders")
    )
    outliers = profiling.iqr_outliers(totals, ("net", "orders"))
    return rounded(outliers, 6, "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_percent")


@PROFILE.add("iqr_outliers_sales", outlier_sql("sales", SALES_NUMBERS), ["sales"])
def iqr_outliers_sales(spark, folder):
    outliers = profiling.iqr_outliers(roles.sale_lines(spark, folder), SALES_NUMBERS)
    return rounded(outliers, 6, "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_percent")


def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pearson_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 9) AS correlation"
        " FROM behavior"
        for a, b in _pairs(BEHAVIOR_NUMBERS)
    )
    return f"WITH behavior AS ({BEHAVIOR_SQL}) {rows}"


def spearman_sql() -> str:
    def rank(column: str) -> str:
        return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"

    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, round(corr(x, y), 9) AS correlation FROM"
        f" (SELECT CAST({rank(a)} AS DOUBLE) AS x, CAST({rank(b)} AS DOUBLE) AS y FROM behavior"
        f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in _pairs(BEHAVIOR_NUMBERS)
    )
    return f"WITH behavior AS ({BEHAVIOR_SQL}) {rows}"


def _behavior(spark, folder):
    return kpis.customer_behavior(
        roles.sales(spark, folder), roles.subscriptions(spark, folder), roles.support_tickets(spark, folder)
    ).drop("customer_id")


@PROFILE.add("correlations_pearson", pearson_sql(), ["subscriptions", "sales", "support_tickets"])
def correlations_pearson(spark, folder):
    return rounded(
        profiling.correlations(_behavior(spark, folder), BEHAVIOR_NUMBERS, method="pearson"), 9, "correlation"
    )


@PROFILE.add("correlations_spearman", spearman_sql(), ["subscriptions", "sales", "support_tickets"])
def correlations_spearman(spark, folder):
    return rounded(profiling.correlations(_behavior(spark, folder), BEHAVIOR_NUMBERS), 9, "correlation")


# Measures whose last bits depend on the order of a sum.
SUMMED = ("mean", "std", "missing_percent")


def profile_sql(table: str, source: str, columns, numbers, texts, digits: int = 4) -> str:
    """The profile of one table, of which ``source`` is the SQL name; quantiles and fences to so many digits."""
    section = f"SELECT '{table}' AS \"table\", '{{}}' AS section, {{}} AS \"column\", '{{}}' AS measure, {{}} AS number, {{}} AS text FROM {{}}"
    dataset = (
        f"(SELECT sum(n) AS rows, {len(columns)} AS columns, sum(n - 1) AS duplicate_rows FROM"
        f" (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(columns)}))"
    )
    parts = [
        section.format("dataset", "NULL", m, f"CAST({m} AS DOUBLE)", "NULL", dataset)
        for m in ("rows", "columns", "duplicate_rows")
    ]
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count,"
        f" (count(*) - count({c})) * 100.0::DOUBLE / greatest(count(*), 1) AS missing_percent FROM {source}"
        for c in columns
    )
    parts += [
        section.format("missing", '"column"', m, f"round(CAST({m} AS DOUBLE), 4)", "NULL", f"({missing})")
        for m in ("missing_count", "missing_percent")
    ]
    summary = summary_sql(source, numbers)
    parts += [
        section.format("numeric", '"column"', m, f"round(CAST({m} AS DOUBLE), {4 if m in SUMMED else digits})", "NULL", f"({summary})")
        for m in ("count", "mean", "median", "std", "min", "p25", "p50", "p75", "max")
    ]
    fences = outlier_sql(source, numbers)
    parts += [
        section.format("iqr_outliers", '"column"', m, f"round(CAST({m} AS DOUBLE), {digits})", "NULL", f"({fences})")
        for m in ("q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_percent")
    ]
    top = top_sql(source, texts, 10)
    parts += [
        section.format("categorical", '"column"', m, f"CAST({m} AS DOUBLE)", "value", f"({top})")
        for m in ("unique_count", "place", "n")
    ]
    return " UNION ALL ".join(parts)


TICKET_TEXTS = ("ticket_category", "severity", "status")

# Per table: its name in SQL, all columns, those of numbers and those of texts.
PROFILED = {
    "customers": (
        "customers",
        ("customer_id", "customer_name", "region", "country", "industry", "company_size", "acquisition_channel",
         "signup_date", "customer_status"),
        ("customer_id",),
        ("customer_name", "region", "country", "industry", "company_size", "acquisition_channel", "customer_status"),
    ),
    "subscriptions": (
        "subscriptions",
        ("subscription_id", "customer_id", "plan_type", "start_date", "renewal_date", "end_date", "monthly_price",
         "seats", "subscription_status"),
        ("subscription_id", "customer_id", "monthly_price", "seats"),
        ("plan_type", "subscription_status"),
    ),
    "sales": (
        "sales",
        ("sale_id", "customer_id", "subscription_id", "sale_date", "region", "plan_type", *SALES_NUMBERS, "sales_channel"),
        ("customer_id", "subscription_id", *SALES_NUMBERS),
        ("sale_id", "region", "plan_type", "sales_channel"),
    ),
    "cloud_costs": (
        "event_costs",
        ("cost_id", "date", "region", "service_type", "compute_cost", "storage_cost", "network_cost", "gpu_cost",
         "total_cost"),
        ("compute_cost", "storage_cost", "network_cost", "gpu_cost", "total_cost"),
        ("cost_id", "region", "service_type"),
    ),
    "support_tickets": ("support_tickets", TICKET_COLUMNS, ("ticket_id", "customer_id", *TICKET_NUMBERS), TICKET_TEXTS),
}


@PROFILE.add(
    "profile_tables",
    " UNION ALL ".join(profile_sql(table, *described, digits=6) for table, described in PROFILED.items()),
    ["customers", "subscriptions", "sales", "event_costs", "support_tickets"],
)
def profile_tables(spark, folder):
    """All columns of all five tables. Quantiles of four-digit amounts have six digits, so none is cut at a half."""
    frames = dict(roles.business_tables(spark, folder).items())
    number = F.when(F.col("measure").isin(*SUMMED), F.round("number", 4)).otherwise(F.round("number", 6))
    return profiling.profile(frames).withColumn("number", number)


@PROFILE.add(
    "profile_tickets",
    profile_sql(
        "support_tickets", "support_tickets", TICKET_COLUMNS[1:], ("customer_id", *TICKET_NUMBERS), TICKET_TEXTS
    ),
    ["support_tickets"],
)
def profile_tickets(spark, folder):
    tickets = roles.support_tickets(spark, folder).drop("ticket_id")
    return profiling.profile({"support_tickets": tickets}).withColumn("number", F.round("number", 4))
