"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import kpis, scope as sc
from tallygrain.operators.scope import Scope
from tallygrain.plans.base import Registry
from tallygrain.sources import roles

KPI = Registry()

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
YEAR = Scope("1998-01-01", "1998-12-31")
FIRST_QUARTER = Scope("1998-01-01", "1998-03-31")
SECOND_QUARTER = Scope("1998-04-01", "1998-06-30")
EUROPE_PROFESSIONAL = Scope("1997-01-01", "1998-12-31", "EUROPE", "Professional", REGIONS)
JANUARY = Scope("2024-01-01", "2024-01-31")
TICKET_SHIFT = 312  # months from 2024-01 back to 1998-01

REVENUE_SUMS = """
  coalesce(CAST(sum(gross_revenue) AS DOUBLE), 0.0) AS gross_revenue,
  coalesce(CAST(sum(discount_amount) AS DOUBLE), 0.0) AS discount_amount,
  coalesce(CAST(sum(net_revenue) AS DOUBLE), 0.0) AS net_revenue"""
COST_SUMS = """
  coalesce(CAST(sum(compute_cost) AS DOUBLE), 0.0) AS compute_cost,
  coalesce(CAST(sum(storage_cost) AS DOUBLE), 0.0) AS storage_cost,
  coalesce(CAST(sum(network_cost) AS DOUBLE), 0.0) AS network_cost,
  coalesce(CAST(sum(gpu_cost) AS DOUBLE), 0.0) AS gpu_cost,
  coalesce(CAST(sum(total_cost) AS DOUBLE), 0.0) AS total_cost"""


def revenue_summary_sql(where: str) -> str:
    return f"""
    SELECT *, discount_amount / nullif(gross_revenue, 0) AS discount_rate,
      net_revenue / nullif(CAST(revenue_customers AS DOUBLE), 0) AS average_revenue_per_customer
    FROM (SELECT {REVENUE_SUMS}, count(DISTINCT customer_id) AS revenue_customers, count(sale_id) AS sales_observations
      FROM sales WHERE {where})"""


def cost_summary_sql(table: str, where: str) -> str:
    return f"SELECT {COST_SUMS}, count(cost_id) AS cost_observations FROM {table} WHERE {where}"


IN_YEAR = "sale_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
COST_YEAR = "date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"


@KPI.add("revenue_summary", revenue_summary_sql(IN_YEAR), ["sales"])
def revenue_summary(spark, folder):
    return kpis.revenue_summary(roles.sales(spark, folder), YEAR)


@KPI.add(
    "revenue_summary_segment",
    revenue_summary_sql(
        "sale_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND region = 'EUROPE' AND plan_type = 'Professional'"
    ),
    ["sales"],
)
def revenue_summary_segment(spark, folder):
    return kpis.revenue_summary(roles.sales(spark, folder), EUROPE_PROFESSIONAL)


@KPI.add("cost_summary", cost_summary_sql("shipping_costs", COST_YEAR + " AND region = 'ASIA'"), ["shipping_costs"])
def cost_summary(spark, folder):
    return kpis.cost_summary(roles.shipping_costs(spark, folder), Scope("1998-01-01", "1998-12-31", "ASIA"))


CONTRIBUTION_SQL = f"""
SELECT r.*, c.*, r.net_revenue - c.total_cost AS estimated_gross_contribution,
  c.total_cost / nullif(r.net_revenue, 0) AS cost_to_revenue_ratio
FROM ({revenue_summary_sql(IN_YEAR)}) r, ({cost_summary_sql("shipping_costs", COST_YEAR)}) c"""


@KPI.add("contribution_summary", CONTRIBUTION_SQL, ["sales", "shipping_costs"])
def contribution_summary(spark, folder):
    return kpis.contribution_summary(roles.sales(spark, folder), roles.shipping_costs(spark, folder), YEAR)


def risk_sql(start: str, end: str) -> str:
    return f"""start_date <= DATE '{end}' AND (end_date IS NULL OR end_date >= DATE '{start}')"""


def cancel_sql(start: str, end: str) -> str:
    return f"subscription_status = 'cancelled' AND end_date BETWEEN DATE '{start}' AND DATE '{end}'"


def subscription_summary_sql(start: str, end: str, where: str = "TRUE") -> str:
    due = f"renewal_date BETWEEN DATE '{start}' AND DATE '{end}'"
    return f"""
    SELECT *, CAST(cancellations AS DOUBLE) / nullif(subscriptions_at_risk, 0) AS churn_rate,
      CAST(renewals_retained AS DOUBLE) / nullif(renewals_due, 0) AS renewal_rate
    FROM (
      SELECT CAST(sum(CASE WHEN {risk_sql(start, end)} THEN 1 ELSE 0 END) AS BIGINT) AS subscriptions_at_risk,
        CAST(sum(CASE WHEN {cancel_sql(start, end)} THEN 1 ELSE 0 END) AS BIGINT) AS cancellations,
        CAST(sum(CASE WHEN {due} THEN 1 ELSE 0 END) AS BIGINT) AS renewals_due,
        CAST(sum(CASE WHEN {due} AND (end_date IS NULL OR end_date >= renewal_date) THEN 1 ELSE 0 END) AS BIGINT)
          AS renewals_retained,
        CAST(sum(CASE WHEN subscription_status = 'active' THEN 1 ELSE 0 END) AS BIGINT)
          AS currently_active_subscriptions
      FROM subscriptions s JOIN customers c USING (customer_id) WHERE {where})"""


@KPI.add(
    "subscription_summary", subscription_summary_sql("1998-01-01", "1998-12-31"), ["customers", "subscriptions"]
)
def subscription_summary(spark, folder):
    return kpis.subscription_summary(roles.subscriptions(spark, folder), roles.customers(spark, folder), YEAR)


@KPI.add(
    "subscription_summary_segment",
    subscription_summary_sql("1997-01-01", "1998-12-31", "region = 'EUROPE' AND plan_type = 'Professional'"),
    ["customers", "subscriptions"],
)
def subscription_summary_segment(spark, folder):
    return kpis.subscription_summary(
        roles.subscriptions(spark, folder), roles.customers(spark, folder), EUROPE_PROFESSIONAL
    )


TICKET_KEY = (
    "customer_id, created_date, resolved_date, ticket_category, severity, resolution_hours, satisfaction_score, status"
)


def support_summary_sql(start: str, end: str, region: str | None = None) -> str:
    keep = f"AND customer_id IN (SELECT customer_id FROM customers WHERE region = '{region}')" if region else ""
    return f"""
    SELECT count(ticket_id) AS ticket_count, count(DISTINCT customer_id) AS customers_with_tickets,
      CAST(sum(resolution_hours) AS DOUBLE) / nullif(count(resolution_hours), 0) AS average_resolution_hours,
      CAST(sum(satisfaction_score) AS DOUBLE) / nullif(count(satisfaction_score), 0) AS average_satisfaction,
      CAST(sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END) AS BIGINT) AS open_tickets
    FROM (SELECT *, row_number() OVER (PARTITION BY {TICKET_KEY} ORDER BY ticket_id) AS copy FROM support_tickets)
    WHERE copy = 1 AND created_date BETWEEN DATE '{start}' AND DATE '{end}' {keep}"""


@KPI.add("support_summary", support_summary_sql("2024-01-01", "2024-01-31"), ["support_tickets"])
def support_summary(spark, folder):
    return kpis.support_summary(roles.support_tickets(spark, folder), roles.customers(spark, folder), JANUARY)


@KPI.add(
    "support_summary_region",
    support_summary_sql("2024-01-05", "2024-01-25", "AMERICA"),
    ["customers", "support_tickets"],
)
def support_summary_region(spark, folder):
    return kpis.support_summary(
        roles.support_tickets(spark, folder),
        roles.customers(spark, folder),
        Scope("2024-01-05", "2024-01-25", "AMERICA", known_regions=REGIONS),
    )


def monthly_revenue_sql(source: str = "sales") -> str:
    return f"""
    SELECT month, gross_revenue, discount_amount, net_revenue, active_customers,
      net_revenue / nullif(lag(net_revenue) OVER (ORDER BY month), 0) - 1 AS net_revenue_growth,
      discount_amount / nullif(gross_revenue, 0) AS discount_rate
    FROM (
      SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, CAST(sum(gross_revenue) AS DOUBLE) AS gross_revenue,
        CAST(sum(discount_amount) AS DOUBLE) AS discount_amount, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue,
        count(DISTINCT customer_id) AS active_customers
      FROM {source} GROUP BY 1)"""


@KPI.add("monthly_revenue", monthly_revenue_sql(), ["sales"])
def monthly_revenue(spark, folder):
    return kpis.monthly_revenue(roles.sales(spark, folder))


@KPI.add(
    "monthly_revenue_trend",
    monthly_revenue_sql(f"(SELECT * FROM sales WHERE {IN_YEAR} AND region = 'ASIA')"),
    ["sales"],
)
def monthly_revenue_trend(spark, folder):
    return kpis.monthly_revenue_trend(roles.sales(spark, folder), Scope("1998-01-01", "1998-12-31", "ASIA"))


def monthly_costs_sql(source: str) -> str:
    sums = ", ".join(
        f"CAST(sum({c}) AS DOUBLE) AS {c}"
        for c in ("compute_cost", "storage_cost", "network_cost", "gpu_cost", "total_cost")
    )
    return f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {sums} FROM {source} GROUP BY 1"


@KPI.add("monthly_costs", monthly_costs_sql("shipping_costs"), ["shipping_costs"])
def monthly_costs(spark, folder):
    return kpis.monthly_costs(roles.shipping_costs(spark, folder))


@KPI.add(
    "monthly_cost_trend",
    monthly_costs_sql(f"(SELECT * FROM shipping_costs WHERE {COST_YEAR} AND region = 'EUROPE')"),
    ["shipping_costs"],
)
def monthly_cost_trend(spark, folder):
    return kpis.monthly_cost_trend(
        roles.shipping_costs(spark, folder), Scope("1998-01-01", "1998-12-31", "EUROPE")
    )


def revenue_by_dimension_sql(dimension: str) -> str:
    return f"""
    SELECT coalesce(a.{dimension}, b.{dimension}) AS {dimension}, gross_revenue, discount_amount, net_revenue,
      revenue_customers, subscriptions_at_risk, cancellations,
      discount_amount / nullif(gross_revenue, 0) AS discount_rate,
      CAST(cancellations AS DOUBLE) / nullif(subscriptions_at_risk, 0) AS churn_rate
    FROM (
      SELECT {dimension}, CAST(sum(gross_revenue) AS DOUBLE) AS gross_revenue,
        CAST(sum(discount_amount) AS DOUBLE) AS discount_amount, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue,
        count(DISTINCT customer_id) AS revenue_customers
      FROM sales WHERE {IN_YEAR} GROUP BY {dimension}) a
    FULL JOIN (
      SELECT {dimension},
        CAST(sum(CASE WHEN {risk_sql("1998-01-01", "1998-12-31")} THEN 1 ELSE 0 END) AS BIGINT)
          AS subscriptions_at_risk,
        CAST(sum(CASE WHEN {cancel_sql("1998-01-01", "1998-12-31")} THEN 1 ELSE 0 END) AS BIGINT) AS cancellations
      FROM subscriptions JOIN customers USING (customer_id) GROUP BY {dimension}) b
    ON a.{dimension} = b.{dimension}"""


def _by_dimension(dimension):
    @KPI.add(
        f"revenue_by_{dimension}", revenue_by_dimension_sql(dimension), ["sales", "customers", "subscriptions"]
    )
    def query(spark, folder):
        return kpis.revenue_by_dimension(
            roles.sales(spark, folder), roles.subscriptions(spark, folder), roles.customers(spark, folder), YEAR, dimension
        )


def dimension_metrics_sql(dimension: str, sales: str = "sales", subscriptions: str = "subscriptions") -> str:
    joined = f"{subscriptions} LEFT JOIN customers USING (customer_id)" if dimension == "region" else subscriptions
    return f"""
    SELECT coalesce(a.{dimension}, b.{dimension}) AS {dimension}, gross_revenue, discount_amount, net_revenue,
      revenue_customers, subscriptions, cancellations,
      CAST(cancellations AS DOUBLE) / nullif(subscriptions, 0) AS churn_rate,
      discount_amount / nullif(gross_revenue, 0) AS discount_rate
    FROM (
      SELECT {dimension}, CAST(sum(gross_revenue) AS DOUBLE) AS gross_revenue,
        CAST(sum(discount_amount) AS DOUBLE) AS discount_amount, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue,
        count(DISTINCT customer_id) AS revenue_customers
      FROM {sales} GROUP BY {dimension}) a
    FULL JOIN (
      SELECT {dimension}, count(*) AS subscriptions,
        CAST(sum(CASE WHEN subscription_status = 'cancelled' THEN 1 ELSE 0 END) AS BIGINT) AS cancellations
      FROM {joined} GROUP BY {dimension}) b
    ON a.{dimension} = b.{dimension}"""


def _metrics_by(dimension):
    @KPI.add(f"metrics_by_{dimension}", dimension_metrics_sql(dimension), ["sales", "customers", "subscriptions"])
    def query(spark, folder):
        return kpis.dimension_metrics(
            roles.sales(spark, folder), roles.subscriptions(spark, folder), roles.customers(spark, folder), dimension
        )


for _dimension in ("region", "plan_type"):
    _by_dimension(_dimension)
    _metrics_by(_dimension)


@KPI.add(
    "segments_by_net_revenue",
    f"SELECT region, net_revenue, churn_rate FROM ({dimension_metrics_sql('region')})",
    ["sales", "customers", "subscriptions"],
)
def segments_by_net_revenue(spark, folder):
    metrics = kpis.dimension_metrics(
        roles.sales(spark, folder), roles.subscriptions(spark, folder), roles.customers(spark, folder), "region"
    )
    return kpis.by_net_revenue(metrics, "region")


def compare_sql() -> str:
    def period(tag: str, start: str, end: str) -> str:
        return f"""{tag} AS (
          SELECT r.gross_revenue, r.discount_amount, r.net_revenue, c.gpu_cost, c.total_cost,
            r.net_revenue - c.total_cost AS estimated_gross_contribution
          FROM ({revenue_summary_sql(f"sale_date BETWEEN DATE '{start}' AND DATE '{end}'")}) r,
            ({cost_summary_sql("shipping_costs", f"date BETWEEN DATE '{start}' AND DATE '{end}'")}) c)"""

    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, first.{m} AS first_value, second.{m} AS second_value FROM first, second"
        for m in kpis.COMPARED
    )
    return f"""WITH {period("first", "1998-01-01", "1998-03-31")}, {period("second", "1998-04-01", "1998-06-30")}
    SELECT *, second_value - first_value AS change, second_value / nullif(first_value, 0) - 1 AS growth FROM ({rows})"""


@KPI.add("compare_periods", compare_sql(), ["sales", "shipping_costs"])
def compare_periods(spark, folder):
    return kpis.compare_periods(
        roles.sales(spark, folder), roles.shipping_costs(spark, folder), FIRST_QUARTER, SECOND_QUARTER
    )


def investigation_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{tag}' AS period, a.*, b.* FROM
          ({subscription_summary_sql(start, end, "region = 'EUROPE'")}) a, ({support_summary_sql(start, end, "EUROPE")}) b"""
        for tag, start, end in (("first", "1998-01-01", "1998-01-15"), ("second", "1998-01-16", "1998-01-31"))
    )
    return rows


@KPI.add(
    "region_investigation", investigation_sql(), ["customers", "subscriptions", f"support_tickets-{TICKET_SHIFT}"]
)
def region_investigation(spark, folder):
    return kpis.region_investigation(
        roles.subscriptions(spark, folder),
        roles.customers(spark, folder),
        roles.support_tickets(spark, folder, months_back=TICKET_SHIFT),
        Scope("1998-01-01", "1998-01-15", "EUROPE"),
        Scope("1998-01-16", "1998-01-31", "EUROPE"),
    )


BUSINESS_SQL = """
SELECT total_revenue, net_revenue, net_revenue / nullif(buyers, 0) AS average_revenue_per_customer, churn_rate,
  renewal_rate, active_subscriptions, discount / nullif(total_revenue, 0) AS average_discount_rate,
  infrastructure_cost, infrastructure_cost / nullif(net_revenue, 0) AS cost_to_revenue_ratio,
  net_revenue - infrastructure_cost AS estimated_gross_contribution, average_support_resolution_hours,
  average_satisfaction_score, customers
FROM
  (SELECT CAST(sum(gross_revenue) AS DOUBLE) AS total_revenue, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue,
    CAST(sum(discount_amount) AS DOUBLE) AS discount, count(DISTINCT customer_id) AS buyers FROM sales),
  (SELECT CAST(sum(CASE WHEN subscription_status = 'cancelled' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS churn_rate,
    CAST(sum(CASE WHEN renewal_date <= last_sale AND (end_date IS NULL OR end_date >= renewal_date) THEN 1 ELSE 0 END)
      AS DOUBLE) / nullif(sum(CASE WHEN renewal_date <= last_sale THEN 1 ELSE 0 END), 0) AS renewal_rate,
    count(*) FILTER (WHERE subscription_status = 'active') AS active_subscriptions
    FROM subscriptions, (SELECT max(sale_date) AS last_sale FROM sales)),
  (SELECT coalesce(CAST(sum(total_cost) AS DOUBLE), 0.0) AS infrastructure_cost FROM event_costs),
  (SELECT CAST(sum(resolution_hours) AS DOUBLE) / count(resolution_hours) AS average_support_resolution_hours,
    CAST(sum(satisfaction_score) AS DOUBLE) / count(satisfaction_score) AS average_satisfaction_score
    FROM support_tickets),
  (SELECT count(DISTINCT customer_id) AS customers FROM customers)"""


@KPI.add(
    "business_metrics", BUSINESS_SQL, ["customers", "subscriptions", "sales", "event_costs", "support_tickets"]
)
def business_metrics(spark, folder):
    return kpis.business_metrics(roles.business_tables(spark, folder))


@KPI.add(
    "monthly_ticket_trend",
    """SELECT CAST(date_trunc('month', created_date) AS DATE) AS month, count(ticket_id) AS ticket_count,
      count(DISTINCT customer_id) AS customers_with_tickets,
      CAST(sum(resolution_hours) AS DOUBLE) / count(resolution_hours) AS average_resolution_hours,
      CAST(sum(satisfaction_score) AS DOUBLE) / count(satisfaction_score) AS average_satisfaction
    FROM support_tickets GROUP BY 1""",
    ["support_tickets"],
)
def monthly_ticket_trend(spark, folder):
    return kpis.monthly_ticket_trend(roles.support_tickets(spark, folder))


CHURN_TREND_SQL = """
SELECT month, subscriptions_at_risk, cancellations,
  CAST(cancellations AS DOUBLE) / nullif(subscriptions_at_risk, 0) AS churn_rate
FROM (
  SELECT CAST(m AS DATE) AS month,
    count(*) FILTER (WHERE start_date < m + INTERVAL 1 MONTH AND (end_date IS NULL OR end_date >= m))
      AS subscriptions_at_risk,
    count(*) FILTER (WHERE subscription_status = 'cancelled' AND end_date >= m AND end_date < m + INTERVAL 1 MONTH)
      AS cancellations
  FROM (SELECT unnest(generate_series(first_month, last_month, INTERVAL 1 MONTH)) AS m FROM (
      SELECT date_trunc('month', min(start_date)) AS first_month,
        date_trunc('month', greatest(max(start_date), max(end_date))) AS last_month FROM subscriptions)),
    subscriptions
  GROUP BY m)"""


@KPI.add("monthly_churn_trend", CHURN_TREND_SQL, ["subscriptions"])
def monthly_churn_trend(spark, folder):
    return kpis.monthly_churn_trend(roles.subscriptions(spark, folder))


BEHAVIOR_SQL = """
SELECT s.customer_id, subscription_count, churned, coalesce(total_net_revenue, 0.0) AS total_net_revenue,
  coalesce(average_discount, 0.0) AS average_discount, coalesce(ticket_count, 0) AS ticket_count,
  average_resolution_hours, average_satisfaction
FROM (SELECT customer_id, count(*) AS subscription_count,
    max(CASE WHEN subscription_status = 'cancelled' THEN 1 ELSE 0 END) AS churned
    FROM subscriptions GROUP BY customer_id) s
LEFT JOIN (SELECT customer_id, CAST(sum(net_revenue) AS DOUBLE) AS total_net_revenue,
    CAST(sum(discount_amount) AS DOUBLE) / count(discount_amount) AS average_discount
    FROM sales GROUP BY customer_id) r USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS ticket_count,
    CAST(sum(resolution_hours) AS DOUBLE) / count(resolution_hours) AS average_resolution_hours,
    CAST(sum(satisfaction_score) AS DOUBLE) / nullif(count(satisfaction_score), 0) AS average_satisfaction
    FROM support_tickets GROUP BY customer_id) t USING (customer_id)"""


@KPI.add("customer_behavior", BEHAVIOR_SQL, ["subscriptions", "sales", "support_tickets"])
def customer_behavior(spark, folder):
    return kpis.customer_behavior(
        roles.sales(spark, folder), roles.subscriptions(spark, folder), roles.support_tickets(spark, folder)
    )


# The filtered view over three years, two regions and two plans.
VIEW_ARGS = ("1997-01-01", "1999-12-31", ("ASIA", "EUROPE"), ("Basic", "Professional"))
VIEW_ROLES = ["customers", "subscriptions", "sales", "shipping_costs"]
VIEW_CTES = """WITH
  picked_sales AS (SELECT * FROM sales WHERE sale_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
    AND region IN ('ASIA', 'EUROPE') AND plan_type IN ('Basic', 'Professional')),
  picked_subscriptions AS (SELECT * FROM subscriptions WHERE plan_type IN ('Basic', 'Professional')
    AND customer_id IN (SELECT customer_id FROM customers WHERE region IN ('ASIA', 'EUROPE'))),
  picked_costs AS (SELECT * FROM shipping_costs WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
    AND region IN ('ASIA', 'EUROPE'))"""
VIEW_CHURN = (
    f"SELECT * FROM ({CHURN_TREND_SQL.replace('subscriptions)', 'picked_subscriptions)').replace('    subscriptions\n', '    picked_subscriptions\n')})"
    " WHERE month BETWEEN DATE '1997-01-01' AND DATE '1999-12-01'"
)


def _view(spark, folder):
    tables = roles.business_tables(spark, folder).with_tables(cloud_costs=roles.shipping_costs(spark, folder))
    return kpis.filtered_view(tables, *VIEW_ARGS, check=False)


@KPI.add("view_revenue", f"{VIEW_CTES} {monthly_revenue_sql('picked_sales')}", VIEW_ROLES)
def view_revenue(spark, folder):
    return _view(spark, folder)["revenue"]


@KPI.add("view_churn", f"{VIEW_CTES} {VIEW_CHURN}", VIEW_ROLES)
def view_churn(spark, folder):
    return _view(spark, folder)["churn"]


@KPI.add("view_costs", f"{VIEW_CTES} {monthly_costs_sql('picked_costs')}", VIEW_ROLES)
def view_costs(spark, folder):
    return _view(spark, folder)["costs"]


@KPI.add(
    "view_region_metrics",
    f"{VIEW_CTES} {dimension_metrics_sql('region', 'picked_sales', 'picked_subscriptions')}",
    VIEW_ROLES,
)
def view_region_metrics(spark, folder):
    return _view(spark, folder)["region_metrics"]


@KPI.add(
    "view_plan_metrics",
    f"{VIEW_CTES} {dimension_metrics_sql('plan_type', 'picked_sales', 'picked_subscriptions')}",
    VIEW_ROLES,
)
def view_plan_metrics(spark, folder):
    return _view(spark, folder)["plan_metrics"]


HEADLINE_SQL = f"""{VIEW_CTES},
  revenue AS ({monthly_revenue_sql('picked_sales')}),
  churn AS ({VIEW_CHURN})
SELECT net_revenue, revenue_customers, infrastructure_cost, revenue_growth, latest_churn_rate,
  net_revenue - infrastructure_cost AS contribution,
  infrastructure_cost / nullif(net_revenue, 0) AS cost_to_revenue_ratio
FROM (SELECT CAST(sum(net_revenue) AS DOUBLE) AS net_revenue, count(DISTINCT customer_id) AS revenue_customers
    FROM picked_sales),
  (SELECT CAST(sum(total_cost) AS DOUBLE) AS infrastructure_cost FROM picked_costs),
  (SELECT CASE WHEN count(*) >= 2 THEN arg_max(net_revenue, month) / nullif(arg_min(net_revenue, month), 0) - 1 END
    AS revenue_growth FROM revenue),
  (SELECT arg_max(churn_rate, month) AS latest_churn_rate FROM churn WHERE churn_rate IS NOT NULL)"""


@KPI.add("view_headline", HEADLINE_SQL, VIEW_ROLES)
def view_headline(spark, folder):
    return _view(spark, folder)["headline"]


@KPI.add(
    "revenue_growth_window",
    f"""SELECT arg_max(net_revenue, month) / nullif(arg_min(net_revenue, month), 0) - 1 AS revenue_growth
    FROM ({monthly_revenue_sql()})""",
    ["sales"],
)
def revenue_growth_window(spark, folder):
    return kpis.growth_over_window(kpis.monthly_revenue(roles.sales(spark, folder)))


@KPI.add(
    "latest_churn_rate",
    f"SELECT arg_max(churn_rate, month) AS latest_churn_rate FROM ({CHURN_TREND_SQL}) WHERE churn_rate IS NOT NULL",
    ["subscriptions"],
)
def latest_churn_rate(spark, folder):
    return kpis.latest_rate(kpis.monthly_churn_trend(roles.subscriptions(spark, folder)))


TICKET_AVERAGES_SQL = """
SELECT CAST(sum(resolution_hours) AS DOUBLE) / nullif(count(resolution_hours), 0) AS average_resolution_hours,
  CAST(sum(satisfaction_score) AS DOUBLE) / nullif(count(satisfaction_score), 0) AS average_satisfaction
FROM support_tickets
WHERE created_date BETWEEN DATE '{start}' AND DATE '{end}'
  AND customer_id IN (SELECT customer_id FROM customers WHERE region IN ('ASIA', 'EUROPE'))
  AND customer_id IN (SELECT customer_id FROM subscriptions WHERE plan_type IN ('Basic', 'Professional'))"""


@KPI.add(
    "scoped_ticket_averages",
    TICKET_AVERAGES_SQL.format(start="2024-01-05", end="2024-01-25"),
    ["customers", "subscriptions", "support_tickets"],
)
def scoped_ticket_averages(spark, folder):
    return kpis.scoped_ticket_averages(
        roles.business_tables(spark, folder), "2024-01-05", "2024-01-25", *VIEW_ARGS[2:]
    )


@KPI.add(
    "plan_contingency",
    """SELECT plan_type, count(*) FILTER (WHERE subscription_status <> 'cancelled') AS not_cancelled,
      count(*) FILTER (WHERE subscription_status = 'cancelled') AS cancelled
    FROM subscriptions GROUP BY plan_type""",
    ["subscriptions"],
)
def plan_contingency(spark, folder):
    return kpis.plan_contingency(roles.subscriptions(spark, folder))


def metric_rows_sql() -> str:
    expressions = {
        "gross_revenue": "(SELECT sum(gross_revenue) FROM revenue)",
        "net_revenue": "(SELECT CAST(sum(net_revenue) AS DOUBLE) FROM picked_sales)",
        "revenue_growth": "(SELECT arg_max(net_revenue, month) / nullif(arg_min(net_revenue, month), 0) - 1 FROM revenue)",
        "discount_rate": "(SELECT sum(discount_amount) / nullif(sum(gross_revenue), 0) FROM revenue)",
        "infrastructure_cost": "(SELECT CAST(sum(total_cost) AS DOUBLE) FROM picked_costs)",
        "gpu_cost": "(SELECT CAST(sum(gpu_cost) AS DOUBLE) FROM picked_costs)",
        "cost_to_revenue_ratio": "(SELECT CAST(sum(total_cost) AS DOUBLE) FROM picked_costs)"
        " / nullif((SELECT CAST(sum(net_revenue) AS DOUBLE) FROM picked_sales), 0)",
        "estimated_gross_contribution": "(SELECT CAST(sum(net_revenue) AS DOUBLE) FROM picked_sales)"
        " - (SELECT CAST(sum(total_cost) AS DOUBLE) FROM picked_costs)",
        "churn_rate": "(SELECT arg_max(churn_rate, month) FROM churn WHERE churn_rate IS NOT NULL)",
        "customer_count": "(SELECT CAST(count(DISTINCT customer_id) AS DOUBLE) FROM picked_sales)",
        "subscription_count": "(SELECT CAST(max(subscriptions_at_risk) AS DOUBLE) FROM churn)",
        "renewal_rate": "(SELECT renewal_rate FROM business)",
        "average_resolution_hours": "(SELECT average_resolution_hours FROM averages)",
        "average_satisfaction": "(SELECT average_satisfaction FROM averages)",
    }
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value, '{kpis.UNITS[name]}' AS unit"
        for name, e in expressions.items()
    )
    return f"""{VIEW_CTES},
  revenue AS ({monthly_revenue_sql('picked_sales')}),
  churn AS ({VIEW_CHURN}),
  business AS ({BUSINESS_SQL}),
  averages AS ({TICKET_AVERAGES_SQL.format(start="1997-01-01", end="1999-12-31")})
{rows}"""


@KPI.add("metric_rows", metric_rows_sql(), [*VIEW_ROLES, "event_costs", f"support_tickets-{TICKET_SHIFT}"])
def metric_rows(spark, folder):
    tables = roles.business_tables(spark, folder, ticket_months_back=TICKET_SHIFT).with_tables(
        cloud_costs=roles.shipping_costs(spark, folder)
    )
    return kpis.metric_rows(tables, *VIEW_ARGS).withColumn("value", F.round("value", 6))


@KPI.add(
    "segment_rows",
    f"""SELECT 'region' AS dimension, region AS segment, net_revenue, churn_rate FROM ({dimension_metrics_sql('region')})
    UNION ALL SELECT 'plan_type', plan_type, net_revenue, churn_rate FROM ({dimension_metrics_sql('plan_type')})""",
    ["customers", "subscriptions", "sales"],
)
def segment_rows(spark, folder):
    return kpis.segment_rows(roles.business_tables(spark, folder), "1990-01-01", "2010-12-31")


# --- scopes ----------------------------------------------------------------------------------


@KPI.add(
    "sales_in_scope",
    """SELECT region, plan_type, count(*) AS n, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue FROM sales
    WHERE sale_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND region IN ('ASIA', 'EUROPE')
      AND plan_type IN ('Basic', 'Professional') GROUP BY ALL""",
    ["sales"],
)
def sales_in_scope(spark, folder):
    picked = sc.pick_sales(roles.sales(spark, folder), *VIEW_ARGS)
    return picked.groupBy("region", "plan_type").agg(
        F.count("*").alias("n"), F.sum("net_revenue").cast("double").alias("net_revenue")
    )


@KPI.add(
    "subscriptions_in_scope",
    """SELECT subscription_id, customer_id, plan_type FROM subscriptions WHERE plan_type = 'Enterprise'
    AND customer_id IN (SELECT customer_id FROM customers WHERE region IN ('ASIA', 'EUROPE'))""",
    ["customers", "subscriptions"],
)
def subscriptions_in_scope(spark, folder):
    return sc.pick_subscriptions(
        roles.subscriptions(spark, folder), roles.customers(spark, folder), ("ASIA", "EUROPE"), ("Enterprise",)
    ).select("subscription_id", "customer_id", "plan_type")


@KPI.add(
    "subscriptions_in_segment",
    """SELECT subscription_id, customer_id, region, plan_type FROM subscriptions JOIN customers USING (customer_id)
    WHERE region = 'EUROPE' AND plan_type = 'Professional'""",
    ["customers", "subscriptions"],
)
def subscriptions_in_segment(spark, folder):
    return sc.subscriptions_in_segment(
        roles.subscriptions(spark, folder), roles.customers(spark, folder), EUROPE_PROFESSIONAL
    ).select("subscription_id", "customer_id", "region", "plan_type")


@KPI.add(
    "costs_in_scope",
    f"SELECT cost_id, CAST(total_cost AS DOUBLE) AS total_cost FROM shipping_costs WHERE {COST_YEAR} AND region = 'ASIA'",
    ["shipping_costs"],
)
def costs_in_scope(spark, folder):
    picked = sc.pick_costs(roles.shipping_costs(spark, folder), "1998-01-01", "1998-12-31", ("ASIA",))
    return picked.select("cost_id", F.col("total_cost").cast("double").alias("total_cost"))


@KPI.add(
    "scope_tables",
    """SELECT 'customers' AS table_name, count(*) AS n FROM customers WHERE industry IN ('MACHINERY', 'BUILDING')
    UNION ALL SELECT 'subscriptions', count(*) FROM subscriptions WHERE customer_id IN
      (SELECT customer_id FROM customers WHERE industry IN ('MACHINERY', 'BUILDING'))
    UNION ALL SELECT 'sales', count(*) FROM sales WHERE customer_id IN
      (SELECT customer_id FROM customers WHERE industry IN ('MACHINERY', 'BUILDING'))
    UNION ALL SELECT 'cloud_costs', count(*) FROM event_costs
    UNION ALL SELECT 'support_tickets', count(*) FROM support_tickets WHERE customer_id IN
      (SELECT customer_id FROM customers WHERE industry IN ('MACHINERY', 'BUILDING'))""",
    ["customers", "subscriptions", "sales", "event_costs", "support_tickets"],
)
def scope_tables(spark, folder):
    from tallygrain.operators.contracts import row_counts

    scoped = sc.scope_tables(roles.business_tables(spark, folder), ("MACHINERY", "BUILDING"), check=False)
    return row_counts(scoped).select(F.col("table").alias("table_name"), F.col("rows").alias("n"))


@KPI.add(
    "unknown_customers",
    "SELECT DISTINCT user_id * 50 AS customer_id FROM events WHERE user_id * 50 NOT IN (SELECT c_custkey FROM customer)",
)
def unknown_customers(spark, folder):
    requested = roles.table(spark, folder, "events").select((F.col("user_id") * 50).alias("customer_id"))
    return sc.unknown_customers(roles.customers(spark, folder), requested)


@KPI.add(
    "parameterised_select",
    """SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_totalprice >= 250000
    AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01' GROUP BY o_orderpriority""",
)
def parameterised_select(spark, folder):
    from datetime import date

    return sc.select_with(
        spark,
        """SELECT o_orderpriority AS priority, count(*) AS n FROM {orders}
        WHERE o_totalprice >= :floor AND o_orderdate >= :first GROUP BY o_orderpriority""",
        {"floor": 250000, "first": date(1998, 1, 1)},
        orders=roles.table(spark, folder, "orders"),
    )


@KPI.add(
    "date_bounds",
    "SELECT min(sale_date) AS start_date, last_day(max(sale_date)) AS end_date FROM sales",
    ["sales"],
)
def date_bounds(spark, folder):
    return sc.date_bounds(roles.sale_lines(spark, folder))


@KPI.add(
    "members_plan_type", "SELECT DISTINCT plan_type FROM subscriptions WHERE plan_type IS NOT NULL", ["subscriptions"]
)
def members_plan_type(spark, folder):
    return sc.members(roles.subscriptions(spark, folder), "plan_type")


@KPI.add("members_region", "SELECT DISTINCT region FROM customers WHERE region IS NOT NULL", ["customers"])
def members_region(spark, folder):
    return sc.members(roles.customers(spark, folder), "region")
