"""Registry of queries and the SQL form of the star-schema roles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries, each with its SQL where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, roles: Iterable[str] = ()) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"Query {name!r} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = with_roles(sql, roles)
            return query

        return register


ROLE_SQL = {
    "customers": """
    customers AS (
      SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, r.r_name AS region, n.n_name AS country,
        c.c_mktsegment AS industry,
        CASE WHEN c.c_acctbal < 2500 THEN 'Small' WHEN c.c_acctbal < 7500 THEN 'Medium' ELSE 'Enterprise' END
          AS company_size,
        CASE c.c_custkey % 4 WHEN 0 THEN 'Direct' WHEN 1 THEN 'Online' WHEN 2 THEN 'Partner' ELSE 'Referral' END
          AS acquisition_channel,
        h.signup_date,
        CASE WHEN h.any_active THEN 'active' ELSE 'inactive' END AS customer_status
      FROM customer c
      JOIN nation n ON n.n_nationkey = c.c_nationkey
      JOIN region r ON r.r_regionkey = n.n_regionkey
      LEFT JOIN (
        SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS signup_date, bool_or(o_orderstatus = 'O') AS any_active
        FROM orders GROUP BY o_custkey
      ) h ON h.o_custkey = c.c_custkey
    )""",
    "subscriptions": """
    subscriptions AS (
      SELECT o_orderkey AS subscription_id, o_custkey AS customer_id,
        CASE WHEN o_totalprice < 125000 THEN 'Basic' WHEN o_totalprice < 350000 THEN 'Professional'
          ELSE 'Enterprise' END AS plan_type,
        CAST(o_orderdate AS DATE) AS start_date,
        CAST(o_orderdate AS DATE) + 365 AS renewal_date,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(75 + o_orderkey % 445 AS INTEGER) END
          AS end_date,
        CAST(o_totalprice AS DECIMAL(14,2)) AS monthly_price,
        CAST(1 + o_orderkey % 420 AS INTEGER) AS seats,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'cancelled' ELSE 'expired' END AS subscription_status
      FROM orders
    )""",
    "sales": """
    sales AS (
      SELECT l.l_orderkey || '-' || l.l_linenumber AS sale_id, o.o_custkey AS customer_id,
        l.l_orderkey AS subscription_id, CAST(l.l_shipdate AS DATE) AS sale_date, r.r_name AS region,
        CASE WHEN o.o_totalprice < 125000 THEN 'Basic' WHEN o.o_totalprice < 350000 THEN 'Professional'
          ELSE 'Enterprise' END AS plan_type,
        CAST(l.l_extendedprice AS DECIMAL(14,2)) AS gross_revenue,
        CAST(l.l_extendedprice AS DECIMAL(14,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS discount_amount,
        CAST(l.l_extendedprice AS DECIMAL(14,2))
          - CAST(l.l_extendedprice AS DECIMAL(14,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS net_revenue,
        l.l_returnflag AS sales_channel
      FROM lineitem l
      JOIN orders o ON o.o_orderkey = l.l_orderkey
      JOIN customer c ON c.c_custkey = o.o_custkey
      JOIN nation n ON n.n_nationkey = c.c_nationkey
      JOIN region r ON r.r_regionkey = n.n_regionkey
    )""",
    "event_costs": """
    event_costs AS (
      SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS cost_id, CAST(ts AS DATE) AS date, 'ALL' AS region,
        'events' AS service_type,
        coalesce(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(14,2)) END), 0) AS compute_cost,
        coalesce(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(14,2)) END), 0) AS storage_cost,
        coalesce(sum(CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(14,2)) END), 0) AS network_cost,
        coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(14,2)) END), 0) AS gpu_cost,
        sum(CAST(value AS DECIMAL(14,2))) AS total_cost
      FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')
      GROUP BY CAST(ts AS DATE)
    )""",
    "shipping_costs": """
    shipping_lines AS (
      SELECT CAST(l.l_shipdate AS DATE) AS date, r.r_name AS region, l.l_returnflag AS flag, l.l_linestatus AS status,
        CAST(l.l_extendedprice AS DECIMAL(14,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS tax
      FROM lineitem l
      JOIN supplier s ON s.s_suppkey = l.l_suppkey
      JOIN nation n ON n.n_nationkey = s.s_nationkey
      JOIN region r ON r.r_regionkey = n.n_regionkey
    ),
    shipping_costs AS (
      SELECT strftime(date, '%Y-%m-%d') || '-' || region AS cost_id, date, region, 'shipping' AS service_type,
        coalesce(sum(CASE WHEN flag = 'A' AND status = 'O' THEN tax END), 0) AS compute_cost,
        coalesce(sum(CASE WHEN flag = 'N' THEN tax END), 0) AS storage_cost,
        coalesce(sum(CASE WHEN flag = 'A' AND status = 'F' THEN tax END), 0) AS network_cost,
        coalesce(sum(CASE WHEN flag = 'R' THEN tax END), 0) AS gpu_cost,
        sum(tax) AS total_cost
      FROM shipping_lines GROUP BY date, region
    )""",
}


def _tickets_sql(months_back: int) -> str:
    created = "CAST(ts AS DATE)" if not months_back else f"CAST(CAST(ts AS DATE) - INTERVAL {months_back} MONTH AS DATE)"
    return f"""
    support_tickets AS (
      SELECT event_id AS ticket_id, user_id AS customer_id, {created} AS created_date,
        CASE WHEN event_id % 50 <> 0 THEN {created} + CAST(event_id % 7 AS INTEGER) END AS resolved_date,
        event_type AS ticket_category,
        CASE WHEN k < 26 THEN 'Low' WHEN k < 72 THEN 'Medium' WHEN k < 95 THEN 'High' ELSE 'Critical' END AS severity,
        CAST(value AS DECIMAL(12,2)) AS resolution_hours,
        CASE WHEN event_id % 12 <> 0 THEN CAST(least(greatest(
          CAST(5.15 AS DECIMAL(8,5)) - CAST(0.055 AS DECIMAL(4,3)) * CAST(value AS DECIMAL(12,2)),
          CAST(1 AS DECIMAL(8,5))), CAST(5 AS DECIMAL(8,5))) AS DECIMAL(8,5)) END AS satisfaction_score,
        CASE WHEN event_id % 50 = 0 THEN 'open' ELSE 'resolved' END AS status
      FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
    )"""


def with_roles(sql: str, roles: Iterable[str]) -> str:
    """Prefix a query with the CTEs of its roles. ``support_tickets-288`` shifts tickets back 288 months."""
    parts = []
    for role in roles:
        if role.startswith("support_tickets"):
            parts.append(_tickets_sql(int(role.partition("-")[2] or 0)))
        else:
            parts.append(ROLE_SQL[role])
    body = sql.strip()
    if not parts:
        return body
    roles_text = ",".join(parts).strip()
    for opening in ("WITH RECURSIVE", "WITH"):
        if body.startswith(opening):
            return f"{opening} {roles_text},\n{body[len(opening):].strip()}"
    return f"WITH {roles_text}\n{body}"


def rounded(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns whose last bits depend on the order floating-point values are summed in."""
    return frame.withColumns({c: F.round(c, digits) for c in columns})
