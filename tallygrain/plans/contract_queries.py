"""Registered contract and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import cleaning, contracts
from tallygrain.plans.base import Registry
from tallygrain.plans.kpi_queries import REGIONS
from tallygrain.schemas import ALLOWED_VALUES, FOREIGN_KEYS
from tallygrain.sources import roles

CONTRACTS = Registry()

# The contract of the star-schema roles: their regions, everything else as declared.
ALLOWED = {**ALLOWED_VALUES, ("customers", "region"): REGIONS}
BROKEN_ALLOWED = {**ALLOWED, ("customers", "region"): ("ASIA", "EUROPE"), ("support_tickets", "severity"): ("Low",)}
ALL_ROLES = ["customers", "subscriptions", "sales", "event_costs", "support_tickets"]


def _rule(table: str, rule: str, count: str, severity: str = "error") -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{rule}' AS rule, '{severity}' AS severity, "
        f"CAST(({count}) AS BIGINT) AS violations"
    )


def _counted(table: str, source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        _rule(table, rule, f"SELECT count(*) FILTER (WHERE {broken}) FROM {source}") for rule, broken in rules.items()
    )


SOURCES = {"cloud_costs": "event_costs"}
KEYS = {
    "customers": "customer_id",
    "subscriptions": "subscription_id",
    "sales": "sale_id",
    "cloud_costs": "cost_id",
    "support_tickets": "ticket_id",
}


def key_sql() -> str:
    parts = []
    for table, key in KEYS.items():
        source = SOURCES.get(table, table)
        parts.append(_rule(table, f"{key} is null", f"SELECT count(*) - count({key}) FROM {source}"))
        parts.append(_rule(table, f"{key} repeats", f"SELECT count({key}) - count(DISTINCT {key}) FROM {source}"))
    return " UNION ALL ".join(parts)


def member_sql(allowed) -> str:
    return " UNION ALL ".join(
        _counted(
            table,
            SOURCES.get(table, table),
            {f"{column} has an unexpected value": f"{column} NOT IN ({', '.join(repr(m) for m in members)})"},
        )
        for (table, column), members in allowed.items()
    )


def relation_sql() -> str:
    return " UNION ALL ".join(
        _rule(
            child,
            f"{name} has no parent",
            f"SELECT count(*) FROM {child} c LEFT JOIN {parent} p ON p.{key} = c.{column} WHERE p.{key} IS NULL",
        )
        for name, (child, column, parent, key) in FOREIGN_KEYS.items()
    )


SUBSCRIPTION_SQL = _counted(
    "subscriptions",
    "subscriptions",
    {
        "end_date does not fit the status": "(subscription_status = 'active') = (end_date IS NOT NULL)",
        "renewal_date is before start_date": "renewal_date < start_date",
        "end_date is before start_date": "end_date < start_date",
        "price or seats is not positive": "monthly_price <= 0 OR seats <= 0",
    },
)
TICKET_SQL = _counted(
    "support_tickets",
    "support_tickets",
    {
        "resolved_date does not fit the status": "(status = 'open') = (resolved_date IS NOT NULL)",
        "resolved_date is before created_date": "resolved_date < created_date",
        "satisfaction_score is outside 1 to 5": "satisfaction_score NOT BETWEEN 1 AND 5",
        "resolution_hours is not positive": "resolution_hours <= 0",
    },
)
STATUS_SQL = _counted(
    "customers",
    "(SELECT c.customer_status, s.expected FROM customers c LEFT JOIN (SELECT customer_id,"
    " CASE WHEN bool_or(subscription_status = ''active'') THEN ''active'' ELSE ''inactive'' END AS expected"
    " FROM subscriptions GROUP BY customer_id) s USING (customer_id))".replace("''", "'"),
    {"customer_status does not fit the subscriptions": "customer_status IS DISTINCT FROM expected"},
)
OWNED = (
    "(SELECT s.customer_id, s.plan_type, s.region, u.customer_id AS owner, u.plan_type AS owner_plan,"
    " c.region AS owner_region FROM sales s LEFT JOIN subscriptions u USING (subscription_id)"
    " LEFT JOIN customers c ON c.customer_id = s.customer_id)"
)
OWNER_SQL = _counted(
    "sales",
    OWNED,
    {
        "customer_id does not match the subscription": "customer_id IS DISTINCT FROM owner",
        "plan_type does not match the subscription": "plan_type IS DISTINCT FROM owner_plan",
        "region does not match the customer": "region IS DISTINCT FROM owner_region",
    },
)
SALES_SQL = _counted(
    "sales",
    "sales",
    {
        "an amount is negative": "gross_revenue < 0 OR discount_amount < 0 OR net_revenue < 0",
        "net_revenue does not reconcile": "abs(gross_revenue - discount_amount - net_revenue)"
        " > CAST(0.02 AS DECIMAL(4,2)) + CAST(0.00001 AS DECIMAL(6,5)) * abs(net_revenue)",
    },
)
COMPONENTS = "compute_cost + storage_cost + network_cost + gpu_cost"
COST_SQL = _counted(
    "cloud_costs",
    "event_costs",
    {
        "total_cost does not reconcile": f"abs({COMPONENTS} - total_cost)"
        " > 0.03 + 0.00001 * abs(total_cost)"
    },
)
DUPLICATES = (
    "SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM support_tickets GROUP BY customer_id,"
    " created_date, resolved_date, ticket_category, severity, resolution_hours, satisfaction_score, status)"
)
CELLS = {
    "customers": "customer_id customer_name region country industry company_size acquisition_channel signup_date customer_status",
    "subscriptions": "subscription_id customer_id plan_type start_date renewal_date end_date monthly_price seats subscription_status",
    "sales": "sale_id customer_id subscription_id sale_date region plan_type gross_revenue discount_amount net_revenue sales_channel",
    "cloud_costs": "cost_id date region service_type compute_cost storage_cost network_cost gpu_cost total_cost",
    "support_tickets": "ticket_id customer_id created_date resolved_date ticket_category severity resolution_hours satisfaction_score status",
}


def warning_sql() -> str:
    parts = [_rule("support_tickets", "duplicate business records", DUPLICATES, "warning")]
    for table, columns in CELLS.items():
        nulls = " + ".join(f"(count(*) - count({c}))" for c in columns.split())
        parts.append(_rule(table, "missing values", f"SELECT {nulls} FROM {SOURCES.get(table, table)}", "warning"))
    return " UNION ALL ".join(parts)


VALIDATE_SQL = " UNION ALL ".join(
    [
        key_sql(), member_sql(ALLOWED), relation_sql(), SUBSCRIPTION_SQL, TICKET_SQL, STATUS_SQL, OWNER_SQL, SALES_SQL,
        COST_SQL, warning_sql(),
    ]
)


@CONTRACTS.add("contract_keys", key_sql(), ALL_ROLES)
def contract_keys(spark, folder):
    tables = roles.business_tables(spark, folder)
    return contracts._union([contracts.key_rules(frame, name, KEYS[name]) for name, frame in tables.items()])


@CONTRACTS.add("contract_members", member_sql(BROKEN_ALLOWED), ALL_ROLES)
def contract_members(spark, folder):
    return contracts.member_rules(roles.business_tables(spark, folder), BROKEN_ALLOWED)


@CONTRACTS.add(
    "unexpected_values",
    """SELECT 'customers' AS "table", 'region' AS "column", region AS value, count(*) AS violations FROM customers
    WHERE region NOT IN ('ASIA', 'EUROPE') GROUP BY region""",
    ["customers"],
)
def unexpected_values(spark, folder):
    return contracts.unexpected_values(roles.customers(spark, folder), "customers", "region", ("ASIA", "EUROPE"))


@CONTRACTS.add("contract_relations", relation_sql(), ["customers", "subscriptions", "sales", "support_tickets"])
def contract_relations(spark, folder):
    return contracts.relation_rules(roles.business_tables(spark, folder))


@CONTRACTS.add(
    "orphan_parts",
    _rule("lineitem", "line_part has no parent", "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)"),
)
def orphan_parts(spark, folder):
    parts = roles.table(spark, folder, "part").filter("p_size > 10")
    return contracts.orphan_rule(
        roles.table(spark, folder, "lineitem"), "l_partkey", parts, "p_partkey", "lineitem", "line_part"
    )


@CONTRACTS.add("contract_subscriptions", SUBSCRIPTION_SQL, ["subscriptions"])
def contract_subscriptions(spark, folder):
    return contracts.subscription_rules(roles.subscriptions(spark, folder))


@CONTRACTS.add("contract_tickets", TICKET_SQL, ["support_tickets"])
def contract_tickets(spark, folder):
    return contracts.ticket_rules(roles.support_tickets(spark, folder))


@CONTRACTS.add("contract_status", STATUS_SQL, ["customers", "subscriptions"])
def contract_status(spark, folder):
    return contracts.status_rule(roles.customers(spark, folder), roles.subscriptions(spark, folder))


@CONTRACTS.add("contract_owners", OWNER_SQL, ["customers", "subscriptions", "sales"])
def contract_owners(spark, folder):
    tables = roles.business_tables(spark, folder)
    return contracts.owner_rules(tables.sales, tables.subscriptions, tables.customers)


@CONTRACTS.add("contract_sales", SALES_SQL, ["sales"])
def contract_sales(spark, folder):
    return contracts.sales_rules(roles.sale_lines(spark, folder))


@CONTRACTS.add("contract_costs", COST_SQL, ["event_costs"])
def contract_costs(spark, folder):
    return contracts.cost_rules(roles.event_costs(spark, folder))


@CONTRACTS.add("contract_warnings", warning_sql(), ALL_ROLES)
def contract_warnings(spark, folder):
    return contracts.warnings(roles.business_tables(spark, folder))


@CONTRACTS.add("validate", VALIDATE_SQL, ALL_ROLES)
def validate(spark, folder):
    return contracts.validate(roles.business_tables(spark, folder), allowed=ALLOWED)


CHECKS = {
    "subscriptions": {
        "price is positive": "NOT monthly_price > 0",
        "seats are positive": "NOT seats > 0",
        "renewal follows start": "NOT renewal_date >= start_date",
        "end fits status": "NOT ((subscription_status = 'active' AND end_date IS NULL)"
        " OR (subscription_status <> 'active' AND end_date IS NOT NULL))",
    },
    "sales": {
        "gross is not negative": "gross_revenue < 0",
        "discount is not negative": "discount_amount < 0",
        "net is not negative": "net_revenue < 0",
        "discount is within gross": "discount_amount > gross_revenue",
        "net reconciles": "abs(gross_revenue - discount_amount - net_revenue) > 0.02",
    },
    "cloud_costs": {
        "costs are not negative": "least(compute_cost, storage_cost, network_cost, gpu_cost, total_cost) < 0",
        "total reconciles": f"abs({COMPONENTS} - total_cost) > 0.03",
    },
    "support_tickets": {
        "hours are positive": "resolution_hours <= 0",
        "score is 1 to 5": "satisfaction_score NOT BETWEEN 1 AND 5",
        "resolution fits status": "NOT ((status = 'resolved' AND resolved_date IS NOT NULL)"
        " OR (status = 'open' AND resolved_date IS NULL))",
        "resolution follows creation": "resolved_date < created_date",
    },
}


def constraint_sql() -> str:
    rules = {table: dict(checks) for table, checks in CHECKS.items()}
    for (table, column), members in BROKEN_ALLOWED.items():
        listed = ", ".join(repr(m) for m in members)
        rules.setdefault(table, {})[f"{column} is allowed"] = f"{column} NOT IN ({listed})"
    return " UNION ALL ".join(_counted(t, SOURCES.get(t, t), checks) for t, checks in rules.items())


@CONTRACTS.add("check_constraints", constraint_sql(), ALL_ROLES)
def check_constraints(spark, folder):
    return contracts.check_constraints(roles.business_tables(spark, folder), allowed=BROKEN_ALLOWED)


@CONTRACTS.add(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {SOURCES.get(t, t)}" for t in KEYS),
    ALL_ROLES,
)
def row_counts(spark, folder):
    return contracts.row_counts(roles.business_tables(spark, folder))


# Sales come without two of their columns.
@CONTRACTS.add(
    "structure_report",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, '{'net_revenue,sales_channel' if t == 'sales' else ''}' AS missing_columns"
        f" FROM {SOURCES.get(t, t)}"
        for t in KEYS
    ),
    ALL_ROLES,
)
def structure_report(spark, folder):
    frames = dict(roles.business_tables(spark, folder).items())
    frames["sales"] = frames["sales"].drop("net_revenue", "sales_channel")
    return contracts.structure_report(frames)


PATTERN = r"(?i)\bthe\b|@|brand#1"


@CONTRACTS.add(
    "pattern_audit",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\","
        f" count(*) FILTER (WHERE regexp_matches({c}, '(?i)\\bthe\\b|@|brand#1')) AS matches FROM {t}"
        for t, c in (
            ("documents", "text"), ("documents", "lang"), ("documents", "source"), ("part", "p_name"),
            ("part", "p_brand"), ("part", "p_type"), ("conversations", "role"), ("conversations", "text"),
        )
    ),
)
def pattern_audit(spark, folder):
    frames = {name: roles.table(spark, folder, name) for name in ("documents", "part", "conversations")}
    return contracts.pattern_audit(frames, PATTERN)


DUPLICATE_DOCS_SQL = """
SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang"""


@CONTRACTS.add("drop_duplicate_documents", DUPLICATE_DOCS_SQL)
def drop_duplicate_documents(spark, folder):
    documents = roles.table(spark, folder, "documents").select("doc_id", "text", "lang")
    return cleaning.drop_duplicate_events(documents, "doc_id")


@CONTRACTS.add(
    "duplicate_documents",
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
)
def duplicate_documents(spark, folder):
    documents = roles.table(spark, folder, "documents").select("doc_id", "text", "lang")
    return cleaning.duplicate_events(documents, "doc_id")


@CONTRACTS.add(
    "drop_duplicate_tickets",
    """SELECT * FROM (SELECT customer_id, created_date, resolved_date, ticket_category, severity,
      CAST(resolution_hours AS DOUBLE) AS resolution_hours, CAST(satisfaction_score AS DOUBLE) AS satisfaction_score,
      status, min(ticket_id) AS ticket_id FROM support_tickets
      GROUP BY customer_id, created_date, resolved_date, ticket_category, severity, support_tickets.resolution_hours,
        support_tickets.satisfaction_score, status)""",
    ["support_tickets"],
)
def drop_duplicate_tickets(spark, folder):
    kept = cleaning.drop_duplicate_events(roles.support_tickets(spark, folder), "ticket_id")
    return kept.withColumns({c: F.col(c).cast("double") for c in ("resolution_hours", "satisfaction_score")})


# Every third industry is blanked, so that the filling has something to do.
BLANKED = "CASE WHEN customer_id % 3 <> 0 THEN industry END"


def _with_gaps(tables):
    return tables.with_tables(
        customers=tables.customers.withColumn(
            "industry", F.when(F.col("customer_id") % 3 != 0, F.col("industry"))
        )
    )


@CONTRACTS.add(
    "fill_missing_industry",
    f"SELECT customer_id, coalesce({BLANKED}, 'Unknown') AS industry FROM customers",
    ["customers"],
)
def fill_missing_industry(spark, folder):
    gaps = _with_gaps(roles.business_tables(spark, folder)).customers
    return cleaning.fill_missing(gaps.select("customer_id", "industry"), "industry")


def cleaning_sql() -> str:
    parts = []
    for table in KEYS:
        source = SOURCES.get(table, table)
        after = (
            f"(SELECT DISTINCT {', '.join(CELLS[table].split()[1:])} FROM support_tickets)"
            if table == "support_tickets"
            else source
        )
        parts.append((table, "rows_before", f"SELECT count(*) FROM {source}"))
        parts.append((table, "rows_after", f"SELECT count(*) FROM {after}"))
    parts.append(("customers", "industries_filled", f"SELECT count(*) - count({BLANKED}) FROM customers"))
    parts.append(("support_tickets", "duplicates_removed", DUPLICATES))
    distinct = f"(SELECT DISTINCT {', '.join(CELLS['support_tickets'].split()[1:])} FROM support_tickets)"
    parts.append(
        ("support_tickets", "scores_left_missing", f"SELECT count(*) - count(satisfaction_score) FROM {distinct}")
    )
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{m}' AS measure, CAST(({q}) AS BIGINT) AS value" for t, m, q in parts
    )


@CONTRACTS.add("cleaning_report", cleaning_sql(), ALL_ROLES)
def cleaning_report(spark, folder):
    raw = _with_gaps(roles.business_tables(spark, folder))
    return cleaning.cleaning_report(raw, cleaning.clean_tables(raw))


@CONTRACTS.add(
    "split_bad_dates",
    """SELECT count(*) FILTER (WHERE text_date IS NOT NULL AND TRY_CAST(text_date AS DATE) IS NULL) AS rejected,
      count(*) FILTER (WHERE text_date IS NULL OR TRY_CAST(text_date AS DATE) IS NOT NULL) AS kept,
      min(TRY_CAST(text_date AS DATE)) AS first_date
    FROM (SELECT CASE WHEN event_id % 7 = 0 THEN '2024-13-45' ELSE strftime(CAST(ts AS DATE), '%Y-%m-%d') END
      AS text_date FROM events)""",
)
def split_bad_dates(spark, folder):
    events = roles.table(spark, folder, "events").select(
        F.when(F.col("event_id") % 7 == 0, "2024-13-45")
        .otherwise(F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd"))
        .alias("text_date")
    )
    good, bad = cleaning.split_bad_dates(events, ("text_date",))
    from tallygrain.functions.exprs import side_by_side

    return side_by_side(
        bad.agg(F.count("*").alias("rejected")),
        good.agg(F.count("*").alias("kept"), F.min("text_date").alias("first_date")),
    )


@CONTRACTS.add(
    "typed_dates",
    """SELECT CAST(strftime(CAST(ts AS DATE), '%Y-%m-%d') AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""",
)
def typed_dates(spark, folder):
    text = roles.table(spark, folder, "events").select(
        F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd").alias("day")
    )
    return cleaning.typed_dates(text, ("day",)).groupBy("day").agg(F.count("*").alias("n"))
