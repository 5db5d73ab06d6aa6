"""Contract rules as queries: one row ``(table, rule, severity, violations)`` per rule.

Row-local rules of a table share one pass, and ``validate`` finds keys, owners, repeated events and row rules of a table
in the same scan. Relations are checked on distinct keys, so a key that owns a large share of a fact table reaches the
join once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain.functions.exprs import any_true, side_by_side, tally
from tallygrain.operators.cleaning import duplicate_events
from tallygrain.schemas import (
    ALLOWED_VALUES,
    COST_COLUMNS,
    COST_COMPONENTS,
    FOREIGN_KEYS,
    PRIMARY_KEYS,
    SCHEMAS,
    Tables,
)
from tallygrain.session import materialize

ERROR, WARNING = "error", "warning"
RESULT_SCHEMA = "table string, rule string, severity string, violations bigint"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _result(frame: DataFrame, table: str, rule: str, severity: str, violations: Column | str) -> DataFrame:
    return frame.select(
        F.lit(table).alias("table"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.coalesce(F.col(violations) if isinstance(violations, str) else violations, F.lit(0))
        .cast("bigint")
        .alias("violations"),
    )


def _one_pass(frame: DataFrame, table: str, rules: Mapping[str, Column], severity: str = ERROR) -> DataFrame:
    """Evaluate row-local rules of one table in a single aggregation."""
    counted = frame.agg(*[tally(broken).alias(name) for name, broken in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations").select(
        F.lit(table).alias("table"), "rule", F.lit(severity).alias("severity"), "violations"
    )


def differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def structure(frames: Mapping[str, DataFrame]) -> DataFrame:
    """V1: missing tables and columns, read from the schemas alone."""
    rows = []
    for table, schema in SCHEMAS.items():
        if table not in frames:
            rows.append((table, "missing table", ERROR, 1))
            continue
        for name in sorted(set(schema.fieldNames()) - set(frames[table].columns)):
            rows.append((table, f"missing column {name}", ERROR, 1))
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def structure_report(frames: Mapping[str, DataFrame]) -> DataFrame:
    """V1: per expected table its rows (null if the table is missing) and the columns it lacks, comma-joined."""
    parts = []
    for table, schema in SCHEMAS.items():
        lacking = sorted(set(schema.fieldNames()) - set(frames[table].columns if table in frames else ()))
        if table in frames:
            counted = frames[table].agg(F.count("*").alias("rows"))
        else:
            counted = next(iter(frames.values())).sparkSession.range(1).select(F.lit(None).cast("long").alias("rows"))
        parts.append(counted.select(F.lit(table).alias("table"), "rows", F.lit(",".join(lacking)).alias("missing_columns")))
    return _union(parts)


def key_rules(frame: DataFrame, table: str, key: str) -> DataFrame:
    """V2: null keys, and rows beyond the first of each key."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("n"))
    counted = per_key.agg(
        F.sum(F.when(F.col(key).isNull(), F.col("n"))).alias("null_key"),
        F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)).alias("repeated_key"),
    )
    return _result(counted, table, f"{key} is null", ERROR, "null_key").unionByName(
        _result(counted, table, f"{key} repeats", ERROR, "repeated_key")
    )


def unexpected_values(frame: DataFrame, table: str, column: str, allowed: Sequence[str]) -> DataFrame:
    """V3: the members outside the allowed set, with their row counts."""
    return (
        frame.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("violations"))
        .select(F.lit(table).alias("table"), F.lit(column).alias("column"), "value", "violations")
    )


def _member_rules(table: str, allowed: Mapping[tuple[str, str], Sequence[str]]) -> dict[str, Column]:
    return {
        f"{column} has an unexpected value": F.col(column).isNotNull() & ~F.col(column).isin(*members)
        for (owner, column), members in allowed.items()
        if owner == table
    }


def member_rules(tables: Tables, allowed: Mapping[tuple[str, str], Sequence[str]] = ALLOWED_VALUES) -> DataFrame:
    """V3: rows with a member outside its allowed set; nulls are not judged."""
    rules = {name: _member_rules(name, allowed) for name, _ in tables.items()}
    return _union([_one_pass(frame, name, rules[name]) for name, frame in tables.items() if rules[name]])


def orphan_rule(
    child: DataFrame, column: str, parent: DataFrame, key: str, table: str, name: str, *, weight: str | None = None
) -> DataFrame:
    """V4: child rows whose reference has no parent; a null reference counts as one.

    ``weight`` names the row count of a child that is grouped already.
    """
    rows = F.sum(weight) if weight else F.count("*")
    per_key = child.groupBy(F.col(column).alias("_key")).agg(rows.alias("n"))
    orphans = per_key.join(parent.select(F.col(key).alias("_key")), "_key", "left_anti")
    return _result(orphans.agg(F.sum("n").alias("n")), table, f"{name} has no parent", ERROR, "n")


# Columns of a fact table that name its owners.
OWNERS = {
    "subscriptions": ("customer_id",),
    "sales": ("subscription_id", "customer_id", "plan_type", "region"),
    "support_tickets": ("customer_id",),
}


def _sale_owners(sales: DataFrame) -> DataFrame:
    """Distinct owners named on sales with their row count. Rules built on it share its shuffle."""
    return sales.groupBy(*OWNERS["sales"]).agg(F.count("*").alias("n"))


def relation_rules(tables: Tables, owners: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """V4 for every relation. ``owners`` names children that are grouped by owner already, with row count ``n``."""
    frames = dict(tables.items())
    grouped = owners or {"sales": _sale_owners(tables.sales)}
    return _union(
        [
            orphan_rule(
                grouped.get(child, frames[child]), column, frames[parent], key, child, name,
                weight="n" if child in grouped else None,
            )
            for name, (child, column, parent, key) in FOREIGN_KEYS.items()
        ]
    )


def _subscription_rules() -> dict[str, Column]:
    active, ended = F.col("subscription_status") == "active", F.col("end_date").isNotNull()
    return {
        "end_date does not fit the status": F.coalesce(active, F.lit(False)) == ended,
        "renewal_date is before start_date": F.col("renewal_date") < F.col("start_date"),
        "end_date is before start_date": F.col("end_date") < F.col("start_date"),
        "price or seats is not positive": (F.col("monthly_price") <= 0) | (F.col("seats") <= 0),
    }


def subscription_rules(subscriptions: DataFrame) -> DataFrame:
    """V5 and V9 on subscriptions."""
    return _one_pass(subscriptions, "subscriptions", _subscription_rules())


def _ticket_rules() -> dict[str, Column]:
    is_open, resolved = F.col("status") == "open", F.col("resolved_date").isNotNull()
    return {
        "resolved_date does not fit the status": F.coalesce(is_open, F.lit(False)) == resolved,
        "resolved_date is before created_date": F.col("resolved_date") < F.col("created_date"),
        "satisfaction_score is outside 1 to 5": ~F.col("satisfaction_score").between(1, 5),
        "resolution_hours is not positive": F.col("resolution_hours") <= 0,
    }


def ticket_rules(tickets: DataFrame) -> DataFrame:
    """V6 and V9 on tickets."""
    return _one_pass(tickets, "support_tickets", _ticket_rules())


def status_rule(customers: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """V7: customer status equals 'active' exactly when any subscription is active."""
    holders = subscriptions.groupBy("customer_id").agg(tally(F.col("subscription_status") == "active").alias("active"))
    return _status_rule(customers, holders)


def _status_rule(customers: DataFrame, holders: DataFrame) -> DataFrame:
    """V7 from the number of ``active`` subscriptions per customer."""
    expected = F.when(F.col("active") > 0, "active").otherwise("inactive").alias("expected")
    compared = customers.select("customer_id", "customer_status").join(
        holders.select("customer_id", expected), "customer_id", "left"
    )
    return _one_pass(
        compared,
        "customers",
        {"customer_status does not fit the subscriptions": differs(F.col("customer_status"), F.col("expected"))},
    )


def owner_rules(sales: DataFrame, subscriptions: DataFrame, customers: DataFrame) -> DataFrame:
    """V8: customer, plan and region on sales equal those of their owners."""
    return _owner_rules(_sale_owners(sales), subscriptions, customers)


def _owner_rules(copies: DataFrame, subscriptions: DataFrame, customers: DataFrame) -> DataFrame:
    """V8 from the distinct owners on sales with their row count ``n``."""
    owned = subscriptions.select(
        "subscription_id", F.col("customer_id").alias("_customer"), F.col("plan_type").alias("_plan")
    )
    homes = customers.select("customer_id", F.col("region").alias("_region"))
    compared = copies.join(owned, "subscription_id", "left").join(homes, "customer_id", "left")
    rules = {
        "customer_id does not match the subscription": ("customer_id", "_customer"),
        "plan_type does not match the subscription": ("plan_type", "_plan"),
        "region does not match the customer": ("region", "_region"),
    }
    # A null on either side is a mismatch, as for any comparison with a missing owner.
    counted = compared.agg(
        *[
            F.sum(F.when(F.coalesce(F.col(a) == F.col(b), F.lit(False)), 0).otherwise(F.col("n"))).alias(name)
            for name, (a, b) in rules.items()
        ]
    )
    return _union([_result(counted, "sales", name, ERROR, F.col(f"`{name}`")) for name in rules])


def off_by_more(left: Column, right: Column, absolute: str, relative: str = "0") -> Column:
    """Whether two exact amounts differ by more than ``absolute + relative * |right|``.

    Compared in decimal, so that a difference equal to the tolerance does not hang on rounding.
    """
    allowed = F.lit(Decimal(absolute)) + F.lit(Decimal(relative)) * F.abs(right)
    return F.abs(left - right) > allowed


def _sales_rules(absolute: str = "0.02", relative: str = "0.00001") -> dict[str, Column]:
    amounts = ("gross_revenue", "discount_amount", "net_revenue")
    return {
        "an amount is negative": any_true([F.col(c) < 0 for c in amounts]),
        "net_revenue does not reconcile": off_by_more(
            F.col("gross_revenue") - F.col("discount_amount"), F.col("net_revenue"), absolute, relative
        ),
    }


def sales_rules(sales: DataFrame, *, absolute: str = "0.02", relative: str = "0.00001") -> DataFrame:
    """V9 and V10 on sales."""
    return _one_pass(sales, "sales", _sales_rules(absolute, relative))


def _components() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in COST_COMPONENTS])


def _cost_rules(absolute: str = "0.03", relative: str = "0.00001") -> dict[str, Column]:
    return {"total_cost does not reconcile": off_by_more(_components(), F.col("total_cost"), absolute, relative)}


def cost_rules(costs: DataFrame, *, absolute: str = "0.03", relative: str = "0.00001") -> DataFrame:
    """V10 on costs."""
    return _one_pass(costs, "cloud_costs", _cost_rules(absolute, relative))


def _row_rules(table: str, allowed: Mapping[tuple[str, str], Sequence[str]]) -> dict[str, Column]:
    """V3, V5, V6, V9 and V10 of one table."""
    own = {
        "subscriptions": _subscription_rules,
        "sales": _sales_rules,
        "cloud_costs": _cost_rules,
        "support_tickets": _ticket_rules,
    }
    return {**_member_rules(table, allowed), **(own[table]() if table in own else {})}


@dataclass(frozen=True)
class Facts:
    """What one scan of a table finds: ``counts``, one row of counts by rule, and ``owners``, rows by owner.

    ``owners`` has the owner columns of the table, their row count ``n`` and, for subscriptions, how many are ``active``;
    it is nothing for a table without owners.
    """

    counts: DataFrame
    owners: DataFrame | None


def fact_groups(
    frame: DataFrame, table: str, allowed: Mapping[tuple[str, str], Sequence[str]] = ALLOWED_VALUES
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The grouping that all rules of one table are read from, and each rule it counts with its severity.

    Grouping sets by key, by owner, by business event and over all rows share one scan and one shuffle. Key and event
    groups are then summed to a row each before anything else meets them, so that owners alone are left as rows.
    """
    key = PRIMARY_KEYS[table]
    rules = _row_rules(table, allowed)
    sets = {"all": (), "key": (key,)}
    if table in OWNERS:
        sets["owner"] = OWNERS[table]
    if table == "support_tickets":
        sets["event"] = tuple(c for c in frame.columns if c != key)
    columns = list(dict.fromkeys(c for names in sets.values() for c in names))
    # A bit of the grouping id is set for each column a row is not grouped by, the first column highest.
    ids = {
        name: sum(1 << place for place, c in enumerate(reversed(columns)) if c not in names) for name, names in sets.items()
    }
    broken = {f"_{i}": tally(rule) for i, rule in enumerate(rules.values())}
    grouped = frame.groupingSets([[F.col(c) for c in names] for names in sets.values()], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("n"),
        F.sum(_null_cells(frame)).alias("_missing"),
        *[count.alias(name) for name, count in broken.items()],
        *([tally(F.col("subscription_status") == "active").alias("active")] if table == "subscriptions" else []),
    )

    def of(name: str) -> Column:
        return F.col("_set") == ids[name]

    keyed = F.col(key).isNotNull()
    counted = {
        f"{key} is null": F.when(of("key") & ~keyed, F.col("n")),
        f"{key} repeats": F.when(of("key") & keyed, F.col("n") - 1),
        **{rule: F.when(of("all"), F.col(name)) for rule, name in zip(rules, broken, strict=True)},
        "missing values": F.when(of("all"), F.col("_missing")),
    }
    if "event" in sets:
        counted["duplicate business records"] = F.when(of("event"), F.col("n") - 1)
    severities = [(r, WARNING if r in ("missing values", "duplicate business records") else ERROR) for r in counted]
    owner_columns = [F.when(of("owner"), F.col(c)).alias(c) for c in sets.get("owner", ())]
    is_owner = of("owner") if "owner" in sets else F.lit(False)
    summed = grouped.groupBy(is_owner.alias("_owner"), *owner_columns).agg(
        F.sum("n").alias("n"),
        *([F.sum("active").alias("active")] if table == "subscriptions" else []),
        *[F.sum(count).alias(f"c{i}") for i, count in enumerate(counted.values())],
    )
    return summed, severities


def facts_of(
    frame: DataFrame, table: str, allowed: Mapping[tuple[str, str], Sequence[str]] = ALLOWED_VALUES
) -> Facts:
    """Keys, row rules, null cells, owners and repeated events of a table, found in one scan and then kept."""
    summed, severities = fact_groups(frame, table, allowed)
    # Read by the counts and by each relation, so it is written once.
    kept = materialize(summed)
    total = kept.filter("NOT _owner").agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(severities))])
    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.lit(rule).alias("rule"),
                F.lit(severity).alias("severity"),
                F.col(f"c{i}").cast("bigint").alias("violations"),
            )
            for i, (rule, severity) in enumerate(severities)
        ]
    )
    counts = total.select(F.inline(rows))
    if table not in OWNERS:
        return Facts(counts, None)
    return Facts(counts, kept.filter("_owner").select(*OWNERS[table], *[c for c in ("n", "active") if c in kept.columns]))


def _null_cells(frame: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in frame.columns])


def missing_values(frame: DataFrame, table: str) -> DataFrame:
    """Null cells in a table."""
    return _result(frame.agg(F.sum(_null_cells(frame)).alias("n")), table, "missing values", WARNING, "n")


def duplicate_warning(tickets: DataFrame) -> DataFrame:
    """Ticket rows that repeat an earlier business event."""
    repeats = duplicate_events(tickets, "ticket_id")
    return _result(repeats, "support_tickets", "duplicate business records", WARNING, "duplicates")


def warnings(tables: Tables) -> DataFrame:
    """Repeated ticket events and null cells per table."""
    return _union(
        [duplicate_warning(tables.support_tickets), *[missing_values(frame, name) for name, frame in tables.items()]]
    )


def validate(
    tables: Tables, *, allowed: Mapping[tuple[str, str], Sequence[str]] = ALLOWED_VALUES
) -> DataFrame:
    """V1–V11 in one frame. A broken structure is reported alone, as the other rules need the columns."""
    frames = dict(tables.items())
    shape = structure(frames)
    if any(set(schema.fieldNames()) - set(frames[name].columns) for name, schema in SCHEMAS.items()):
        return shape
    facts = {name: facts_of(frames[name], name, allowed) for name in PRIMARY_KEYS}
    owners = {name: found.owners for name, found in facts.items() if found.owners is not None}
    return _union(
        [
            *[found.counts for found in facts.values()],
            relation_rules(tables, owners),
            _status_rule(tables.customers, owners["subscriptions"]),
            _owner_rules(owners["sales"], tables.subscriptions, tables.customers),
        ]
    )


def require_valid(report: DataFrame) -> None:
    """Raise when a contract rule is broken. The report has one row per rule."""
    broken = report.filter((F.col("severity") == ERROR) & (F.col("violations") > 0)).collect()
    if broken:
        raise ValueError("Contract broken: " + "; ".join(f"{r.table}: {r.rule} ({r.violations})" for r in broken))


def check_constraints(
    tables: Tables, *, allowed: Mapping[tuple[str, str], Sequence[str]] = ALLOWED_VALUES
) -> DataFrame:
    """Declared row checks, with strict absolute tolerances. A null never breaks a check."""
    status, ended = F.col("subscription_status"), F.col("end_date")
    state, resolved = F.col("status"), F.col("resolved_date")
    score = F.col("satisfaction_score")
    rows = {
        "subscriptions": {
            "price is positive": ~(F.col("monthly_price") > 0),
            "seats are positive": ~(F.col("seats") > 0),
            "renewal follows start": ~(F.col("renewal_date") >= F.col("start_date")),
            "end fits status": ~(
                ((status == "active") & ended.isNull()) | ((status != "active") & ended.isNotNull())
            ),
        },
        "sales": {
            "gross is not negative": F.col("gross_revenue") < 0,
            "discount is not negative": F.col("discount_amount") < 0,
            "net is not negative": F.col("net_revenue") < 0,
            "discount is within gross": F.col("discount_amount") > F.col("gross_revenue"),
            "net reconciles": off_by_more(
                F.col("gross_revenue") - F.col("discount_amount"), F.col("net_revenue"), "0.02"
            ),
        },
        "cloud_costs": {
            "costs are not negative": any_true([F.col(c) < 0 for c in COST_COLUMNS]),
            "total reconciles": off_by_more(_components(), F.col("total_cost"), "0.03"),
        },
        "support_tickets": {
            "hours are positive": F.col("resolution_hours") <= 0,
            "score is 1 to 5": score.isNotNull() & ~score.between(1, 5),
            "resolution fits status": ~(
                ((state == "resolved") & resolved.isNotNull()) | ((state == "open") & resolved.isNull())
            ),
            "resolution follows creation": resolved < F.col("created_date"),
        },
    }
    for (table, column), members in allowed.items():
        rows.setdefault(table, {})[f"{column} is allowed"] = ~F.col(column).isin(*members)
    return _union([_one_pass(frame, name, rows[name]) for name, frame in tables.items() if name in rows])


def row_counts(tables: Tables) -> DataFrame:
    """Rows per table."""
    return _union(
        [frame.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, frame in tables.items()]
    )


def pattern_audit(frames: Mapping[str, DataFrame], pattern: str) -> DataFrame:
    """Cells of each text column that match a regular expression, whole text, one pass per table."""
    audits = []
    for table, frame in frames.items():
        columns = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
        if not columns:
            continue
        counted = frame.agg(*[tally(F.col(c).rlike(pattern)).alias(c) for c in columns])
        audits.append(
            counted.unpivot([], columns, "column", "matches").select(F.lit(table).alias("table"), "column", "matches")
        )
    return _union(audits)


def identity_audit(frame: DataFrame, key: str, label: str) -> DataFrame:
    """Rows, distinct keys and label classes of a one-row-per-key frame."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("n"))
    keys = per_key.agg(
        F.sum("n").alias("rows"), F.count(key).alias("distinct_keys"), F.sum(F.col("n") - 1).alias("repeated_rows")
    )
    classes = frame.agg(F.count_distinct(label).alias("label_classes"))
    return side_by_side(keys, classes)
