from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import cleaning, contracts
from tallygrain.schemas import PRIMARY_KEYS
from tests.frames import valid_tables


def broken(report):
    return {(r.table, r.rule): r.violations for r in report.filter("severity = 'error' AND violations > 0").collect()}


def test_valid_tables_break_nothing(spark):
    report = contracts.validate(valid_tables(spark))
    assert broken(report) == {}
    contracts.require_valid(report)
    warned = {(r.table, r.rule): r.violations for r in report.filter("severity = 'warning'").collect()}
    assert warned[("support_tickets", "duplicate business records")] == 1
    assert warned[("customers", "missing values")] == 1
    assert warned[("subscriptions", "missing values")] == 3


def test_every_kind_of_break_is_found(spark):
    t = valid_tables(spark)
    bad = t.with_tables(
        customers=t.customers.withColumn("customer_status", F.lit("active")),
        subscriptions=t.subscriptions.withColumn(
            "renewal_date", F.when(F.col("subscription_id") == "S1", F.lit("2020-01-01").cast("date")).otherwise(F.col("renewal_date"))
        ).withColumn("seats", F.when(F.col("subscription_id") == "S2", 0).otherwise(F.col("seats"))),
        sales=t.sales.withColumn("region", F.when(F.col("sale_id") == "A1", "India").otherwise(F.col("region")))
        .withColumn("customer_id", F.when(F.col("sale_id") == "A2", "C9").otherwise(F.col("customer_id")))
        .withColumn("sale_id", F.when(F.col("sale_id") == "A5", "A4").otherwise(F.col("sale_id"))),
        cloud_costs=t.cloud_costs.withColumn("total_cost", F.col("total_cost") + 1),
        support_tickets=t.support_tickets.withColumn("severity", F.lit("Odd")),
    )
    found = broken(contracts.validate(bad))
    assert found == {
        ("customers", "customer_status does not fit the subscriptions"): 1,
        ("subscriptions", "renewal_date is before start_date"): 1,
        ("subscriptions", "price or seats is not positive"): 1,
        ("sales", "region does not match the customer"): 2,
        ("sales", "customer_id does not match the subscription"): 1,
        ("sales", "sales_customer has no parent"): 1,
        ("sales", "sale_id repeats"): 1,
        ("cloud_costs", "total_cost does not reconcile"): 4,
        ("support_tickets", "severity has an unexpected value"): 5,
    }
    with pytest.raises(ValueError, match="Contract broken"):
        contracts.require_valid(contracts.validate(bad))


def test_missing_structure_is_reported_alone(spark):
    t = valid_tables(spark)
    report = contracts.validate(t.with_tables(sales=t.sales.drop("region"))).collect()
    assert [(r.table, r.rule) for r in report] == [("sales", "missing column region")]
    frames = {name: frame for name, frame in t.items() if name != "sales"}
    assert [r.rule for r in contracts.structure(frames).collect()] == ["missing table"]


def test_two_tolerances(spark):
    row = spark.createDataFrame([(Decimal("100000.00"), Decimal("100000.90"))], "a decimal(14,2), b decimal(14,2)")

    def off(absolute, relative="0"):
        return row.select(contracts.off_by_more(F.col("a"), F.col("b"), absolute, relative).alias("x")).first().x

    assert off("0.02") and not off("0.02", "0.00001")
    edge = spark.createDataFrame([(Decimal("1.00"), Decimal("1.02"))], "a decimal(14,2), b decimal(14,2)")
    assert not edge.select(contracts.off_by_more(F.col("a"), F.col("b"), "0.02").alias("x")).first().x


def test_duplicate_events_keep_the_lowest_key_and_treat_nulls_as_equal(spark):
    rows = [(3, "x", None), (1, "x", None), (2, "y", 1), (4, "y", 2)]
    kept = cleaning.drop_duplicate_events(spark.createDataFrame(rows, "k int, a string, b int"), "k")
    assert sorted(r.k for r in kept.collect()) == [1, 2, 4]


def test_cleaning_report(spark):
    raw = valid_tables(spark)
    cleaned = cleaning.clean_tables(raw)
    report = {(r.table, r.measure): r.value for r in cleaning.cleaning_report(raw, cleaned).collect()}
    assert report[("support_tickets", "duplicates_removed")] == 1
    assert report[("customers", "industries_filled")] == 1
    assert report[("support_tickets", "scores_left_missing")] == 1
    assert cleaned.customers.filter("industry = 'Unknown'").count() == 1
    assert raw.customers.filter("industry IS NULL").count() == 1


def test_dates(spark):
    frame = spark.createDataFrame([("2024-01-31",), ("2024-02-31",), (None,)], "day string")
    good, bad = cleaning.split_bad_dates(frame, ("day",))
    assert good.count() == 2 and [r.day for r in bad.collect()] == ["2024-02-31"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|2024-02-31"):
        cleaning.typed_dates(frame, ("day",)).collect()


def test_pattern_audit_and_identity(spark):
    t = valid_tables(spark)
    audit = {(r.table, r.column): r.matches for r in contracts.pattern_audit(dict(t.items()), "(?i)^(one|two)$").collect()}
    assert audit[("customers", "customer_name")] == 2
    row = contracts.identity_audit(t.subscriptions, "customer_id", "subscription_status").first()
    assert (row.rows, row.distinct_keys, row.repeated_rows, row.label_classes) == (5, 4, 1, 3)


def test_structure_report_counts_rows_and_names_what_lacks(spark):
    frames = {"customers": spark.createDataFrame([(1,), (2,)], "customer_id long")}
    report = {r.table: r for r in contracts.structure_report(frames).collect()}
    assert len(report) == 5 and report["customers"].rows == 2 and report["sales"].rows is None
    assert "region" in report["customers"].missing_columns.split(",") and "sale_id" in report["sales"].missing_columns.split(",")


def test_validate_agrees_with_the_rules_taken_one_by_one(spark):
    """Null and repeated keys, null owners, all-null events and a table without rows."""
    t = valid_tables(spark)
    empty = [None] * len(t.support_tickets.columns)
    odd = t.with_tables(
        customers=t.customers.withColumn("customer_id", F.when(F.col("customer_id") != "C4", F.col("customer_id"))),
        sales=t.sales.unionAll(t.sales.limit(2)).withColumn(
            "subscription_id", F.when(F.col("sale_id") != "A1", F.col("subscription_id"))
        ),
        cloud_costs=t.cloud_costs.limit(0),
        support_tickets=t.support_tickets.unionAll(spark.createDataFrame([tuple(empty)] * 3, t.support_tickets.schema)),
    )
    frames = dict(odd.items())
    alone = [
        *[contracts.key_rules(frames[name], name, key) for name, key in PRIMARY_KEYS.items()],
        contracts.member_rules(odd),
        contracts.relation_rules(odd),
        contracts.subscription_rules(odd.subscriptions),
        contracts.ticket_rules(odd.support_tickets),
        contracts.status_rule(odd.customers, odd.subscriptions),
        contracts.owner_rules(odd.sales, odd.subscriptions, odd.customers),
        contracts.sales_rules(odd.sales),
        contracts.cost_rules(odd.cloud_costs),
        contracts.warnings(odd),
    ]
    expected = sorted(tuple(r) for part in alone for r in part.collect())
    found = sorted(tuple(r) for r in contracts.validate(odd).collect())
    assert found == expected
    assert ("support_tickets", "ticket_id is null", "error", 3) in found
    assert ("support_tickets", "duplicate business records", "warning", 3) in found
    assert ("sales", "sale_id repeats", "error", 2) in found
