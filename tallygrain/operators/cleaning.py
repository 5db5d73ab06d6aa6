"""Typing, filling and deduplication with an audit report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.exprs import any_true, side_by_side, tally
from tallygrain.schemas import DATE_COLUMNS, Tables


def typed_dates(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Dates from ISO text; a malformed value fails the job (ANSI cast)."""
    return frame.withColumns({c: F.col(c).cast("date") for c in columns})


def type_tables(tables: Tables) -> Tables:
    return tables.with_tables(**{name: typed_dates(frame, DATE_COLUMNS[name]) for name, frame in tables.items()})


def split_bad_dates(frame: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """C1, lenient: (rows with typed dates, untouched rows holding a malformed date)."""
    parsed = {c: F.expr(f"try_cast(`{c}` AS date)") for c in columns}
    bad = any_true([F.col(c).isNotNull() & parsed[c].isNull() for c in columns])
    return frame.filter(~bad).withColumns(parsed), frame.filter(bad)


def fill_missing(frame: DataFrame, column: str, value: str = "Unknown") -> DataFrame:
    """Replace nulls of a category."""
    return frame.na.fill(value, [column])


def drop_duplicate_events(frame: DataFrame, key: str) -> DataFrame:
    """Rows that agree on all but the surrogate key, kept once with the lowest key.

    A grouped minimum is summed before the shuffle, so copies of one event meet as one row per
    input partition; a ranked window would sort them all in one task. Nulls count as equal.
    """
    business = [c for c in frame.columns if c != key]
    return frame.groupBy(*business).agg(F.min(key).alias(key)).select(*frame.columns)


def duplicate_events(frame: DataFrame, key: str) -> DataFrame:
    """How many rows repeat an earlier event."""
    business = [c for c in frame.columns if c != key]
    return frame.groupBy(*business).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def clean_tables(tables: Tables, *, unknown_industry: str = "Unknown") -> Tables:
    """Typed, filled and deduplicated. Structural nulls and missing scores stay null."""
    typed = type_tables(tables)
    return typed.with_tables(
        customers=fill_missing(typed.customers, "industry", unknown_industry),
        support_tickets=drop_duplicate_events(typed.support_tickets, "ticket_id"),
    )


def cleaning_report(raw: Tables, cleaned: Tables) -> DataFrame:
    """C4: rows before and after, and what cleaning changed, as (table, measure, value) rows.

    The contract rules on ``cleaned`` complete the report: see ``contracts.validate``.
    """
    row = side_by_side(
        *[
            frame.agg(F.count("*").alias(f"{name}|{when}"))
            for when, bundle in (("rows_before", raw), ("rows_after", cleaned))
            for name, frame in bundle.items()
        ],
        raw.customers.agg(tally(F.col("industry").isNull()).alias("customers|industries_filled")),
        cleaned.support_tickets.agg(
            tally(F.col("satisfaction_score").isNull()).alias("support_tickets|scores_left_missing")
        ),
    ).withColumn(
        "support_tickets|duplicates_removed",
        F.col("support_tickets|rows_before") - F.col("support_tickets|rows_after"),
    )
    parts = F.split("name", "\\|")
    return row.unpivot([], row.columns, "name", "value").select(
        parts[0].alias("table"), parts[1].alias("measure"), "value"
    )
