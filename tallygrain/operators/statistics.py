"""Descriptives, intervals and hypothesis tests.

Samples are reduced to sufficient sums, or to counts per distinct value where ranks are needed.
Tail probabilities are taken on the one row per test that is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.exprs import as_double, correlation, ratio, tally
from tallygrain.functions.ranking import average_ranks, grouped_shape
from tallygrain.functions.tails import (
    chi_square_p_value,
    normal_p_value,
    normal_quantile,
    t_critical,
    t_p_value,
)
from tallygrain.operators.kpis import at_risk, cancelled_within, plan_contingency, ticket_averages, ticket_parts
from tallygrain.operators.scope import Scope
from tallygrain.schemas import Tables
from tallygrain.session import materialize

# The decision texts and the names of tests and effects.
REJECT = "Reject the null hypothesis"
KEEP = "Fail to reject the null hypothesis"
WELCH = "Welch's independent-samples t-test"
MANN_WHITNEY = "Mann–Whitney U test (two-sided)"
CHI_SQUARE = "Pearson chi-square test of independence"
PEARSON = "Pearson product-moment correlation"
SPEARMAN = "Spearman rank correlation"
HEDGES_G = "Hedges' g"
RANK_BISERIAL = "rank-biserial correlation"
CRAMERS_V = "Cramér's V"


def _check_level(value: float, name: str) -> None:
    if not 0 < value < 1:
        raise ValueError(f"{name} must be between 0 and 1")


# --- descriptives and intervals --------------------------------------------------------------


def descriptive_statistics(frame: DataFrame, value: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Location, spread, exact quartiles and bias-corrected skewness; needs two values."""
    return (
        grouped_shape(frame, value, by, {"median": 0.5, "p25": 0.25, "p75": 0.75})
        .filter(F.col("count") >= 2)
        .select(*by, F.col("count").alias("n"), "mean", "median", "std", "min", "p25", "p75", "max", "skewness")
    )


def mean_interval(frame: DataFrame, value: str, *, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """T interval of the mean."""
    _check_level(confidence, "confidence")
    v = as_double(value)
    summed = frame.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("standard_error")
    )
    margin = t_critical(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double")) * F.col("standard_error")
    return (
        summed.filter("n >= 2")
        .withColumn("_margin", margin)
        .select(
            *by,
            "n",
            "mean",
            F.lit(float(confidence)).alias("confidence"),
            (F.col("mean") - F.col("_margin")).alias("lower"),
            (F.col("mean") + F.col("_margin")).alias("upper"),
            "standard_error",
        )
    )


def proportion_interval(frame: DataFrame, successes: str, observations: str, *, confidence: float = 0.95) -> DataFrame:
    """Wilson score interval added to rows of counts; null without observations."""
    _check_level(confidence, "confidence")
    z = normal_quantile((1 + confidence) / 2)
    s, n = as_double(successes), F.nullif(as_double(observations), F.lit(0.0))
    p = s / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return frame.withColumns(
        {
            "proportion": p,
            "confidence": F.lit(float(confidence)),
            "lower": F.greatest(centre - half, F.lit(0.0)),
            "upper": F.least(centre + half, F.lit(1.0)),
        }
    )


# --- test reports ----------------------------------------------------------------------------


def _report(
    row: DataFrame,
    *,
    test: str,
    sizes: dict[str, Column],
    statistic: Column,
    p_value: Column,
    effect_name: str,
    effect: Column,
    alpha: float,
) -> DataFrame:
    _check_level(alpha, "alpha")
    size_map = F.create_map(*[x for label, size in sizes.items() for x in (F.lit(label), size.cast("bigint"))])
    return (
        row.withColumn("p_value", p_value)
        .select(
            F.lit(test).alias("test_used"),
            size_map.alias("sample_size"),
            as_double(statistic).alias("statistic"),
            "p_value",
            F.lit(effect_name).alias("effect_size_name"),
            as_double(effect).alias("effect_size"),
            F.lit(float(alpha)).alias("alpha"),
        )
        .withColumn("result", F.when(F.col("p_value") < alpha, REJECT).otherwise(KEEP))
    )


def _two_groups(frame: DataFrame, value: str, group: str, first: object, second: object) -> DataFrame:
    return frame.select(
        as_double(value).alias("value"),
        F.when(F.col(group) == first, 1).when(F.col(group) == second, 2).alias("side"),
    ).filter("value IS NOT NULL AND side IS NOT NULL")


def two_sample_moments(frame: DataFrame, value: str, group: str, first: object, second: object) -> DataFrame:
    """T4: sizes, means, variances and Hedges' g of two groups in one row."""
    sides = _two_groups(frame, value, group, first, second)
    row = sides.agg(
        *[
            fn(F.when(F.col("side") == i, F.col("value"))).alias(f"{name}{i}")
            for i in (1, 2)
            for name, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    ).filter("n1 >= 2 AND n2 >= 2")
    free = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / free
    g = (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled) * (1 - 3 / (4 * free - 1))
    return row.withColumn("hedges_g", F.when(pooled > 0, g).otherwise(0.0))


def welch_t_test(
    frame: DataFrame, value: str, group: str, first: object, second: object, *, alpha: float = 0.05
) -> DataFrame:
    """T5: difference of two means without equal variances. Fewer than two values in a group: no row."""
    row = two_sample_moments(frame, value, group, first, second)
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    t = (F.col("mean1") - F.col("mean2")) / F.nullif(F.sqrt(a + b), F.lit(0.0))
    df = F.pow(a + b, F.lit(2.0)) / F.nullif(a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1), F.lit(0.0))
    return _report(
        row.withColumns({"_t": t, "_df": df}),
        test=WELCH,
        sizes={str(first): F.col("n1"), str(second): F.col("n2")},
        statistic=F.col("_t"),
        p_value=t_p_value("_t", "_df"),
        effect_name=HEDGES_G,
        effect=F.col("hedges_g"),
        alpha=alpha,
    )


def mann_whitney_test(
    frame: DataFrame, value: str, group: str, first: object, second: object, *, alpha: float = 0.05
) -> DataFrame:
    """U of the first group; normal p-value with tie and continuity correction at every size."""
    counts = (
        _two_groups(frame, value, group, first, second)
        .groupBy("value")
        .agg(F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("n_first"))
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, half = n1 + n2, F.col("n1").cast("double") * F.col("n2") / 2
    row = (
        average_ranks(counts, extra=["n_first"])
        .agg(
            F.sum("n_first").alias("n1"),
            F.sum(F.col("n") - F.col("n_first")).alias("n2"),
            F.sum(F.col("n_first") * F.col("average_rank")).alias("rank_sum"),
            F.sum(F.pow(as_double("n"), F.lit(3.0)) - F.col("n")).alias("ties"),
        )
        .filter("n1 >= 2 AND n2 >= 2")
        .withColumn("u", F.col("rank_sum") - n1 * (n1 + 1) / 2)
        .withColumn("_sd", F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))))
        .withColumn(
            "_z", (F.greatest(F.col("u"), n1 * n2 - F.col("u")) - half - 0.5) / F.nullif(F.col("_sd"), F.lit(0.0))
        )
    )
    return _report(
        row,
        test=MANN_WHITNEY,
        sizes={str(first): F.col("n1"), str(second): F.col("n2")},
        statistic=F.col("u"),
        p_value=normal_p_value("_z"),
        effect_name=RANK_BISERIAL,
        effect=2 * F.col("u") / (n1 * n2) - 1,
        alpha=alpha,
    )


def chi_square_test(table: DataFrame, row: str, columns: Sequence[str], *, alpha: float = 0.05) -> DataFrame:
    """Independence in a wide table of counts, no continuity correction.

    Empty rows or columns would leave a cell without an expectation, so they give a null statistic.
    """
    if len(columns) < 2:
        raise ValueError("A contingency table needs two columns")
    cells = table.select(row, *[as_double(c).alias(c) for c in columns]).unpivot([row], list(columns), "_column", "o")
    by_row = cells.groupBy(row).agg(F.sum("o").alias("_row_sum"))
    by_column = cells.groupBy("_column").agg(F.sum("o").alias("_column_sum"))
    whole = cells.agg(F.sum("o")).scalar()
    expected = F.col("_row_sum") * F.col("_column_sum") / F.nullif(F.col("_all"), F.lit(0.0))
    summed = (
        cells.join(by_row, row)
        .join(F.broadcast(by_column), "_column")  # one row per column named
        .withColumn("_all", whole)
        .withColumn("e", expected)
        .agg(
            F.when(F.min("e") > 0, F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2.0)) / F.nullif("e", F.lit(0.0)))).alias("chi"),
            F.first("_all").alias("observations"),
            F.count("*").alias("cells"),
            tally(F.col("e") < 5).alias("low_expected_cells"),
        )
    )
    width = len(columns)
    rows = F.col("cells") / width
    df = (rows - 1) * (width - 1)
    smaller = F.least(rows - 1, F.lit(float(width - 1)))
    ready = summed.filter(F.col("cells") >= 2 * width).withColumns({"_df": df, "_smaller": smaller})
    return _report(
        ready,
        test=CHI_SQUARE,
        sizes={
            "observations": F.col("observations"),
            "cells": F.col("cells"),
            "cells_expected_below_five": F.col("low_expected_cells"),
        },
        statistic=F.col("chi"),
        p_value=chi_square_p_value("chi", "_df"),
        effect_name=CRAMERS_V,
        effect=F.sqrt(F.col("chi") / (F.col("observations") * F.col("_smaller"))),
        alpha=alpha,
    )


def correlation_test(
    frame: DataFrame, first: str, second: str, *, method: str = "spearman", alpha: float = 0.05
) -> DataFrame:
    """Pearson or Spearman over complete pairs. No row without three pairs and variation in both."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    pairs = frame.select(as_double(first).alias("x"), as_double(second).alias("y")).na.drop()
    if method == "pearson":
        row = pairs.agg(F.count("*").alias("n"), correlation("x", "y").alias("r"))
    else:
        joint = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
        sides = joint.select(
            "n",
            F.inline(
                F.array(
                    F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
                    F.struct(F.lit("y").alias("side"), F.col("y").alias("value")),
                )
            ),
        )
        ranks = average_ranks(
            sides.groupBy("side", "value").agg(F.sum("n").alias("n")), by=["side"]
        ).withColumn("centred", F.col("average_rank") - (F.col("n_total") + 1) / 2.0)
        lookups = {
            s: ranks.filter(F.col("side") == s).select(F.col("value").alias(s), F.col("centred").alias(f"r{s}"))
            for s in ("x", "y")
        }
        row = (
            joint.join(lookups["x"], "x")
            .join(lookups["y"], "y")
            .agg(
                F.sum("n").alias("n"),
                F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"),
                F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"),
                F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"),
            )
            .withColumn("r", ratio("xy", F.sqrt(F.col("xx") * F.col("yy"))))
        )
    r = F.col("r")
    t = r * F.sqrt((F.col("n") - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    ready = row.filter("n >= 3 AND r IS NOT NULL").withColumns(
        {"_t": F.coalesce(t, F.lit(float("inf"))), "_df": (F.col("n") - 2).cast("double")}
    )
    return _report(
        ready,
        test=PEARSON if method == "pearson" else SPEARMAN,
        sizes={"complete_pairs": F.col("n")},
        statistic=r,
        p_value=t_p_value("_t", "_df"),
        effect_name="Pearson r" if method == "pearson" else "Spearman rho",
        effect=r,
        alpha=alpha,
    )


def variance_ratio(frame: DataFrame, value: str, group: str, first: object, second: object) -> DataFrame:
    """Larger over smaller sample variance of two groups."""
    row = two_sample_moments(frame, value, group, first, second)
    return row.select(ratio(F.greatest("var1", "var2"), F.least("var1", "var2")).alias("variance_ratio"))


# --- business frames and the table of tests --------------------------------------------------


def support_before_outcome(tables: Tables) -> DataFrame:
    """Support known by a customer's first cancellation, or by the end of the data.

    Tickets are summed per customer and day before the join, so a customer with very many tickets
    meets the outcome date as a few rows. Customers without tickets stay, with a count of zero.
    """
    first = (
        tables.subscriptions.filter(F.col("subscription_status") == "cancelled")
        .groupBy("customer_id")
        .agg(F.min("end_date").alias("first_cancellation_date"))
    )
    last_seen = F.greatest(
        tables.sales.agg(F.max("sale_date")).scalar(), tables.support_tickets.agg(F.max("created_date")).scalar()
    )
    outcome = tables.customers.select("customer_id", "region").join(first, "customer_id", "left").withColumns(
        {
            "outcome_date": F.coalesce("first_cancellation_date", last_seen),
            "churned": F.col("first_cancellation_date").isNotNull().cast("int"),
        }
    )
    daily = tables.support_tickets.groupBy("customer_id", "created_date").agg(
        *[part.alias(name) for name, part in ticket_parts().items()]
    )
    known = F.col("created_date") <= F.col("outcome_date")
    counted = outcome.join(daily, "customer_id", "left").select(
        *outcome.columns, *[F.when(known, F.col(name)).alias(name) for name in ticket_parts()]
    )
    return counted.groupBy(*outcome.columns).agg(
        F.coalesce(F.sum("ticket_count"), F.lit(0)).alias("ticket_count"),
        *[average.alias(name) for name, average in ticket_averages().items()],
    )


def exposure_churn_interval(
    subscriptions: DataFrame,
    customers: DataFrame,
    region: str,
    periods: dict[str, tuple[date | str, date | str]],
    *,
    confidence: float = 0.95,
) -> DataFrame:
    """Cancelled over exposed subscriptions of one region per period, with a Wilson interval."""
    scopes = {name: Scope(start, end, region) for name, (start, end) in periods.items()}
    per_customer = subscriptions.groupBy("customer_id").agg(
        *[
            tally(rule).alias(f"{name}|{what}")
            for name, scope in scopes.items()
            for what, rule in (("successes", cancelled_within(scope)), ("observations", at_risk(scope)))
        ]
    )
    row = per_customer.join(
        customers.filter(F.col("region") == region).select("customer_id"), "customer_id", "left_semi"
    ).agg(*[F.sum(f"{n}|{w}").alias(f"{n}|{w}") for n in scopes for w in ("successes", "observations")])
    counts = F.array(
        *[
            F.struct(
                F.lit(name).alias("period"),
                F.col(f"{name}|successes").alias("successes"),
                F.col(f"{name}|observations").alias("observations"),
            )
            for name in scopes
        ]
    )
    return proportion_interval(row.select(F.inline(counts)), "successes", "observations", confidence=confidence)


def business_tests(tables: Tables, *, alpha: float = 0.05) -> DataFrame:
    """The five tests on support and cancellation, one row each. The customer frame is built once."""
    support = materialize(support_before_outcome(tables))
    hours, score = "average_resolution_hours", "average_satisfaction"
    tests = {
        "support_resolution_welch": welch_t_test(support, hours, "churned", 1, 0, alpha=alpha),
        "support_resolution_mann_whitney": mann_whitney_test(support, hours, "churned", 1, 0, alpha=alpha),
        "support_satisfaction_spearman": correlation_test(support, hours, score, alpha=alpha),
        "support_satisfaction_pearson_sensitivity": correlation_test(
            support, hours, score, method="pearson", alpha=alpha
        ),
        "plan_cancellation_chi_square": chi_square_test(
            plan_contingency(tables.subscriptions), "plan_type", ["not_cancelled", "cancelled"], alpha=alpha
        ),
    }
    return reduce(
        lambda a, b: a.unionByName(b), [frame.select(F.lit(name).alias("test"), "*") for name, frame in tests.items()]
    )


def business_descriptives(tables: Tables) -> DataFrame:
    """Descriptives and mean interval of resolution time for churned and retained customers."""
    support = materialize(support_before_outcome(tables))
    described = descriptive_statistics(support, "average_resolution_hours", by=["churned"])
    interval = mean_interval(support, "average_resolution_hours", by=["churned"]).select(
        "churned", "confidence", "lower", "upper", "standard_error"
    )
    return described.join(interval, "churned")
