"""Registered statistics queries (T1–T13). Tail probabilities have no SQL form and are left out of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import statistics as st
from tallygrain.operators.kpis import plan_contingency
from tallygrain.plans.base import Registry, rounded
from tallygrain.sources import roles

STATISTICS = Registry()

SHIFT = 336  # months from 2024-01 back to 1996-01
SUPPORT_ROLES = ["customers", "subscriptions", "sales", f"support_tickets-{SHIFT}"]

SUPPORT_SQL = """
SELECT c.customer_id, c.region, f.first_cancellation_date, c.outcome_date,
  CASE WHEN f.first_cancellation_date IS NULL THEN 0 ELSE 1 END AS churned,
  coalesce(t.ticket_count, 0) AS ticket_count, t.average_resolution_hours, t.average_satisfaction
FROM (
  SELECT c.customer_id, c.region, coalesce(f.first_cancellation_date, greatest(
      (SELECT max(sale_date) FROM sales), (SELECT max(created_date) FROM support_tickets))) AS outcome_date
  FROM customers c LEFT JOIN (SELECT customer_id, min(end_date) AS first_cancellation_date FROM subscriptions
    WHERE subscription_status = 'cancelled' GROUP BY customer_id) f USING (customer_id)) c
LEFT JOIN (SELECT customer_id, min(end_date) AS first_cancellation_date FROM subscriptions
  WHERE subscription_status = 'cancelled' GROUP BY customer_id) f USING (customer_id)
LEFT JOIN (
  SELECT k.customer_id, count(*) AS ticket_count,
    CAST(sum(resolution_hours) AS DOUBLE) / nullif(count(resolution_hours), 0) AS average_resolution_hours,
    CAST(sum(satisfaction_score) AS DOUBLE) / nullif(count(satisfaction_score), 0) AS average_satisfaction
  FROM support_tickets k
  LEFT JOIN (SELECT customer_id, min(end_date) AS ended FROM subscriptions
    WHERE subscription_status = 'cancelled' GROUP BY customer_id) e USING (customer_id)
  WHERE created_date <= coalesce(ended, greatest(
    (SELECT max(sale_date) FROM sales), (SELECT max(created_date) FROM support_tickets)))
  GROUP BY k.customer_id) t USING (customer_id)"""


def _tables(spark, folder):
    return roles.business_tables(spark, folder, ticket_months_back=SHIFT)


def _support(spark, folder):
    return st.support_before_outcome(_tables(spark, folder))


def _tested(frame, *sizes, extra=()):
    """A test row without its p-value, sizes as columns."""
    return rounded(frame, 8, "statistic", "effect_size").select(
        "test_used",
        *[F.element_at("sample_size", F.lit(label)).alias(f"n_{label}") for label in sizes],
        "statistic",
        "effect_size_name",
        "effect_size",
        "alpha",
        *extra,
    )


@STATISTICS.add("support_before_outcome", SUPPORT_SQL, SUPPORT_ROLES)
def support_before_outcome(spark, folder):
    return _support(spark, folder)


@STATISTICS.add(
    "descriptive_statistics",
    f"""SELECT churned, count(v) AS n, round(avg(v), 8) AS mean, round(median(v), 8) AS median,
      round(stddev_samp(v), 8) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 8) AS p25,
      round(quantile_cont(v, 0.75), 8) AS p75, max(v) AS max, round(skewness(v), 8) AS skewness
    FROM (SELECT churned, average_resolution_hours AS v FROM ({SUPPORT_SQL})) WHERE v IS NOT NULL GROUP BY churned""",
    SUPPORT_ROLES,
)
def descriptive_statistics(spark, folder):
    described = st.descriptive_statistics(_support(spark, folder), "average_resolution_hours", by=["churned"])
    return rounded(described, 8, "mean", "median", "std", "p25", "p75", "skewness")


@STATISTICS.add(
    "descriptive_statistics_lines",
    """SELECT count(v) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std,
      min(v) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75, max(v) AS max,
      round(skewness(v), 6) AS skewness FROM (SELECT l_extendedprice AS v FROM lineitem)""",
)
def descriptive_statistics_lines(spark, folder):
    described = st.descriptive_statistics(roles.table(spark, folder, "lineitem"), "l_extendedprice")
    return rounded(rounded(described, 4, "mean", "median", "std", "p25", "p75"), 6, "skewness")


@STATISTICS.add(
    "mean_interval",
    f"""SELECT churned, count(v) AS n, round(avg(v), 8) AS mean, 0.95::DOUBLE AS confidence,
      round(stddev_samp(v) / sqrt(count(v)), 8) AS standard_error
    FROM (SELECT churned, average_resolution_hours AS v FROM ({SUPPORT_SQL})) WHERE v IS NOT NULL GROUP BY churned""",
    SUPPORT_ROLES,
)
def mean_interval(spark, folder):
    interval = st.mean_interval(_support(spark, folder), "average_resolution_hours", by=["churned"])
    return rounded(interval, 8, "mean", "standard_error").drop("lower", "upper")


@STATISTICS.add("mean_interval_bounds")
def mean_interval_bounds(spark, folder):
    return st.mean_interval(_support(spark, folder), "average_resolution_hours", by=["churned"])


# The z of a 95 % interval, as used on both sides.
Z95 = "1.959963984540054"


def wilson_sql(source: str, keys: str) -> str:
    z2 = f"({Z95}::DOUBLE * {Z95}::DOUBLE)"
    return f"""
    SELECT {keys}, successes, observations, p AS proportion, 0.95::DOUBLE AS confidence,
      round(greatest((p + {z2} / (2 * n) - {Z95}::DOUBLE * sqrt(p * (1 - p) / n + {z2} / (4 * n * n)))
        / (1 + {z2} / n), 0.0), 9) AS lower,
      round(least((p + {z2} / (2 * n) + {Z95}::DOUBLE * sqrt(p * (1 - p) / n + {z2} / (4 * n * n)))
        / (1 + {z2} / n), 1.0), 9) AS upper
    FROM (SELECT *, CAST(observations AS DOUBLE) AS n, CAST(successes AS DOUBLE) / observations AS p FROM ({source}))"""


@STATISTICS.add(
    "proportion_interval",
    wilson_sql(
        """SELECT plan_type, count(*) FILTER (WHERE subscription_status = 'cancelled') AS successes,
        count(*) AS observations FROM subscriptions GROUP BY plan_type""",
        "plan_type",
    ),
    ["subscriptions"],
)
def proportion_interval(spark, folder):
    counts = (
        roles.subscriptions(spark, folder)
        .groupBy("plan_type")
        .agg(F.count_if(F.col("subscription_status") == "cancelled").alias("successes"), F.count("*").alias("observations"))
    )
    return rounded(st.proportion_interval(counts, "successes", "observations"), 9, "lower", "upper")


MOMENTS_SQL = """
SELECT *, CASE WHEN pooled > 0 THEN (mean1 - mean2) / sqrt(pooled) * (1 - 3 / (4 * (n1 + n2 - 2) - 1.0::DOUBLE))
  ELSE 0 END AS g
FROM (SELECT *, ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) AS pooled FROM (
  SELECT count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2,
    avg(v) FILTER (WHERE side = 1) AS mean1, avg(v) FILTER (WHERE side = 2) AS mean2,
    var_samp(v) FILTER (WHERE side = 1) AS var1, var_samp(v) FILTER (WHERE side = 2) AS var2
  FROM ({sample}) WHERE v IS NOT NULL AND side IS NOT NULL))"""
CHURN_SAMPLE = f"SELECT average_resolution_hours AS v, 2 - churned AS side FROM ({SUPPORT_SQL})"
PRICE_SAMPLE = (
    "SELECT l_extendedprice AS v, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS side FROM lineitem"
)


@STATISTICS.add(
    "two_sample_moments",
    f"""SELECT n1, n2, round(mean1, 8) AS mean1, round(mean2, 8) AS mean2, round(var1, 8) AS var1,
      round(var2, 8) AS var2, round(g, 8) AS hedges_g FROM ({MOMENTS_SQL.format(sample=CHURN_SAMPLE)})""",
    SUPPORT_ROLES,
)
def two_sample_moments(spark, folder):
    row = st.two_sample_moments(_support(spark, folder), "average_resolution_hours", "churned", 1, 0)
    return rounded(row, 8, "mean1", "mean2", "var1", "var2", "hedges_g")


def welch_sql(sample: str, first: str, second: str) -> str:
    return f"""
    SELECT '{st.WELCH.replace("'", "''")}' AS test_used, n1 AS "n_{first}", n2 AS "n_{second}",
      round((mean1 - mean2) / sqrt(var1 / n1 + var2 / n2), 8) AS statistic,
      '{st.HEDGES_G.replace("'", "''")}' AS effect_size_name, round(g, 8) AS effect_size, 0.05::DOUBLE AS alpha
    FROM ({MOMENTS_SQL.format(sample=sample)})"""


@STATISTICS.add("welch_t_test", welch_sql(CHURN_SAMPLE, "1", "0"), SUPPORT_ROLES)
def welch_t_test(spark, folder):
    test = st.welch_t_test(_support(spark, folder), "average_resolution_hours", "churned", 1, 0)
    return _tested(test, "1", "0")


@STATISTICS.add("welch_t_test_lines", welch_sql(PRICE_SAMPLE, "R", "A"))
def welch_t_test_lines(spark, folder):
    test = st.welch_t_test(roles.table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag", "R", "A")
    return _tested(test, "R", "A")


def mann_whitney_sql(sample: str, first: str, second: str) -> str:
    return f"""
    SELECT '{st.MANN_WHITNEY}' AS test_used, n1 AS "n_{first}", n2 AS "n_{second}", u AS statistic,
      '{st.RANK_BISERIAL}' AS effect_size_name,
      round(2 * u / (CAST(n1 AS DOUBLE) * n2) - 1, 8) AS effect_size, 0.05::DOUBLE AS alpha
    FROM (SELECT count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2,
        CAST(sum(r) FILTER (WHERE side = 1) AS DOUBLE)
          - CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) * (count(*) FILTER (WHERE side = 1) + 1) / 2 AS u
      FROM (SELECT side, CAST(rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS DOUBLE) AS r
        FROM ({sample}) WHERE v IS NOT NULL AND side IS NOT NULL))"""


@STATISTICS.add("mann_whitney_test", mann_whitney_sql(CHURN_SAMPLE, "1", "0"), SUPPORT_ROLES)
def mann_whitney_test(spark, folder):
    test = st.mann_whitney_test(_support(spark, folder), "average_resolution_hours", "churned", 1, 0)
    return _tested(test, "1", "0")


@STATISTICS.add("mann_whitney_test_lines", mann_whitney_sql(PRICE_SAMPLE, "R", "A"))
def mann_whitney_test_lines(spark, folder):
    test = st.mann_whitney_test(roles.table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag", "R", "A")
    return _tested(test, "R", "A")


CHI_SQL = f"""
WITH cells AS (SELECT plan_type, subscription_status = 'cancelled' AS cancelled, CAST(count(*) AS DOUBLE) AS o
  FROM subscriptions GROUP BY ALL),
expected AS (SELECT o, sum(o) OVER (PARTITION BY plan_type) * sum(o) OVER (PARTITION BY cancelled) / sum(o) OVER () AS e,
  sum(o) OVER () AS n FROM cells)
SELECT '{st.CHI_SQUARE}' AS test_used, CAST(max(n) AS BIGINT) AS n_observations, count(*) AS n_cells,
  count(*) FILTER (WHERE e < 5) AS n_cells_expected_below_five, round(sum((o - e) ** 2 / e), 8) AS statistic,
  '{st.CRAMERS_V.replace("'", "''")}' AS effect_size_name, round(sqrt(sum((o - e) ** 2 / e) / max(n)), 8) AS effect_size,
  0.05::DOUBLE AS alpha, round(exp(-sum((o - e) ** 2 / e) / 2), 12) AS p_value FROM expected"""


@STATISTICS.add("chi_square_test", CHI_SQL, ["subscriptions"])
def chi_square_test(spark, folder):
    """Two degrees of freedom, so the p-value has a closed form that SQL can check."""
    test = st.chi_square_test(
        plan_contingency(roles.subscriptions(spark, folder)), "plan_type", ["not_cancelled", "cancelled"]
    )
    return _tested(rounded(test, 12, "p_value"), "observations", "cells", "cells_expected_below_five", extra=("p_value",))


def correlation_sql(sample: str, name: str, effect: str, ranked: bool) -> str:
    x, y = (
        (f"CAST(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS DOUBLE)" if ranked else c)
        for c in ("x", "y")
    )
    return f"""
    SELECT '{name}' AS test_used, count(*) AS n_complete_pairs, round(corr(a, b), 8) AS statistic,
      '{effect}' AS effect_size_name, round(corr(a, b), 8) AS effect_size, 0.05::DOUBLE AS alpha
    FROM (SELECT {x} AS a, {y} AS b FROM ({sample}) WHERE x IS NOT NULL AND y IS NOT NULL)"""


PAIR_SAMPLE = f"SELECT average_resolution_hours AS x, average_satisfaction AS y FROM ({SUPPORT_SQL})"
LINE_PAIRS = "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem"


@STATISTICS.add(
    "correlation_pearson", correlation_sql(PAIR_SAMPLE, st.PEARSON, "Pearson r", False), SUPPORT_ROLES
)
def correlation_pearson(spark, folder):
    test = st.correlation_test(
        _support(spark, folder), "average_resolution_hours", "average_satisfaction", method="pearson"
    )
    return _tested(test, "complete_pairs")


@STATISTICS.add("correlation_spearman", correlation_sql(PAIR_SAMPLE, st.SPEARMAN, "Spearman rho", True), SUPPORT_ROLES)
def correlation_spearman(spark, folder):
    test = st.correlation_test(_support(spark, folder), "average_resolution_hours", "average_satisfaction")
    return _tested(test, "complete_pairs")


@STATISTICS.add("correlation_spearman_lines", correlation_sql(LINE_PAIRS, st.SPEARMAN, "Spearman rho", True))
def correlation_spearman_lines(spark, folder):
    test = st.correlation_test(roles.table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return _tested(test, "complete_pairs")


@STATISTICS.add(
    "variance_ratio",
    f"SELECT round(greatest(var1, var2) / least(var1, var2), 8) AS variance_ratio FROM ({MOMENTS_SQL.format(sample=CHURN_SAMPLE)})",
    SUPPORT_ROLES,
)
def variance_ratio(spark, folder):
    ratio = st.variance_ratio(_support(spark, folder), "average_resolution_hours", "churned", 1, 0)
    return rounded(ratio, 8, "variance_ratio")


PERIODS = {"first": ("1998-01-01", "1998-03-31"), "second": ("1998-04-01", "1998-06-30")}


def exposure_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS period,
          count(*) FILTER (WHERE subscription_status = 'cancelled'
            AND end_date BETWEEN DATE '{start}' AND DATE '{end}') AS successes,
          count(*) FILTER (WHERE start_date <= DATE '{end}' AND (end_date IS NULL OR end_date >= DATE '{start}'))
            AS observations
        FROM subscriptions JOIN customers USING (customer_id) WHERE region = 'EUROPE'"""
        for name, (start, end) in PERIODS.items()
    )
    return wilson_sql(rows, "period")


@STATISTICS.add("exposure_churn_interval", exposure_sql(), ["customers", "subscriptions"])
def exposure_churn_interval(spark, folder):
    intervals = st.exposure_churn_interval(
        roles.subscriptions(spark, folder), roles.customers(spark, folder), "EUROPE", PERIODS
    )
    return rounded(intervals, 9, "lower", "upper")


@STATISTICS.add("business_tests")
def business_tests(spark, folder):
    return st.business_tests(_tables(spark, folder)).withColumn("sample_size", F.to_json("sample_size"))


@STATISTICS.add("business_descriptives")
def business_descriptives(spark, folder):
    return st.business_descriptives(_tables(spark, folder))
