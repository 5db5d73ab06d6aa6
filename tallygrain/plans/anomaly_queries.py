"""Registered anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import anomaly as an
from tallygrain.operators.anomaly import AnomalyConfig
from tallygrain.plans.base import Registry, rounded
from tallygrain.sources import roles

ANOMALY = Registry()

CONFIG = AnomalyConfig(metric="total_cost")
COSTS = ["shipping_costs"]
PARTS = ("compute_cost", "storage_cost", "network_cost", "gpu_cost", "total_cost")
DAILY = f"SELECT date, {', '.join(f'sum({c}) AS {c}' for c in PARTS)} FROM shipping_costs GROUP BY date"
BOUNDS = """greatest(q1 - 1.5 * (q3 - q1), 0.0) AS ratio_lower, q3 + 1.5 * (q3 - q1) AS ratio_upper,
  greatest(q1 - 3.0 * (q3 - q1), 0.0) AS strong_lower, q3 + 3.0 * (q3 - q1) AS strong_upper"""
# Nine digits of a ratio decide nothing but the last bits that engines round differently.
FENCED = f"""WITH daily AS ({DAILY}),
  based AS (SELECT date, CAST(total_cost AS DOUBLE) AS observed_value,
    CASE WHEN count(*) OVER around >= 15 THEN quantile_cont(CAST(total_cost AS DOUBLE), 0.5) OVER around END
      AS local_baseline
    FROM daily WINDOW around AS (ORDER BY date ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING)),
  related AS (SELECT *, observed_value / nullif(local_baseline, 0) AS relative_to_baseline FROM based),
  quartiles AS (SELECT quantile_cont(relative_to_baseline, 0.25) AS q1, quantile_cont(relative_to_baseline, 0.75) AS q3
    FROM related),
  bounds AS (SELECT q1, q3, {BOUNDS} FROM quartiles),
  fenced AS (SELECT date, observed_value, local_baseline, relative_to_baseline,
    local_baseline * ratio_lower AS normal_range_lower, local_baseline * ratio_upper AS normal_range_upper,
    relative_to_baseline < ratio_lower OR relative_to_baseline > ratio_upper AS iqr_anomaly,
    relative_to_baseline < strong_lower OR relative_to_baseline > strong_upper AS strong_iqr_anomaly
    FROM related, bounds)"""


def _costs(spark, folder):
    return roles.shipping_costs(spark, folder)


def _fenced(spark, folder):
    return an.fenced(an.daily_costs(_costs(spark, folder)), CONFIG)


@ANOMALY.add(
    "daily_costs",
    f"SELECT date, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in PARTS)} FROM ({DAILY})",
    COSTS,
)
def daily_costs(spark, folder):
    daily = an.daily_costs(_costs(spark, folder))
    return daily.select("date", *[F.col(c).cast("double").alias(c) for c in PARTS])


@ANOMALY.add(
    "daily_problems",
    """WITH calendar AS (SELECT region, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT region, min(date) AS first, max(date) AS last FROM shipping_costs GROUP BY region))
    SELECT 'negative cost' AS problem, count(*) FILTER (WHERE least(compute_cost, storage_cost, network_cost, gpu_cost,
      total_cost) < 0) AS n FROM shipping_costs
    UNION ALL SELECT 'missing day', count(*) FROM calendar c WHERE NOT EXISTS
      (SELECT 1 FROM shipping_costs s WHERE s.region = c.region AND s.date = c.date)
    UNION ALL SELECT 'parts do not reconcile', count(*) FILTER (WHERE
      abs(compute_cost + storage_cost + network_cost + gpu_cost - total_cost) > 0.10) FROM shipping_costs""",
    COSTS,
)
def daily_problems(spark, folder):
    return an.daily_problems(_costs(spark, folder), by=["region"])


@ANOMALY.add(
    "fill_days",
    """WITH calendar AS (SELECT region, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT region, min(date) AS first, max(date) AS last FROM shipping_costs GROUP BY region))
    SELECT region, date, coalesce(CAST(total_cost AS DOUBLE), 0.0) AS total_cost FROM calendar
    LEFT JOIN shipping_costs USING (region, date)""",
    COSTS,
)
def fill_days(spark, folder):
    filled = an.fill_days(an.daily_costs(_costs(spark, folder), by=["region"]), by=["region"])
    return filled.select("region", "date", F.col("total_cost").cast("double").alias("total_cost"))


@ANOMALY.add("local_baseline", f"{FENCED} SELECT date, observed_value, round(local_baseline, 6) AS local_baseline FROM based", COSTS)
def local_baseline(spark, folder):
    return rounded(an.local_baseline(an.daily_costs(_costs(spark, folder)), CONFIG), 6, "local_baseline")


FENCE_COLUMNS = (
    "date", "observed_value", "local_baseline", "relative_to_baseline", "normal_range_lower", "normal_range_upper",
    "iqr_anomaly", "strong_iqr_anomaly",
)


@ANOMALY.add(
    "cost_fences",
    f"""{FENCED} SELECT date, observed_value, round(local_baseline, 4) AS local_baseline,
      round(relative_to_baseline, 9) AS relative_to_baseline, round(normal_range_lower, 4) AS normal_range_lower,
      round(normal_range_upper, 4) AS normal_range_upper, iqr_anomaly, strong_iqr_anomaly FROM fenced""",
    COSTS,
)
def cost_fences(spark, folder):
    rows = rounded(_fenced(spark, folder).select(*FENCE_COLUMNS), 9, "relative_to_baseline")
    return rounded(rows, 4, "local_baseline", "normal_range_lower", "normal_range_upper")


@ANOMALY.add(
    "fence_bounds",
    f"""{FENCED} SELECT round(q1, 9) AS ratio_q1, round(q3, 9) AS ratio_q3, round(ratio_lower, 9) AS ratio_lower,
      round(ratio_upper, 9) AS ratio_upper, round(strong_lower, 9) AS strong_ratio_lower,
      round(strong_upper, 9) AS strong_ratio_upper, round(q3 - q1, 9) AS ratio_iqr FROM bounds""",
    COSTS,
)
def fence_bounds(spark, folder):
    bounds = an.fence_bounds(_fenced(spark, folder))
    return rounded(bounds, 9, *bounds.columns)


# The forest's random splits have no SQL form. A day-of-month rule stands in for its flag here.
STATUS_SQL = f"""{FENCED},
  flagged AS (SELECT *, day(date) = 13 AS isolation_forest_anomaly FROM fenced),
  stated AS (SELECT *, strong_iqr_anomaly AND isolation_forest_anomaly AS strong_anomaly,
    iqr_anomaly OR isolation_forest_anomaly AS candidate_anomaly FROM flagged),
  judged AS (SELECT *, CASE WHEN strong_anomaly THEN 'strong_anomaly' WHEN candidate_anomaly THEN 'candidate_anomaly'
    ELSE 'normal' END AS status FROM stated)"""


def _judged(spark, folder):
    return an.consensus(
        _fenced(spark, folder).withColumn("isolation_forest_anomaly", F.dayofmonth("date") == 13)
    )


@ANOMALY.add(
    "cost_status",
    f"""{STATUS_SQL} SELECT date, strong_anomaly, candidate_anomaly, status, CASE status
      WHEN 'normal' THEN 'Within the expected robust local range for total_cost.'
      ELSE format(CASE status WHEN 'strong_anomaly' THEN 'Strong total_cost anomaly: {{:.1f}}% {{}} the robust local median; both the outer IQR fence and Isolation Forest agree.'
        ELSE 'Candidate total_cost anomaly: {{:.1f}}% {{}} the robust local median; only one method or the standard IQR fence flags it.' END,
        abs((relative_to_baseline - 1) * 100), CASE WHEN relative_to_baseline >= 1 THEN 'above' ELSE 'below' END)
      END AS interpretation FROM judged""",
    COSTS,
)
def cost_status(spark, folder):
    judged = _judged(spark, folder).withColumn("interpretation", an.interpretation("total_cost"))
    return judged.select("date", "strong_anomaly", "candidate_anomaly", "status", "interpretation")


@ANOMALY.add(
    "anomaly_counts",
    f"""{STATUS_SQL} SELECT count(*) FILTER (WHERE iqr_anomaly) AS iqr_candidates,
      count(*) FILTER (WHERE strong_iqr_anomaly) AS strong_iqr_outliers,
      count(*) FILTER (WHERE isolation_forest_anomaly) AS isolation_forest_anomalies,
      count(*) FILTER (WHERE strong_anomaly) AS final_strong_anomalies FROM judged""",
    COSTS,
)
def anomaly_counts(spark, folder):
    return an.method_counts(_judged(spark, folder))


@ANOMALY.add(
    "evaluate_period",
    f"""{STATUS_SQL},
    counted AS (SELECT count(*) FILTER (WHERE NOT f AND NOT e) AS true_negative, count(*) FILTER (WHERE f AND NOT e) AS false_positive,
      count(*) FILTER (WHERE NOT f AND e) AS false_negative, count(*) FILTER (WHERE f AND e) AS true_positive,
      coalesce(string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) FILTER (WHERE f), '') AS detected_dates,
      coalesce(string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) FILTER (WHERE NOT f AND e), '')
        AS missed_expected_dates
      FROM (SELECT date, candidate_anomaly AS f, date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AS e FROM judged))
    SELECT 'candidate_anomaly' AS flag, '1998-01-01/1998-03-31' AS expected_period,
      coalesce(CAST(true_positive AS DOUBLE) / nullif(true_positive + false_positive, 0), 0) AS precision,
      coalesce(CAST(true_positive AS DOUBLE) / nullif(true_positive + false_negative, 0), 0) AS recall,
      coalesce(CAST(2 * true_positive AS DOUBLE) / nullif(2 * true_positive + false_positive + false_negative, 0), 0)
        AS f1, true_negative, false_positive, false_negative, true_positive, detected_dates, missed_expected_dates
    FROM counted""",
    COSTS,
)
def evaluate_period(spark, folder):
    judged = _judged(spark, folder)
    rows = an.evaluate_period(judged, "1998-01-01", "1998-03-31", flag="candidate_anomaly")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("detected_dates", "missed_expected_dates")})


@ANOMALY.add(
    "strong_events",
    f"""{STATUS_SQL} SELECT date, observed_value, round(normal_range_lower, 4) AS normal_range_lower,
      round(normal_range_upper, 4) AS normal_range_upper, 0.0::DOUBLE AS anomaly_score
    FROM judged WHERE candidate_anomaly AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
    COSTS,
)
def strong_events(spark, folder):
    judged = _judged(spark, folder).withColumns(
        {"strong_anomaly": F.col("candidate_anomaly"), "anomaly_score": F.lit(0.0)}
    )
    return rounded(an.strong_events(judged, "1997-01-01", "1999-12-31"), 4, "normal_range_lower", "normal_range_upper")


@ANOMALY.add("cost_anomalies")
def cost_anomalies(spark, folder):
    return an.detect(_costs(spark, folder), CONFIG)


@ANOMALY.add("cost_anomaly_counts")
def cost_anomaly_counts(spark, folder):
    return an.method_counts(an.detect(_costs(spark, folder), CONFIG))


@ANOMALY.add("cost_anomalies_by_region")
def cost_anomalies_by_region(spark, folder):
    """Many series at once; the smallest scales lack some region days, which are filled from the day before.

    A region may have days without positive cost there, which the fences judge alone, so the check is off.
    """
    filled = an.fill_days(an.daily_costs(_costs(spark, folder), by=["region"]), by=["region"], how="previous")
    return an.detect(filled, CONFIG, by=["region"], check=False)
