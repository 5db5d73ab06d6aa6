"""Registered forecasting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import forecast as fc
from tallygrain.operators.forecast import ForecastConfig
from tallygrain.plans.base import Registry, rounded
from tallygrain.session import materialize
from tallygrain.sources import roles

FORECAST = Registry()

CONFIG = ForecastConfig()
SALES = ["sales"]
MONTHLY = """SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, CAST(sum(net_revenue) AS DOUBLE) AS value
  FROM sales GROUP BY 1"""
MONTHLY_BY_REGION = """SELECT region, CAST(date_trunc('month', sale_date) AS DATE) AS month,
  CAST(sum(net_revenue) AS DOUBLE) AS value FROM sales GROUP BY ALL"""


def _total(spark, folder):
    """The months of the whole company. Every later step reads these few rows, not the facts again."""
    return materialize(fc.monthly_series(roles.sale_lines(spark, folder)))


def _by_region(spark, folder):
    return materialize(fc.monthly_series(roles.sale_lines(spark, folder), by=["region"], owners=roles.sale_owners(spark, folder)))


def _tested_by_region(monthly):
    return materialize(fc.backtest(monthly, CONFIG, by=["region"]))


def _values(name: str, values) -> str:
    return f"(SELECT unnest([{', '.join(map(repr, values))}]::DOUBLE[]) AS {name})"


# The smoothing recursion, one row per parameter triple and prefix length; ``{by}`` keys the series.
def smoothing_sql(by: str = "") -> str:
    key, on = (f"{by}, ", f"v.{by} = s.{by} AND ") if by else ("", "")
    of_s = f"s.{by}, " if by else ""
    source = MONTHLY_BY_REGION if by else MONTHLY
    part = f"PARTITION BY {by}" if by else ""
    grid = (
        f"(SELECT * FROM {_values('alpha', CONFIG.alphas)}, {_values('beta', CONFIG.betas)}, {_values('phi', CONFIG.phis)})"
    )
    keys = f"(SELECT DISTINCT {by} FROM series)," if by else ""
    return f"""WITH RECURSIVE
  series AS (SELECT {key}month, value, row_number() OVER ({part} ORDER BY month) - 1 AS idx,
    count(*) OVER ({part}) AS months FROM ({source})),
  fold AS (
    SELECT {key}alpha, beta, phi, 0::BIGINT AS seen, 0::DOUBLE AS l0, 1::DOUBLE AS l1, 0::DOUBLE AS l2,
      0::DOUBLE AS b0, 0::DOUBLE AS b1, 1::DOUBLE AS b2, 0::DOUBLE AS s11, 0::DOUBLE AS s12, 0::DOUBLE AS s22,
      0::DOUBLE AS c1, 0::DOUBLE AS c2, 0::DOUBLE AS rr, 0::DOUBLE AS r, 0::DOUBLE AS f1, 0::DOUBLE AS f2
    FROM {keys} {grid}
    UNION ALL
    SELECT {key}alpha, beta, phi, seen + 1, n0, n1, n2,
      beta * (n0 - l0) + (1 - beta) * phi * b0, beta * (n1 - l1) + (1 - beta) * phi * b1,
      beta * (n2 - l2) + (1 - beta) * phi * b2, s11 + g1 * g1, s12 + g1 * g2, s22 + g2 * g2, c1 + g1 * rest,
      c2 + g2 * rest, rr + rest * rest, r + rest, f1 + g1, f2 + g2
    FROM (SELECT *, y - g0 AS rest, alpha * y + (1 - alpha) * g0 AS n0, (1 - alpha) * g1 AS n1, (1 - alpha) * g2 AS n2
      FROM (SELECT s.*, v.value AS y, l0 + phi * b0 AS g0, l1 + phi * b1 AS g1, l2 + phi * b2 AS g2
        FROM fold s JOIN series v ON {on}v.idx = s.seen))
  ),
  solved AS (
    SELECT {key}alpha, beta, phi, seen AS origin, rr - u * c1 - w * c2 AS sse, l0 + l1 * u + l2 * w AS level,
      b0 + b1 * u + b2 * w AS trend, (r - f1 * u - f2 * w) / seen AS bias
    FROM (SELECT *, (c1 * s22 - c2 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS u,
        (c2 * s11 - c1 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS w FROM fold WHERE seen >= 3)
  ),
  best AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}origin ORDER BY sse, alpha, beta, phi) AS place
      FROM solved WHERE sse IS NOT NULL) WHERE place = 1
  ),
  smooth AS (
    SELECT {of_s}s.month, s.value, s.idx, s.months, 'exponential_smoothing' AS method,
      b.level + b.phi * b.trend + b.bias AS forecast
    FROM series s JOIN best b ON {f"b.{by} = s.{by} AND " if by else ""}b.origin = s.idx WHERE s.idx >= s.months - 12
  ),
  simple AS (
    SELECT *, lag(value) OVER (ord) AS naive,
      CASE WHEN idx >= 3 THEN avg(value) OVER (ord ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS moving_average
    FROM series WINDOW ord AS ({part} ORDER BY month)
  ),
  steps AS (
    SELECT {key}month, value, idx, months, 'naive' AS method, naive AS forecast FROM simple
    UNION ALL SELECT {key}month, value, idx, months, 'moving_average', moving_average FROM simple
    UNION ALL SELECT * FROM smooth
  ),
  tested AS (
    SELECT {key}CASE WHEN months - idx <= 6 THEN 'test' ELSE 'validation' END AS phase, month, method,
      value AS actual_net_revenue, forecast AS forecast_net_revenue, abs(value - forecast) AS absolute_error
    FROM steps WHERE months - idx <= 12 AND months >= 24
  ),
  scored AS (
    SELECT {key}phase, method, avg(absolute_error) AS mae, sqrt(avg(absolute_error * absolute_error)) AS rmse,
      sum(absolute_error) / sum(abs(actual_net_revenue)) AS wape FROM tested GROUP BY ALL
  ),
  chosen AS (
    SELECT {key}method FROM (SELECT *, row_number() OVER (PARTITION BY {key}phase ORDER BY wape, mae,
      list_position(['naive', 'moving_average', 'exponential_smoothing'], method)) AS place
      FROM scored WHERE phase = 'validation') WHERE place = 1
  )"""


@FORECAST.add("monthly_net_revenue", MONTHLY, SALES)
def monthly_net_revenue(spark, folder):
    return fc.monthly_series(roles.sale_lines(spark, folder))


@FORECAST.add("monthly_net_revenue_by_region", MONTHLY_BY_REGION, SALES)
def monthly_net_revenue_by_region(spark, folder):
    return fc.monthly_series(roles.sale_lines(spark, folder), by=["region"], owners=roles.sale_owners(spark, folder))


# Series per part brand and type have months without sales.
GAPPY_SQL = """WITH lines AS (SELECT p_brand || ' ' || p_type AS item, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS price FROM lineitem JOIN part ON p_partkey = l_partkey),
  months AS (SELECT item, month, CAST(sum(price) AS DOUBLE) AS value FROM lines GROUP BY ALL),
  calendar AS (SELECT item, CAST(unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS DATE) AS month
    FROM (SELECT item, min(month) AS first, max(month) AS last FROM months GROUP BY item))"""


def _gappy(spark, folder):
    lines = roles.table(spark, folder, "lineitem").join(
        roles.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    sales = lines.select(
        F.concat_ws(" ", "p_brand", "p_type").alias("item"),
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("net_revenue"),
    )
    return fc.monthly_series(sales, by=["item"])


@FORECAST.add(
    "series_problems",
    f"""{GAPPY_SQL} SELECT item, month, 'missing' AS problem FROM calendar
    WHERE NOT EXISTS (SELECT 1 FROM months m WHERE m.item = calendar.item AND m.month = calendar.month)
    UNION ALL SELECT item, month, 'not positive' FROM months WHERE value <= 0""",
)
def series_problems(spark, folder):
    return fc.series_problems(_gappy(spark, folder), by=["item"])


@FORECAST.add(
    "fill_months",
    f"""{GAPPY_SQL} SELECT item, c.month, last_value(value IGNORE NULLS) OVER (PARTITION BY item ORDER BY c.month
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM calendar c LEFT JOIN months m USING (item, month)""",
)
def fill_months(spark, folder):
    return fc.fill_months(_gappy(spark, folder), by=["item"], how="previous")


@FORECAST.add(
    "short_series",
    f"{GAPPY_SQL} SELECT item, count(*) AS months FROM months GROUP BY item HAVING count(*) < 60",
)
def short_series(spark, folder):
    return fc.short_series(_gappy(spark, folder), ForecastConfig(minimum_training_months=48), by=["item"])


@FORECAST.add(
    "simple_forecasts",
    f"""{smoothing_sql()} SELECT month, method, value, round(forecast, 4) AS forecast FROM steps
    WHERE method <> 'exponential_smoothing'""",
    SALES,
)
def simple_forecasts(spark, folder):
    rows = fc.simple_forecasts(_total(spark, folder), CONFIG)
    return rounded(rows.select("month", "method", "value", "forecast"), 4, "forecast")


@FORECAST.add(
    "smoothing_states",
    f"""{smoothing_sql()} SELECT origin::INTEGER AS origin, alpha, beta, phi, round(level, 2) AS level,
      round(trend, 2) AS trend, round(bias, 2) AS bias FROM best WHERE origin >= (SELECT max(months) - 12 FROM series)""",
    SALES,
)
def smoothing_states(spark, folder):
    return rounded(fc.smoothing_states(_total(spark, folder), CONFIG), 2, "level", "trend", "bias").drop("sse")


BACKTEST_ROWS = """phase, month, method, actual_net_revenue, round(forecast_net_revenue, 2) AS forecast_net_revenue,
  round(absolute_error, 2) AS absolute_error"""


@FORECAST.add("rolling_origin", f"{smoothing_sql()} SELECT month, method, round(forecast, 2) AS forecast FROM steps", SALES)
def rolling_origin(spark, folder):
    return rounded(fc.rolling_origin(_total(spark, folder), CONFIG).select("month", "method", "forecast"), 2, "forecast")


# Every seventh month is left out for one region, another one ends early.
@FORECAST.add(
    "series_rejects",
    f"""WITH series AS (SELECT * FROM ({MONTHLY_BY_REGION}) WHERE NOT (region = 'ASIA' AND month(month) = 7)
      AND NOT (region = 'EUROPE' AND month >= DATE '1996-06-01'))
    SELECT region, months, CASE WHEN span <> months THEN 'missing months' WHEN least <= 0 THEN 'not positive'
      ELSE 'too short' END AS problem
    FROM (SELECT region, count(*) AS months, min(value) AS least,
      datediff('month', min(month), max(month)) + 1 AS span FROM series GROUP BY region)
    WHERE span <> months OR least <= 0 OR months < {CONFIG.required_months}""",
    SALES,
)
def series_rejects(spark, folder):
    monthly = _by_region(spark, folder).filter(
        "NOT (region = 'ASIA' AND month(month) = 7) AND NOT (region = 'EUROPE' AND month >= DATE '1996-06-01')"
    )
    return fc.series_rejects(monthly, by=["region"], needed=CONFIG.required_months)


@FORECAST.add("backtest", f"{smoothing_sql()} SELECT {BACKTEST_ROWS} FROM tested", SALES)
def backtest(spark, folder):
    return rounded(fc.backtest(_total(spark, folder), CONFIG), 2, "forecast_net_revenue", "absolute_error")


@FORECAST.add("backtest_by_region", f"{smoothing_sql('region')} SELECT region, {BACKTEST_ROWS} FROM tested", SALES)
def backtest_by_region(spark, folder):
    rows = fc.backtest(_by_region(spark, folder), CONFIG, by=["region"])
    return rounded(rows, 2, "forecast_net_revenue", "absolute_error")


@FORECAST.add(
    "forecast_metrics",
    f"""{smoothing_sql('region')} SELECT region, phase, method, round(mae, 2) AS mae, round(rmse, 2) AS rmse,
      round(wape, 8) AS wape FROM scored""",
    SALES,
)
def forecast_metrics(spark, folder):
    rows = _tested_by_region(_by_region(spark, folder))
    return rounded(rounded(fc.forecast_metrics(rows, by=["region", "phase", "method"]), 2, "mae", "rmse"), 8, "wape")


@FORECAST.add("select_method", f"{smoothing_sql('region')} SELECT region, method FROM chosen", SALES)
def select_method(spark, folder):
    return fc.select_method(_tested_by_region(_by_region(spark, folder)), by=["region"])


def future_sql(by: str) -> str:
    return f"""{smoothing_sql(by)},
  ends AS (SELECT {by}, month AS last_month, months, value AS y1 FROM series WHERE idx = months - 1),
  recent AS (SELECT e.*, a.value AS y2, b.value AS y3 FROM ends e
    JOIN series a ON a.{by} = e.{by} AND a.idx = e.months - 2 JOIN series b ON b.{by} = e.{by} AND b.idx = e.months - 3),
  averages AS (SELECT *, (y3 + y2 + y1) / 3 AS m1, (y2 + y1 + (y3 + y2 + y1) / 3) / 3 AS m2 FROM recent),
  future AS (
    SELECT {by}, last_month, 'naive' AS method, k, y1 AS forecast FROM averages, (SELECT unnest([1, 2, 3]) AS k)
    UNION ALL SELECT {by}, last_month, 'moving_average', k,
      CASE k WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE (y1 + m1 + m2) / 3 END FROM averages, (SELECT unnest([1, 2, 3]) AS k)
    UNION ALL SELECT e.{by}, last_month, 'exponential_smoothing', k,
      level + trend * (CASE k WHEN 1 THEN phi WHEN 2 THEN phi + phi ** 2 ELSE phi + phi ** 2 + phi ** 3 END) + bias
      FROM ends e JOIN best b ON b.{by} = e.{by} AND b.origin = e.months, (SELECT unnest([1, 2, 3]) AS k)
  )"""


FUTURE_ROWS = """{by}, CAST(last_month + to_months(k) AS DATE) AS month, method, k AS horizon_month,
  round(forecast, 2) AS forecast_net_revenue"""


@FORECAST.add("future_forecasts", f"{future_sql('region')} SELECT {FUTURE_ROWS.format(by='region')} FROM future", SALES)
def future_forecasts(spark, folder):
    rows = fc.future_forecasts(_by_region(spark, folder), CONFIG, by=["region"])
    return rounded(rows, 2, "forecast_net_revenue")


@FORECAST.add(
    "selected_future",
    f"{future_sql('region')} SELECT {FUTURE_ROWS.format(by='region')} FROM future JOIN chosen USING (region, method)",
    SALES,
)
def selected_future(spark, folder):
    monthly = _by_region(spark, folder)
    rows = _tested_by_region(monthly)
    return rounded(fc.selected_future(monthly, rows, CONFIG, by=["region"]), 2, "forecast_net_revenue")


@FORECAST.add(
    "selected_test_rows",
    f"{smoothing_sql('region')} SELECT region, {BACKTEST_ROWS} FROM tested JOIN chosen USING (region, method) WHERE phase = 'test'",
    SALES,
)
def selected_test_rows(spark, folder):
    rows = _tested_by_region(_by_region(spark, folder))
    return rounded(fc.selected_test_rows(rows, by=["region"]), 2, "forecast_net_revenue", "absolute_error")


@FORECAST.add(
    "series_facts",
    f"""SELECT region, count(*) AS observations, min(month) AS start_month, max(month) AS end_month,
      arg_max(value, month) / arg_min(value, month) - 1 AS overall_growth,
      round(corr(value, year_ago), 9) AS lag_12_correlation
    FROM (SELECT *, lag(value, 12) OVER (PARTITION BY region ORDER BY month) AS year_ago FROM ({MONTHLY_BY_REGION}))
    GROUP BY region""",
    SALES,
)
def series_facts(spark, folder):
    return rounded(fc.series_facts(_by_region(spark, folder), by=["region"]), 9, "lag_12_correlation")


@FORECAST.add(
    "phase_periods",
    f"""SELECT region, CASE WHEN left_months <= 6 THEN 'test' WHEN left_months <= 12 THEN 'validation'
      ELSE 'initial_training' END AS phase, min(month) AS start_month, max(month) AS end_month
    FROM (SELECT region, month, count(*) OVER (PARTITION BY region)
        - row_number() OVER (PARTITION BY region ORDER BY month) + 1 AS left_months FROM ({MONTHLY_BY_REGION}))
    GROUP BY ALL""",
    SALES,
)
def phase_periods(spark, folder):
    return fc.phase_periods(_by_region(spark, folder), CONFIG, by=["region"])


GAIN_SQL = """SELECT s.region, s.method, s.mae, s.rmse, s.wape,
    (n.wape - s.wape) / nullif(n.wape, 0) AS test_wape_improvement_over_naive
  FROM scored s JOIN chosen USING (region, method) JOIN scored n ON n.region = s.region AND n.phase = 'test'
    AND n.method = 'naive' WHERE s.phase = 'test'"""


@FORECAST.add(
    "gain_over_naive",
    f"""{smoothing_sql('region')} SELECT region, method, round(mae, 2) AS mae, round(rmse, 2) AS rmse,
      round(wape, 8) AS wape, round(test_wape_improvement_over_naive, 8) AS test_wape_improvement_over_naive
    FROM ({GAIN_SQL})""",
    SALES,
)
def gain_over_naive(spark, folder):
    rows = fc.gain_over_naive(_tested_by_region(_by_region(spark, folder)), by=["region"])
    return rounded(rounded(rows, 2, "mae", "rmse"), 8, "wape", "test_wape_improvement_over_naive")


@FORECAST.add(
    "forecast_evidence",
    f"""{future_sql('region')}, gain AS ({GAIN_SQL})
    SELECT region, 'next_month_net_revenue' AS metric, round(forecast, 4) AS value, 'currency' AS unit
      FROM future JOIN chosen USING (region, method) WHERE k = 1
    UNION ALL SELECT region, 'test_mae', round(mae, 4), 'currency' FROM gain
    UNION ALL SELECT region, 'test_rmse', round(rmse, 4), 'currency' FROM gain
    UNION ALL SELECT region, 'test_wape', round(wape, 4), 'ratio' FROM gain
    UNION ALL SELECT region, 'test_wape_improvement_over_naive', round(test_wape_improvement_over_naive, 4), 'ratio'
      FROM gain""",
    SALES,
)
def forecast_evidence(spark, folder):
    monthly = _by_region(spark, folder)
    rows = _tested_by_region(monthly)
    return rounded(fc.forecast_evidence(monthly, rows, CONFIG, by=["region"]), 4, "value")
