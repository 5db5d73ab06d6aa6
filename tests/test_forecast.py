import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrain.operators import forecast as fc
from tallygrain.operators.forecast import ForecastConfig

CONFIG = ForecastConfig()


def month(i):
    return date(2020 + i // 12, i % 12 + 1, 1)


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, month(i), float(v)) for i, v in enumerate(values)], "k string, month date, value double")


def wavy(n=24):
    return [1000 * 1.012**i + 40 * math.sin(i) for i in range(n)]


def test_config_is_checked():
    for bad in ({"test_months": 0}, {"minimum_training_months": 2}, {"alphas": ()}, {"phis": (1.2,)}):
        with pytest.raises(ValueError):
            ForecastConfig(**bad)


def test_known_errors(spark):
    rows = spark.createDataFrame([(100.0, 90.0), (200.0, 220.0)], "actual_net_revenue double, forecast_net_revenue double")
    row = fc.forecast_metrics(rows).first()
    assert (row.mae, row.wape) == (15.0, 0.1) and row.rmse == pytest.approx(math.sqrt(250))


def test_simple_methods(spark):
    rows = fc.simple_forecasts(series(spark, range(1, 19)), CONFIG, by=["k"]).collect()
    naive = {r._index: r.forecast for r in rows if r.method == "naive"}
    average = {r._index: r.forecast for r in rows if r.method == "moving_average"}
    assert naive[0] is None and [naive[i] for i in range(12, 18)] == [float(v) for v in range(12, 18)]
    assert average[2] is None and average[3] == 2.0 and average[17] == 16.0


def brute_smoothing(values, config):
    """Least squares over start values for every triple, by numpy."""
    best = None
    for a, b, p in config.grid():
        forecasts = []
        for start in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0)):
            level, trend, path = *start, []
            for y in values:
                path.append(level + p * trend)
                # The unit runs see no data, so that the run is linear in its start.
                y = y if start == (0.0, 0.0) else 0.0
                new = a * y + (1 - a) * (level + p * trend)
                trend = b * (new - level) + (1 - b) * p * trend
                level = new
            forecasts.append((np.array(path), level, trend))
        (f0, l0, b0), (f1, l1, b1), (f2, l2, b2) = forecasts
        design = np.column_stack([f1, f2])
        solution, *_ = np.linalg.lstsq(design, np.array(values) - f0, rcond=None)
        errors = np.array(values) - f0 - design @ solution
        state = (float(errors @ errors), p, l0 + l1 * solution[0] + l2 * solution[1], b0 + b1 * solution[0] + b2 * solution[1], errors.mean())
        best = min(best, state) if best else state
    return best


def test_smoothing_matches_numpy_least_squares(spark):
    values = wavy(20)
    config = ForecastConfig(alphas=(0.2, 0.6), betas=(0.1, 0.4), phis=(0.9,), validation_months=3, test_months=3)
    states = {r.origin: r for r in fc.smoothing_states(series(spark, values), config, by=["k"]).collect()}
    assert sorted(states) == list(range(14, 21))
    for origin in (14, 17, 20):
        sse, phi, level, trend, bias = brute_smoothing(values[:origin], config)
        got = states[origin]
        assert got.sse == pytest.approx(sse, rel=1e-6)
        assert got.level + got.phi * got.trend + got.bias == pytest.approx(level + phi * trend + bias, rel=1e-9)


def test_a_month_does_not_change_its_own_forecast(spark):
    values = wavy()
    changed = values[:-1] + [values[-1] * 5]
    get = lambda v: {
        (r.method): r.forecast
        for r in fc.rolling_origin(series(spark, v), CONFIG, by=["k"]).filter("_index = 23").collect()
    }
    assert get(values) == pytest.approx(get(changed))


def test_backtest_selection_and_future(spark):
    monthly = series(spark, wavy()).unionAll(series(spark, [100.0] * 12 + wavy(14), "t"))
    rows = fc.backtest(monthly, CONFIG, by=["k"])
    counts = {(r.k, r.phase, r.method): r["count"] for r in rows.groupBy("k", "phase", "method").count().collect()}
    assert len(counts) == 12 and set(counts.values()) == {6}
    chosen = {r.k: r.method for r in fc.select_method(rows, by=["k"]).collect()}
    metrics = fc.forecast_metrics(rows.filter("phase = 'validation'"), by=["k", "method"]).collect()
    for k, method in chosen.items():
        assert min((m for m in metrics if m.k == k), key=lambda m: (m.wape, m.mae)).method == method
    future = fc.selected_future(monthly, rows, CONFIG, by=["k"]).collect()
    assert sorted((r.k, r.horizon_month, r.method) for r in future) == [(k, h, chosen[k]) for k in ("s", "t") for h in (1, 2, 3)]
    assert {str(r.month) for r in future if r.k == "s"} == {"2022-01-01", "2022-02-01", "2022-03-01"}


def test_moving_average_feeds_on_itself(spark):
    rows = fc.future_forecasts(series(spark, list(range(1, 25))), CONFIG, by=["k"]).filter("method = 'moving_average'").orderBy("horizon_month").collect()
    first = (22 + 23 + 24) / 3
    second = (23 + 24 + first) / 3
    assert [r.forecast_net_revenue for r in rows] == pytest.approx([first, second, (24 + first + second) / 3])


def test_gaps_short_and_low_series_are_reported(spark):
    monthly = series(spark, [5, 6, 0, 8]).filter("month <> DATE '2020-02-01'")
    problems = {(str(r.month), r.problem) for r in fc.series_problems(monthly, by=["k"]).collect()}
    assert problems == {("2020-02-01", "missing"), ("2020-03-01", "not positive")}
    with pytest.raises(ValueError, match="complete"):
        fc.require_series(monthly, CONFIG, by=["k"])
    with pytest.raises(ValueError, match="At least 24"):
        fc.require_series(series(spark, range(1, 24)), CONFIG, by=["k"])
    for refused in (fc.backtest, fc.future_forecasts, fc.rolling_origin):
        with pytest.raises(ValueError, match="complete"):
            refused(monthly, CONFIG, by=["k"])
    with pytest.raises(ValueError, match="At least 24"):
        fc.backtest(series(spark, range(1, 24)), CONFIG, by=["k"])
    many = monthly.unionAll(series(spark, range(1, 24), "t")).unionAll(series(spark, wavy(), "u")).unionAll(series(spark, [0, 1], "v"))
    rejects = {r.k: r.problem for r in fc.series_rejects(many, by=["k"], needed=24).collect()}
    assert rejects == {"s": "missing months", "t": "too short", "v": "not positive"}
    filled = [r.value for r in fc.fill_months(monthly, by=["k"], how="previous").orderBy("month").collect()]
    assert filled == [5.0, 5.0, 0.0, 8.0]


def test_series_facts(spark):
    values = wavy(30)
    row = fc.series_facts(series(spark, values), by=["k"]).first()
    assert row.overall_growth == pytest.approx(values[-1] / values[0] - 1)
    assert row.lag_12_correlation == pytest.approx(np.corrcoef(values[12:], values[:-12])[0, 1])
    assert fc.series_facts(series(spark, [1, 2, 3])).first().lag_12_correlation is None
    evidence = fc.forecast_evidence(series(spark, values).drop("k"), fc.backtest(series(spark, values).drop("k"), CONFIG), CONFIG)
    assert evidence.count() == 5 and evidence.filter(F.col("value").isNull()).count() == 0
