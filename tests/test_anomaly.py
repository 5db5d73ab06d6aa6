import math
import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrain.operators import anomaly as an
from tallygrain.operators.anomaly import AnomalyConfig

START = date(2024, 1, 1)
SPIKE = range(120, 127)
COSTS = "region string, date date, compute_cost decimal(14,2), storage_cost decimal(14,2), network_cost decimal(14,2), gpu_cost decimal(14,2), total_cost decimal(14,2)"


def costs(spark, days=300, region="r", seed=1):
    draw, rows = random.Random(seed), []
    for i in range(days):
        gpu = 100 + 0.1 * i + draw.gauss(0, 2)
        gpu = gpu * 1.8 if i in SPIKE else gpu
        parts = [Decimal(f"{v:.2f}") for v in (10, 20, 30, gpu)]
        rows.append((region, START + timedelta(days=i), *parts, sum(parts)))
    return spark.createDataFrame(rows, COSTS)


def test_config_is_checked():
    for bad in ({"metric": "x"}, {"window_days": 8}, {"window_days": 5}, {"strong_multiplier": 1.0}, {"contamination": 0.6}, {"trees": 10}):
        with pytest.raises(ValueError):
            AnomalyConfig(**bad)


def test_injected_week_is_found(spark):
    config = AnomalyConfig(contamination=0.04, trees=100)
    found = an.detect(costs(spark), config, check=True)
    rows = found.collect()
    assert len(rows) == 300 and found.columns == list(an.DETECTION_COLUMNS)
    week = [START + timedelta(days=i) for i in SPIKE]
    assert [r.date for r in rows if r.strong_anomaly] == week
    outcome = an.evaluate_period(found, str(week[0]), str(week[-1])).first()
    assert (outcome.precision, outcome.recall, outcome.f1) == (1.0, 1.0, 1.0)
    assert outcome.detected_dates == [str(d) for d in week] and outcome.missed_expected_dates == []
    counts = an.method_counts(found).first()
    assert counts.final_strong_anomalies == 7 and counts.isolation_forest_anomalies <= math.ceil(300 * 0.04)
    assert all(r.interpretation.startswith("Strong gpu_cost anomaly: ") for r in rows if r.strong_anomaly)
    assert [r.date for r in an.strong_events(found, str(week[2]), "2024-12-31").collect()] == week[2:]


def test_many_series_equal_single_ones(spark):
    config = AnomalyConfig(trees=60)
    both = an.detect(costs(spark, 60, "a", 1).unionAll(costs(spark, 60, "b", 2)), config, by=["region"])
    alone = an.detect(costs(spark, 60, "b", 2), config).collect()
    assert [r.relative_to_baseline for r in both.filter("region = 'b'").collect()] == [r.relative_to_baseline for r in alone]
    assert [r.anomaly_score for r in both.filter("region = 'b'").collect()] == pytest.approx([r.anomaly_score for r in alone])


def test_baseline_matches_pandas(spark):
    config = AnomalyConfig(window_days=7)
    got = an.local_baseline(an.daily_costs(costs(spark, 40)), config).orderBy("date").toPandas()
    expected = pd.Series(got["observed_value"]).rolling(7, center=True, min_periods=4).median()
    assert np.allclose(got["local_baseline"], expected)
    short = an.local_baseline(an.daily_costs(costs(spark, 3)), config).collect()
    assert all(r.local_baseline is None for r in short)


def test_problems(spark):
    base = costs(spark, 10)
    bad = base.filter(F.col("date") != F.lit(date(2024, 1, 4))).withColumn(
        "total_cost", F.when(F.col("date") == F.lit(date(2024, 1, 6)), F.col("total_cost") + 1).otherwise(F.col("total_cost"))
    )
    assert {r.problem: r.n for r in an.daily_problems(bad).collect()} == {
        "negative cost": 0, "missing day": 1, "parts do not reconcile": 1,
    }
    with pytest.raises(ValueError, match="clean daily series"):
        an.require_daily(bad, AnomalyConfig())
    with pytest.raises(ValueError, match="no cost rows"):
        an.require_daily(base.limit(0), AnomalyConfig())
    assert an.fill_days(an.daily_costs(bad), how="zero").count() == 10


def test_tree_steps_are_a_path_length_function():
    values = np.sort(np.random.default_rng(5).normal(size=64))
    steps = list(an.tree_steps(values, np.random.default_rng(1)))
    assert steps[0][0] == -math.inf and [s[0] for s in steps] == sorted(s[0] for s in steps)
    heights = np.cumsum([s[1] for s in steps])
    assert (heights > 0).all() and heights.max() <= math.ceil(math.log2(64)) + an.expected_path(64)
    same = list(an.tree_steps(np.array([3.0, 3.0, 3.0]), np.random.default_rng(1)))
    assert same == [(-math.inf, an.expected_path(3))]


def test_outlier_scores_highest(spark):
    rows = [(START + timedelta(days=i), float(i % 10)) for i in range(100)] + [(START + timedelta(days=200), 90.0)]
    scores = an.isolation_scores(spark.createDataFrame(rows, "date date, x double"), "x", AnomalyConfig(trees=60)).collect()
    best = max(scores, key=lambda r: r.anomaly_score)
    assert best.date == START + timedelta(days=200) and best.isolation_forest_anomaly
    assert len(scores) == 101


def test_isolation_scores_equal_brute_force(spark):
    """Two series and one without a name; the samples are the rows of least hash of each tree."""
    config = AnomalyConfig(trees=50, sample_size=40, contamination=0.1)
    draw = np.random.default_rng(3)
    rows = [(r, START + timedelta(days=i), float(x)) for r, size in (("a", 700), ("b", 30), (None, 90)) for i, x in enumerate(draw.normal(size=size).round(1))]
    frame = spark.createDataFrame([*rows, ("a", START - timedelta(days=1), None)], "region string, date date, x double")
    hashed = frame.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(50)))).select(
        "region", "date", "tree", F.xxhash64(F.lit(config.seed), "tree", "date").alias("h")
    )
    order = {(r.region, r.date, r.tree): (r.h, r.date) for r in hashed.collect()}
    got = {(r.region, r.date): (r.anomaly_score, r.isolation_forest_anomaly) for r in an.isolation_scores(frame, "x", config, by=["region"]).collect()}
    assert len(got) == len(rows)
    for region in ("a", "b", None):
        own = [(d, x) for r, d, x in rows if r == region]
        values, paths = np.array([x for _, x in own]), np.zeros(len(own))
        for tree in range(1, 51):
            sample = sorted(own, key=lambda row: order[region, row[0], tree])[: config.sample_size]
            cuts = list(an.tree_steps(np.sort([x for _, x in sample]), np.random.default_rng([config.seed, tree])))
            paths += [sum(change for cut, change in cuts if cut < x) for x in values]
        n = min(config.sample_size, len(own))
        scores = 2.0 ** (-paths / 50 / (2 * (math.log(n - 1) + an.EULER_GAMMA) - 2 * (n - 1) / n))
        limit = np.quantile(scores, 0.9)
        for (day, _), score in zip(own, scores, strict=True):
            assert got[region, day][0] == pytest.approx(score - limit, abs=1e-9)


def test_few_rows_go_on_to_a_tree(spark):
    """Little more than a sample for each tree, however long the series, and never less."""
    rows = spark.range(20_000).select(F.lit("").alias("_series"), F.col("id").alias("_key"), F.rand(1).alias("_x"))
    config = AnomalyConfig(trees=50, sample_size=64)
    for frame, fits in ((rows, lambda n: 64 <= n <= 290), (rows.where("_key < 50"), lambda n: n == 50)):
        counts = an._low_hashes(frame, config).groupBy("tree").count().collect()
        assert len(counts) == 50 and all(fits(r["count"]) for r in counts)
