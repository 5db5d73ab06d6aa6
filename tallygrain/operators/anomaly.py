"""Robust daily cost anomalies for one or many series (A1–A10).

Facts are summed to days first, so each series is bounded by its days. A series is keyed by the
``by`` columns, for example region; without them there is one company-wide series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.functions.exprs import as_double, ratio, tally
from tallygrain.functions.ranking import grouped_shape, running_totals
from tallygrain.operators.scope import iso_date
from tallygrain.schemas import COST_COLUMNS, COST_COMPONENTS
from tallygrain.session import materialize

EULER_GAMMA = 0.5772156649015329


@dataclass(frozen=True)
class AnomalyConfig:
    """A10: detection settings, checked when made."""

    metric: str = "gpu_cost"
    window_days: int = 29
    multiplier: float = 1.5
    strong_multiplier: float = 3.0
    contamination: float = 0.01
    trees: int = 300
    sample_size: int = 256
    seed: int = 42

    def __post_init__(self) -> None:
        if self.metric not in COST_COLUMNS:
            raise ValueError(f"metric must be one of {COST_COLUMNS}")
        if self.window_days < 7 or self.window_days % 2 == 0:
            raise ValueError("window_days must be odd and at least seven")
        if self.multiplier <= 0 or self.strong_multiplier <= self.multiplier:
            raise ValueError("multipliers must be positive, the strong one larger")
        if not 0 < self.contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        if self.trees < 50 or self.sample_size < 2:
            raise ValueError("at least 50 trees and samples of two are needed")


# --- daily series ----------------------------------------------------------------------------


def daily_costs(costs: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """A1: one exact cost row per series and day."""
    return costs.groupBy(*by, "date").agg(*[F.sum(c).alias(c) for c in COST_COLUMNS])


def _calendar(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        daily.groupBy(*by)
        .agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
        .select(*by, F.explode(F.sequence("_first", "_last")).alias("date"))
    )


def daily_problems(costs: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """A1: counts of negative cost rows, missing days and days whose parts miss the total by over 0.10."""
    daily = daily_costs(costs, by=by)
    parts = reduce(lambda a, b: a + b, [F.col(c) for c in COST_COMPONENTS])
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in COST_COLUMNS])
    found = [
        ("negative cost", costs.agg(tally(negative).alias("n"))),
        ("missing day", _calendar(daily, by).join(daily, [*by, "date"], "left_anti").agg(F.count("*").alias("n"))),
        (
            "parts do not reconcile",
            daily.agg(tally(F.abs(parts - F.col("total_cost")) > F.lit(Decimal("0.10"))).alias("n")),
        ),
    ]
    return reduce(
        lambda a, b: a.unionByName(b), [frame.select(F.lit(name).alias("problem"), "n") for name, frame in found]
    )


def fill_days(daily: DataFrame, *, by: Sequence[str] = (), how: str = "zero") -> DataFrame:
    """Complete the calendar with zeros or with the previous day, where the caller asks for it."""
    if how not in ("zero", "previous"):
        raise ValueError("how must be 'zero' or 'previous'")
    joined = _calendar(daily, by).join(daily, [*by, "date"], "left")
    if how == "zero":
        return joined.na.fill(0, list(COST_COLUMNS))
    so_far = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in COST_COLUMNS})


def require_daily(costs: DataFrame, config: AnomalyConfig, *, by: Sequence[str] = ()) -> None:
    """Raise unless there are rows, none negative, on a complete calendar, that reconcile and are positive."""
    if costs.isEmpty():
        raise ValueError("There are no cost rows")
    broken = [(r.problem, r.n) for r in daily_problems(costs, by=by).collect() if r.n]
    if broken:
        raise ValueError(f"Cost rows do not form a clean daily series: {broken}")
    if not daily_costs(costs, by=by).filter(F.col(config.metric) <= 0).isEmpty():
        raise ValueError(f"{config.metric} must be positive on every day")


# --- local baseline and fences ---------------------------------------------------------------


def local_baseline(daily: DataFrame, config: AnomalyConfig, *, by: Sequence[str] = ()) -> DataFrame:
    """A2: centred rolling median; a window cut off by an end of the series needs its half plus one."""
    half = config.window_days // 2
    around = Window.partitionBy(*by).orderBy("date").rowsBetween(-half, half)
    observed = as_double(config.metric)
    return daily.select(*by, "date", observed.alias("observed_value")).withColumn(
        "local_baseline",
        F.when(
            F.count("observed_value").over(around) >= half + 1,
            F.percentile("observed_value", F.lit(0.5)).over(around),
        ),
    )


def fenced(daily: DataFrame, config: AnomalyConfig, *, by: Sequence[str] = ()) -> DataFrame:
    """A3: ratio to the baseline, quartile fences of the whole series, and the two fence flags."""
    series = Window.partitionBy(*by)
    relative = F.col("relative_to_baseline")

    def fence(multiplier: float, side: int) -> Column:
        edge = F.col("ratio_q3") if side > 0 else F.col("ratio_q1")
        moved = edge + side * F.lit(float(multiplier)) * (F.col("ratio_q3") - F.col("ratio_q1"))
        return moved if side > 0 else F.greatest(moved, F.lit(0.0))

    return (
        local_baseline(daily, config, by=by)
        .withColumn("relative_to_baseline", ratio("observed_value", "local_baseline"))
        .withColumns(
            {
                "ratio_q1": F.percentile("relative_to_baseline", F.lit(0.25)).over(series),
                "ratio_q3": F.percentile("relative_to_baseline", F.lit(0.75)).over(series),
            }
        )
        .withColumns(
            {
                "ratio_lower": fence(config.multiplier, -1),
                "ratio_upper": fence(config.multiplier, 1),
                "strong_ratio_lower": fence(config.strong_multiplier, -1),
                "strong_ratio_upper": fence(config.strong_multiplier, 1),
            }
        )
        .withColumns(
            {
                "normal_range_lower": F.col("local_baseline") * F.col("ratio_lower"),
                "normal_range_upper": F.col("local_baseline") * F.col("ratio_upper"),
                "iqr_anomaly": (relative < F.col("ratio_lower")) | (relative > F.col("ratio_upper")),
                "strong_iqr_anomaly": (relative < F.col("strong_ratio_lower"))
                | (relative > F.col("strong_ratio_upper")),
            }
        )
    )


def fence_bounds(scored: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """A3: quartiles and fences, one row per series."""
    names = ("ratio_q1", "ratio_q3", "ratio_lower", "ratio_upper", "strong_ratio_lower", "strong_ratio_upper")
    return scored.groupBy(*by).agg(*[F.max(c).alias(c) for c in names]).withColumn(
        "ratio_iqr", F.col("ratio_q3") - F.col("ratio_q1")
    )


# --- isolation forest ------------------------------------------------------------------------


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def tree_steps(values: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[float, float]]:
    """One isolation tree over a sorted sample, as steps of its path length along the number line.

    The first step starts at minus infinity; each later one is (cut, change of path length beyond it).
    """
    deepest = math.ceil(math.log2(max(len(values), 2)))
    previous = 0.0
    # Leaves come off the stack from left to right; each entry is (low, high, depth, cut on its left).
    stack = [(0, len(values), 0, -math.inf)]
    while stack:
        low, high, depth, left_cut = stack.pop()
        if depth >= deepest or high - low <= 1 or values[low] == values[high - 1]:
            path = depth + expected_path(high - low)
            yield left_cut, path - previous
            previous = path
            continue
        cut = rng.uniform(values[low], values[high - 1])
        middle = int(np.searchsorted(values, cut, side="right"))
        middle = min(max(middle, low + 1), high - 1)
        stack.append((middle, high, depth + 1, cut))
        stack.append((low, middle, depth + 1, left_cut))


def _low_hashes(rows: DataFrame, config: AnomalyConfig) -> DataFrame:
    """The rows (_series, _key, _x) that may belong to a tree's sample, with the number of the tree.

    A row goes on to a tree only if its hash is low enough, judged by the size of its series. So many rows are expected
    below the limit that fewer than a sample would be ten deviations off.
    """
    size = config.sample_size
    share = F.lit(size + 10 * math.sqrt(size) + 20) / F.col("_rows")
    low = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    sizes = rows.groupBy("_series").agg(F.count("*").alias("_rows")).select("_series", low.alias("_low"))
    trees = F.filter(
        F.sequence(F.lit(1), F.lit(config.trees)),
        lambda tree: F.xxhash64(F.lit(config.seed), tree, F.col("_key")) <= F.col("_low"),
    )
    return rows.join(sizes, "_series").select("_series", "_key", "_x", F.explode(trees).alias("tree"))


def isolation_scores(
    frame: DataFrame, value: str, config: AnomalyConfig, *, key: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """A4: isolation-forest score of one value per row; higher is more unusual.

    A tree over one value only cuts the number line, so the summed path length of all trees is a
    step function. Each tree grows in its own task from the rows of least hash; a running sum over the
    distinct cuts and values, which no single task holds, then gives every row its mean path. The threshold is the ``1 - contamination`` quantile per
    series, ``anomaly_score`` is measured from it.
    """
    seed, size = config.seed, config.sample_size
    series = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = frame.select(*by, series.alias("_series"), F.col(key).alias("_key"), as_double(value).alias("_x")).filter("_x IS NOT NULL")
    order = F.xxhash64(F.lit(seed), F.col("tree"), F.col("_key"))
    sample = (
        _low_hashes(rows, config)
        .withColumn("_place", F.row_number().over(Window.partitionBy("_series", "tree").orderBy(order, "_key")))
        .filter(F.col("_place") <= size)
        .select("_series", "tree", "_x")
    )

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        values = np.sort(group["_x"].to_numpy())
        steps = pd.DataFrame(tree_steps(values, np.random.default_rng([seed, tree])), columns=["_x", "change"])
        return steps.assign(_series=group["_series"].iloc[0], sampled=len(values))

    steps = materialize(sample.groupBy("_series", "tree").applyInPandas(grow, "_series string, _x double, change double, sampled int"))
    # A value equal to a cut lies on its left, so values come before cuts at the same place.
    cuts = steps.groupBy("_series", "_x").agg(F.sum("change").alias("change")).withColumn("_is_cut", F.lit(1))
    places = rows.select("_series", "_x").distinct().withColumns({"change": F.lit(0.0), "_is_cut": F.lit(0)})
    line = running_totals(cuts.unionByName(places), order=["_x", "_is_cut"], sums=["change"], by=["_series"])
    paths = line.filter("_is_cut = 0").select("_series", "_x", (F.col("change_before") / config.trees).alias("_path"))
    n = F.col("_sampled").cast("double")
    typical = F.when(n > 2, 2 * (F.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n).when(n == 2, 1.0)
    scored = materialize(
        rows.join(paths, ["_series", "_x"])
        .join(steps.groupBy("_series").agg(F.max("sampled").alias("_sampled")), "_series")
        .withColumn("_score", F.pow(F.lit(2.0), -F.col("_path") / typical))
    )
    limits = grouped_shape(scored, "_score", ["_series"], {"_limit": 1 - config.contamination}).select("_series", "_limit")
    return scored.join(limits, "_series", "left").select(
        *by,
        F.col("_key").alias(key),
        (F.col("_score") - F.col("_limit")).alias("anomaly_score"),
        (F.col("_score") > F.col("_limit")).alias("isolation_forest_anomaly"),
    )


# --- consensus -------------------------------------------------------------------------------

# The texts of the interpretation, per status.
INTERPRETATION = {
    "strong_anomaly": "Strong {metric} anomaly: %.1f%% %s the robust local median; "
    "both the outer IQR fence and Isolation Forest agree.",
    "candidate_anomaly": "Candidate {metric} anomaly: %.1f%% %s the robust local median; "
    "only one method or the standard IQR fence flags it.",
    "normal": "Within the expected robust local range for {metric}.",
}


def consensus(scored: DataFrame) -> DataFrame:
    """A5: strong needs the outer fence and the forest, candidate the inner fence or the forest.

    A day the forest cannot score (no positive ratio) is judged by the fences alone.
    """
    forest = F.coalesce("isolation_forest_anomaly", F.lit(False))
    return scored.withColumn("isolation_forest_anomaly", forest).withColumns(
        {
            "strong_anomaly": F.col("strong_iqr_anomaly") & F.col("isolation_forest_anomaly"),
            "candidate_anomaly": F.col("iqr_anomaly") | F.col("isolation_forest_anomaly"),
        }
    ).withColumn(
        "status",
        F.when(F.col("strong_anomaly"), "strong_anomaly")
        .when(F.col("candidate_anomaly"), "candidate_anomaly")
        .otherwise("normal"),
    )


def interpretation(metric: str) -> Column:
    """One sentence per row."""
    off = (F.col("relative_to_baseline") - 1) * 100
    direction = F.when(off >= 0, "above").otherwise("below")
    texts = {status: text.format(metric=metric) for status, text in INTERPRETATION.items()}
    return (
        F.when(F.col("status") == "strong_anomaly", F.format_string(texts["strong_anomaly"], F.abs(off), direction))
        .when(F.col("status") == "candidate_anomaly", F.format_string(texts["candidate_anomaly"], F.abs(off), direction))
        .otherwise(texts["normal"])
    )


DETECTION_COLUMNS = (
    "date", "metric", "normal_range_lower", "normal_range_upper", "observed_value", "local_baseline",
    "relative_to_baseline", "iqr_anomaly", "strong_iqr_anomaly", "isolation_forest_anomaly", "candidate_anomaly",
    "strong_anomaly", "anomaly_score", "status", "interpretation",
)


def detect(costs: DataFrame, config: AnomalyConfig | None = None, *, by: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Scores, flags, status and text per series and day.

    Unless ``check`` is off, rows that do not form a clean daily series are an error. The day rows are few, so the forest is joined by key.
    """
    config = config or AnomalyConfig()
    if check:
        require_daily(costs, config, by=by)
    # Few rows, read three times from here on: the facts behind them are summed once.
    scored = materialize(fenced(daily_costs(costs, by=by), config, by=by))
    positive = F.when(F.col("relative_to_baseline") > 0, F.col("relative_to_baseline"))
    forest = isolation_scores(
        scored.select(*by, "date", F.log(positive).alias("log_ratio")), "log_ratio", config, by=by
    )
    return (
        consensus(scored.join(forest, [*by, "date"], "left"))
        .withColumns({"metric": F.lit(config.metric), "interpretation": interpretation(config.metric)})
        .select(*by, *DETECTION_COLUMNS)
        .orderBy(*by, "date")
    )


def method_counts(detections: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Days flagged by each method."""
    flags = {
        "iqr_candidates": "iqr_anomaly",
        "strong_iqr_outliers": "strong_iqr_anomaly",
        "isolation_forest_anomalies": "isolation_forest_anomaly",
        "final_strong_anomalies": "strong_anomaly",
    }
    return detections.groupBy(*by).agg(*[tally(F.col(flag)).alias(name) for name, flag in flags.items()])


def evaluate_period(
    detections: DataFrame, start: date | str, end: date | str, *, flag: str = "strong_anomaly", by: Sequence[str] = ()
) -> DataFrame:
    """A flag against an expected period. Empty denominators give zero."""
    first, last = iso_date(start), iso_date(end)
    if first > last:
        raise ValueError("start must not be after end")
    if flag not in detections.columns:
        raise ValueError(f"Unknown flag: {flag}")
    flagged, expected = F.coalesce(F.col(flag), F.lit(False)), F.col("date").between(F.lit(first), F.lit(last))

    def days(rule: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(rule, F.date_format("date", "yyyy-MM-dd"))))

    counted = detections.groupBy(*by).agg(
        tally(~flagged & ~expected).alias("true_negative"),
        tally(flagged & ~expected).alias("false_positive"),
        tally(~flagged & expected).alias("false_negative"),
        tally(flagged & expected).alias("true_positive"),
        days(flagged).alias("detected_dates"),
        days(~flagged & expected).alias("missed_expected_dates"),
    )
    hit = F.col("true_positive")

    def share(whole: Column) -> Column:
        return F.coalesce(ratio(hit, whole), F.lit(0.0))

    return counted.select(
        *by,
        F.lit(flag).alias("flag"),
        F.lit(f"{first}/{last}").alias("expected_period"),
        share(hit + F.col("false_positive")).alias("precision"),
        share(hit + F.col("false_negative")).alias("recall"),
        F.coalesce(ratio(2 * hit, 2 * hit + F.col("false_positive") + F.col("false_negative")), F.lit(0.0)).alias("f1"),
        "true_negative",
        "false_positive",
        "false_negative",
        "true_positive",
        "detected_dates",
        "missed_expected_dates",
    )


def strong_events(detections: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Strong anomalies in a period, in date order."""
    return (
        detections.filter(
            F.col("strong_anomaly") & F.col("date").between(F.lit(iso_date(start)), F.lit(iso_date(end)))
        )
        .select("date", "observed_value", "normal_range_lower", "normal_range_upper", "anomaly_score")
        .orderBy("date")
    )
