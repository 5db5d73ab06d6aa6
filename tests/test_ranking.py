"""Distributed running totals against pandas, with a hot value and a hot group."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrain.functions import ranking
from tallygrain.functions.ranking import (
    average_ranks,
    column_quantiles,
    grouped_shape,
    numbered,
    running_totals,
)


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows share one value, and one group holds most rows."""
    draw = random.Random(7)
    groups = ["hot"] * 700 + ["a"] * 200 + ["b"] * 100
    values = [5.0 if draw.random() < 0.34 else round(draw.gauss(0, 10), 2) for _ in groups]
    return pd.DataFrame({"id": range(len(groups)), "g": groups, "v": values})


def test_running_totals_match_a_sorted_cumulative_sum(spark, skewed):
    rows = spark.createDataFrame(skewed[["id", "g"]]).withColumn("w", F.col("id") % 7)
    got = running_totals(rows, order=["id"], sums=["w"], by=["g"]).toPandas().sort_values(["g", "id"])
    expected = got.groupby("g")["w"]
    assert (got["w_before"].to_numpy() == (expected.cumsum() - got["w"]).to_numpy()).all()
    assert (got["w_total"].to_numpy() == expected.transform("sum").to_numpy()).all()


def test_running_totals_descending(spark):
    rows = spark.range(100).withColumn("one", F.lit(1))
    got = {r.id: r.one_before for r in running_totals(rows, order=["id"], sums=["one"], descending=True).collect()}
    assert got[99] == 0 and got[0] == 99


def test_numbered_gives_every_group_dense_positions(spark, skewed):
    got = numbered(spark.createDataFrame(skewed[["id", "g"]]), order=["id"], by=["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["position"]) == list(range(1, len(part) + 1))
        assert (part["position_count"] == len(part)).all()


def test_average_ranks_match_pandas(spark, skewed):
    counts = spark.createDataFrame(skewed).groupBy("g", F.col("v").alias("value")).agg(F.count("*").alias("n"))
    got = average_ranks(counts, by=["g"]).toPandas().set_index(["g", "value"])["average_rank"]
    expected = skewed.assign(r=skewed.groupby("g")["v"].rank())
    for g, v, r in expected[["g", "v", "r"]].itertuples(index=False):
        assert got[(g, v)] == r


def check_shape(got, part, chances):
    assert got["count"] == len(part)
    assert got["std"] == pytest.approx(part.std(), nan_ok=True)
    assert got["skewness"] == pytest.approx(part.skew(), nan_ok=True)
    for name, p in chances.items():
        assert got[name] == pytest.approx(float(np.quantile(part, p)), abs=1e-12)


@pytest.mark.parametrize("size", [60, 40_000])
def test_grouped_shape_matches_pandas(spark, size):
    """One group holds most rows; in another one value does, in a third all are equal, and one has a single row."""
    draw = np.random.default_rng(size)
    groups = np.where(draw.random(size) < 0.6, "hot", draw.choice(["tied", "flat", "plain"], size))
    values = np.select([groups == "tied", groups == "flat"], [np.where(draw.random(size) < 0.5, 5.0, draw.random(size) * 9), 1.0], draw.lognormal(size=size))
    frame = pd.DataFrame({"g": groups, "h": 1, "v": values})
    rows = [*frame.itertuples(index=False, name=None), ("single", 1, 3.0), ("single", 1, None), ("none", 1, None)]
    chances = {"q0": 0.0, "median": 0.5, "p25": 0.25, "p99": 0.99, "q1": 1.0}
    made = spark.createDataFrame([(g, h, None if v is None else float(v)) for g, h, v in rows], "g string, h int, v double").repartition(6)
    got = {r.g: r for r in grouped_shape(made, "v", ["g", "h"], chances).collect()}
    assert set(got) == set(groups) | {"single"} and got["single"]["skewness"] is None and got["single"]["median"] == 3.0
    for g, part in frame.groupby("g"):
        if g == "flat":
            assert got[g]["skewness"] is None and got[g]["std"] == 0 and got[g]["p99"] == 1.0
        else:
            check_shape(got[g], part["v"], chances)
    check_shape(grouped_shape(made.where("v is not null and g <> 'single'"), "v", [], chances).first(), frame["v"], chances)


def test_values_outside_the_brackets_become_no_rows(spark, monkeypatch):
    """What the second scan explodes: a fiftieth of the values at most."""
    made = []
    real = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda frame: made.append(real(frame)) or made[-1])
    frame = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    column_quantiles(frame, ["v"], {"p25": 0.25, "p50": 0.5, "p75": 0.75}).collect()
    counted = next(x for x in made if set(x.columns) == {"c", "k", "value", "n"})
    assert 0 < counted.agg(F.sum("n")).first()[0] < 200_000 * 3 / 50
    made.clear()
    grouped_shape(frame, "v", ["g"], {"p25": 0.25, "p50": 0.5, "p75": 0.75}).collect()
    placed = next(x for x in made if "_slice" in x.columns)
    assert 0 < placed.agg(F.sum("n")).first()[0] < 200_000 * 3 / 50


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_bracket_ends", lambda chances: [0.9, 0.91] * len(chances))
    frame = spark.range(50_000).select(F.col("id").cast("double").alias("v"))
    assert column_quantiles(frame, ["v"], {"p25": 0.25, "p90": 0.905}).first().p25 == 0.25 * 49_999


def test_counts_beside_a_scan_are_taken_again_if_they_are_off(spark):
    values = spark.range(10_000).select(F.col("id").cast("double").alias("v0"))
    for expected in (10_000, 9_999):
        counted, below = ranking._near(values, {(0, 0): (100.0, 120.0)}, 0, expected)
        assert below == {(0, 0): 100} and counted.agg(F.sum("n")).first()[0] == 21


def test_empty_input_gives_no_rows(spark):
    empty = spark.createDataFrame([], "id long, one long")
    assert running_totals(empty, order=["id"], sums=["one"]).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 3999, 30_000])
def test_column_quantiles_are_exact(spark, size):
    draw = np.random.default_rng(size)
    frame = pd.DataFrame({"a": draw.normal(size=size).round(2), "b": np.where(draw.random(size) < 0.4, 5.0, draw.random(size)), "none": [None] * size})
    chances = {"q0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "q1": 1.0}
    got = {r["column"]: r for r in column_quantiles(spark.createDataFrame(frame, "a double, b double, none double").repartition(5), ["a", "b", "none"], chances).collect()}
    assert set(got) >= {"a", "b"} and got.get("none", {"count": 0})["count"] == 0
    for name in ("a", "b"):
        for q, p in chances.items():
            assert got[name][q] == pytest.approx(float(np.quantile(frame[name], p)), abs=1e-12)
        assert got[name]["count"] == size and got[name]["max"] == frame[name].max()
