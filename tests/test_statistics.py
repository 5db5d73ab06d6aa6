import math

import numpy as np
import pytest

from tallygrain.functions import tails
from tallygrain.operators import statistics as st
from tests.frames import valid_tables


def column(spark, values, name="v"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def groups(spark, first, second):
    rows = [(float(v), "a") for v in first] + [(float(v), "b") for v in second]
    return spark.createDataFrame(rows, "v double, g string")


def test_tails_known_values():
    assert tails.t_two_sided(2.228138851964939, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, rel=1e-9)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert tails.chi_square_upper(61.67, 2) == pytest.approx(math.exp(-61.67 / 2), rel=1e-10)
    assert tails.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    # One degree of freedom is the Cauchy law, two have a closed form.
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert tails.t_two_sided(3.0, 2) == pytest.approx(1 - 3 / math.sqrt(11), rel=1e-12)


def test_tiny_tails_do_not_round_to_zero():
    assert 0 < tails.t_two_sided(16.42, 600) < 1e-48
    assert 0 < tails.normal_two_sided(21.5) < 1e-100
    assert 0 < tails.chi_square_upper(400, 2) < 1e-80


def test_descriptives(spark):
    row = st.descriptive_statistics(column(spark, [1, 2, 3, 4, 5]), "v").first()
    assert (row.n, row["mean"], row.median, row.p25, row.p75) == (5, 3.0, 3.0, 2.0, 4.0)
    assert row["std"] == pytest.approx(math.sqrt(2.5))
    squares = [i * i for i in range(1, 11)]
    skew = st.descriptive_statistics(column(spark, squares), "v").first().skewness
    assert skew == pytest.approx(0.67437, abs=1e-5)
    assert st.descriptive_statistics(column(spark, [1]), "v").count() == 0


def test_mean_interval(spark):
    row = st.mean_interval(column(spark, [1, 2, 3, 4, 5]), "v").first()
    margin = 2.7764451051977987 * math.sqrt(2.5 / 5)
    assert row.lower == pytest.approx(3 - margin) and row.upper == pytest.approx(3 + margin)


def test_wilson(spark):
    counts = spark.createDataFrame([(50, 100), (0, 10), (10, 10), (0, 0)], "s long, n long")
    rows = {(r.s, r.n): r for r in st.proportion_interval(counts, "s", "n").collect()}
    assert rows[(50, 100)].lower == pytest.approx(0.4038, abs=1e-3)
    assert rows[(50, 100)].upper == pytest.approx(0.5962, abs=1e-3)
    assert rows[(0, 10)].lower == pytest.approx(0.0) and rows[(10, 10)].upper == pytest.approx(1.0)
    assert rows[(0, 0)].proportion is None


def test_welch(spark):
    row = st.welch_t_test(groups(spark, range(10, 16), range(1, 7)), "v", "g", "a", "b").first()
    assert row.p_value < 0.05 and row.effect_size > 0 and row.result == st.REJECT
    assert row.statistic == pytest.approx(9 / math.sqrt(3.5 / 6 * 2))
    assert row.effect_size == pytest.approx(9 / math.sqrt(3.5) * (1 - 3 / 39))
    assert row.sample_size == {"a": 6, "b": 6}
    assert st.welch_t_test(groups(spark, [1, 2], [3]), "v", "g", "a", "b").count() == 0


def test_mann_whitney(spark):
    row = st.mann_whitney_test(groups(spark, range(8, 12), range(1, 5)), "v", "g", "a", "b").first()
    assert row.statistic == 16.0 and row.effect_size == 1.0
    # Normal form with continuity correction: z = (16 - 8 - 0.5) / sqrt(12).
    assert row.p_value == pytest.approx(math.erfc(7.5 / math.sqrt(12) / math.sqrt(2)))
    tied = st.mann_whitney_test(groups(spark, [1, 2, 2, 3], [2, 2, 4, 5]), "v", "g", "a", "b").first()
    wins = sum((x > y) + 0.5 * (x == y) for x in [1, 2, 2, 3] for y in [2, 2, 4, 5])
    assert tied.statistic == wins


def test_chi_square(spark):
    table = spark.createDataFrame([("x", 90, 10), ("y", 20, 80)], "r string, a long, b long")
    row = st.chi_square_test(table, "r", ["a", "b"]).first()
    expected = np.outer([100, 100], [110, 90]) / 200
    chi = float((((np.array([[90, 10], [20, 80]]) - expected) ** 2) / expected).sum())
    assert row.statistic == pytest.approx(chi)
    assert row.p_value < 0.001 and 0 < row.effect_size <= 1
    assert row.effect_size == pytest.approx(math.sqrt(chi / 200))
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(chi / 2)), rel=1e-9)
    with pytest.raises(ValueError):
        st.chi_square_test(table, "r", ["a"])


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_perfect_correlation(spark, method):
    pairs = spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 6)], "x double, y double")
    row = st.correlation_test(pairs, "x", "y", method=method).first()
    assert row.statistic == pytest.approx(1.0) and row.p_value < 1e-6


def test_correlation_needs_pairs_and_variation(spark):
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (None, 4.0)], "x double, y double")
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    for frame in (two, flat):
        for method in ("pearson", "spearman"):
            assert st.correlation_test(frame, "x", "y", method=method).count() == 0
    with pytest.raises(ValueError):
        st.correlation_test(two, "x", "y", method="kendall")


def test_support_is_censored_at_the_first_cancellation(spark):
    rows = {r.customer_id: r for r in st.support_before_outcome(valid_tables(spark)).collect()}
    assert rows["C2"].churned == 1 and rows["C2"].ticket_count == 1  # T4 came after the cancellation
    assert rows["C2"].average_satisfaction is None
    assert rows["C4"].ticket_count == 0 and rows["C4"].average_resolution_hours is None
    assert str(rows["C1"].outcome_date) == "2024-04-06"


def test_tails_keep_their_digits_for_many_degrees_of_freedom(monkeypatch):
    import math

    from tallygrain.functions import tails

    normal = math.erfc(2.0 / math.sqrt(2.0))
    for df in (1e6, 1e9, 1e12, float("inf")):
        # The t law nears the normal one like 1 / df.
        assert abs(tails.t_two_sided(2.0, df) / normal - 1) < 6 / df + 1e-11
    assert tails.t_two_sided(1.0, 1.0) == pytest.approx(0.5, abs=1e-15)
    assert tails.t_two_sided(2.0, 2.0) == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-14)
    assert tails.chi_square_upper(7.0, 2.0) == pytest.approx(math.exp(-3.5), rel=1e-14)
    monkeypatch.setattr(tails, "MOST_TERMS", 2)
    with pytest.raises(ArithmeticError):
        tails.t_two_sided(1.5, 40.0)
    with pytest.raises(ArithmeticError):
        tails.chi_square_upper(300.0, 290.0)
