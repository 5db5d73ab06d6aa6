import random
import re
from itertools import combinations
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import profiling

COLUMNS = ["whole", "few", "hot", "gap", "twin", "other", "none"]


@pytest.fixture(scope="module")
def rows():
    """Ties, a two-valued column, a value of a third of the rows, two columns null in the same rows, and an empty one."""
    draw = random.Random(8)
    made = []
    for i in range(400):
        whole = draw.gauss(0, 1)
        hot = 0.0 if draw.random() < 0.35 else round(whole + draw.gauss(0, 1), 1)
        gap = round(whole * 3) + draw.randrange(3) if i % 5 else None
        twin = draw.random() if i % 5 else None
        other = float(draw.randrange(4)) if draw.random() < 0.8 else None
        made.append((whole, float(whole > 0.5), hot, None if gap is None else float(gap), twin, other, None))
    return made


def brute_ranks(values):
    return [sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for v in values]


def brute_spearman(rows, a, b):
    complete = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
    if not complete:
        return None
    x, y = (brute_ranks(side) for side in zip(*complete))
    mx, my = fmean(x), fmean(y)
    xx, yy = sum((v - mx) ** 2 for v in x), sum((v - my) ** 2 for v in y)
    return sum((v - mx) * (w - my) for v, w in zip(x, y)) / (xx * yy) ** 0.5 if xx and yy else None


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS)).repartition(3)


def test_spearman_matches_ranks_of_complete_rows(spark, rows):
    got = {(r.first, r.second): r.correlation for r in profiling.spearman_pairs(frame(spark, rows)).collect()}
    assert set(got) == set(combinations(COLUMNS, 2))
    for a, b in got:
        expected = brute_spearman(rows, COLUMNS.index(a), COLUMNS.index(b))
        assert got[a, b] == (None if expected is None else pytest.approx(expected, abs=1e-12)), (a, b)


def test_columns_are_ranked_once_for_partners_that_leave_the_same_rows(spark, rows):
    values = frame(spark, rows).drop("none")
    needed = profiling.shared_rankings(values, values.columns)
    full = ["whole", "few", "hot"]
    assert {needed[a, b] for a in full for b in full if a != b} == {(a, a) for a in full}
    assert needed["whole", "gap"] == needed["whole", "twin"] == ("whole", "gap")
    assert needed["gap", "twin"] == needed["gap", "whole"] == ("gap", "gap")
    assert needed["gap", "other"] == ("gap", "other")
    # Three whole columns rank alone and beside both kinds of gaps; the others alone and beside each other's.
    assert len(set(needed.values())) == 3 * 3 + 2 * 2 + 2


def test_spearman_of_little(spark, rows):
    values = frame(spark, rows)
    assert profiling.spearman_pairs(values, ["whole"]).count() == 0
    assert profiling.spearman_pairs(values, ["whole"]).columns == ["first", "second", "correlation"]
    empty = profiling.spearman_pairs(values.limit(0), ["whole", "few", "none"]).collect()
    assert [r.correlation for r in empty] == [None] * 3
    repeated = values.union(values).withColumn("flat", F.lit(1.0))
    got = {(r.first, r.second): r.correlation for r in profiling.spearman_pairs(repeated, ["whole", "hot", "flat"]).collect()}
    assert got["whole", "hot"] == pytest.approx(brute_spearman(rows + rows, 0, 2), abs=1e-12)
    assert got["whole", "flat"] is None and got["hot", "flat"] is None


@pytest.mark.parametrize("columns", [["few", "whole"], ["whole", "few"]])
def test_the_column_of_more_values_takes_its_ranks_first(spark, rows, columns):
    """So what is joined to the ranks of a column of two values is a sum for each of them, not pairs of values."""
    plan = profiling.spearman_pairs(frame(spark, rows), columns)._jdf.queryExecution().analyzed().toString()
    assert set(re.findall(r"x, (\w+)#\w+, jy, \d+, y, (\w+)#", plan)) == {("whole", "few")}
    # From the top: products by pair, below them sums by value of the other side, below those pairs of values.
    assert plan.index("sum((rx#") < plan.index("sum((cast(n#") < plan.index("jx, ")


def test_a_profiled_table_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return (i, f"t{i % 3}", float(i % 7), None)

    source = spark.createDataFrame(spark.sparkContext.parallelize(range(60), 3).map(row), "k long, s string, x double, gap string")
    got = {(r.section, r.column, r.measure, r.text): r.number for r in profiling.profile({"t": source}).collect()}
    assert made.value == 60
    assert got["dataset", None, "rows", None] == 60 and got["dataset", None, "duplicate_rows", None] == 0
    assert got["categorical", "s", "n", "t0"] == 20 and got["categorical", "s", "unique_count", "t0"] == 3
    assert got["categorical", "gap", "unique_count", None] == 0 and got["missing", "gap", "missing_count", None] == 60
    assert got["numeric", "x", "max", None] == 6 and got["iqr_outliers", "k", "outlier_count", None] == 0


def test_a_profile_takes_cells_that_parquet_has_no_type_for(spark):
    source = spark.range(4).withColumn("nothing", F.lit(None))
    got = {(r.section, r.column, r.measure): r.number for r in profiling.profile({"t": source}).collect()}
    assert got["dataset", None, "duplicate_rows"] == 0 and got["missing", "nothing", "missing_count"] == 4


def test_category_counts_are_shuffled_once(spark):
    top = profiling.categorical_summary(spark.range(50).selectExpr("string(id % 5) AS a", "string(id % 7) AS b"))
    top.collect()
    assert "ReusedExchange" in top._jdf.queryExecution().executedPlan().toString()
