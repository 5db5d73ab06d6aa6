"""Order statistics that no single task has to hold.

A window over one global ordering puts every row in one task, and ``percentile`` keeps a whole
column in one aggregation buffer. Here rows are first reduced to one per distinct value, spread by
range partitioning, and summed in two steps: inside a partition and over the partition totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallygrain.functions.exprs import any_true, side_by_side
from tallygrain.session import materialize


@dataclass(frozen=True)
class Placed:
    """Rows spread in order over slices, and what each slice adds up to.

    ``slices`` has one row per group and slice: the sum before it ``_<s>_offset``, its own sum
    ``_<s>_slice`` and the group's ``<s>_total``.
    """

    rows: DataFrame
    slices: DataFrame
    by: tuple[str, ...]
    direction: tuple[Column, ...]
    sums: tuple[str, ...]


def place(
    rows: DataFrame,
    *,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> Placed:
    """Range-partition rows and sum every slice.

    ``rows`` must be unique on ``by + order`` and hold no null in ``by``. A hot group is spread
    over many range partitions. The partition number is stored as data before it is used, since a
    second evaluation of the range bounds could cut elsewhere.
    """
    direction = tuple(F.col(c).desc() if descending else F.col(c).asc() for c in order)
    keys = [F.col(c) for c in by]
    placed = materialize(
        rows.repartitionByRange(*keys, *direction).withColumn("_slice", F.spark_partition_id())
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    own = {s: F.col(f"_{s}_slice") for s in sums}
    slices = (
        placed.groupBy(*keys, "_slice")
        .agg(*[F.sum(s).alias(f"_{s}_slice") for s in sums])
        .select(
            *by,
            "_slice",
            *own.values(),
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{s}_offset") for s, c in own.items()],
            *[F.sum(c).over(whole).alias(f"{s}_total") for s, c in own.items()],
        )
    )
    return Placed(placed, slices, tuple(by), direction, tuple(sums))


def accumulate(placed: Placed, slices: DataFrame | None = None) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` to the rows of the given slices, of all by default."""
    keys = [*placed.by, "_slice"]
    earlier = Window.partitionBy(*keys).orderBy(*placed.direction).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.rows.join(placed.slices if slices is None else slices, keys)
        .withColumns(
            {
                f"{s}_before": F.col(f"_{s}_offset") + F.coalesce(F.sum(s).over(earlier), F.lit(0))
                for s in placed.sums
            }
        )
        .drop("_slice", *[f"_{s}_{part}" for s in placed.sums for part in ("offset", "slice")])
    )


def running_totals(
    rows: DataFrame,
    *,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<s>_before`` (sum over earlier rows) and ``<s>_total`` (sum over the group)."""
    return accumulate(place(rows, order=order, sums=sums, by=by, descending=descending))


def numbered(
    rows: DataFrame, *, order: Sequence[str], by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Number rows 1, 2, … per group, without one task per group. ``by + order`` must be unique."""
    counted = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), order=order, sums=["_one"], by=by)
    return (
        counted.withColumn(name, F.col("_one_before") + 1)
        .withColumnRenamed("_one_total", f"{name}_count")
        .drop("_one", "_one_before")
    )


def average_ranks(counts: DataFrame, *, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct ``value`` from its count ``n``, as ``average_rank``.

    ``extra`` names further count columns to keep alongside ``n``.
    """
    ranked = running_totals(counts, order=["value"], sums=["n"], by=by)
    return ranked.select(
        *by, "value", "n", *extra, "n_total", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("average_rank")
    )


# Ranks between which a quantile is looked for, as a share on either side; and the accuracy of the sketch that finds
# them, whose error is a tenth of that share.
BRACKET = 0.001
ACCURACY = 10_000
# Below so many values the sketch's ranks are too coarse, and the bracket is the whole column.
FEW_VALUES = 4 / BRACKET


def _bracket_ends(probabilities: Mapping[str, float]) -> list[float]:
    return [min(1.0, max(0.0, p + side * BRACKET)) for p in probabilities.values() for side in (-1, 1)]


def _value_at(rank: str) -> Column:
    """The value at a rank, from the rows whose ranks run from ``start`` on."""
    here = (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("start") + F.col("n"))
    return F.max(F.when(here, F.col("value")))


def _interpolated() -> Column:
    return _value_at("low") + (_value_at("high") - _value_at("low")) * F.max(F.col("at") - F.floor("at"))


def _near(
    values: DataFrame, brackets: Mapping[tuple[int, int], tuple[float, float]], place: int, expected: int
) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Distinct values inside each bracket with their count, and how many values lie below it, from one scan.

    Only what lies inside is put into rows of its own. What lies below is counted beside the scan, as metrics that are
    collected with its result. A task that runs again after a loss may be counted twice there; the values of column
    ``place`` are counted in the same way, and if there are not as many as expected, a plain aggregate counts instead.
    """
    column = {i: F.col(f"v{i}") for i, _ in brackets}
    within = {(i, k): (column[i] >= F.lit(low)) & (column[i] <= F.lit(high)) for (i, k), (low, high) in brackets.items()}
    inside = F.array(
        *[F.when(here, F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), column[i].alias("value"))) for (i, k), here in within.items()]
    )
    counts = [F.count_if(column[i] < F.lit(low)).alias(f"below_{i}_{k}") for (i, k), (low, _) in brackets.items()]
    seen = Observation()
    watched = values.observe(seen, F.count(column[place]).alias("values"), *counts)
    # Rows without a value inside go before anything is built of them.
    rows = watched.where(any_true(list(within.values()))).select(F.explode(F.array_compact(inside)).alias("x"))
    counted = materialize(rows.groupBy("x.c", "x.k", "x.value").agg(F.count("*").alias("n")))
    found = seen.get
    if found["values"] != expected:
        found = values.agg(*counts).first().asDict()
    return counted, {(i, k): found[f"below_{i}_{k}"] for i, k in brackets}


def column_quantiles(frame: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact linear quantiles of whole columns, one row per column.

    The first scan brackets every quantile between two sketched ranks. The second keeps the distinct values inside, a
    few thousandths of the rows, whose order gives the exact value, and counts what lies below. No value outside a
    bracket becomes a row or is shuffled. Should a wanted rank lie outside its bracket after all, the whole column
    becomes that bracket. Only numbers by column and quantile reach the driver.
    """
    columns, names = list(columns), list(probabilities)
    values = frame.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    ends = _bracket_ends(probabilities)
    measures = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        measures.append(
            F.struct(
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.percentile_approx(v, ends, ACCURACY).alias("ends"),
            ).alias(f"s{i}")
        )
    first = values.agg(*measures).first()
    shapes = [(c, i, *[first[f"s{i}"][m] for m in ("count", "mean", "std", "min", "max")]) for i, c in enumerate(columns)]
    shape = frame.sparkSession.createDataFrame(
        shapes, "`column` string, c int, count long, mean double, std double, min double, max double"
    )
    brackets, ranks = {}, {}
    for i in range(len(columns)):
        s = first[f"s{i}"]
        for k, p in enumerate(probabilities.values()):
            if s["count"]:
                brackets[i, k] = (s["min"], s["max"]) if s["count"] < FEW_VALUES else tuple(s["ends"][2 * k : 2 * k + 2])
                ranks[i, k] = (s["count"] - 1) * float(p)
    if not brackets:
        return shape.select("*", *[F.lit(None).cast("double").alias(n) for n in names]).drop("c").filter("count > 0")
    known = next(i for i, _ in brackets)
    counted, below = _near(values, brackets, known, first[f"s{known}"]["count"])
    held = {(r.c, r.k): r.n for r in counted.groupBy("c", "k").agg(F.sum("n").alias("n")).collect()}
    missed = {x for x, at in ranks.items() if floor(at) < below[x] or ceil(at) >= below[x] + held.get(x, 0)}
    if missed:
        wide = {x: tuple(first[f"s{x[0]}"][m] for m in ("min", "max")) if x in missed else ends for x, ends in brackets.items()}
        counted, below = _near(values, wide, known, first[f"s{known}"]["count"])
    places = frame.sparkSession.createDataFrame([(*x, below[x], at) for x, at in ranks.items()], "c int, k int, below long, at double")
    ranked = (
        running_totals(counted, order=["value"], sums=["n"], by=["c", "k"])
        .join(F.broadcast(places), ["c", "k"])
        .withColumns({"start": F.col("below") + F.col("n_before"), "low": F.floor("at"), "high": F.ceil("at")})
    )
    found = ranked.groupBy("c", "k").agg(_interpolated().alias("q"))
    wide = found.groupBy("c").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in enumerate(names)])
    return shape.join(F.broadcast(wide), "c").drop("c")


def grouped_shape(frame: DataFrame, value: str, by: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """Count, mean, extremes, sample deviation, bias-corrected skewness and exact linear quantiles of ``value`` by group.

    A group's sketch merges across tasks, so its brackets come from one aggregate by key. They are joined back to the
    rows, which Spark does without a shuffle while the groups are few. Values outside a bracket are only counted, per
    group and before the shuffle; the few inside are counted by value and put in order. Groups with a null key are left
    out. Without ``by`` there is one group.
    """
    by = list(by)
    values = frame.select(*by, F.col(value).cast("double").alias("value")).where("value IS NOT NULL")
    v, count = F.col("value"), F.col("count")
    skewness = F.when(count > 2, F.col("_skew") * F.sqrt(count * (count - 1)) / F.nullif(count - 2, F.lit(0)))
    if not by:
        whole = column_quantiles(values, ["value"], probabilities).drop("column")
        return side_by_side(whole, values.agg(F.skewness(v).alias("_skew"))).withColumn("skewness", skewness).drop("_skew")
    shape = materialize(
        values.groupBy(*by).agg(
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.skewness(v).alias("_skew"),
            F.percentile_approx(v, _bracket_ends(probabilities), ACCURACY).alias("_ends"),
        )
    )
    places = range(len(probabilities))
    few = count < FEW_VALUES
    lows = [F.when(few, F.col("min")).otherwise(F.col("_ends")[2 * k]) for k in places]
    highs = [F.when(few, F.col("max")).otherwise(F.col("_ends")[2 * k + 1]) for k in places]
    brackets = shape.select(*by, F.array(*lows).alias("_low"), F.array(*highs).alias("_high"))
    keyed = values.join(brackets, by)
    below = keyed.groupBy(*by).agg(F.array(*[F.count_if(v < F.col("_low")[k]) for k in places]).alias("_below"))
    within = [(v >= F.col("_low")[k]) & (v <= F.col("_high")[k]) for k in places]
    inside = F.array_compact(F.array(*[F.when(here, F.lit(k)) for k, here in enumerate(within)]))
    near = keyed.where(any_true(within)).select(*by, v, F.explode(inside).alias("_k"))
    counted = near.groupBy(*by, "_k", "value").agg(F.count("*").alias("n"))
    chances = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    ranked = (
        running_totals(counted, order=["value"], sums=["n"], by=[*by, "_k"])
        .join(shape.select(*by, "count").join(below, by), by)
        .withColumns({"at": (count - 1) * chances[F.col("_k")], "below": F.col("_below")[F.col("_k")]})
        .withColumns({"start": F.col("below") + F.col("n_before"), "low": F.floor("at"), "high": F.ceil("at")})
    )
    found = ranked.groupBy(*by, "_k").agg(_interpolated().alias("q"))
    checked = F.when(F.col("q").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(F.col("q"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == k, checked)).alias(n) for k, n in enumerate(probabilities)])
    return shape.join(wide, by).withColumn("skewness", skewness).drop("_skew", "_ends")
