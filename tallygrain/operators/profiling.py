"""Table profiles.

Exact quantiles come from two scans: sketched ranks bracket them, and only values inside a bracket are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain.functions.exprs import as_double, correlation, ratio
from tallygrain.functions.ranking import average_ranks, column_quantiles
from tallygrain.session import materialize, stored


def numeric_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]


def category_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def dataset_summary(frame: DataFrame) -> DataFrame:
    """Rows, columns and rows that repeat an earlier one in full."""
    distinct = frame.groupBy(*frame.columns).agg(F.count("*").alias("n"))
    return distinct.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(frame.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def column_types(frame: DataFrame) -> DataFrame:
    """Column names, places and types, read from the schema alone."""
    rows = [(place, name, kind) for place, (name, kind) in enumerate(frame.dtypes, start=1)]
    return frame.sparkSession.createDataFrame(rows, "place int, column string, dtype string")


def missing_values(frame: DataFrame) -> DataFrame:
    """Null cells per column, most first."""
    names = frame.columns
    counted = frame.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return (
        counted.unpivot(["_rows"], names, "column", "missing_count")
        .select(
            "column",
            "missing_count",
            (F.col("missing_count") * 100.0 / F.greatest(F.col("_rows"), F.lit(1))).alias("missing_percent"),
        )
        .orderBy(F.desc("missing_count"), "column")
    )


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def numerical_summary(
    frame: DataFrame, columns: Sequence[str] | None = None, *, shape: DataFrame | None = None
) -> DataFrame:
    """Count, mean, median, sample deviation, extremes and exact quartiles per numeric column.

    ``shape`` passes on a result of ``column_quantiles`` that is there already.
    """
    shape = shape or column_quantiles(frame, columns or numeric_columns(frame), QUARTILES)
    return shape.select(
        "column", "count", "mean", F.col("p50").alias("median"), "std", "min", "p25", "p50", "p75", "max"
    )


def categorical_summary(frame: DataFrame, columns: Sequence[str] | None = None, *, top_n: int = 10) -> DataFrame:
    """The most frequent values per text or boolean column, null as a value of its own.

    ``unique_count`` leaves null out. Ties go to the value that sorts first. The rank limit is
    applied in every partition before the shuffle, so a column of unique texts stays cheap.
    """
    if top_n < 1:
        raise ValueError("top_n must be positive")
    columns = list(columns or category_columns(frame))
    counts = (
        frame.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    # Both sides name n, so that they plan the same counts and Spark makes and shuffles these once.
    unique = counts.groupBy("column").agg(F.count_if((F.col("n") > 0) & F.col("value").isNotNull()).alias("unique_count"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_n)
    return top.join(unique, "column").select("column", "unique_count", "place", "value", "n")


def iqr_outliers(
    frame: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    multiplier: float = 1.5,
    shape: DataFrame | None = None,
) -> DataFrame:
    """P5: quartile fences per numeric column and how many values lie strictly beyond them."""
    if multiplier <= 0:
        raise ValueError("multiplier must be positive")
    columns = list(columns or numeric_columns(frame))
    shape = shape or column_quantiles(frame, columns, QUARTILES)
    iqr = F.col("p75") - F.col("p25")
    fences = materialize(
        shape.select(
            "column",
            "count",
            F.col("p25").alias("q1"),
            F.col("p75").alias("q3"),
            iqr.alias("iqr"),
            (F.col("p25") - F.lit(float(multiplier)) * iqr).alias("lower_bound"),
            (F.col("p75") + F.lit(float(multiplier)) * iqr).alias("upper_bound"),
        )
    )
    # One row per column: the bounds go into the scan that counts what lies beyond them.
    bounds = {r["column"]: r for r in fences.collect()}
    beyond = {
        c: F.count_if((as_double(c) < F.lit(bounds[c].lower_bound)) | (as_double(c) > F.lit(bounds[c].upper_bound)))
        for c in columns
        if c in bounds
    }
    if not beyond:
        return fences.select("*", F.lit(0).cast("long").alias("outlier_count"), F.lit(0.0).alias("outlier_percent")).drop("count")
    counted = frame.agg(*[count.alias(f"_{i}") for i, count in enumerate(beyond.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("outlier_count")) for i, c in enumerate(beyond)])
    return (
        fences.join(F.broadcast(counted.select(F.inline(rows))), "column")
        .withColumn("outlier_percent", ratio("outlier_count", "count") * 100)
        .drop("count")
    )


def pearson_pairs(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over its complete rows, in one pass."""
    columns = list(columns or numeric_columns(frame))
    pairs = list(combinations(columns, 2))
    values = frame.select(*[as_double(c).alias(c) for c in columns])
    row = values.agg(*[correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"_{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.inline(rows))


def shared_rankings(values: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], tuple[str, str]]:
    """The ranking each column needs beside each other column, as (column, a column that must not be null either).

    Ranks of a column depend on its partner only through the rows where the partner is null. A partner that is never
    null where the column is not asks for the column's own ranking, and partners that are null in the same rows
    share one, under the first of them. One scan counts, for each two columns, the rows that only one of them has.
    """
    ordered = [(a, b) for a in columns for b in columns if a != b]
    if not ordered:
        return {}
    only = [F.count_if(F.col(a).isNotNull() & F.col(b).isNull()) for a, b in ordered]
    lost = dict(zip(ordered, values.agg(*[n.alias(f"_{i}") for i, n in enumerate(only)]).first()))
    first = {b: next(c for c in columns if c == b or not (lost[b, c] or lost[c, b])) for b in columns}
    return {(a, b): (a, first[b] if lost[a, b] else a) for a, b in ordered}


def spearman_pairs(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spearman correlation of every column pair over the pair's complete rows; null where there are none.

    A column is ranked once for all partners that leave it the same rows, from counts of its distinct values, and so
    are the sums of its squared ranks. Only products belong to a pair: equal (x, y) rows are counted once, and the
    side with more distinct values takes its ranks first. What it adds to each value of the other side is summed
    before that side's ranks are joined, so a column of two values meets the join as two rows.
    """
    columns = list(columns or numeric_columns(frame))
    pairs = list(combinations(columns, 2))
    values = frame.select(*[as_double(c).alias(c) for c in columns])
    needed = shared_rankings(values, columns)
    number = {ranking: j for j, ranking in enumerate(dict.fromkeys(needed.values()))}
    schema = "first string, second string, pair int, spread double"
    if not pairs:
        return frame.sparkSession.createDataFrame([], schema).select("first", "second", F.col("spread").alias("correlation"))
    members = [
        F.when(F.col(other).isNotNull(), F.struct(F.lit(j).alias("ranking"), F.col(c).alias("value")))
        for (c, other), j in number.items()
    ]
    counts = (
        values.select(F.inline(F.array_compact(F.array(*members))))
        .filter("value IS NOT NULL")
        .groupBy("ranking", "value")
        .agg(F.count("*").alias("n"))
    )
    ranks = materialize(
        average_ranks(counts, by=["ranking"]).select(
            "ranking", "value", "n", (F.col("average_rank") - (F.col("n_total") + 1) / 2.0).alias("centred")
        )
    )
    # A row per ranking: how much its ranks spread, and of how many values.
    spread = F.sum(F.col("n") * F.col("centred") * F.col("centred"))
    shape = {r.ranking: r for r in ranks.groupBy("ranking").agg(spread.alias("spread"), F.count("*").alias("distinct")).collect()}

    def sides(a: str, b: str) -> list[tuple[str, int]]:
        both = [(a, number[needed[a, b]]), (b, number[needed[b, a]])]
        return sorted(both, key=lambda side: -shape[side[1]].distinct if side[1] in shape else 0)

    rows = []
    for i, (a, b) in enumerate(pairs):
        (x, jx), (y, jy) = sides(a, b)
        row = {"pair": F.lit(i), "jx": F.lit(jx), "x": F.col(x), "jy": F.lit(jy), "y": F.col(y)}
        rows.append(F.struct(*[value.alias(name) for name, value in row.items()]))
    joint = (
        values.select(F.inline(F.array(*rows)))
        .filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("pair", "jx", "x", "jy", "y")
        .agg(F.count("*").alias("n"))
    )

    def ranked(j: str, value: str) -> DataFrame:
        return ranks.select(F.col("ranking").alias(j), F.col("value").alias(value), F.col("centred").alias(f"r{value}"))

    added = joint.join(ranked("jx", "x"), ["jx", "x"]).groupBy("pair", "jy", "y").agg(F.sum(F.col("n") * F.col("rx")).alias("rx"))
    products = added.join(ranked("jy", "y"), ["jy", "y"]).groupBy("pair").agg(F.sum(F.col("rx") * F.col("ry")).alias("xy"))
    spreads = [
        (a, b, i, sqrt(jx.spread) * sqrt(jy.spread) if jx and jy else None)
        for i, (a, b) in enumerate(pairs)
        for jx, jy in [[shape.get(j) for _, j in sides(a, b)]]
    ]
    named = frame.sparkSession.createDataFrame(spreads, schema)
    return named.join(products, "pair", "left").select("first", "second", ratio("xy", "spread").alias("correlation"))


def correlations(frame: DataFrame, columns: Sequence[str] | None = None, *, method: str = "spearman") -> DataFrame:
    """One row per column pair ``(first, second, correlation)``; null where a column does not vary."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    return (pearson_pairs if method == "pearson" else spearman_pairs)(frame, columns)


def profile(frames: Mapping[str, DataFrame], *, top_n: int = 10) -> DataFrame:
    """P1–P5 of every table as (table, section, column, measure, number, text) rows.

    Each part scans its table once or more, so the joins and casts behind a table are run once and their rows stored.
    """

    def long(table: str, section: str, rows: DataFrame, numbers: Sequence[str], text: str | None = None) -> DataFrame:
        name = F.col("column") if "column" in rows.columns else F.lit(None).cast("string")
        label = F.col(text) if text else F.lit(None).cast("string")
        keyed = rows.select(name.alias("_column"), label.alias("_text"), *[as_double(c).alias(c) for c in numbers])
        return keyed.unpivot(["_column", "_text"], list(numbers), "measure", "number").select(
            F.lit(table).alias("table"),
            F.lit(section).alias("section"),
            F.col("_column").alias("column"),
            "measure",
            "number",
            F.col("_text").alias("text"),
        )

    parts = []
    for table, source in frames.items():
        frame = stored(source)
        parts.append(long(table, "dataset", dataset_summary(frame), ["rows", "columns", "duplicate_rows"]))
        parts.append(long(table, "missing", missing_values(frame), ["missing_count", "missing_percent"]))
        if numeric_columns(frame):
            shape = materialize(column_quantiles(frame, numeric_columns(frame), QUARTILES))
            summary = numerical_summary(frame, shape=shape)
            parts.append(long(table, "numeric", summary, [c for c in summary.columns if c != "column"]))
            fences = iqr_outliers(frame, shape=shape)
            parts.append(long(table, "iqr_outliers", fences, [c for c in fences.columns if c != "column"]))
        if category_columns(frame):
            top = categorical_summary(frame, top_n=top_n)
            parts.append(long(table, "categorical", top, ["unique_count", "place", "n"], "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)
