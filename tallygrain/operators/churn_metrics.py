"""Splits, classification metrics and error analysis over any score column.

Everything that needs an ordering by score works on one row per distinct score with distributed
running totals, so neither a window nor a collected array holds all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.functions.exprs import ratio, side_by_side, tally
from tallygrain.functions.ranking import numbered, running_totals


# --- deterministic splits --------------------------------------------------------------------


def stratified_positions(frame: DataFrame, key: str, label: str, *, seed: int = 42) -> DataFrame:
    """M3: number the rows of each class in an order fixed by a hash of key and seed."""
    drawn = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return numbered(frame.withColumn("_draw", drawn), order=["_draw", key], by=[label], name="_position").drop("_draw")


def stratified_split(
    frame: DataFrame, key: str, label: str, *, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """M3: add ``is_test``, the same share of each class."""
    if not 0 < test_size < 0.5:
        raise ValueError("test_size must be between zero and 0.5")
    placed = stratified_positions(frame, key, label, seed=seed)
    share = F.round(F.col("_position_count") * F.lit(test_size))
    return placed.withColumn("is_test", F.col("_position") <= share).drop("_position", "_position_count")


def stratified_folds(frame: DataFrame, key: str, label: str, *, folds: int = 5, seed: int = 42) -> DataFrame:
    """M4: add ``fold`` from 0, spreading each class evenly."""
    if folds < 2:
        raise ValueError("folds must be at least two")
    placed = stratified_positions(frame, key, label, seed=seed)
    return placed.withColumn("fold", ((F.col("_position") - 1) % folds).cast("int")).drop(
        "_position", "_position_count"
    )


def cohort_summary(split: DataFrame, label: str) -> DataFrame:
    """Rows, positives and rate of the whole cohort and of its training and test part."""
    part = F.when(F.col("is_test"), "test").otherwise("training")
    counted = split.groupBy(part.alias("part")).agg(
        F.count("*").alias("customers"), F.sum(label).alias("churners")
    )
    whole = counted.agg(F.sum("customers").alias("customers"), F.sum("churners").alias("churners"))
    return (
        whole.select(F.lit("cohort").alias("part"), "customers", "churners")
        .unionByName(counted)
        .withColumn("churn_rate", ratio("churners", "customers"))
    )


# --- metrics ---------------------------------------------------------------------------------


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def check_threshold(threshold: float) -> None:
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between zero and one")


def threshold_metrics(
    scored: DataFrame, score: str, label: str, *, threshold: float | Column = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """M6: accuracy, precision, recall, F1 and the confusion counts at a threshold, score >= threshold."""
    if isinstance(threshold, (int, float)):
        check_threshold(threshold)
        threshold = F.lit(float(threshold))
    predicted, actual = F.col(score) >= threshold, F.col(label) == 1
    counted = scored.groupBy(*by).agg(
        F.max(threshold).alias("threshold"),
        tally(~predicted & ~actual).alias("tn"),
        tally(predicted & ~actual).alias("fp"),
        tally(~predicted & actual).alias("fn"),
        tally(predicted & actual).alias("tp"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        *by,
        "threshold",
        _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def _score_counts(scored: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), tally(F.col(label) == 1).alias("positives")
    )


def ranking_quality(scored: DataFrame, score: str, label: str, *, by: Sequence[str] = ()) -> DataFrame:
    """M7: exact ROC-AUC and average precision; equal scores share one step. One class alone gives null."""
    placed = running_totals(
        _score_counts(scored, score, label, by), order=["score"], sums=["n", "positives"], by=by, descending=True
    )
    n, positives = F.col("n").cast("double"), F.col("positives").cast("double")
    negatives_above = F.col("n_before") - F.col("positives_before")
    all_negatives = F.col("n_total") - F.col("positives_total")
    beaten = all_negatives - negatives_above - (n - positives) / 2
    precision = (F.col("positives_before") + positives) / (F.col("n_before") + n)
    return placed.groupBy(*by).agg(
        ratio(
            F.sum(positives * beaten), F.max(F.col("positives_total").cast("double") * all_negatives)
        ).alias("roc_auc"),
        ratio(F.sum(positives * precision), F.max("positives_total")).alias("average_precision"),
    )


def classification_metrics(
    scored: DataFrame, score: str, label: str, *, threshold: float | Column = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """M6 and M7 in one row per group."""
    at_threshold = threshold_metrics(scored, score, label, threshold=threshold, by=by)
    quality = ranking_quality(scored, score, label, by=by)
    return at_threshold.join(quality, list(by)) if by else side_by_side(at_threshold, quality)


def threshold_for_recall(
    scored: DataFrame, score: str, label: str, *, minimum_recall: float = 0.7, by: Sequence[str] = ()
) -> DataFrame:
    """M8: the threshold with the best (precision, F1, threshold) among those that reach the recall.

    Candidates are the distinct scores with 0.01 and 0.99, strictly between zero and one. Where none
    reaches the recall the threshold is 0.5.
    """
    if not 0 < minimum_recall <= 1:
        raise ValueError("minimum_recall must be in (0, 1]")
    counts = _score_counts(scored, score, label, by)
    groups = counts.select(*by).distinct() if by else scored.sparkSession.range(1)
    fixed = groups.select(
        *by, F.explode(F.array(F.lit(0.01), F.lit(0.99))).alias("score"), F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("positives"),
    )
    candidates = (
        counts.unionByName(fixed)
        .groupBy(*by, "score")
        .agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    )
    placed = running_totals(candidates, order=["score"], sums=["n", "positives"], by=by, descending=True)
    tp, flagged = F.col("positives_before") + F.col("positives"), F.col("n_before") + F.col("n")
    measured = placed.select(
        *by,
        F.col("score").alias("threshold"),
        _share(tp, flagged).alias("precision"),
        _share(tp, F.col("positives_total")).alias("recall"),
        _share(2 * tp, flagged + F.col("positives_total")).alias("f1"),
    )
    usable = (F.col("threshold") > 0) & (F.col("threshold") < 1) & (F.col("recall") >= minimum_recall)
    best = F.max(F.when(usable, F.struct("precision", "f1", "threshold")))
    return measured.groupBy(*by).agg(F.coalesce(best["threshold"], F.lit(0.5)).alias("threshold"))


# --- errors and ranked lists -----------------------------------------------------------------


def with_errors(scored: DataFrame, score: str, label: str, threshold: float | Column) -> DataFrame:
    """M9: add the error type of each row."""
    threshold = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    predicted, actual = F.col(score) >= threshold, F.col(label) == 1
    return scored.withColumn(
        "error_type",
        F.when(actual & ~predicted, "false_negative").when(~actual & predicted, "false_positive").otherwise("correct"),
    )


def errors_by(errors: DataFrame, dimension: str) -> DataFrame:
    """M9: wrong rows per member of a dimension."""
    return (
        errors.filter(F.col("error_type") != "correct")
        .groupBy(dimension)
        .pivot("error_type", ["false_negative", "false_positive"])
        .count()
        .na.fill(0)
    )


def extreme_errors(errors: DataFrame, score: str, key: str, columns: Sequence[str], *, top: int = 10) -> DataFrame:
    """M9: the highest-scored false positives and lowest-scored false negatives, ties by key."""
    distance = F.when(F.col("error_type") == "false_positive", -F.col(score)).otherwise(F.col(score))
    order = Window.partitionBy("error_type").orderBy(distance, key)
    return (
        errors.filter(F.col("error_type") != "correct")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)
        .select("error_type", "place", key, score, *columns)
    )


def ranked_predictions(
    predictions: DataFrame,
    *,
    threshold: float,
    regions: Sequence[str] = (),
    plans: Sequence[str] = (),
    key: str = "customer_id",
) -> DataFrame:
    """Predictions of the chosen segment with their flag, highest risk first, ties by key."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between zero and one")
    missing = {key, "region", "primary_plan", "churn_probability"} - set(predictions.columns)
    if missing:
        raise ValueError(f"Predictions lack columns: {sorted(missing)}")
    chosen = predictions
    if regions:
        chosen = chosen.filter(F.col("region").isin(*regions))
    if plans:
        chosen = chosen.filter(F.col("primary_plan").isin(*plans))
    return chosen.withColumn("predicted_churn", F.col("churn_probability") >= F.lit(float(threshold))).orderBy(
        F.desc("churn_probability"), key
    )


def risk_list(
    predictions: DataFrame,
    *,
    threshold: float,
    regions: Sequence[str] = (),
    plans: Sequence[str] = (),
    customer_ids: DataFrame | None = None,
    top: int = 25,
) -> DataFrame:
    """The highest-risk flagged customers in a scope."""
    ranked = ranked_predictions(predictions, threshold=threshold, regions=regions, plans=plans)
    if customer_ids is not None:
        ranked = ranked.join(customer_ids.select("customer_id"), "customer_id", "left_semi")
    return (
        ranked.filter("predicted_churn")
        .orderBy(F.desc("churn_probability"), "customer_id")
        .select("customer_id", "region", F.col("primary_plan").alias("plan"), "churn_probability")
        .limit(top)
    )


def scope_counts(
    predictions: DataFrame,
    *,
    threshold: float,
    regions: Sequence[str] = (),
    plans: Sequence[str] = (),
    held_out: DataFrame | None = None,
) -> DataFrame:
    """Visible and flagged customers of a scope as (metric, value, unit) rows.

    ``held_out`` is the one row of ``classification_metrics`` on the test rows; it adds the model's own quality, which
    does not depend on the scope.
    """
    ranked = ranked_predictions(predictions, threshold=threshold, regions=regions, plans=plans)
    row = ranked.agg(F.count("*").alias("visible"), tally(F.col("predicted_churn")).alias("flagged"))

    def listed(frame: DataFrame, metrics: Sequence[tuple[str, Column, str]]) -> DataFrame:
        parts = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(u).alias("unit")) for m, v, u in metrics]
        return frame.select(F.inline(F.array(*parts)))

    counts = listed(
        row,
        [
            ("visible_customers", F.col("visible"), "customers"),
            ("flagged_customers", F.col("flagged"), "customers"),
            ("operating_threshold", F.lit(float(threshold)), "probability"),
        ],
    )
    if held_out is None:
        return counts
    quality = [
        ("held_out_average_precision", F.col("average_precision"), "score"),
        ("held_out_recall", F.col("recall"), "ratio"),
        ("held_out_precision", F.col("precision"), "ratio"),
    ]
    return counts.unionByName(listed(held_out, quality))
