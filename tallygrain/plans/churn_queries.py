"""Registered churn-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.operators import churn_metrics as cm
from tallygrain.operators import churn_models as models
from tallygrain.operators.churn_models import KEY, LABEL, SCORE, TrainingConfig
from tallygrain.operators.features import CATEGORICAL_FEATURES
from tallygrain.plans.base import Registry, rounded
from tallygrain.plans.feature_queries import SNAPSHOT_ROLES, SNAPSHOT_SQL, snapshot
from tallygrain.session import materialize
from tallygrain.sources import roles

CHURN = Registry()

# A fixed arithmetic score with ties over the labelled documents stands in for a model's probability.
SCORED_SQL = """SELECT l.doc_id, d.lang, d.source, l.quality,
  CAST((d.n_chars * 37 + l.quality * 190 + l.toxic * 55) % 997 // 2 AS DOUBLE) / 500 AS score
  FROM labels l JOIN documents d USING (doc_id)"""


def _scored(spark, folder):
    labels, documents = roles.table(spark, folder, "labels"), roles.table(spark, folder, "documents")
    mixed = F.col("n_chars") * 37 + F.col("quality") * 190 + F.col("toxic") * 55
    return labels.join(documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        "doc_id", "lang", "source", "quality", (F.floor(mixed % 997 / 2).cast("double") / 500).alias("score")
    )


METRIC_ROW = """CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
  coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1, tn, fp, fn, tp"""


def threshold_sql(threshold: float, keys: str = "") -> str:
    return f"""SELECT {keys} {threshold}::DOUBLE AS threshold, {METRIC_ROW} FROM (
      SELECT {keys} count(*) FILTER (WHERE score >= {threshold} AND quality = 1) AS tp,
        count(*) FILTER (WHERE score >= {threshold} AND quality = 0) AS fp,
        count(*) FILTER (WHERE score < {threshold} AND quality = 1) AS fn,
        count(*) FILTER (WHERE score < {threshold} AND quality = 0) AS tn
      FROM ({SCORED_SQL}) {'GROUP BY ' + keys.rstrip(', ') if keys else ''})"""


@CHURN.add("threshold_metrics", threshold_sql(0.5))
def threshold_metrics(spark, folder):
    return cm.threshold_metrics(_scored(spark, folder), "score", "quality")


@CHURN.add("threshold_metrics_by_lang", threshold_sql(0.35, "lang, "))
def threshold_metrics_by_lang(spark, folder):
    return cm.threshold_metrics(_scored(spark, folder), "score", "quality", threshold=0.35, by=["lang"])


def quality_sql(key: str = "") -> str:
    part = f"PARTITION BY {key}" if key else ""
    select, group = (f"{key},", f"GROUP BY {key}") if key else ("", "")
    return f"""WITH scored AS ({SCORED_SQL}),
    steps AS (SELECT {select} score, count(*) AS n, sum(quality) AS pos FROM scored GROUP BY {select} score),
    ranked AS (SELECT *, sum(n) OVER ({part}) AS all_n, sum(pos) OVER ({part}) AS all_pos,
      sum(n) OVER above AS cum_n, sum(pos) OVER above AS cum_pos FROM steps
      WINDOW above AS ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT {select} round(sum(pos * ((all_n - all_pos) - (cum_n - cum_pos) + (n - pos) / 2.0::DOUBLE))
        / nullif(max(all_pos * (all_n - all_pos)), 0), 9) AS roc_auc,
      round(sum(pos * CAST(cum_pos AS DOUBLE) / cum_n) / nullif(max(all_pos), 0), 9) AS average_precision
    FROM ranked {group}"""


@CHURN.add("ranking_quality", quality_sql())
def ranking_quality(spark, folder):
    return rounded(cm.ranking_quality(_scored(spark, folder), "score", "quality"), 9, "roc_auc", "average_precision")


@CHURN.add("ranking_quality_by_lang", quality_sql("lang"))
def ranking_quality_by_lang(spark, folder):
    rows = cm.ranking_quality(_scored(spark, folder), "score", "quality", by=["lang"])
    return rounded(rows, 9, "roc_auc", "average_precision")


@CHURN.add(
    "classification_metrics",
    f"SELECT a.*, b.* FROM ({threshold_sql(0.5)}) a, ({quality_sql()}) b",
)
def classification_metrics(spark, folder):
    rows = cm.classification_metrics(_scored(spark, folder), "score", "quality")
    return rounded(rows, 9, "roc_auc", "average_precision")


THRESHOLD_SQL = f"""WITH scored AS ({SCORED_SQL}),
  candidates AS (SELECT DISTINCT lang, t FROM (SELECT lang, score AS t FROM scored
    UNION ALL SELECT DISTINCT lang, unnest([0.01, 0.99]::DOUBLE[]) FROM scored) WHERE t > 0 AND t < 1),
  measured AS (SELECT c.lang, c.t, count(*) FILTER (WHERE score >= t AND quality = 1) AS tp,
    count(*) FILTER (WHERE score >= t) AS flagged, count(*) FILTER (WHERE quality = 1) AS pos
    FROM candidates c JOIN scored s ON s.lang = c.lang GROUP BY c.lang, c.t),
  usable AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY
      coalesce(CAST(tp AS DOUBLE) / nullif(flagged, 0), 0) DESC,
      coalesce(CAST(2 * tp AS DOUBLE) / nullif(flagged + pos, 0), 0) DESC, t DESC) AS place
    FROM measured WHERE coalesce(CAST(tp AS DOUBLE) / nullif(pos, 0), 0) >= 0.7)
SELECT lang, coalesce(t, 0.5) AS threshold FROM (SELECT DISTINCT lang FROM scored)
LEFT JOIN (SELECT lang, t FROM usable WHERE place = 1) USING (lang)"""


@CHURN.add("threshold_for_recall", THRESHOLD_SQL)
def threshold_for_recall(spark, folder):
    return cm.threshold_for_recall(_scored(spark, folder), "score", "quality", by=["lang"])


ERRORS_SQL = f"""SELECT *, CASE WHEN quality = 1 AND score < 0.5 THEN 'false_negative'
  WHEN quality = 0 AND score >= 0.5 THEN 'false_positive' ELSE 'correct' END AS error_type FROM ({SCORED_SQL})"""


@CHURN.add(
    "errors_by_source",
    f"""SELECT source, count(*) FILTER (WHERE error_type = 'false_negative') AS false_negative,
      count(*) FILTER (WHERE error_type = 'false_positive') AS false_positive
    FROM ({ERRORS_SQL}) WHERE error_type <> 'correct' GROUP BY source""",
)
def errors_by_source(spark, folder):
    return cm.errors_by(cm.with_errors(_scored(spark, folder), "score", "quality", 0.5), "source")


@CHURN.add(
    "extreme_errors",
    f"""SELECT error_type, CAST(place AS INTEGER) AS place, doc_id, score, lang, source FROM (
      SELECT *, row_number() OVER (PARTITION BY error_type
        ORDER BY CASE WHEN error_type = 'false_positive' THEN -score ELSE score END, doc_id) AS place
      FROM ({ERRORS_SQL}) WHERE error_type <> 'correct') WHERE place <= 10""",
)
def extreme_errors(spark, folder):
    errors = cm.with_errors(_scored(spark, folder), "score", "quality", 0.5)
    return cm.extreme_errors(errors, "score", "doc_id", ["lang", "source"])


PREDICTED_SQL = f"""SELECT customer_id, region, primary_plan, churned_in_horizon,
  CAST((customer_id * 7919 + total_seats) % 1000 AS DOUBLE) / 1000 AS churn_probability FROM ({SNAPSHOT_SQL})"""


def _predicted(spark, folder):
    mixed = (F.col("customer_id") * 7919 + F.col("total_seats")) % 1000
    return snapshot(spark, folder).select(
        KEY, "region", "primary_plan", LABEL, (mixed.cast("double") / 1000).alias(SCORE)
    )


@CHURN.add(
    "ranked_predictions",
    f"""SELECT *, churn_probability >= 0.6 AS predicted_churn FROM ({PREDICTED_SQL})
    WHERE region IN ('ASIA', 'EUROPE') AND primary_plan IN ('Professional', 'Enterprise')""",
    SNAPSHOT_ROLES,
)
def ranked_predictions(spark, folder):
    return cm.ranked_predictions(
        _predicted(spark, folder), threshold=0.6, regions=("ASIA", "EUROPE"), plans=("Professional", "Enterprise")
    )


@CHURN.add(
    "risk_list",
    f"""SELECT customer_id, region, primary_plan AS plan, churn_probability FROM ({PREDICTED_SQL})
    WHERE region = 'ASIA' AND churn_probability >= 0.6 ORDER BY churn_probability DESC, customer_id LIMIT 25""",
    SNAPSHOT_ROLES,
)
def risk_list(spark, folder):
    return cm.risk_list(_predicted(spark, folder), threshold=0.6, regions=("ASIA",))


@CHURN.add(
    "risk_counts",
    f"""SELECT 'visible_customers' AS metric, CAST(count(*) AS DOUBLE) AS value, 'customers' AS unit FROM ({PREDICTED_SQL}) WHERE region = 'ASIA'
    UNION ALL SELECT 'flagged_customers', CAST(count(*) AS DOUBLE), 'customers' FROM ({PREDICTED_SQL})
      WHERE region = 'ASIA' AND churn_probability >= 0.6
    UNION ALL SELECT 'operating_threshold', 0.6::DOUBLE, 'probability'""",
    SNAPSHOT_ROLES,
)
def risk_counts(spark, folder):
    return cm.scope_counts(_predicted(spark, folder), threshold=0.6, regions=("ASIA",))


# The scored documents play the test rows of the model.
@CHURN.add(
    "risk_metrics",
    f"""SELECT 'visible_customers' AS metric, CAST(count(*) AS DOUBLE) AS value, 'customers' AS unit FROM ({PREDICTED_SQL}) WHERE region = 'ASIA'
    UNION ALL SELECT 'flagged_customers', CAST(count(*) AS DOUBLE), 'customers' FROM ({PREDICTED_SQL})
      WHERE region = 'ASIA' AND churn_probability >= 0.6
    UNION ALL SELECT 'operating_threshold', 0.6::DOUBLE, 'probability'
    UNION ALL SELECT 'held_out_average_precision', average_precision, 'score' FROM ({quality_sql()})
    UNION ALL SELECT 'held_out_recall', round(CAST(recall AS DOUBLE), 9), 'ratio' FROM ({threshold_sql(0.5)})
    UNION ALL SELECT 'held_out_precision', round(CAST("precision" AS DOUBLE), 9), 'ratio' FROM ({threshold_sql(0.5)})""",
    SNAPSHOT_ROLES,
)
def risk_metrics(spark, folder):
    held_out = cm.classification_metrics(_scored(spark, folder), "score", "quality")
    rows = cm.scope_counts(_predicted(spark, folder), threshold=0.6, regions=("ASIA",), held_out=held_out)
    return rounded(rows, 9, "value")


DRAWN_SQL = f"""SELECT customer_id, churned_in_horizon, row_number() OVER (PARTITION BY churned_in_horizon
    ORDER BY md5(customer_id || ':42'), customer_id) AS place, count(*) OVER (PARTITION BY churned_in_horizon) AS n
  FROM ({SNAPSHOT_SQL})"""


@CHURN.add(
    "stratified_split",
    f"SELECT customer_id, churned_in_horizon, place <= round(n * 0.2) AS is_test FROM ({DRAWN_SQL})",
    SNAPSHOT_ROLES,
)
def stratified_split(spark, folder):
    return cm.stratified_split(snapshot(spark, folder).select(KEY, LABEL), KEY, LABEL)


@CHURN.add(
    "cohort_summary",
    f"""WITH parts AS (SELECT churned_in_horizon AS y,
      CASE WHEN place <= round(n * 0.2) THEN 'test' ELSE 'training' END AS part FROM ({DRAWN_SQL}))
    SELECT part, count(*) AS customers, CAST(sum(y) AS BIGINT) AS churners, CAST(sum(y) AS DOUBLE) / count(*) AS churn_rate
      FROM parts GROUP BY part
    UNION ALL SELECT 'cohort', count(*), CAST(sum(y) AS BIGINT), CAST(sum(y) AS DOUBLE) / count(*) FROM parts""",
    SNAPSHOT_ROLES,
)
def cohort_summary(spark, folder):
    return cm.cohort_summary(cm.stratified_split(snapshot(spark, folder).select(KEY, LABEL), KEY, LABEL), LABEL)


@CHURN.add(
    "stratified_folds",
    f"SELECT customer_id, churned_in_horizon, CAST((place - 1) % 5 AS INTEGER) AS fold FROM ({DRAWN_SQL})",
    SNAPSHOT_ROLES,
)
def stratified_folds(spark, folder):
    return cm.stratified_folds(snapshot(spark, folder).select(KEY, LABEL), KEY, LABEL)


# Learners depend on their own random numbers: rows only. All run with the defaults of ``TrainingConfig``.
def _folded(spark, folder):
    rows = materialize(snapshot(spark, folder))
    return materialize(cm.stratified_folds(rows, KEY, LABEL, folds=TrainingConfig().folds))


def _logistic_scores(spark, folder):
    rows = materialize(snapshot(spark, folder))
    folded = materialize(cm.stratified_folds(rows, KEY, LABEL))
    return models.out_of_fold(folded, {"logistic": ("logistic_regression", {"C": 1.0})}, folds=TrainingConfig().folds)


@CHURN.add("cross_validation")
def cross_validation(spark, folder):
    config = TrainingConfig()
    trials = {name: (name, config.base.get(name)) for name in config.candidates}
    scored = models.out_of_fold(_folded(spark, folder), trials, folds=config.folds, seed=config.seed, parallelism=config.parallelism)
    return models.cross_validation(materialize(scored))


@CHURN.add("out_of_fold")
def out_of_fold(spark, folder):
    return _logistic_scores(spark, folder)


@CHURN.add(
    "out_of_fold_rows",
    f"""SELECT customer_id, churned_in_horizon, CAST((place - 1) % 5 AS INTEGER) AS fold, TRUE AS is_probability
    FROM ({DRAWN_SQL})""",
    SNAPSHOT_ROLES,
)
def out_of_fold_rows(spark, folder):
    """One score for each customer, in the customer's own fold."""
    scored = _logistic_scores(spark, folder)
    return scored.select(KEY, LABEL, "fold", F.col(models.SCORE).between(0, 1).alias("is_probability"))


@CHURN.add("tune_candidate")
def tune_candidate(spark, folder):
    rows = materialize(cm.stratified_folds(materialize(snapshot(spark, folder)), KEY, LABEL))
    return models.tune(rows, "logistic_regression", TrainingConfig())[1]


@CHURN.add("logistic_coefficients")
def logistic_coefficients(spark, folder):
    return models.coefficients(models.fit_candidate(materialize(snapshot(spark, folder)), "logistic_regression"), spark)


def coefficient_names_sql() -> str:
    fixed = ", ".join(f"'{name}'" for name in models.feature_names())
    members = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}=' || {c} AS feature FROM ({SNAPSHOT_SQL}) WHERE {c} IS NOT NULL" for c in CATEGORICAL_FEATURES
    )
    return f"SELECT unnest([{fixed}]) AS feature UNION ALL {members}"


@CHURN.add("coefficient_names", coefficient_names_sql(), SNAPSHOT_ROLES)
def coefficient_names(spark, folder):
    """The features of a fitted model, one for each member of a category that its training rows hold."""
    return logistic_coefficients(spark, folder).select("feature")


@CHURN.add("permutation_importance")
def permutation_importance(spark, folder):
    rows = materialize(snapshot(spark, folder))
    return models.permutation_importance(models.fit_candidate(rows, "logistic_regression"), rows)


@CHURN.add("train_churn_model")
def train_churn_model(spark, folder):
    """The held-out metrics of the whole workflow."""
    result = models.train(materialize(snapshot(spark, folder)), TrainingConfig())
    return result.held_out.withColumn("selected", F.lit(result.selected))
