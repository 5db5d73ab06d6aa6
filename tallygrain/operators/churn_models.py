"""Churn models on Spark ML: preprocessing, candidates, validation, tuning, training.

What is fitted is fitted on the training rows of its fold only. What preprocessing learns is gathered for
all folds at once, in three scans of the rows, and shared by all fits. The driver holds what the features of a
fold need (a number or two per feature, a count per category), parameters, and the models of running fits only:
a model is let go as soon as its scores are stored. Customer rows stay distributed.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from math import ceil, sqrt
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallygrain.functions.ranking import numbered
from tallygrain.functions.trees import boosted_probabilities, forest_probabilities
from tallygrain.operators.churn_metrics import (
    classification_metrics,
    ranking_quality,
    stratified_folds,
    stratified_split,
    threshold_for_recall,
)
from tallygrain.operators.features import CATEGORICAL_FEATURES, LABEL, NUMERIC_FEATURES
from tallygrain.session import materialize, release

KEY = "customer_id"
SCORE = "churn_probability"
CV_METRICS = ("average_precision", "roc_auc", "recall", "precision", "f1")
CANDIDATES = ("dummy", "logistic_regression", "random_forest", "gradient_boosting")

# The parameter lists a tuned candidate is drawn from, in Spark ML terms.
SEARCH_SPACES: dict[str, dict[str, Sequence[Any]]] = {
    "logistic_regression": {"C": (0.03, 0.1, 0.3, 1.0, 3.0, 10.0)},
    "random_forest": {
        "numTrees": (200, 350, 500),
        "maxDepth": (20, 6, 10, 16),
        "minInstancesPerNode": (2, 5, 10, 20),
        "featureSubsetStrategy": ("sqrt", "0.5", "0.8"),
    },
    "gradient_boosting": {
        "stepSize": (0.03, 0.05, 0.08, 0.12),
        "maxIter": (120, 200, 300),
        "maxDepth": (3, 4, 5),
        "minInstancesPerNode": (10, 20, 40),
    },
}

# Candidates made of trees, with the parameters a task can fit them by and Spark ML's values where none are given.
TREES: dict[str, dict[str, Any]] = {
    "random_forest": {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "auto"},
    "gradient_boosting": {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 1},
}

# Candidates that see standardised features.
SCALED = ("logistic_regression",)

# Parameters of the untuned candidates.
BASE_PARAMETERS: dict[str, dict[str, Any]] = {
    "logistic_regression": {"C": 1.0},
    "random_forest": {"numTrees": 300, "minInstancesPerNode": 5, "maxDepth": 12, "featureSubsetStrategy": "sqrt"},
    "gradient_boosting": {"stepSize": 0.08, "maxIter": 200, "maxDepth": 4, "minInstancesPerNode": 20},
}


@dataclass(frozen=True)
class TrainingConfig:
    """Settings of the whole workflow, checked when made."""

    seed: int = 42
    test_size: float = 0.2
    folds: int = 5
    tuning_iterations: int = 12
    minimum_recall: float = 0.7
    importance_repeats: int = 8
    parallelism: int = 4
    candidates: Sequence[str] = CANDIDATES
    base: Mapping[str, Mapping[str, Any]] = field(default_factory=lambda: BASE_PARAMETERS)
    spaces: Mapping[str, Mapping[str, Sequence[Any]]] = field(default_factory=lambda: SEARCH_SPACES)

    def __post_init__(self) -> None:
        if not 0 < self.test_size < 0.5:
            raise ValueError("test_size must be between zero and 0.5")
        if self.folds < 2 or self.tuning_iterations < 1:
            raise ValueError("at least two folds and one tuning iteration are needed")
        if not 0 < self.minimum_recall <= 1:
            raise ValueError("minimum_recall must be in (0, 1]")
        if "dummy" not in self.candidates or len(self.candidates) < 2:
            raise ValueError("candidates need the dummy baseline and one model")


def _parallel(jobs: Sequence[Callable[[], Any]], parallelism: int) -> list[Any]:
    """Run independent Spark fits from a few driver threads; the cluster does the work."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


# --- preprocessing and fitting ---------------------------------------------------------------


# One part in so many is the largest error in rank of an imputed median.
MEDIAN_ACCURACY = 1000
# Rows of a fit are dealt to all cores, but not to tasks of fewer rows than this; a task has at most the second number.
FEW_ROWS = 2_000
MANY_ROWS = 100_000
# A logistic fit has a job for each of its steps, which few rows do not fill: a task has so many rows at least.
LINEAR_ROWS = 50_000
# Trees of up to so many rows are fitted by one task for each fit; some 300 bytes of a row are held there.
ROWS_OF_A_TASK = 1_000_000
# A column whose deviation is a smaller share of its mean does not vary; it is scaled to zero.
NO_VARIATION = 1e-9


@dataclass(frozen=True)
class Preparation:
    """M1: what preprocessing learns from one set of training rows.

    ``labels`` are the categories seen there in alphabetical order, and ``shifts`` and ``scales`` standardise the
    imputed numbers and then their missing flags, in the order of :func:`feature_names`.
    """

    rows: int
    positives: int
    modes: Mapping[str, str]
    labels: Mapping[str, Sequence[str]]
    medians: Mapping[str, float]
    shifts: Sequence[float]
    scales: Sequence[float]


def category_counts(frame: DataFrame, columns: Sequence[str], by: str) -> dict[str, dict[str, dict[int, int]]]:
    """Rows of each non-null value of each column, by fold.

    Values are counted before the shuffle, so no task holds the members of a column. A row per value and fold is
    collected: the indexer needs every category anyway.
    """
    long = frame.select(by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([by], list(columns), "column", "value")
    found: dict[str, dict[str, dict[int, int]]] = {c: {} for c in columns}
    for r in long.where("value IS NOT NULL").groupBy(by, "column", "value").agg(F.count("*").alias("n")).collect():
        found[r["column"]].setdefault(r.value, {})[r[by]] = r.n
    return found


def _modes(counts: Mapping[str, Mapping[str, int]]) -> dict[str, str]:
    """The most frequent value of each column, of equally frequent ones the first; none for a column of nulls."""
    return {c: min(values, key=lambda v: (-values[v], v)) for c, values in counts.items() if values}


def category_modes(frame: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent non-null value of each column, of equally frequent ones the first; none for a column of nulls."""
    counts = category_counts(frame.withColumn("fold", F.lit(0)), columns, "fold")
    return _modes({c: {v: n[0] for v, n in values.items()} for c, values in counts.items()})


def _moments(parts: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean and reciprocal sample deviation of the union of parts of (count, mean, variance within the part).

    The reciprocal is zero where nothing varies.
    """
    size = sum(n for n, _, _ in parts)
    mean = sum(n * m for n, m, _ in parts) / size
    spread = sum(n * (v + (m - mean) ** 2) for n, m, v in parts)
    deviation = sqrt(spread / (size - 1)) if size > 1 else 0.0
    return mean, 0.0 if deviation <= NO_VARIATION * abs(mean) else 1.0 / deviation


def prepare(frame: DataFrame) -> dict[int | None, Preparation]:
    """M1: what preprocessing learns without each ``fold``, and under None from all rows (all there is without folds).

    Three scans serve all folds. One sums numbers by fold; the moments without a fold are put together from the
    sums of the others, an imputed part being a part that does not vary. One has a sketch per feature and fold left
    out, which merges across tasks, for the medians. One counts categories by fold. NaN counts as missing; a feature
    without any value is imputed as zero, a category without any as ``missing``.
    """
    kept = [F.col(c).cast("string").alias(c) for c in CATEGORICAL_FEATURES]
    numbers = [F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in NUMERIC_FEATURES]
    fold = F.col("fold") if "fold" in frame.columns else F.lit(0).alias("fold")
    label = F.col(LABEL) if LABEL in frame.columns else F.lit(None).cast("int").alias(LABEL)
    typed = frame.select(fold, label, *kept, *numbers)
    measures = [F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance")).alias(c) for c in NUMERIC_FEATURES]
    sums = {
        r.fold: r
        for r in typed.groupBy("fold").agg(F.count("*").alias("rows"), F.sum(LABEL).alias("positives"), *measures).collect()
    }
    parts: dict[int | None, list[int]] = {None: sorted(sums)}
    if len(sums) > 1:
        parts |= {k: [f for f in sorted(sums) if f != k] for k in sums}
    seen = {k: F.lit(True) if k is None else F.col("fold") != k for k in parts}
    middle = typed.agg(
        *[
            F.struct(*[F.percentile_approx(F.when(here, F.col(c)), 0.5, MEDIAN_ACCURACY).alias(c) for c in NUMERIC_FEATURES]).alias(
                f"without_{k}"
            )
            for k, here in seen.items()
        ]
    ).first()
    counts = category_counts(typed, CATEGORICAL_FEATURES, "fold")

    def learnt(k: int | None) -> Preparation:
        rows = [sums[f] for f in parts[k]]
        size = sum(r.rows for r in rows)
        medians = {c: 0.0 if x is None else x for c, x in middle[f"without_{k}"].asDict().items()}
        filled, flags = [], []
        for c in NUMERIC_FEATURES:
            known = [(r[c].n, r[c].mean, r[c].variance) for r in rows if r[c].n]
            gaps = size - sum(n for n, _, _ in known)
            filled.append(_moments([*known, (gaps, medians[c], 0.0)]) if size else (0.0, 0.0))
            flags.append(_moments([(gaps, 1.0, 0.0), (size - gaps, 0.0, 0.0)]) if size else (0.0, 0.0))
        within = {
            c: {v: sum(by.get(f, 0) for f in parts[k]) for v, by in values.items() if any(f in by for f in parts[k])}
            for c, values in counts.items()
        }
        modes = {c: "missing" for c in CATEGORICAL_FEATURES} | _modes(within)
        return Preparation(
            rows=size,
            positives=sum(r.positives or 0 for r in rows),
            modes=modes,
            labels={c: sorted({*values, modes[c]}) for c, values in within.items()},
            medians=medians,
            shifts=[m for m, _ in filled + flags],
            scales=[x for _, x in filled + flags],
        )

    return {k: learnt(k) for k in parts}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preprocessing_stages(train: DataFrame, *, scale: bool, learnt: Preparation | None = None) -> list[Transformer]:
    """M1: medians with missing indicators, optional scaling, modes and one-hot blocks, as transformers.

    What they need is ``learnt`` already, so making them reads no rows. A category unseen in training gets an
    all-zero block: the indexer puts it last, and the encoder drops the last place.
    """
    learnt = learnt or prepare(train)[None]
    filled = [f"coalesce(CAST({c} AS STRING), {_quoted(learnt.modes[c])}) AS {c}_filled" for c in CATEGORICAL_FEATURES]
    known = {c: f"nullif(CAST({c} AS DOUBLE), DOUBLE('NaN'))" for c in NUMERIC_FEATURES}
    numbers = [f"coalesce({known[c]}, DOUBLE('{learnt.medians[c]!r}'))" for c in NUMERIC_FEATURES]
    flags = [f"CAST({known[c]} IS NULL AS DOUBLE)" for c in NUMERIC_FEATURES]
    values = [
        f"({x} - DOUBLE('{shift!r}')) * DOUBLE('{by!r}')" if scale else x
        for x, shift, by in zip(numbers + flags, learnt.shifts, learnt.scales)
    ]
    named = [f"{name}_number" for name in feature_names()]
    listed = ", ".join(filled + [f"{x} AS {name}" for x, name in zip(values, named)])
    filler = SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__")
    indexers = [
        StringIndexerModel.from_labels(
            list(learnt.labels[c]), inputCol=f"{c}_filled", outputCol=f"{c}_index", handleInvalid="keep"
        )
        for c in CATEGORICAL_FEATURES
    ]
    # Indexers name their categories in the schema, so that this fit reads no rows.
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in CATEGORICAL_FEATURES], outputCols=[f"{c}_block" for c in CATEGORICAL_FEATURES]
    ).fit(PipelineModel([filler, *indexers]).transform(train))
    blocks = [*named, *[f"{c}_block" for c in CATEGORICAL_FEATURES]]
    return [filler, *indexers, encoder, VectorAssembler(inputCols=blocks, outputCol="features")]


def feature_names() -> list[str]:
    """Names of the numeric block, in assembler order."""
    return [*NUMERIC_FEATURES, *[f"{c}_missing" for c in NUMERIC_FEATURES]]


def _learner(name: str, parameters: Mapping[str, Any], rows: int, seed: int) -> Any:
    common = {"labelCol": LABEL, "featuresCol": "features", "weightCol": "class_weight"}
    if name == "logistic_regression":
        # C weighs the summed loss against the penalty; Spark weighs the mean loss.
        return LogisticRegression(
            maxIter=200, regParam=1.0 / (parameters["C"] * rows), standardization=False, **common
        )
    if name == "random_forest":
        return RandomForestClassifier(seed=seed, **parameters, **common)
    if name == "gradient_boosting":
        return GBTClassifier(seed=seed, **parameters, **common)
    raise ValueError(f"Unknown candidate: {name!r}")


@dataclass(frozen=True)
class ChurnModel:
    """A fitted candidate. The dummy has no pipeline, only the training rate."""

    name: str
    parameters: Mapping[str, Any]
    pipeline: PipelineModel | None
    training_rate: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Add the churn probability, keeping the columns of ``rows``."""
        if self.pipeline is None:
            return rows.withColumn(SCORE, F.lit(self.training_rate))
        kept = [F.col(c) for c in rows.columns]
        return self.pipeline.transform(rows).select(*kept, vector_to_array("probability")[1].alias(SCORE))


def fit_candidate(
    train: DataFrame,
    name: str,
    parameters: Mapping[str, Any] | None = None,
    *,
    seed: int = 42,
    learnt: Preparation | None = None,
) -> ChurnModel:
    """M2: fit one candidate with classes balanced by weight ``n / (2 * n_class)``.

    ``learnt`` is what :func:`prepare` found in just these rows; without it, it is found here.
    """
    parameters = dict(BASE_PARAMETERS.get(name, {}) if parameters is None else parameters)
    learnt = learnt or prepare(train)[None]
    _check_classes(learnt)
    rate = learnt.positives / learnt.rows
    if name == "dummy":
        return ChurnModel(name, {}, None, rate)
    stages = preprocessing_stages(train, scale=name in SCALED, learnt=learnt)
    features = PipelineModel(stages).transform(train).select("features", LABEL).repartition(fit_parts(train, learnt.rows))
    fitted = _fitted(features, name, parameters, learnt, seed)
    return ChurnModel(name, parameters, PipelineModel([*stages, fitted]), rate)


def fit_parts(frame: DataFrame, rows: int) -> int:
    """Partitions for a learner, which passes over its rows many times: rows of a small table lie in one otherwise."""
    wanted = max(frame.sparkSession.sparkContext.defaultParallelism, ceil(rows / MANY_ROWS))
    return max(1, min(wanted, ceil(rows / FEW_ROWS)))


def _check_classes(learnt: Preparation) -> None:
    if not learnt.rows or not learnt.positives or learnt.positives == learnt.rows:
        raise ValueError("Training rows must contain both classes")


def _fitted(features: DataFrame, name: str, parameters: Mapping[str, Any], learnt: Preparation, seed: int) -> Transformer:
    """A learner fitted to prepared training rows."""
    n, positives = learnt.rows, learnt.positives
    weights = F.when(F.col(LABEL) == 1, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives)))
    if name == "logistic_regression":
        # Up to four tasks, a step has no second stage that adds up what they find.
        features = features.coalesce(ceil(n / LINEAR_ROWS))
    return _without_summary(_learner(name, parameters, n, seed).fit(features.select("features", LABEL, weights.alias("class_weight"))))


def _scored_by_trees(
    rows: DataFrame, fold: int, name: str, parameters: Mapping[str, Any], learnt: Preparation, seed: int
) -> DataFrame:
    """Rows of a fold, scored by trees that one task fits to the rows of the others.

    A level of a tree waits for the level before, so the jobs that Spark ML runs for each take their time however few the
    rows are, and it collects what every node of a forest counts. Fits run side by side, on as many tasks.
    """
    n, positives = learnt.rows, learnt.positives
    kept = [c for c in rows.columns if c != "features"]
    numbers = len(NUMERIC_FEATURES)
    classes = np.array([n / (2.0 * (n - positives)), n / (2.0 * positives)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of training rows the features and the label are held, of the others all that is given on; flags need a byte.
        known, asked, labels, named = [], [], [], []
        for batch in batches:
            matrix = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = batch.column("fold").to_numpy(zero_copy_only=False) == fold
            for part, to in ((matrix[~own], known), (matrix[own], asked)):
                to.append((part[:, :numbers].copy(), part[:, numbers:].astype(np.uint8)))
            labels.append(batch.column(LABEL).to_numpy(zero_copy_only=False)[~own])
            named.append(batch.select(kept).filter(pa.array(own)))
        if not any(b.num_rows for b in named):
            return
        features = [x for k in (0, 1) for x in np.concatenate([part[k] for part in known + asked]).T]
        del known, asked
        marks = np.concatenate(labels)
        if not np.isin(marks, (0, 1)).all():
            raise ValueError("Labels must be 0 or 1")
        marks = marks.astype(int)
        if name == "random_forest":
            scores = forest_probabilities(features, marks, classes, parameters, seed)
        else:
            scores = boosted_probabilities(features, marks, classes[marks], parameters)
        at = 0
        for batch in named:
            yield batch.append_column(SCORE, pa.array(scores[at : at + batch.num_rows], pa.float64()))
            at += batch.num_rows

    held = StructType([rows.schema[c] for c in kept]).add(SCORE, "double")
    # Rows are drawn by their place, which has to be the same in each run.
    listed = rows.filter("fold IS NOT NULL").select(*kept, vector_to_array("features").alias("x"))
    listed = listed.repartition(1).sortWithinPartitions(KEY, "x")
    return listed.mapInArrow(scored, held)


def _without_summary(model: Any) -> Any:
    """The model without the summary of its training rows, which holds the session.

    Scoring sends the model to the tasks, and a session that has observed a frame cannot be sent.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


# --- validation and tuning -------------------------------------------------------------------


def out_of_fold(
    folded: DataFrame,
    trials: Mapping[str, tuple[str, Mapping[str, Any] | None]],
    *,
    folds: int,
    seed: int = 42,
    parallelism: int = 4,
    prepared: Mapping[int | None, Preparation] | None = None,
) -> DataFrame:
    """Every training row scored by the model that did not see it, for each named trial.

    All trials share what :func:`prepare` finds in ``folded``, and those of a fold share its feature vectors, which
    are stored once for its training rows and its own. Trees of up to ``ROWS_OF_A_TASK`` rows are fitted in a task, those
    of more rows by Spark ML. Fits of all folds run side by side, ``parallelism`` at a time: one
    that waits for many small jobs leaves its cores to the others. The scores of a fit are stored at once, and its model
    is let go, so as many models are held as fits run.
    """
    keep = [KEY, LABEL, "fold"]
    prepared = prepared or prepare(folded)
    chosen = {t: (name, dict(BASE_PARAMETERS.get(name, {}) if p is None else p)) for t, (name, p) in trials.items()}
    kinds = {name in SCALED for name, _ in chosen.values() if name != "dummy"}

    def one(trial: str, fold: int, features: Mapping[bool, DataFrame]) -> DataFrame:
        name, parameters = chosen[trial]
        learnt = prepared[fold]
        if name == "dummy":
            held = folded.filter(F.col("fold") == fold).select(*keep, F.lit(learnt.positives / learnt.rows).alias(SCORE))
        elif name in TREES and learnt.rows <= ROWS_OF_A_TASK and parameters.keys() <= TREES[name].keys():
            held = _scored_by_trees(features[False], fold, name, TREES[name] | parameters, learnt, seed)
        else:
            rows = features[name in SCALED]
            model = _fitted(rows.filter(F.col("fold") != fold), name, parameters, learnt, seed)
            held = model.transform(rows.filter(F.col("fold") == fold)).select(*keep, vector_to_array("probability")[1].alias(SCORE))
        # A union of stored frames needs a projection on each: Spark looks up what it knows of their former columns.
        return materialize(held).select(F.lit(trial).alias("trial"), *keep, SCORE)

    parts = [fold for fold in range(folds) if fold in prepared]
    if not parts:
        raise ValueError("Rows of at least two folds are needed")
    jobs = []
    for fold in parts:
        _check_classes(prepared[fold])
        features = {}
        for scale in kinds:
            stages = preprocessing_stages(folded, scale=scale, learnt=prepared[fold])
            vectors = PipelineModel(stages).transform(folded).select(*keep, "features")
            features[scale] = materialize(vectors.repartition(fit_parts(folded, prepared[fold].rows), KEY))
        jobs += [lambda t=trial, k=fold, x=features: one(t, k, x) for trial in chosen]
    return reduce(lambda a, b: a.unionByName(b), _parallel(jobs, parallelism))


def cross_validation(scored: DataFrame) -> DataFrame:
    """M4: mean and sample deviation over folds of each metric, per trial."""
    per_fold = classification_metrics(scored, SCORE, LABEL, by=["trial", "fold"])
    return (
        per_fold.unpivot(["trial", "fold"], list(CV_METRICS), "metric", "value")
        .groupBy("trial", "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )


def drawn_parameters(space: Mapping[str, Sequence[Any]], iterations: int, seed: int) -> list[dict[str, Any]]:
    """M5: distinct points of a finite grid, drawn without replacement."""
    points = [dict(zip(space, values)) for values in product(*space.values())]
    return random.Random(seed).sample(points, min(iterations, len(points)))


def tune(
    folded: DataFrame, name: str, config: TrainingConfig, prepared: Mapping[int | None, Preparation] | None = None
) -> tuple[dict[str, Any], DataFrame, DataFrame]:
    """M5: parameters with the best mean average precision, the result of every draw, and the best draw's scores."""
    if name not in config.spaces:
        raise ValueError(f"No parameters to search for {name!r}")
    draws = drawn_parameters(config.spaces[name], config.tuning_iterations, config.seed)
    base = dict(config.base.get(name, {}))
    trials = {f"{i:03d}": (name, {**base, **draw}) for i, draw in enumerate(draws)}
    scored = materialize(
        out_of_fold(
            folded, trials, folds=config.folds, seed=config.seed, parallelism=config.parallelism, prepared=prepared
        )
    )
    quality = ranking_quality(scored, SCORE, LABEL, by=["trial", "fold"])
    results = quality.groupBy("trial").agg(F.avg("average_precision").alias("average_precision"))
    best = results.orderBy(F.desc("average_precision"), "trial").first()
    return trials[best.trial][1], results, scored.filter(F.col("trial") == best.trial)


# --- interpretation --------------------------------------------------------------------------


def coefficients(model: ChurnModel, spark: SparkSession) -> DataFrame:
    """Logistic coefficients by absolute size; no rows for other models."""
    schema = "feature string, coefficient double"
    if model.name != "logistic_regression" or model.pipeline is None:
        return spark.createDataFrame([], schema)
    indexers = [stage for stage in model.pipeline.stages if isinstance(stage, StringIndexerModel)]
    names = feature_names() + [f"{c}={value}" for c, x in zip(CATEGORICAL_FEATURES, indexers) for value in x.labels]
    learner = model.pipeline.stages[-1]
    values = learner.coefficients.toArray().tolist()
    rows = sorted(zip(names, values, strict=True), key=lambda row: -abs(row[1]))
    return spark.createDataFrame(rows, schema)


def permutation_importance(
    model: ChurnModel, rows: DataFrame, *, repeats: int = 8, seed: int = 42
) -> DataFrame:
    """Drop in average precision when one feature is shuffled, mean and deviation over repeats.

    Rows are numbered in a hashed order. A shuffled feature is taken from the row at
    ``(step * position + shift) mod n``: with a step that shares no factor with n, that is a
    permutation, and one equi-join on the position carries it out.
    """
    features = [*CATEGORICAL_FEATURES, *NUMERIC_FEATURES]
    release(rows.sparkSession)  # what the fit has left
    hashed = rows.select(KEY, LABEL, *features).withColumn("_draw", F.xxhash64(F.lit(seed), KEY))
    placed = materialize(numbered(hashed, order=["_draw", KEY], name="_position").drop("_draw"))
    n = placed.count()
    if n < 2:
        raise ValueError("At least two rows are needed")
    generator = random.Random(seed)
    plan = []
    for feature in features:
        for repeat in range(repeats):
            step = generator.randrange(1, n) if n > 2 else 1
            while _common_factor(step, n) != 1:
                step = generator.randrange(1, n)
            plan.append((feature, repeat, step, generator.randrange(1, n)))
    # One literal per (feature, repeat): a bounded list, exploded in place of a join. Each row gives its values to the
    # rows that take them, so the step is inverted.
    literals = ", ".join(
        f"named_struct('feature', '{f}', 'repeat', {r}, 'back', {pow(a, -1, n)}L, 'shift', {b}L)" for f, r, a, b in plan
    )
    # Products of two positions may pass 64 bits, hence decimal.
    taker = (F.col("back").cast("decimal(19,0)") * (F.col("_position") - 1 + n - F.col("shift"))) % F.lit(n)
    # Only the one value that a copy of a row takes over is shuffled to it, as text, which keeps every type exact.
    given = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("string")) for f in features])
    # A few rows have many copies, so tasks are cut by copies and not by the size of the rows.
    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, ceil(n * len(plan) / MANY_ROWS))
    copies = placed.repartition(tasks, "_position").select("*", F.expr(f"inline(array({literals}))"))
    taken = copies.select(
        (taker.cast("bigint") + 1).alias("_position"), "feature", "repeat", given.alias("_value")
    ).repartition(tasks, "_position")
    kinds = dict(placed.dtypes)
    swapped = taken.join(placed, "_position").select(
        *[c for c in placed.columns if c not in features],
        "feature",
        "repeat",
        *[F.when(F.col("feature") == f, F.col("_value").cast(kinds[f])).otherwise(F.col(f)).alias(f) for f in features],
    )
    base = ranking_quality(model.score(placed), SCORE, LABEL).select("average_precision")
    shuffled = ranking_quality(model.score(swapped), SCORE, LABEL, by=["feature", "repeat"])
    return (
        shuffled.withColumn("drop", base.scalar() - F.col("average_precision"))
        .groupBy("feature")
        .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


def _common_factor(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


# --- the whole workflow ----------------------------------------------------------------------


@dataclass(frozen=True)
class TrainingResult:
    """The deployed model and every table of the report."""

    deployed: ChurnModel
    selected: str
    parameters: Mapping[str, Any]
    threshold: float
    cross_validation: DataFrame
    tuning: DataFrame
    held_out: DataFrame
    held_out_default: DataFrame
    untuned_test: DataFrame
    predictions: DataFrame
    importance: DataFrame
    coefficients: DataFrame


def train(snapshot: DataFrame, config: TrainingConfig | None = None) -> TrainingResult:
    """Validate candidates, choose by average precision, tune, set the threshold, test once, refit.

    Choice, tuning and threshold use training rows only.
    """
    config = config or TrainingConfig()
    spark = snapshot.sparkSession
    cohort = materialize(stratified_split(snapshot, KEY, LABEL, test_size=config.test_size, seed=config.seed))
    test = cohort.filter("is_test").drop("is_test")
    training = materialize(
        stratified_folds(cohort.filter("NOT is_test").drop("is_test"), KEY, LABEL, folds=config.folds, seed=config.seed)
    )
    trials = {name: (name, config.base.get(name)) for name in config.candidates}
    prepared = prepare(training)
    shared = {"folds": config.folds, "seed": config.seed, "parallelism": config.parallelism, "prepared": prepared}
    validated = materialize(cross_validation(materialize(out_of_fold(training, trials, **shared))))
    best = (
        validated.filter((F.col("metric") == "average_precision") & (F.col("trial") != "dummy"))
        .orderBy(F.desc("mean"), "trial")
        .first()
    )
    selected = best.trial
    parameters, tuning, held_back = tune(training, selected, config, prepared)
    threshold = threshold_for_recall(held_back, SCORE, LABEL, minimum_recall=config.minimum_recall).first().threshold
    model = fit_candidate(training, selected, parameters, seed=config.seed, learnt=prepared[None])
    scored = materialize(model.score(test))

    def untuned(name: str, base: Mapping[str, Any] | None) -> DataFrame:
        fitted = fit_candidate(training, name, base, seed=config.seed, learnt=prepared[None])
        return materialize(fitted.score(test).select(LABEL, SCORE)).select(F.lit(name).alias("trial"), LABEL, SCORE)

    base_scores = reduce(
        lambda a, b: a.unionByName(b),
        _parallel([lambda n=name, p=p: untuned(n, p) for name, p in trials.values()], config.parallelism),
    )
    return TrainingResult(
        deployed=fit_candidate(cohort, selected, parameters, seed=config.seed),
        selected=selected,
        parameters=parameters,
        threshold=threshold,
        cross_validation=validated,
        tuning=tuning,
        held_out=classification_metrics(scored, SCORE, LABEL, threshold=threshold),
        held_out_default=classification_metrics(scored, SCORE, LABEL),
        untuned_test=classification_metrics(base_scores, SCORE, LABEL, by=["trial"]),
        predictions=scored.select(KEY, "region", "primary_plan", LABEL, SCORE).orderBy(F.desc(SCORE), KEY),
        importance=permutation_importance(model, test, repeats=config.importance_repeats, seed=config.seed),
        coefficients=coefficients(model, spark),
    )


def lift_over_dummy(result: TrainingResult) -> DataFrame:
    """Average precision of the tuned model over that of the dummy, on the test rows."""
    dummy = result.untuned_test.filter("trial = 'dummy'").select("average_precision").scalar()
    return result.held_out.select(
        (F.col("average_precision") / F.nullif(dummy, F.lit(0.0))).alias("average_precision_lift")
    )


def save_model(model: ChurnModel, path: str) -> None:
    """IO11: write a fitted pipeline."""
    if model.pipeline is None:
        raise ValueError("The dummy has no pipeline to save")
    model.pipeline.write().overwrite().save(path)


def load_model(path: str) -> Transformer:
    return PipelineModel.load(path)
