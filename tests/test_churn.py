import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import churn_metrics as cm
from tallygrain.operators import churn_models as models
from tallygrain.operators.churn_models import TrainingConfig
from tallygrain.operators.features import CATEGORICAL_FEATURES, LABEL, NUMERIC_FEATURES


@pytest.fixture(scope="module")
def scored(spark):
    draw = random.Random(3)
    rows = []
    for i in range(300):
        label = int(draw.random() < 0.3)
        # Few distinct scores, one of them very common.
        score = 0.5 if draw.random() < 0.35 else round(min(1.0, max(0.0, draw.gauss(0.4 + 0.2 * label, 0.2))), 1)
        rows.append((i, score, label))
    return rows


def brute_quality(rows):
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        flagged = [y for _, s, y in rows if s >= t]
        recall = sum(flagged) / len(pos)
        ap += (recall - before) * sum(flagged) / len(flagged)
        before = recall
    return auc, ap


def brute_threshold(rows, floor):
    candidates = sorted({s for _, s, _ in rows} | {0.01, 0.99})
    positives, best = sum(y for *_, y in rows), None
    for t in (c for c in candidates if 0 < c < 1):
        flagged = [y for _, s, y in rows if s >= t]
        tp = sum(flagged)
        precision = tp / len(flagged) if flagged else 0.0
        recall = tp / positives
        f1 = 2 * tp / (len(flagged) + positives)
        if recall >= floor:
            best = max(best or (-1, -1, -1), (precision, f1, t))
    return best[2] if best else 0.5


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, score double, label int")


def test_ranking_quality_matches_all_pairs(spark, scored):
    row = cm.ranking_quality(frame(spark, scored), "score", "label").first()
    assert (row.roc_auc, row.average_precision) == pytest.approx(brute_quality(scored))


def test_category_modes(spark):
    rows = [("b\\", "x", None, "q'")] * 3 + [("a", "y", None, None)] * 3 + [("a", "y", None, "r")] * 0 + [("c", None, None, "p")] * 2
    frame_ = spark.createDataFrame(rows, "k string, l string, m string, n string").repartition(3)
    assert models.category_modes(frame_, ["k", "l", "m", "n"]) == {"k": "a", "l": "x", "n": "q'"}
    assert models.category_modes(frame_.limit(0), ["k"]) == {}


def test_preparation_fills_with_odd_modes(spark, monkeypatch):
    """A most frequent value that ends in a backslash or holds a quote stands in for a missing one."""
    plain = models.NUMERIC_FEATURES
    schema = ", ".join([f"{c} double" for c in plain] + [f"{c} string" for c in models.CATEGORICAL_FEATURES])
    odd = ["it's \\", "a\\'b", "\\"]
    values = [odd[i % 3] for i in range(len(models.CATEGORICAL_FEATURES))]
    rows = [(*[float(i + j) for j in range(len(plain))], *(values if i else [None] * len(values))) for i in range(6)]
    train = spark.createDataFrame(rows, schema)
    prepared = models.preprocessing_stages(train, scale=False)[0].transform(train)
    filled = prepared.select(*[f"{c}_filled" for c in models.CATEGORICAL_FEATURES]).distinct().collect()
    assert [tuple(r) for r in filled] == [tuple(values)]


def test_one_class_has_no_auc(spark):
    row = cm.ranking_quality(frame(spark, [(1, 0.2, 0), (2, 0.4, 0)]), "score", "label").first()
    assert row.roc_auc is None and row.average_precision is None


@pytest.mark.parametrize("floor", [0.1, 0.7, 0.95, 1.0])
def test_threshold_matches_a_scan(spark, scored, floor):
    got = cm.threshold_for_recall(frame(spark, scored), "score", "label", minimum_recall=floor).first().threshold
    assert got == brute_threshold(scored, floor)


def test_threshold_leaves_out_zero_and_one_and_falls_back(spark):
    sure = frame(spark, [(1, 1.0, 1), (2, 1.0, 1), (3, 0.0, 0)])
    assert cm.threshold_for_recall(sure, "score", "label").first().threshold == 0.99
    low = frame(spark, [(1, 0.0, 1), (2, 1.0, 0)])
    assert cm.threshold_for_recall(low, "score", "label").first().threshold == 0.5


def test_threshold_metrics(spark):
    row = cm.threshold_metrics(frame(spark, [(1, 0.5, 1), (2, 0.4, 1), (3, 0.6, 0), (4, 0.1, 0)]), "score", "label").first()
    assert (row.tn, row.fp, row.fn, row.tp, row.accuracy, row.f1) == (1, 1, 1, 1, 0.5, 0.5)
    none = cm.threshold_metrics(frame(spark, [(1, 0.1, 1)]), "score", "label").first()
    assert none.precision == 0.0 and none.recall == 0.0
    with pytest.raises(ValueError):
        cm.threshold_metrics(frame(spark, [(1, 0.1, 1)]), "score", "label", threshold=1.0)


def test_splits_are_stratified_and_repeatable(spark, scored):
    rows = frame(spark, scored)
    split = cm.stratified_split(rows, "id", "label").groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")
    )
    for r in split.collect():
        assert r.t == round(r.n * 0.2)
    folds = cm.stratified_folds(rows, "id", "label", folds=4).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.label == label]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    again = cm.stratified_split(rows.repartition(3), "id", "label").orderBy("id").collect()
    assert [(r.id, r.is_test) for r in cm.stratified_split(rows, "id", "label").orderBy("id").collect()] == [
        (r.id, r.is_test) for r in again
    ]


def test_errors_and_lists(spark):
    rows = spark.createDataFrame(
        [(1, "A", "Basic", 0.9, 0), (2, "A", "Basic", 0.2, 1), (3, "B", "Basic", 0.8, 1), (4, "B", "Pro", 0.7, 0)],
        "customer_id long, region string, primary_plan string, churn_probability double, y int",
    )
    errors = cm.with_errors(rows, "churn_probability", "y", 0.5)
    by = {r.region: (r.false_negative, r.false_positive) for r in cm.errors_by(errors, "region").collect()}
    assert by == {"A": (1, 1), "B": (0, 1)}
    extreme = cm.extreme_errors(errors, "churn_probability", "customer_id", ["region"], top=1).collect()
    assert {(r.error_type, r.customer_id) for r in extreme} == {("false_positive", 1), ("false_negative", 2)}
    ranked = cm.ranked_predictions(rows, threshold=0.75, plans=["Basic"]).collect()
    assert [(r.customer_id, r.predicted_churn) for r in ranked] == [(1, True), (3, True), (2, False)]
    assert [r.customer_id for r in cm.risk_list(rows, threshold=0.6, top=2).collect()] == [1, 3]
    with pytest.raises(ValueError):
        cm.ranked_predictions(rows.drop("region"), threshold=0.5)


TINY = TrainingConfig(
    folds=2, tuning_iterations=1, importance_repeats=1, candidates=("dummy", "logistic_regression"),
    spaces={"logistic_regression": {"C": (1.0,)}},
)


@pytest.fixture(scope="module")
def snapshot(spark, small):
    from tallygrain.plans.feature_queries import snapshot as build
    from tallygrain.session import materialize

    return materialize(build(spark, small))


def test_training_workflow(spark, snapshot, tmp_path):
    result = models.train(snapshot, TINY)
    held = result.held_out.first()
    n_test = result.predictions.count()
    assert held.tn + held.fp + held.fn + held.tp == n_test
    assert 0 < result.threshold < 1 and held.threshold == result.threshold
    assert 0 <= held.roc_auc <= 1 and result.selected == "logistic_regression"
    cv = {(r.trial, r.metric): r for r in result.cross_validation.collect()}
    assert cv[("dummy", "roc_auc")]["mean"] == pytest.approx(0.5)
    assert result.importance.count() == 23
    assert result.coefficients.count() > 36
    assert models.lift_over_dummy(result).first()[0] > 0
    path = str(tmp_path / "model")
    models.save_model(result.deployed, path)
    again = models.load_model(path).transform(snapshot).select("customer_id", "prediction")
    assert again.count() == snapshot.count()


def test_unseen_categories_and_nulls_are_scored(spark, snapshot):
    model = models.fit_candidate(snapshot, "logistic_regression")
    odd = snapshot.withColumn("region", F.lit("Atlantis")).withColumn("industry", F.lit(None).cast("string"))
    scored = model.score(odd)
    assert scored.filter("churn_probability IS NULL OR isnan(churn_probability)").count() == 0
    assert scored.count() == snapshot.count()
    assert model.score(snapshot).columns == [*snapshot.columns, "churn_probability"]


@pytest.fixture(scope="module")
def gappy(spark):
    """Rows of three folds with gaps, NaN, a constant, a feature without values and a category of one fold only."""
    draw = random.Random(11)
    rows = []
    for i in range(240):
        fold = i % 3
        numbers = [draw.gauss(j, 1 + j) if draw.random() < 0.8 else None for j in range(len(NUMERIC_FEATURES))]
        numbers[1] = float("nan") if i % 7 == 0 else float(i)
        numbers[2], numbers[3] = 0.1, None
        texts = [draw.choice(["a", "b", "c", None]) for _ in CATEGORICAL_FEATURES]
        texts[1] = "only" if fold == 1 else None
        texts[2] = None
        label = int(texts[0] == "b") if draw.random() < 0.9 else int(draw.random() < 0.5)
        rows.append((f"C{i}", label, fold, *texts, *numbers))
    types = [f"{c} string" for c in CATEGORICAL_FEATURES] + [f"{c} double" for c in NUMERIC_FEATURES]
    return spark.createDataFrame(rows, f"customer_id string, {LABEL} int, fold int, {', '.join(types)}").repartition(5).cache()


def test_preparation_without_each_fold_matches_brute_force(gappy):
    from statistics import fmean, median_low, stdev

    rows = gappy.collect()
    prepared = models.prepare(gappy)
    assert set(prepared) == {None, 0, 1, 2}
    for k, got in prepared.items():
        part = [r for r in rows if k is None or r.fold != k]
        assert (got.rows, got.positives) == (len(part), sum(r[LABEL] for r in part))
        for i, c in enumerate(NUMERIC_FEATURES):
            known = [r[c] for r in part if r[c] is not None and r[c] == r[c]]
            middle = median_low(known) if known else 0.0
            flags = [float(r[c] is None or r[c] != r[c]) for r in part]
            filled = [middle if gap else r[c] for gap, r in zip(flags, part)]
            assert got.medians[c] == middle
            for at, values in ((i, filled), (len(NUMERIC_FEATURES) + i, flags)):
                spread = stdev(values)
                assert got.shifts[at] == pytest.approx(fmean(values), abs=1e-12)
                assert got.scales[at] == pytest.approx(1 / spread if spread > 1e-9 else 0.0)
        for c in CATEGORICAL_FEATURES:
            counts = Counter(r[c] for r in part if r[c] is not None)
            first = min(counts, key=lambda v: (-counts[v], v)) if counts else "missing"
            assert got.modes[c] == first and got.labels[c] == sorted({*counts, first})
    assert "only" in prepared[0].labels[CATEGORICAL_FEATURES[1]]
    assert prepared[1].labels[CATEGORICAL_FEATURES[1]] == ["missing"]


def test_preparation_of_no_rows_and_of_one_fold(gappy):
    empty = models.prepare(gappy.limit(0))[None]
    assert (empty.rows, empty.positives) == (0, 0) and set(empty.scales) == {0.0}
    assert set(models.prepare(gappy.filter("fold = 0"))) == {None}
    with pytest.raises(ValueError):
        models.fit_candidate(gappy.limit(0), "dummy")
    with pytest.raises(ValueError):
        models.out_of_fold(gappy.filter("fold = 0"), {"d": ("dummy", None)}, folds=3)


def test_stages_of_what_is_learnt_read_no_rows(spark, gappy):
    learnt = models.prepare(gappy)[2]
    spark.sparkContext.setJobGroup("stages", "stages")
    stages = models.preprocessing_stages(gappy, scale=True, learnt=learnt)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("stages")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    size = len(models.feature_names()) + sum(len(x) for x in learnt.labels.values())
    features = models.PipelineModel(stages).transform(gappy).select("features").collect()
    assert {r.features.size for r in features} == {size}


def test_coefficients_belong_to_their_categories(spark, gappy):
    model = models.fit_candidate(gappy, "logistic_regression")
    found = {r.feature: r.coefficient for r in models.coefficients(model, spark).collect()}
    learnt = models.prepare(gappy)[None]
    members = {f"{c}={v}" for c, values in learnt.labels.items() for v in values}
    assert set(found) == members | set(models.feature_names())
    assert max(found, key=found.get) == f"{CATEGORICAL_FEATURES[0]}=b"


def test_folds_score_as_a_model_of_their_training_rows_alone(spark, gappy):
    """What is shared between folds does not leak: each fold's scores are those of a fit on the other rows alone."""
    trials = {"l": ("logistic_regression", {"C": 1.0})}
    got = {r.customer_id: r[models.SCORE] for r in models.out_of_fold(gappy, trials, folds=3).collect()}
    for k in range(3):
        alone = models.fit_candidate(gappy.filter(F.col("fold") != k).drop("fold"), "logistic_regression", {"C": 1.0})
        for r in alone.score(gappy.filter(F.col("fold") == k)).collect():
            assert got[r.customer_id] == pytest.approx(r[models.SCORE], abs=1e-6)
    assert len(got) == 240


@pytest.mark.parametrize(
    ("name", "parameters"),
    [
        ("logistic_regression", {"C": 1.0}),
        ("random_forest", {"numTrees": 2, "maxDepth": 2}),
        ("gradient_boosting", {"maxIter": 2, "maxDepth": 2}),
    ],
)
def test_models_score_in_a_session_that_has_observed_a_frame(spark, gappy, name, parameters):
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    scored = models.fit_candidate(gappy, name, parameters).score(gappy)
    assert scored.filter(F.col(models.SCORE).between(0, 1)).count() == 240


def test_out_of_fold_scores_every_row_once(spark, snapshot):
    folded = cm.stratified_folds(snapshot, "customer_id", models.LABEL, folds=2)
    got = models.out_of_fold(folded, {"d": ("dummy", None)}, folds=2)
    assert got.count() == snapshot.count() == got.select("customer_id").distinct().count()


def test_rows_of_a_fit_are_dealt_to_the_cores_and_folds_do_not_wait(spark, gappy, monkeypatch):
    assert [models.fit_parts(gappy, n) for n in (0, 240, 3_000, 12_000, 10_000_000)] == [1, 1, 2, 6, 100]
    monkeypatch.setattr(models, "FEW_ROWS", 60)
    fitted, jobs = models._fitted, []
    monkeypatch.setattr(
        models, "_fitted", lambda x, *rest: jobs.append(x.rdd.getNumPartitions()) or fitted(x, *rest)
    )
    pools = []
    parallel = models._parallel
    monkeypatch.setattr(models, "_parallel", lambda work, n: pools.append(len(work)) or parallel(work, n))
    trials = {"l": ("logistic_regression", {"C": 1.0}), "d": ("dummy", None)}
    scored = models.out_of_fold(gappy.coalesce(1), trials, folds=3)
    assert Counter((r.trial, r.fold) for r in scored.collect()) == {(t, k): 80 for t in trials for k in range(3)}
    assert jobs == [3, 3, 3] and pools == [6]


def test_steps_of_a_logistic_fit_take_no_second_stage_for_few_rows(spark, gappy, monkeypatch):
    monkeypatch.setattr(models, "FEW_ROWS", 30)
    learnt = models.prepare(gappy)[None]

    def stages(group):
        spark.sparkContext.setJobGroup(group, group)
        models.fit_candidate(gappy, "logistic_regression", {"C": 1.0}, learnt=learnt)
        tracker = spark.sparkContext.statusTracker()
        found = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    few = stages("few")
    monkeypatch.setattr(models, "LINEAR_ROWS", 1)
    many = stages("many")
    assert len(few) > 5 and max(few) < max(many)


def test_permutation_lets_the_driver_return_what_the_fit_took(spark, gappy, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "release", seen.append)
    scorer = SimpleNamespace(score=lambda frame: frame.withColumn(models.SCORE, F.lit(0.5)))
    models.permutation_importance(scorer, gappy, repeats=1)
    assert seen == [spark]


def test_boosting_in_a_task_scores_as_spark_ml(spark, gappy, monkeypatch):
    trials = {"g": ("gradient_boosting", {"maxIter": 4, "maxDepth": 3, "minInstancesPerNode": 20, "stepSize": 0.1})}
    got = {r.customer_id: r[models.SCORE] for r in models.out_of_fold(gappy, trials, folds=3).collect()}
    monkeypatch.setattr(models, "ROWS_OF_A_TASK", 0)
    spark_ml = {r.customer_id: r[models.SCORE] for r in models.out_of_fold(gappy, trials, folds=3).collect()}
    assert len(got) == 240 and got == pytest.approx(spark_ml, abs=1e-9)


def test_forest_in_a_task_scores_nearly_as_spark_ml_and_repeats(spark, gappy, monkeypatch):
    trials = {"f": ("random_forest", {"numTrees": 60, "maxDepth": 4, "minInstancesPerNode": 5})}
    got = {r.customer_id: r[models.SCORE] for r in models.out_of_fold(gappy, trials, folds=3).collect()}
    again = models.out_of_fold(gappy.repartition(3), trials, folds=3).collect()
    assert len(got) == 240 and got == {r.customer_id: r[models.SCORE] for r in again}
    monkeypatch.setattr(models, "ROWS_OF_A_TASK", 0)
    spark_ml = {r.customer_id: r[models.SCORE] for r in models.out_of_fold(gappy, trials, folds=3).collect()}
    assert sum(abs(got[k] - x) for k, x in spark_ml.items()) / 240 < 0.05


def test_a_fit_of_trees_takes_few_jobs(spark, gappy):
    """Spark ML ran a job for each level of each tree."""
    trials = {
        "f": ("random_forest", {"numTrees": 5, "maxDepth": 8, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}),
        "g": ("gradient_boosting", {"maxIter": 20, "maxDepth": 3, "minInstancesPerNode": 10, "stepSize": 0.1}),
    }
    prepared = models.prepare(gappy)
    spark.sparkContext.setJobGroup("trees", "trees")
    scored = models.out_of_fold(gappy, trials, folds=3, prepared=prepared)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 40
    assert Counter((r.trial, r.fold) for r in scored.collect()) == {(t, k): 80 for t in trials for k in range(3)}


def test_trees_refuse_other_labels_and_leave_other_parameters_to_spark(spark, gappy):
    with pytest.raises(Exception, match="Labels must be 0 or 1"):
        models.out_of_fold(gappy.withColumn(LABEL, F.col(LABEL) * 2), {"g": ("gradient_boosting", None)}, folds=3)
    few = {"g": ("gradient_boosting", {"maxIter": 1, "subsamplingRate": 0.5})}
    assert models.out_of_fold(gappy, few, folds=3).filter(F.col(models.SCORE).between(0, 1)).count() == 240


def test_split_points_are_midpoints_at_equal_weights():
    import numpy as np

    from tallygrain.functions import trees

    assert trees.split_points(np.array([2.0, 1.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.5, 3.0]
    assert trees.split_points(np.ones(5), np.ones(5)).tolist() == []
    draw = np.random.default_rng(1)
    values, weights = draw.integers(0, 300, 2000).astype(float), draw.choice([0.5, 3.0], 2000)
    seen = sorted(set(values))
    reached = np.cumsum([weights[values == v].sum() for v in seen])
    expected, target = [], reached[-1] / 32
    for i in range(1, len(seen)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            expected.append((seen[i - 1] + seen[i]) / 2)
            target += reached[-1] / 32
    assert trees.split_points(values, weights).tolist() == expected
    assert [trees.features_of_a_node(x, 66) for x in ("sqrt", "0.5", "0.8", "all", "3")] == [9, 33, 53, 66, 3]


def test_drawn_parameters_are_distinct_and_repeatable():
    space = {"a": (1, 2, 3), "b": (1, 2)}
    drawn = models.drawn_parameters(space, 12, 42)
    assert len(drawn) == 6 and drawn == models.drawn_parameters(space, 12, 42)
    assert len({tuple(d.items()) for d in drawn}) == 6


def test_training_config_is_checked():
    for bad in ({"test_size": 0.5}, {"folds": 1}, {"minimum_recall": 0}, {"candidates": ("dummy",)}):
        with pytest.raises(ValueError):
            TrainingConfig(**bad)


def test_registered_learners_run_the_whole_job(spark, small, monkeypatch):
    from tallygrain.plans import churn_queries

    class Seen(Exception):
        pass

    def stop(*args, **named):
        raise Seen(args[1:], named)

    monkeypatch.setattr(models, "out_of_fold", stop)
    whole = TrainingConfig()
    with pytest.raises(Seen) as seen:
        churn_queries.cross_validation(spark, small)
    (trials,), named = seen.value.args
    assert trials == {n: (n, whole.base.get(n)) for n in models.CANDIDATES} and named["folds"] == whole.folds
    monkeypatch.setattr(models, "train", stop)
    with pytest.raises(Seen) as seen:
        churn_queries.train_churn_model(spark, small)
    assert seen.value.args[0] == (whole,)


def test_permutation_changes_one_column_and_keeps_its_values(spark):
    features = [*CATEGORICAL_FEATURES, *NUMERIC_FEATURES]
    known = NUMERIC_FEATURES[0]
    draw = random.Random(5)
    rows = spark.createDataFrame([(f"C{i}", int(draw.random() < 0.4), i / 7) for i in range(40)], f"customer_id string, {LABEL} int, x double")
    rows = rows.select(
        "customer_id",
        F.when(F.col("x") > 3, 1).otherwise(F.col(LABEL)).alias(LABEL),
        *[F.when(F.col("x") > 0.5, F.concat(F.lit(c), F.col("x").cast("string"))).alias(c) for c in CATEGORICAL_FEATURES],
        *[(F.col("x") + i).alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
    )
    scored = []

    def score(frame):
        scored.append(frame)
        return frame.withColumn(models.SCORE, F.col(known))

    found = {r.feature: r for r in models.permutation_importance(SimpleNamespace(score=score), rows, repeats=2).collect()}
    assert set(found) == set(features)
    assert found[known].importance_mean > 0
    assert all(abs(r.importance_mean) < 1e-12 for f, r in found.items() if f != known)
    whole = {r.customer_id: r for r in rows.collect()}
    swapped = next(f for f in scored if "feature" in f.columns).collect()
    assert len(swapped) == 40 * len(features) * 2
    taken, moved = {}, Counter()
    for r in swapped:
        own = whole[r.customer_id]
        assert all(r[f] == own[f] for f in features if f != r.feature)
        taken.setdefault((r.feature, r.repeat), []).append(r[r.feature])
        moved[r.feature] += r[r.feature] != own[r.feature]
    assert all(Counter(v) == Counter(own[f] for own in whole.values()) for (f, _), v in taken.items())
    assert all(moved[f] > 40 for f in features)


def test_copies_of_few_rows_are_scored_by_many_tasks(spark, monkeypatch):
    features = [*CATEGORICAL_FEATURES, *NUMERIC_FEATURES]
    rows = spark.range(40).select(
        F.concat(F.lit("C"), "id").alias("customer_id"),
        (F.col("id") % 3 == 0).cast("int").alias(LABEL),
        *[F.col("id").cast("string").alias(c) for c in CATEGORICAL_FEATURES],
        *[F.col("id").cast("double").alias(c) for c in NUMERIC_FEATURES],
    )
    scored = []

    def score(frame):
        scored.append(frame)
        return frame.withColumn(models.SCORE, F.col(NUMERIC_FEATURES[0]))

    monkeypatch.setattr(models, "MANY_ROWS", 100)
    models.permutation_importance(SimpleNamespace(score=score), rows, repeats=2)
    swapped = next(f for f in scored if "feature" in f.columns)
    assert swapped.rdd.getNumPartitions() == -(-40 * len(features) * 2 // 100)
    assert swapped._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
