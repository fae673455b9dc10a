import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from adsift.operators import importance, training
from conftest import column


def labelled(spark, n=1000):
    share = F.pmod(F.xxhash64("job_id"), F.lit(100)) < 71
    return spark.range(n).withColumnRenamed("id", "job_id").withColumn(
        "label", share.cast("double")
    )


def test_split_quota(spark):
    assert training.split_quotas({0: 290, 1: 711}) == {0: 58, 1: 143}
    assert training.split_quotas({0: 1, 1: 2}) == {0: 0, 1: 1}
    assert training.split_quotas({}) == {}


def test_split_is_exact_disjoint_complete_and_stable(spark):
    df = labelled(spark)
    counts = training.class_counts(df)
    split = training.stratified_split(df)
    got = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    quota = training.split_quotas(counts)
    for c, n in counts.items():
        assert got[(c, "test")] == quota[c] and got[(c, "train")] == n - quota[c]
    again = training.stratified_split(df.repartition(7))
    assert split.exceptAll(again).count() == 0
    other = training.stratified_split(df, seed=1)
    assert split.exceptAll(other).count() > 0
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


def test_labels_must_be_binary(spark):
    for bad in (None, 2):
        df = spark.createDataFrame([(1, 0), (2, 1), (3, bad)], "job_id long, label int")
        with pytest.raises(ValueError):
            training.class_counts(df)


def test_fit_rows_are_bounded_exactly(spark):
    df = labelled(spark)
    assert training.bounded_rows(df, 130).count() == 130
    assert training.bounded_rows(df, None) is df and training.bounded_rows(df, 2000) is df


def test_weights(spark):
    assert training.balanced_weights({0: 25, 1: 75}) == {0: 2.0, 1: pytest.approx(2 / 3)}
    assert training.positive_scale({0: 30, 1: 10}) == 3.0
    assert training.positive_scale({0: 30}) == 1.0
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    rows = [tuple(r) for r in training.class_weight_table(df).orderBy("label").collect()]
    assert rows == [(0, 3, pytest.approx(2 / 3), 1.0), (1, 1, 2.0, 3.0)]


def test_calibration_sample_and_folds(spark):
    df = labelled(spark)
    sample = training.calibration_sample(df)
    assert sample.count() == 300
    assert training.calibration_sample(df, fraction=7).count() == 300
    assert training.calibration_sample(df, fraction=0.01).count() == 100
    assert training.calibration_sample(df.limit(40)).count() == 40
    folds = training.with_folds(sample).groupBy("label", "fold").count().collect()
    by_class = {}
    for r in folds:
        by_class.setdefault(r["label"], []).append(r["count"])
    for sizes in by_class.values():
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


@pytest.fixture(scope="module")
def points(spark):
    rows = []
    for i in range(240):
        label = float(i % 4 != 0)
        x = (i * 37 % 100) / 100 + label * 0.8
        rows.append((i, label, Vectors.dense([x, (i * 17 % 50) / 50, 1.0])))
    return spark.createDataFrame(rows, ["job_id", "label", "features"])


def test_models_score_between_0_and_1(spark, points):
    models = {
        "lr": training.fit_logistic(points, max_iter=50),
        "lr1": training.fit_logistic(points, version=1, max_iter=50),
        "rf": training.fit_forest(points, trees=6, max_depth=4, draws=3),
        "gbt": training.fit_boosted(points, rounds=3),
    }
    for name, model in models.items():
        got = training.score(model, points, name)
        assert got.columns == ["job_id", "label", "score", "model"]
        low, high, n = got.agg(F.min("score"), F.max("score"), F.count("*")).first()
        assert 0 <= low < high <= 1 and n == 240
        right = got.where((F.col("score") >= 0.5) == (F.col("label") == 1)).count()
        assert right / 240 > 0.75


def test_node_tables_say_what_the_models_say(spark, points):
    for model in (
        training.fit_forest(points, trees=6, max_depth=4, draws=3),
        training.fit_forest(points, version=1, trees=5, max_depth=4),
        training.fit_boosted(points, rounds=4),
    ):
        nodes = importance.tree_nodes(spark, model)
        boosted = isinstance(model, GBTClassificationModel)
        got = {r["feature"]: r["importance"] for r in importance.shares(nodes, by_tree=not boosted).collect()}
        assert [got.get(i, 0) for i in range(3)] == pytest.approx(importance.model_shares(model))
        table = importance.feature_importance(spark, model, ["a", "b"]).collect()
        if boosted:
            used = {("a", "b", "tfidf_0")[i] for i in got}
            assert {r["feature"] for r in table} == used and all(r["gain"] > 0 for r in table)
            assert table == sorted(table, key=lambda r: -r["gain"])
        else:
            assert {r["feature"] for r in table} == {"a", "b", "tfidf_0"}
            assert table[0]["feature"] == "a"


def test_gain_is_the_mean_of_what_splits_save(spark):
    # The first tree's only split: the squared errors before less those after it.
    rows = [(i, float(i >= 30), Vectors.dense([float(i), 0.0])) for i in range(100)]
    points = spark.createDataFrame(rows, ["job_id", "label", "features"])
    model = GBTClassifier(maxIter=1, maxDepth=1, seed=1).fit(points)
    table = importance.feature_importance(spark, model, ["place", "none"]).collect()
    # Labels as -1 and 1: 100 rows with mean 0.4 split into two pure sides, at a bin's edge.
    assert [r["feature"] for r in table] == ["place"]
    assert table[0]["gain"] == pytest.approx(100 * (1 - 0.4**2), rel=0.1)


def test_forest_2_is_the_mean_of_its_bootstraps(spark, points):
    forests = training.fit_forest(points, trees=6, max_depth=4, draws=3)
    assert [m.getNumTrees for m in forests] == [2, 2, 2]
    got = column(training.score(forests, points, "rf"), "score")
    each = [column(training.score(m, points, "rf"), "score") for m in forests]
    assert got == pytest.approx([sum(s) / 3 for s in zip(*each)]) and each[0] != each[1]
    with pytest.raises(ValueError):
        training.fit_forest(points, trees=7, draws=3)


def test_bootstrap_weights(spark, points):
    rows = training.bootstrap_weights(points, 2).toPandas()
    again = training.bootstrap_weights(points.repartition(7), 2).toPandas()
    for name in ("weight_0", "weight_1"):
        assert sorted(rows[name]) == sorted(again[name])
        # Classes weigh the same inside each bootstrap, and a third or so is not drawn.
        by_class = rows.groupby("label")[name].sum()
        assert by_class[0.0] == pytest.approx(by_class[1.0])
        assert 0.3 < (rows[name] == 0).mean() < 0.45
    assert (rows["weight_0"] != rows["weight_1"]).any()
    # Also where the rows of the fit were drawn by a hash themselves.
    few = training.bootstrap_weights(training.bounded_rows(points, 60), 20).toPandas()
    assert min((few[f"weight_{i}"] > 0).mean() for i in range(20)) > 0.4


def test_gradient_vanishes_at_the_fit_and_nowhere_else(spark, points):
    for version in (1, 2):
        model = training.fit_logistic(points, version=version, tol=1e-12)
        table = training.logistic_gradient(model, points, version).toPandas()
        assert len(table) == 4
        assert table["gradient"].abs().max() < 1e-5 < 1e-2 < table["start"].abs().max()
    early = training.fit_logistic(points, max_iter=2)
    assert training.logistic_gradient(early, points).toPandas()["gradient"].abs().max() > 1e-3


def test_penalised_intercept_equals_a_newton_solve(spark, points):
    rows = points.toPandas()
    x = np.array([[*f.toArray(), 1.0] for f in rows["features"]])
    y = rows["label"].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - y)) + w / 2
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.eye(len(w)) / 2, gradient)
    model = training.fit_logistic(points, tol=1e-12)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-4) and model.intercept == 0


def test_sigmoids_equal_a_plain_solve(spark):
    draw = np.random.default_rng(3)
    rows = [
        (fold, float(label), float(draw.normal(label * (fold + 1), 1 + fold)))
        for fold in range(3) for label in draw.integers(0, 2, 80)
    ]
    rows += [(3, 1.0, float(m)) for m in range(5)]
    got = training.fit_sigmoids(spark.createDataFrame(rows, "fold int, label double, margin double"))
    for fold in range(4):
        m, y = (np.array([r[i] for r in rows if r[0] == fold]) for i in (2, 1))
        high, low = training.softened_targets({1.0: int(y.sum()), 0.0: int((1 - y).sum())})
        t, z = np.where(y == 1, high, low), np.c_[m, np.ones(len(m))]
        slope, offset = got[fold]
        p = 1 / (1 + np.exp(-(m * slope + offset)))
        assert np.abs(z.T @ (p - t)).max() < 1e-6


def test_cross_fitted_scores_come_from_other_folds(spark, points):
    seen = []

    def fit(rows):
        seen.append({r["job_id"] for r in rows.select("job_id").collect()})
        return training.fit_logistic(rows, max_iter=20)

    got = training.cross_fitted_scores(points, fit, "lr")
    assert sorted(column(got, "job_id")) == list(range(240)) and len(seen) == 3
    assert sorted(i for ids in seen for i in ids) == sorted(list(range(240)) * 2)


def test_calibrated_probability_is_the_mean_of_the_folds(spark, points):
    fitted = training.fit_calibrated(points, fraction=1.0, max_iter=50)
    assert len(fitted) == 3 and all(slope > 0 for _, (slope, _) in fitted)
    got = training.score_calibrated(fitted, points, "c")
    low, high, mean = got.agg(F.min("score"), F.max("score"), F.avg("score")).first()
    assert 0 < low < high < 1
    # Folds are fitted with balanced classes, the sigmoid restores the base rate.
    assert mean == pytest.approx(0.75, abs=0.03)


def test_folds_are_calibrated_to_their_targets(spark, points):
    rows = training.calibration_balance(points, fraction=1.0, max_iter=50).collect()
    assert [r["fold"] for r in rows] == [0, 1, 2]
    assert all(abs(r["gap"]) < 0.01 for r in rows)


def test_balanced_classes_add_up_to_one(spark, points):
    scored = training.score(training.fit_logistic(points, version=1, max_iter=200, tol=1e-9), points, "lr")
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[0.0] + means[1.0] == pytest.approx(1, abs=1e-3)


def test_assemble_keeps_names_in_order(spark):
    rows = [(1, 1, 2.0, 3, "x", Vectors.sparse(2, [1], [0.5]))]
    df = spark.createDataFrame(rows, ["job_id", "fake_label", "b", "a", "note", "tfidf"])
    df = df.withColumn("a", F.lit(None).cast("int"))
    got, names = training.assemble(df)
    assert names == ["b", "a"]
    assert got.first()["features"].toArray().tolist() == [2.0, 0.0, 0.0, 0.5]


def test_a_fit_has_no_more_tasks_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = training.packed(spark.range(0, 50_000, 1, 12), "rows")
    assert rows.rdd.getNumPartitions() == cores < 10 and rows.count() == 50_000
    assert training.packed(spark.range(6000), "rows").rdd.getNumPartitions() == 2
