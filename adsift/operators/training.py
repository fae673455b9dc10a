"""Split, weights, assembly, the three classifiers, calibration, cross-fitting."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsift.functions import fixed_values as fixed
from adsift.operators.ordered import hash_cuts, hash_of, upto_cut
from adsift.sources.storage import stage

_NOT_FEATURES = ("job_id", "fake_label", "label", "split")
#: Fits that run side by side.
MOST_AT_ONCE = 8
#: Rows for each task of a fit: at least, and at most if there are more tasks than cores.
PACKED_ROWS = 5000
MOST_PACKED_ROWS = 100_000
#: What tells the seeds of bootstraps from those that draw splits, folds and rows of a fit.
BOOTSTRAP_SEEDS = 1000
#: Bootstraps of a version 2 forest.
FOREST_DRAWS = 20


# --- split and weights ----------------------------------------------------------


def class_counts(df: DataFrame, label: str = "label") -> dict:
    """Rows of each class; labels are 0 and 1, anything else is an error."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(10).collect()
    odd = {r[label]: r["n"] for r in rows if r[label] not in (0, 1)}
    if odd:
        raise ValueError(f"labels must be 0 or 1, but there are rows with {odd}")
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def split_quotas(counts: dict, test_size: float = fixed.TEST_SIZE) -> dict:
    """Rows of each class in the test part: shares by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(test_size * total)
    exact = {c: wanted * n / total for c, n in counts.items()}
    quota = {c: math.floor(share) for c, share in exact.items()}
    by_rest = sorted(counts, key=lambda c: (quota[c] - exact[c], c))
    for c in by_rest[: wanted - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "job_id",
    test_size: float = fixed.TEST_SIZE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``split``: exact class shares, rows drawn by a seeded hash order.

    The hash of the last test row of each class is found first; each row is
    then sorted in by itself, so the wide table is neither sorted nor shuffled.
    Keys must be unique, or the rows of the last one would all go to one side.
    """
    quotas = split_quotas(class_counts(df, label), test_size)
    cuts = hash_cuts(df, key, seed, {c: [n] for c, n in quotas.items()}, label)
    test = F.lit(False)
    for c, n in quotas.items():
        test = test | ((F.col(label) == c) & upto_cut(key, seed, cuts.get((c, n))))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def balanced_weights(counts: dict) -> dict:
    """n / (classes * class rows)."""
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def positive_scale(counts: dict) -> float:
    """Negatives per positive; 1 without positives."""
    positives = sum(n for c, n in counts.items() if c == 1)
    negatives = sum(n for c, n in counts.items() if c == 0)
    return negatives / positives if positives else 1.0


def class_weight_table(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: rows, balanced weight and boosting weight."""
    counts = class_counts(df, label)
    balanced, scale = balanced_weights(counts), positive_scale(counts)
    rows = [(int(c), n, balanced[c], scale if c == 1 else 1.0) for c, n in counts.items()]
    return df.sparkSession.createDataFrame(
        rows, "label int, n bigint, balanced_weight double, boosting_weight double"
    )


def _weighted(df: DataFrame, weights: dict) -> DataFrame:
    weight = F.lit(1.0)
    for c, w in weights.items():
        weight = F.when(F.col("label") == c, F.lit(float(w))).otherwise(weight)
    return df.withColumn("weight", weight)


# --- features -------------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in _NOT_FEATURES
    ]


def assemble(
    df: DataFrame,
    text_column: str | None = "tfidf",
    label: str = "fake_label",
    names: list[str] | None = None,
):
    """Dense features (missing 0), then the text vector, as ``features``.

    Both sit on the same row, so nothing is aligned by position or joined.
    ``names`` are the dense features that a model was fitted on, in order; the
    numeric columns of the table otherwise.  Returns the table and the names.
    """
    names = numeric_columns(df) if names is None else names
    zeroed = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    if text_column and isinstance(df.schema[text_column].dataType, T.ArrayType):
        zeroed = zeroed.withColumn(text_column, array_to_vector(F.col(text_column)))
    inputs = [*names, text_column] if text_column else names
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(zeroed)
    label_column = F.col(label).cast("double").alias("label")
    return assembled.select("job_id", label_column, "features"), names


#: The vector column of models that have the constant 1 as their last feature.
WITH_CONSTANT = "features_and_one"


def with_constant(df: DataFrame) -> DataFrame:
    """Add the features followed by a constant 1, whose weight is the intercept."""
    ones = df.withColumn("_one", F.lit(1.0))
    inputs = VectorAssembler(inputCols=["features", "_one"], outputCol=WITH_CONSTANT)
    return inputs.transform(ones).drop("_one")


def predicted(model, df: DataFrame) -> DataFrame:
    """The model's columns added to assembled rows, with the constant if it wants one."""
    wants = model.getFeaturesCol() == WITH_CONSTANT
    return model.transform(with_constant(df) if wants else df).drop(WITH_CONSTANT)


def score(model, df: DataFrame, name: str) -> DataFrame:
    """``(job_id, label, score, model)`` with the probability of class 1; the mean of them for
    a list of models."""
    models = model if isinstance(model, list) else [model]
    total = F.lit(0.0)
    for i, each in enumerate(models):
        df = predicted(each, df).drop("rawPrediction", "prediction")
        df = df.withColumn(f"_score{i}", vector_to_array("probability")[1]).drop("probability")
        total = total + F.col(f"_score{i}")
    return df.select(
        "job_id", "label", (total / len(models)).alias("score"), F.lit(name).alias("model")
    )


def at_once(spark: SparkSession, tasks: list[Callable]) -> list:
    """The results of small fits that run side by side.

    A fit of some thousand rows is a chain of short jobs that leaves most cores idle.
    """
    with ThreadPoolExecutor(max_workers=min(len(tasks), MOST_AT_ONCE)) as pool:
        return list(pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks))


def packed(df: DataFrame, name: str) -> DataFrame:
    """The rows of a fit, written once and read by as few tasks as they need: each of its many
    short jobs then has few tasks, and trees, whose tasks all send sums for each node, feature and
    bin, send no more for more rows.  Where that takes fewer tasks than rows alone would, they are
    dealt evenly first, since the slowest task makes the pace of every job."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, -(-n // PACKED_ROWS))
    tasks = min(wanted, max(cores, -(-n // MOST_PACKED_ROWS)))
    return stage(df if tasks == wanted else df.repartition(tasks), name).coalesce(tasks)


# --- classifiers ----------------------------------------------------------------


def _logistic_terms(train: DataFrame, version: int) -> tuple[dict, float]:
    """Balanced class weights and Spark's penalty, which is per unit of weight."""
    counts = class_counts(train)
    weights = balanced_weights(counts)
    total = sum(weights[c] * n for c, n in counts.items())
    return weights, 1.0 / (fixed.LOGISTIC_COST[version - 1] * total)


def fit_logistic(
    train: DataFrame,
    version: int = 2,
    max_iter: int = fixed.LOGISTIC_ITERATIONS,
    tol: float = fixed.LOGISTIC_TOLERANCE,
):
    """L2 logistic regression with balanced classes.

    Version 1 leaves the intercept free.  Version 2 penalises it like all weights: it is
    the weight of a constant feature, and the model has no other intercept.
    """
    weights, penalty = _logistic_terms(train, version)
    estimator = LogisticRegression(
        weightCol="weight",
        maxIter=max_iter,
        tol=tol,
        regParam=penalty,
        elasticNetParam=0.0,
        standardization=False,
    )
    rows = _weighted(train, weights)
    if version == 2:
        rows = _half_mirrored(with_constant(rows))
        estimator = estimator.setFitIntercept(False).setFeaturesCol(WITH_CONSTANT)
    return estimator.fit(rows)


def _half_mirrored(rows: DataFrame) -> DataFrame:
    """About half of the rows with features and label turned round.

    Without an intercept the loss of ``(x, y)`` is that of ``(-x, 1 - y)``, so the
    objective stays as it is.  But the constant feature is now -1 in some rows, and Spark,
    which gives a feature without variance no weight, fits it like any other.
    """
    size = rows.select(WITH_CONSTANT).first()[0].size
    turn = ElementwiseProduct(
        scalingVec=Vectors.dense([-1.0] * size), inputCol=WITH_CONSTANT, outputCol="_turned"
    )
    picked = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 0
    turned = turn.transform(rows.where(picked)).drop(WITH_CONSTANT)
    turned = turned.withColumnRenamed("_turned", WITH_CONSTANT).withColumn("label", 1 - F.col("label"))
    return rows.where(~picked).unionByName(turned)


def _times(share: Column, x: Column) -> Column:
    return x * share


def logistic_gradient(model, train: DataFrame, version: int = 2) -> DataFrame:
    """``(feature_id, gradient, start)``: the penalised objective's gradient by each weight
    at the fitted weights, and at zero weights, for scale.

    Where it vanishes is the optimum, the objective being convex, so this certifies a fit
    without a second solver.  One aggregate over the rows of the fit; what leaves the
    executors is two numbers for each feature.  The free intercept of version 1 is the last row.
    """
    weights, penalty = _logistic_terms(train, version)
    total = sum(weights[c] * n for c, n in class_counts(train).items())
    rows = _weighted(with_constant(predicted(model, train)), weights)
    p = vector_to_array("probability")[1]
    sums = {}
    for name, guess in (("gradient", p), ("start", F.lit(0.5))):
        share = F.col("weight") * (guess - F.col("label")) / total
        parts = F.transform(vector_to_array(WITH_CONSTANT), functools.partial(_times, share))
        sums[name] = Summarizer.sum(array_to_vector(parts)).alias(name)
    found = rows.agg(*sums.values()).first()
    at = model.coefficients.toArray() if version == 2 else [*model.coefficients.toArray(), 0.0]
    values = zip(found["gradient"].toArray(), found["start"].toArray(), at)
    table = [(i, float(g + penalty * w), float(s)) for i, (g, s, w) in enumerate(values)]
    return train.sparkSession.createDataFrame(table, "feature_id int, gradient double, start double")


def bootstrap_weights(
    df: DataFrame,
    draws: int,
    label: str = "label",
    key: str = "job_id",
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``weight_0`` to ``weight_<draws - 1>``: how often each bootstrap draws the row,
    times the balanced weight of its class inside that bootstrap.

    A row's number of draws is Poisson distributed with mean 1, read off a seeded hash of
    its key, so it does not depend on how the rows lie.  The class sizes of all bootstraps
    come from one aggregate.
    """
    counted = df
    for i in range(draws):
        counted = counted.withColumn(f"_draws_{i}", poisson_draw(key, seed + BOOTSTRAP_SEEDS + i))
    sums = counted.groupBy(label).agg(*[F.sum(f"_draws_{i}").alias(f"n_{i}") for i in range(draws)])
    found = sums.collect()
    for i in range(draws):
        sizes = {r[label]: r[f"n_{i}"] for r in found if r[f"n_{i}"]}
        weight = F.lit(0.0)
        for c, w in balanced_weights(sizes).items():
            weight = F.when(F.col(label) == c, F.lit(float(w))).otherwise(weight)
        counted = counted.withColumn(f"weight_{i}", F.col(f"_draws_{i}") * weight)
    return counted.drop(*[f"_draws_{i}" for i in range(draws)])


#: Draws above this have a chance below one in 10^13.
_MOST_DRAWS = 15


def poisson_draw(key: str, seed: int) -> Column:
    """How often a bootstrap of as many rows draws a row, by 32 bits of its hash."""
    chance = F.conv(F.substring(hash_of(key, seed), 1, 8), 16, 10).cast("double") / 2.0**32
    reached, draws = 0.0, F.lit(0)
    for k in range(_MOST_DRAWS):
        reached += math.exp(-1) / math.factorial(k)
        draws = draws + (chance >= reached).cast("int")
    return draws


def fit_forest(
    train: DataFrame,
    version: int = 2,
    trees: int | None = None,
    max_depth: int = fixed.FOREST_DEPTH,
    seed: int = fixed.SEED,
    draws: int | None = None,
):
    """Random forest with balanced classes; Spark limits the depth to 30.

    Version 1 weighs the classes once.  Version 2 weighs them inside each bootstrap: the
    bootstraps are weight columns, ``draws`` of them, and the trees are dealt to them in
    equal parts.  It gives a list of forests, whose mean is the forest's
    probability.
    """
    trees = trees or fixed.FOREST_TREES[version - 1]
    common = {"maxDepth": max_depth, "featureSubsetStrategy": "sqrt"}
    if version == 1:
        return RandomForestClassifier(weightCol="weight", numTrees=trees, seed=seed, **common).fit(
            _weighted(train, balanced_weights(class_counts(train)))
        )
    draws = min(draws or FOREST_DRAWS, trees)
    if trees % draws:
        raise ValueError(f"{trees} trees cannot be dealt evenly to {draws} bootstraps")
    rows = packed(bootstrap_weights(train, draws, seed=seed), "bootstraps")

    def fit(i: int):
        estimator = RandomForestClassifier(
            weightCol=f"weight_{i}", numTrees=trees // draws, bootstrap=False, seed=seed + i, **common
        )
        return estimator.fit(rows.where(F.col(f"weight_{i}") > 0))

    return at_once(train.sparkSession, [lambda i=i: fit(i) for i in range(draws)])


def fit_boosted(
    train: DataFrame, version: int = 2, rounds: int | None = None, seed: int = fixed.SEED
):
    """Gradient-boosted trees; version 2 weighs positives by neg/pos."""
    scale = positive_scale(class_counts(train)) if version == 2 else 1.0
    i = version - 1
    return GBTClassifier(
        weightCol="weight",
        maxIter=rounds or fixed.BOOSTING_ROUNDS[i],
        maxDepth=fixed.BOOSTING_DEPTH[i],
        stepSize=fixed.BOOSTING_STEP[i],
        subsamplingRate=fixed.BOOSTING_ROW_SHARE[i],
        featureSubsetStrategy=str(fixed.BOOSTING_COLUMN_SHARE[i]),
        seed=seed,
    ).fit(_weighted(train, {1: scale, 0: 1.0}))


# --- calibration ----------------------------------------------------------------


def bounded_rows(
    train: DataFrame, most: int | None, key: str = "job_id", seed: int = fixed.SEED + 2
) -> DataFrame:
    """The training rows, or ``most`` of them in a seeded hash order.

    Spark's trees keep all features of a row in memory and pass over them once
    per level of each tree, so classifiers are fitted on a bounded number of
    labelled rows; everything else works on all.
    """
    if most is None or train.count() <= most:
        return train
    cuts = hash_cuts(train, key, seed, {None: [most]})
    return train.where(upto_cut(key, seed, cuts.get((None, most))))


def calibration_sample(
    train: DataFrame,
    fraction: float = fixed.CALIBRATION_FRACTION,
    key: str = "job_id",
    seed: int = fixed.SEED,
) -> DataFrame:
    """An exact random share of the training rows, 100 at least if there are."""
    if not 0 < fraction <= 1:
        fraction = fixed.CALIBRATION_FRACTION
    rows = train.count()
    wanted = min(rows, max(fixed.CALIBRATION_MIN_ROWS, int(rows * fraction)))
    cuts = hash_cuts(train, key, seed, {None: [wanted]})
    return train.where(upto_cut(key, seed, cuts.get((None, wanted))))


def with_folds(
    df: DataFrame,
    folds: int = fixed.CALIBRATION_FOLDS,
    key: str = "job_id",
    seed: int = fixed.SEED + 1,
) -> DataFrame:
    """Add ``fold``: equal parts of each class in a seeded hash order."""
    counts = class_counts(df)
    ranks = {c: [n * i // folds for i in range(1, folds)] for c, n in counts.items()}
    cuts = hash_cuts(df, key, seed, ranks, "label")
    fold = F.lit(0)
    for c, marks in ranks.items():
        for mark in marks:
            past = (F.col("label") == c) & ~upto_cut(key, seed, cuts.get((c, mark)))
            fold = fold + past.cast("int")
    return df.withColumn("fold", fold)


def _margin(model, df: DataFrame) -> DataFrame:
    return predicted(model, df).withColumn("margin", vector_to_array("rawPrediction")[1])


def softened_targets(counts: dict) -> tuple[float, float]:
    """Targets of the positive and the negative rows."""
    ones, zeros = counts.get(1.0, 0), counts.get(0.0, 0)
    return (ones + 1) / (ones + 2), 1 / (zeros + 2)


def fit_sigmoids(
    margins: DataFrame, rounds: int = 100, tolerance: float = 1e-9
) -> dict[int, tuple[float, float]]:
    """Platt scaling of every fold at once: slope and offset by fold, from a staged table
    ``(fold, label, margin)``.

    Newton's method on two numbers a fold.  A round is one aggregate over the rows for
    all folds: loss, gradient and second derivatives at the present point.  A step
    that made the loss larger is halved.
    """
    counts: dict[int, dict] = {}
    for r in margins.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["fold"], {})[r["label"]] = r["n"]
    targets = {fold: softened_targets(n) for fold, n in counts.items()}
    now = {
        fold: (0.0, math.log((n.get(1.0, 0) + 1) / (n.get(0.0, 0) + 1))) for fold, n in counts.items()
    }
    best: dict[int, tuple] = {}
    step = {fold: (0.0, 0.0) for fold in counts}
    done: set[int] = set()
    for _ in range(rounds):
        if done == set(counts):
            break
        sums = _sigmoid_sums(margins.where(F.col("fold").isin([f for f in counts if f not in done])), now, targets)
        for r in sums.collect():
            fold = r["fold"]
            if fold in best and not r["loss"] <= best[fold][0] + abs(best[fold][0]) * 1e-12:
                step[fold] = (step[fold][0] / 2, step[fold][1] / 2)
            else:
                best[fold] = (r["loss"], *now[fold])
                step[fold] = _newton_step(r)
            now[fold] = (best[fold][1] + step[fold][0], best[fold][2] + step[fold][1])
            if max(map(abs, step[fold])) <= tolerance * (1 + max(map(abs, best[fold][1:]))):
                done.add(fold)
    return {fold: found[1:] for fold, found in best.items()}


def _sigmoid_sums(margins: DataFrame, at: dict, targets: dict) -> DataFrame:
    of_fold = lambda values: F.create_map(
        *[F.lit(x) for fold, v in values.items() for x in (fold, float(v))]
    )[F.col("fold")]
    high, low = ({fold: t[i] for fold, t in targets.items()} for i in (0, 1))
    rows = margins.select(
        "fold",
        F.col("margin").alias("m"),
        F.when(F.col("label") == 1, of_fold(high)).otherwise(of_fold(low)).alias("t"),
        (
            F.col("margin") * of_fold({f: a for f, (a, _) in at.items()})
            + of_fold({f: b for f, (_, b) in at.items()})
        ).alias("z"),
    ).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    m, t, z, p = (F.col(c) for c in "mtzp")
    spread = p * (1 - p)
    # log(1 + e^z) - t z, without overflow.
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
    return rows.groupBy("fold").agg(
        F.sum(loss).alias("loss"),
        F.sum(m * (p - t)).alias("by_slope"),
        F.sum(p - t).alias("by_offset"),
        F.sum(m * m * spread).alias("slope_slope"),
        F.sum(m * spread).alias("slope_offset"),
        F.sum(spread).alias("offset_offset"),
    )


def _newton_step(sums) -> tuple[float, float]:
    """The step to where the quadratic around the present point is least."""
    # A trace of ridge keeps equal margins solvable.
    a = sums["slope_slope"] * (1 + 1e-12) + 1e-12
    b, c = sums["slope_offset"], sums["offset_offset"] * (1 + 1e-12) + 1e-12
    det = a * c - b * b
    g, h = sums["by_slope"], sums["by_offset"]
    return (b * h - c * g) / det, (b * g - a * h) / det


def _fold_fits(sample: DataFrame, folds: int, fit: Callable) -> list:
    """For each fold, what ``fit`` makes of the rows of all others; side by side."""
    tasks = [lambda k=k: fit(sample.where(F.col("fold") != k)) for k in range(folds)]
    return at_once(sample.sparkSession, tasks)


def fit_calibrated(
    train: DataFrame,
    fraction: float = fixed.CALIBRATION_FRACTION,
    folds: int = fixed.CALIBRATION_FOLDS,
    seed: int = fixed.SEED,
    **logistic,
) -> list:
    """Per fold: a logistic model of the other folds and its sigmoid.

    The folds' models are fitted side by side, then all sigmoids together.
    """
    sample = calibration_sample(train, fraction, seed=seed)
    sample = packed(with_folds(sample, folds, seed=seed + 1), "calibration")
    models = _fold_fits(sample, folds, lambda rows: fit_logistic(rows, **logistic))
    sigmoids = fit_sigmoids(stage(_held_out_margins(models, sample), "margins"))
    return [(model, sigmoids[k]) for k, model in enumerate(models)]


def _held_out_margins(models: list, sample: DataFrame) -> DataFrame:
    """``(job_id, fold, label, margin)`` by the model that did not see the row."""
    parts = [
        _margin(model, sample.where(F.col("fold") == k)).select("job_id", "fold", "label", "margin")
        for k, model in enumerate(models)
    ]
    return functools.reduce(DataFrame.unionAll, parts)


def cross_fitted_scores(
    train: DataFrame,
    fit: Callable,
    name: str,
    folds: int = fixed.CALIBRATION_FOLDS,
    seed: int = fixed.SEED,
    scored: Callable = score,
) -> DataFrame:
    """Every training row scored by a model that was fitted without its fold.

    A threshold taken from these scores owes nothing to the test rows, nor to rows that
    their model had seen.  ``scored(model, rows, name)`` scores with what ``fit(rows)``
    gives.
    """
    rows = packed(with_folds(train, folds, seed=seed + 3), "cross-fit")
    models = _fold_fits(rows, folds, lambda others: fit(others.drop("fold")))
    parts = [scored(m, rows.where(F.col("fold") == k), name) for k, m in enumerate(models)]
    return functools.reduce(DataFrame.unionAll, parts)


def calibration_balance(
    train: DataFrame, fraction: float = fixed.CALIBRATION_FRACTION, **logistic
) -> DataFrame:
    """``(fold, n_rows, gap)``: the mean calibrated score of each fold's held-out rows
    less the mean of the targets that its sigmoid was fitted to."""
    fitted = fit_calibrated(train, fraction, **logistic)
    sample = with_folds(calibration_sample(train, fraction), len(fitted))
    parts = []
    for fold, (model, (slope, offset)) in enumerate(fitted):
        held = sample.where(F.col("fold") == fold)
        high, low = softened_targets(class_counts(held))
        target = F.when(F.col("label") == 1, high).otherwise(low)
        p = 1 / (1 + F.exp(-(F.col("margin") * slope + offset)))
        parts.append(
            _margin(model, held).agg(
                F.lit(fold).alias("fold"),
                F.count(F.lit(1)).alias("n_rows"),
                (F.round(F.avg(p) - F.avg(target), 3) + 0.0).alias("gap"),
            )
        )
    return functools.reduce(DataFrame.unionAll, parts)


def score_calibrated(fitted: list, df: DataFrame, name: str) -> DataFrame:
    """Mean of the folds' calibrated probabilities."""
    total = F.lit(0.0)
    for i, (model, (slope, offset)) in enumerate(fitted):
        df = _margin(model, df).drop("rawPrediction", "probability", "prediction")
        df = df.withColumnRenamed("margin", f"_margin{i}")
        total = total + 1 / (1 + F.exp(-(F.col(f"_margin{i}") * slope + offset)))
    return df.select(
        "job_id", "label", (total / len(fitted)).alias("score"), F.lit(name).alias("model")
    )
