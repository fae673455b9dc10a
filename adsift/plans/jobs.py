"""The three jobs end to end: labelling, features, training."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.operators import evaluation, fitted, importance, labeling, reduction, training
from adsift.operators import vocabulary
from adsift.operators.features import fit_date_formats, row_features
from adsift.sources import postings as source
from adsift.sources.storage import committed_state, saved_state, stage, staged_job, write_table

#: Labelled rows that the classifiers are fitted on, at most.
FIT_ROWS = 200_000


# --- labelling ------------------------------------------------------------------


def label_job(
    postings: DataFrame,
    desc_threshold: int = fixed.DESC_THRESHOLD,
    min_flags: int = fixed.MIN_FLAGS,
) -> DataFrame:
    """Raw postings to labelled ones: dedup, key, rules, both labels.

    Copies go before the rows are numbered, or each copy would have a number of
    its own.  Keys that the input brings stay as they are; null or repeated
    ones are an error.
    """
    unique = source.dedup_postings(source.tolerant_schema(postings))
    if "job_id" in unique.columns:
        keyed = source.require_keys(stage(unique.drop(source.PLACE), "unique-postings"))
    else:
        keyed = source.surrogate_key(unique)
    return labeling.tune_label(labeling.label_postings(keyed, desc_threshold, min_flags))


def write_label_outputs(labelled: DataFrame, out: str) -> dict[str, DataFrame]:
    """The labelled tables, compact tables and rule counts.

    The wide table is written first; everything else reads it back, so the
    rules run once.
    """
    full = write_table(labelled, f"{out}/labelled")
    return {
        "labelled": full,
        "clean": write_table(labeling.compact_labelled(full), f"{out}/clean"),
        "clean_tuned": write_table(labeling.compact_tuned(full), f"{out}/clean_tuned"),
        "rule_counts": write_table(
            labeling.rule_trigger_counts(full), f"{out}/rule_counts"
        ),
    }


# --- features -------------------------------------------------------------------


@dataclass
class FeatureState:
    """All fitted state of the feature job; small tables and numbers."""

    index_max: float
    moments: dict[str, tuple[float, float]]
    codes: DataFrame
    text: vocabulary.TextModel
    formats: dict | None = None
    version: int = 2

    def save(self, spark: SparkSession, path: str) -> None:
        with saved_state(spark, path) as folder:
            self._write(spark, folder)

    def _write(self, spark: SparkSession, path: str) -> None:
        numbers = [("index_max", self.index_max, None)]
        numbers += [(c, mean, std) for c, (mean, std) in self.moments.items()]
        terms = list(enumerate(zip(self.text.terms, self.text.idf)))
        write_table(
            spark.createDataFrame(numbers, "name string, value double, scale double"),
            f"{path}/numbers",
        )
        write_table(
            spark.createDataFrame(
                [(t, i, w) for i, (t, w) in terms], "term string, term_id int, idf double"
            ),
            f"{path}/terms",
        )
        write_table(self.codes, f"{path}/codes")
        options = {"formats": self.formats, "version": self.version, "ngram": self.text.ngram}
        _save_json(spark, options, f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureState:
        path = committed_state(spark, path)
        numbers = {r["name"]: r for r in spark.read.parquet(f"{path}/numbers").collect()}
        top = numbers.pop("index_max")["value"]
        terms = spark.read.parquet(f"{path}/terms").collect()
        terms.sort(key=lambda r: r["term_id"])
        options = _load_json(spark, f"{path}/options")
        return cls(
            top,
            {c: (r["value"], r["scale"]) for c, r in sorted(numbers.items(), key=_scaled_place)},
            spark.read.parquet(f"{path}/codes"),
            vocabulary.TextModel(
                [r["term"] for r in terms], [r["idf"] for r in terms], options["ngram"]
            ),
            options["formats"],
            options["version"],
        )


def _scaled_place(item: tuple) -> int:
    return fixed.SCALED_COLUMNS.index(item[0])


def _save_json(spark: SparkSession, value, path: str) -> None:
    write_table(spark.createDataFrame([(json.dumps(value),)], "json string"), path)


def _load_json(spark: SparkSession, path: str):
    return json.loads(spark.read.parquet(path).first()["json"])


def prepare_rows(labelled: DataFrame, version: int = 2, formats: dict | None = None) -> DataFrame:
    """Row features and the words of each posting, written once.

    The only pass over the raw texts; all fits and the weighting read this
    table, most of them a few narrow columns of it.  ``formats`` are the date
    formats of each column, from ``fit_formats`` or a saved state.
    """
    labelled = source.default_label(labelled)
    rows = row_features(labelled, version, formats)
    text_column = "desc_clean" if version == 2 else "job_description"
    rows = vocabulary.with_words(
        rows, text_column, accents=version == 1, raw="job_description" if version == 2 else None
    )
    return stage(rows.drop("desc_clean", "job_description"), "row-features")


def fit_formats(labelled: DataFrame, version: int = 2) -> dict | None:
    """One format for each date column in version 2; each cell's own in version 1."""
    return fit_date_formats(labelled) if version == 2 else None


def fit_features(
    rows: DataFrame, version: int = 2, formats: dict | None = None, **limits
) -> FeatureState:
    """Fit on prepared rows: one pass for the numbers, one for the categories, and
    the passes of the vocabulary."""
    encoded = fixed.ENCODED_COLUMNS if version == 2 else fixed.ENCODED_COLUMNS_V1
    if version == 1:
        limits.setdefault("max_features", fixed.MAX_FEATURES_V1)
    numbers = fitted.fit_numbers(rows)
    return FeatureState(
        numbers.index_max,
        numbers.moments,
        fitted.fit_category_codes(rows, encoded),
        vocabulary.TextModel.fit(rows, documents=numbers.rows, **limits),
        formats,
        version,
    )


def apply_features(rows: DataFrame, state: FeatureState) -> DataFrame:
    """Meta features and the ``tfidf`` vector of each posting, on one row."""
    if state.version == 2:
        rows = fitted.apply_index(rows, state.index_max)
    rows = fitted.apply_scaler(fitted.apply_category_codes(rows, state.codes), state.moments)
    vectors = state.text.transform(rows)
    meta = fitted.meta_features(vectors, state.version).columns
    return vectors.select(*meta, "tfidf")


def feature_job(labelled: DataFrame, version: int = 2, **limits):
    """Labelled postings to the feature table and its fitted state."""
    formats = fit_formats(labelled, version)
    rows = prepare_rows(labelled, version, formats)
    state = fit_features(rows, version, formats, **limits)
    return apply_features(rows, state), state


def features_of(labelled: DataFrame, state: FeatureState) -> DataFrame:
    """The features of new postings by a fitted or loaded state."""
    return apply_features(prepare_rows(labelled, state.version, state.formats), state)


def write_feature_outputs(
    features: DataFrame, state: FeatureState, out: str
) -> dict[str, DataFrame]:
    """Feature table, sparse matrix, feature groups and fitted state."""
    spark = features.sparkSession
    state.save(spark, f"{out}/state")
    full = write_table(features, f"{out}/features")
    return {
        "features": full,
        "meta": write_table(full.drop("tfidf"), f"{out}/meta"),
        "tfidf": write_table(vocabulary.vector_entries(full), f"{out}/tfidf"),
        "feature_groups": write_table(fitted.feature_groups(full), f"{out}/feature_groups"),
    }


# --- training -------------------------------------------------------------------


@dataclass
class Parts:
    """Assembled rows, split, with the dense feature names and the SVD, if any."""

    train: DataFrame
    test: DataFrame
    names: list[str]
    components: np.ndarray | None = None


def assembled_rows(
    features: DataFrame, components: np.ndarray | None = None, names: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Feature vectors, the text part reduced if there are components."""
    if components is None:
        return training.assemble(features, "tfidf", names=names)
    return training.assemble(reduction.apply_svd(features, components), "svd", names=names)


def training_parts(
    features: DataFrame,
    svd_dim: int | None = None,
    test_size: float = fixed.TEST_SIZE,
    seed: int = fixed.SEED,
) -> Parts:
    """Assemble, optionally reduce the text part, split; written once."""
    components = None
    if svd_dim:
        features = stage(features, "features")
        size = features.schema["tfidf"].metadata.get("ml_attr", {}).get("num_attrs")
        size = size or features.select("tfidf").first()[0].size
        components = reduction.fit_svd(features, size, svd_dim, seed=seed)
    assembled, names = assembled_rows(features, components)
    rows = stage(assembled, "assembled")
    split = training.stratified_split(rows, test_size=test_size, seed=seed)
    return Parts(
        split.where(F.col("split") == "train").drop("split"),
        split.where(F.col("split") == "test").drop("split"),
        names,
        components,
    )


#: The three classifiers; names of their rows in the metrics table, and of their files.
LOGISTIC, FOREST, BOOSTED = "LogisticRegression", "RandomForest", "GradientBoosting"


@dataclass
class Models:
    """The three classifiers, with all that scoring new feature rows needs.

    ``logistic`` is a model, or a list of folds with their sigmoids if it is calibrated;
    ``forest`` a model, or a list of those that make up a version 2 forest.
    """

    logistic: LogisticRegressionModel | list
    forest: RandomForestClassificationModel | list
    boosted: GBTClassificationModel
    components: np.ndarray | None = None
    names: list[str] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        with saved_state(spark, path) as folder:
            self._write(spark, folder)

    def _write(self, spark: SparkSession, path: str) -> None:
        folds = self.logistic if isinstance(self.logistic, list) else [(self.logistic, None)]
        forests = self.forest if isinstance(self.forest, list) else [self.forest]
        for i, (model, _) in enumerate(folds):
            model.write().save(f"{path}/{LOGISTIC}-{i}")
        for i, model in enumerate(forests):
            model.write().save(f"{path}/{FOREST}-{i}")
        self.boosted.write().save(f"{path}/{BOOSTED}")
        if self.components is not None:
            reduction.save_components(spark, self.components, f"{path}/components")
        options = {
            "sigmoids": [s for _, s in folds],
            "forests": len(forests) if isinstance(self.forest, list) else None,
            "svd": self.components is not None,
            "names": self.names,
        }
        _save_json(spark, options, f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Models:
        path = committed_state(spark, path)
        options = _load_json(spark, f"{path}/options")
        folds = [
            (LogisticRegressionModel.load(f"{path}/{LOGISTIC}-{i}"), s and tuple(s))
            for i, s in enumerate(options["sigmoids"])
        ]
        forests = [
            RandomForestClassificationModel.load(f"{path}/{FOREST}-{i}")
            for i in range(options["forests"] or 1)
        ]
        return cls(
            folds[0][0] if folds[0][1] is None else folds,
            forests[0] if options["forests"] is None else forests,
            GBTClassificationModel.load(f"{path}/{BOOSTED}"),
            reduction.load_components(spark, f"{path}/components") if options["svd"] else None,
            options["names"],
        )

    def score(self, rows: DataFrame) -> DataFrame:
        """``(job_id, label, score, model)`` of assembled rows, one for each model."""
        table = score_logistic(self.logistic, rows, LOGISTIC)
        table = table.unionByName(training.score(self.forest, rows, FOREST))
        return table.unionByName(training.score(self.boosted, rows, BOOSTED))

    def score_features(self, features: DataFrame) -> DataFrame:
        return self.score(assembled_rows(features, self.components, self.names)[0])


def score_logistic(model, rows: DataFrame, name: str) -> DataFrame:
    """Scores of a plain model, or of the folds of a calibrated one."""
    if isinstance(model, list):
        return training.score_calibrated(model, rows, name)
    return training.score(model, rows, name)


def _fits(
    version: int = 2,
    calibrate: bool = False,
    trees: int | None = None,
    max_depth: int = fixed.FOREST_DEPTH,
    rounds: int | None = None,
    max_iter: int = fixed.LOGISTIC_ITERATIONS,
    calibration_share: float = fixed.CALIBRATION_FRACTION,
    seed: int = fixed.SEED,
    draws: int | None = None,
) -> dict:
    """For each model its fit, from training rows, and its scores."""

    def logistic(rows):
        if not calibrate:
            return training.fit_logistic(rows, version, max_iter)
        return training.fit_calibrated(
            rows, calibration_share, seed=seed, version=version, max_iter=max_iter
        )

    return {
        LOGISTIC: (logistic, score_logistic),
        FOREST: (
            lambda rows: training.fit_forest(rows, version, trees, max_depth, seed, draws),
            training.score,
        ),
        BOOSTED: (lambda rows: training.fit_boosted(rows, version, rounds, seed), training.score),
    }


def _fit_rows(parts: Parts, most: int | None) -> DataFrame:
    return training.packed(training.bounded_rows(parts.train, most), "fit-rows")


def fit_models(parts: Parts, *, fit_rows: int | None = FIT_ROWS, **options) -> Models:
    """Fit the three classifiers on at most ``fit_rows`` training rows; options as for
    the job."""
    train = _fit_rows(parts, fit_rows)
    models = {name: fit(train) for name, (fit, _) in _fits(**options).items()}
    return Models(
        models[LOGISTIC], models[FOREST], models[BOOSTED], parts.components, parts.names
    )


def validation_scores(parts: Parts, *, fit_rows: int | None = FIT_ROWS, **options) -> DataFrame:
    """Scores of the rows of the fit, each by models that did not see it."""
    train = _fit_rows(parts, fit_rows)
    seed = options.get("seed", fixed.SEED)
    tables = [
        training.cross_fitted_scores(train, fit, name, seed=seed, scored=scored)
        for name, (fit, scored) in _fits(**options).items()
    ]
    return stage(functools.reduce(DataFrame.unionByName, tables), "validation-scores")


def metrics_table(
    scores: DataFrame, version: int = 2, tune_on: DataFrame | None = None
) -> DataFrame:
    """Metrics of all models; version 1 reports the 0.5 threshold alone."""
    report = evaluation.threshold_report(scores, tune_on=tune_on)
    if version == 1:
        report = report.where(~F.col("model").endswith("_Tuned")).drop("threshold")
    return report


def training_job(
    features: DataFrame,
    out: str,
    version: int = 2,
    svd_dim: int | None = None,
    test_size: float = fixed.TEST_SIZE,
    seed: int = fixed.SEED,
    tune_on: str = "test",
    **options,
) -> DataFrame:
    """Fit, score, report; writes models, importances and the metrics table, and
    leaves nothing staged.

    Thresholds are tuned on the test rows, as the table is defined, or, with
    ``tune_on="validation"``, on cross-fitted scores of the training rows.
    """
    if tune_on not in ("test", "validation"):
        raise ValueError(f"thresholds are tuned on 'test' or 'validation', not {tune_on!r}")
    spark = features.sparkSession
    with staged_job():
        parts = training_parts(features, svd_dim, test_size, seed)
        options |= {"version": version, "seed": seed}
        models = fit_models(parts, **options)
        models.save(spark, f"{out}/models")
        for name, model in ((FOREST, models.forest), (BOOSTED, models.boosted)):
            table = importance.feature_importance(spark, model, parts.names)
            write_table(table, f"{out}/importance/{name}")
        scores = stage(models.score(parts.test), "scores")
        tuning = validation_scores(parts, **options) if tune_on == "validation" else None
        return write_table(metrics_table(scores, version, tuning), f"{out}/metrics")
