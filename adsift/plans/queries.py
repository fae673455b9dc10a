"""The registered queries: each takes ``(spark, sf_dir)`` and gives a DataFrame."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.functions import parsing, text
from adsift.operators import evaluation, features, fitted, importance, labeling, reduction
from adsift.operators import training
from adsift.operators import vocabulary
from adsift.plans import jobs
from adsift.sources import postings as source
from adsift.sources.fixture import job_postings
from adsift.sources.storage import scratch_path, stage

# Labelled rows that lr_scores and lr_balance fit on; all other model queries fit on
# the whole training part.  Trees, depth, rounds, iterations and rank are those of the jobs.
FIT_ROWS = 300
DIGITS = 6
# What is left of the largest entry of the gradient, at most.
STATIONARY = 0.01


def postings(spark, sf) -> DataFrame:
    return source.tolerant_schema(job_postings(spark, sf))


def _rounded(*names: str) -> list[Column]:
    return [F.round(F.col(n), DIGITS).alias(n) for n in names]


# --- sources --------------------------------------------------------------------


def input_profile(spark, sf):
    return source.input_profile(postings(spark, sf))


def description_samples(spark, sf):
    return source.description_samples(postings(spark, sf))


def null_tokens(spark, sf):
    return postings(spark, sf).select("job_id", "job_location", "company_name", "job_type")


def scan_csv(spark, sf):
    """Postings written as a quoted export, texts with line breaks included, and scanned."""
    path = scratch_path(spark, "export")
    named = {b: a for a, b in fixed.SOURCE_COLUMNS.items()}
    rows = job_postings(spark, sf)
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.withColumnsRenamed(named).write.csv(path, header=True, escape='"', **blanks)
    read = source.tolerant_schema(source.scan_postings(spark, path, "csv", multi_line=True))
    return read.select(
        F.col("job_id").cast("long").alias("job_id"), "job_title", "company_name", "salary_range",
        F.md5(F.regexp_replace(F.trim("job_description"), r"\s+", " ")).alias("text_md5"),
    )


def absent_columns(spark, sf):
    """What columns that the input lacks are taken for."""
    few = job_postings(spark, sf).select("job_id", "job_title")
    return source.tolerant_schema(few).select(
        "job_id", "company_size", "skills_required", "job_portal", "salary_range"
    )


def surrogate_key(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = source.surrogate_key(documents.select(F.col("text").alias("job_description")))
    return keyed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("job_id").alias("first_id"),
        F.max("job_id").alias("last_id"),
        F.count_distinct("job_id").alias("n_ids"),
    )


def file_order_keys(spark, sf):
    """Keys of a keyless input of several files that holds every posting twice, the second time
    in reverse: the first of all copies stays, and numbers follow the files."""
    path = scratch_path(spark, "export")
    rows = postings(spark, sf)
    for folder, order in (("first", F.asc("job_id")), ("second", F.desc("job_id"))):
        rows.orderBy(order).drop("job_id").write.parquet(f"{path}/{folder}")
    read = source.scan_postings(spark, [f"{path}/first", f"{path}/second"], keep_order=True)
    keyed = source.surrogate_key(source.dedup_postings(source.tolerant_schema(read)))
    return keyed.select(
        "job_id", "job_title", "company_name",
        F.md5(F.coalesce("job_description", F.lit(""))).alias("text_md5"),
    )


def default_label(spark, sf):
    return source.default_label(postings(spark, sf)).select("job_id", "fake_label")


def _repeated(spark, sf):
    """Some of the postings stand there twice or three times."""
    times = F.greatest(F.col("job_id") % 5 - 1, F.lit(1)).cast("int")
    rows = postings(spark, sf)
    return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), times))).drop("_time")


def dedup_postings(spark, sf):
    return source.dedup_postings(_repeated(spark, sf))


def dedup_counts(spark, sf):
    return source.dedup_counts(_repeated(spark, sf))


def label_job_keyless(spark, sf):
    """Labelled postings of an input without keys, with how many keys they got."""
    table = jobs.label_job(_repeated(spark, sf).drop("job_id"))
    keys = table.agg(F.max("job_id").alias("last_id"), F.count_distinct("job_id").alias("n_ids"))
    return table.join(F.broadcast(keys)).select(
        F.md5(F.coalesce("job_description", F.lit(""))).alias("text_md5"),
        "company_name", "job_title", "salary_range", "num_flags", "fake_label",
        "fake_label_tuned", "triggered_rules", "last_id", "n_ids",
    )


def label_job_text_ids(spark, sf):
    """Labels and split of postings whose keys are text."""
    named = _repeated(spark, sf).withColumn("job_id", F.concat(F.lit("JOB-"), F.col("job_id")))
    table = jobs.label_job(named).select(
        "job_id", "triggered_rules", F.col("fake_label_tuned").alias("label")
    )
    return training.stratified_split(stage(table, "labels"))


# --- label derivations ----------------------------------------------------------


def salary_bounds_label(spark, sf):
    names = "salary_lower_lpa", "salary_upper_lpa"
    return parsing.add_label_salary(postings(spark, sf), *names).select("job_id", *names)


def experience_years(spark, sf):
    years = parsing.years_of_experience(F.col("experience_required"))
    return postings(spark, sf).select("job_id", years.alias("exp_years"))


def word_count_whitespace(spark, sf):
    count = text.count_blank_separated(text.text_of(F.col("job_description")))
    return postings(spark, sf).select("job_id", count.alias("desc_wordcount_ws"))


def company_size_bucket(spark, sf):
    bucket = parsing.company_size_bucket(F.col("company_size"))
    return postings(spark, sf).select("job_id", bucket.alias("company_size_bucket"))


def email_domain(spark, sf):
    domain = parsing.email_domain(F.col("recruiter_email"))
    return postings(spark, sf).select("job_id", domain.alias("email_domain"))


def applicants_number(spark, sf):
    number = parsing.to_number(parsing.ascii_digits(F.col("number_of_applicants")))
    return postings(spark, sf).select("job_id", number.alias("number_of_applicants"))


# --- rules and labels -----------------------------------------------------------


def labelled(spark, sf) -> DataFrame:
    return labeling.tune_label(labeling.label_postings(postings(spark, sf)))


def rule_flags(spark, sf):
    table = labelled(spark, sf)
    return table.select("job_id", *labeling.flag_columns(table))


def rule_trace(spark, sf):
    return labelled(spark, sf).select("job_id", "num_flags", "fake_label", "triggered_rules")


def rule_trigger_counts(spark, sf):
    return labeling.rule_trigger_counts(labelled(spark, sf))


def label_summary(spark, sf):
    return labeling.label_summary(labelled(spark, sf)).withColumn(
        "flagged_percent", F.round("flagged_percent", DIGITS)
    )


def tuned_label(spark, sf):
    return labelled(spark, sf).select("job_id", "num_flags", "fake_label_tuned")


def label_distribution(spark, sf):
    return labeling.label_distribution(labelled(spark, sf))


def labelled_compact(spark, sf):
    return labeling.compact_labelled(labelled(spark, sf))


def tuned_compact(spark, sf):
    return labeling.compact_tuned(labelled(spark, sf))


# --- row features ---------------------------------------------------------------

_DATES = [
    "posted_year", "posted_month", "posted_dayofweek", "days_to_deadline", "is_urgent",
    "is_long_term",
]


def date_features(spark, sf):
    rows = postings(spark, sf)
    return features.add_date_features(rows, features.fit_date_formats(rows)).select(
        "job_id", *_DATES
    )


def date_features_v1(spark, sf):
    return features.add_date_features(postings(spark, sf)).select("job_id", *_DATES)


def salary_features(spark, sf):
    table = features.add_salary_category(features.add_salary_features(postings(spark, sf)))
    return table.select("job_id", "min_salary", "max_salary", "avg_salary", "salary_category")


def experience_features(spark, sf):
    table = features.add_experience_features(postings(spark, sf))
    return features.add_experience_category(table).select(
        "job_id", "min_experience", "max_experience", "avg_experience", "experience_category"
    )


def skill_features(spark, sf):
    names = [features.skill_column(s) for s in fixed.SKILLS]
    return features.add_skill_features(postings(spark, sf)).select(
        "job_id", *[f"`{n}`" for n in names], "total_skills", "technical_skills_count"
    )


def clean_text(spark, sf):
    return features.add_clean_text(postings(spark, sf)).select("job_id", "desc_clean")


_KEYWORDS = ["desc_wordcount", "has_remote", "has_urgent", "has_fee"]


def keyword_flags_v1(spark, sf):
    return features.add_keyword_flags(postings(spark, sf), version=1).select(
        "job_id", *_KEYWORDS
    )


def keyword_flags_v2(spark, sf):
    return features.add_keyword_flags(features.add_clean_text(postings(spark, sf))).select(
        "job_id", *_KEYWORDS
    )


def india_signals(spark, sf):
    return features.add_india_signals(features.add_clean_text(postings(spark, sf))).select(
        "job_id", "india_scam_keyword_count", "has_india_scam_kw", "mentions_whatsapp",
        "mentions_gmail_or_free_email", "mentions_confidential", "has_gst_hint",
    )


def _indexed(spark, sf) -> DataFrame:
    """Narrow table with the raw index; written once, fitted, applied."""
    rows = features.add_salary_features(features.add_clean_text(postings(spark, sf)))
    rows = features.add_india_signals(features.add_keyword_flags(rows))
    raw = stage(
        features.add_fraud_trigger_raw(rows).select(
            "job_id", "fraud_trigger_index_raw", "india_scam_keyword_count"
        ),
        "index",
    )
    return fitted.apply_index(raw, fitted.fit_index_max(raw))


def fraud_trigger_index(spark, sf):
    return _indexed(spark, sf).select(
        "job_id", *_rounded("fraud_trigger_index_raw", "fraud_trigger_index")
    )


def location_features(spark, sf):
    return features.add_location_features(postings(spark, sf)).select(
        "job_id", "is_multiple_locations", "is_remote_location", "is_major_city",
        "location_category",
    )


def company_features(spark, sf):
    return features.add_company_features(postings(spark, sf)).select(
        "job_id", "is_premium_company", "is_established_company", "company_tier"
    )


def portal_features(spark, sf):
    return features.add_portal_features(postings(spark, sf)).select(
        "job_id", "is_popular_portal", "portal_category"
    )


def _features(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """Row features with the date formats that the whole table fits."""
    rows = postings(spark, sf) if rows is None else rows
    return features.row_features(rows, 2, jobs.fit_formats(postings(spark, sf)))


def composite_features(spark, sf):
    return _features(spark, sf).select(
        "job_id", "number_of_applicants",
        *_rounded(
            "competition_index", "salary_exp_ratio", "skill_demand_score", "job_attractiveness"
        ),
    )


# --- fitted transforms ----------------------------------------------------------


def category_encode(spark, sf):
    rows = features.add_location_features(postings(spark, sf))
    rows = features.add_portal_features(features.add_company_features(rows))
    rows = stage(rows.select("job_id", *fixed.ENCODED_COLUMNS), "category-values")
    encoded = fitted.apply_category_codes(rows, fitted.fit_category_codes(rows))
    return encoded.select("job_id", *[f"{c}_enc" for c in fixed.ENCODED_COLUMNS])


def category_encode_v1(spark, sf):
    rows = features.row_features(postings(spark, sf), version=1)
    rows = stage(rows.select("job_id", *fixed.ENCODED_COLUMNS_V1), "category-values")
    codes = fitted.fit_category_codes(rows, fixed.ENCODED_COLUMNS_V1)
    return fitted.apply_category_codes(rows, codes).select(
        "job_id", *[f"{c}_enc" for c in fixed.ENCODED_COLUMNS_V1]
    )


_SCALED = [c for c in fixed.SCALED_COLUMNS if c != "education_level"]


def standardize(spark, sf):
    rows = _features(spark, sf).select("job_id", *_SCALED)
    rows = stage(rows, "numbers")
    scaled = fitted.apply_scaler(rows, fitted.fit_scaler(rows))
    return scaled.select("job_id", *_rounded(*[f"{c}_scaled" for c in _SCALED]))


def _tuned(spark, sf) -> DataFrame:
    return labeling.use_tuned_label(labelled(spark, sf))


def meta_features(spark, sf):
    rows = _features(spark, sf, _tuned(spark, sf))
    rows = stage(rows.drop("desc_clean", "job_description"), "row-features")
    numbers = fitted.fit_numbers(rows)
    rows = fitted.apply_index(rows, numbers.index_max)
    rows = fitted.apply_category_codes(rows, fitted.fit_category_codes(rows))
    table = fitted.meta_features(fitted.apply_scaler(rows, numbers.moments))
    doubles = {c for c, kind in table.dtypes if kind == "double"}
    return table.select(*[_rounded(c)[0] if c in doubles else c for c in table.columns])


def reloaded_features(spark, sf):
    """Features by a state that was saved and loaded."""
    tuned = _tuned(spark, sf)
    path = scratch_path(spark, "state")
    jobs.feature_job(tuned)[1].save(spark, path)
    table = jobs.features_of(tuned, jobs.FeatureState.load(spark, path)).drop("tfidf")
    doubles = {c for c, kind in table.dtypes if kind == "double"}
    return table.select(*[_rounded(c)[0] if c in doubles else c for c in table.columns])


def feature_groups(spark, sf):
    rows = _features(spark, sf, _tuned(spark, sf))
    return fitted.feature_group_counts(fitted.apply_index(rows, 1.0))


def feature_group_select(spark, sf):
    rows = _features(spark, sf)
    return fitted.select_group(rows, "salary_experience").withColumn(
        "salary_exp_ratio", F.round("salary_exp_ratio", DIGITS)
    )


# --- text model -----------------------------------------------------------------


def _word_rows(spark, sf) -> DataFrame:
    """Words of each posting, written once for the passes of the text model."""
    rows = features.add_clean_text(postings(spark, sf).select("job_id", "job_description"))
    return stage(vocabulary.with_words(rows, raw="job_description").select("job_id", "words"), "words")


def tokens_ngrams(spark, sf):
    rows = features.add_clean_text(postings(spark, sf).select("job_id", "job_description"))
    return vocabulary.terms_of_documents(vocabulary.with_words(rows, raw="job_description"))


def tokens_ngrams_v1(spark, sf):
    rows = postings(spark, sf).select("job_id", "job_description")
    return vocabulary.terms_of_documents(
        vocabulary.with_words(rows, "job_description", accents=True)
    )


def vocabulary_terms(spark, sf):
    return vocabulary.fit_vocabulary(_word_rows(spark, sf))


def tfidf(spark, sf):
    rows = _word_rows(spark, sf)
    vectors = vocabulary.TextModel.fit(rows).transform(rows)
    return vocabulary.vector_entries(vectors).withColumn("weight", F.round("weight", DIGITS))


def _reduced(spark, sf):
    rows = _word_rows(spark, sf)
    model = vocabulary.TextModel.fit(rows)
    vectors = stage(model.transform(rows).select("job_id", "tfidf"), "vectors")
    components = reduction.fit_svd(vectors, len(model.terms), fixed.SVD_DIM)
    return vectors, reduction.apply_svd(vectors, components)


def svd_features(spark, sf):
    return _reduced(spark, sf)[1].select("job_id", "svd")


def svd_energy(spark, sf):
    """The energy of the TF-IDF rows, that of the strongest terms, and whether the
    captured share lies between: no projection of a rank holds more than the whole,
    the best one no less than as many single terms."""
    vectors, reduced = _reduced(spark, sf)
    squares = F.aggregate("svd", F.lit(0.0), lambda a, x: a + x * x)
    captured = reduced.agg(F.sum(squares).alias("captured"))
    by_term = reduction.gram_diagonal(vectors)
    # As many terms as the vocabulary has at most.
    strongest = by_term.orderBy(F.desc("energy")).limit(fixed.SVD_DIM)
    top = strongest.agg(F.sum("energy").alias("top"))
    whole = by_term.agg(F.sum("energy").alias("whole"))
    table = whole.join(top).join(captured)
    return table.select(
        F.round("whole", 4).alias("energy"),
        F.round("top", 4).alias("strongest_terms"),
        (F.col("captured") <= F.col("whole") * (1 + 1e-9)).alias("within_energy"),
        (F.col("captured") >= F.col("top") * (1 - 1e-9)).alias("no_less_than_terms"),
    )


def svd_certificate(spark, sf):
    """Whether the components are singular vectors: lengths 1 and right angles, and of each
    no more than the tolerance left over when the rows are applied to it."""
    rows = _word_rows(spark, sf)
    model = vocabulary.TextModel.fit(rows)
    vectors = stage(model.transform(rows).select("job_id", "tfidf"), "vectors")
    found = reduction.certify(
        vectors, reduction.fit_svd(vectors, len(model.terms), fixed.SVD_DIM)
    )
    return found.agg(
        F.count(F.lit(1)).alias("n_components"),
        (F.max("overlap") <= 1e-8).alias("orthonormal"),
        (F.max("residual") <= reduction.TOLERANCE * F.max("energy") * (1 + 1e-6)).alias("certified"),
        (F.min("energy") >= -1e-9).alias("no_negative_energy"),
    )


# --- split, weights, models -----------------------------------------------------


# What the model queries of a session share: staged tables and fitted models.
_shared: dict = {}


def _once(spark, sf, kind: str, make):
    """The shared thing of this session and folder, made by the first query that asks."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def _label_rows(spark, sf) -> DataFrame:
    rows = labelled(spark, sf).select("job_id", F.col("fake_label_tuned").alias("label"))
    return stage(rows, "labels")


def stratified_split(spark, sf):
    return training.stratified_split(_label_rows(spark, sf))


def class_weights(spark, sf):
    return training.class_weight_table(_label_rows(spark, sf)).withColumns(
        {c: F.round(c, DIGITS) for c in ("balanced_weight", "boosting_weight")}
    )


def calibration_sample(spark, sf):
    rows = _label_rows(spark, sf)
    return training.calibration_sample(rows).select("job_id", "label")


def calibration_folds(spark, sf):
    return training.with_folds(_label_rows(spark, sf))


def _feature_table(spark, sf) -> DataFrame:
    make = lambda: stage(jobs.feature_job(_tuned(spark, sf))[0], "feature-table")
    return _once(spark, sf, "features", make)


def assembled_features(spark, sf):
    """What assembly makes of each row: the sum of the dense part, and the entries
    and length of the text part."""
    assembled, names = training.assemble(_feature_table(spark, sf))
    rows = assembled.withColumn("x", vector_to_array("features"))
    dense = F.slice("x", F.lit(1), F.lit(len(names)))
    rows = rows.withColumns(
        {"dense": dense, "text": F.slice("x", F.lit(len(names) + 1), F.size("x"))}
    )
    squares = F.aggregate("text", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(
        "job_id",
        F.col("label").cast("int").alias("label"),
        F.round(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x), 4).alias("dense_sum"),
        F.size(F.filter("text", lambda x: x != 0)).alias("text_entries"),
        F.round(F.sqrt(squares), 6).alias("text_norm"),
    )


def _parts(spark, sf) -> jobs.Parts:
    return _once(spark, sf, "parts", lambda: jobs.training_parts(_feature_table(spark, sf)))


def _reduced_parts(spark, sf) -> jobs.Parts:
    """The text reduced to the job's rank: 300 components in place of 5,000 terms."""
    make = lambda: jobs.training_parts(_feature_table(spark, sf), fixed.SVD_DIM)
    return _once(spark, sf, "reduced", make)


def _fit_rows(parts: jobs.Parts) -> DataFrame:
    return training.packed(training.bounded_rows(parts.train, FIT_ROWS), "fit-rows")


def _train_rows(spark, sf) -> DataFrame:
    """All training rows with the reduced text; written once, read by every fit of the session."""
    make = lambda: training.packed(_reduced_parts(spark, sf).train, "train-rows")
    return _once(spark, sf, "train", make)


def _model(spark, sf, kind: str):
    """The calibrated, forest or boosted model on the reduced text, fitted on all training rows."""
    fits = {
        "calibrated": training.fit_calibrated,
        "forest": training.fit_forest,
        "boosted": training.fit_boosted,
    }
    return _once(spark, sf, kind, lambda: fits[kind](_train_rows(spark, sf)))


def lr_scores(spark, sf):
    parts = _parts(spark, sf)
    model = training.fit_logistic(_fit_rows(parts))
    return training.score(model, parts.test, "LogisticRegression")


def lr_balance(spark, sf):
    """At the optimum of a fit with balanced classes and a free intercept, the mean
    scores of both classes add up to 1 on the rows of the fit."""
    parts = _parts(spark, sf)
    rows = _fit_rows(parts)
    model = training.fit_logistic(rows, version=1)
    scored = training.score(model, rows, "LogisticRegression")
    mean = lambda c: F.avg(F.when(F.col("label") == c, F.col("score")))
    found = scored.agg(F.count(F.lit(1)).alias("n_fit"), F.round(mean(0) + mean(1), 1).alias("means"))
    tests = parts.test.agg(F.count(F.lit(1)).alias("n_test"))
    return found.join(tests)


def lr_stationarity(spark, sf):
    """The gradient of the penalised objective, the intercept's penalty included, has all but
    vanished at the fitted weights: its largest entry against the largest at zero weights,
    and the intercept's own, whose feature is 1, as it is."""
    parts = _reduced_parts(spark, sf)
    rows = _train_rows(spark, sf)
    table = training.logistic_gradient(training.fit_logistic(rows), rows)
    intercept = F.abs(F.max_by("gradient", "feature_id"))
    ends = table.agg(
        (intercept <= STATIONARY).alias("intercept_stationary"),
        (F.max(F.abs("gradient")) <= STATIONARY * F.max(F.abs("start"))).alias("stationary"),
        (F.count(F.lit(1)) == len(parts.names) + parts.components.shape[1] + 1).alias("all_weights"),
    )
    return rows.agg(F.count(F.lit(1)).alias("n_fit")).join(ends)


def calibrated_scores(spark, sf):
    models = _model(spark, sf, "calibrated")
    return training.score_calibrated(models, _reduced_parts(spark, sf).test, "LogisticRegression")


def calibration_balance(spark, sf):
    """A fold's sigmoid gives its held-out rows the mean of their softened targets."""
    return training.calibration_balance(_train_rows(spark, sf))


def bootstrap_weights(spark, sf):
    """Rows drawn and weights given by each of four bootstraps, by class."""
    rows = training.bootstrap_weights(_label_rows(spark, sf), 4)
    weights = [F.struct(F.lit(i).alias("draw"), F.col(f"weight_{i}").alias("weight")) for i in range(4)]
    long = rows.select("label", F.inline(F.array(*weights)))
    return long.groupBy("draw", "label").agg(
        F.count_if(F.col("weight") > 0).alias("n_rows"),
        F.round(F.min(F.when(F.col("weight") > 0, F.col("weight"))), DIGITS).alias("class_weight"),
        F.round(F.sum("weight"), DIGITS).alias("total"),
    )


def rf_scores(spark, sf):
    model = _model(spark, sf, "forest")
    return training.score(model, _reduced_parts(spark, sf).test, "RandomForest")


def gbt_scores(spark, sf):
    model = _model(spark, sf, "boosted")
    return training.score(model, _reduced_parts(spark, sf).test, "GradientBoosting")


def feature_importance(spark, sf):
    names = _reduced_parts(spark, sf).names
    return importance.feature_importance(spark, _model(spark, sf, "forest"), names)


def gain_importance(spark, sf):
    names = _reduced_parts(spark, sf).names
    return importance.feature_importance(spark, _model(spark, sf, "boosted"), names)


def importance_sums(spark, sf):
    """Forests list every feature once, with shares that add up to 1; boosted trees those used
    once, with mean gains.  Summed up, both node tables say what the models say themselves."""
    names = _reduced_parts(spark, sf).names
    tables = []
    for kind, name in (("forest", "RandomForest"), ("boosted", "GradientBoosting")):
        model = _model(spark, sf, kind)
        own = [(i, x) for i, x in enumerate(importance.model_shares(model))]
        own = spark.createDataFrame(own, "feature int, own double")
        found = importance.shares(importance.tree_nodes(spark, model), by_tree=kind == "forest")
        apart = F.abs(F.coalesce("importance", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)))
        same = own.join(found, "feature", "full").agg((F.max(apart) < 1e-9).alias("as_model"))
        listed = importance.feature_importance(spark, model, names)
        value = listed.columns[1]
        checks = listed.agg(
            F.lit(name).alias("model"),
            (F.min(value) > 0).alias("used_only"),
            (F.count(F.lit(1)) == F.count_distinct("feature")).alias("each_once"),
        )
        total = found.agg(F.round(F.sum("importance"), 6).alias("total"))
        tables.append(checks.join(total).join(same))
    return tables[0].unionByName(tables[1])


def model_report(spark, sf):
    parts = _reduced_parts(spark, sf)
    logistic = training.fit_logistic(_train_rows(spark, sf))
    models = jobs.Models(
        logistic, _model(spark, sf, "forest"), _model(spark, sf, "boosted"), parts.components, parts.names
    )
    return jobs.metrics_table(stage(models.score(parts.test), "scores"))


def _score_checks(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("job_id").alias("n_ids"),
        F.sum("label").cast("long").alias("positives"),
        F.count_if(F.col("score").between(0, 1)).alias("in_range"),
    )


def score_rows(spark, sf):
    """Each model scores each test row once, with a probability: the plain and the calibrated
    logistic, the forest and the boosted trees."""
    parts = _reduced_parts(spark, sf)
    logistic = training.fit_logistic(_train_rows(spark, sf))
    scores = training.score(logistic, parts.test, "LogisticRegression")
    for table in (
        training.score_calibrated(_model(spark, sf, "calibrated"), parts.test, "Calibrated"),
        training.score(_model(spark, sf, "forest"), parts.test, "RandomForest"),
        training.score(_model(spark, sf, "boosted"), parts.test, "GradientBoosting"),
    ):
        scores = scores.unionByName(table)
    return _score_checks(scores)


def cross_fitted_rows(spark, sf):
    """Each row of the fit is scored once, by a model of the other folds."""
    rows = _train_rows(spark, sf)
    return _score_checks(
        training.cross_fitted_scores(rows, training.fit_logistic, "LogisticRegression")
    )


def reloaded_models(spark, sf):
    """Models that were saved and loaded, components and sigmoids included, score new feature rows
    as they did before."""
    parts = _reduced_parts(spark, sf)
    features = _feature_table(spark, sf)
    live = jobs.Models(
        _model(spark, sf, "calibrated"), _model(spark, sf, "forest"), _model(spark, sf, "boosted"),
        parts.components, parts.names,
    )
    path = scratch_path(spark, "models")
    live.save(spark, path)
    before = live.score_features(features)
    after = jobs.Models.load(spark, path).score_features(features)
    pairs = before.join(after.withColumnRenamed("score", "again"), ["job_id", "model"], "full")
    same = F.abs(F.col("score") - F.col("again")) < 1e-9
    return pairs.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_same")
    )


# --- evaluation, on a score without a model -------------------------------------


def index_scores(spark, sf) -> DataFrame:
    """Two deterministic scores of each posting against the tuned label."""
    rows = _features(spark, sf, labelled(spark, sf))
    index = F.round(F.col("fraud_trigger_index_raw"), 4)
    crowd = F.round(1 / (F.col("competition_index") + 1), 4)
    return stage(
        rows.select(
            "job_id",
            F.col("fake_label_tuned").alias("label"),
            F.inline(
                F.array(
                    F.struct(F.lit("TriggerIndex").alias("model"), index.alias("score")),
                    F.struct(F.lit("Competition").alias("model"), crowd.alias("score")),
                )
            ).alias("model", "score"),
        ),
        "scores",
    )


def classification_metrics(spark, sf):
    guess = (F.col("score") >= 0.15).cast("int")
    scored = index_scores(spark, sf).withColumn("prediction", guess)
    table = evaluation.classification_metrics(scored, by=("model",))
    return table.select(
        "model", "tp", "fp", "fn", "tn", *_rounded("accuracy", "precision", "recall", "f1")
    )


def roc_auc(spark, sf):
    curve = evaluation.threshold_curve(index_scores(spark, sf))
    return evaluation.roc_auc(curve).select("model", *_rounded("roc_auc"))


def pr_curve(spark, sf):
    curve = evaluation.threshold_curve(index_scores(spark, sf))
    return evaluation.pr_curve(curve).select(
        "model", "threshold", *_rounded("precision", "recall")
    )


def best_threshold(spark, sf):
    curve = evaluation.threshold_curve(index_scores(spark, sf))
    return evaluation.best_threshold(curve).select("model", "threshold", *_rounded("f1"))


def threshold_report(spark, sf):
    table = evaluation.threshold_report(index_scores(spark, sf))
    return table.select(
        *_rounded("accuracy", "precision", "recall", "f1", "roc_auc"), "model", "threshold"
    )


def threshold_report_validation(spark, sf):
    """Thresholds tuned on the training part, metrics on the test part."""
    split = training.stratified_split(_label_rows(spark, sf)).select("job_id", "split")
    scored = stage(index_scores(spark, sf).join(split, "job_id"), "split-scores")
    table = evaluation.threshold_report(
        scored.where("split = 'test'"), tune_on=scored.where("split = 'train'")
    )
    return table.select(
        *_rounded("accuracy", "precision", "recall", "f1", "roc_auc"), "model", "threshold"
    )


def index_stats(spark, sf):
    return evaluation.index_stats(_indexed(spark, sf))


def top_value_counts(spark, sf):
    rows = features.add_india_signals(features.add_clean_text(postings(spark, sf)))
    return evaluation.top_value_counts(rows)


QUERIES = {
    "input_profile": input_profile,
    "description_samples": description_samples,
    "null_tokens": null_tokens,
    "scan_csv": scan_csv,
    "absent_columns": absent_columns,
    "surrogate_key": surrogate_key,
    "file_order_keys": file_order_keys,
    "default_label": default_label,
    "dedup_postings": dedup_postings,
    "dedup_counts": dedup_counts,
    "label_job_keyless": label_job_keyless,
    "label_job_text_ids": label_job_text_ids,
    "salary_bounds_label": salary_bounds_label,
    "experience_years": experience_years,
    "word_count_whitespace": word_count_whitespace,
    "company_size_bucket": company_size_bucket,
    "email_domain": email_domain,
    "applicants_number": applicants_number,
    "rule_flags": rule_flags,
    "rule_trace": rule_trace,
    "rule_trigger_counts": rule_trigger_counts,
    "label_summary": label_summary,
    "tuned_label": tuned_label,
    "label_distribution": label_distribution,
    "labelled_compact": labelled_compact,
    "tuned_compact": tuned_compact,
    "date_features": date_features,
    "date_features_v1": date_features_v1,
    "salary_features": salary_features,
    "experience_features": experience_features,
    "skill_features": skill_features,
    "clean_text": clean_text,
    "keyword_flags_v1": keyword_flags_v1,
    "keyword_flags_v2": keyword_flags_v2,
    "india_signals": india_signals,
    "fraud_trigger_index": fraud_trigger_index,
    "location_features": location_features,
    "company_features": company_features,
    "portal_features": portal_features,
    "composite_features": composite_features,
    "category_encode": category_encode,
    "category_encode_v1": category_encode_v1,
    "standardize": standardize,
    "meta_features": meta_features,
    "reloaded_features": reloaded_features,
    "feature_groups": feature_groups,
    "feature_group_select": feature_group_select,
    "tokens_ngrams": tokens_ngrams,
    "tokens_ngrams_v1": tokens_ngrams_v1,
    "vocabulary": vocabulary_terms,
    "tfidf": tfidf,
    "svd_features": svd_features,
    "svd_energy": svd_energy,
    "svd_certificate": svd_certificate,
    "assembled_features": assembled_features,
    "stratified_split": stratified_split,
    "class_weights": class_weights,
    "calibration_sample": calibration_sample,
    "calibration_folds": calibration_folds,
    "lr_scores": lr_scores,
    "lr_balance": lr_balance,
    "lr_stationarity": lr_stationarity,
    "calibrated_scores": calibrated_scores,
    "calibration_balance": calibration_balance,
    "bootstrap_weights": bootstrap_weights,
    "rf_scores": rf_scores,
    "gbt_scores": gbt_scores,
    "feature_importance": feature_importance,
    "gain_importance": gain_importance,
    "importance_sums": importance_sums,
    "model_report": model_report,
    "score_rows": score_rows,
    "cross_fitted_rows": cross_fitted_rows,
    "reloaded_models": reloaded_models,
    "classification_metrics": classification_metrics,
    "roc_auc": roc_auc,
    "pr_curve": pr_curve,
    "best_threshold": best_threshold,
    "threshold_report": threshold_report,
    "threshold_report_validation": threshold_report_validation,
    "index_stats": index_stats,
    "top_value_counts": top_value_counts,
}
