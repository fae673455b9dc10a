import os

import pytest
from pyspark.sql import functions as F

from adsift.operators import labeling, training
from adsift.plans import jobs
from adsift.sources.fixture import job_postings
from conftest import SMALL


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("labels"))
    return jobs.write_label_outputs(jobs.label_job(job_postings(spark, SMALL)), out)


@pytest.fixture(scope="module")
def built(spark, labelled, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("features"))
    features, state = jobs.feature_job(
        labeling.use_tuned_label(labelled["labelled"]), max_features=200
    )
    return jobs.write_feature_outputs(features, state, out), state, out


def test_label_outputs(labelled):
    assert labelled["labelled"].count() == 200
    assert "fake_label" in labelled["clean"].columns and len(labelled["clean"].columns) == 13
    assert len(labelled["clean_tuned"].columns) == 14
    assert labelled["rule_counts"].count() == 9


def test_label_job_drops_copies(spark):
    rows = job_postings(spark, SMALL)
    assert jobs.label_job(rows.unionByName(rows)).count() == 200


def test_label_job_drops_copies_before_it_makes_keys(spark):
    rows = job_postings(spark, SMALL).drop("job_id")
    some = rows.where(F.length("job_title") > 11)
    found = jobs.label_job(rows.unionByName(some).unionByName(some))
    ids = [r["job_id"] for r in found.collect()]
    assert sorted(ids) == list(range(1, rows.distinct().count() + 1))


def test_label_job_keeps_text_keys_and_refuses_bad_ones(spark):
    rows = job_postings(spark, SMALL).withColumn("job_id", F.concat(F.lit("JOB-"), "job_id"))
    found = jobs.label_job(rows)
    assert found.where(F.col("job_id").startswith("JOB-")).count() == 200
    split = training.stratified_split(found.withColumn("label", F.col("fake_label")))
    assert split.where("split = 'test'").count() == 40
    for bad in (F.lit(None).cast("string"), F.lit("same")):
        with pytest.raises(ValueError):
            jobs.label_job(rows.withColumn("job_id", bad))


def test_feature_outputs(spark, built):
    tables, state, out = built
    meta = tables["meta"]
    assert meta.count() == 200
    assert [c for c in meta.columns if c.endswith("_enc")] == [
        "job_type_enc", "remote_onsite_enc", "company_size_enc", "location_category_enc",
        "company_tier_enc", "portal_category_enc",
    ]
    norms = tables["tfidf"].groupBy("job_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    low, high = norms.agg(F.min("n"), F.max("n")).first()
    assert low == pytest.approx(1) and high == pytest.approx(1)
    loaded = jobs.FeatureState.load(spark, f"{out}/state")
    assert loaded.text.terms == state.text.terms and loaded.text.idf == state.text.idf
    assert loaded.moments == state.moments and loaded.index_max == state.index_max


def test_loaded_state_scores_new_rows_alike(spark, labelled, built):
    tables, _, out = built
    state = jobs.FeatureState.load(spark, f"{out}/state")
    assert state.formats["posted_date"][0][1] == "yyyy-MM-dd" and state.text.ngram == 2
    again = jobs.features_of(labeling.use_tuned_label(labelled["labelled"]), state)
    a, b = tables["meta"], again.drop("tfidf")
    assert a.exceptAll(b.select(a.columns)).count() == 0


def test_first_version(labelled):
    features, _ = jobs.feature_job(
        labeling.use_tuned_label(labelled["labelled"]), version=1, max_features=100
    )
    assert "salary_category_enc" in features.columns
    assert "fraud_trigger_index" not in features.columns
    assert features.count() == 200


@pytest.mark.parametrize(
    "options", [{}, {"svd_dim": 5, "calibrate": True}, {"tune_on": "validation"}]
)
def test_training_job(spark, built, tmp_path, options):
    tables, _, _ = built
    table = jobs.training_job(
        tables["features"], str(tmp_path), trees=4, max_depth=3, rounds=2, max_iter=10, **options
    )
    rows = {r["model"]: r for r in table.collect()}
    assert set(rows) == {
        m + t for m in ("LogisticRegression", "RandomForest", "GradientBoosting")
        for t in ("", "_Tuned")
    }
    for name, r in rows.items():
        assert all(0 <= r[c] <= 1 for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))
        if name.endswith("_Tuned") and "tune_on" not in options:
            assert r["f1"] >= rows[name[:-6]]["f1"] - 1e-9
    assert os.path.isdir(f"{tmp_path}/importance/RandomForest")


@pytest.mark.parametrize("options", [{}, {"svd_dim": 5}])
def test_reloaded_models_score_new_rows_alike(spark, labelled, built, tmp_path, options):
    tables, state, out = built
    parts = jobs.training_parts(tables["features"], **options)
    models = jobs.fit_models(
        parts, calibrate=True, trees=3, max_depth=3, rounds=2, max_iter=10, calibration_share=0.5
    )
    models.save(spark, str(tmp_path))
    loaded = jobs.Models.load(spark, str(tmp_path))
    new = jobs.features_of(
        labeling.use_tuned_label(labelled["labelled"]).where("job_id % 3 = 0"),
        jobs.FeatureState.load(spark, f"{out}/state"),
    )
    old = tables["features"].where("job_id % 3 = 0")
    live = {(r["model"], r["job_id"]): r["score"] for r in models.score_features(old).collect()}
    again = {(r["model"], r["job_id"]): r["score"] for r in loaded.score_features(new).collect()}
    assert len(live) == 3 * old.count() and live == pytest.approx(again)


def test_a_job_leaves_nothing_staged_and_takes_its_options(spark, built, tmp_path, monkeypatch):
    from adsift.sources import storage

    monkeypatch.setattr(storage, "scratch_dir", lambda spark: str(tmp_path / "scratch"))
    jobs.training_job(
        built[0]["features"], str(tmp_path / "out"), test_size=0.5, seed=7, fit_rows=60,
        calibrate=True, calibration_share=0.9, trees=2, max_depth=2, rounds=1, max_iter=5,
    )
    assert not os.listdir(tmp_path / "scratch" / "adsift")


def test_a_broken_state_is_refused(spark, tmp_path):
    from adsift.sources import storage

    path = str(tmp_path / "state")

    def save(value):
        with storage.saved_state(spark, path) as folder:
            storage.write_table(spark.range(value), f"{folder}/numbers")
        return folder

    first = save(3)
    assert storage.committed_state(spark, path) == first
    # A save that breaks off leaves the state before.
    with pytest.raises(RuntimeError), storage.saved_state(spark, path) as folder:
        storage.write_table(spark.range(9), f"{folder}/numbers")
        raise RuntimeError
    assert storage.committed_state(spark, path) == first
    second = save(4)
    assert storage.committed_state(spark, path) == second != first
    part = next(f for f in os.listdir(f"{second}/numbers") if f.endswith(".parquet"))
    with open(f"{second}/numbers/{part}", "ab") as f:
        f.write(b"x")
    os.remove(f"{second}/numbers/.{part}.crc")
    with pytest.raises(ValueError, match="not whole"):
        storage.committed_state(spark, path)
    other = spark.createDataFrame([("a", 1, "b", 99, "c")], storage._MANIFEST)
    storage.write_table(other, f"{path}/manifest")
    with pytest.raises(ValueError, match="version"):
        storage.committed_state(spark, path)
