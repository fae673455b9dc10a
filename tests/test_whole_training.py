"""The model queries fit on the whole training part, here 400 made rows."""

import pytest
from pyspark.ml.linalg import Vectors

from adsift.operators import training
from adsift.plans import jobs, queries

N = 400


@pytest.fixture
def made(spark, monkeypatch):
    rows = []
    for i in range(N + 50):
        label = float(i % 3 != 0)
        x = (i * 37 % 100) / 100 + label * 0.8
        rows.append((i, label, Vectors.dense([x, (i * 17 % 50) / 50])))
    df = spark.createDataFrame(rows, ["job_id", "label", "features"])
    parts = jobs.Parts(df.where(f"job_id < {N}"), df.where(f"job_id >= {N}"), ["a"])
    app = spark.sparkContext.applicationId
    monkeypatch.setattr(queries, "_shared", {(app, "made", "reduced"): parts})
    return "made"


def test_rows_of_the_logistic_certificate(spark, made, monkeypatch):
    found = []
    plain = training.logistic_gradient
    monkeypatch.setattr(
        training, "logistic_gradient", lambda model, rows: found.append(rows.count()) or plain(model, rows)
    )
    # The made parts have no components, which the count of weights asks for.
    with pytest.raises(AttributeError):
        queries.lr_stationarity(spark, made)
    assert found == [N]


def test_rows_of_the_calibration(spark, made):
    got = queries.calibration_balance(spark, made).collect()
    assert sum(r["n_rows"] for r in got) == int(N * 0.3) and all(abs(r["gap"]) < 0.01 for r in got)


def test_rows_that_are_cross_fitted(spark, made):
    (got,) = queries.cross_fitted_rows(spark, made).collect()
    assert got["n_rows"] == got["n_ids"] == got["in_range"] == N


@pytest.mark.parametrize("kind", ["calibrated", "forest", "boosted"])
def test_rows_of_the_shared_models(spark, made, monkeypatch, kind):
    found = []
    monkeypatch.setattr(training, f"fit_{kind}", lambda rows: found.append(rows.count()))
    queries._model(spark, made, kind)
    assert found == [N]
