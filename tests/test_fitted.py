import random

import pytest
from pyspark.sql import functions as F

from adsift.operators import fitted
from adsift.operators.ordered import hash_cuts, running_totals, upto_cut
from conftest import column


def test_scaler(spark):
    rows = [(0, 1.0, 5), (1, 2.0, 5), (2, 4.0, 5), (3, None, 5)]
    df = spark.createDataFrame(rows, "job_id long, min_salary double, total_skills int")
    three = df.where("job_id < 3")
    got = fitted.apply_scaler(three, fitted.fit_scaler(three))
    assert column(got, "min_salary_scaled") == pytest.approx([-1.0690, -0.2673, 1.3363], abs=1e-4)
    assert column(got, "total_skills_scaled") == [0, 0, 0]
    assert fitted.fit_scaler(df)["min_salary"][0] == 1.75


def test_index(spark):
    df = spark.createDataFrame(
        [(0, 0.3), (1, 0.9), (2, 0.0)], "job_id long, fraud_trigger_index_raw double"
    )
    got = fitted.apply_index(df, fitted.fit_index_max(df))
    assert column(got, "fraud_trigger_index") == [0.3333, 1.0, 0.0]
    assert fitted.fit_index_max(df.where("job_id = 2")) == 1.0


@pytest.mark.parametrize("limit", [10_000, 3])
def test_category_codes_small_and_large_dictionary(spark, monkeypatch, limit):
    monkeypatch.setattr(fitted, "SMALL_DICTIONARY_ROWS", limit)
    draw = random.Random(1)
    values = [None, "b", "B", "é", "Zeta", "zeta", "", "10", "9"]
    # One value holds a third of the rows and more.
    rows = [(i, draw.choice(values) if i % 3 else "b", draw.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(rows, "job_id long, job_type string, company_size string")
    codes = fitted.fit_category_codes(df)
    got = fitted.apply_category_codes(df, codes)
    known = sorted({"Unknown" if v is None else v for _, v, _ in rows})
    expected = [known.index("Unknown" if v is None else v) for _, v, _ in rows]
    assert column(got, "job_type_enc") == expected
    assert column(got, "company_size_enc") == ["xy".index(s) for _, _, s in rows]
    assert got.count() == 300


def test_code_order(spark):
    df = spark.createDataFrame([(0, None), (1, "b"), (2, "B")], "job_id long, job_type string")
    got = fitted.apply_category_codes(df, fitted.fit_category_codes(df))
    assert column(got, "job_type_enc") == [1, 2, 0]


def test_running_totals(spark):
    draw = random.Random(5)
    rows = [(g, s, draw.randint(0, 4)) for g in "ab" for s in draw.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, s int, n int").repartition(7)
    got = running_totals(df, [F.desc("s")], {"t": "n"}, ("g",)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["t"] == sum(n for g, s, n in rows if g == r["g"] and s >= r["s"])


def test_hash_cuts_take_exact_numbers(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    cuts = hash_cuts(df, "id", 42, {0: [1, 100, 667], 1: [50]}, "label")
    for (stratum, rank), cut in cuts.items():
        taken = df.where((F.col("label") == stratum) & upto_cut("id", 42, cut))
        if stratum == 0 and rank == 667:
            raise AssertionError("only 666 rows there")
        assert taken.count() == rank
    assert set(cuts) == {(0, 1), (0, 100), (1, 50)}


def test_outputs(spark):
    df = spark.createDataFrame(
        [(1, 0, 2.0, 1, 0.5, 3, 1)],
        "job_id long, fake_label int, min_salary double, has_fee int,"
        " min_salary_scaled double, job_type_enc int, desc_wordcount int",
    )
    assert fitted.meta_features(df).columns == [
        "job_id", "fake_label", "desc_wordcount", "min_salary_scaled", "job_type_enc",
    ]
    assert fitted.select_group(df, "skills").columns == ["job_id", "has_fee"]
    assert ("skills", "has_fee") in [tuple(r) for r in fitted.feature_groups(df).collect()]
    counts = {tuple(r)[:2]: r["n_values"] for r in fitted.feature_group_counts(df).collect()}
    assert counts[("skills", "has_fee")] == 1 and counts[("meta", "education_level")] == 0
