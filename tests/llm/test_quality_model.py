"""Co-training: views, held-out quality, and what it does without data."""

import random

import pytest
from pyspark.sql import functions as F

from adsift.llm import quality_model
from conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, p int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = ["".join(rng.choice("aeioustn") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [w[0]] * 40
        text = " ".join(w)
        rows.append((i, text, rng.choice(["en", "de", None]), f"s{int(bad) * 3 + i % 3}", len(text), "x", 1))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], LABELS)
    bad = [x for x in labels if x[0] % 8 == 0][:25] + [x for x in labels if x[0] % 8 == 4][:25]
    known = known.union(spark.createDataFrame(bad, LABELS))
    seen = {x[0] for x in labels if x[0] % 2} | {x[0] for x in bad}
    scored = quality_model.score_documents(docs, known)
    found = {r["doc_id"]: r["kept"] for r in scored.collect()}
    truth = {i: bool(q) for i, q, _ in labels if i not in seen}
    assert sum(found[i] == q for i, q in truth.items()) >= 0.97 * len(truth)
    kept = quality_model.good_documents(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k in found.items() if k)


def test_supplied_labels(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = quality_model.score_documents(docs, labels.where(~test))
    rows = scored.join(labels.where(test).withColumnRenamed("quality", "truth"), "doc_id").collect()
    assert sum(r["kept"] == bool(r["truth"]) for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("quality,kept", [([], True), ([1, 1], True), ([0, 0, None], False)])
def test_no_labels_or_one_class(spark, quality, kept):
    rows = corpus(12)[0] + [(None, None, None, None, None, None, None), (3, "", "", "", 0, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], LABELS)
    found = quality_model.score_documents(docs, labels).collect()
    assert len(found) == len(rows) and {r["kept"] for r in found} == {kept}


def test_odd_rows(spark):
    rows, labels = corpus(80)
    rows += [(None, None, None, None, None, None, None)] * 2 + [(1, "twice", "en", "s", -5, "x", 1)] * 2
    rows += [(500, "long " * 30000, "en", "s", 150000, "x", 1), (501, "\n\n", None, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    more = labels + [(2, 0, 0), (2, 1, 1), (None, 0, 0), (4, None, 1), (999, 0, 0)]
    found = quality_model.score_documents(docs, spark.createDataFrame(more, LABELS)).collect()
    assert len(found) == len(rows)
    assert all(0 <= r[c] <= 1 for r in found for c in ("text_score", "meta_score", "quality"))
    votes = {r["doc_id"]: r["label"] for r in quality_model.quality_labels(spark.createDataFrame(more, LABELS)).collect()}
    assert votes[2] == 1 and votes[4] == 0 and None not in votes and len(votes) == 81


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    assert quality_model.score_documents(empty, labels).collect() == []


def test_the_sample_is_bounded(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert 400 < quality_model._drawn(rows, 500).count() < 600
    assert quality_model._drawn(rows, 5000).count() == 5000


def test_the_pool_is_drawn_from_unlabelled_rows(spark, monkeypatch):
    class Staged(Exception):
        pass

    def watched(df, name):
        if name == "quality-pool":
            raise Staged([r["doc_id"] for r in df.collect()])
        return df

    monkeypatch.setattr(quality_model, "stage", watched)
    view = F.array(F.lit(1.0)).alias
    views = spark.range(5000).select(F.col("id").alias("doc_id"), view(quality_model.TEXT), view(quality_model.META))
    labels = spark.range(3500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    with pytest.raises(Staged) as found:
        quality_model.fit(views, labels, pool_rows=500)
    ids = found.value.args[0]
    assert 400 < len(ids) < 600 and min(ids) >= 3500
