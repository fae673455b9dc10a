import collections
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from adsift.functions import text
from adsift.operators import reduction, vocabulary


def tokens_of(value):
    parts = unicodedata.normalize("NFKD", value.lower())
    bare = "".join(c for c in parts if not unicodedata.combining(c))
    return [w for w in re.findall(r"\w+", bare) if len(w) >= 2]


def test_words_strip_accents(spark):
    texts = [
        "Café déjà vu", "ﬁne ½ cup", "ßtraße øre", "한국 ab", "ａｂｃ x", "A ab, c1 d_e", "", "a b",
        "が ガイド", "x² m³ ab²",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id long, t string")
    rows = vocabulary.with_words(df, "t", cleaned=False).orderBy("job_id").collect()
    assert [r["words"] for r in rows] == [tokens_of(t) for t in texts]
    clean = text.add_clean_text(df, "t", "c").drop("t").withColumnRenamed("c", "t")
    rows = vocabulary.with_words(clean, "t").orderBy("job_id").collect()
    assert [r["words"] for r in rows] == [tokens_of(r["t"]) for r in rows]
    kept = vocabulary.with_words(df, "t", accents=True).orderBy("job_id").first()
    assert kept["words"] == ["café", "déjà", "vu"]


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(text.bigrams(F.col("w"))).collect()]
    assert got == [["a b", "b c"], [], []]


def brute_vocabulary(docs, min_df, limit, ngram):
    tf, df = collections.Counter(), collections.Counter()
    for words in docs:
        terms = list(words)
        if ngram > 1:
            terms += [f"{a} {b}" for a, b in zip(words, words[1:])]
        tf.update(terms)
        df.update(set(terms))
    able = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:limit]
    return [(t, i, df[t], tf[t]) for i, t in enumerate(sorted(able))]


@pytest.fixture(scope="module")
def documents():
    draw = random.Random(3)
    names = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    docs = [draw.choices(names, weights, k=draw.randint(0, 25)) for _ in range(80)]
    # A third of the documents are equal copies.
    return docs + [["same", "same", "copy"]] * 40


@pytest.mark.parametrize(
    "min_df,limit,ngram,bits",
    [(3, 5000, 2, 1 << 20), (3, 12, 2, 1 << 20), (1, 40, 2, 64), (2, 40, 2, 128), (3, 10, 1, 64)],
)
def test_vocabulary_equals_full_counting(
    spark, documents, monkeypatch, min_df, limit, ngram, bits
):
    # However full the bitmap of able words is, the result is the same.
    whole = vocabulary.bitmap_of, vocabulary.bit_of
    monkeypatch.setattr(vocabulary, "bitmap_of", lambda words: whole[0](words, bits))
    monkeypatch.setattr(vocabulary, "bit_of", lambda word: whole[1](word, bits))
    df = spark.createDataFrame(list(enumerate(documents)), "job_id long, words array<string>")
    got = vocabulary.fit_vocabulary(df, min_df=min_df, max_features=limit, ngram=ngram)
    rows = [tuple(r) for r in got.orderBy("term_id").collect()]
    assert rows == brute_vocabulary(documents, min_df, limit, ngram)


def test_tfidf(spark, documents):
    df = spark.createDataFrame(list(enumerate(documents)), "job_id long, words array<string>")
    model = vocabulary.TextModel.fit(df)
    entries = vocabulary.vector_entries(model.transform(df)).collect()
    got = collections.defaultdict(dict)
    for r in entries:
        got[r["job_id"]][r["term_id"]] = r["weight"]
    terms = brute_vocabulary(documents, 3, 5000, 2)
    n = len(documents)
    for i, words in enumerate(documents):
        counts = collections.Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        raw = {
            k: counts[t] * (math.log((1 + n) / (1 + d)) + 1) for t, k, d, _ in terms if counts[t]
        }
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert got[i] == pytest.approx({k: w / norm for k, w in raw.items()})


def test_idf_of_a_known_case(spark):
    vocab = spark.createDataFrame([("ab", 0, 2, 2)], "term string, term_id int, df long, tf long")
    assert vocabulary.TextModel.from_vocabulary(vocab, 3).idf == pytest.approx([1.287682])


def test_no_terms_at_all(spark):
    df = spark.createDataFrame([(1, []), (2, ["aa"])], "job_id long, words array<string>")
    model = vocabulary.TextModel.fit(df)
    assert model.terms == []
    assert vocabulary.vector_entries(model.transform(df)).count() == 0


def test_tfidf_plan_has_no_shuffle(spark, documents):
    df = spark.createDataFrame(list(enumerate(documents)), "job_id long, words array<string>")
    plan = vocabulary.TextModel.fit(df).transform(df)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_terms_of_each_text(spark, documents):
    df = spark.createDataFrame(list(enumerate(documents)), "job_id long, words array<string>")
    got = {(r["job_id"], r["term"]): r["n"] for r in vocabulary.terms_of_documents(df).collect()}
    wanted = {}
    for i, words in enumerate(documents):
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        wanted |= {(i, t): n for t, n in collections.Counter(terms).items()}
    assert got == wanted


def test_only_odd_texts_go_to_python(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "½ cup")], "job_id long, t string")
    plan = vocabulary.with_words(df, "t", cleaned=False)._jdf.queryExecution().executedPlan().toString()
    plain, odd = plan.split("ArrowEvalPython")
    assert "Filter" in odd and "RLIKE" in odd


def test_filters_do_not_make_texts_anew(spark):
    """The filters read cleaned texts and arrays of terms as columns, and change no result."""
    texts = ["Ab cd, ab! x@y.z http://a.b", "½ cup ﬁne ab", "한국 ab", "", None, "a . b", "Café ½@x.y vu"]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id long, job_description string")
    rows = text.add_clean_text(df, "job_description", "desc_clean")
    terms = vocabulary.terms_of_documents(vocabulary.with_words(rows, raw="job_description"))
    plan = terms._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Filter" in line:
            assert "regexp_replace" not in line and "sort_array" not in line, line
    wanted = {}
    for row in rows.collect():
        words = tokens_of(row["desc_clean"])
        both = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        wanted |= {(row["job_id"], t): n for t, n in collections.Counter(both).items()}
    assert {(r["job_id"], r["term"]): r["n"] for r in terms.collect()} == wanted
    assert any(job == 6 for job, _ in wanted)


def test_svd_parts_do_not_grow_with_the_splits(spark, documents, monkeypatch):
    seen = []
    plain = type(spark.range(1)).mapInPandas

    def counted(df, func, schema):
        seen.append(df.rdd.getNumPartitions())
        return plain(df, func, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", counted)
    df = spark.createDataFrame(list(enumerate(documents)), "job_id long, words array<string>")
    vectors = vocabulary.TextModel.fit(df, max_features=10).transform(df).select("job_id", "tfidf")
    for splits in (3, 60):
        reduction.fit_svd(vectors.repartition(splits), 10, 3, iterations=1)
    most = reduction.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    assert set(seen) == {3, most} and most < 60


def test_components_are_kept(spark, tmp_path):
    matrix = np.arange(12.0).reshape(4, 3)
    reduction.save_components(spark, matrix, str(tmp_path / "c"))
    assert np.array_equal(reduction.load_components(spark, str(tmp_path / "c")), matrix)


def test_svd_matches_numpy(spark, documents, monkeypatch):
    df = spark.createDataFrame(list(enumerate(documents)), "job_id long, words array<string>")
    model = vocabulary.TextModel.fit(df, max_features=40)
    vectors = model.transform(df).select("job_id", "tfidf")
    rows = vectors.orderBy("job_id").collect()
    matrix = np.array([r["tfidf"].toArray() for r in rows])
    monkeypatch.setattr(reduction, "CHUNK_CELLS", 300)
    components = reduction.fit_svd(vectors, len(model.terms), 4, iterations=25)
    truth = np.linalg.svd(matrix, full_matrices=False)[2][:4].T
    assert np.abs((components * truth).sum(axis=0)) == pytest.approx(np.ones(4), abs=1e-6)
    projected = reduction.apply_svd(vectors, components).orderBy("job_id").collect()
    assert np.array([r["svd"] for r in projected]) == pytest.approx(matrix @ components, abs=1e-9)
    assert reduction.clamp_rank(300, 40) == 39 and reduction.clamp_rank(5, 1) == 5 - 4


def _vectors(spark, rows, parts):
    made = [(i, Vectors.sparse(6, v)) for i, v in enumerate(rows)]
    return spark.createDataFrame(made, ["job_id", "tfidf"]).repartition(parts)


def test_svd_with_empty_splits_and_empty_rows(spark):
    rows = [{0: 1.0, 1: 2.0}, {2: 1.0}, {}]
    for df in (_vectors(spark, rows, 12), _vectors(spark, rows, 1)):
        found = reduction.fit_svd(df, 6, rank=2)
        assert found.shape == (6, 2)
        assert np.abs(found.T @ found - np.eye(2)).max() < 1e-9
    nothing = reduction.fit_svd(_vectors(spark, [{}, {}], 4), 6, rank=2)
    assert nothing.shape == (6, 2)


def test_certificate_finds_wrong_components(spark):
    draw = np.random.default_rng(4)
    rows = [{j: float(x) for j, x in enumerate(draw.random(6))} for _ in range(30)]
    df = _vectors(spark, rows, 3)
    dense = np.array([[r.get(j, 0.0) for j in range(6)] for r in rows])
    right = reduction.fit_svd(df, 6, rank=3, tolerance=1e-8, most_iterations=200)
    got = reduction.certify(df, right).toPandas()
    assert got["energy"].to_numpy() == pytest.approx(np.linalg.svd(dense)[1][:3] ** 2)
    assert got["residual"].max() < 1e-6 and got["overlap"].max() < 1e-9
    turned = right.copy()
    turned[:, 0] = (right[:, 0] + right[:, 1]) / 2**0.5
    wrong = reduction.certify(df, turned).toPandas()
    assert wrong["residual"][0] > 1 and wrong["overlap"][1] > 0.5


def test_svd_goes_on_until_it_is_certified(spark):
    draw = np.random.default_rng(5)
    rows = [Vectors.sparse(40, {j: float(x) for j, x in enumerate(draw.random(40))}) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), ["job_id", "tfidf"]).repartition(3)
    found = reduction.fit_svd(df, 40, rank=3, iterations=0, tolerance=1e-4, most_iterations=60)
    got = reduction.certify(df, found).toPandas()
    assert got["residual"].max() <= 1e-4 * got["energy"].max() * (1 + 1e-6)
    with pytest.raises(ValueError):
        reduction.fit_svd(df, 40, rank=3, iterations=0, tolerance=1e-12, most_iterations=1)


def test_svd_reads_the_rows_once(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [Vectors.sparse(40, {j: float(x) for j, x in enumerate(draw.random(40)) if x > 0.5}) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), ["job_id", "tfidf"]).repartition(3)
    plain, passes = type(df).mapInPandas, []
    monkeypatch.setattr(type(df), "mapInPandas", lambda *args: passes.append(1) or plain(*args))
    once = reduction.fit_svd(df, 40, rank=3, tolerance=1e-9, most_iterations=200)
    assert len(passes) == 1
    dense = np.array([r.toArray() for r in rows])
    for frequent in (512, 7):
        monkeypatch.setattr(reduction, "_DENSE_TERMS", frequent)
        assert reduction._gram_matrix(df, "tfidf", 40) == pytest.approx(dense.T @ dense)
    # With more terms than a matrix is made for, each iteration is a pass, with the same result.
    monkeypatch.setattr(reduction, "GRAM_TERMS", 39)
    passes.clear()
    assert reduction.fit_svd(df, 40, rank=3, tolerance=1e-9, most_iterations=200) == pytest.approx(once, abs=1e-9)
    assert len(passes) > 5
