"""Hyperdimensional profiles: the blocks against plain sums, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adsift.llm import language_id, queries
from conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def plain_vector(encoder, text):
    letters = language_id.letters_of(text)
    letters = np.pad(letters, (0, max(0, 3 - len(letters))))
    total = np.zeros(encoder.dimensions)
    for i in range(len(letters) - 2):
        a, b, c = (encoder.letter(int(x)).astype(int) for x in letters[i : i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


TEXTS = ["a", "A b", "Hello, World! 42 hello", "éÉ ß ñandú", "日本語 テキスト", "x" * 500, "the of and " * 90, "½ ª word"]


def test_blocks_give_the_plain_sums(monkeypatch):
    encoder = language_id.Encoder(dimensions=128)
    monkeypatch.setattr(language_id, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 200)
    seen = {}
    for places, vectors in encoder.vectors([*TEXTS, None, "", "123 !?"]):
        seen.update(zip(places, vectors))
    assert sorted(seen) == list(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert np.array_equal(seen[i], plain_vector(encoder, text))


def test_letters_between_blanks():
    assert language_id.letters_of("Ab1-2c").tolist() == [0, ord("a"), ord("b"), 0, ord("c"), 0]
    assert not len(language_id.letters_of("12 . ")) and not len(language_id.letters_of(""))


def test_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, SMALL.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_the_fit_on_a_sample(spark):
    rows = [(i, "le la les des une " * 5, "fr", "s", "x") for i in range(40)]
    rows += [(100 + i, "the of and with that " * 5, "en", "s", "x") for i in range(3)]
    rows += [(200, None, "en", None, None), (201, "", "fr", None, None), (202, "12 34!", None, "s", None),
             (None, "the of and that", None, None, None), (7, "le la les", None, None, None), (7, "le la les", None, None, None),
             (203, "the of and " * 40000, None, None, None), (204, "x", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    chosen = language_id.training_rows(docs, F.lit(True), per_language=10)
    assert 0 < chosen.where("lang = 'fr'").count() < 40 and chosen.where("lang = 'en'").count() == 3
    names, prototypes = language_id.fit_prototypes(chosen)
    again = language_id.fit_prototypes(chosen.repartition(5))
    assert names == ["en", "fr"] and np.array_equal(prototypes, again[1])
    found = language_id.identify(docs, names, prototypes).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert {by_id[i]["lang_pred"] for i in (200, 201, 202)} == {"und"} and by_id[200]["score"] == 0
    assert by_id[None]["lang_pred"] == by_id[203]["lang_pred"] == "en"
    assert [r["lang_pred"] for r in found if r["doc_id"] == 7] == ["fr"] * 3


@pytest.mark.parametrize("rows", [[], [(1, "text without label", None, None, None)]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    names, prototypes = language_id.fit_prototypes(language_id.training_rows(docs, F.lit(True)))
    assert names == [] and [r["lang_pred"] for r in language_id.identify(docs, names, prototypes).collect()] == ["und"] * len(rows)
