"""Words, pairs, vocabulary and TF-IDF vectors.

The vocabulary is counted with one explode and one aggregation by term, with
partial sums in each task, so a word found in every posting is no hot key.
Weighting is row-local: each text becomes a sparse vector by lookup in the
vocabulary, whose size ``max_features`` bounds; no join, no shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.functions import text
from adsift.operators.bitmap import bit_is_set, bit_of, bitmap_of
from adsift.sources.storage import stage

# Texts whose terms a task holds at once.
_TEXTS = 64


def with_words(
    df: DataFrame,
    source: str = "desc_clean",
    accents: bool = False,
    cleaned: bool = True,
    name: str = "words",
    raw: str | None = None,
) -> DataFrame:
    """Add the array of words of a text.

    Version 2 strips accents and splits cleaned text at its blanks; version 1
    (``accents=True``) picks the words of the raw text.  Texts with a character
    that falls apart into several are worked on in a branch of their own, the
    only one that passes through Python.  ``raw`` names the column that the text was
    cleaned from: cleaning adds no such character, so that branch cleans few texts.
    """
    df = df.withColumn("_text", F.lower(F.coalesce(F.col(source), F.lit(""))))
    if accents:
        return df.withColumn(name, text.words(F.col("_text"))).drop("_text")
    split = text.words_of_clean if cleaned else text.words
    odd = text.falls_apart(F.col("_text"))
    plain = _made_once(df, "_text").where(~odd)
    plain = plain.withColumn(name, split(text.without_accents(F.col("_text"))))
    able = df.where(text.falls_apart(F.lower(raw))) if raw else df
    apart = _made_once(able, "_text").where(odd)
    apart = apart.withColumn(name, text.words(text.decomposed(F.col("_text"))))
    return plain.unionAll(apart).drop("_text")


def _made_once(df: DataFrame, name: str) -> DataFrame:
    """The rows with a column that later filters take as it is.

    A filter on a computed column moves below it and holds its expression wherever it reads
    the column; after several steps of cleaning that is dozens of times.  A filter on what a
    generator gives stays above it.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(name)).alias(name))


def terms_of(words, ngram: int = 2):
    """Array of words and, for ``ngram`` 2 or more, of adjacent pairs."""
    if min(2, ngram) < 2:
        return words
    return F.concat(words, text.bigrams(words))


def count_terms(df: DataFrame, terms) -> DataFrame:
    """``(term, tf, df)``: occurrences, and rows with the term.

    Sorting a row's terms puts equal ones side by side, so a row counts once by
    comparing neighbours; no second pass and no key per row and term.
    """
    ordered = df.select(F.sort_array(terms).alias("_terms"))
    pairs = F.arrays_zip(
        F.col("_terms").alias("term"),
        F.concat(F.array(F.lit(None).cast("string")), F.col("_terms")).alias("before"),
    )
    return (
        ordered.select(F.inline(pairs).alias("term", "before"))
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("tf"),
            F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("df"),
        )
    )


def _pair_counts(df: DataFrame, words: str, able: DataFrame) -> DataFrame:
    """Counts of the adjacent pairs of the words that a table may hold.

    The table is a bitmap in the scan: a pair of other words is mostly left out,
    and the caller's bound takes off the rest.
    """
    bitmap = bitmap_of(able)
    kept = F.transform(words, lambda w: F.when(bit_is_set(bitmap, bit_of(w)), w))
    # A column of its own, since the pairs read it twice.
    marked = df.select(kept.alias("_words"))
    return count_terms(marked, F.array_compact(text.bigrams(F.col("_words"))))


def _count_at_rank(counted: DataFrame, rank: int) -> int:
    """The ``tf`` of the term at a rank; 0 if there are fewer terms.

    The counts by binary magnitude, 64 rows at most, tell which terms can reach
    the rank, so the top-k below them sees few rows from each task.
    """
    bits = F.length(F.bin("tf"))
    sizes = counted.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()
    seen = 0
    for row in sorted(sizes, key=lambda r: -r["bits"]):
        seen += row["n"]
        if seen >= rank:
            able = counted.where(F.col("tf") >= 1 << (row["bits"] - 1))
            return able.orderBy(F.desc("tf")).limit(rank).agg(F.min("tf")).first()[0]
    return 0


def fit_vocabulary(
    df: DataFrame,
    words: str = "words",
    min_df: int = fixed.MIN_DF,
    max_features: int = fixed.MAX_FEATURES,
    ngram: int = 2,
) -> DataFrame:
    """``(term, term_id, df, tf)``: the most frequent terms, ids in term order.

    A pair occurs no more often than either of its words, in texts and overall.
    So once the words are counted, a pair can only enter the vocabulary if both
    words reach ``min_df`` and the count of the last word that would fit.  Only
    such pairs are counted, which keeps the many rare pairs out of the shuffle
    without changing the result.
    """
    min_df = max(1, min_df)
    found = stage(
        count_terms(df, F.col(words)).where(F.col("df") >= min_df), "word-counts"
    )
    floor = _count_at_rank(found, max_features)
    found = found.where(F.col("tf") >= floor)
    if min(2, ngram) == 2:
        pairs = _pair_counts(df, words, found.select("term"))
        found = found.unionByName(
            pairs.where((F.col("df") >= min_df) & (F.col("tf") >= floor))
        )
    top = found.orderBy(F.desc("tf"), "term").limit(max_features)
    # At most max_features rows reach this window.
    ids = F.row_number().over(Window.orderBy("term")) - 1
    return top.select("term", ids.cast("int").alias("term_id"), "df", "tf")


@dataclass
class TextModel:
    """Vocabulary in id order with the inverse document frequencies."""

    terms: list[str]
    idf: list[float]
    ngram: int = 2

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        words: str = "words",
        ngram: int = 2,
        documents: int | None = None,
        **limits,
    ) -> TextModel:
        """Fit on rows of words; ``documents`` is their number, if it is known."""
        vocabulary = fit_vocabulary(df, words, ngram=ngram, **limits)
        return cls.from_vocabulary(vocabulary, df.count() if documents is None else documents, ngram)

    @classmethod
    def from_vocabulary(cls, vocabulary: DataFrame, documents: int, ngram: int = 2):
        rows = vocabulary.select("term", "term_id", "df").collect()
        rows.sort(key=lambda r: r["term_id"])
        idf = [math.log((1 + documents) / (1 + r["df"])) + 1 for r in rows]
        return cls([r["term"] for r in rows], idf, ngram)

    def transform(self, df: DataFrame, words: str = "words", output: str = "tfidf") -> DataFrame:
        """Add the L2-normalised TF-IDF vector; row-local, inside the JVM."""
        # A vectoriser needs one term at least; its weight is 0 in that case.
        terms, idf = (self.terms, self.idf) if self.terms else ([""], [0.0])
        df = df.withColumn("_terms", terms_of(F.col(words), self.ngram))
        stages = [
            CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_tf"),
            ElementwiseProduct(
                scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_weighted"
            ),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=output),
        ]
        for step in stages:
            df = step.transform(df)
        return df.drop("_terms", "_tf", "_weighted")


def vector_entries(df: DataFrame, vector: str = "tfidf", key: str = "job_id") -> DataFrame:
    """The sparse matrix as a long table ``(key, term_id, weight)``."""
    inner = F.unwrap_udt(F.col(vector))
    cells = F.arrays_zip(inner["indices"].alias("term_id"), inner["values"].alias("weight"))
    return df.select(key, F.inline(cells).alias("term_id", "weight"))


def terms_of_documents(
    df: DataFrame, words: str = "words", key: str = "job_id", ngram: int = 2
) -> DataFrame:
    """``(key, term, n)``: every term of each text and how often it stands there.

    Row-local, by Arrow batch: a text's terms are counted in a hash table, which takes a
    fraction of the time of sorting them and telling runs apart by array functions.
    """
    rows = df.select(key, F.col(words).cast("array<string>").alias("w"))
    pairs = min(2, ngram) == 2

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), _TEXTS):
                some = batch.slice(start, _TEXTS)
                lists = some.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                sizes = lists.value_lengths().fill_null(0).to_pylist()
                places, found, counts, at = [], [], [], 0
                for place, size in enumerate(sizes):
                    own = [w for w in flat[at : at + size] if w is not None]
                    at += size
                    terms = Counter(own)
                    if pairs:
                        terms.update(map(" ".join, zip(own, own[1:])))
                    places += [place] * len(terms)
                    found += terms.keys()
                    counts += terms.values()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(places, pa.int32())), pa.array(found, pa.string()),
                     pa.array(counts, pa.int64())],
                    names=[key, "term", "n"],
                )

    return rows.mapInArrow(counted, f"`{key}` {rows.dtypes[0][1]}, term string, n long")
