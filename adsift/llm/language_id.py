"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds the vectors
of its letters, each permuted by its place (rotated), by multiplying them; a text's
vector bundles those of its n-grams by adding them.  A language's prototype is the
bundle of its training texts, each brought to length one, and a text is of the
language whose prototype has the largest cosine with it.  What all languages share
is no evidence, so the prototypes' mean is taken off before the comparison.

Texts are worked off in blocks: the different n-grams of a block get their vectors
once, and a matrix of counts times these vectors gives the bundles.  Whole texts
count; a block is cut by characters, and a text longer than a block is added up
piece by piece.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import own_columns

DIMENSIONS = 1024
NGRAM = 3
SEED = 11
#: The prototypes are fitted on about so many texts of each language at most,
#: drawn by a hash of the id.
TRAIN_TEXTS = 20_000
#: Prototypes are broadcast: at most so many languages.
MOST_LANGUAGES = 4_096
#: Characters that are worked off at once, and rows of the count matrix.
BLOCK_CHARS, BLOCK_TEXTS = 1 << 18, 128
UNKNOWN = "und"
_BLANK = 0


@functools.cache
def _letter_table() -> np.ndarray:
    """For each code point 1 if it is a letter or a mark on one, else 0."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            table[code] = 1
    return table


def letters_of(text: str) -> np.ndarray:
    """Code points in lower case, everything between letters as one blank, with a
    blank at both ends; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_letter_table()[codes] > 0, codes, _BLANK)
    if not codes.any():
        return codes[:0]
    codes = np.concatenate(([_BLANK], codes, [_BLANK]))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
    return codes[keep]


class Encoder:
    """Vectors of letters and n-grams; the same in every worker."""

    def __init__(self, dimensions: int = DIMENSIONS, ngram: int = NGRAM, seed: int = SEED):
        self.dimensions, self.ngram, self.seed = dimensions, ngram, seed
        self.rows: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        found = self.rows.get(code)
        if found is None:
            draw = np.random.default_rng([self.seed, code])
            found = draw.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            self.rows[code] = found
        return found

    def ngram_vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row for each n-gram, given as rows of code points."""
        codes, places = np.unique(grams, return_inverse=True)
        places = places.reshape(grams.shape)
        letters = np.stack([self.letter(int(c)) for c in codes])
        bound = np.ones((len(grams), self.dimensions), dtype=np.int8)
        for i in range(self.ngram):
            bound *= np.roll(letters, self.ngram - 1 - i, axis=1)[places[:, i]]
        return bound.astype(np.float32)

    def bundles(self, texts: list[np.ndarray]) -> np.ndarray:
        """The vectors of texts, given as the code points of ``letters_of``.

        A text with a letter has an n-gram at least, padded with blanks.
        """
        n = self.ngram
        texts = [np.pad(t, (0, max(0, n - len(t)))) for t in texts]
        lengths = np.array([len(t) - n + 1 for t in texts])
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(t, n) for t in texts])
        owner = np.repeat(np.arange(len(texts)), lengths)
        # Code points have 21 bits; three of them fit into one number.
        packed = np.zeros(len(grams), dtype=np.uint64)
        for i in range(n):
            packed = packed * np.uint64(0x110000 if n > 3 else 1 << 21) + grams[:, i].astype(np.uint64)
        _, first, which = np.unique(packed, return_index=True, return_inverse=True)
        kinds = len(first)
        counts = np.bincount(owner * kinds + which, minlength=len(texts) * kinds)
        counts = counts.reshape(len(texts), kinds).astype(np.float32)
        total = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for at in range(0, kinds, 4096):
            total += counts[:, at : at + 4096] @ self.ngram_vectors(grams[first[at : at + 4096]])
        return total

    def vectors(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Blocks of (places of the texts that have a letter, their vectors)."""
        places, block, chars = [], [], 0
        for i, text in enumerate(texts):
            letters = letters_of(text or "")
            if not len(letters):
                continue
            if len(letters) > BLOCK_CHARS:
                yield [i], self._long(letters)
                continue
            places.append(i)
            block.append(letters)
            chars += len(letters)
            if chars > BLOCK_CHARS or len(block) == BLOCK_TEXTS:
                yield places, self.bundles(block)
                places, block, chars = [], [], 0
        if block:
            yield places, self.bundles(block)

    def _long(self, letters: np.ndarray) -> np.ndarray:
        """Pieces share n - 1 letters, so every n-gram counts once."""
        total = np.zeros((1, self.dimensions), dtype=np.float32)
        for at in range(0, len(letters) - self.ngram + 1, BLOCK_CHARS):
            total += self.bundles([letters[at : at + BLOCK_CHARS + self.ngram - 1]])
        return total


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def training_rows(docs: DataFrame, chosen: Column, per_language: int = TRAIN_TEXTS) -> DataFrame:
    """``(lang, text)`` of the labelled rows to learn from.

    All of a language up to ``per_language`` rows, beyond that about as many,
    drawn by a hash of the id; the numbers of rows come from a scan without
    the texts.
    """
    own = own_columns(docs, doc_id="string", lang="string", text="string")
    rows = docs.select(
        *[c.alias(n) for n, c in own.items()], chosen.alias("chosen")
    ).where(F.col("chosen") & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = {r["lang"]: per_language / r["count"] for r in counts if r["count"] > per_language}
    if share:
        steps = 1 << 30
        wanted = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(s * steps))])
        draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(steps))
        rows = rows.where(draw < F.coalesce(F.try_element_at(wanted, F.col("lang")), F.lit(steps)))
    return rows.where(F.col("text").isNotNull()).select("lang", "text")


def fit_prototypes(rows: DataFrame, **options) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one row each.

    Each task bundles its texts by language; the bundles, one for each language
    and task, are added by language and dimension.
    """
    size = options.get("dimensions", DIMENSIONS)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(**options), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for places, vectors in encoder.vectors(batch.column("text").to_pylist()):
                # On a grid, so that the order of addition does not show.
                grid = np.round(_unit(vectors.astype(np.float64)) * 2**20).astype(np.int64)
                for i, vector in zip(places, grid):
                    sums.setdefault(langs[i], np.zeros(size, dtype=np.int64))
                    sums[langs[i]] += vector
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()),
             "part": pa.array(list(sums.values()), pa.list_(pa.int64()))}
        )

    parts = rows.mapInArrow(bundle, "lang string, part array<long>")
    cells = parts.select("lang", F.posexplode("part").alias("i", "x"))
    sums = cells.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    listed = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in found.collect())
    names = [lang for lang, _ in listed]
    return names, np.array([v for _, v in listed], dtype=np.float64).reshape(len(names), size)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, **options) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every document.

    The score is the cosine with the prototype, 0 at least.  Texts that are null
    or have no letter are ``und`` with score 0, and so is every text if no
    language was learnt.  Of equal scores the first language wins.
    """
    centred = _unit(prototypes)
    centre = centred.mean(axis=0) if len(names) > 1 else np.zeros(prototypes.shape[1])
    centred = _unit(centred - centre)
    shared = docs.sparkSession.sparkContext.broadcast(
        (names, centre.astype(np.float32), centred.astype(np.float32))
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, mean, matrix = shared.value
        encoder = Encoder(**options)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for places, vectors in encoder.vectors(texts) if langs else ():
                cosines = _unit(_unit(vectors) - mean) @ matrix.T
                best = cosines.argmax(axis=1)
                for i, k, c in zip(places, best, cosines.max(axis=1)):
                    pred[i], score[i] = langs[k], min(1.0, max(0.0, float(c)))
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    own = own_columns(docs, doc_id="long", text="string")
    rows = docs.select(*[c.alias(n) for n, c in own.items()])
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
