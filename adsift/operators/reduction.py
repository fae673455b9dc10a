"""Truncated SVD of the TF-IDF vectors: an uncentred low-rank projection.

Randomised subspace iteration (Halko, Martinsson, Tropp 2011).  Its iterations need the
rows only as products with their Gram matrix.  Up to ``GRAM_TERMS`` terms that matrix is
summed up in one pass, and all iterations are products of matrices of the vocabulary.  For
more terms an iteration is one pass over the rows, and only matrices of vocabulary x rank
leave the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.sources.storage import write_table

OVERSAMPLES = 10
#: Iterations that are always done, and those that may follow.
ITERATIONS = 5
MOST_ITERATIONS = 30
#: The largest residual of a component, as a share of the largest energy.
TOLERANCE = 0.02
# Numbers held at once when a batch of rows is multiplied.
CHUNK_CELLS = 4_000_000
# Tasks that sum up shares of the Gram product.
PARTS_PER_CORE = 2
#: Terms up to which the whole Gram matrix is made; a task and the driver hold 288 MB then.
GRAM_TERMS = 6_000
# Terms, the most frequent of a task's first rows, whose products are made by dense blocks of rows.
_DENSE_TERMS = 512
_DENSE_ROWS = 512
# Cells of the Gram matrix that a batch of its rows holds.
_BATCH_CELLS = 1_000_000


def clamp_rank(wanted: int, features: int) -> int:
    return max(1, features - 1) if wanted >= features else wanted


def _gram_tasks(features: int):
    """What the tasks of ``_gram_matrix`` do: the share of a task's rows, and the sums of the
    shares.  A share is made of rows of the matrix, ``(term_id, part)``, each from its diagonal
    on.  Nested, so that the executors need no module of ours."""
    batch_cells, block_rows, block_terms = _BATCH_CELLS, _DENSE_ROWS, min(_DENSE_TERMS, features)

    def batches_of(rows):
        def batch():
            offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), cells], names=["term_id", "part"])

        terms, parts, held = [], [], 0
        for term, part in rows:
            terms.append(term)
            parts.append(part)
            held += len(part)
            if held >= batch_cells:
                yield batch()
                terms, parts, held = [], [], 0
        if terms:
            yield batch()

    def rows_of(batches):
        for batch in batches:
            cells = batch.column(1)
            ends, values = cells.offsets.to_numpy(), cells.values.to_numpy()
            for place, term in enumerate(batch.column(0).to_pylist()):
                yield term, values[ends[place] : ends[place + 1]]

    def shares(batches):
        # Products of two frequent terms, of a rare and a frequent one, of two rare ones.
        cells, often = np.zeros(features * features), None
        block, mixed = np.zeros((block_terms, block_terms)), np.zeros((features, block_terms))
        for batch in batches:
            if often is None:
                counts = np.bincount(np.concatenate(batch["indices"].to_list()), minlength=features)
                often = np.argsort(-counts, kind="stable")[:block_terms]
                place = np.full(features, -1)
                place[often] = np.arange(block_terms)
            for start in range(0, len(batch), block_rows):
                part = batch.iloc[start : start + block_rows]
                dense = np.zeros((len(part), block_terms))
                for row, own, value in zip(dense, part["indices"], part["values"]):
                    at = place[own]
                    row[at[at >= 0]] = value[at >= 0]
                    own, value = own[at < 0], value[at < 0]
                    mixed[own] += np.multiply.outer(value, row)
                    places = (own[:, None] * features + own).ravel()
                    cells[places] += np.multiply.outer(value, value).ravel()
                block += dense.T @ dense
        matrix = cells.reshape(features, features)
        if often is not None:
            matrix[:, often] += mixed
            matrix[often, :] += mixed.T
            matrix[np.ix_(often, often)] += block
        used = np.flatnonzero(matrix.diagonal())
        step = max(1, batch_cells // features)
        for start in range(0, used.size, step):
            some = used[start : start + step]
            yield pd.DataFrame({"term_id": some, "part": [matrix[i, i:] for i in some]})

    def sums(batches):
        total = {}
        for term, part in rows_of(batches):
            if term in total:
                total[term] += part
            else:
                total[term] = part.copy()
        yield from batches_of(total.items())

    return shares, sums, rows_of


def _gram_matrix(df: DataFrame, vector: str, features: int) -> np.ndarray:
    """A'A, whole, in one pass over the rows.

    A row adds the products of its own terms, whatever the rank that is looked for.  Each
    task adds up its rows and sends the half above the diagonal; the shares are added by term.
    """
    shares, sums, rows_of = _gram_tasks(features)
    inner = F.unwrap_udt(F.col(vector))
    places = inner["indices"].cast("array<bigint>")
    rows = df.select(places.alias("indices"), inner["values"].alias("values"))
    # A task's share is as large as the matrix, so what they send must not grow with the splits.
    rows = rows.coalesce(PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInPandas(shares, "term_id int, part array<double>")
    found = parts.repartition("term_id").mapInArrow(sums, "term_id int, part array<double>")
    matrix = np.zeros((features, features))
    for term, part in rows_of(found.toArrow().to_batches()):
        matrix[term, term:] = part
        matrix[term:, term] = part
    return matrix


def _gram_product(df: DataFrame, vector: str, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis in one pass."""
    if len(basis) <= GRAM_TERMS:
        return _gram_matrix(df, vector, len(basis)) @ basis
    return _row_products(df, vector, basis)


def _row_products(df: DataFrame, vector: str, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis in one pass, row by row, without the matrix A'A.

    Each task sums its rows' share; the shares are then added by term.  A share
    is as large as the basis, so the scan is folded into a few long tasks, two
    for each core: what they send does not grow with the splits of the input.
    """
    context = df.sparkSession.sparkContext
    shared = context.broadcast(basis)
    cells = CHUNK_CELLS

    def partial_sums(batches):
        matrix = shared.value
        total = np.zeros_like(matrix)
        for batch in batches:
            lengths = batch["indices"].map(len).to_numpy()
            batch, lengths = batch[lengths > 0], lengths[lengths > 0]
            done = 0
            while done < len(batch):
                ends = np.cumsum(lengths[done:])
                take = max(1, int(np.searchsorted(ends, cells // matrix.shape[1], "right")))
                part = batch.iloc[done : done + take]
                counts = lengths[done : done + take]
                done += take
                terms = np.concatenate(part["indices"].to_list())
                weights = np.concatenate(part["values"].to_list())[:, None]
                starts = np.cumsum(counts) - counts
                products = np.add.reduceat(weights * matrix[terms], starts)
                order = np.argsort(terms, kind="stable")
                spread = (weights * np.repeat(products, counts, axis=0))[order]
                found, first = np.unique(terms[order], return_index=True)
                total[found] += np.add.reduceat(spread, first)
        used = np.flatnonzero(total.any(axis=1))
        # Without a row the list would have no type.
        if used.size:
            yield pd.DataFrame({"term_id": used, "part": list(total[used])})

    inner = F.unwrap_udt(F.col(vector))
    rows = df.select(inner["indices"].alias("indices"), inner["values"].alias("values"))
    rows = rows.coalesce(PARTS_PER_CORE * context.defaultParallelism)
    parts = rows.mapInPandas(partial_sums, "term_id int, part array<double>")
    sums = (
        parts.select("term_id", array_to_vector("part").alias("part"))
        .groupBy("term_id")
        .agg(Summarizer.sum(F.col("part")).alias("total"))
        .collect()
    )
    product = np.zeros_like(basis)
    for r in sums:
        product[r["term_id"]] = r["total"].toArray()
    shared.destroy()
    return product


def _ritz(basis: np.ndarray, product: np.ndarray, rank: int):
    """The best vectors inside a basis, the energy of each, and what is left of it outside:
    ``|A'Av - ev|``, from the product that an iteration has anyway."""
    small = basis.T @ product
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    chosen = np.argsort(values)[::-1][:rank]
    vectors, energy = vectors[:, chosen], values[chosen]
    found = basis @ vectors
    return found, energy, np.linalg.norm(product @ vectors - found * energy, axis=0)


def fit_svd(
    df: DataFrame,
    features: int,
    rank: int = fixed.SVD_DIM,
    vector: str = "tfidf",
    iterations: int = ITERATIONS,
    seed: int = fixed.SEED,
    tolerance: float = TOLERANCE,
    most_iterations: int = MOST_ITERATIONS,
) -> np.ndarray:
    """Right singular vectors, one column per component, largest first.

    ``df`` should be a staged table: it is read once for the Gram matrix or, with more than
    ``GRAM_TERMS`` features, once for each iteration and once for the result.  After ``iterations`` passes it goes on until every component's
    residual is at most ``tolerance`` of the largest energy; if ``most_iterations`` do not
    suffice, that is an error.  Each component is signed so that its largest entry is
    positive, which makes runs agree.
    """
    rank = clamp_rank(rank, features)
    width = min(features, rank + OVERSAMPLES)
    basis = np.random.default_rng(seed).standard_normal((features, width))
    basis = np.linalg.qr(basis)[0]
    gram = _gram_matrix(df, vector, features) if features <= GRAM_TERMS else None
    for done in range(most_iterations + 1):
        product = _row_products(df, vector, basis) if gram is None else gram @ basis
        components, energy, residual = _ritz(basis, product, rank)
        worst = residual.max() / energy[0] if energy[0] > 0 else 0.0
        if done >= iterations and worst <= tolerance:
            break
        if done == most_iterations:
            raise ValueError(f"a component is off by {worst:.3g} after {done} iterations")
        basis = np.linalg.qr(product)[0]
    peak = components[np.abs(components).argmax(axis=0), np.arange(rank)]
    return components * np.where(peak < 0, -1.0, 1.0)


def certify(df: DataFrame, components: np.ndarray, vector: str = "tfidf") -> DataFrame:
    """``(component, energy, residual, overlap)``: one more pass over the rows tells for any
    matrix of components, loaded ones too, whether they are what they should be.

    ``energy`` is that of the rows along the component, ``residual`` is ``|A'Av - ev|``, zero
    for a singular vector; an energy is no further from a true one than this.  ``overlap`` is
    the largest product with another component, or the deviation of its own length from 1.
    """
    product = _gram_product(df, vector, components)
    energy = np.einsum("ij,ij->j", components, product)
    residual = np.linalg.norm(product - components * energy, axis=0)
    overlap = np.abs(components.T @ components - np.eye(components.shape[1])).max(axis=0)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(energy, residual, overlap))]
    return df.sparkSession.createDataFrame(
        rows, "component int, energy double, residual double, overlap double"
    )


def save_components(spark: SparkSession, components: np.ndarray, path: str) -> None:
    rows = [(i, row.tolist()) for i, row in enumerate(components)]
    write_table(spark.createDataFrame(rows, "term_id int, weights array<double>"), path)


def load_components(spark: SparkSession, path: str) -> np.ndarray:
    rows = sorted(spark.read.parquet(path).collect())
    return np.array([r["weights"] for r in rows])


def gram_diagonal(df: DataFrame, vector: str = "tfidf") -> DataFrame:
    """``(term_id, energy)``: each term's sum of squared weights."""
    inner = F.unwrap_udt(F.col(vector))
    cells = F.arrays_zip(inner["indices"].alias("term_id"), inner["values"].alias("weight"))
    return (
        df.select(F.inline(cells).alias("term_id", "weight"))
        .groupBy("term_id")
        .agg(F.sum(F.col("weight") * F.col("weight")).alias("energy"))
    )


def apply_svd(
    df: DataFrame, components: np.ndarray, vector: str = "tfidf", output: str = "svd"
) -> DataFrame:
    """Project each row; the component matrix is bounded by vocabulary x rank."""
    shared = df.sparkSession.sparkContext.broadcast(components)

    @F.pandas_udf("array<double>")
    def project(indices: pd.Series, values: pd.Series) -> pd.Series:
        matrix = shared.value
        return pd.Series([v @ matrix[i] for i, v in zip(indices, values)])

    inner = F.unwrap_udt(F.col(vector))
    return df.withColumn(output, project(inner["indices"], inner["values"]))
