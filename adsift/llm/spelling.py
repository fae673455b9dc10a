"""Spelling variants by blocked Gram matrices.

Two words are near if one inserted, deleted or replaced code point makes one of the
other.  Their letter counts then differ by a squared distance of 2, or of 1 if one is
longer, and ``|a - b|^2 = |a|^2 + |b|^2 - 2ab`` gives the distances of a whole block of
words by one matrix product.  What is at most two apart, with equal or adjacent lengths,
is verified letter by letter.

Blocks are finer than lengths.  The shorter word of a pair is cut into ``PIECES`` pieces;
one edit touches one of them, so all others stand in the longer word too, those before
the edit counted from its start and those after from its end.  Leaving out each piece in
turn, a word is in one block for each piece among words of its own length and the next, and once
more among those of the length before.  A block holds equal and adjacent lengths only, and
near words share a block for certain.

A block of more than ``TILE`` words is dealt to tiles by hash, and each pair of tiles is a
product of its own, so no task takes a whole large block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import UPPER, own_columns, stage

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent as its variant.
FORM_RATIO = 10
PIECES = 3
TILE = 2048
#: Up to so many large blocks the list of their tiles is broadcast.
BROADCAST_BLOCKS = 100_000
#: Small blocks are multiplied together, so many words at once.
PACK = 128
# Counts of words up to this length have squares that single precision holds exactly.
_SINGLE = 2048
_LETTERS = "A-Za-zÀ-ÿ"


# --- words ----------------------------------------------------------------------


def dropped_letter(run: Column, key: Column, every: int = 31) -> Column:
    """The run as it is counted: where ``every`` divides the crc32 of ``key:run``, the
    letter at that number, taken modulo the run's length, is left out."""
    hashed = F.crc32(F.concat(key, F.lit(":"), run))
    at = (hashed % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(hashed % every == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the words of ``LEAST_LENGTH`` letters or more that are there
    ``LEAST_COUNT`` times or more, over all documents.

    Shorter runs cannot become words and are passed over by the pattern.  A null id
    counts as an empty one.
    """
    own = own_columns(docs, doc_id="long", text="string")
    runs = F.regexp_extract_all(
        own["text"], F.lit(f"[{_LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0)
    )
    key = F.coalesce(own["doc_id"].cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.explode(runs).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    run = F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower()))
    rows = rows.select("key", run.alias("run"))
    words = rows.select(dropped_letter(F.col("run"), F.col("key")).alias("word"))
    return (
        words.where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


# --- blocks ---------------------------------------------------------------------


def bounds(length: int, pieces: int = PIECES) -> list[int]:
    return [length * i // pieces for i in range(pieces + 1)]


def block_entries(words: DataFrame, pieces: int = PIECES) -> DataFrame:
    """``(block, piece, base, word, n)``: the blocks of each word, by a hash of the base
    length, the piece left out and the pieces kept; words that share it by chance cost
    a comparison."""
    length = F.length("word")
    entries = []
    for base in (length, length - 1):
        for i in range(pieces):
            start = F.floor(base * i / pieces).cast("int")
            end = F.floor(base * (i + 1) / pieces).cast("int")
            head = F.substring("word", F.lit(1), start)
            tail = F.substring("word", length - (base - end) + 1, base - end)
            key = F.xxhash64(base, F.lit(i), head, tail)
            entries.append(F.struct(key.alias("block"), F.lit(i).alias("piece"), base.alias("base")))
    return words.select(F.inline(F.array(*entries)), "word", "n")


def unit_entries(
    entries: DataFrame, tile: int = TILE, broadcast_blocks: int = BROADCAST_BLOCKS
) -> DataFrame:
    """``(unit, part, piece, base, word, n)``: what one product compares.

    A block up to ``tile`` words is one unit.  A larger one has a unit for each tile and
    for each pair of tiles; in a pair's unit only words of different ``part`` are
    compared, in all others ``part`` is -1.
    """
    large = stage(
        entries.groupBy("block").agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > tile)
        .select("block", F.ceil(F.col("_size") / tile).cast("int").alias("tiles")),
        "spelling-blocks",
    )
    few = large.count() <= broadcast_blocks
    rows = entries.join(F.broadcast(large) if few else large, "block", "left")
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    whole = F.struct(F.col("block").alias("unit"), F.lit(-1).alias("part"))
    pair = lambda j: F.struct(
        F.xxhash64("block", F.least(own, j), F.greatest(own, j)).alias("unit"),
        F.when(own == j, -1).when(own < j, 0).otherwise(1).alias("part"),
    )
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair)
    units = F.when(F.col("tiles").isNull(), F.array(whole)).otherwise(tiles)
    return rows.select(F.inline(units), "piece", "base", "word", "n")


# --- products -------------------------------------------------------------------


def letter_counts(words: list[str]) -> np.ndarray:
    """A row for each word, a column for each letter of the words' alphabet."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    letters, column = np.unique(codes, return_inverse=True)
    cells = np.repeat(np.arange(len(words)), lengths) * len(letters) + column
    counts = np.bincount(cells, minlength=len(words) * len(letters))
    kind = np.float32 if lengths.max() <= _SINGLE else np.float64
    return counts.reshape(len(words), len(letters)).astype(kind)


def one_edit(a: str, b: str) -> bool:
    """Whether one edit makes ``b`` of ``a``; ``b`` is as long or one longer."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    return a[at:] == b[at + 1 :]


def first_shared(a: str, b: str, pieces: int) -> int:
    """The first piece that may be left out for both words to have the same rest."""
    cuts, more = bounds(len(a), pieces), len(b) - len(a)
    for i in range(pieces):
        if a[: cuts[i]] == b[: cuts[i]] and a[cuts[i + 1] :] == b[cuts[i + 1] + more :]:
            return i
    return -1


def close_pairs(words: list[str], group: np.ndarray, part: np.ndarray, base: np.ndarray):
    """Places ``(i, j)`` of words of the same unit, the first of the base length, whose
    letter counts are at most two apart; pairs of the base length once."""
    counts = letter_counts(words)
    squares = np.einsum("ij,ij->i", counts, counts)
    apart = squares[:, None] + squares[None, :] - 2 * (counts @ counts.T)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short = lengths == base
    place = np.arange(len(words))
    close = (apart <= 2) & (group[:, None] == group[None, :]) & short[:, None]
    close &= ~short[None, :] | (place[:, None] < place[None, :])
    close &= (part[:, None] != part[None, :]) | (part[:, None] < 0)
    return np.nonzero(close)


def _packs(unit: np.ndarray) -> Iterator[np.ndarray]:
    """Rows, sorted by unit, of some units with two rows or more each."""
    starts = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1 if len(unit) else 0))
    ends = np.append(starts[1:], len(unit))
    pack, size = [], 0
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        pack.append(np.arange(a, b))
        size += b - a
        if size >= PACK:
            yield np.concatenate(pack)
            pack, size = [], 0
    if pack:
        yield np.concatenate(pack)


_NEAR = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _near_of(table: pa.Table, pieces: int) -> Iterator[pa.RecordBatch]:
    unit = table["unit"].to_numpy()
    part, piece, base = (table[c].to_numpy() for c in ("part", "piece", "base"))
    for rows in _packs(unit):
        some = table.select(["word", "n"]).take(rows)
        words, ns = some["word"].to_pylist(), some["n"].to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        left = piece[rows]
        for i, j in zip(*(x.tolist() for x in close_pairs(words, unit[rows], part[rows], base[rows]))):
            a, b = words[i], words[j]
            # A pair may share several blocks; the first one counts.
            if left[i] == left[j] == first_shared(a, b, pieces) and one_edit(a, b):
                for column, values in zip(out, ((a, b), (b, a), (ns[j], ns[i]))):
                    column.extend(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NEAR)], schema=_NEAR)


def near_words(words: DataFrame, pieces: int = PIECES, tile: int = TILE, **limits) -> DataFrame:
    """``(word, other, other_n)`` for both directions of each near pair, once.

    ``words`` is a staged table ``(word, n)`` of letters up to code point 255.  A unit's
    rows come sorted; the units that a batch completes are compared, the last one waits
    for the next batch.
    """
    units = unit_entries(block_entries(words, pieces), tile, **limits)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if held is not None:
                    yield from _near_of(held, pieces)
                return
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            unit = held["unit"].to_numpy()
            open_from = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            if open_from:
                yield from _near_of(held.slice(0, open_from), pieces)
                held = held.slice(open_from)

    ordered = units.repartition("unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(compare, "word string, other string, other_n long")


# --- forms ----------------------------------------------------------------------


def _followed(forms: DataFrame, most: int) -> DataFrame:
    """``(word, root)`` of words with a form: the last one on the way of forms.

    Each form is ``FORM_RATIO`` times as frequent, so the way's length is bounded by the
    largest count; every round doubles the length that is followed.
    """
    links = forms.select("word", F.col("form").alias("root"))
    reach, steps = 1, 0
    count = LEAST_COUNT
    while count * FORM_RATIO <= most:
        count, steps = count * FORM_RATIO, steps + 1
    while reach < steps:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(
            links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
            "spelling-roots",
        )
        reach *= 2
    return links


def variant_groups(words: DataFrame, **limits) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each row of a staged table ``(word, n)``
    with distinct words.

    The form is the most frequent near word, the first by code points of equals, if it is
    ``FORM_RATIO`` times as frequent; the root is the last form on the way from the word.
    """
    near = near_words(words, **limits)
    none = lambda kind: F.lit(None).cast(kind)
    rows = words.select("word", "n", none("string").alias("other"), none("long").alias("other_n"))
    rows = rows.unionAll(near.select("word", none("long"), "other", "other_n"))
    # Of equal counts the smaller word: Spark compares strings by their bytes.
    ranked = F.struct((-F.col("other_n")).alias("minus_n"), "other")
    found = rows.groupBy("word").agg(
        F.max("n").alias("n"),
        F.count("other").alias("n_near"),
        F.min(F.when(F.col("other").isNotNull(), ranked)).alias("best"),
    )
    form_n = -F.col("best")["minus_n"]
    is_form = form_n >= FORM_RATIO * F.col("n")
    found = stage(
        found.select(
            "word", "n", "n_near",
            F.when(is_form, F.col("best")["other"]).alias("form"),
            F.when(is_form, form_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    most = found.agg(F.max("n")).first()[0] or 0
    roots = _followed(found.where("form IS NOT NULL"), most)
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variant groups of all words of the documents.

    Null and empty texts have no words, repeated rows count as often as they are there, and an
    empty table has none.  Runs of any length are taken whole.
    """
    return variant_groups(stage(word_counts(docs), "spelling-words"))
