"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words.  Its fingerprint is the least hash of
the ``GRAM``-word runs inside it, so a text keeps about a third of its hashes and
yet two texts that share a window share its fingerprint: nothing of that length
can be missed.  Documents are compared with the fingerprints of the benchmark
while they are scanned; only windows with a known fingerprint leave the scan and
are then extended to the words themselves in an exact join.

The scan sees the fingerprints as a bitmap of fixed size, whatever the size of the
benchmark.  A bit may be set by another hash, which costs a row in the join and
changes nothing in the result.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import (
    NO_ID,
    ascii_lower,
    joined_runs,
    own_columns,
    split_words,
    stage,
    text_digest,
    without_rows,
)
from adsift.operators.bitmap import bit_is_set, collected_bitmap, constant_longs

#: What separates the words: all of ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 6
#: Bits of the bitmap of known fingerprints; 16,384 longs, 128 KB.
BITMAP_BITS = 1 << 20


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def with_fingerprints(
    df: DataFrame, hashes: str, out: str, length: int, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Add the fingerprint of each window of ``length`` words, in order.

    Whole windows are winnowed: the least hash of the grams inside.  Shorter
    ones (of items below the window length) have their own hash.
    """
    df = df.withColumn(out, F.col(hashes))
    run = gram if length == window else length
    df = joined_runs(df, out, run)
    return joined_runs(df, out, length - run + 1, F.least)


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(length, words, items)``: the different windows with their item ids.

    An item shorter than the window, but with a word, is one window.
    """
    own = own_columns(items, item_id="string", text="string")
    words = items.select(own["item_id"].alias("item"), words_of(own["text"]).alias("w"))
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    spans = F.transform(starts, lambda i: F.array_join(F.slice("w", i, length), " "))
    return (
        words.where(F.size("w") > 0)
        .select("item", length.alias("length"), F.explode(spans).alias("words"))
        .groupBy("length", "words")
        .agg(F.collect_set("item").alias("items"))
    )


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bit(fingerprint: Column, length: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(fingerprint, F.lit(length)), F.lit(bits).cast("long"))


def known_bitmap(
    windows: DataFrame, lengths: list[int], window: int, gram: int, bits: int
) -> Column:
    """The bits of all benchmark windows as a constant array of longs."""
    dense = [0] * (bits // 64)
    for n in lengths:
        words = _word_hashes(F.split("words", " "))
        hashed = windows.where(F.col("length") == n).select(words.alias("h"))
        # Outer: a filter on the array would be computed through all its steps.
        marked = with_fingerprints(hashed, "h", "f", n, window, gram).select(
            F.explode_outer("f").alias("f")
        ).select(_bit(F.col("f"), n, bits).alias("bit"))
        dense = [a | b for a, b in zip(dense, collected_bitmap(marked, bits))]
    return constant_longs(dense)


def _suspects(words: Column, marks: Column, length: int, bitmap: Column, bits: int) -> Column:
    """``(start, length, words)`` of the windows whose fingerprint may be known."""

    places = F.transform(
        marks, lambda f, i: F.when(bit_is_set(bitmap, _bit(f, length, bits)), i)
    )
    return F.transform(
        F.array_compact(places),
        lambda i: F.struct(
            i.alias("start"),
            F.lit(length).alias("length"),
            F.array_join(F.slice(words, i + 1, length), " ").alias("words"),
        ),
    )


def _covered(spans: Column) -> Column:
    """How many places the ``(start, length)`` spans cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, span):
        end = F.greatest(acc["end"], span["start"] + span["length"])
        new = F.greatest(end - F.greatest(acc["end"], span["start"]), F.lit(0))
        return F.struct(end.alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``digest`` of the text, ``n_words``,
    ``n_hit`` words inside benchmark windows and the ``items`` found, as sorted
    strings.

    A null or empty text has no words and no hits, and an empty benchmark hits
    nothing.  Rows with equal id and text have equal results; a null item id
    counts as no item but its windows hit.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram must fit into the window")
    windows = stage(benchmark_windows(items, window), "bench-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    own = own_columns(docs, doc_id="long", text="string")
    digest = text_digest(own["text"])
    rows = docs.select(
        own["doc_id"].alias("doc_id"), digest.alias("digest"), words_of(own["text"]).alias("w")
    )
    kind = "array<struct<start:int,length:int,words:string>>"
    suspects = F.array().cast(kind)
    if lengths:
        bitmap = known_bitmap(windows, lengths, window, gram, bits)
        rows = rows.withColumn("h", _word_hashes(F.col("w")))
        for n in lengths:
            rows = with_fingerprints(rows, "h", f"f{n}", n, window, gram)
        found = [
            _suspects(F.col("w"), F.col(f"f{n}"), n, bitmap, bits).cast(kind) for n in lengths
        ]
        suspects = found[0] if len(found) == 1 else F.concat(*found)
    rows = stage(
        rows.select(
            "doc_id", "digest", F.size("w").cast("long").alias("n_words"), suspects.alias("suspects")
        ),
        "bench-suspects",
    )
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("nil"), "digest"]
    found = (
        rows.select(*key, F.inline("suspects"))
        .join(windows, ["length", "words"])
        .groupBy("k", "nil", "digest")
        .agg(
            F.collect_set(F.struct("start", "length")).alias("spans"),
            F.flatten(F.collect_set("items")).alias("items"),
        )
        .select(
            "k", "nil", "digest",
            _covered(F.col("spans")).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct("items")).alias("items"),
        )
    )
    narrow = rows.select("doc_id", *key, "n_words")
    return narrow.join(found, ["k", "nil", "digest"], "left").select(
        "doc_id",
        "digest",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window; the columns of ``docs``."""
    found = find_overlaps(docs, items, **options).where(F.col("n_hit") > 0)
    gone = found.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "digest", F.lit(False).alias("stays")
    ).distinct()
    return without_rows(docs, stage(gone, "bench-gone"))
