"""Quality rules with adaptive thresholds.

Fixed cutoffs fit one language and one kind of source.  Here each rule's cutoff is
a fence over the values that the language and source really have: the upper
quartile plus a multiple of the distance to the median, from mergeable quantile
sketches (Greenwald-Khanna; one for each language and source, each language, and
all).  Most texts repeat nothing, so for repeated lines and words the quartiles are those
of the texts that do.  A group with few values uses the fence of the next level, and no
group's fence is far above that of the next level, so a source full of junk does not lift
its own.  Then every document is joined with its group's cutoffs.

Sketches are small and fold in each task before the shuffle, so a source with a
third of all rows is no hot key.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import SPACES, own_columns, space_words, stage

#: Base rules, kept fixed.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rank error of a sketch is at most 1 / ACCURACY of the group's rows.
ACCURACY = 10_000
#: Sketches of fewer values leave it to the next level: language, then all documents.
LEAST_ROWS = 100
#: Fence: upper quartile + SPREAD x (upper quartile - median).
SPREAD = 8.0
#: What a value may be above the quartile at least, where the quartiles are (nearly) equal.
EPSILON = {"symbol_rate": 0.02, "line_rate": 0.02, "repeat_rate": 0.02, "long_rate": 0.1}
RATES = tuple(EPSILON)
#: Rates that are zero for most texts; their sketches hold the others.
SPARSE = ("line_rate", "repeat_rate")
#: A fence is at most so many times that of the next level.
MOST_ABOVE = 1.5
SYMBOLS = r"[^#*$%&|<>]+"


def _placed_windows(words: Column) -> Column:
    """The hashes of the 3-word windows with their places, equal ones side by side."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice(words, F.lit(3), n), lambda h, c: F.xxhash64(h, c))
    return F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _places_of_equals(placed: Column) -> Column:
    """The places of windows that the text holds twice or more, in order."""
    n = F.greatest(F.size(placed) - 1, F.lit(0))
    # Each window beside its successor: both places, if their hashes are equal.
    both = F.zip_with(
        F.slice(placed, F.lit(1), n),
        F.slice(placed, F.lit(2), n),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(both))))


def _covered(places: Column) -> Column:
    """Words that 3-word windows at these sorted places cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, i):
        new = i + 3 - F.greatest(acc["end"], i)
        return F.struct((i + 3).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(places, start, add)["n"]


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of every whole text.

    Null text has no words, symbols or lines.
    """
    own = own_columns(docs, doc_id="long", lang="string", source="string", text="string")
    text = F.coalesce(own["text"], F.lit(""))
    rows = docs.select(
        own["doc_id"].alias("doc_id"), own["lang"].alias("lang"), own["source"].alias("source"),
        text.alias("t"), space_words(text).alias("w"),
    )
    lines = F.filter(F.split("t", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumns({"lines": lines, "placed": _placed_windows(F.col("w"))})
    rows = rows.withColumn("places", _places_of_equals(F.col("placed")))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _rate(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def with_rates(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return measured.withColumns(
        {
            "base_failed": failed,
            "symbol_rate": _rate("n_symbols", "word_chars"),
            "line_rate": _rate("n_dup_lines", "n_lines"),
            "repeat_rate": _rate("n_repeat_words", "n_words"),
            "long_rate": _rate("word_chars", "n_words"),
        }
    )


def fences(rated: DataFrame) -> DataFrame:
    """``(l, ln, s, sn, gid, <rate>_n, <rate>_median, <rate>_upper, <rate>_fence ...)`` of the
    documents that pass the base rules: a row for each language and source (gid 0), for
    each language (3) and for all (15)."""
    marked = rated.where(~F.col("base_failed")).withColumns(
        {"l": F.coalesce("lang", F.lit("")), "s": F.coalesce("source", F.lit("")),
         "ln": F.col("lang").isNull(), "sn": F.col("source").isNull()}
    )
    sums = []
    for c in RATES:
        value = F.when(F.col(c) > 0, F.col(c)) if c in SPARSE else F.col(c)
        quarters = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.75)), F.lit(ACCURACY))
        sums += [F.count(value).alias(f"{c}_n"), quarters.alias(c)]
    levels = [["l", "ln", "s", "sn"], ["l", "ln"], []]
    grouped = marked.groupingSets(
        [[F.col(c) for c in keys] for keys in levels], *[F.col(c) for c in levels[0]]
    )
    found = grouped.agg(F.grouping_id().alias("gid"), *sums)
    for c in RATES:
        middle, upper = F.col(c)[0], F.col(c)[1]
        spread = F.greatest(SPREAD * (upper - middle), F.lit(EPSILON[c]))
        found = found.withColumns(
            {f"{c}_median": middle, f"{c}_upper": upper, f"{c}_fence": upper + spread}
        )
    return found.drop(*RATES)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and no rate is above the
    fence of its language and source (of its language, or of all documents,
    where the sketch has fewer than ``LEAST_ROWS`` values).  Null languages and
    sources are groups of their own, null and empty texts fail the base rules, repeated rows
    count and are judged as often as they are there, and an empty table has no rows.
    """
    rated = with_rates(stage(measures(docs), "rule-measures"))
    table = stage(fences(rated), "rule-fences")
    whole = table.where(F.col("gid") == 15).first()

    def level(gid: int, *keys: str) -> DataFrame:
        sure = [
            F.when(F.col(f"{c}_n") >= LEAST_ROWS, F.col(f"{c}_fence")).alias(f"{c}{gid}") for c in RATES
        ]
        return table.where(F.col("gid") == gid).select(*keys, *sure)

    joined = (
        rated.withColumns(
            {"l": F.coalesce("lang", F.lit("")), "s": F.coalesce("source", F.lit("")),
             "ln": F.col("lang").isNull(), "sn": F.col("source").isNull()}
        )
        .join(level(0, "l", "ln", "s", "sn"), ["l", "ln", "s", "sn"], "left")
        .join(level(3, "l", "ln"), ["l", "ln"], "left")
    )

    def held(own: Column, above: Column) -> Column:
        return F.when(own.isNull(), above).otherwise(F.least(own, above * MOST_ABOVE))

    inside = F.lit(True)
    for c in RATES:
        # Without a value there is nothing to judge by, nor anything to judge.
        fence = F.lit(whole[f"{c}_fence"] if whole else None).cast("double")
        for gid in (3, 0):
            fence = held(F.col(f"{c}{gid}"), fence)
        inside = inside & F.coalesce(F.col(c) <= fence, F.lit(True))
    return joined.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
    )
