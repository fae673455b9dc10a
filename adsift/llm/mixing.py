"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the documents are put in
key order, the word counts are summed up along that order, and the mix takes the
documents until the source's budget is used up; a budget above the source's size
takes whole epochs first and cuts the last one.  The prefix sums are distributed:
a key's leading digits name its range, ranges are summed up in parallel, and the
totals of a source's earlier ranges are added.  A source with a third of all rows
is thus spread over all its ranges, and only a few numbers of a document move.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsift.llm.common import own_columns, private, space_words, stage
from adsift.operators.ordered import running_totals

#: Share of all words that the targets add up to.
SHARE = 1.5
#: Weights of the sources in code point order, repeating; a null source is last.
WEIGHTS = (3, 1, 2)
#: A target stops at so many times its source's size.
MAX_EPOCHS = 2
#: Leading hex digits of the key that name its range: 4,096 ranges for each source.
RANGE_DIGITS = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.size(space_words(text)).cast("long")


def mix_key(doc_id: Column) -> Column:
    """The hash-random place of a document; equal ids share it."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{SEED}")))


def sized_columns(docs: DataFrame) -> dict[str, Column]:
    return own_columns(docs, doc_id="long", source="string", text="string")


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, key)`` of every row; null text has size 0."""
    own = sized_columns(docs)
    return docs.select(
        own["doc_id"].alias("doc_id"),
        own["source"].alias("source"),
        word_count(own["text"]).alias("size"),
        mix_key(own["doc_id"]).alias("key"),
    )


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``(source, source_size, target)`` from a table of ``(source, size)`` rows.

    Sharing by weight with caps has one solution: each target is the smaller of
    its cap and weight x level.  With the sources in the order of cap / weight,
    those in front are at their cap; the level is what is left, divided by the
    weights not at their cap.  Both orders are running sums over ranges, since
    sources may be many; one number comes to the driver.
    """
    totals = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("missing", F.col("source").isNull())
        .withColumn("one", F.lit(1).cast("long"))
    )
    ranked = running_totals(totals, [F.col("missing"), F.col("source")], {"place": "one"})
    listed = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    turn = ((F.col("place") - 1) % len(weights) + 1).cast("int")
    weighed = (
        ranked.withColumn("weight", F.element_at(listed, turn))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("full", F.col("cap") / F.col("weight"))
    )
    summed = stage(
        running_totals(
            weighed, [F.col("full"), F.col("place")], {"caps": "cap", "weights": "weight"}
        ),
        "mix-sources",
    )
    whole = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    all_words, all_weights = whole[0] or 0, whole[1] or 0
    level = (F.lit(float(share)) * all_words - (F.col("caps") - F.col("cap"))) / (
        F.lit(all_weights).cast("long") - F.col("weights") + F.col("weight")
    )
    free = summed.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap"))
    level = free.agg(F.min_by("level", F.struct("full", "place"))).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.least(F.lit(level) * F.col("weight"), cap)
    return summed.select("source", "source_size", target.alias("target"))


def _keyed(df: DataFrame) -> DataFrame:
    """The source as two columns without nulls, to group and join by."""
    return df.withColumns(
        {"missing": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}
    ).drop("source")


def mix(docs: DataFrame, **shares) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per document.

    ``taken`` counts the words of a document that the mix takes, repeats
    counted: whole epochs, and in the last one the words up to the source's
    budget, so a source's ``taken`` add up to its target, rounded down.
    Documents without words take nothing; rows with one id share a key and
    follow each other by size, so reruns agree.  An empty table gives no rows.
    """
    rows = stage(sized(docs), "mix-sizes")
    targets = _keyed(source_targets(rows, **shares))
    ranged = _keyed(rows).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    source, place = ["missing", "name"], ["missing", "name", "range"]
    before = Window.partitionBy(*source).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most 4,096 rows for each source.
    offsets = (
        ranged.groupBy(*place)
        .agg(F.sum("size").alias("words"))
        .withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .drop("words")
        .join(targets, source)
    )
    within = Window.partitionBy(*place).orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = ranged.withColumn("upto", F.sum("size").over(within)).join(offsets, place)
    budget = F.floor("target")
    epochs = F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))
    rest = budget - epochs * F.col("source_size")
    start = F.col("offset") + F.col("upto") - F.col("size")
    last = F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return joined.select(
        "doc_id",
        F.when(~F.col("missing"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + last).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **shares) -> DataFrame:
    """The documents of the mix, each as often as it is taken, whole.

    The columns are those of ``docs``.  A document that the cut divides stays
    whole once more, so a source exceeds its target by less than one document.
    The texts do not move: each source's cut is one row, and a document
    compares its own key with it.  Documents without words are never taken.
    """
    taken = mix(docs, **shares).where(F.col("size") > 0)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    place = F.struct(mix_key(F.col("doc_id")).alias("key"), "doc_id", "size")
    # The number of times falls by one along a source's order, at the cut.
    cuts = (
        taken.select("source", times.alias("times"), place.alias("place"))
        .groupBy("source")
        .agg(
            F.max("times").alias("most"),
            F.max_by("place", F.struct("times", "place")).alias("cut"),
        )
    )
    cuts = stage(_keyed(cuts), "mix-cuts")
    own = sized_columns(docs)
    names = [private(docs, n) for n in ("_missing", "_name", "_place", "_copy")]
    missing, name, here, copy = names
    marked = docs.withColumns(
        {
            missing: own["source"].isNull(),
            name: F.coalesce(own["source"], F.lit("")),
            here: F.struct(
                mix_key(own["doc_id"]).alias("key"),
                own["doc_id"].alias("doc_id"),
                word_count(own["text"]).alias("size"),
            ),
        }
    ).where(F.col(f"{here}.size") > 0)
    cut, most = private(docs, "_cut"), private(docs, "_most")
    cuts = cuts.select(
        F.col("missing").alias(missing), F.col("name").alias(name),
        F.col("cut").alias(cut), F.col("most").alias(most),
    )
    repeats = F.when(F.col(here) <= F.col(cut), F.col(most)).otherwise(F.col(most) - 1)
    return (
        marked.join(cuts, [missing, name])
        .where(repeats > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), repeats)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
