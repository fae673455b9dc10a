"""Global order without a global window.

A window without partitions would pull its whole input into one task.  Here the
rows are range-partitioned and staged, each range is accumulated on its own, and
the totals of the earlier ranges are added; those are one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsift.sources.storage import stage


def running_totals(
    df: DataFrame, order: list[Column], sums: dict[str, str], by: tuple[str, ...] = ()
) -> DataFrame:
    """Add inclusive running sums (``new name -> source column``) in the order
    given, restarting for each value of ``by``.

    The order must tell all rows of a group apart.
    """
    ranged = stage(
        df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranged",
    )
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    keys = ["_range", *by]
    offsets = (
        ranged.groupBy(*keys)
        .agg(*[F.sum(source).alias(f"_all_{new}") for new, source in sums.items()])
        .select(
            *keys,
            *[
                F.coalesce(F.sum(f"_all_{new}").over(earlier), F.lit(0)).alias(f"_before_{new}")
                for new in sums
            ],
        )
    )
    summed = ranged.withColumns(
        {new: F.sum(source).over(within) for new, source in sums.items()}
    )
    # At most one row for each range and group: bounded by the partition count.
    return (
        summed.join(F.broadcast(offsets), keys)
        .withColumns({new: F.col(new) + F.col(f"_before_{new}") for new in sums})
        .drop("_range", *[f"_before_{new}" for new in sums])
    )


# Leading hex digits of a hash that name its bucket: 65,536 buckets.
_BUCKET_DIGITS = 4


def hash_of(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def hash_cuts(
    df: DataFrame, key: str, seed: int, ranks: dict, stratum: str | None = None
) -> dict:
    """The rows at given ranks of a seeded hash order, within each stratum.

    ``ranks`` maps a stratum value (``None`` without strata) to 1-based ranks;
    the result maps ``(stratum, rank)`` to that row's ``(hash, key)``.  Taking
    the first n rows is then a row-local comparison with the n-th row, so exact
    random samples and splits need no sort and move no wide row.  Two narrow
    passes: counts by hash bucket, then the order inside the few buckets that a
    rank falls into.
    """
    spark = df.sparkSession
    level = F.lit(None).cast("string") if stratum is None else F.col(stratum).cast("string")
    hashed = df.select(
        level.alias("_stratum"), F.col(key).alias("_key"), hash_of(key, seed).alias("_hash")
    ).withColumn("_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))
    names = {None if s is None else str(s): s for s in ranks}
    wanted = [(n, int(r)) for n, s in names.items() for r in ranks[s] if r >= 1]
    if not wanted:
        return {}
    wanted_df = spark.createDataFrame(wanted, "_for string, _rank bigint")

    # At most 65,536 buckets for each stratum.
    upto = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counts = (
        hashed.groupBy("_stratum", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(upto))
    )
    hits = counts.join(
        F.broadcast(wanted_df),
        F.col("_stratum").eqNullSafe(F.col("_for"))
        & (F.col("_rank") <= F.col("_upto"))
        & (F.col("_rank") > F.col("_upto") - F.col("_rows")),
    ).select(
        "_for",
        F.col("_bucket").alias("_hit"),
        "_rank",
        (F.col("_rank") - F.col("_upto") + F.col("_rows")).alias("_place"),
    )
    order = Window.partitionBy("_for", "_rank").orderBy("_hash", "_key")
    found = (
        hashed.join(
            F.broadcast(hits),
            F.col("_stratum").eqNullSafe(F.col("_for")) & (F.col("_bucket") == F.col("_hit")),
        )
        .withColumn("_row", F.row_number().over(order))
        .where(F.col("_row") == F.col("_place"))
        .select("_for", "_rank", "_hash", "_key")
        .collect()
    )
    return {(names[r["_for"]], r["_rank"]): (r["_hash"], r["_key"]) for r in found}


def upto_cut(key: str, seed: int, cut) -> Column:
    """True for the rows of the hash order up to and with the cut row."""
    if cut is None:
        return F.lit(False)
    digest, last = hash_of(key, seed), cut[1]
    return (digest < cut[0]) | ((digest == cut[0]) & (F.col(key) <= last))
