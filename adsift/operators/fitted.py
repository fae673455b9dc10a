"""Transforms with fitted state: index maximum, category codes, scaling.

Each fit is one aggregation whose result is small and of known size, and each
apply is row-local (a literal or a lookup join).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.operators.ordered import running_totals
from adsift.sources.storage import stage

# A category dictionary is broadcast up to this size.
SMALL_DICTIONARY_ROWS = 10_000
SMALL_DICTIONARY_BYTES = 8 << 20
# Copies of a large dictionary, so that no frequent category fills one task.
SALTS = 32


# --- fraud trigger index --------------------------------------------------------


def fit_index_max(df: DataFrame) -> float:
    return fit_numbers(df, ()).index_max


def apply_index(df: DataFrame, top: float) -> DataFrame:
    """Share of the maximum, rounded half-even to four places."""
    share = F.col("fraud_trigger_index_raw") / F.lit(top)
    return df.withColumn("fraud_trigger_index", F.rint(share * 10000) / 10000)


# --- category codes -------------------------------------------------------------


def _category_value(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(fixed.UNKNOWN_CATEGORY))


def fit_category_codes(df: DataFrame, columns=fixed.ENCODED_COLUMNS) -> DataFrame:
    """Dictionary ``(column_name, value, code)``: rank among the sorted values.

    All columns share one pass; equal values fold within each task before the
    shuffle.
    """
    columns = [c for c in columns if c in df.columns]
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), _category_value(c).alias("value"))
            for c in columns
        ]
    )
    values = df.select(F.inline(pairs)).distinct().withColumn("_one", F.lit(1))
    ranked = running_totals(values, [F.col("value")], {"_rank": "_one"}, ("column_name",))
    coded = ranked.select("column_name", "value", (F.col("_rank") - 1).cast("int").alias("code"))
    return stage(coded, "codes")


def apply_category_codes(df: DataFrame, codes: DataFrame, key: str = "job_id") -> DataFrame:
    """Add ``<column>_enc`` for each column of the dictionary.

    A dictionary of checked size becomes one map for each column, looked up
    by hash join.  The columns with larger ones are coded as ``(key, column)``
    rows, joined by value and salt, which spreads a value that a third of the
    rows share over many tasks; the wide rows then meet all their codes in a
    single join by key.
    """
    sizes = {
        r["column_name"]: (r["rows"], r["bytes"])
        for r in codes.groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes")
        )
        .collect()
    }
    named = [c for c in df.columns if c in sizes]
    small = [
        c for c in named
        if sizes[c][0] <= SMALL_DICTIONARY_ROWS and sizes[c][1] <= SMALL_DICTIONARY_BYTES
    ]
    large = [c for c in named if c not in small]
    if large:
        pairs = [
            F.struct(F.lit(c).alias("column_name"), _category_value(c).alias("value")) for c in large
        ]
        salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
        cells = df.select(key, salt.alias("_salt"), F.inline(F.array(*pairs)))
        copies = codes.where(F.col("column_name").isin(large)).withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        )
        coded = cells.join(copies, ["column_name", "value", "_salt"], "left")
        of = {c: F.max(F.when(F.col("column_name") == c, F.col("code"))).alias(f"{c}_enc") for c in large}
        df = df.join(coded.groupBy(key).agg(*of.values()), key, "left")
    for column in small:
        lookup = codes.where(F.col("column_name") == column).select(
            F.col("value").alias("_value"), F.col("code").alias(f"{column}_enc")
        )
        df = df.withColumn("_of", _category_value(column))
        df = df.join(F.broadcast(lookup), F.col("_of") == F.col("_value"), "left")
        df = df.drop("_of", "_value")
    return df


# --- scaling --------------------------------------------------------------------


@dataclass(frozen=True)
class Numbers:
    """What one pass over the feature rows finds out."""

    rows: int
    index_max: float
    moments: dict[str, tuple[float, float]]


def fit_numbers(df: DataFrame, columns=fixed.SCALED_COLUMNS) -> Numbers:
    """Row count, index maximum (1 without an index above 0), and each column's mean
    and population deviation, missing counted as 0."""
    columns = [c for c in columns if c in df.columns]
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    index = "fraud_trigger_index_raw"
    top = F.max(index) if index in df.columns else F.lit(None).cast("double")
    found = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        top.alias("_top"),
        *[F.avg(value[c]).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(value[c]).alias(f"{c}_std") for c in columns],
    ).first()
    top = found["_top"]
    return Numbers(
        found["_rows"],
        top if top is not None and top > 0 else 1.0,
        {c: (found[f"{c}_mean"] or 0.0, found[f"{c}_std"] or 1.0) for c in columns},
    )


def fit_scaler(df: DataFrame, columns=fixed.SCALED_COLUMNS) -> dict[str, tuple[float, float]]:
    return fit_numbers(df, columns).moments


def apply_scaler(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {
            f"{c}_scaled": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - mean) / std
            for c, (mean, std) in moments.items()
        }
    )


# --- outputs --------------------------------------------------------------------


def meta_features(df: DataFrame, version: int = 2) -> DataFrame:
    """Key, label, the raw columns kept, then all scaled and encoded ones."""
    wanted = fixed.META_COLUMNS if version == 2 else fixed.META_COLUMNS_V1
    derived = [c for c in df.columns if c.endswith(("_scaled", "_enc"))]
    return df.select(*[c for c in wanted if c in df.columns], *derived)


def group_members(columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of group and feature; the groups overlap on purpose."""
    groups = {name: list(members) for name, members in fixed.FEATURE_GROUPS.items()}
    groups["skills"] += [c for c in columns if c.startswith(fixed.SKILL_GROUP_PREFIX)]
    return [(group, feature) for group, features in groups.items() for feature in features]


def feature_groups(df: DataFrame) -> DataFrame:
    """The group table ``(group, feature)`` of a feature table."""
    return df.sparkSession.createDataFrame(
        group_members(df.columns), "`group` string, feature string"
    )


def feature_group_counts(df: DataFrame) -> DataFrame:
    """The group table with each feature's number of values, 0 if absent."""
    pairs = group_members(df.columns)
    present = {f for _, f in pairs if f in df.columns}
    counts = df.agg(*[F.count(F.col(f"`{f}`")).alias(f) for f in sorted(present)])
    rows = F.array(
        *[
            F.struct(
                F.lit(group).alias("feature_group"),
                F.lit(f).alias("feature"),
                (F.col(f"`{f}`") if f in present else F.lit(0).cast("bigint")).alias("n_values"),
            )
            for group, f in pairs
        ]
    )
    return counts.select(F.inline(rows))


def select_group(df: DataFrame, group: str) -> DataFrame:
    """The key and the present features of one group, for ablations."""
    members = [f for g, f in group_members(df.columns) if g == group]
    return df.select("job_id", *[f"`{f}`" for f in members if f in df.columns])
