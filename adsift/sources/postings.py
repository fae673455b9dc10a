"""Reading postings: scan, tolerant schema, key, default label, exact dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adsift.functions import fixed_values as fixed
from adsift.operators.bitmap import marked, member_bits
from adsift.operators.ordered import running_totals
from adsift.sources.records import read_csv
from adsift.sources.storage import stage

POSTING_SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "job_id" else T.StringType())
        for name in fixed.SOURCE_COLUMNS.values()
    ]
)
#: A row's place in the files it was read from.
PLACE = "_place"
_REPEATS = "_may_repeat"
# Rows of one partition that its ids leave room for.
_ROW_BITS = 33


def scan_postings(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    multi_line: bool = False,
    keep_order: bool = False,
) -> DataFrame:
    """Postings of a parquet or CSV location under their canonical names.

    CSV files are split at their lines; pass ``multi_line=True`` for exports whose
    quoted fields span lines, which takes a pass more.  All CSV columns are read as text, so
    none is spent on inferring types.  ``keep_order`` adds each row's place in the
    files, by which dedup and keys then go.
    """
    if fmt == "csv" and multi_line:
        return canonical_names(read_csv(spark, path, PLACE if keep_order else None))
    if fmt == "csv":
        df = spark.read.csv(path, header=True, escape='"')
    else:
        df = spark.read.format(fmt).load(path)
    return canonical_names(df.withColumn(PLACE, file_place(fmt)) if keep_order else df)


def file_place(fmt: str) -> Column:
    """Where a row stands: file, start of its split and place in that, whatever the split size.

    Parquet numbers the rows of a file.  For text files the split's first byte is known, and
    generated ids grow along it, since a split is read by one task in order.  Files go
    by their paths.
    """
    meta = F.col("_metadata")
    if fmt == "parquet":
        start, row = F.lit(0).cast("long"), meta["row_index"]
    else:
        start, row = meta["file_block_start"], F.monotonically_increasing_id()
    return F.struct(
        meta["file_path"].alias("path"), start.alias("start"), row.cast("long").alias("row")
    )


def canonical_names(df: DataFrame) -> DataFrame:
    renamed = {a: b for a, b in fixed.SOURCE_COLUMNS.items() if a in df.columns}
    return df.withColumnsRenamed(renamed)


def tolerant_schema(df: DataFrame) -> DataFrame:
    """Null tokens become null; columns the input lacks get their default.

    A key is kept as it comes, whatever its type.
    """
    types = dict(df.dtypes)
    tokens = ", ".join(f"'{token}'" for token in fixed.NULL_TOKENS)
    columns = {}
    for name in POSTING_SCHEMA.names:
        if name == "job_id":
            continue
        if name not in types:
            columns[name] = F.lit(fixed.ABSENT_DEFAULTS.get(name)).cast("string")
        else:
            columns[name] = F.expr(f"CASE WHEN string({name}) NOT IN ({tokens}) THEN string({name}) END")
    return df.withColumns(columns)


def surrogate_key(df: DataFrame) -> DataFrame:
    """``job_id`` 1..n in file order, where the input has none.

    Rows that know their places are numbered by them: they are range-partitioned by
    place and the counts of earlier ranges added.  Others are numbered as they lie: the
    rows are written first, since their places must not change between the two passes.  A
    generated id holds the partition and the row's place in it; adding the row counts
    of all earlier partitions makes the numbers consecutive without moving a row.  Only
    the counts are joined back, one row for each partition.
    """
    if "job_id" in df.columns:
        return df.drop(PLACE) if PLACE in df.columns else df
    if PLACE in df.columns:
        ordered = df.withColumn("_one", F.lit(1).cast("long"))
        numbered = running_totals(ordered, [F.col(PLACE)], {"job_id": "_one"})
        return numbered.drop(PLACE, "_one")
    placed = stage(df.withColumn("_place", F.monotonically_increasing_id()), "placed")
    partition = F.shiftright("_place", _ROW_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(partition.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn("job_id", F.col("_before") + place + 1)
        .drop("_place", "_part", "_before")
    )


def require_keys(df: DataFrame, key: str = "job_id") -> DataFrame:
    """The table as it is, or an error if a key is null or stands twice."""
    found = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(5).collect()
    if found:
        raise ValueError(f"null or repeated keys, such as {[r[key] for r in found]}")
    return df


def default_label(df: DataFrame) -> DataFrame:
    """``fake_label`` 0 where the input carries no label."""
    if "fake_label" in df.columns:
        return df
    return df.withColumn("fake_label", F.lit(0))


def row_digest(df: DataFrame) -> Column:
    """256 bits for a whole row: the JSON of its fields tells nulls, which it leaves
    out, from any text."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in _own_columns(df)])), 256)


def _own_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != PLACE]


def _digest_counts(df: DataFrame) -> DataFrame:
    return df.select(row_digest(df).alias("digest")).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies")
    )


def dedup_postings(df: DataFrame) -> DataFrame:
    """One of each set of equal rows, nulls being equal; the first one, if rows know their
    places in the files.

    Digests are counted first.  Rows whose digest stands once, most of them, pass
    through where they are; only those that may have a copy are regrouped whole,
    copies folding within each task before the shuffle.
    """
    repeated = _digest_counts(df).where(F.col("copies") > 1).select("digest")
    flagged = marked(df, member_bits(repeated), row_digest(df), _REPEATS)
    once = flagged.where(~F.col(_REPEATS)).drop(_REPEATS)
    able = flagged.where(_REPEATS).drop(_REPEATS)
    if PLACE not in df.columns:
        return once.unionAll(able.dropDuplicates())
    first = able.groupBy(*[f"`{c}`" for c in _own_columns(df)]).agg(F.min(PLACE).alias(PLACE))
    return once.unionByName(first)


def dedup_counts(df: DataFrame) -> DataFrame:
    """Row numbers before and after dedup; only digests move."""
    return _digest_counts(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_loaded"),
        F.count(F.lit(1)).alias("rows_after_dedup"),
    )


def input_profile(df: DataFrame) -> DataFrame:
    """One row per input column: position, name, row and null counts."""
    names = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.col(c).alias("null_count"),
            )
            for i, c in enumerate(names)
        ]
    )
    return counts.select("row_count", F.inline(rows)).select(
        "position", "column_name", "row_count", "null_count"
    )


def description_samples(df: DataFrame, rows: int = 2, chars: int = 1000) -> DataFrame:
    """The report's look at the first descriptions: word count and opening text."""
    from adsift.functions.text import count_blank_separated, text_of

    if "job_description" not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "job_id bigint, word_count int, sample string"
        )
    text = text_of(F.col("job_description"))
    return (
        df.select("job_id", "job_description")
        .orderBy("job_id")
        .limit(rows)
        .select(
            "job_id",
            count_blank_separated(text).alias("word_count"),
            F.substring(text, 1, chars).alias("sample"),
        )
    )
