"""CSV records whose quoted fields span lines, read in as many tasks as the files have splits.

A split of a file does not tell whether it begins inside a quoted field; Spark's own reader
takes such files as one task each.  But a line break ends a record just if the quotes
before it are even in number, and doubled quotes do not change that.  So a first pass counts
the quotes of each split, and the parity of all earlier splits of the file, a prefix XOR
over one row for each split, tells where each split begins.  A second pass then strings the
lines of each split together to records.  Only records that reach over a split's end, one for
each split at most, are put together from their parts in a shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adsift.sources.storage import stage

_WHOLE, _OPEN, _REST = 0, 1, 2
_PARTS = "path string, start long, row long, kind int, text string"
_ARROW = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]
)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), "value"
    )


def _inside(lines: DataFrame) -> DataFrame:
    """``(path, start, inside)``: whether a split begins inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    return odd.select("path", "start", (before == 1).alias("inside"))


def _strung(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a task's splits, which come one after the other, line by line.

    What is left at the end of a split is ``_OPEN``, or ``_REST`` if no record began in it;
    ``_REST`` is also what comes before the first record.
    """
    split, held, out = None, [], []

    def close(kind: int) -> None:
        if held:
            out.append((*split, first, kind, "\n".join(held)))
            held.clear()

    for batch in batches:
        for path, start, value, inside in zip(*(c.to_pylist() for c in batch.columns)):
            if split != (path, start):
                close(_REST if rest else _OPEN) if split else None
                split, row, first, rest, within = (path, start), 0, 0, inside, inside
            held.append(value)
            within ^= value.count('"') % 2 == 1
            row += 1
            if not within:
                close(_REST if rest else _WHOLE)
                first, rest = row, False
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in out], _ARROW)
        out.clear()
    if split:
        close(_REST if rest else _OPEN)
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in out], _ARROW)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, start, row, record)``: the text of each record and its place, which orders the
    records of a file; blank lines are none."""
    lines = _lines(spark, path)
    # One row for each split.
    states = stage(_inside(lines), "csv-splits")
    known = lines.join(F.broadcast(states), ["path", "start"])
    parts = stage(
        known.select("path", "start", "value", "inside").mapInArrow(_strung, _PARTS), "csv-records"
    )
    order = Window.partitionBy("path").orderBy("start", "row")
    begun = F.sum((F.col("kind") == _OPEN).cast("int")).over(order)
    pieces = F.sort_array(F.collect_list(F.struct("start", "row", "text")))
    joined = (
        parts.where(F.col("kind") != _WHOLE)
        .withColumn("record", begun)
        .groupBy("path", "record")
        .agg(pieces.alias("pieces"))
        .select(
            "path",
            F.col("pieces")[0]["start"].alias("start"),
            F.col("pieces")[0]["row"].alias("row"),
            F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("record"),
        )
    )
    whole = parts.where(F.col("kind") == _WHOLE).select("path", "start", "row", F.col("text").alias("record"))
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.where(F.trim("record") != "")


def read_csv(spark: SparkSession, path: str | list[str], place: str | None = None) -> DataFrame:
    """A table of text columns, as Spark's reader makes it with ``header``, ``multiLine`` and
    doubled quotes; ``place`` names a further column with each row's place in the files.

    Each file begins with the header.  Files without one are no table.
    """
    records = csv_records(spark, path)
    first = Window.partitionBy("path").orderBy("start", "row")
    heads = records.where((F.col("start") == 0) & (F.col("row") < 100))
    heads = stage(heads.withColumn("n", F.row_number().over(first)).where("n = 1"), "csv-headers")
    header = heads.orderBy("path").first()
    if header is None:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader([header["record"]]))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("record", schema, {"escape": '"', "multiLine": "true"})
    keys = ["path", "start", "row"]
    rows = records.join(F.broadcast(heads.select(keys)), keys, "left_anti")
    columns = [F.col("fields")[n].alias(n) for n in names]
    if place:
        columns.append(F.struct(*keys).alias(place))
    return rows.select(*keys, parsed.alias("fields")).select(*columns)
