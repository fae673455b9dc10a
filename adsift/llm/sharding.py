"""Sharding by extendible hashing.

Every row has a 64-bit hash of its content.  A bucket is a prefix of hash bits; it
is split on the next bit only if its rows exceed the byte limit, until every
bucket fits.  The sizes come from one histogram over the leading bits, folded in
each task, and its sums over shorter prefixes.  Buckets that are still too large
at the histogram's depth are counted by their rows' full hashes, which only such
rows reach.  The directory then names, for each value of the leading bits, the
bucket that it points to; many entries may point to one.

Rows with equal id and text share all hash bits, so no bit splits them; those that
are equal in every column are counted, and the copies of all dealt to overflow
shards, one such group of rows after the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import own_columns, private, stage
from adsift.operators.ordered import running_totals

LIMIT = 64 << 20
#: Bits of a row's hash, so that it stays a positive number.
HASH_BITS = 60
#: Bits that the histogram has beyond those that shards of equal size would need.
SLACK_BITS = 4
MOST_BITS = 24


def row_hash(docs: DataFrame) -> Column:
    """60 bits of a digest of id and text; equal rows are equal here."""
    own = own_columns(docs, doc_id="string", text="string")
    text = F.coalesce(F.md5(own["text"]), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(own["doc_id"], F.lit("")), text))
    return F.conv(F.left(digest, F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def row_bytes(docs: DataFrame) -> Column:
    text = own_columns(docs, text="string")["text"]
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _prefix(hashed: Column, bits: Column | int) -> Column:
    """The leading bits of a hash, as a number."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftright", hashed, (F.lit(HASH_BITS) - bits).cast("int"))


def _fitting_depths(cells: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """``(cell, depth)``: the shortest prefix of each cell that holds no more than
    the limit; null if all are too large.

    ``cells`` are ``(cell, bytes)``, a cell being a hash of which the leading
    ``last`` bits count.  A cell's prefixes are as many as there are depths.
    """
    tried = cells.select(
        "cell", "bytes", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")
    ).withColumn("prefix", _prefix(F.col("cell"), F.col("depth")))
    small = (
        tried.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("total"))
        .where(F.col("total") <= limit)
    )
    fits = tried.join(small, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(fits, "cell", "left")


def directory(rows: DataFrame, limit: int = LIMIT) -> tuple[int, DataFrame, DataFrame]:
    """The bits of the directory, its entries, and those of the deeper buckets.

    ``rows`` are ``(hash, bytes)``, one for each document, in a staged table.
    Entries are ``(cell, depth)``: the leading bits and the depth of the bucket
    that they point to, null where the rows' full hashes are looked up instead.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    top = _prefix(F.col("hash"), bits)
    back = F.call_function("shiftleft", top, F.lit(HASH_BITS - bits))
    cells = rows.groupBy(back.alias("cell")).agg(F.sum("bytes").alias("bytes"))
    entries = stage(_fitting_depths(stage(cells, "shard-cells"), 0, bits, limit), "shard-entries")
    large = entries.where(F.col("depth").isNull()).select("cell")
    deep = (
        rows.withColumn("cell", back)
        .join(large, "cell", "left_semi")
        .groupBy(F.col("hash").alias("cell"))
        .agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"))
    )
    deep = stage(deep, "shard-deep")
    depths = _fitting_depths(deep.select("cell", "bytes"), bits + 1, HASH_BITS, limit)
    deep = deep.select("cell", "most").join(depths, "cell")
    return bits, entries, stage(deep, "shard-deep-entries")


def _bucket(hashed: Column, depth: Column) -> Column:
    """The bits that all rows of a bucket share; one bucket for all has none."""
    bits = F.lpad(F.bin(_prefix(hashed, depth)), depth, F.lit("0"))
    return F.concat(F.lit("b"), F.when(depth == 0, F.lit("")).otherwise(bits))


def assign_shards(docs: DataFrame, limit: int = LIMIT, shard: str = "shard") -> DataFrame:
    """The rows of ``docs`` with the shard of each.

    No shard holds more than ``limit`` bytes of text, unless a single document
    does; that one is alone.  Null texts have 0 bytes.  Rows of equal id and text,
    whatever their other columns, that together exceed the limit go to shards
    ``...-0``, ``...-1`` and so on.
    """
    names = docs.columns
    h, b, cell, depth, deeper, most, copies, page, copy, group, upto = (
        private(docs, n)
        for n in (
            "_hash", "_bytes", "_cell", "_depth", "_deeper", "_most", "_copies", "_page", "_copy", "_group", "_upto"
        )
    )
    rows = stage(docs.select(row_hash(docs).alias("hash"), row_bytes(docs).alias("bytes")), "shard-rows")
    bits, entries, deep = directory(rows, limit)
    marked = docs.withColumns({h: row_hash(docs), b: row_bytes(docs)})
    top = F.call_function("shiftleft", _prefix(F.col(h), bits), F.lit(HASH_BITS - bits))
    entries = entries.select(F.col("cell").alias(cell), F.col("depth").alias(depth))
    placed = marked.withColumn(cell, top).join(entries, cell)
    by_hash = deep.select(F.col("cell").alias(h), F.col("depth").alias(deeper), F.col("most").alias(most))
    shallow = placed.where(F.col(depth).isNotNull())
    below = placed.where(F.col(depth).isNull()).join(by_hash, h)
    split = below.where(F.col(deeper).isNotNull())
    kept = [F.col(f"`{c}`") for c in names]
    out = shallow.select(*kept, _bucket(F.col(h), F.col(depth)).alias(shard)).unionAll(
        split.select(*kept, _bucket(F.col(h), F.col(deeper)).alias(shard))
    )
    if deep.where(F.col("depth").isNull()).isEmpty():
        return out
    # Equal rows fold to one with its count before they move, then come apart
    # again page by page, behind the copies of the groups before theirs.
    equal = stage(
        below.where(F.col(deeper).isNull())
        .groupBy(*kept, h, most)
        .agg(F.count(F.lit(1)).alias(copies))
        .withColumn(group, F.monotonically_increasing_id()),
        "shard-equal",
    )
    place = equal.select(
        F.col(h).alias("hash"), F.xxhash64(*kept).alias("digest"), F.col(group).alias("group"), F.col(copies).alias("n")
    )
    place = running_totals(place, [F.col("digest"), F.col("group")], {"upto": "n"}, by=("hash",))
    equal = equal.join(place.select(F.col("group").alias(group), F.col("upto").alias(upto)), group)
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col(most), F.lit(1))), F.lit(1))
    before = F.col(upto) - F.col(copies)
    equal = equal.withColumn(
        page, F.explode(F.sequence(F.floor(before / per_page), F.floor((F.col(upto) - 1) / per_page)))
    ).withColumn(
        copy,
        F.explode(
            F.sequence(
                F.greatest(F.col(page) * per_page, before) + 1,
                F.least((F.col(page) + 1) * per_page, F.col(upto)),
            )
        ),
    )
    named = F.concat(_bucket(F.col(h), F.lit(HASH_BITS)), F.lit("-"), F.col(page).cast("string"))
    return out.unionAll(equal.select(*kept, named.alias(shard)))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard, each written by one task."""
    sharded.repartition(shard).write.mode("overwrite").partitionBy(shard).parquet(path)
