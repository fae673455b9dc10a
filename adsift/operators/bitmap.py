"""Membership tests that are never wrongly false.

What they wrongly let through costs work in the exact step that has to follow, and
changes nothing in its result; so there is one plan for sets of every size.

``member_bits`` makes a staged table of bits, some for each member, cut into blocks of
1 KB; ``marked`` joins each row with the one block that its value belongs to.  Plans
hold the table's path, not its bits, and no bit passes the driver.  The table is broadcast
and its size is bounded: up to ``MOST_BLOCKS`` blocks, 64 MB or 53 million members, some
3 % of strangers pass, beyond that more.

``bitmap_of`` is a constant of 128 KB for tests inside arrays, where a join would have to
take the arrays apart.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.sources.storage import stage

#: Bits for each member, of which two are set.
BITS_EACH = 10
#: Bits of a block as a power of two; a value's block and both its bits come from one hash.
_BLOCK = 13
#: Blocks of the largest table, 64 MB.
MOST_BLOCKS = 1 << 16

#: 16,384 longs.
BITMAP_BITS = 1 << 20


def constant_longs(values: list[int]) -> Column:
    """An array as one constant, which the optimizer folds; thousands of literals
    would not do."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def collected_bitmap(bit_rows: DataFrame, bits: int) -> list[int]:
    """The bits of column ``bit`` as longs; ``bits`` / 64 rows come to the driver."""
    cells = bit_rows.groupBy(F.expr("int(bit div 64)").alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(bit % 64))"))
    )
    dense = [0] * (bits // 64)
    for cell, value in cells.collect():
        dense[cell] = value
    return dense


def bit_is_set(bitmap: Column, bit: Column) -> Column:
    cell = F.get(bitmap, F.call_function("shiftright", bit, F.lit(6)).cast("int"))
    return F.getbit(cell, bit.bitwiseAND(F.lit(63)).cast("int")) == 1


def bit_of(value: Column, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits).cast("long"))


def bitmap_of(values: DataFrame, bits: int = BITMAP_BITS) -> Column:
    """The bitmap of the first column of a table."""
    known = values.select(bit_of(F.col(values.columns[0]), bits).alias("bit"))
    return constant_longs(collected_bitmap(known, bits))


class MemberBits(NamedTuple):
    """The staged blocks ``(block, cells)`` of a set, and their number."""

    table: DataFrame
    blocks: int


def _block_of(hashed: Column, blocks: int) -> Column:
    return F.call_function("shiftrightunsigned", hashed, F.lit(2 * _BLOCK)) % blocks


def _bits_of(hashed: Column) -> list[Column]:
    inside = F.lit((1 << _BLOCK) - 1)
    return [
        F.call_function("shiftrightunsigned", hashed, F.lit(at)).bitwiseAND(inside).cast("int")
        for at in (0, _BLOCK)
    ]


def member_bits(members: DataFrame, most_blocks: int = MOST_BLOCKS) -> MemberBits:
    """The bits of the first column of a table, sized by its rows.

    Repeated members do no harm; a null is a member like others.  Without members
    the table is empty.
    """
    hashes = stage(members.select(F.xxhash64(members.columns[0]).alias("h")), "member-hashes")
    blocks = min(max(1, -(-hashes.count() * BITS_EACH >> _BLOCK)), most_blocks)
    bit = F.col("bit")
    cells = (
        hashes.select(_block_of(F.col("h"), blocks).alias("block"), F.explode(F.array(*_bits_of(F.col("h")))).alias("bit"))
        .groupBy("block", F.call_function("shiftright", bit, F.lit(6)).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("word"))
    )
    # A block has at most 128 cells.
    by_cell = cells.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("cell", "word"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit((1 << _BLOCK - 6) - 1))
    dense = F.transform(places, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0).cast("long")))
    return MemberBits(stage(by_cell.select("block", dense.alias("cells")), "member-bits"), blocks)


def marked(df: DataFrame, bits: MemberBits, asked: Column, name: str) -> DataFrame:
    """``df`` with a column ``name``: whether the set may hold the value.

    An equi-join with the broadcast blocks; rows stay where they are, once each.
    """
    taken = {c.lower() for c in [*df.columns, name]}
    block, cells, hashed = "_block", "_cells", "_hashed"
    while taken & {block, cells, hashed}:
        block, cells, hashed = block + "_", cells + "_", hashed + "_"
    kept = [F.col(f"`{c}`") for c in df.columns]
    joined = (
        df.withColumn(hashed, F.xxhash64(asked))
        .withColumn(block, _block_of(F.col(hashed), bits.blocks))
        .join(F.broadcast(bits.table.toDF(block, cells)), block, "left")
    )
    hit = F.lit(True)
    for bit in _bits_of(F.col(hashed)):
        cell = F.get(F.col(cells), F.call_function("shiftright", bit, F.lit(6)))
        hit = hit & (F.getbit(cell, bit.bitwiseAND(F.lit(63))) == 1)
    return joined.select(*kept, F.coalesce(hit, F.lit(False)).alias(name))
