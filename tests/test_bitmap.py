"""Membership tests: never wrongly false, seldom wrongly true, sized by the set."""

import pytest
from pyspark.sql import functions as F

from adsift.operators import bitmap


def passed(spark, bits, start, n):
    asked = spark.range(start, start + n)
    return bitmap.marked(asked, bits, F.col("id"), "hit").where("hit").count()


@pytest.mark.parametrize("n", [1, 1000, 3_000_000])
def test_members_pass_and_few_strangers(spark, n):
    bits = bitmap.member_bits(spark.range(n))
    assert passed(spark, bits, 0, n) == n
    assert passed(spark, bits, 10_000_000, 200_000) < 0.05 * 200_000
    assert bits.blocks == max(1, -(-n * bitmap.BITS_EACH // 8192))


def test_a_set_beyond_the_largest_table_is_still_never_wrongly_false(spark):
    bits = bitmap.member_bits(spark.range(100_000), most_blocks=2)
    assert bits.table.count() <= 2
    assert passed(spark, bits, 0, 100_000) == 100_000


def test_no_members_nulls_repeated_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(None, "a", 1), (5, "b", 2), (5, "b", 2), (7, None, 3)], "_block long, _cells string, `_hashed` int")
    asked = F.col("_block")
    none = bitmap.marked(rows, bitmap.member_bits(rows.select("_block").limit(0)), asked, "hit")
    assert none.columns == ["_block", "_cells", "_hashed", "hit"]
    assert none.count() == 4 and none.where("hit").count() == 0
    members = rows.where("_hashed < 3").select("_block")
    found = bitmap.marked(rows, bitmap.member_bits(members), asked, "hit").orderBy("_hashed").collect()
    assert [r["hit"] for r in found] == [True, True, True, False]
    assert [r["_cells"] for r in found] == ["a", "b", "b", None]


def test_the_plan_is_a_broadcast_join_without_moving_rows(spark):
    bits = bitmap.member_bits(spark.range(100))
    plan = bitmap.marked(spark.range(1000), bits, F.col("id"), "hit")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
