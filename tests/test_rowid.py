"""Row numbers over several buckets, with unique, string and heavily repeated leading keys."""

import pytest
from pyspark.sql import functions as F

from nearspark.operators.rowid import row_at_position, with_row_id


def check(df, cols, **kw):
    got = [tuple(r) for r in with_row_id(df, cols, **kw).select("row_id", *cols).orderBy("row_id").collect()]
    want = [(i, *tuple(r)) for i, r in enumerate(df.select(*cols).orderBy(*cols).collect())]
    assert got == want


@pytest.mark.parametrize("rows_per_bucket", [10_000, 300, 7])
def test_orders_match_a_global_sort(spark, rows_per_bucket):
    df = spark.range(2000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50).alias("hot"),
        F.md5(F.col("id").cast("string")).alias("text"),
        F.timestamp_seconds(F.col("id") * 1000).alias("ts"),
        (F.col("id") / 7).alias("real"),
    )
    check(df, ["id"], rows_per_bucket=rows_per_bucket)
    check(df, ["hot", "id"], rows_per_bucket=rows_per_bucket)
    check(df, ["text"], rows_per_bucket=rows_per_bucket)
    check(df, ["real", "ts"], rows_per_bucket=rows_per_bucket)
    check(df, ["ts"], rows_per_bucket=rows_per_bucket)


def test_empty_table(spark):
    assert with_row_id(spark.range(0), ["id"]).count() == 0


def test_buckets_of_a_hot_leading_value_stay_small(spark):
    df = spark.range(3000).select(F.lit(1).alias("hot"), "id")
    numbered = with_row_id(df, ["hot", "id"], rows_per_bucket=300)
    assert numbered.count() == 3000
    check(df, ["hot", "id"], rows_per_bucket=300)


def test_row_at_position_is_the_row_with_that_number(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("a"), "id")
    want = {r["row_id"]: (r["a"], r["id"]) for r in with_row_id(df, ["a", "id"], rows_per_bucket=90).collect()}
    for position in (0, 89, 90, 500, 999):
        found = row_at_position(df, position, ["a", "id"], rows_per_bucket=90).collect()
        assert [(r["row_id"], r["a"], r["id"]) for r in found] == [(position, *want[position])]
    assert row_at_position(df, 1000, ["a", "id"], rows_per_bucket=90).count() == 0
    assert row_at_position(df.where("false"), 0, ["a", "id"]).count() == 0


def test_numbers_are_joined_without_moving_the_table(spark):
    """The sizes of the buckets, one row each, go to the table; only the wanted columns are written."""
    df = spark.range(500).selectExpr("id * 7 % 500 AS a", "id AS b", "id + 1 AS c", "'x' AS d")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = with_row_id(df, ["a"], rows_per_bucket=100, keep=["c"])
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got.columns == ["c", "row_id"]
    want = {r["a"]: r["c"] for r in df.collect()}
    assert {r["row_id"]: r["c"] for r in got.collect()} == want
