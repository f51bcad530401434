"""Dense row numbers for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.session import cut_lineage

OFFSET_BITS = 33  # fixed value: the low bits of monotonically_increasing_id are the place inside a partition
ROWS_PER_BUCKET = 200_000


def _ordered_buckets(df: DataFrame, order_cols: list[str], rows_per_bucket: int) -> DataFrame:
    """Spark's range partitioning: ordered buckets, as many as the table needs, cut by whole keys."""
    return df.repartitionByRange(max(1, -(-df.count() // rows_per_bucket)), *order_cols)


def with_row_id(
    df: DataFrame,
    order_cols: list[str],
    name: str = "row_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_cols``, which must be unique and not NULL.

    The table is cut into ordered buckets by whole keys, so a frequent leading value is split as well. The sorted
    buckets are written with each row's place, and shifted by the sizes of the earlier ones. The numbers are read from
    the written table, so re-running a lost task cannot change one. ``keep`` lists the columns wanted beside the number;
    others are left out before the table is moved or written.
    """
    if keep is not None:
        df = df.select(*dict.fromkeys([*order_cols, *keep]))
    ordered = _ordered_buckets(df, order_cols, rows_per_bucket).sortWithinPartitions(*order_cols)
    if keep is not None:
        ordered = ordered.select(*keep)
    placed = cut_lineage(ordered.withColumn("__place", F.monotonically_increasing_id()))
    return shift_by_part(placed, name)


def row_at_position(
    df: DataFrame, position: int, order_cols: list[str], name: str = "row_id", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The row that ``with_row_id`` would give this number. The buckets' sizes say which one holds it; only that one is sorted."""
    ordered = _ordered_buckets(df, order_cols, rows_per_bucket)
    placed = cut_lineage(ordered.withColumn("__part", F.spark_partition_id()))
    starts = _starts(placed.groupBy("__part").agg(F.count("*").alias("n")))
    holds = (F.col("__start") <= position) & (F.lit(position) < F.col("__start") + F.col("n"))
    one = placed.join(F.broadcast(starts.where(holds)), "__part")  # one row
    inside = Window.partitionBy("__part", "__start").orderBy(*order_cols)
    numbered = one.withColumn(name, F.col("__start") + F.row_number().over(inside) - 1)
    return numbered.where(F.col(name) == position).drop("__part", "__start", "n")


def _starts(sizes: DataFrame) -> DataFrame:
    """Add the number of rows in earlier parts to ``(__part, n)``, a table with one row per partition."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def shift_by_part(placed: DataFrame, name: str) -> DataFrame:
    """Dense numbers from a written ``__place`` (partition and place inside it, as Spark numbers them)."""
    part = F.shiftright("__place", OFFSET_BITS)
    starts = _starts(placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))).drop("n")
    inside = F.col("__place").bitwiseAND((1 << OFFSET_BITS) - 1)
    # one row a bucket: Spark doesn't know how few these are and would shuffle the whole table
    numbered = placed.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, F.col("__start") + inside)
    return numbered.drop("__place", "__part", "__start")
