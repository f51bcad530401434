"""Row predicates and look-ups on a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearspark.operators.rowid import row_at_position


def equals(column: str, value) -> Column:
    return F.col(column) == value


def lesser(column: str, value) -> Column:
    return F.col(column) < value


def greater_or_equal(column: str, value) -> Column:
    return F.col(column) >= value


def subset(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that satisfy any Spark condition."""
    return df.where(condition)


def contains_rows(df: DataFrame, probes: DataFrame, columns: list[str]) -> DataFrame:
    """Probe rows that occur in the table with equal values (NULL equals NULL) in all the columns."""
    table = df.select(*[F.col(c).alias(f"__{c}") for c in columns])
    asked = probes.select(*[F.col(c).alias(f"___{c}") for c in columns]).distinct()

    def same(left: str, right: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(left + c).eqNullSafe(F.col(right + c)) for c in columns])

    # the table is reduced by the probes first, so few probes are broadcast and the table stays where it is
    present = table.join(asked, same("__", "___"), "left_semi").distinct()
    return probes.join(present, same("", "__"), "left_semi")


def row_at(df: DataFrame, position: int, order_cols: list[str]) -> DataFrame:
    """The row at a 0-based position of the given order, with the position as ``row_id``."""
    return row_at_position(df, position, order_cols)


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("is_empty", F.col("n_rows") == 0)
