"""Dictionary encoding of categorical values and labels.

A dictionary is a written table, found in one pass over the data. The joins carry no broadcast hint: Spark knows the
size of the table when it plans the join, and broadcasts a small one without shuffling the data first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.operators.rowid import with_row_id
from nearspark.session import cut_lineage

UNSEEN = -1
UNKNOWN = "unknown"


def attribute_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values ``(name, value)`` of each column."""
    if len(columns) == 1:
        named = df.select(F.col(columns[0]).cast("string").alias("value"))
        return named.where(F.col("value").isNotNull()).distinct().select(F.lit(columns[0]).alias("name"), "value")
    named = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*named))).where(F.col("value").isNotNull()).distinct()


def build_dictionary(df: DataFrame, columns: list[str], window_rows: int = 200_000) -> DataFrame:
    """``(name, value, code)`` with codes 0, 1, ... per column by ascending value."""
    values = cut_lineage(attribute_values(df, columns))
    if values.count() <= window_rows:
        code = F.row_number().over(Window.partitionBy("name").orderBy("value")) - 1
        return values.select("name", "value", code.alias("code"))
    numbered = with_row_id(values, ["name", "value"])  # more values than one task should sort
    first = numbered.groupBy("name").agg(F.min("row_id").alias("first"))  # one row per column
    coded = numbered.join(F.broadcast(first), "name")
    return coded.select("name", "value", (F.col("row_id") - F.col("first")).cast("int").alias("code"))


def label_dictionary(df: DataFrame, label: str) -> DataFrame:
    """``(label, code)`` of the label column."""
    return build_dictionary(df, [label]).select(F.col("value").alias("label"), "code")


def encode(df: DataFrame, dictionary: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add code columns ``{source: target}``; a value that is not in the dictionary gets -1."""
    for source, target in columns.items():
        codes = dictionary.where(F.col("name") == source).select(
            F.col("value").alias("__value"), F.col("code").alias(target)
        )
        df = df.join(codes, F.col(source).cast("string") == F.col("__value"), "left").drop("__value")
        df = df.withColumn(target, F.coalesce(target, F.lit(UNSEEN)))
    return df


def encode_label(df: DataFrame, labels: DataFrame, label: str = "label", target: str = "label_code") -> DataFrame:
    """Add the code of a label from a ``(label, code)`` dictionary, -1 when it is not listed."""
    codes = labels.select(F.col("label").alias("__label"), F.col("code").alias(target))
    df = df.join(codes, F.col(label) == F.col("__label"), "left").drop("__label")
    return df.withColumn(target, F.coalesce(target, F.lit(UNSEEN)))


def decode_label(df: DataFrame, labels: DataFrame, code: str, target: str = "label") -> DataFrame:
    """Add the label of a code; a NaN code, which stands for no prediction, becomes ``unknown``."""
    number = F.col(code).cast("double")
    names = labels.select(F.col("label").alias("__label"), F.col("code").cast("double").alias("__code"))
    df = df.join(names, number == F.col("__code"), "left")
    return df.withColumn(target, F.when(F.isnan(number), UNKNOWN).otherwise(F.col("__label"))).drop("__label", "__code")


def recode(df: DataFrame, from_labels: DataFrame, to_labels: DataFrame, code: str, target: str) -> DataFrame:
    """Translate codes of one dictionary into codes of another through the label string; -1 where either lacks it."""
    both = from_labels.select("label", F.col("code").alias("__from")).join(
        to_labels.select("label", F.col("code").alias(target)), "label", "left"
    )
    pairs = both.select("__from", F.coalesce(target, F.lit(UNSEEN)).alias(target))
    joined = df.join(pairs, F.col(code) == F.col("__from"), "left").drop("__from")
    return joined.withColumn(target, F.coalesce(target, F.lit(UNSEEN)))


def number_of_values(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("name").agg(F.count("*").alias("n_values"))

