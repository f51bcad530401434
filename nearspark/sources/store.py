"""Saved tables: dataset descriptions, reduced sets, predictions and reports. Nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.operators.evaluate import accuracy, confusion_matrix
from nearspark.operators.profile import profile_table
from nearspark.operators.roles import Attributes


def save_table(df: DataFrame, path: str) -> None:
    """Write as Parquet; an existing output is an error."""
    df.write.mode("errorifexists").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_description(df: DataFrame, attributes: Attributes, path: str) -> None:
    """Profile of a table with its roles, value lists, row count and whether the label is a number."""
    save_table(profile_table(df, attributes).withColumn("regression", F.lit(attributes.regression)), path)


def load_description(spark: SparkSession, path: str) -> tuple[Attributes, DataFrame, int]:
    """Attributes, dictionary ``(name, value, code)`` and row count of a saved description."""
    saved = load_table(spark, path)
    declared = saved.select("attr", "name", "role", "n_rows", "regression").distinct().orderBy("attr").collect()  # the columns
    attributes = Attributes(tuple(r["name"] for r in declared), tuple(r["role"] for r in declared), declared[0]["regression"])
    return attributes, saved.where("code IS NOT NULL").select("name", "value", "code"), declared[0]["n_rows"]


def save_predictions(predictions: DataFrame, path: str) -> None:
    """Text file rows ``qid, actual, predicted`` with a header line, in query order across the part files."""
    ordered = predictions.select("qid", "actual", "predicted").orderBy("qid")
    ordered.write.mode("errorifexists").csv(path, header=True)


def save_predictions_by_file(predictions: DataFrame, path: str, order_col: str = "qid") -> None:
    """One folder per input file, records in their order. A large input is spread over several part files."""
    ranged = predictions.repartitionByRange("input_file", order_col).sortWithinPartitions("input_file", order_col)
    ranged.write.mode("errorifexists").partitionBy("input_file").parquet(path)


def save_report(predictions: DataFrame, codes: list[int], path: str) -> None:
    """Confusion matrix and accuracy of saved predictions, one small file each."""
    confusion_matrix(predictions, codes).orderBy("predicted").coalesce(1).write.mode("errorifexists").csv(
        f"{path}/confusion", header=True
    )
    accuracy(predictions).coalesce(1).write.mode("errorifexists").json(f"{path}/accuracy")

