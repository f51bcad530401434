"""Evaluation of predictions ``(qid, actual, predicted)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_truth(
    truth: DataFrame, predictions: DataFrame, qid: str, actual: str, missing_class: int | None = None
) -> DataFrame:
    """``(qid, actual, predicted)`` for every truth row; without a prediction NULL, or ``missing_class``."""
    found = predictions.select(F.col("qid").alias("__qid"), F.col("predicted").alias("__predicted"))
    predicted = F.col("__predicted")
    if missing_class is not None:
        predicted = F.coalesce(predicted, F.lit(missing_class))
    joined = truth.join(found, F.col(qid) == F.col("__qid"), "left")
    return joined.select(F.col(qid).alias("qid"), F.col(actual).alias("actual"), predicted.alias("predicted"))


def ordered(predictions: DataFrame) -> DataFrame:
    """Predictions by ascending query number; sort only where the order is written out."""
    return predictions.orderBy("qid")


def class_codes(labels: DataFrame) -> list[int]:
    """Class codes of a dictionary, for the columns of a confusion matrix."""
    return [r["code"] for r in labels.select("code").distinct().orderBy("code").collect()]


def confusion_long(predictions: DataFrame, codes: list[int]) -> DataFrame:
    """``(predicted, actual, n)`` over all pairs of classes and NULL, zero-filled; ``n`` sums to the predictions.

    A class that is not in ``codes``, or none at all, counts as NULL.
    """
    spark = predictions.sparkSession
    listed = [F.when(F.col(c).isin(codes), F.col(c)).cast("int").alias(f"__{c}") for c in ("predicted", "actual")]
    counts = predictions.select(*listed).groupBy("__predicted", "__actual").agg(F.count("*").alias("__n"))
    # the driver lists each class once; tasks write the pairs
    axis = F.array_append(F.filter(F.split(F.lit(",".join(map(str, codes))), ","), lambda c: c != "").cast("array<int>"), F.lit(None))
    grid = spark.createDataFrame([(c,) for c in [*codes, None]], "predicted int").withColumn("actual", F.explode(axis))
    same = F.col("predicted").eqNullSafe(F.col("__predicted")) & F.col("actual").eqNullSafe(F.col("__actual"))
    return grid.join(counts, same, "left").select("predicted", "actual", F.coalesce("__n", F.lit(0)).alias("n"))


def confusion_matrix(predictions: DataFrame, codes: list[int]) -> DataFrame:
    """One row per predicted class and one for NULL; one column per actual class and ``none`` for NULL."""
    column = F.coalesce(F.col("actual").cast("string"), F.lit("none"))
    cells = confusion_long(predictions, codes).withColumn("actual", column)
    return cells.groupBy("predicted").pivot("actual", [*map(str, codes), "none"]).agg(F.sum("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """``(n, correct, accuracy)``; a query without a prediction counts as wrong."""
    hit = F.coalesce(F.col("predicted") == F.col("actual"), F.lit(False))
    return _share(predictions, hit)


def accuracy_labels(predictions: DataFrame) -> DataFrame:
    """Accuracy on label strings, compared without regard to case."""
    hit = F.coalesce(F.lower("predicted") == F.lower("actual"), F.lit(False))
    return _share(predictions, hit)


def _share(df: DataFrame, hit: Column) -> DataFrame:
    found = df.agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"))
    return found.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("n").cast("double")))


def _recalls(predictions: DataFrame) -> DataFrame:
    """``recall0`` and ``recall1`` of a two-class prediction, and the ``positive`` class: the rarer one, 0 on equal counts.

    A class's size counts its actual rows, so a row without a prediction is a miss of its class.
    """
    sizes = [F.count_if(F.col("actual") == c).alias(f"size{c}") for c in (0, 1)]
    hits = [F.count_if((F.col("actual") == c) & (F.col("predicted") == c)).alias(f"hits{c}") for c in (0, 1)]
    counted = predictions.agg(*sizes, *hits)
    recalls = [F.try_divide(F.col(f"hits{c}").cast("double"), F.col(f"size{c}").cast("double")).alias(f"recall{c}") for c in (0, 1)]
    return counted.select((F.col("size1") < F.col("size0")).cast("int").alias("positive"), *recalls)


def binary_auc(predictions: DataFrame) -> DataFrame:
    """Area under the one-point ROC curve of a two-class prediction: the mean recall; NULL when a class has no rows."""
    return _recalls(predictions).select("positive", ((F.col("recall0") + F.col("recall1")) / 2).alias("auc"))


def binary_gmean(predictions: DataFrame) -> DataFrame:
    """Geometric mean of the two recalls."""
    return _recalls(predictions).select("positive", F.sqrt(F.col("recall0") * F.col("recall1")).alias("gmean"))
