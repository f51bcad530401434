"""End-to-end jobs: classify by k nearest neighbours, score against a reduced set, reduce and score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearspark.functions.vectors import features_of
from nearspark.operators.encode import UNSEEN, build_dictionary, encode, encode_label
from nearspark.operators.knn import KnnLimits, nearest_lists
from nearspark.operators.reduction import reduce_training
from nearspark.operators.roles import Attributes
from nearspark.operators.vote import majority_of
from nearspark.session import cut_lineage
from nearspark.sources.store import save_predictions, save_predictions_by_file, save_report, save_table
from nearspark.sources.text import parse_lines


def classify_knn(
    train: DataFrame,
    test: DataFrame,
    k: int,
    *,
    id_col: str = "id",
    features: str = "features",
    label: str = "label",
    vote: str = "majority",
    missing_class: int | None = None,
    carry: Sequence[str] = (),
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
) -> DataFrame:
    """``(qid, *carry, actual, predicted)`` for every test row, by majority among its ``k`` nearest training rows.

    ``label`` holds integer class codes; training rows without one do not vote. A test row without a complete vector
    keeps a NULL prediction. ``carry`` names further columns of ``test`` to keep.
    """
    train = train.where(F.col(label).isNotNull())
    near = nearest_lists(
        test, train, k, qid=id_col, tid=id_col, features=features, label=label, carry=[label, *carry], plan=plan,
        limits=limits,
    )
    top = majority_of(F.transform("neighbors", lambda e: e["label"]), vote)
    return _predictions(near, top["label"], train, label, missing_class, carry)


def _predictions(
    near: DataFrame, predicted: Column, train: DataFrame, label: str, missing_class: int | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    predicted = predicted.cast(train.schema[label].dataType)
    if missing_class is not None:
        predicted = F.coalesce(predicted, F.lit(missing_class))
    return near.select("qid", *carry, F.col(label).alias("actual"), predicted.alias("predicted"))


def instances(
    rows: DataFrame,
    attributes: Attributes,
    dictionary: DataFrame | None,
    labels: DataFrame,
    id_col: str = "id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(id, *carry, features, label)`` of parsed records: categories as dictionary codes, the label as its class code.

    A record with a missing input has no vector. A label that the classes do not list is NULL: it neither votes nor wins.
    """
    categories = [c for c in attributes.categorical if c != attributes.label]
    coded = encode(rows, dictionary, {c: f"{c}__code" for c in categories})
    coded = encode_label(coded, labels, attributes.label, "class__code")
    inputs = [
        F.when(F.col(c).isNotNull(), F.col(f"{c}__code")) if c in categories else F.col(c) for c in attributes.inputs
    ]
    listed = F.when(F.col("class__code") != UNSEEN, F.col("class__code"))
    return coded.select(id_col, *carry, features_of(*inputs).alias("features"), listed.alias("label"))


def classify_text(
    train_lines: DataFrame,
    test_lines: DataFrame,
    attributes: Attributes,
    labels: DataFrame,
    k: int,
    *,
    id_col: str = "id",
    drop_missing: bool = False,
    mode: str = "dropmalformed",
    carry: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Classify records of delimited text ``(id, value)``, as ``read_lines`` gives them; ``labels`` is the class dictionary.

    Training records with a missing value, or of a class that is not listed, are dropped (the latter end the job with
    ``mode="failfast"``). Test records with a missing value stay without a prediction, unless ``drop_missing``.
    ``carry`` names columns of the test lines to keep, such as ``input_file``.
    """
    train = parse_lines(train_lines, attributes, mode=mode)
    test = parse_lines(test_lines, attributes, keep_missing=not drop_missing)
    categories = [c for c in attributes.categorical if c != attributes.label]
    dictionary = build_dictionary(train, categories) if categories else None
    known = instances(train, attributes, dictionary, labels, id_col)
    if mode == "failfast":
        unlisted = F.raise_error(F.concat(F.lit("class not listed, record "), F.col(id_col).cast("string")))
        known = known.withColumn("label", F.coalesce("label", unlisted.cast("int")))
    asked = instances(test, attributes, dictionary, labels, id_col, carry)
    return classify_knn(known, asked, k, id_col=id_col, carry=carry, **options)


def classify_text_1nn(
    test_lines: DataFrame,
    attributes: Attributes,
    dictionary: DataFrame | None,
    labels: DataFrame,
    reduced: DataFrame,
    *,
    id_col: str = "id",
    drop_missing: bool = False,
    carry: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Score text on a saved reduced set: new records are coded by the saved dictionary, as the set was.

    ``attributes`` and ``dictionary`` come from ``load_description``. A value that the dictionary does not have is -1.
    """
    test = parse_lines(test_lines, attributes, keep_missing=not drop_missing)
    asked = instances(test, attributes, dictionary, labels, id_col, carry)
    return classify_1nn(asked, reduced, id_col=id_col, carry=carry, **options)


def classify_1nn(
    test: DataFrame,
    reduced: DataFrame,
    *,
    id_col: str = "id",
    features: str = "features",
    label: str = "label",
    carry: Sequence[str] = (),
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
) -> DataFrame:
    """``(qid, *carry, actual, predicted)``: each test row gets the class of its nearest prototype ``(pid, features, label)``."""
    train = reduced.select("pid", F.col("features").alias(features), F.col("label").alias(label))
    near = nearest_lists(
        test, train, 1, qid=id_col, tid="pid", features=features, label=label, carry=[label, *carry], plan=plan,
        limits=limits,
    )
    return _predictions(near, F.try_element_at("neighbors", F.lit(1))["label"], train, label, carry=carry)


def reduce_then_classify(
    train: DataFrame,
    test: DataFrame,
    method: str,
    *,
    by: str | None = None,
    save_to: str | None = None,
    max_rounds: int | None = None,
    id_col: str = "id",
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
) -> DataFrame:
    """Reduce the prototypes ``(pid, [stratum], features, label, weight)``, save them, and score the test rows on them."""
    reduced = reduce_training(train, method, by, max_rounds=max_rounds, plan=plan, limits=limits)
    if save_to is None:
        reduced = cut_lineage(reduced)
    else:
        save_table(reduced, save_to)
        reduced = train.sparkSession.read.parquet(save_to)
    return classify_1nn(test, reduced, id_col=id_col, plan=plan, limits=limits)


def run_classification(train: DataFrame, test: DataFrame, k: int, codes: list[int], output: str, **options) -> DataFrame:
    """Classify, write predictions, confusion matrix and accuracy below ``output``, and return the predictions."""
    save_table(classify_knn(train, test, k, **options), f"{output}/predictions")
    predictions = train.sparkSession.read.parquet(f"{output}/predictions")
    save_predictions(predictions, f"{output}/predictions_text")
    save_report(predictions, codes, f"{output}/report")
    return predictions


def run_scoring(
    test: DataFrame, reduced: DataFrame, codes: list[int], output: str, *, file_col: str = "input_file", order_col: str | None = None, **options
) -> DataFrame:
    """Score on a saved reduced set, write predictions per input file, confusion matrix and accuracy below ``output``, and
    return the predictions with their file. ``order_col`` numbers the records of a file (default: the id)."""
    carry = [file_col, *([order_col] if order_col else [])]
    found = classify_1nn(test, reduced, carry=carry, **options).withColumnRenamed(file_col, "input_file")
    save_predictions_by_file(found, f"{output}/predictions", order_col or "qid")
    predictions = test.sparkSession.read.parquet(f"{output}/predictions")
    save_report(predictions, codes, f"{output}/report")
    return predictions
