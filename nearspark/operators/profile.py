"""Profiles of a labelled table: dictionary, ranges, label counts, homogeneity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.functions.vectors import draw
from nearspark.operators.encode import attribute_values, build_dictionary
from nearspark.operators.roles import Attributes

SUMS_AT_ONCE = 64  # positions of a vector that one aggregation sums


def profile_table(df: DataFrame, attributes: Attributes) -> DataFrame:
    """Dataset description ``(attr, name, role, value, code, n_rows)``.

    One row per value of a categorical attribute or label, one row with a NULL value per numerical or ignored attribute.
    """
    spark, n_rows = df.sparkSession, df.count()
    declared = spark.createDataFrame(
        list(zip(range(len(attributes.names)), attributes.names, attributes.roles)), "attr int, name string, role string"
    )
    values = build_dictionary(df, attributes.categorical)
    return declared.join(values, "name", "left").select(
        "attr", "name", "role", "value", "code", F.lit(n_rows).cast("bigint").alias("n_rows")
    )


def schema_summary(df: DataFrame, attributes: Attributes) -> DataFrame:
    """``(attr, name, role, n_values, n_rows)`` of the kept attributes, in one pass over the table."""
    rows = []
    for i, name, role in attributes.kept:
        value = F.col(name) if name in attributes.categorical else F.lit(None)
        entry = [F.lit(i).alias("attr"), F.lit(name).alias("name"), F.lit(role).alias("role")]
        rows.append(F.struct(*entry, value.cast("string").alias("value")))
    per_value = df.select(F.inline(F.array(*rows))).groupBy("attr", "name", "role", "value").count()
    return per_value.groupBy("attr", "name", "role").agg(
        F.count("value").alias("n_values"), F.sum("count").alias("n_rows")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of every column as rows ``(attr, name, min_value, max_value)``, from one aggregation.

    Adding 0 turns a negative zero into zero, which would otherwise depend on the order of the rows.
    """
    found = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("attr"),
                    F.lit(c).alias("name"),
                    (F.min(F.col(c).cast("double")) + 0.0).alias("min_value"),
                    (F.max(F.col(c).cast("double")) + 0.0).alias("max_value"),
                )
                for i, c in enumerate(columns)
            ]
        ).alias("r")
    )
    return found.select(F.inline("r"))


def is_identical(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Whether all rows agree in every column; true for an empty table. With ``by``, one row per group."""
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.min(c) == F.max(c), F.lit(True)) & F.count(c).isin(F.lit(0), F.count("*"))
    return (df.groupBy(*by) if by else df).agg(same.alias("is_identical"))


def is_identical_label(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    return is_identical(df, [label], by).withColumnRenamed("is_identical", "is_identical_label")


def label_counts(df: DataFrame, label: str, labels: DataFrame | None = None) -> DataFrame:
    """``(label, n)``; with a dictionary of labels, classes without rows are listed with 0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if labels is None:
        return counts
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def majority_label(df: DataFrame, label: str, tie_seed: int | None = None) -> DataFrame:
    """The most frequent label; the lowest one on ties, or one drawn by hash when ``tie_seed`` is given."""
    counts = label_counts(df, label)
    order = [-F.col("n"), F.col("label")] if tie_seed is None else [-F.col("n"), draw(tie_seed, "label"), F.col("label")]
    return counts.agg(F.min_by(F.struct("label", "n"), F.struct(*order)).alias("top")).select("top.label", "top.n")


def vector_sum(df: DataFrame, by: str, features: str = "features", dims: int | None = None) -> DataFrame:
    """Element-wise sum of the vectors of each group, which must have the same length; NULL vectors take no part.

    One sum for each position, all in one aggregation that combines before the shuffle; wider vectors than
    ``SUMS_AT_ONCE`` as several such blocks of positions. Without ``dims`` the length is read from the table first.
    """
    vectors = df.where(F.col(features).isNotNull()).select(F.col(by).alias("__by"), F.col(features).alias("__x"))
    if dims is None:
        dims = vectors.agg(F.max(F.size("__x"))).first()[0] or 0
    blocks = -(-dims // SUMS_AT_ONCE)
    keys, first = ["__by"], F.lit(0)
    if blocks > 1:
        vectors = vectors.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys, first = ["__by", "__block"], F.col("__block") * SUMS_AT_ONCE
    size = F.size("__x")
    sums = [F.sum(F.get("__x", first + i)).alias(f"__{i}") for i in range(min(dims, SUMS_AT_ONCE))]
    found = vectors.groupBy(*keys).agg(F.min(size).alias("__lo"), F.max(size).alias("__hi"), *sums).where("__hi > 0")
    whole = F.array(*[f"__{i}" for i in range(len(sums))]) if sums else F.array().cast("array<double>")
    if blocks > 1:
        part = F.struct("__block", whole.alias("sums"))
        found = found.groupBy("__by").agg(
            F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.array_sort(F.collect_list(part)).alias("__p")
        )
        whole = F.slice(F.flatten(F.transform("__p", lambda e: e["sums"])), 1, dims)
    # a group of shorter vectors than another group's: their sums end where they end
    uneven = F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")
    summed = F.when(F.col("__lo") == F.col("__hi"), F.slice(whole, F.lit(1), F.col("__hi"))).otherwise(uneven)
    return found.select(F.col("__by").alias(by), summed.alias("vector_sum"))


def validate(df: DataFrame, attributes: Attributes, dictionary: DataFrame) -> None:
    """Raise ``ValueError`` unless table, roles and dictionary ``(name, value, code)`` agree.

    The table has every kept column; every categorical attribute has values in the dictionary, with codes 0, 1, ...;
    and every value of the table is listed.
    """
    absent = [n for _, n, _ in attributes.kept if n not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} are declared but not in the table")
    per_name = {r["name"]: r for r in dictionary.groupBy("name").agg(
        F.count("*").alias("n"), F.countDistinct("code").alias("codes"), F.min("code").alias("lo"), F.max("code").alias("hi")
    ).collect()}  # fmt: skip  # one row per attribute
    for name in attributes.categorical:
        found = per_name.get(name)
        if found is None:
            raise ValueError(f"no values listed for {name!r}")
        if (found["lo"], found["hi"], found["codes"]) != (0, found["n"] - 1, found["n"]):
            raise ValueError(f"codes of {name!r} are not 0 to {found['n'] - 1}")
    used = attribute_values(df, attributes.categorical)
    unlisted = used.join(dictionary, ["name", "value"], "left_anti").first()
    if unlisted is not None:
        raise ValueError(f"value {unlisted['value']!r} of {unlisted['name']!r} is not listed")

