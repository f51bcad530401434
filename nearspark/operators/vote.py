"""Majority vote over neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = ("majority",)


def majority_of(labels: Column, vote: str = "majority") -> Column:
    """Struct ``(n, label)`` of the most frequent entry of an array, the lowest label on ties; NULL when empty."""
    if vote not in VOTES:
        raise ValueError(f"unknown vote {vote!r}, expected one of {VOTES}")
    counted = F.transform(
        F.array_distinct(labels),
        lambda c: F.struct((-F.size(F.filter(labels, lambda x: x == c))).alias("n"), c.alias("label")),
    )
    top = F.array_min(counted)
    return F.when(top.isNotNull(), F.struct((-top["n"]).alias("n"), top["label"].alias("label")))


def majority_vote(neighbors: DataFrame, label: str = "label", vote: str = "majority") -> DataFrame:
    """``(qid, predicted, votes)`` from neighbour rows; one shuffle, with k labels per query."""
    lists = neighbors.groupBy("qid").agg(F.collect_list(label).alias("labels"))
    top = lists.select("qid", majority_of(F.col("labels"), vote).alias("top"))
    return top.select("qid", F.col("top.label").alias("predicted"), F.col("top.n").cast("bigint").alias("votes"))
