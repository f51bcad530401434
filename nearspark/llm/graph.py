"""Helpers on key sets and links that stay in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.words import U
from nearspark.session import cut_lineage


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter with one hash: bit (key mod 2**bits) of each 64-bit key, as 2**bits / 64 words.

    Its size is fixed by ``bits`` alone. It only spares work: where it is full, later steps get rows that an exact join
    then drops. NULL keys have no bit.
    """
    at = keys.where(F.col(column).isNotNull()).select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy().astype(U)
    return out


def maybe_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in a bitmap (no false negatives)."""
    at = keys.astype(U) & U(len(table) * 64 - 1)
    return (table[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) > 0


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node each linked node reaches.

    Large-star and small-star steps in turn: the neighbours of a node are linked to the smallest of them instead, until
    nothing changes. Every step is two joins on written tables; no node's neighbours are gathered in one row.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut_lineage(edges)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut_lineage(small)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark:
            break
        mark = now
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
