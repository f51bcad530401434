"""Mixing sources to target weights.

A source's weight is its share of all tokens raised to an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is bisected until the weights reach a target entropy, or until no source is repeated more often than a
limit; with both, the limit wins. The weights are realised by epochs: in each, the documents of a source stand in a
permutation of its own, made of hash blocks, and the last epoch ends where the source's budget does. Cumulative token
counts over blocks, then inside blocks, tell how far into its budget a document comes; that share is its place in the
mixture, so every stretch of the mixture has the target weights. A source with a third of all rows is many blocks.

With no budget given, it is the smallest that uses every document of every source at least once, so nothing is left out.

Defined cases. NULL source: a source of its own. NULL or empty text: no tokens; such documents stand in every epoch.
Rows with the same doc_id and source move together, each as often as it occurs. Empty input: empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SEED = 20


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised shares ** exponent; sources without tokens have none."""
    most = max([*tokens, 1])
    raised = [(t / most) ** exponent if t else 0.0 for t in tokens]
    total = math.fsum(raised) or 1.0
    return [r / total for r in raised]


def entropy(shares: list[float]) -> float:
    return -math.fsum(p * math.log(p) for p in shares if p > 0)


def repetition(tokens: list[int], shares: list[float], budget: int | None) -> float:
    """How often the most repeated source is read."""
    passes = [p / t for p, t in zip(shares, tokens, strict=True) if t]
    if not passes:
        return 1.0
    return max(passes) * (budget if budget is not None else 1 / min(passes))


def fit_exponent(
    tokens: list[int], target_entropy: float | None, most_passes: float | None, budget: int | None, steps: int = 60
) -> float:
    """The exponent by bisection: entropy and repetition both fall as it rises from 0 to 1."""

    def bisect(enough) -> float:
        low, high = 0.0, 1.0
        if enough(low):
            return low
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (low, middle) if enough(middle) else (middle, high)
        return high

    found = [0.0]
    if target_entropy is not None:
        # the largest exponent that still has the entropy: between the sources as they are and all alike
        low, high = 0.0, 1.0
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (middle, high) if entropy(weights(tokens, middle)) >= target_entropy else (low, middle)
        found.append(high if entropy(weights(tokens, 1.0)) >= target_entropy else low)
    if most_passes is not None:
        found.append(bisect(lambda a: repetition(tokens, weights(tokens, a), budget) <= most_passes))
    return max(found)


def plan(
    docs: DataFrame,
    target_entropy: float | None = None,
    most_passes: float | None = 1.5,
    budget: int | None = None,
    docs_per_block: int = 2000,
) -> DataFrame:
    """One row per use of a document: source, doc_id, epoch, n_tokens, weight, progress (0 to 1: place in the mixture).

    ``docs`` has doc_id, source, n_tokens. One row per source reaches the driver.
    """
    units = docs.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    sums = units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d")).collect()
    sums = sorted(sums, key=lambda r: (r["source"] is not None, r["source"]))
    tokens = [r["t"] for r in sums]
    shares = weights(tokens, fit_exponent(tokens, target_entropy, most_passes, budget))
    if budget is None:
        budget = math.ceil(max([t / p for t, p in zip(tokens, shares, strict=True) if t], default=0))
    rows = []
    for r, p in zip(sums, shares, strict=True):
        quota = max(round(p * budget), 0) if r["t"] else 0
        full, rest = divmod(quota, r["t"]) if r["t"] else (1, 0)
        rows.append((r["source"], p, quota, full, rest, r["t"], max(1, -(-r["d"] // docs_per_block))))
    kind = (
        f"source {docs.schema['source'].dataType.simpleString()}, weight double, quota long, full int, rest long, "
        "own long, blocks int"
    )
    quotas = docs.sparkSession.createDataFrame(rows, kind)
    quotas = quotas.select(F.col("source").alias("__source"), *quotas.columns[1:])
    each = units.join(F.broadcast(quotas), units["source"].eqNullSafe(quotas["__source"]))  # one row per source
    last = F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1)
    each = each.where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    draw = F.xxhash64("doc_id", "epoch", F.lit(_SEED))
    each = each.withColumn("draw", draw).withColumn("block", F.pmod("draw", "blocks").cast("int"))

    key = ["source", "epoch", "block"]
    size = each.groupBy(*key).agg(F.sum("n_tokens").alias("block_tokens"))
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(*[F.col(k).alias(f"__{k}") for k in key], F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy(*key).orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = each.join(size, [each[k].eqNullSafe(size[f"__{k}"]) for k in key])
    done = F.col("begin") + F.col("inside")
    used = placed.where((F.col("epoch") < F.col("full")) | (done < F.col("rest")))
    progress = F.coalesce(F.try_divide(F.col("epoch") * F.col("own") + done, F.col("quota")), F.lit(0.0))
    return used.select("source", "doc_id", "epoch", "n_tokens", "weight", progress.alias("progress"))


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``: words of the whole text."""
    return docs.withColumn("n_tokens", F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))


def mix_sources(docs: DataFrame, blocks: int | None = None, **target) -> DataFrame:
    """(doc_id, source, text) -> the mixture: doc_id, source, epoch, n_tokens, weight, progress, ``block`` and ``place``.

    A block is a stretch of the mixture with all sources at their weights; ``place`` is the position inside it, by hash.
    """
    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = count_tokens(docs.select("doc_id", "source", "text")).drop("text")
    rows = plan(counted, **target)
    rows = rows.withColumn("block", F.least(F.floor(F.col("progress") * blocks), F.lit(blocks - 1)).cast("int"))
    window = Window.partitionBy("block").orderBy(F.xxhash64("doc_id", "epoch", F.lit(_SEED + 1)), "doc_id", "epoch", "source")
    return rows.withColumn("place", F.row_number().over(window) - 1)


def mixed_documents(docs: DataFrame, **target) -> DataFrame:
    """The documents themselves, each as often as the mixture has it, with the columns of ``docs``."""
    counted = count_tokens(docs.select("doc_id", "source", "text")).drop("text")
    uses = plan(counted, **target).groupBy("source", "doc_id").agg(F.count("*").cast("int").alias("__uses"))
    uses = uses.select(F.col("source").alias("__source"), F.col("doc_id").alias("__doc"), "__uses")
    same = docs["source"].eqNullSafe(uses["__source"]) & docs["doc_id"].eqNullSafe(uses["__doc"])
    joined = docs.join(uses, same).withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("__uses"))))
    return joined.select(*[docs[c] for c in docs.columns])
