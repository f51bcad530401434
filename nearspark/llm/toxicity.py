"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: whether each word, each pair of neighbours and each pair with one word between occurs in it, as 64-bit
hashes of the words (runs of letters, digits and non-ASCII) in lower case. Every coordinate has a learning rate of its own, and L1 regularisation leaves few
weights; they are what is broadcast. Training sees a bounded, hash-chosen sample of labelled rows.

Defined cases. NULL and empty texts have no features; their score is that of the bias. Rows without a label take no part
in training. Repeated rows are scored, and trained on, as often as they occur. With no labelled rows every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.language import bounded_sample
from nearspark.llm.words import NOT_ALNUM, U, Words, mix, slices, text_bytes
from nearspark.session import cut_lineage

KINDS = (0, 1, 2)  # single words, neighbours, pairs with one word between
_SALT = mix(np.arange(1, 4, dtype=U))


def gram_hashes(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every feature occurrence."""
    owner = words.owner()
    values, owners = [mix(hashes ^ _SALT[0])], [owner]
    for gap in KINDS[1:]:
        size = max(0, len(hashes) - gap)
        pair = mix(hashes[:size] * U(0x9E3779B97F4A7C15) + hashes[gap : gap + size] + _SALT[gap])
        same = owner[:size] == owner[gap : gap + size]
        values.append(pair[same])
        owners.append(owner[:size][same])
    return np.concatenate(values), np.concatenate(owners)


def features(docs: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) -> doc_id, label, features: the distinct feature hashes of each text, as bytes."""

    def run(batches):
        for part in slices(batches):
            words = Words(*text_bytes(part.column("text")), NOT_ALNUM)
            value, owner = gram_hashes(words, words.hashes(lower=True))
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            value, owner = value[new], owner[new]
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            packed = [value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column(label), pa.array(packed, pa.binary())],
                names=["doc_id", label, "features"],
            )

    return docs.select("doc_id", label, "text").mapInArrow(run, f"doc_id long, {label} int, features binary")


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, size: int, passes: int, alpha: float, beta: float, l1: float, l2: float
) -> np.ndarray:
    """Weights after ``passes`` over the rows (arrays of coordinates below ``size``; the last coordinate is the bias)."""
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == bias, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(passes):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            slope = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            grown = n[at] + slope * slope
            z[at] += slope - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(np.arange(size))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    rows_per_label: int = 4000,
    least_docs: int = 5,
    passes: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 1.0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(doc_id, text) and (doc_id, label) -> sorted hashes with a weight, the weights, the bias.

    About ``rows_per_label`` rows of each label are used at most, in the order of a hash of doc_id; the bias is then
    set right for the labels' shares in all labelled rows. Their features are computed by tasks; the one task that
    learns holds the bounded sample alone. Coordinates that occur in under ``least_docs`` sampled texts are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = cut_lineage(known.agg(F.max(label).cast("int").alias(label)))
    chosen = cut_lineage(bounded_sample(known, label, rows_per_label))  # written: Spark sees that it fits a broadcast
    shares = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # two rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    sample = features(texts, label)

    def learn(key, table):
        table = table.take(pc.sort_indices(table, [("place", "ascending"), ("doc_id", "ascending")]))
        y = table.column(label).to_numpy()
        bags = [np.frombuffer(x.as_py(), U) for x in table.column("features")]
        values, counts = np.unique(np.concatenate([np.zeros(0, U), *bags]), return_counts=True)
        values = values[counts >= least_docs]
        rows = []
        for bag in bags:
            at = np.searchsorted(values, bag)
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == bag)] if len(values) else at[:0]
            rows.append(np.append(at, len(values)))
        w = ftrl(rows, y, len(values) + 1, passes, alpha, beta, l1, l2)
        used = np.flatnonzero(w[:-1])
        hashes = np.append(values[used], U(0)).astype(np.int64)
        kind = np.append(np.ones(len(used), np.int32), np.int32(0))
        return pa.table({"hash": hashes, "weight": np.append(w[used], w[-1]), "kind": kind, "ones": [int(y.sum())] * len(kind), "n": [len(y)] * len(kind)})

    one = sample.withColumn("place", F.xxhash64("doc_id")).withColumn("group", F.lit(0)).groupBy("group")
    model = one.applyInArrow(learn, "hash long, weight double, kind int, ones long, n long").toArrow()
    if not model.num_rows:
        return np.zeros(0, U), np.zeros(0), -1e9
    kind = model.column("kind").to_numpy()
    hashes, weight = model.column("hash").to_numpy().astype(U), model.column("weight").to_numpy()
    order = np.argsort(hashes[kind == 1])
    ones, n = model.column("ones")[0].as_py(), model.column("n")[0].as_py()
    ones_all, all_ = shares.get(1, 0), sum(shares.values())
    bias = float(weight[kind == 0][0])
    if 0 < ones < n and 0 < ones_all < all_:
        bias += float(np.log(ones_all / (all_ - ones_all)) - np.log(ones / (n - ones)))
    return hashes[kind == 1][order], weight[kind == 1][order], bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """(doc_id, text) -> doc_id, ``score``, ``predicted`` (1 from ``threshold`` on). No shuffle."""
    scored = score_rows(docs.select("doc_id", "text"), ["doc_id"], model, threshold)
    return scored.select("doc_id", F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    return score_rows(docs, docs.columns, model, threshold).where("__predicted = 0").select(*docs.columns)


def score_rows(docs: DataFrame, keep: list[str], model: tuple[np.ndarray, np.ndarray, float], threshold: float) -> DataFrame:
    """The columns ``keep``, ``__score`` and ``__predicted``."""
    hashes, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((hashes, weights))  # bounded by the training sample

    def run(batches):
        hashes, weights = shared.value
        quick = np.zeros(1 << 20, bool)
        quick[(hashes & U((1 << 20) - 1)).astype(np.int64)] = True
        for part in slices(batches):
            words = Words(*text_bytes(part.column("text")), NOT_ALNUM)
            value, owner = gram_hashes(words, words.hashes(lower=True))
            hit = np.flatnonzero(quick[(value & U((1 << 20) - 1)).astype(np.int64)])
            value, owner = value[hit], owner[hit]
            at = np.searchsorted(hashes, value)
            ok = at < len(hashes)
            ok[ok] = hashes[at[ok]] == value[ok]
            pairs = np.unique(np.stack([owner[ok], at[ok]]), axis=1)  # a feature counts once a text
            total = bias + np.bincount(pairs[0], weights[pairs[1]], minlength=part.num_rows)
            chance = 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], pa.array(chance), pa.array((chance >= threshold).astype(np.int32))],
                names=[*keep, "__score", "__predicted"],
            )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    used = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*used).mapInArrow(run, ", ".join([*kinds, "__score double, __predicted int"]))
