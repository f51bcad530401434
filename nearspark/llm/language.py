"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree of order ``ORDER`` with escapes of method C. Statistics are frozen
after training, so the exact code length of a byte depends on the byte and the ``ORDER`` bytes before it alone, and the
trees of all languages become one table that tasks look bytes up in. A text belongs to the language with the shortest code.

Bytes are folded to ``SYMBOLS`` symbols first: letters without case, blanks, other ASCII, and the bytes above 0x7F
that are the most frequent in training, the rest of them together. Code lengths are those of the folded stream.

Defined cases. NULL text, or one without a letter: ``und``, score 0. Equal code lengths: the language that sorts first.
No training rows: every text is ``und``. Rows without an id or a language take no part in training. Repeated rows are
scored, and trained on, as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.words import SPACE, slices, text_bytes
from nearspark.session import cut_lineage

ORDER, SYMBOLS = 3, 40
_BLANK, _OTHER, _HIGH = 26, 27, 28
UNKNOWN = "und"


def held_out(column: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, if there are fewer), chosen by a hash of doc_id."""
    counts = rows.groupBy(by).count().select(F.col(by).alias("__by"), F.col("count").alias("__n"))
    counts = cut_lineage(counts)  # written, so that Spark knows that it is small and moves no texts to meet it
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(counts, F.col(by) == F.col("__by")).where(draw * F.col("__n") < most).drop("__by", "__n")


def _fold(high: list[int]) -> np.ndarray:
    """Symbol of each byte."""
    table = np.full(256, _OTHER, np.int64)
    table[SPACE] = _BLANK
    table[97:123] = table[65:91] = np.arange(26)
    table[128:] = SYMBOLS - 1
    for i, byte in enumerate(high):
        table[byte] = _HIGH + i
    return table


def _contexts(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Number of (the ORDER symbols before, symbol) at each byte; a text is preceded by blanks."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.arange(len(data)) + ORDER * (row + 1)
    symbols = np.full(len(data) + ORDER * (len(ends) - 1), _BLANK, np.int64)
    symbols[at] = table[data]
    index = symbols[at - ORDER]
    for back in range(ORDER - 1, -1, -1):
        index *= SYMBOLS
        index += symbols[at - back]
    return index


def train(rows: DataFrame, docs_per_language: int = 3000) -> tuple[list[str], list[int], np.ndarray]:
    """(doc_id, text, lang) -> languages, high bytes with a symbol, bits[context and symbol, language].

    Learns from at most about ``docs_per_language`` rows of each language. What reaches the driver is bounded by the
    alphabet: 128 byte counts, and one count per (context, symbol) and language.
    """
    sample = bounded_sample(rows.where("lang IS NOT NULL AND text IS NOT NULL"), "lang", docs_per_language)
    sample = cut_lineage(sample.select("lang", "text"))

    def bytes_of(batches):
        total = np.zeros(256, np.int64)
        for part in slices(batches):
            total += np.bincount(text_bytes(part.column("text"))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    seen = sample.select("text").mapInArrow(bytes_of, "byte long, n long").where("byte >= 128 AND n > 0")
    ranked = seen.groupBy("byte").agg(F.sum("n").alias("n")).collect()
    high = [r["byte"] for r in sorted(ranked, key=lambda r: (-r["n"], r["byte"]))][: SYMBOLS - 1 - _HIGH]
    table = _fold(high)

    def counts_of(batches):
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches):
            data, ends = text_bytes(part.column("text"))
            index = _contexts(data, ends, table)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = np.repeat(langs == lang, np.diff(ends))
                totals.setdefault(lang, np.zeros(SYMBOLS ** (ORDER + 1), np.int32))
                totals[lang] += np.bincount(index[own], minlength=SYMBOLS ** (ORDER + 1)).astype(np.int32)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))],
                names=["lang", "at", "n"],
            )

    found = sample.select("lang", "text").mapInArrow(counts_of, "lang string, at long, n long")
    found = found.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    of = np.searchsorted(np.array(langs, object), np.array(found.column("lang").to_pylist(), object)) if langs else []
    bits = np.empty((SYMBOLS ** (ORDER + 1), len(langs)), np.float32)
    for i in range(len(langs)):
        counts = np.zeros(SYMBOLS ** (ORDER + 1))
        own = of == i
        counts[found.column("at").to_numpy()[own]] = found.column("n").to_numpy()[own]
        bits[:, i] = code_lengths(counts)
    return langs, high, bits


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol in each context of order ORDER, from the counts of (context, symbol).

    From order 0 up: a symbol seen c times in a context with n symbols, d of them different, has probability
    c / (n + d); one not seen has the escape's, d / (n + d), times its probability one order lower. Below order 0
    all symbols are alike.
    """
    chance = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        c = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(axis=0)
        n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(chance, (c.shape[0] // chance.shape[0], 1))
        escaped = np.where(n > 0, d / np.maximum(n + d, 1), 1.0) * lower
        chance = np.where(c > 0, c / np.maximum(n + d, 1), escaped)
    return -np.log2(chance).reshape(-1)


def identify(docs: DataFrame, model: tuple[list[str], list[int], np.ndarray]) -> DataFrame:
    """(doc_id, text) -> doc_id, ``lang_pred``, ``score``: the share of the best language if all are equally likely
    beforehand, by exact code lengths of the whole text."""
    langs, high, bits = model
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # bounded: SYMBOLS ** (ORDER + 1) floats a language
    table = _fold(high)
    names = np.array([*langs, UNKNOWN], object)

    def run(batches):
        bits = shared.value
        for part in slices(batches, limit=1 << 20):
            data, ends = text_bytes(part.column("text"))
            total = np.zeros((len(ends) - 1, len(langs)))
            some = np.flatnonzero(np.diff(ends))
            if len(some) and langs:
                cost = np.take(bits, _contexts(data, ends, table), axis=0)
                total[some] = np.add.reduceat(cost, ends[some], axis=0, dtype=np.float64)
            if langs:
                best = total.argmin(axis=1)
                gap = total.min(axis=1, keepdims=True) - total
                score = 1.0 / np.exp2(np.maximum(gap, -1000.0)).sum(axis=1)
            else:
                best, score = np.zeros(len(total), int), np.zeros(len(total))
            silent = ~_has_letter(part.column("text"), data, ends) if langs else np.ones(len(total), bool)
            best[silent], score[silent] = len(langs), 0.0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def _has_letter(column: pa.Array, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    found = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[ends]) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found
