"""Quality rules with adaptive thresholds per language and source.

Each document gets counts (words, repeated words and lines, symbols). A few ratios of these counts are summarised, per
language and source, by histograms over fixed cells: quantile sketches that merge by addition, exactly and in any order.
Values below ``2 ** CELL_BITS`` have a cell each; larger ones, which only mean word lengths reach, share cells that are less
than 1/512 of their values wide, 512 for each doubling. So every value has a cell, and a sketch has some thousand at most.
Thresholds are quantiles of these sketches, joined back to the documents by group. A small group leans on the sketch of its language: its own counts are
added to ``prior`` documents' worth of the language's.

Defined cases. NULL text: no words, so the base rules reject it. NULL language or source: a group of its own. Repeated
rows are counted as often as they occur. Extra columns are kept; the columns added here replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.llm.words import Words, mix, sequence_hashes, slices, starts_within, text_bytes
from nearspark.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
CELL_BITS = 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")



def _ratio(scale: int, above: str, below: str):
    return lambda: F.floor(F.try_divide(scale * F.col(above), F.col(below)))


#: ratio on the grid, the quantile that bounds it, and by how much a document may exceed the bound
RULES = {
    "word_length": (_ratio(100, "word_chars", "n_words"), 0.99, 1.5),
    "symbols": (_ratio(1000, "n_symbols", "word_chars"), 0.95, 2.0),
    "dup_lines": (_ratio(1000, "n_dup_lines", "n_words"), 0.95, 2.0),
    "repeats": (_ratio(1000, "n_repeat_words", "n_words"), 0.95, 2.0),
}
#: a bound below this cell counts as this cell: one symbol in a text is no offence where there are usually none
LEAST_BOUND = 5


def count_document_parts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the five counts of each whole text (see ``COUNTS``).

    ``word_chars``: code points in words. ``n_symbols``: characters of ``[#*$%&|<>]``. ``n_dup_lines``: lines (split at
    ``\\n``) with a word that equal an earlier line. ``n_repeat_words``: words covered by a 3-word window that the text
    has twice or more.
    """
    fields = [docs.schema[c] for c in keep]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches):
        for part in slices(batches, text_col):
            data, ends = text_bytes(part.column(text_col))
            words = Words(data, ends)
            begun = np.concatenate([[0], np.cumsum(words.inside & ((data & 0xC0) != 0x80))])
            symbols = np.concatenate([[0], np.cumsum(symbol[data])])
            counts = [
                words.counts,
                np.diff(begun[ends]),
                np.diff(symbols[ends]),
                _dup_lines(words),
                _repeat_words(words),
            ]
            columns = [part.column(c) for c in keep] + [pa.array(c.astype(np.int64)) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} long" for c in COUNTS]
    return docs.select(*keep, text_col).mapInArrow(run, ", ".join(kinds))


def _per_row(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[borders])


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, value) in order: whether the pair occurred before, and whether it occurs more than once."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    same = np.zeros(len(order), bool)
    same[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    many = same.copy()
    many[:-1] |= same[1:]
    before, often = np.zeros(len(order), bool), np.zeros(len(order), bool)
    before[order], often[order] = same, many
    return before, often


def _repeat_words(words: Words) -> np.ndarray:
    at = starts_within(words.row, 3)
    covered = np.zeros(words.row[-1] + 1, np.int64)
    if len(at):
        _, often = _again(words.owner()[at], sequence_hashes(words.hashes(), 3)[at])
        first = at[often]
        np.add.at(covered, first, 1)
        np.add.at(covered, first + 3, -1)
    return _per_row(np.cumsum(covered[:-1]) > 0, words.row)


def _dup_lines(words: Words) -> np.ndarray:
    data, ends = words.data, words.ends
    out = np.zeros(len(ends) - 1, np.int64)
    breaks = np.flatnonzero(data == 10)
    # one begin for each document and each place behind a line break; a break at the end leaves an empty line, dropped below
    begin = np.union1d(ends[:-1][ends[:-1] < ends[1:]], breaks + 1)
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop = stop - (data[stop - 1] == 10)
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[has_word], stop[has_word]
    row = np.searchsorted(ends, begin, side="right") - 1
    many = np.flatnonzero(np.bincount(row, minlength=len(out)) > 1)
    for r in many:  # documents of several lines: as bytes, so equality is exact
        lo, hi = np.searchsorted(row, [r, r + 1])
        lines = [data[b:s].tobytes() for b, s in zip(begin[lo:hi], stop[lo:hi], strict=True)]
        out[r] = len(lines) - len(set(lines))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(counted: DataFrame, by: list[str], ratios: dict[str, Column]) -> DataFrame:
    """(group, rule, cell, documents): the histograms of each group. Rows are pre-aggregated before they move."""
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), _cell(v).alias("cell")) for r, v in ratios.items()])
    exploded = counted.select(*by, F.explode(cells).alias("c")).select(*by, "c.rule", "c.cell")
    return exploded.groupBy(*by, "rule", "cell").agg(F.count("*").alias("docs"))


def _cell(value: Column) -> Column:
    """The largest value of the cell: the value itself, but for its first CELL_BITS bits all ones."""
    value = value.cast("long")
    rest = F.greatest(F.length(F.bin(value)) - CELL_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, rest) + 1, rest) - 1


def merge(*sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch for the rows of several."""
    total = sketches[0]
    for other in sketches[1:]:
        total = total.unionByName(other)
    return total.groupBy(*by, "rule", "cell").agg(F.sum("docs").alias("docs"))


def thresholds(sketches: DataFrame, by: list[str], prior: int) -> DataFrame:
    """The bound of each rule and group: the least cell with at least the rule's share of the documents at or below it.

    ``by`` = (language, source). Shares are of the group's documents plus ``prior`` documents spread like the language's:
    weight(cell) = own(cell) * language total + prior * language(cell), in whole numbers.
    """
    language = by[:1]
    whole = sketches.groupBy(*language, "rule", "cell").agg(F.sum("docs").alias("lang_docs"))
    whole = whole.withColumn("lang_total", F.sum("lang_docs").over(Window.partitionBy(*language, "rule")))
    count = "decimal(18,0)"  # products of two counts, times a hundred, may exceed a long
    grid = _same_join(sketches.select(*by).distinct(), whole, language, "inner")
    joined = _same_join(grid, sketches, [*by, "rule", "cell"], "left").select(
        *by, "rule", "cell",
        (
            F.coalesce("docs", F.lit(0)).cast(count) * F.col("lang_total").cast(count) + prior * F.col("lang_docs").cast(count)
        ).cast("decimal(36,0)").alias("weight"),
    )
    window = Window.partitionBy(*by, "rule")
    below = F.sum("weight").over(window.orderBy("cell"))
    everything = F.sum("weight").over(window)
    share = F.lit(0)
    for rule, (_, q, _) in RULES.items():
        share = F.when(F.col("rule") == rule, round(100 * q)).otherwise(share)
    reached = joined.select(*by, "rule", "cell", (below * F.lit(100).cast("decimal(3,0)") >= everything * share.cast("decimal(2,0)")).alias("reached"))
    return reached.where("reached").groupBy(*by, "rule").agg(F.min("cell").alias("cell"))


def _same_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the keys stay once."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(other, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys], how).drop(*[f"__{k}" for k in keys])


def apply_quality_rules(docs: DataFrame, prior: int = 500, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(doc_id, lang, source, text) -> doc_id, the five counts, ``base_failed`` and ``kept``.

    ``kept``: the base rules hold, and no ratio lies above its rule's adaptive bound, which is the quantile of the
    document's language and source times the rule's slack. Sketches are taken over the documents that pass the base
    rules. The bounds (at most one row a group and rule) are joined, not collected.
    """
    by = list(by)
    counted = cut_lineage(count_document_parts(docs, ["doc_id", *by]))  # texts are read once; three steps read the counts
    ratios = {r: make() for r, (make, _, _) in RULES.items()}
    bounds = thresholds(sketch(counted.where(~base_failed()), by, ratios), by, prior)
    wide = bounds.groupBy(*by).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cell"))).alias(f"max_{r}") for r in RULES]
    )
    held = F.lit(True)
    for rule, (_, _, slack) in RULES.items():
        bound = F.greatest(F.col(f"max_{rule}"), F.lit(LEAST_BOUND))
        # a rule without a bound rejects nothing
        held &= F.coalesce(2 * ratios[rule] <= round(2 * slack) * bound, F.lit(True))
    joined = _same_join(counted, wide, by, "left")
    failed = base_failed()
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & held).alias("kept"))
