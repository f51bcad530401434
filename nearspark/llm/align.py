"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and which id pairs are linked often.

Both token streams of a text cover the same bytes. Every token points to the token that reaches farthest right among
those it overlaps (at a common end to the second tokenizer's); the pointers are doubled, a whole batch of texts at once,
until each token points to the last one of its component. That token labels the group.

Texts are encoded once. What is kept of each is its row of counts and its distinct (A id, B id) pairs with how often they
are linked. Counts over the corpus are sums that Spark combines before the shuffle. The pairs that make up at least one
of ``FREQUENT`` links are broadcast (there can be no more than that many), which resolves nearly all links where they are
read; rarer pairs meet their counts in a join, in which no key has more than its share. The highest count of each B id is a
table bounded by the vocabulary.

Defined cases. Texts that are NULL, empty, or not given back byte by byte by both tokenizers: no tokens, zeros and an
empty ``groups_sha256``. Strings of special tokens: plain text. Repeated rows: each a row, and each counts. NULL ids are
kept. Empty input: no rows. Very long texts are encoded whole, one batch each. Other columns, whatever their names, take
no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.words import slices
from nearspark.session import cut_lineage

FREQUENT = 1 << 20  # pairs with at least this part of all links are broadcast
SLICE_BYTES = 1 << 20
PAIRS_AT_ONCE = 1 << 20
B_BITS = 32  # a pair is the A id above the B id


class Tokenizers:
    """Ids of a space and the text, by the byte-level and by the piece vocabulary, and the bytes of every id."""

    def __init__(self, folder: str | None = None):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        def path(name: str) -> str:
            return f"{folder}/{name}" if folder else public_tokenizers.path(name)

        with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:  # byte_bpe_50k.json as ranks: the same ids, sooner
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        """Both id lists; two empty ones if either doesn't give the bytes back."""
        whole = (" " + text).encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return [], []
        a = self.a.encode_ordinary(" " + text)
        return (a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == whole else ([], [])


_LOADED: dict[str | None, Tokenizers] = {}


def tokenizers(folder: str | None) -> Tokenizers:
    """One a worker process."""
    if folder not in _LOADED:
        _LOADED[folder] = Tokenizers(folder)
    return _LOADED[folder]


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the tokens of either side (ascending, none empty, the same last end) -> the number of the last B token of
    each A token's and each B token's component, and the first and last B token that each A token overlaps."""
    a_start, b_start = (np.concatenate([[0], end[:-1]]) if len(end) else end for end in (a_end, b_end))
    first = np.searchsorted(b_end, a_start, side="right")
    last = np.searchsorted(b_start, a_end, side="left") - 1
    reach = np.searchsorted(a_start, b_end, side="left") - 1  # the last A token that a B token overlaps
    n = len(a_end)
    at = np.arange(n + len(b_end))
    succ = at.copy()
    further = b_end[last] >= a_end
    succ[:n][further] = n + last[further]
    further = a_end[reach] > b_end
    succ[n:][further] = reach[further]
    while True:
        doubled = succ[succ]
        if np.array_equal(doubled, succ):
            break
        succ = doubled
    return succ[:n] - n, succ[n:] - n, first, last


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, each number from its first to its last)."""
    size = last - first + 1
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each number up to ``most``, one more column for what follows, and how many there are."""
    names = [str(i).encode() for i in range(most + 1)]
    width = len(names[-1])
    table = np.zeros((len(names), width + 1), np.uint8)
    for i, name in enumerate(names):
        table[i, : len(name)] = list(name)
    return table, np.array([len(x) for x in names])


def groups_text(ids: np.ndarray, marks: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in decimal, each followed by its mark, as bytes; and where each one ends."""
    table, size = digits
    length = size[ids] + 1
    end = np.cumsum(length)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    start = end - length
    for column in range(table.shape[1]):
        has = size[ids] > column
        out[start[has] + column] = table[ids[has], column]
    out[end - 1] = marks
    return out, end


def align_texts(texts: list[str | None], tools: Tokenizers, digits) -> dict[str, list | np.ndarray]:
    """Counts, digest, distinct pairs and their numbers of links for each text of a batch."""
    encoded = [tools(t) if t else ([], []) for t in texts]
    a_count, b_count = (np.array([len(x[side]) for x in encoded], np.int64) for side in (0, 1))
    a, b = (np.array([i for x in encoded for i in x[side]], np.int64) for side in (0, 1))
    a_row, b_row = np.repeat(np.arange(len(texts)), a_count), np.repeat(np.arange(len(texts)), b_count)
    a_group, b_group, first, last = components(np.cumsum(tools.a_size[a]), np.cumsum(tools.b_size[b]))

    # A and B tokens of a group in turn: a token stands after all of its own side and those of the other in earlier groups,
    # and B tokens after the A tokens of their group
    a_at = np.arange(len(a)) + np.searchsorted(b_group, a_group, side="left")
    b_at = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
    ids = np.empty(len(a) + len(b), np.int64)
    marks = np.empty(len(ids), np.uint8)
    ids[a_at], ids[b_at] = a, b
    marks[a_at] = np.where(np.append(a_group[1:] != a_group[:-1], True)[: len(a)], ord("|"), ord(","))
    marks[b_at] = np.where(np.append(b_group[1:] != b_group[:-1], True)[: len(b)], ord(";"), ord(","))
    text, end = groups_text(ids, marks, digits)
    stop = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(a_count + b_count)])]
    raw = text.tobytes()
    sha = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(stop[:-1], stop[1:], strict=True)]

    row, other = _expand(first, last)
    n_links = np.bincount(a_row[row], minlength=len(texts))
    n_groups = np.bincount(b_row[np.unique(b_group)], minlength=len(texts))
    code = (a[row] << B_BITS) | b[other]
    order = np.lexsort((code, a_row[row]))
    code, of = code[order], a_row[row][order]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1]))[: len(code)])
    times = np.diff(np.append(new, len(code)))
    cut = np.searchsorted(of[new], np.arange(len(texts) + 1))
    return {
        "n_a": a_count, "n_b": b_count, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha,
        "pairs": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(code[new], pa.int64())),
        "times": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(times, pa.int32())),
    }


KINDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, ``row`` (a number of its own for each row), counts, digest, ``pairs`` and ``times``.

    A written table: each text is encoded once.
    """

    def run(batches):
        tools = tokenizers(folder)
        digits = _digits(max(len(tools.a_bytes), len(tools.b_bytes)))
        for part in slices(batches, limit=SLICE_BYTES):
            out = align_texts(part.column("text").to_pylist(), tools, digits)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()]],
                names=["doc_id", *out],
            )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {KINDS}")
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair linked."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))


def score_links(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``align`` with ``count_sum`` (corpus counts, over links) and ``n_best`` (links whose count is the highest
    of their B id)."""
    spark = aligned.sparkSession
    counts = cut_lineage(pair_counts(aligned))
    links = counts.agg(F.sum("n")).first()[0] or 0
    best = counts.groupBy(F.expr(f"pair & {(1 << B_BITS) - 1}").alias("b")).agg(F.max("n").alias("best"))
    counts = counts.withColumn("b", F.expr(f"pair & {(1 << B_BITS) - 1}")).join(best, "b")
    counts = cut_lineage(counts.select("pair", "n", (F.col("n") == F.col("best")).alias("is_best")))
    often = F.col("n") * frequent >= links  # of no more than ``frequent`` pairs this can hold
    known = counts.where(often).toArrow()
    order = np.argsort(known.column("pair").to_numpy())
    # 17 bytes a pair, at most ``frequent`` pairs
    shared = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy()[order] for c in ("pair", "n", "is_best")))

    def run(batches):
        pair, n, is_best = shared.value
        for batch in slices(batches, "pairs", PAIRS_AT_ONCE):
            pairs, times = batch.column("pairs"), batch.column("times")
            code, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(pairs.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
            hit = pair[at] == code if len(pair) else np.zeros(len(code), bool)
            total, good = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row[hit], n[at[hit]] * times[hit])
            np.add.at(good, row[hit], np.where(is_best[at[hit]], times[hit], 0))
            rest = np.flatnonzero(~hit)
            cut = np.searchsorted(row[rest], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(cut), pa.array(code[rest])),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(times[rest].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(total), pa.array(good), *lists], names=["row", "total", "good", "pairs", "times"]
            )

    parts = aligned.select("row", "pairs", "times").mapInArrow(
        run, "row long, total long, good long, pairs array<long>, times array<int>"
    )
    parts = cut_lineage(parts)
    rare = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rare = rare.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    rare = rare.join(counts.where(~often), "pair")
    rare = rare.select("row", (F.col("n") * F.col("times")).alias("total"), F.when(F.col("is_best"), F.col("times")).otherwise(0).alias("good"))
    sums = parts.select("row", "total", "good").unionByName(rare).groupBy("row")
    sums = sums.agg(F.sum("good").alias("n_best"), F.sum("total").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row")


def align_documents(docs: DataFrame, folder: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: token, group and link counts, how its links fare in the corpus, and its groups' digest."""
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return score_links(align(docs, folder), frequent).select(*columns)
