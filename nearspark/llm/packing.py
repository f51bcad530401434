"""Best-fit packing of tokenised documents, after Martello and Toth's dominance reduction.

A document is its token ids and an end mark; longer ones than a sequence are cut, the odd piece first. Packing looks at
lengths alone, so the instance is a histogram with at most one count per length, whatever the number of documents. On
it, sets of a piece and at most one more that dominate every other set with that piece are fixed for good, as often as
the counts allow; best fit in decreasing order packs what is left. The solution is a short list of patterns with
multiplicities (a bounded table); each piece finds its sequence by its rank among the pieces of its length.

Ranks come from counts per (length, salt), so a length that a third of all pieces share is not numbered in one task.

Defined cases. NULL text: as the empty text, which is the end mark alone. Repeated rows: packed as often as they occur.
Empty input: no sequences. The control string of the vocabulary inside a text is that one token, as the tokenizer has it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.llm.words import slices
from nearspark.session import cut_lineage

CONTROL = "<|endoftext|>"


class Encoder:
    """Ids of texts as ``tokenizers`` gives them for ``byte_bpe_50k.json``.

    The same vocabulary, as ranks, encodes four times as fast with ``tiktoken``; the ids are the same (tested). A text
    with the control string goes to ``tokenizers`` itself.
    """

    def __init__(self, folder: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        def path(name: str) -> str:
            return f"{folder}/{name}" if folder else public_tokenizers.path(name)

        with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.json = path("byte_bpe_50k.json")
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = None

    def __call__(self, text: str) -> np.ndarray:
        if CONTROL not in text:
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(folder: str | None) -> Encoder:
    """One a worker process: reading the vocabulary takes longer than a batch."""
    if folder not in _ENCODERS:
        _ENCODERS[folder] = Encoder(folder)
    return _ENCODERS[folder]


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` tokens begin: whole sequences but for the first, which has the rest."""
    first = n % capacity
    return [0] * bool(first) + list(range(first, n, capacity))


def token_pieces(
    docs: DataFrame, capacity: int, end_id: int = 2, folder: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches):
        encode = encoder(folder)
        for part in slices(batches):
            out: list[list] = [[] for _ in columns]
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(cuts := cut_points(len(ids), capacity)):
                    stop = cuts[piece + 1] if piece + 1 < len(cuts) else len(ids)
                    raw = ids[start:stop].tobytes()
                    for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(raw), raw), strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=columns)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences follow each, for ``counts`` pieces of each length."""
    left = {s: n for s, n in counts.items() if n}
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity)


def reduce_dominated(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take dominating sets out of ``left`` and return them.

    For a piece s, let k be the longest other piece that fits beside it. {s} dominates if nothing fits. {s, k} dominates
    if it is full, if no two pieces fit together beside s, or if at most two do and no such pair is longer than k: then
    in any packing k can take the place of what stands with s.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(left)
    for _ in range(2 * len(left) + 2):  # a length is fixed in part at most: each pass ends or uses one up
        before = len(fixed)
        for s in sorted(left, reverse=True):
            while left.get(s):
                found = _dominating(s, left, lengths, capacity)
                if found is None:
                    break
                times = min(left[x] // found.count(x) for x in found)
                fixed.append((found, times))
                for x in set(found):
                    left[x] -= times * found.count(x)
                    if not left[x]:
                        del left[x]
                        lengths.pop(bisect_left(lengths, x))
        if len(fixed) == before:
            break
    return fixed


def _dominating(s: int, left: dict[int, int], lengths: list[int], capacity: int) -> tuple[int, ...] | None:
    room = capacity - s
    others = lengths[: bisect_right(lengths, room)]
    if s in others and left[s] == 1:
        others = [x for x in others if x != s]
    if not others:
        return (s,)
    k = others[-1]
    if s + k == capacity:
        return (s, k)
    smallest: list[int] = []
    for x in lengths:  # the three shortest pieces other than this one
        smallest += [x] * min(3, left[x] - (x == s))
        if len(smallest) >= 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (s, k)
    if len(smallest) < 3 or sum(smallest[:3]) > room:
        best = max((a + b for a in others if (b := _partner(a, s, room, left, others))), default=0)
        if best <= k:
            return (s, k)
    return None


def _partner(a: int, s: int, room: int, left: dict[int, int], others: list[int]) -> int:
    """The longest piece that fits beside s and a, or 0."""
    for b in reversed(others[: bisect_right(others, room - a)]):
        if left[b] > (b == a) + (b == s):
            return b
    return 0


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order: every piece goes to the fullest sequence with room. Equal sequences are one group."""
    groups: dict[int, list[list]] = {capacity: []}  # room -> [pattern, times]
    for s in sorted(left, reverse=True):
        n = left[s]
        for room in sorted(r for r in groups if r >= s):
            fits = room // s
            kept = []
            for pattern, times in groups.pop(room, []):
                used = min(times, n // fits)
                if used:
                    groups.setdefault(room - fits * s, []).append([pattern + (s,) * fits, used])
                    n -= used * fits
                rest = times - used
                if rest and 0 < n < fits:
                    groups.setdefault(room - n * s, []).append([pattern + (s,) * n, 1])
                    rest, n = rest - 1, 0
                if rest:
                    kept.append([pattern, rest])
            if kept:
                groups.setdefault(room, []).extend(kept)
        fits = capacity // s
        if n // fits:
            groups.setdefault(capacity - fits * s, []).append([(s,) * fits, n // fits])
        if n % fits:
            groups.setdefault(capacity - n % fits * s, []).append([(s,) * (n % fits), 1])
    return [(tuple(p), times) for room in sorted(groups) for p, times in groups[room]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length: (first rank, first sequence, offset) of each run of pieces, in the order of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s in pattern:
            runs.setdefault(s, []).append((ranks.get(s, 0), sequence, offset))
            ranks[s] = ranks.get(s, 0) + times
            offset += s
        sequence += times
    return runs


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces`` (doc_id, piece, start, length, ...).

    The driver sees one count per length, and gives tasks one row per place in a pattern.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = places(solve(counts, capacity))
    salts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    shared = pieces.sparkSession.sparkContext.broadcast(
        {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}
    )
    keep = pieces.columns

    def run(batches):
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                first, begin, place = table[int(s)]
                at = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own] = begin[at] + rank[own] - first[at]
                offset[own] = place[at]
            columns = [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*keep, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised once: the pieces' lengths are written to the shared folder.
    """
    return pack_pieces(cut_lineage(token_pieces(docs, capacity, end_id, folder)), capacity)
