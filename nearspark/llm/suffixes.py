"""Repeated passages by a sparse suffix array.

1. Suffixes are retained at the places that runs of ``MIN_WORDS - MATCH + 1`` places select as minimisers of 8-word hashes.
   So any passage of MIN_WORDS words has a retained suffix with MATCH of its words to the right, wherever it stands.
2. A retained suffix is its next MIN_WORDS words and the words before it, back to where the selecting run may begin, as 32-bit
   word numbers. Suffixes whose first MATCH words occur once in the corpus (counted by hash) cannot match and are left out.
3. The rest are sorted by range partitions, in two orders: by all right words, whose neighbours have the longest match to
   the right; and by the first MATCH of them, then by the words to the left, backwards, whose neighbours have the longest
   match to the left. Where neighbours are of the same document, the nearest of another one counts. Ranges may cut anywhere, also between equal suffixes, so a passage
   that a third of all documents share is spread over tasks; the documents at both sides of each cut are compared in a
   second, small step.
4. Matches of MIN_WORDS words with one document are sure. Where shorter ones join to as much, the windows of MIN_WORDS words
   there are looked up in all documents, by hash. What is sure or found there is joined into passages and reported.

Every passage of MIN_WORDS words that two documents share is found, whole, and no other word is reported.

Defined cases. NULL text or one under MATCH words: nothing. NULL doc_id: one document without an id. Rows with equal
doc_id are one document; passages that recur only within a document are not reported. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.llm.graph import bitmap, maybe_in
from nearspark.llm.words import U, Words, give_back, minimisers, offsets_of, sequence_hashes, slices, starts_within, text_bytes
from nearspark.session import cut_lineage

MIN_WORDS, MATCH, ANCHOR = 50, 25, 8
LEFT = MIN_WORDS - MATCH
FILTER_BITS = 26
ROWS_PER_RANGE = 40_000
LINK_ROWS = 4_096
LAST = 2**63 - 1


def retained(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Word places of the retained suffixes that have MATCH words to the right in their document."""
    order = sequence_hashes(hashes, ANCHOR)
    runs = starts_within(words.row, MIN_WORDS - MATCH + ANCHOR)
    places = minimisers(order, runs, MIN_WORDS - MATCH + 1)
    if not len(places):
        return places
    document_end = words.row[np.searchsorted(words.row, places, side="right")]
    return places[places + MATCH <= document_end]


def _suffix_rows(rows: DataFrame, live: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(live)

    def run(batches):
        for part in slices(batches):
            words = Words(*text_bytes(part.column("text")))
            hashes = words.hashes()
            at = retained(words, hashes)
            at = at[maybe_in(shared.value, sequence_hashes(hashes, MATCH)[at])] if len(at) else at
            ids = hashes.astype(np.uint32).astype(">u4")  # big-endian: bytes sort like numbers
            backwards = ids[::-1]
            row = np.searchsorted(words.row, at, side="right") - 1
            row_begin, row_end = words.row[row], words.row[row + 1]
            n = len(ids)
            left = [backwards[n - a : n - max(b, a - LEFT)].tobytes() for a, b in zip(at, row_begin, strict=True)]
            doc = part.column("__place").to_numpy()[row]
            for by_left, most in ((0, MIN_WORDS), (1, MATCH)):
                right = [ids[a : min(a + most, e)].tobytes() for a, e in zip(at, row_end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), by_left, np.int32)), pa.array(right, pa.binary()),
                        pa.array(left, pa.binary()), pa.array(doc), pa.array(at - row_begin),
                    ],
                    names=["by_left", "right", "left", "doc", "at"],
                )

    return rows.mapInArrow(run, "by_left int, right binary, left binary, doc long, at long")


def common_words(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """How many leading words each pair has in common."""
    if not one:
        return np.zeros(0, np.int64)
    wide = max(map(len, [*one, *other])) // 4
    if not wide:
        return np.zeros(len(one), np.int64)
    a, b = (np.frombuffer(b"".join(x.ljust(4 * wide, b"\0") for x in xs), ">u4").reshape(-1, wide) for xs in (one, other))
    same = a == b
    first = np.where(same.all(axis=1), wide, (~same).argmax(axis=1))
    return np.minimum(first, np.minimum([len(x) // 4 for x in one], [len(x) // 4 for x in other]))


def _reach(r: list[int], s: list[int], doc: list[int], after: bool) -> list[tuple[int, int, int]]:
    """What each suffix shares with the nearest one of another document on one side, directly or through its document's
    own suffixes between: words to the right and to the left, and that document (-1: none). ``r[k]`` and ``s[k]`` link
    k - 1 and k."""
    n = len(doc)
    out, reach = [(0, 0, -1)] * n, (0, 0, -1)
    for i in range(n - 2, -1, -1) if after else range(1, n):
        j, k = (i + 1, i + 1) if after else (i - 1, i)
        if doc[i] != doc[j]:
            reach = (r[k], s[k], doc[j])
        else:
            reach = (min(reach[0], r[k]), min(reach[1], s[k]), reach[2])
        out[i] = reach
    return out


def _links(column: pa.Array) -> list[int]:
    """Leading words that each row of a binary column has in common with the row before it (0 for the first).

    Rows are compared as one matrix of words, ``LINK_ROWS`` at a time, and none becomes a Python object.
    """
    out = [0]
    ends, data = offsets_of(column).astype(np.int64), column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    for a in range(0, len(column) - 1, LINK_ROWS):
        at = ends[a : min(len(column), a + LINK_ROWS + 1) + 1]
        sizes = np.diff(at) // 4
        words = np.zeros((len(sizes), max(1, int(sizes.max()))), "<u4")
        held = np.arange(words.shape[1]) < sizes[:, None]
        words[held] = np.frombuffer(data[at[0] : at[-1]].tobytes(), "<u4")
        same = (words[1:] == words[:-1]) & held[1:] & held[:-1]
        out += np.where(same.all(axis=1), words.shape[1], (~same).argmax(axis=1)).tolist()
    return out


def _through(r: list[int], s: list[int]) -> list[tuple[int, int]]:
    """Running minimum of links, the first of which is the row itself."""
    rights = np.minimum.accumulate([MIN_WORDS, *r])
    lefts = np.minimum.accumulate([LEFT, *s])
    return list(zip(rights.tolist(), lefts.tolist(), strict=True))


_FOUND = "part int, edge int, place int, doc long, at long, r int, s int, other long, right binary, left binary"
HIT, HEAD, TAIL, FIRST, LAST_ROW = range(5)


def _compare_range(batches):
    """Neighbours of one range, as ``edge`` = HIT; and what the ranges around it need or may add:

    HEAD and TAIL are the suffixes of the document at its begin and end, with what links them to the range's first and
    last row. FIRST and LAST_ROW are these two rows, with what they share with another document in the range; or, where
    there is none (``other`` = -1), with what links one end of the range to the other.
    """
    from pyspark import TaskContext

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    del batches
    table = table.combine_chunks()
    right, left = (table.column(c).chunk(0) for c in ("right", "left"))
    doc, at = (table.column(c).to_pylist() for c in ("doc", "at"))
    n, part = len(doc), TaskContext.get().partitionId()
    r, s = _links(right), _links(left)
    before, after = _reach(r, s, doc, False), _reach(r, s, doc, True)
    head = next((i for i in range(n) if doc[i] != doc[0]), n)
    tail = next((i + 1 for i in range(n - 1, -1, -1) if doc[i] != doc[-1]), 0)
    to_first = _through(r[1:head], s[1:head])
    to_last = _through(r[:tail:-1], s[:tail:-1])
    rows = []
    for i, (x, y) in enumerate(zip(before, after, strict=True)):  # each is a true match with one document; once if one has both
        if x[0] >= MATCH and not (y[0] >= x[0] and y[1] >= x[1]):
            rows.append((HIT, i, *x))
        if y[0] >= MATCH and not (x[0] >= y[0] and x[1] >= y[1] and x[:2] != y[:2]):
            rows.append((HIT, i, *y))
    rows += [(HEAD, i, *x, -1) for i, x in enumerate(to_first) if x[0] >= MATCH]
    rows += [(TAIL, n - 1 - i, *x, -1) for i, x in enumerate(to_last) if x[0] >= MATCH]
    rows += [(FIRST, 0, *(after[0] if head < n else (*to_first[-1], -1)))]
    rows += [(LAST_ROW, n - 1, *(before[-1] if head < n else (*to_last[-1], -1)))]
    ends = (FIRST, LAST_ROW)
    columns = [
        pa.array([part] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()),
        pa.array([doc[x[1]] for x in rows], pa.int64()), pa.array([at[x[1]] for x in rows], pa.int64()),
        pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.int32()),
        pa.array([x[4] for x in rows], pa.int64()),
        pa.array([right[x[1]].as_py() if x[0] in ends else b"" for x in rows], pa.binary()),
        pa.array([left[x[1]].as_py() if x[0] in ends else b"" for x in rows], pa.binary()),
    ]
    del rows, before, after, r, s, doc, at, right, left, table
    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])
    del columns
    give_back()


def carry(firsts: list, lasts: list) -> list[tuple[int, int, int, int, int]]:
    """(part, HEAD or TAIL, r, s, other): what the first and last row of each range, in order, share with the nearest
    other document outside it. Ranges of one document pass on what reaches them."""
    r, s = (common_words([x[c] for x in lasts[:-1]], [x[c] for x in firsts[1:]]).tolist() for c in ("right", "left"))
    out = []
    for edge, order in ((HEAD, range(len(firsts))), (TAIL, range(len(firsts) - 1, -1, -1))):
        near, far = (firsts, lasts) if edge == HEAD else (lasts, firsts)
        reach = end = None
        for p in order:
            if end is None:
                came = (0, 0, -1)
            else:
                k = p - 1 if edge == HEAD else p
                if end["doc"] != near[p]["doc"]:
                    came = (r[k], s[k], end["doc"])
                else:
                    came = (min(reach[0], r[k]), min(reach[1], s[k]), reach[2])
            if came[0] >= MATCH:
                out.append((near[p]["part"], edge, *came))
            end = far[p]
            reach = (end["r"], end["s"], end["other"])
            if end["other"] == -1:
                reach = (min(reach[0], came[0]), min(reach[1], came[1]), came[2])
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per passage of a document that another one has: doc_id, ``first_word`` (from 0),
    ``n_words``, ``copy_doc_id`` (the smallest doc_id among those it was matched with), ``n_suffixes`` that matched MIN_WORDS words around them."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__place"), "text")

    def prefixes(batches):
        for part in slices(batches):
            words = Words(*text_bytes(part.column("text")))
            hashes = words.hashes()
            at = retained(words, hashes)
            first = sequence_hashes(hashes, MATCH)[at] if len(at) else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64))], names=["prefix"])

    counted = rows.mapInArrow(prefixes, "prefix long").groupBy("prefix").agg(F.count("*").alias("n"))
    live = cut_lineage(counted.where("n > 1"))
    total = live.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-2 * total // ROWS_PER_RANGE))
    order = ["by_left", "right", "left", "doc", "at"]
    suffixes = _suffix_rows(rows, bitmap(live, "prefix", FILTER_BITS))
    ordered = suffixes.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = cut_lineage(ordered.mapInArrow(_compare_range, _FOUND))

    matched = found.where(F.col("edge") == HIT).select("doc", "at", "r", "s", "other")
    # two rows a range reach the driver; what they carry meets the rows at the cuts where these are
    ends = found.where(F.col("edge") >= FIRST).drop("place", "at").toArrow().to_pylist()
    ends.sort(key=lambda x: (x["edge"], x["part"]))
    carried = rows.sparkSession.createDataFrame(
        carry(ends[: len(ends) // 2], ends[len(ends) // 2 :]), "part int, edge int, r2 int, s2 int, other2 long"
    )
    at_cuts = found.where(F.col("edge").isin(HEAD, TAIL)).join(F.broadcast(carried), ["part", "edge"])
    at_cuts = at_cuts.select(
        "doc", "at", F.least("r", "r2").alias("r"), F.least("s", "s2").alias("s"), F.col("other2").alias("other")
    ).where(F.col("r") >= MATCH)
    spans = matched.unionByName(at_cuts).select(
        "doc", (F.col("at") - F.col("s")).alias("begin"), (F.col("at") + F.col("r")).alias("stop"), "other"
    )
    spans = spans.withColumn("suffix", F.lit(1))
    long_enough = F.col("stop") - F.col("begin") >= MIN_WORDS
    sure = spans.where(long_enough)
    confirmed = _shared_windows(rows, _joined(spans).where(long_enough), _joined(sure))
    return _joined(sure.unionByName(confirmed)).select(
        F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), F.col("begin").alias("first_word"),
        (F.col("stop") - F.col("begin")).alias("n_words"),
        F.when(F.col("copy") < LAST, F.col("copy")).alias("copy_doc_id"), "n_suffixes",
    )


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch as one."""
    by = Window.partitionBy("doc").orderBy("begin", "stop", "other")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0)
    numbered = spans.withColumn("new", new).withColumn(
        "passage", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return numbered.groupBy("doc", "passage").agg(
        F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.min("other").alias("copy"), F.sum("suffix").alias("n_suffixes")
    )


def _open_places(n: int, areas: list[dict], sure: list[dict]) -> np.ndarray:
    """Where windows of MIN_WORDS words start that lie in an area, with a word that is not in a sure one, in a text of ``n``."""
    unsure = np.ones(n, bool)
    for x in sure:
        unsure[x["begin"] : x["stop"]] = False
    total = np.concatenate([[0], np.cumsum(unsure)])
    at = [np.arange(x["begin"], min(x["stop"], n) - MIN_WORDS + 1) for x in areas]
    at = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
    return at[total[at + MIN_WORDS] > total[at]]


def _shared_windows(rows: DataFrame, areas: DataFrame, sure: DataFrame) -> DataFrame:
    """The windows of MIN_WORDS words in ``areas``, beyond what is ``sure``, that two documents have, as spans."""

    def listed(passages: DataFrame, name: str) -> DataFrame:
        return passages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias(name))

    known = listed(areas, "areas").join(listed(sure, "sure"), "doc", "left")
    known = cut_lineage(known.where(~F.col("areas").eqNullSafe(F.col("sure"))))
    docs = rows.sparkSession.sparkContext.broadcast(bitmap(known, "doc", FILTER_BITS))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(docs.value, batch.column("__place").to_numpy())))

    def unsure(batches):
        for part in slices(batches):
            words = Words(*text_bytes(part.column("text")))
            window = sequence_hashes(words.hashes(), MIN_WORDS)
            areas, sure = part.column("areas").to_pylist(), part.column("sure").to_pylist()
            at = [_open_places(n, a, b or []) for n, a, b in zip(words.counts.tolist(), areas, sure, strict=True)]
            row = np.repeat(np.arange(len(at)), [len(x) for x in at])
            at = np.concatenate([np.zeros(0, np.int64), *at])
            columns = [window[words.row[row] + at].astype(np.int64), part.column("doc").to_numpy()[row], at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "doc", "begin"])

    own = rows.mapInArrow(some, "__place long, text string").withColumnRenamed("__place", "doc").join(known, "doc")
    asked = cut_lineage(own.mapInArrow(unsure, "window long, doc long, begin long"))
    table = rows.sparkSession.sparkContext.broadcast(bitmap(asked, "window", FILTER_BITS))

    def occurrences(batches):
        for part in slices(batches):
            words = Words(*text_bytes(part.column("text")))
            at = starts_within(words.row, MIN_WORDS)
            window = sequence_hashes(words.hashes(), MIN_WORDS)[at] if len(at) else np.zeros(0, U)
            may = maybe_in(table.value, window)
            doc = part.column("__place").to_numpy()[words.owner()[at[may]]]
            yield pa.RecordBatch.from_arrays([pa.array(window[may].astype(np.int64)), pa.array(doc)], names=["window", "doc"])

    seen = rows.mapInArrow(occurrences, "window long, doc long").groupBy("window")
    seen = seen.agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    other = F.when(F.col("low") < F.col("doc"), F.col("low")).otherwise(F.col("high"))
    return asked.join(seen, "window").select(
        "doc", "begin", (F.col("begin") + MIN_WORDS).alias("stop"), other.alias("other"), F.lit(0).alias("suffix")
    )
