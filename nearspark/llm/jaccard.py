"""Exact n-gram Jaccard join by T-occurrence search, and the classes of near duplicates.

A document is the set of its distinct word shingles; two documents link if their sets' Jaccard similarity reaches a
threshold. A document that links with a set of n shingles shares at least T = ceil(threshold * n) of them.

* **Which lists are short.** Shingles are ordered by how often their hash bucket occurs in all documents (a table of fixed
  size), then by hash. A document's n - T + 1 first shingles are its short lists: any partner occurs in one of them. All
  its other lists are long in this sense and are never formed over the corpus.
* **Copies.** Documents with equal sets are one class and are searched once.
* **Near copies.** Every class is first compared with one other of its lists (the smallest class there); what links is one
  component. Only lists that then still hold two components are searched.
* **Search.** The classes of those lists are dealt into blocks of bounded size and sets of like size, near copies together: each
  goes with the longest of its short lists. A block is an inverted index of its classes' whole sets. A query class is sent
  once to every block with which it shares as many short lists as linked sets must, so no pair of a list is ever a row.
  DivideSkip finds the candidates in the block: the longest of the query's lists there are put aside, the others are merged on
  a heap, and what is found often enough is looked up in the long lists by binary search. The exact similarity decides.
  Classes already in one component are passed over, and a task returns the links that join two components, no others: so
  no link between components is lost.

Defined cases. NULL or empty text, or one without a word: no shingles, links with nothing, a class of its own. Fewer
words than the shingle has: the whole sequence is the one shingle. Repeated rows, and rows with the same doc_id: equal
ids are one node. Extra columns are ignored. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearspark.llm.graph import bitmap, components, maybe_in
from nearspark.llm.words import U, Words, give_back, mix, sequence_hashes, slices, starts_within, text_bytes
from nearspark.session import cut_lineage

COUNTER_BITS = 22
COUNTER_CHUNK = 1 << 14
FILTER_BITS = 26
BLOCK = 256
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1 << 20
SIZE_STEP = 1.05


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column."""
    words = Words(*text_bytes(column))
    hashes = words.hashes(lower=True)
    at = starts_within(words.row, n)
    grams = sequence_hashes(hashes, n)[at]
    cut = np.searchsorted(at, words.row)
    out = [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i in np.flatnonzero((words.counts > 0) & (words.counts < n)):
        own = hashes[words.row[i] : words.row[i + 1]]
        out[i] = mix(sequence_hashes(own, len(own)) + U(len(own)))
    return out


def class_of(shingles: np.ndarray) -> int:
    """64-bit name of a set, as Spark's signed long."""
    total = np.array([mix(shingles).sum(dtype=U)]) + U(len(shingles))
    return int(mix(total).astype(np.int64)[0])


def needed(n: int, threshold: tuple[int, int]) -> int:
    """The overlap that any partner of a set of ``n`` shingles has at least."""
    return -(-threshold[0] * n // threshold[1])


def linked(common, size_a, size_b, threshold: tuple[int, int]):
    return threshold[1] * common >= threshold[0] * (size_a + size_b - common)


class InvertedIndex:
    """The lists of a block of sets (sorted distinct hashes): which of them hold each hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")  # ids stay in order inside a list
        self.values, self.ids = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def divide_skip(
        self, query: np.ndarray, threshold: tuple[int, int], wanted: np.ndarray | None = None, mu: float = 0.01
    ) -> list[int]:
        """Which sets link with ``query`` by T-occurrence search; ``wanted`` marks the sets to look at."""
        large, small = np.maximum(self.sizes, len(query)), np.minimum(self.sizes, len(query))
        fits = threshold[1] * small >= threshold[0] * large
        wanted = fits if wanted is None else fits & wanted
        if not wanted.any():
            return []
        begin, end = (np.searchsorted(self.values, query, side) for side in ("left", "right"))
        found = np.flatnonzero(end > begin)
        least = needed(len(query), threshold)
        if len(found) < least:
            return []
        lists = [self.ids[a:b] for a, b in zip(begin[found].tolist(), end[found].tolist(), strict=True)]
        if not wanted.all():
            lists = [x for x in (x[wanted[x]] for x in lists) if len(x)]
            if len(lists) < least:
                return []
        lists.sort(key=len)
        aside = min(least - 1, int(least / (mu * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        merged = ((i, sum(1 for _ in same)) for i, same in groupby(heapq.merge(*(x.tolist() for x in short))))
        kept = [(i, count) for i, count in merged if count >= least - aside]
        if not kept:
            return []
        ids, counts = (np.array(x) for x in zip(*kept, strict=True))
        for x in long:
            place = np.searchsorted(x, ids)
            place[place == len(x)] = 0
            counts += x[place] == ids
        return ids[linked(counts, len(query), self.sizes[ids], threshold)].tolist()


def divide_skip(query: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> list[int]:
    """Which of ``sets`` link with ``query`` (sorted distinct hashes both)."""
    return InvertedIndex(sets).divide_skip(query, threshold)


def joining_links(queries: pa.Table, members: pa.Table, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between query classes and a block's classes that join two components; later ones see earlier ones."""
    sets = [np.frombuffer(x, U) for x in members.column("shingles").to_pylist()]
    index, names = InvertedIndex(sets), members.column("cls").to_numpy()
    mine, theirs = queries.column("comp").to_numpy().copy(), members.column("comp").to_numpy().copy()
    own = queries.column("own").to_numpy(zero_copy_only=False)
    out = []
    for i, (q, query) in enumerate(zip(queries.column("cls").to_pylist(), queries.column("shingles").to_pylist(), strict=True)):
        wanted = theirs != mine[i]
        if own[i]:
            wanted &= names > q  # the block's own classes meet each other once
        for at in index.divide_skip(np.frombuffer(query, U), threshold, wanted):
            joined = theirs[at]
            if joined != mine[i]:
                out.append((q, int(names[at])))
                theirs[theirs == joined] = mine[i]
                mine[mine == joined] = mine[i]
    return out


def near_duplicate_classes(
    docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text) -> one row per input row: doc_id, ``n_shingles``, ``component_id`` (smallest doc_id reachable)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slots = 1 << COUNTER_BITS

    def survey(batches):
        counts, fields = np.zeros(slots, np.int64), ["doc_id", "n", "cls", "chunk", "docs"]
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), n)
            counts += np.bincount((np.concatenate(sets) & U(slots - 1)).astype(np.int64), minlength=slots)
            size = pa.array([len(s) for s in sets], pa.int64())
            cls = pa.array([class_of(s) for s in sets], pa.int64())
            none = [pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, cls, *none], names=fields)
        packed = np.minimum(counts, np.iinfo(np.uint16).max).astype(np.uint16).reshape(-1, COUNTER_CHUNK)
        used = np.flatnonzero(packed.any(axis=1))
        none = [pa.nulls(len(used), pa.int64())] * 3
        blobs = pa.array([zlib.compress(packed[i].tobytes(), 1) for i in used], pa.binary())
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int64()), blobs], names=fields)

    def add_up(batches):
        total = {}
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(blob), np.uint16)
                total[chunk] = total.get(chunk, 0) + counts.astype(np.int64)
        blobs = [np.minimum(x, np.iinfo(np.uint32).max).astype(np.uint32).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "docs"])

    surveyed = cut_lineage(texts.mapInArrow(survey, "doc_id long, n long, cls long, chunk long, docs binary"))
    members = surveyed.where("n IS NOT NULL").select("doc_id", "n", "cls")
    chunks = surveyed.where("chunk IS NOT NULL").select("chunk", "docs").repartition(64, "chunk")
    often = np.zeros((slots // COUNTER_CHUNK, COUNTER_CHUNK), np.uint32)
    for row in chunks.mapInArrow(add_up, "chunk long, docs binary").toArrow().to_pylist():
        often[row["chunk"]] = np.frombuffer(row["docs"], np.uint32)
    often = often.reshape(-1)
    often = spark.sparkContext.broadcast(often)  # of fixed size

    def short_lists(live):
        def run(batches):
            counts, done = often.value, set()
            for part in slices(batches):
                keys, classes, sizes = [], [], []
                for s in shingle_sets(part.column("text"), n):
                    if not len(s) or (cls := class_of(s)) in done:
                        continue
                    done.add(cls)  # copies in this task
                    order = np.lexsort((s, counts[(s & U(slots - 1)).astype(np.int64)]))
                    first = s[order[: len(s) - needed(len(s), threshold) + 1]]
                    if live is not None:
                        first = first[maybe_in(live.value, first)]
                    keys.append(first)
                    classes.append(np.full(len(first), cls, np.int64))
                    sizes.append(np.full(len(first), len(s), np.int64))
                if keys:
                    columns = [np.concatenate(x) for x in (keys, classes, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(np.int64)) for c in columns], names=["shingle", "cls", "n"]
                    )

        return texts.mapInArrow(run, "shingle long, cls long, n long")

    lists = short_lists(None).groupBy("shingle").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    live = cut_lineage(lists.where("low < high").select("shingle"))
    table = spark.sparkContext.broadcast(bitmap(live, "shingle", FILTER_BITS))
    entries = cut_lineage(short_lists(table).join(live, "shingle").distinct())

    links = None
    labels = entries.select("cls").distinct().withColumn("comp", F.col("cls"))
    for last in (False, True):
        own = entries.join(labels, "cls")
        if last:
            found = _search(texts, members, cut_lineage(_mixed(own)), n, threshold)
        else:
            found = _verify(texts, members, cut_lineage(_one_each(own, threshold)), n, threshold)
        found = cut_lineage(found)
        links = found if links is None else cut_lineage(links.unionByName(found))
        reached = components(links).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
        labels = cut_lineage(
            entries.select("cls").distinct().join(reached, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"))
        )

    nodes = members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = nodes.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = nodes.where("n > 0").join(lowest, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = nodes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The document with the smallest doc_id of each class, with all its columns. Rows without a doc_id stay."""
    classes = near_duplicate_classes(docs, n, threshold)
    return docs.join(classes.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(
        *docs.columns
    )


def _least_shared(n: str, m: str, threshold: tuple[int, int]) -> Column:
    """How many short lists two linked classes of ``n`` and ``m`` shingles have in common at least.

    Of the two ends of their short lists, take the one that comes first in the order: every common shingle up to there is in
    both short lists, and behind it that class has T - 1 more. So the overlap they need, less T - 1 of the larger T, is shared.
    """
    hit, whole = threshold
    both = F.expr(f"({hit} * ({n} + {m}) + {hit + whole - 1}) div {hit + whole}")
    own = [F.expr(f"({hit} * {x} + {whole - 1}) div {whole}") for x in (n, m)]
    return both - F.greatest(*own) + 1


def _sizes_fit(n: str, m: str, threshold: tuple[int, int]) -> Column:
    return threshold[1] * F.least(n, m) >= threshold[0] * F.greatest(n, m)


def _one_each(entries: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """One comparison for each class: with the smallest class of another component in one of its lists, the one that
    most of its lists name, if those are enough. Rows grow with the classes, not with the lists' lengths."""
    by_comp = entries.groupBy("shingle", "comp").agg(F.min(F.struct("cls", "n")).alias("q"))
    two = by_comp.groupBy("shingle").agg(
        F.min(F.struct("q", "comp")).alias("one"), F.count("*").alias("comps"), F.max(F.struct("q", "comp")).alias("other")
    )
    two = two.where("comps > 1")
    other = F.when(F.col("comp") == F.col("one.comp"), F.col("other.q")).otherwise(F.col("one.q"))
    named = entries.join(two, "shingle").select(F.col("cls").alias("c"), "n", other.alias("q"))
    counted = named.groupBy("c", "n", F.col("q.cls").alias("q"), F.col("q.n").alias("m")).agg(F.count("*").alias("shared"))
    counted = counted.where(_sizes_fit("n", "m", threshold) & (F.col("shared") >= _least_shared("n", "m", threshold)))
    best = counted.groupBy("c").agg(F.max(F.struct("shared", "q")).alias("best"))
    return best.select(F.col("best.q").alias("q"), "c")


def _mixed(entries: DataFrame) -> DataFrame:
    """The lists that hold classes of two components."""
    mixed = entries.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return entries.join(mixed.select("shingle"), "shingle").select("shingle", "cls", "n", "comp")


def _sets(texts: DataFrame, members: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, shingles) of the wanted classes, from one document of each, as a written table."""
    reps = cut_lineage(members.join(wanted, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
    table = texts.sparkSession.sparkContext.broadcast(bitmap(reps, "doc_id", FILTER_BITS))

    def sets(batches):
        for part in slices(batches):
            ids = part.column("doc_id")
            may = maybe_in(table.value, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
            may |= np.asarray(pc.is_null(ids))
            part = part.filter(pa.array(may))
            if part.num_rows:
                found = shingle_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["cls", "shingles"],
                )

    # a class is a set, so which of its documents is read does not matter
    own = texts.mapInArrow(sets, "cls long, shingles binary").join(reps.select("cls"), "cls").dropDuplicates(["cls"])
    return cut_lineage(own)


def _verify(texts: DataFrame, members: DataFrame, pairs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (q, c) of classes that link, as (a, b): each query searched against blocks of its candidates."""
    own = _sets(texts, members, pairs.select(F.col("q").alias("cls")).union(pairs.select("c")).distinct(), n)
    blocks = pairs.groupBy("q").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    salted = pairs.join(blocks, "q").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    candidates = salted.join(own.select(F.col("cls").alias("c"), "shingles"), "c").select("q", "block", "c", "shingles")
    queries = salted.select("q", "block").distinct().join(own.withColumnRenamed("cls", "q"), "q")
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # names of its own, for the cogroup

    def search(key, queries, candidates):
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        query = np.frombuffer(queries.column("shingles")[0].as_py(), U)
        names = candidates.column("c").to_pylist()
        found = [np.frombuffer(s, U) for s in candidates.column("shingles").to_pylist()]
        hits = [names[i] for i in divide_skip(query, found, threshold)]
        return pa.table({"a": pa.array([key[0].as_py()] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})

    return queries.groupBy("q", "block").cogroup(candidates.groupBy("q", "block")).applyInArrow(search, "a long, b long")


def _blocks(entries: DataFrame) -> DataFrame:
    """(cls, n, comp, block): classes in blocks of bounded size and of sets within 5 % in size, near copies together.

    Classes of a size with the same longest list share a block; more than half a block of them have blocks of their own, by
    hash of the class. The others share the blocks of their size by hash.
    """
    longest = entries.groupBy("shingle").agg(F.count("*").alias("length"))
    homes = entries.join(longest, "shingle").groupBy("cls", "n", "comp")
    homes = homes.agg(F.max(F.struct("length", "shingle"))["shingle"].alias("home"))
    homes = cut_lineage(homes.withColumn("size", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP)))))
    load = F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)
    halves = F.ceil(2 * load).cast("long")
    packs = homes.groupBy("size").agg(halves.alias("packs"))  # some hundred sizes at most
    large = homes.groupBy("size", "home").agg(halves.alias("parts")).where("parts > 1")
    part = F.xxhash64("size", "home", F.pmod(F.xxhash64("cls"), "parts"))
    pack = F.xxhash64("size", F.pmod(F.xxhash64("home"), "packs"))
    placed = homes.join(packs, "size").join(large, ["size", "home"], "left")
    return placed.select("cls", "n", "comp", F.when(F.col("parts") > 1, part).otherwise(pack).alias("block"))


def _meetings(entries: DataFrame, blocks: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(cls, block, there): the blocks in which a class shares as many short lists as it must with a link's other end.

    A link is seen from both ends, so what only one end asks for is left out.
    """
    hit, whole = threshold
    placed = entries.select("shingle", "cls").join(blocks, "cls")
    reach = placed.groupBy("shingle", F.col("block").alias("there")).agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    fits = (whole * F.col("most") >= hit * F.col("n")) & (whole * F.col("n") >= hit * F.col("least"))
    other = (F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))
    met = placed.join(reach, "shingle").where(fits & other).groupBy("cls", "n", "block", "there").agg(
        F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    # between the smallest and the largest size that fits, the lists needed are fewest at one of the ends; beyond n both
    # terms are rounded up and fall at different sizes, so one less may do just before the upper end
    met = met.withColumn("least", F.expr(f"greatest(least, ({hit} * n + {whole - 1}) div {whole})"))
    met = met.withColumn("most", F.expr(f"least(most, {whole} * n div {hit})"))
    enough = F.least(_least_shared("n", "least", threshold), _least_shared("n", "most", threshold) - 1)
    met = cut_lineage(met.where(F.col("shared") >= enough).select("cls", "block", "there"))
    back = met.select(F.col("there").alias("block"), F.col("block").alias("there")).distinct()
    return met.join(back, ["block", "there"], "left_semi").select("cls", "block", "there")


def _search(texts: DataFrame, members: DataFrame, entries: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) between components: every class searched in the blocks that its short lists reach."""
    blocks = cut_lineage(_blocks(entries))
    both = cut_lineage(_meetings(entries, blocks, threshold))
    used = both.select("cls").distinct()
    own = blocks.join(_sets(texts, members, used, n), "cls").select("cls", "comp", "block", "shingles")
    # of two blocks the classes of one are the queries, by the parity of both, so that no block has all queries
    odd = F.xxhash64("block").bitwiseXOR(F.xxhash64("there")).bitwiseAND(F.lit(1)) == 1
    asks = F.when(odd, F.col("block") <= F.col("there")).otherwise(F.col("block") >= F.col("there"))
    met = both.where(asks).select("cls", "there")

    # a block is repeated for parts of its queries, each at most about a block
    asked = met.groupBy("there").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("parts"))
    asked = cut_lineage(asked)
    queries = met.join(asked, "there").join(own, "cls").select(
        F.col("there").alias("to"), F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part"), "cls", "comp",
        (F.col("block") == F.col("there")).alias("own"), "shingles",
    )
    index = own.join(asked, F.col("block") == F.col("there")).select(
        F.col("block").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cls", "comp", "shingles"
    )

    index = index.select(*[F.col(c).alias(c) for c in index.columns])  # names of its own, for the cogroup

    def search(key, queries, index):
        links = joining_links(queries, index, threshold) if queries.num_rows and index.num_rows else []
        a, b = zip(*links, strict=True) if links else ((), ())
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return queries.groupBy("to", "part").cogroup(index.groupBy("to", "part")).applyInArrow(search, "a long, b long")
