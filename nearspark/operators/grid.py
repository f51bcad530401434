"""The ``pivots`` plan of the nearest-neighbour join, for wide vectors, where no cut of a single axis keeps rows apart.

Training rows are dealt into blocks around a few far-apart rows, the pivots, and by distance to them. Blocks decide which
pairs are compared, not what moves: both sides are dealt into a grid of places, a place being a run of whole blocks of up to
``GROUP_BYTES``, and of parts of the queries of the same size. A pair of a place and a part is one group of work. A query is
sent once to a place, with one bit for each block there that it visits, so neither side is repeated more often than about
the root of the number of groups, however small the blocks are.

The distances of a block's rows to every pivot lie between two numbers. By the triangle inequality they bound the distance
of a query to anything in the block from below, so blocks beyond a query's k-th distance are left out before any pair is
formed. That k-th distance is passed on from block to block in three rounds: the block that promises most, then about a root
of the blocks in the order of their bounds, then what is left and still within the bound. Blocks are left out only where
the bound, less an allowance for rounding, is above the k-th distance, so the result is exact, ties included.

The ranges are one row a block and are broadcast; blocks are made larger where there would be more than ``MOST_BLOCKS`` (every
query is measured against every block) or that table would exceed ``broadcast_bytes``. Blocks above a place are split by a
hash of the id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.operators.kernel import Best, Shelf, find_in_blocks, squared_sum
from nearspark.operators.knn import PARTIAL, _partial_batch, _side, merge_top_k, vectors
from nearspark.session import cut_lineage

MOST_BLOCKS = 1024
GROUP_BYTES = 32 << 20  # vectors of either side in one group of work
PAIRS_PER_GROUP = 4_000_000  # below that, a group is not cut further to give work to more cores
SCRATCH_BYTES = 32 << 20
STEP_ROWS = 512  # rows that are measured against all pivots or blocks at once: few enough for a processor's own memory


def far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x``, each as far as possible from those before; the first is the one next to the mean."""
    if len(x) == 0:
        return np.zeros((1, x.shape[1]))
    picked = [int(np.argmin(squared_sum(x - x.mean(axis=0))))]
    nearest = squared_sum(x - x[picked[0]])
    while len(picked) < count and nearest.max() > 0:
        picked.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared_sum(x - x[picked[-1]]))
    return x[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of every row to every pivot; summed as ``squared_sum`` does, a column of the rows at a time."""
    total = np.zeros((len(pivots), len(x)))
    for a in range(0, len(x), STEP_ROWS):
        part = total[:, a : a + STEP_ROWS]
        for column, at in zip(np.ascontiguousarray(x[a : a + STEP_ROWS].T), pivots.T):
            diff = column - at[:, None]
            diff *= diff
            part += diff
    return np.sqrt(total, out=total).T.copy()


def leading(bound: np.ndarray, own: np.ndarray, count: int) -> np.ndarray:
    """Flags of the first ``count`` blocks of each row in the order of ``bound``, then ``own``, then position, without sorting them."""
    if count <= 0 or count >= bound.shape[1]:
        return np.full(bound.shape, count > 0)
    key = np.empty(bound.shape, complex)  # ordered by real, then imaginary part
    key.real, key.imag = bound, own
    last = np.partition(key, count - 1, axis=1)[:, count - 1 : count]
    before, same = key < last, key == last
    left = count - before.sum(axis=1, keepdims=True)
    return before | (same & (np.cumsum(same, axis=1) <= left))


def lower_bounds(dist: np.ndarray, lo: np.ndarray, hi: np.ndarray, dims: int) -> np.ndarray:
    """Squared distance that each query (row of distances to the pivots) keeps at least from each block.

    Distances are sums of ``dims`` rounded squares; the allowance is several times what that can add up to.
    """
    slack = 8 * (dims + 8) * np.finfo(float).eps
    gap = np.zeros((len(dist), len(lo)))
    for p in range(dist.shape[1]):
        d = dist[:, p, None]
        np.maximum(gap, d * (1 - slack) - hi[:, p] * (1 + slack), out=gap)
        np.maximum(gap, lo[:, p] * (1 - slack) - d * (1 + slack), out=gap)
    return gap * gap * (1 - slack)


def once(function):
    """Keep Spark from evaluating a Python function a second time in a filter that it derives from the function's result."""
    return function.asNondeterministic()


class Ranges:
    """What tasks know of the blocks: the pivots, and each block's own pivot and range of distances to every pivot."""

    def __init__(self, pivots: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, dims: int):
        self.pivots, self.own, self.lo, self.hi, self.dims = pivots, own, lo, hi, dims

    def wanted(self, x: np.ndarray, within: np.ndarray, first: int, last: int):
        """For some rows at a time, the first of them and a flag for each of their blocks: those at places ``first`` to
        ``last`` of a row's order that are within its bound.

        The order is by bound, then by distance to the block's own pivot; it depends on the row's vector alone.
        """
        step = max(1, min(STEP_ROWS, SCRATCH_BYTES // (8 * max(1, len(self.lo)))))
        for a in range(0, len(x), step):
            dist = distances(x[a : a + step], self.pivots)
            bound = lower_bounds(dist, self.lo, self.hi, self.dims)
            own = dist[:, self.own]
            out = leading(bound, own, last) & ~leading(bound, own, first)
            yield a, out & (bound <= within[a : a + step, None])


class PivotGrid:
    """One join by this plan. ``job`` is a checked join of ``knn``."""

    def __init__(self, job):
        self.job = job
        self.block = max(1, min(job.limits.block_rows, job.limits.block_bytes // (8 * (job.dims + 2))))
        self.pivots = self.choose_pivots()
        self.rows = cut_lineage(self.with_distances(job.without_copies(job.t)))
        self.cuts = self.cut_rings()
        self.t = self.with_block(self.rows)
        self.measure()

    def choose_pivots(self) -> np.ndarray:
        """From a bounded sample: which rows are pivots decides how many blocks are left out, never the result."""
        job = self.job
        wanted = job.limits.sample_bytes // (8 * (job.dims + 2))
        share = min(1.0, wanted / max(1, job.train_rows))
        sample = job.t.select("id", "x")
        side = _side((sample.sample(share, seed=17) if share < 1 else sample).toArrow(), job.dims, False)
        return far_apart(side["x"][np.argsort(side["ids"], kind="stable")], job.limits.pivots)

    def with_distances(self, t: DataFrame) -> DataFrame:
        """Add the distances to all pivots, the number of the nearest and the distance to it; rows with a gap are dropped."""
        pivots, dims = self.job.context.broadcast(self.pivots), self.job.dims

        @F.arrow_udf("array<double>")
        def to_pivots(x: pa.Array) -> pa.Array:
            rows = vectors(x, dims)
            whole = np.isfinite(rows).all(axis=1)
            found = distances(np.where(whole[:, None], rows, 0.0), pivots.value)
            ends = np.concatenate([[0], np.cumsum(np.where(whole, len(pivots.value), 0))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[whole].ravel()))

        near = F.array_min("dists")
        t = t.withColumn("dists", once(to_pivots)("x")).where(F.size("dists") > 0)
        return t.withColumn("near", near).withColumn("pivot", F.array_position("dists", near).cast("int") - 1)

    def cut_rings(self) -> list[np.ndarray]:
        """Distances that cut the rows around each pivot into rings of about a block: quantiles of all rows."""
        sizes = {r["pivot"]: r["n"] for r in self.rows.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        blocks = sum(-(-n // self.block) for n in sizes.values())
        most = max(len(self.pivots), min(MOST_BLOCKS, self.job.limits.broadcast_bytes // (16 * len(self.pivots))))
        rings = {p: max(1, -(-n // self.block) * min(blocks, most) // blocks) for p, n in sizes.items()}
        steps = max(rings.values(), default=1)
        cuts = [np.empty(0) for _ in self.pivots]
        if steps > 1:
            shares = [i / (4 * steps) for i in range(1, 4 * steps)]
            at = F.percentile_approx("near", shares, 20 * steps).alias("at")
            for row in self.rows.groupBy("pivot").agg(at).collect():  # one row a pivot
                want = np.arange(1, rings[row["pivot"]]) / rings[row["pivot"]]
                cuts[row["pivot"]] = np.unique(np.array(row["at"])[np.round(want * 4 * steps).astype(int) - 1])
        return cuts

    def with_block(self, rows: DataFrame) -> DataFrame:
        """Add the block of each training row, as ``cell``."""
        first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])])
        self.own = np.repeat(np.arange(len(self.cuts)), np.diff(first))
        shared = self.job.context.broadcast((first, self.cuts))

        @F.arrow_udf("int")
        def block(pivot: pa.Array, near: pa.Array) -> pa.Array:
            first, cuts = shared.value
            pivot, near = pivot.to_numpy(zero_copy_only=False), near.to_numpy(zero_copy_only=False)
            out = first[pivot]
            for p in np.unique(pivot):
                out[pivot == p] += np.searchsorted(cuts[p], near[pivot == p], side="left")
            return pa.array(out.astype(np.int32))

        return rows.withColumn("cell", once(block)("pivot", "near"))

    def measure(self) -> None:
        """Rows of each block, and its range of distances to every pivot."""
        count = len(self.pivots)
        ends = [f(F.col("dists")[p]).alias(f"{name}{p}") for name, f in (("lo", F.min), ("hi", F.max)) for p in range(count)]
        found = self.t.groupBy("cell").agg(F.count("*").alias("n"), *ends).toArrow()
        at = found.column("cell").to_numpy()
        self.sizes = np.zeros(len(self.own), np.int64)
        self.sizes[at] = found.column("n").to_numpy()
        lo, hi = np.full((len(self.own), count), np.inf), np.full((len(self.own), count), np.inf)  # an empty block is far away
        for p in range(count):
            lo[at, p], hi[at, p] = found.column(f"lo{p}").to_numpy(), found.column(f"hi{p}").to_numpy()
        self.shared = self.job.context.broadcast(Ranges(self.pivots, self.own, lo, hi, self.job.dims))
        self.deal()
        full = int((self.sizes > 0).sum())
        root = 1 + math.isqrt(max(0, full - 1))
        self.steps = [s for s in ((0, 1), (1, 1 + root), (1 + root, len(self.own))) if s[0] < full]

    def deal(self) -> None:
        """Deal blocks into places, and choose the number of parts of the queries: as few copies as the cores and the size of a
        group allow. ``span`` holds the first block and the number of blocks of each place."""
        q_rows, t_rows = max(1, self.job.query_rows), max(1, int(self.sizes.sum()))
        most = max(1, GROUP_BYTES // (8 * (self.job.dims + 2)))
        places, self.q_parts = -(-t_rows // most), -(-q_rows // most)
        groups = min(3 * self.job.context.defaultParallelism, q_rows * t_rows // PAIRS_PER_GROUP)
        while places * self.q_parts < groups:
            if self.q_parts * t_rows >= places * q_rows:
                places += 1
            else:
                self.q_parts += 1
        most = -(-t_rows // places)
        dealt, self.span, room = [], [], 0
        for block, n in enumerate(self.sizes.tolist()):
            if n > most:
                dealt.append((block, len(self.span), -(-n // most)))
                self.span += [(block, 1)] * (-(-n // most))
                room = 0
                continue
            if n > room or not self.span:
                self.span.append((block, 0))
                room = most
            dealt.append((block, len(self.span) - 1, 1))
            self.span[-1] = (self.span[-1][0], block + 1 - self.span[-1][0])
            room -= n
        self.places = self.job.spark.createDataFrame(dealt, "cell int, first int, t_parts int")

    def visits(self, queries: DataFrame, first: int, last: int) -> DataFrame:
        """(id, x, within) -> a row for every place that the query is sent to in this round, with a bit for each block there."""
        shared, span, dims = self.shared, self.span, self.job.dims

        @F.arrow_udf("array<struct<place:int,wanted:binary>>")
        def places_of(x: pa.Array, within: pa.Array) -> pa.Array:
            rows = vectors(x, dims)
            whole = np.flatnonzero(np.isfinite(rows).all(axis=1))
            bound = within.to_numpy(zero_copy_only=False)
            row, place, bits = [np.empty(0, np.int64)], [np.empty(0, np.int32)], []
            for a, wanted in shared.value.wanted(rows[whole], bound[whole], first, last):
                for number, (block, count) in enumerate(span):
                    here = wanted[:, block : block + count]
                    some = np.flatnonzero(here.any(axis=1))
                    row.append(whole[a + some])
                    place.append(np.full(len(some), number, np.int32))
                    bits += [b.tobytes() for b in np.packbits(here[some], axis=1)]
            row, place = np.concatenate(row), np.concatenate(place)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(rows) + 1))
            columns = [pa.array(place[order]), pa.array(bits, pa.binary()).take(pa.array(order))]
            sent = pa.StructArray.from_arrays(columns, names=["place", "wanted"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sent)

        part = F.pmod(F.xxhash64("id"), F.lit(self.q_parts)).cast("int").alias("q_part")
        sent = queries.select("id", "x", "within", part, once(places_of)("x", "within").alias("sent"))
        return sent.select("id", "x", "within", "q_part", F.inline("sent"))

    def rounds(self):
        """For every round: its queries' visits, and the lists that it adds."""
        job = self.job
        queries = job.over_cores(job.q, job.query_rows).withColumn("within", F.lit(float("inf")))
        best = None
        t = self.t.select("id", "code", "x", "cell").join(F.broadcast(self.places), "cell")
        place = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("t_parts"))).cast("int").alias("place")
        parts = F.explode(F.sequence(F.lit(0), F.lit(self.q_parts - 1))).alias("q_part")
        t = t.select("id", "code", "x", "cell", place, parts)
        for i, (first, last) in enumerate(self.steps):
            if best is not None:
                bound = best.where(F.col("rank") == job.k).select(F.col("qid").alias("id"), F.col("dist").alias("kth"))
                queries = job.q.join(bound, "id", "left").withColumn("within", F.coalesce("kth", F.lit(float("inf")))).drop("kth")
            visits = self.visits(queries, first, last)
            found = self.compare(visits, t)
            if best is not None:
                found = best.unionByName(found)
            if i + 1 < len(self.steps):
                best = cut_lineage(merge_top_k(found, job.k))
            yield visits, found

    def compare(self, visits: DataFrame, t: DataFrame) -> DataFrame:
        """The pairs of this round, in groups of at most a place and a part of the queries."""
        k, dims, skip_self, span = self.job.k, self.job.dims, self.job.skip_self, self.span

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.Table.from_batches([_partial_batch(np.empty(0, np.int64), Best.empty(0, k))])
            block, count = span[right["place"][0].as_py()]
            bits = left["wanted"].combine_chunks()
            bits = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(left), -1)
            query, train = _side(left.drop_columns("wanted"), dims, False), _side(right, dims, False)
            cell = right["cell"].to_numpy()[train["rows"]]
            order = np.argsort(cell, kind="stable")
            starts = np.searchsorted(cell[order], np.arange(block, block + count + 1))
            x = train["x"][order]
            shelf = Shelf(x, train["ids"][order], train["codes"][order], starts, x, x, squared_sum(x))
            del train
            best = find_in_blocks(query["x"], query["ids"], shelf, bits[query["rows"]], k, skip_self, query["within"])
            return pa.Table.from_batches([_partial_batch(query["ids"], best)])

        def dealt(rows: DataFrame):
            """A group is a partition of its own: groups are of like size, so two in one task would take twice as long as the others."""
            group = (F.col("place") * self.q_parts + F.col("q_part")).alias("group")
            return rows.select("*", group).drop("q_part").repartitionById(len(span) * self.q_parts, "group").groupBy("group")

        return dealt(visits).cogroup(dealt(t)).applyInArrow(search, PARTIAL)

    def lists(self) -> DataFrame:
        found = None
        for _, found in self.rounds():
            pass
        return found if found is not None else self.job.no_lists()

    def report(self) -> list[dict]:
        """For every round, how often queries visit a block and how many pairs that compares."""

        @F.arrow_udf("array<int>")
        def bits_set(wanted: pa.Array) -> pa.Array:
            return pa.array([np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) for b in wanted.to_pylist()], pa.list_(pa.int32()))

        out = []
        for number, (visits, _) in enumerate(self.rounds(), 1):
            met = np.zeros(len(self.sizes), np.int64)
            for r in visits.select("place", F.explode(bits_set("wanted")).alias("bit")).groupBy("place", "bit").count().collect():  # one row a block
                met[self.span[r["place"]][0] + r["bit"]] += r["count"]
            # a block above a place counts once in each of its places, with its share of the rows
            places = np.bincount([b for b, n in self.span if n == 1], minlength=len(self.sizes)).clip(1)
            out.append({"round": number, "visits": int(met.sum()), "pairs": int((met * self.sizes / places).sum())})
        return out


def pivot_report(job) -> dict:
    """Blocks, rounds and the share of all pairs that a join by this plan never compares."""
    grid = PivotGrid(job)
    rounds = grid.report()
    everything = job.query_rows * int(grid.sizes.sum())
    compared = sum(r["pairs"] for r in rounds)
    return {"blocks": int((grid.sizes > 0).sum()), "rounds": rounds, "skipped": 1 - compared / max(1, everything)}
