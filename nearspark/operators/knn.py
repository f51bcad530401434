"""Exact k-nearest-neighbour join: k lowest squared Euclidean distances, ties by ascending training id.

Four ways to run it, all with the same rows as result:

* ``broadcast_train``   - a training table of checked size goes to every task; queries are neither moved nor merged.
* ``broadcast_queries`` - a query table of checked size goes to every task; each task reads its part of the training
  table once and returns k rows per query, which are merged by a window.
* ``cells``             - both sides are large: rows are grouped by cell of feature space (and stratum), a query is
  sent only to the cells that can hold its neighbours, and the partial lists are merged by the same window.
* ``pivots``            - the same for vectors too wide for cells: a grid of blocks around far-apart rows (``grid``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearspark.operators import cells
from nearspark.operators.kernel import DIRECT_DIMS, NO_ID, Best, build_shelf, find_nearest
from nearspark.session import cut_lineage, ship_package

PLANS = ("auto", "broadcast_train", "broadcast_queries", "cells", "pivots")

PARTIAL = "qid bigint, rank int, tid bigint, label bigint, dist double"
ENTRIES = "array<struct<dist:double,tid:bigint,label:bigint>>"
VISITS = "array<struct<cell:int,within:double>>"


@dataclass(frozen=True)
class KnnLimits:
    """Sizes that steer the choice of plan and the size of one task's work."""

    broadcast_bytes: int = 64 << 20  # vectors of a side that is sent to every task
    block_rows: int = 1 << 17  # rows of either side in one group of the ``cells`` plan
    block_bytes: int = 64 << 20
    sample_bytes: int = 32 << 20  # training rows sampled to place the cut planes
    scan_bytes: int = 128 << 20  # training bytes per task, to estimate the number of tasks
    pivots: int = 16  # rows that blocks of wide vectors are measured from


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    *,
    qid: str = "qid",
    tid: str = "tid",
    features: str = "features",
    label: str | None = None,
    by: str | None = None,
    exclude_self: bool = False,
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
) -> DataFrame:
    """For each query row, its ``k`` nearest training rows: ``(qid, rank, tid, [label], dist)``.

    ``qid`` and ``tid`` are unique integer ids. ``label`` names an integer class code to carry along. With ``by`` only
    rows with an equal value of that column are compared. ``exclude_self`` leaves out the row with the query's own id.
    A query with fewer than ``k`` candidates gets what exists; rows without a complete, finite vector take no part.
    """
    job = _Job(queries, train, k, qid, tid, features, label, by, exclude_self, [], plan, limits)
    if job.plan == "broadcast_train":
        found = _ranked(job.broadcast_train())
    else:
        found = job.merged_lists()
    carried = [F.col("label").cast(train.schema[label].dataType).alias(label)] if label else []
    return found.select("qid", "rank", "tid", *carried, "dist")


def nearest_lists(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    *,
    qid: str = "qid",
    tid: str = "tid",
    features: str = "features",
    label: str | None = None,
    by: str | None = None,
    exclude_self: bool = False,
    carry: list[str] | tuple[str, ...] = (),
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
) -> DataFrame:
    """One row per query: ``(qid, *carry, neighbors)`` with ``neighbors`` an array of ``(dist, tid, label)``, nearest
    first; empty for a query without candidates. With a broadcast training table nothing is shuffled.
    """
    job = _Job(queries, train, k, qid, tid, features, label, by, exclude_self, list(carry), plan, limits)
    if job.plan == "broadcast_train":
        return job.broadcast_train()
    if job.plan == "cells":
        return job.cells(as_lists=True)
    lists = neighbor_lists(job.merged_lists(), "label")
    rows = queries.select(F.col(qid).cast("bigint").alias("qid"), *carry).join(lists, "qid", "left")
    none = F.array().cast(ENTRIES)
    return rows.select("qid", *carry, F.coalesce(F.col("neighbors").cast(ENTRIES), none).alias("neighbors"))


def merge_top_k(partial: DataFrame, k: int, qid: str = "qid", dist: str = "dist", tid: str = "tid") -> DataFrame:
    """Merge partial neighbour lists into the true k nearest per query; Spark limits per task before the shuffle."""
    order = Window.partitionBy(qid).orderBy(dist, tid)
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbor_lists(neighbors: DataFrame, *carried: str) -> DataFrame:
    """One row per query with its neighbours as an array sorted by distance, then id (k entries per query)."""
    entry = F.struct("dist", "tid", *carried)
    return neighbors.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("neighbors"))


def _ranked(lists: DataFrame) -> DataFrame:
    """A row for every neighbour of ``(qid, neighbors)``."""
    entries = lists.select("qid", F.posexplode("neighbors").alias("rank", "e"))
    return entries.select("qid", (F.col("rank") + 1).alias("rank"), "e.*")


def first_k(neighbors: DataFrame, k: int) -> DataFrame:
    return neighbors.where(F.col("rank") <= k)


# ---- inside the tasks ------------------------------------------------------------------------------------------


def vectors(column, dims: int) -> np.ndarray:
    """Arrow list column to a matrix; a vector of another length is an error, a NULL entry becomes NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (np.diff(column.offsets.to_numpy()) != dims).any():
        raise ValueError(f"expected vectors of length {dims}")
    return np.asarray(flat, dtype=np.float64).reshape(len(column), dims)


def _rows_by_group(column, rows: int):
    """(value, row positions) per distinct value of the column; a single group when there is none."""
    if column is None:
        yield None, np.arange(rows)
        return
    encoded = column.dictionary_encode()
    codes = encoded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    for value, a, b in zip(encoded.dictionary.to_pylist(), cuts[:-1], cuts[1:]):
        yield value, order[a:b]


def _tables(batches, rows: int):
    """Regroup Arrow batches into tables of about ``rows`` rows, so that numpy works on sizeable blocks."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _side(table: pa.Table, dims: int, grouped: bool) -> dict:
    """Arrays of one side: vectors, ids, class codes and the row positions of every group.

    ``rows`` holds the positions in the table of the rows that have a complete, finite vector (and a stratum).
    """
    present = pc.is_valid(table["x"])
    if grouped:
        present = pc.and_(present, pc.is_valid(table["grp"]))
    rows = np.flatnonzero(present.to_numpy())
    if len(rows) < len(table):
        table = table.filter(present)
    table = table.combine_chunks()
    column = {name: _one_chunk(table[name]) for name in table.schema.names}
    x = vectors(column["x"], dims)
    whole = np.isfinite(x).all(axis=1)
    if not whole.all():
        column = {name: c.filter(pa.array(whole)) for name, c in column.items()}
        x, rows = x[whole], rows[whole]
    return {
        "x": x,
        "rows": rows,
        "ids": column["id"].to_numpy(zero_copy_only=False),
        "codes": column["code"].to_numpy(zero_copy_only=False) if "code" in column else None,
        "within": column["within"].to_numpy(zero_copy_only=False) if "within" in column else None,
        "groups": dict(_rows_by_group(column["grp"] if grouped else None, len(x))),
    }


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays([pa.array([], column.type), *column.chunks])


def _shelf(side: dict, value):
    """Arranged rows of one group, built on first use and kept with the broadcast value for later tasks."""
    shelves = side.setdefault("shelves", {})
    if value not in shelves:
        rows, codes = side["groups"].get(value), side["codes"]
        if rows is None:
            shelves[value] = None
        else:
            if side.get("keep"):
                rows = rows[cells.lowest_copies(side["x"][rows], side["ids"][rows], side["keep"])]
            shelves[value] = build_shelf(side["x"][rows], side["ids"][rows], None if codes is None else codes[rows])
    return shelves[value]


def _partial_batch(qids: np.ndarray, best: Best) -> pa.RecordBatch:
    row, rank = np.nonzero(best.ids != NO_ID)
    arrays = [qids[row], (rank + 1).astype(np.int32), best.ids[row, rank], best.codes[row, rank], best.dist[row, rank]]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["qid", "rank", "tid", "label", "dist"])


def _entries(best: Best) -> pa.ListArray:
    row, rank = np.nonzero(best.ids != NO_ID)
    ends = np.searchsorted(row, np.arange(len(best.ids) + 1)).astype(np.int32)
    arrays = [best.dist[row, rank], best.ids[row, rank], best.codes[row, rank]]
    entries = pa.StructArray.from_arrays([pa.array(a) for a in arrays], names=["dist", "tid", "label"])
    return pa.ListArray.from_arrays(pa.array(ends), entries)


# ---- the plans -------------------------------------------------------------------------------------------------


class _Job:
    """One join: checked arguments, both sides under fixed column names ``(id, [grp], x, ...)``, and the chosen plan."""

    def __init__(self, queries, train, k, qid, tid, features, label, by, exclude_self, carry, plan, limits):
        if k < 1:
            raise ValueError("k must be at least 1")
        if plan not in PLANS:
            raise ValueError(f"unknown plan {plan!r}, expected one of {PLANS}")
        if label is not None and not isinstance(train.schema[label].dataType, T.IntegralType):
            raise TypeError(f"{label!r} must hold integer class codes; encode it first")
        self.spark = train.sparkSession
        self.context = self.spark.sparkContext
        ship_package(self.spark)
        self.k, self.skip_self, self.limits, self.carry = k, exclude_self, limits, carry
        self.keep = k + 1 if exclude_self else k  # copies of one vector that can be neighbours
        self.whole = False  # whether partial lists are whole
        self.grouped, self.keys = by is not None, ["grp"] if by else []

        def side(df, key, *more):
            group = [F.col(by).alias("grp")] if by else []
            return df.select(F.col(key).cast("bigint").alias("id"), *group, F.col(features).cast("array<double>").alias("x"), *more)

        code = F.col(label).cast("bigint") if label else F.lit(0).cast("bigint")
        self.all_queries = side(queries, qid, *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
        self.present = " AND ".join(f"{c} IS NOT NULL" for c in ["x", *self.keys])
        self.q, self.t = (
            s.where(self.present)
            for s in (side(queries, qid), side(train, tid, code.alias("code")))
        )
        # sizes of the inputs as they are: an upper bound that needs no vectors, only file footers for a plain scan
        self.query_rows, self.train_rows = queries.count(), train.count()
        first = self.t.select(F.size("x")).head() or self.q.select(F.size("x")).head()
        self.dims = first[0] if first else 1
        self.plan = self.choose(plan)

    def choose(self, plan: str) -> str:
        """Broadcast a side only if its vectors fit the limit; queries only if the partial lists stay below a shuffle
        of the training table."""
        row_bytes = 8 * (self.dims + 2)
        if self.grouped:
            row_bytes += 8 if isinstance(self.t.schema["grp"].dataType, T.NumericType) else 64
        limit = self.limits.broadcast_bytes
        fits = {
            "broadcast_train": self.train_rows * row_bytes <= limit,
            "broadcast_queries": self.query_rows * (row_bytes + 24 * self.k) <= limit,
        }
        if plan != "auto":
            if not fits.get(plan, True):
                raise ValueError(f"{plan}: the table is larger than broadcast_bytes = {limit}")
            if plan == "pivots" and self.grouped:
                raise ValueError("pivots: rows are compared across the whole table; use cells with strata")
            return plan
        if fits["broadcast_train"]:
            return "broadcast_train"
        tasks = max(self.context.defaultParallelism, self.train_rows * row_bytes // self.limits.scan_bytes)
        few = self.query_rows * self.k * tasks <= self.train_rows
        if fits["broadcast_queries"] and few:
            return "broadcast_queries"
        return "cells" if self.grouped or self.dims <= DIRECT_DIMS else "pivots"

    def over_cores(self, df: DataFrame, rows: int) -> DataFrame:
        """Spread a small table, which may be a single split, over the cores; a large one has splits enough."""
        if rows * 8 * self.dims > self.limits.broadcast_bytes:
            return df
        pairs = rows * max(1, self.train_rows)  # work is pairs, so few queries against much data still use the cores
        return df.repartition(max(1, min(self.context.defaultParallelism, rows, pairs // 1_000_000)), "id")

    def rows_at_once(self) -> int:
        """Rows of one Arrow table in a task, with their lists: at most 262,144 of few dimensions, where queries that are handled
        together lie the closer the more there are; at most 50,000 of wide vectors."""
        most = 1 << 18 if self.dims <= DIRECT_DIMS else 50_000
        return max(1, min(most, self.limits.block_bytes // (8 * (self.dims + 2 + 3 * self.k))))

    def without_copies(self, t: DataFrame) -> DataFrame:
        """Of equal vectors only the k lowest ids (one more without self) can be neighbours; the rest is left out.

        The rank limit runs before the shuffle too, so a group of copies never travels whole. Spark leaves that step out
        for large k; then the copies are first ranked in parts, by a hash of their id.
        """
        keep = self.keep
        vector = [F.xxhash64("x"), "x", *self.keys]

        def lowest(rows: DataFrame, *part) -> DataFrame:
            copies = Window.partitionBy(*vector, *part).orderBy("id")
            return rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= keep).drop("copy")

        if keep > int(self.spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
            parts = max(1, self.train_rows // self.limits.block_rows)
            t = lowest(t, F.pmod(F.xxhash64("id"), F.lit(parts)))
        return lowest(t)

    def broadcast_train(self) -> DataFrame:
        """``(qid, *carry, neighbors)`` for every query row, without a shuffle of a large query table."""
        k, dims, skip_self, grouped = self.k, self.dims, self.skip_self, self.grouped
        shared = self.context.broadcast(_side(self.without_copies(self.t).toArrow(), dims, grouped))
        q = self.over_cores(self.all_queries, self.query_rows)
        kept = [c for c in q.columns if c not in ("x", "grp")]
        rows_at_once = self.rows_at_once()

        def search(batches):
            train = shared.value
            for table in _tables(batches, rows_at_once):
                side = _side(table, dims, grouped)
                best = Best.empty(len(table), k)
                for value, rows in side["groups"].items():
                    shelf = _shelf(train, value)
                    if shelf is not None:
                        part = find_nearest(side["x"][rows], side["ids"][rows], shelf, k, skip_self)
                        at = side["rows"][rows]
                        best.dist[at], best.ids[at], best.codes[at] = part.dist, part.ids, part.codes
                yield from table.select(kept).append_column("neighbors", _entries(best)).to_batches()

        schema = T.StructType([q.schema[c] for c in kept]).add("neighbors", T._parse_datatype_string(ENTRIES))
        found = q.mapInArrow(search, schema)
        carried = [F.col(f"carried_{i}").alias(c) for i, c in enumerate(self.carry)]
        return found.select(F.col("id").alias("qid"), *carried, "neighbors")

    def merged_lists(self) -> DataFrame:
        """The k nearest of every query: ``(qid, rank, tid, label, dist)``; partial lists are merged where there are several."""
        if self.plan == "cells":
            found = self.cells()
            return found if self.whole else _ranked(found)
        if self.plan == "pivots":
            from nearspark.operators.grid import PivotGrid  # it builds on this module

            found = PivotGrid(self).lists()
        else:
            found = self.broadcast_queries()
        return merge_top_k(found, self.k)

    def no_lists(self) -> DataFrame:
        return self.spark.createDataFrame([], PARTIAL)

    def broadcast_queries(self) -> DataFrame:
        k, dims, skip_self, grouped = self.k, self.dims, self.skip_self, self.grouped
        shared = self.context.broadcast(_side(self.q.toArrow(), dims, grouped))
        rows_at_once = self.rows_at_once()

        def search(batches):
            query = shared.value
            best = Best.empty(len(query["ids"]), k)
            for table in _tables(batches, rows_at_once):
                train = _side(table, dims, grouped)
                for value, rows in query["groups"].items():
                    shelf = _shelf(train, value)
                    if shelf is not None:
                        part = Best(best.dist[rows], best.ids[rows], best.codes[rows])
                        find_nearest(query["x"][rows], query["ids"][rows], shelf, k, skip_self, part)
                        best.dist[rows], best.ids[rows], best.codes[rows] = part.dist, part.ids, part.codes
            yield _partial_batch(query["ids"], best)

        return self.over_cores(self.t, self.train_rows).mapInArrow(search, PARTIAL)

    def cells(self, as_lists: bool = False) -> DataFrame:
        """``(qid, *carry, neighbors)`` of all query rows; if ``whole`` is set by this call, which then means that each query met
        all its candidates in one group, only with ``as_lists``, and a row for every neighbour without."""
        dims = self.dims
        block = max(1, min(self.limits.block_rows, self.limits.block_bytes // (8 * (dims + 2))))
        split = _CellSplit(self, block)
        t = split.place_train(self.t)
        # Cells that stay larger than a block hold equal vectors mostly; there are at most train_rows / block of them.
        t_cells = F.broadcast(split.parts)
        self.whole = not split.any_large  # each query meets all of its stratum in one group
        if split.full:
            # cells within a block leave copies out in their group; only what is above one is moved for it
            t, full = cut_lineage(t), F.col("cell").isin(split.full)
            t = t.where(~full).unionByName(self.without_copies(t.where(full)))
        t = split.with_home(_pick(t, t_cells, "t_parts"))
        as_lists |= not self.whole
        queries = self.all_queries.where(self.present) if as_lists else self.q
        q = split.with_home(_spread(split.route(self.over_cores(queries, self.query_rows)), t_cells, "t_parts"))

        # Groups that attract more queries than a block are split on the query side and their training rows repeated.
        # The counts come from a sample: they balance the work and have no influence on the result. They are written
        # once, and joined without a broadcast hint, so Spark decides by the measured size.
        place = ["home", "cell", "t_part"]
        if self.query_rows > block:
            share = min(1.0, max(0.001, 200_000 / self.query_rows))
            seen = _spread(split.route(self.q.sample(share, seed=29) if share < 1 else self.q), t_cells, "t_parts")
            seen = split.with_home(seen)
            load = seen.groupBy(*place).agg((F.count("*") / share).alias("n")).where(F.col("n") > block)
            load = cut_lineage(load.select(*place, F.ceil(F.col("n") / block).cast("int").alias("q_parts")))
            t, q = _spread(t, load, "q_parts"), _pick(q, load, "q_parts")
            place = [*place, "q_part"]
        return self.list_groups(q, t, place) if as_lists else self.compare_groups(q, t, place)

    def compare_groups(self, q: DataFrame, t: DataFrame, place: list[str]) -> DataFrame:
        """The neighbours among the training rows that the queries meet at the same ``place``; copies that can't be among them
        are left out there."""
        k, dims, skip_self, grouped, keep = self.k, self.dims, self.skip_self, self.grouped, self.keep

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            query, train = _side(left, dims, grouped), _side(right, dims, grouped)
            train["keep"] = keep
            best = Best.empty(len(query["ids"]), k)
            for value, rows in query["groups"].items():  # the strata that share this home
                shelf = _shelf(train, value)
                if shelf is not None:
                    within = query["within"][rows]
                    part = find_nearest(query["x"][rows], query["ids"][rows], shelf, k, skip_self, within=within)
                    best.dist[rows], best.ids[rows], best.codes[rows] = part.dist, part.ids, part.codes
            return pa.Table.from_batches([_partial_batch(query["ids"], best)])

        return q.groupBy(*place).cogroup(t.groupBy(*place)).applyInArrow(search, PARTIAL)

    def list_groups(self, q: DataFrame, t: DataFrame, place: list[str]) -> DataFrame:
        """``(qid, *carry, neighbors)`` of every query row. A query that meets its candidates in several groups has a list from
        each, in order: the lists are merged, not their rows."""
        k, dims, skip_self, grouped, keep = self.k, self.dims, self.skip_self, self.grouped, self.keep
        kept = [c for c in self.all_queries.columns if c not in ("x", "grp")]

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            query, train = _side(left, dims, grouped), _side(right, dims, grouped)
            train["keep"] = keep
            best = Best.empty(len(left), k)
            for value, rows in query["groups"].items():
                shelf = _shelf(train, value)
                if shelf is not None:
                    within = query["within"][rows]
                    part = find_nearest(query["x"][rows], query["ids"][rows], shelf, k, skip_self, within=within)
                    at = query["rows"][rows]
                    best.dist[at], best.ids[at], best.codes[at] = part.dist, part.ids, part.codes
            return left.select(kept).append_column("neighbors", _entries(best))

        schema = T.StructType([self.all_queries.schema[c] for c in kept]).add("neighbors", T._parse_datatype_string(ENTRIES))
        found = q.groupBy(*place).cogroup(t.groupBy(*place)).applyInArrow(search, schema)
        if not self.whole:
            first = [F.any_value(c).alias(c) for c in kept if c != "id"]
            found = found.groupBy("id").agg(*first, F.collect_list("neighbors").alias("lists"))
            merged = F.slice(F.array_sort(F.flatten("lists")), 1, k)
            found = found.select(*kept, F.when(F.size("lists") == 1, F.col("lists")[0]).otherwise(merged).alias("neighbors"))
        others = self.all_queries.where(f"NOT ({self.present})").select(*kept, F.array().cast(ENTRIES).alias("neighbors"))
        carried = [F.col(f"carried_{i}").alias(c) for i, c in enumerate(self.carry)]
        return found.unionByName(others).select(F.col("id").alias("qid"), *carried, "neighbors")


class _CellSplit:
    """Where the cells of one join are: a tree for each stratum above one block, of which there are at most
    train_rows / block. Other strata are not cut; their rows are at cell -1."""

    def __init__(self, job: _Job, block: int):
        self.job, self.block = job, block
        if job.train_rows <= block:
            large = {}
        elif job.grouped:
            sizes = job.t.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()
            large = {row["grp"]: row["n"] for row in sizes}
        else:
            large = {None: job.train_rows}
        self.any_large = bool(large)
        self.full: list[int] = []  # cells with more rows than a block, copies included
        self.roots = {g: i for i, g in enumerate(large)}
        self.parts = job.spark.createDataFrame([], "cell int, t_parts int")
        if large:
            self.sample_and_cut(sum(large.values()))

    def sample_and_cut(self, rows: int) -> None:
        """Trees from a sample of each large stratum, then cells that hold too much are cut again from samples of their own."""
        job = self.job
        sample_rows = max(1, job.limits.sample_bytes // (8 * (job.dims + 2)))
        share = min(1.0, sample_rows / rows, 128 / self.block)  # 32 sample rows for a quarter of a block
        sample = self.with_root(job.t).where("root >= 0").sample(share, seed=17).drop("root", "code").toArrow()
        side = _side(sample, job.dims, job.grouped)
        rows_of = {self.roots[g]: side["x"][at] for g, at in side["groups"].items()}
        fill = self.block / 4
        self.forest = cells.Forest(len(self.roots))
        self.forest.grow(rows_of, max(8, math.ceil(share * fill)))
        if not self.cuts_pay(side):
            # in many dimensions a query has to visit most cells anyway: then as few cells as blocks are enough
            fill = self.block
            self.forest = cells.Forest(len(self.roots))
            self.forest.grow(rows_of, max(8, math.ceil(share * fill)))
        self.share_forest(side)
        done: set[int] = set()
        while True:
            sizes = self.oversized()
            wide = {c: n for c, n in sizes.items() if c not in done}
            if not wide:
                break
            # as many at once as the sample has rows enough to cut
            wide = dict(sorted(wide.items(), key=lambda c: -c[1])[: max(1, sample_rows // 32)])
            done |= set(wide)
            share = min(1.0, sample_rows / sum(wide.values()), 128 / self.block)
            again = self.place_train(job.t).where(F.col("cell").isin(list(wide))).sample(share, seed=31)
            found = _side(again.select("id", "x", F.col("cell").alias("grp")).toArrow(), job.dims, True)
            self.forest.grow({c: found["x"][at] for c, at in found["groups"].items()}, max(8, math.ceil(share * fill)))
            self.share_forest(side)
        parts = [(int(c), -(-int(n) // self.block)) for c, n in sizes.items()]
        if parts:
            self.parts = job.spark.createDataFrame(parts, "cell int, t_parts int")

    def share_forest(self, side: dict) -> None:
        self.shared = self.job.context.broadcast({"forest": self.forest, "sample": side, "roots": self.roots})

    def cuts_pay(self, side: dict) -> bool:
        """Whether queries next to sample rows visit less than half of the cells of their trees."""
        lo, hi = self.forest.regions(self.job.dims)
        met = every = 0
        for g, at in side["groups"].items():
            probes = at[:: max(1, len(at) * len(side["groups"]) // 256)]
            shelf = build_shelf(side["x"][at], side["ids"][at])
            within = find_nearest(side["x"][probes], side["ids"][probes], shelf, self.job.k, True).dist[:, -1]
            rows, _ = self.forest.leaves_within(np.full(len(probes), self.roots[g]), side["x"][probes], within, lo, hi)
            met += len(rows)
            every += len(probes) * self.forest.leaves_of(self.roots[g])
        return met <= every / 2

    def with_root(self, df: DataFrame) -> DataFrame:
        """Add the root of the tree of the row's stratum, -1 if it has none."""
        if not self.job.grouped:
            return df.withColumn("root", F.lit(self.roots.get(None, -1)))
        if not self.roots:
            return df.withColumn("root", F.lit(-1))
        schema = T.StructType([df.schema["grp"], T.StructField("root", T.IntegerType())])
        listed = self.job.spark.createDataFrame(list(self.roots.items()), schema)
        return df.join(F.broadcast(listed), "grp", "left").fillna(-1, ["root"])

    def with_home(self, df: DataFrame) -> DataFrame:
        """Add the group of strata that a row is sent to.

        A stratum with cells has a home of its own. The others, none of which fills a block, share homes by hash, at most about
        a quarter of a block in each, so that the number of groups follows the rows and not the strata.
        """
        if not self.job.grouped:
            return df.withColumn("home", F.lit(0).cast("bigint"))
        # several homes a core as well, so that cores are kept alike
        few = max(8 * self.job.context.defaultParallelism, -(-4 * self.job.train_rows // self.block))
        own = F.xxhash64("grp")
        return df.withColumn("home", F.when(F.col("cell") >= 0, own).otherwise(F.pmod(own, F.lit(few))))

    def place_train(self, t: DataFrame) -> DataFrame:
        """Add the cell of each training row."""
        if not self.any_large:
            return t.withColumn("cell", F.lit(-1))
        shared, dims = self.shared, self.job.dims

        @F.arrow_udf("int")
        def leaf(root: pa.Array, x: pa.Array) -> pa.Array:
            return pa.array(shared.value["forest"].leaf_of(root.to_numpy(), vectors(x, dims)).astype(np.int32))

        return self.with_root(t).withColumn("cell", leaf("root", "x")).drop("root")

    def oversized(self) -> dict[int, int]:
        """Cells with more distinct rows than a block, and how many; only cells with more rows than that are looked into."""
        placed = self.place_train(self.job.t)
        rows = placed.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > self.block)
        self.full = full = [r["cell"] for r in rows.select("cell").collect()]
        if not full:
            return {}
        distinct = F.approx_count_distinct(F.xxhash64("x")) * self.job.keep
        sizes = placed.where(F.col("cell").isin(full)).groupBy("cell").agg(F.least(F.count("*"), distinct).alias("n"))
        return {r["cell"]: r["n"] for r in sizes.where(F.col("n") > self.block).collect()}

    def route(self, q: DataFrame) -> DataFrame:
        """One row per query and cell it has to visit, with an upper bound of its k-th distance; one in all for a query without
        a finite vector, which finds nothing there."""
        keys = self.job.keys
        if not self.any_large:
            return q.withColumn("cell", F.lit(-1)).withColumn("within", F.lit(float("inf")))
        shared, dims, k, skip_self = self.shared, self.job.dims, self.job.k, self.job.skip_self

        def visits(x, ids, roots, groups=None):
            held = shared.value
            if "regions" not in held:
                held["regions"] = held["forest"].regions(dims)
            lo, hi = held["regions"]
            x, ids, roots = vectors(x, dims), ids.to_numpy(), roots.to_numpy()
            within = np.full(len(x), np.inf)
            finite = np.isfinite(x).all(axis=1)
            for value, rows in _rows_by_group(groups, len(x)):
                rows = rows[finite[rows]]
                shelf = _shelf(held["sample"], value) if len(rows) and value in held["roots"] else None
                if shelf is not None:
                    within[rows] = find_nearest(x[rows], ids[rows], shelf, k, skip_self).dist[:, -1]
            whole = np.flatnonzero(finite)
            row, cell = held["forest"].leaves_within(roots[whole], x[whole], within[whole], lo, hi)
            row, cell = np.append(whole[row], np.flatnonzero(~finite)), np.append(cell, roots[~finite])
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
            arrays = [pa.array(cell[order].astype(np.int32)), pa.array(within[row[order]])]
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, names=["cell", "within"]))

        if keys:

            @F.arrow_udf(VISITS)
            def cells_of(x: pa.Array, ids: pa.Array, roots: pa.Array, groups: pa.Array) -> pa.Array:
                return visits(x, ids, roots, groups)
        else:

            @F.arrow_udf(VISITS)
            def cells_of(x: pa.Array, ids: pa.Array, roots: pa.Array) -> pa.Array:
                return visits(x, ids, roots)

        return self.with_root(q).select(*q.columns, F.inline(cells_of("x", "id", "root", *keys)))


def _parts(df: DataFrame, parts: DataFrame, name: str, part: Column) -> DataFrame:
    """Join the number of parts of the row's place (one unless listed) and add the part column."""
    on = [c for c in parts.columns if c != name]
    joined = df.join(parts, on, "left").withColumn(name, F.coalesce(name, F.lit(1)))
    return joined.withColumn(name[:-1], part).drop(name)


def _spread(df: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Repeat each row for every part of its place."""
    return _parts(df, parts, name, F.explode(F.sequence(F.lit(0), F.col(name) - 1)))


def _pick(df: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Give each row one of the parts of its place, by a hash of its id."""
    return _parts(df, parts, name, F.pmod(F.xxhash64("id"), F.col(name)).cast("int"))
