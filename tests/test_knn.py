"""The three plans against a brute-force loop that shares no code with them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspark.operators.knn import KnnLimits, first_k, knn_join, merge_top_k, nearest_lists, neighbor_lists

PLANS = ["broadcast_train", "broadcast_queries", "cells"]
SMALL = KnnLimits(block_rows=64)


def make(spark, x, ids, labels, strata=None):
    strata = [0] * len(ids) if strata is None else strata
    rows = [(int(i), [float(v) for v in f], int(c), int(s)) for i, f, c, s in zip(ids, x, labels, strata)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int, stratum int")


def brute(q, t, k, exclude_self=False, by=False):
    """Expected {(qid, rank): (tid, label, dist)} from plain Python loops."""
    out = {}
    for qi, qf, _, qs in q:
        found = []
        for ti, tf, tc, ts in t:
            if (by and ts != qs) or (exclude_self and ti == qi):
                continue
            d = 0.0
            for a, b in zip(tf, qf):
                d += (a - b) * (a - b)
            found.append((d, ti, tc))
        for rank, (d, ti, tc) in enumerate(sorted(found)[:k], 1):
            out[qi, rank] = (ti, tc, d)
    return out


def result(df):
    return {(r["qid"], r["rank"]): (r["tid"], r["label"], r["dist"]) for r in df.collect()}


def rows(df):
    return [tuple(r) for r in df.collect()]


def sample(seed, n, dims, grid=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    return (np.round(x * 2) if grid else x), rng.permutation(n), rng.integers(0, 4, n), rng.integers(0, 3, n)


def join(q, t, k, plan, **kw):
    return knn_join(q, t, k, qid="id", tid="id", label="label", plan=plan, **kw)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("dims,grid", [(3, False), (2, True), (12, False)])
def test_matches_brute_force(spark, plan, dims, grid):
    q = make(spark, *sample(1, 90, dims, grid))
    t = make(spark, *sample(2, 700, dims, grid))
    got = result(join(q, t, 4, plan, limits=SMALL))
    assert got == brute(rows(q), rows(t), 4)


@pytest.mark.parametrize("plan", PLANS)
def test_self_join_with_strata_and_hot_copies(spark, plan):
    x, ids, labels, strata = sample(3, 600, 2)
    x[:200] = [0.25, -1.5]  # a third of the rows are copies of one vector
    strata[:450] = 1  # and one stratum holds most rows
    t = make(spark, x, ids, labels, strata)
    for by in (None, "stratum"):
        got = result(join(t, t, 3, plan, exclude_self=True, by=by, limits=SMALL))
        assert got == brute(rows(t), rows(t), 3, exclude_self=True, by=by is not None)


def test_many_small_strata_share_homes(spark):
    x, ids, labels, _ = sample(15, 500, 2, True)
    strata = np.where(np.arange(500) < 150, 1000, np.arange(500) % 90)  # one stratum is cut, ninety fit into a block
    t = make(spark, x, ids, labels, strata)
    found = join(t, t, 3, "cells", exclude_self=True, by="stratum", limits=SMALL)
    assert result(found) == brute(rows(t), rows(t), 3, exclude_self=True, by=True)
    assert "home" in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("plan", ["broadcast_train", "cells"])
def test_copies_are_ranked_in_parts_where_spark_has_no_early_limit(spark, plan):
    x, ids, labels, strata = sample(16, 400, 2)
    x[:300] = [1.0, 2.0]
    t = make(spark, x, ids, labels, strata)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        got = result(join(t, t, 4, plan, exclude_self=True, limits=SMALL))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert got == brute(rows(t), rows(t), 4, exclude_self=True)


@pytest.mark.parametrize("plan", PLANS)
def test_same_rows_for_any_partitioning(spark, plan):
    q, t = make(spark, *sample(4, 60, 3, True)), make(spark, *sample(5, 300, 3, True))
    runs = [result(join(q.repartition(n), t.repartition(n), 5, plan, limits=SMALL)) for n in (1, 4, 17)]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("plan", PLANS)
def test_fewer_candidates_than_k_and_missing_vectors(spark, plan):
    t = spark.createDataFrame(
        [(1, [0.0, 0.0], 0), (2, [3.0, 4.0], 1), (3, None, 1), (4, [float("nan"), 0.0], 1)],
        "id bigint, features array<double>, label int",
    )
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, None)], "id bigint, features array<double>")
    assert result(join(q, t, 5, plan)) == {(7, 1): (1, 0, 0.0), (7, 2): (2, 1, 25.0)}


def test_empty_training_table(spark):
    q = make(spark, *sample(6, 5, 2))
    assert join(q, q.where("false"), 3, "auto").count() == 0


def test_unequal_vector_lengths_are_an_error(spark):
    t = spark.createDataFrame([(1, [0.0]), (2, [1.0, 2.0])], "id bigint, features array<double>")
    with pytest.raises(Exception, match="length 1"):
        knn_join(t, t, 1, qid="id", tid="id").collect()


def test_argument_checks(spark):
    t = make(spark, *sample(6, 5, 2))
    with pytest.raises(ValueError, match="unknown plan"):
        join(t, t, 3, "fast")
    with pytest.raises(ValueError, match="k must be"):
        join(t, t, 0, "auto")
    with pytest.raises(TypeError, match="integer class codes"):
        join(t, t.withColumn("label", F.col("label").cast("string")), 1, "auto")


def test_merge_keeps_the_true_nearest(spark):
    parts = [(1, 1.0, 11), (1, 2.0, 12), (1, 3.0, 13), (1, 0.5, 21), (1, 10.0, 22), (1, 11.0, 23)]
    merged = merge_top_k(spark.createDataFrame(parts, "qid bigint, dist double, tid bigint"), 3)
    assert [r["dist"] for r in merged.orderBy("rank").collect()] == [0.5, 1.0, 2.0]
    once = merge_top_k(spark.createDataFrame(parts[:3], merged.schema[:3]), 3)
    again = merge_top_k(once.drop("rank").union(spark.createDataFrame(parts[3:], merged.schema[:3])), 3)
    assert sorted(again.collect()) == sorted(merged.collect())


def test_lists_and_first_k(spark):
    t = make(spark, *sample(8, 40, 2))
    found = join(t, t, 4, "auto", exclude_self=True)
    lists = {r["qid"]: [e["tid"] for e in r["neighbors"]] for r in neighbor_lists(found).collect()}
    flat = result(found)
    assert all(tids == [flat[q, r][0] for r in range(1, 5)] for q, tids in lists.items())
    assert first_k(found, 2).count() == 80


def test_plan_choice_by_size(spark):
    q, t = make(spark, *sample(9, 10, 2)), make(spark, *sample(10, 400, 2))
    few_bytes = KnnLimits(broadcast_bytes=2000, block_rows=64)
    with pytest.raises(ValueError, match="larger than broadcast_bytes"):
        join(q, t, 2, "broadcast_train", limits=few_bytes)
    plan = join(q, t, 2, "auto", limits=few_bytes)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan  # the small query side is broadcast
    plan = join(t, t, 2, "auto", limits=few_bytes)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan


@pytest.mark.parametrize("plan", PLANS)
def test_lists_keep_every_query_and_its_columns(spark, plan):
    t = make(spark, *sample(11, 200, 3))
    q = make(spark, *sample(12, 30, 3)).union(spark.createDataFrame([(99, None, 2, 1)], t.schema))
    kw = {"qid": "id", "tid": "id", "label": "label", "plan": plan, "limits": SMALL}
    lists = nearest_lists(q, t, 3, carry=["stratum", "label"], **kw).collect()
    assert {(r["qid"], r["stratum"], r["label"]) for r in lists} == {(r["id"], r["stratum"], r["label"]) for r in q.collect()}
    got = {(r["qid"], i): (e["tid"], e["label"], e["dist"]) for r in lists for i, e in enumerate(r["neighbors"], 1)}
    assert got == brute([r for r in rows(q) if r[1]], rows(t), 3)
    assert [r["neighbors"] for r in lists if r["qid"] == 99] == [[]]


def test_a_broadcast_classification_has_no_shuffle(spark):
    q, t = make(spark, *sample(13, 30, 2)), make(spark, *sample(14, 50, 2))
    limits = KnnLimits(broadcast_bytes=8 * 4 * 50)
    big = q.union(q.withColumn("id", q["id"] + 1000)).union(q.withColumn("id", q["id"] + 2000)).union(q)
    lists = nearest_lists(big, t, 3, qid="id", tid="id", label="label", limits=limits)
    assert "Exchange" not in lists._jdf.queryExecution().toString()


# ---- trees of strata -------------------------------------------------------------------------------------------


def visits_a_query(t, limits):
    from nearspark.operators.knn import _CellSplit, _Job

    split = _CellSplit(_Job(t, t, 3, "id", "id", "features", "label", "stratum", True, [], "cells", limits), limits.block_rows)
    split.job.t.cache()
    return split, split.route(split.job.q).count() / split.job.query_rows


def test_each_large_stratum_has_a_tree_of_its_own(spark):
    """Strata far from each other: cuts made for all of them together would leave every stratum in a cell or two."""
    limits = KnnLimits(block_rows=60)
    x, ids, labels, _ = sample(31, 200 * 150, 2)
    strata = np.arange(200 * 150) % 200
    spread = make(spark, x + strata[:, None] * 1000.0, ids, labels, strata)
    many, met = visits_a_query(spread, limits)
    one, met_by_one = visits_a_query(make(spark, x[:150], ids[:150], labels[:150], np.zeros(150, int)), limits)
    assert len(many.roots) == 200 and len(one.roots) == 1
    assert met <= 2 * met_by_one
    some = spread.where("stratum < 4")
    assert result(join(some, some, 3, "cells", exclude_self=True, by="stratum", limits=limits)) == brute(
        rows(some), rows(some), 3, exclude_self=True, by=True
    )


def test_cells_are_cut_again_until_they_fit(spark):
    """A sample too small for all cells: the first cuts leave cells above a block, which samples of their own cut further."""
    limits = KnnLimits(block_rows=40, sample_bytes=8 * 4 * 300)
    x, ids, labels, _ = sample(32, 6000, 2)
    strata = np.where(np.arange(6000) < 5000, 1, 2)
    x[5000:5400] = [3.0, 3.0]  # copies can't be cut
    t = make(spark, x, ids, labels, strata)
    split, _ = visits_a_query(t, limits)
    placed = split.place_train(split.job.t).groupBy("cell").agg(F.countDistinct("x").alias("d")).collect()
    assert max(r["d"] for r in placed) <= 50  # of distinct rows; their number is an estimate
    assert len(split.forest.axis) > 2 * 2 * 300 / 8  # more nodes than one sample allows
    some = t.where("id % 10 = 0")
    assert result(join(some, t, 3, "cells", by="stratum", limits=limits)) == brute(rows(some), rows(t), 3, by=True)


def test_lists_of_small_strata_need_no_merge(spark):
    x, ids, labels, strata = sample(33, 300, 2, True)
    x[:120] = [1.0, 1.0]
    t = make(spark, x, ids, labels, strata)
    for limits in (KnnLimits(), KnnLimits(block_rows=250)):  # above a block of queries, but no stratum above it
        found = join(t, t, 3, "cells", exclude_self=True, by="stratum", limits=limits)
        assert "Window" not in found._jdf.queryExecution().analyzed().toString()
        assert result(found) == brute(rows(t), rows(t), 3, exclude_self=True, by=True)


def test_tables_in_a_task_are_large_where_rows_are_small(spark):
    """Queries of few dimensions are searched in large tables, whose size counts their lists as well."""
    from nearspark.operators.knn import _Job

    def at_once(dims, k):
        t = make(spark, *sample(34, 20, dims)[:3])
        return _Job(t, t, k, "id", "id", "features", "label", None, False, [], "broadcast_train", KnnLimits()).rows_at_once()

    assert at_once(4, 1) > 200_000
    assert at_once(64, 1) <= 50_000
    for dims, k in ((4, 1), (4, 500), (64, 500)):
        assert 8 * at_once(dims, k) * (dims + 2 + 3 * k) <= KnnLimits().block_bytes


# ---- pivots ----------------------------------------------------------------------------------------------------


def clustered(seed, n, dims=12, clusters=9):
    """Far-apart bunches; some rows are copies, some are mirrored around a centre, so that distances tie."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dims)) * 40
    x = middle[rng.integers(0, clusters, n)] + np.round(rng.normal(size=(n, dims)) * 2) / 2
    x[: n // 5] = x[0]
    x[n // 5 : n // 4] = 2 * middle[0] - x[n // 4 : n // 4 + n // 4 - n // 5]
    return x, rng.permutation(n), rng.integers(0, 4, n)


@pytest.mark.parametrize("limits", [SMALL, KnnLimits(block_rows=20, pivots=3), KnnLimits(block_rows=64, broadcast_bytes=600)])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_pivots_match_brute_force(spark, limits, exclude_self):
    t = make(spark, *clustered(21, 500))
    q = t if exclude_self else make(spark, *clustered(22, 120))
    got = result(join(q, t, 4, "pivots", exclude_self=exclude_self, limits=limits))
    assert got == brute(rows(q), rows(t), 4, exclude_self)


def test_pivots_with_odd_rows(spark):
    """Rows with a gap take no part; fewer candidates than k; one vector only; nothing at all."""
    x, ids, labels = clustered(23, 60)
    x[7, 3], x[9, 0] = np.nan, np.inf
    t = make(spark, x, ids, labels)
    whole = [r for r in rows(t) if np.isfinite(r[1]).all()]
    assert result(join(t, t, 70, "pivots", exclude_self=True, limits=SMALL)) == brute(whole, whole, 70, True)
    same = make(spark, np.ones((50, 12)), range(50), [0] * 50)
    assert result(join(same, same, 2, "pivots", limits=KnnLimits(block_rows=8))) == brute(rows(same), rows(same), 2)
    none = t.limit(0)
    assert join(t, none, 2, "pivots", limits=SMALL).count() == 0
    assert join(none, t, 2, "pivots", limits=SMALL).count() == 0


def test_pivots_leave_out_pairs_and_bound_repeats(spark):
    from nearspark.operators.grid import pivot_report
    from nearspark.operators.knn import _Job

    t = make(spark, *clustered(24, 4000, clusters=16))
    job = _Job(t, t, 3, "id", "id", "features", "label", None, True, [], "pivots", KnnLimits(block_rows=40))
    report = pivot_report(job)
    visits = sum(r["visits"] for r in report["rounds"])
    assert report["blocks"] > 60 and report["skipped"] > 0.8
    assert visits <= 4000 * 2 * report["blocks"] ** 0.5  # a query is sent to about a root of the blocks


def test_pivots_send_a_query_once_to_a_place(spark, monkeypatch):
    """What moves grows with the places, not with the blocks, and blocks above a place are split."""
    from nearspark.operators import grid
    from nearspark.operators.knn import _Job

    rng = np.random.default_rng(26)
    x = rng.normal(size=(600, 24))  # no structure: nearly every block is visited
    x[:150] = np.sign(x[:150])  # one ring
    t = make(spark, x, range(600), [0] * 600)
    job = _Job(t, t, 3, "id", "id", "features", "label", None, True, [], "pivots", KnnLimits(block_rows=8))
    assert len((plan := grid.PivotGrid(job)).sizes) > 60
    assert all(visits.count() <= 600 for visits, _ in plan.rounds())
    want = brute(rows(t), rows(t), 3, True)
    monkeypatch.setattr(grid, "GROUP_BYTES", 8 * 26 * 40)
    assert result(join(t, t, 3, "pivots", exclude_self=True, limits=KnnLimits(block_rows=8))) == want
    assert result(join(t, t, 3, "pivots", exclude_self=True, limits=KnnLimits(block_rows=100, pivots=1))) == want


def test_pivots_deal_a_group_to_a_partition_and_place_queries_once(spark, monkeypatch):
    from nearspark.operators import grid
    from nearspark.operators.knn import _Job

    monkeypatch.setattr(grid, "GROUP_BYTES", 8 * 18 * 40)
    t = make(spark, *sample(27, 600, 16)[:3])
    plan = grid.PivotGrid(_Job(t, t, 3, "id", "id", "features", "label", None, True, [], "pivots", KnnLimits(block_rows=8)))
    groups = len(plan.span) * plan.q_parts
    assert groups > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for visits, found in plan.rounds():
        assert visits._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [places_of(") == 1
        assert found.rdd.getNumPartitions() >= groups


@pytest.mark.parametrize("kind", ["unit", "far", "ties", "copies", "huge", "tiny", "mixed"])
def test_pairs_screened_in_single_precision_lose_no_neighbour(monkeypatch, kind):
    from nearspark.operators import kernel

    rng = np.random.default_rng(46)
    x = rng.normal(size=(700, 12))
    x = {
        "unit": x / np.linalg.norm(x, axis=1)[:, None],
        "far": 1e6 + x * 1e-3,  # single precision tells nothing apart without the middle taken off
        "ties": np.round(x),
        "copies": np.repeat(x[:7], 100, axis=0),
        "huge": x * 1e60,
        "tiny": x * 1e-60,
        "mixed": x * 10.0 ** rng.integers(-12, 12, size=(700, 1)),
    }[kind]
    products, usual = [], kernel.Screen.near
    monkeypatch.setattr(kernel.Screen, "near", lambda s, *a: products.append(s.t.dtype) or usual(s, *a))
    q, qids, ids, codes = x[:150], np.arange(150), np.arange(700), np.arange(700) % 5
    starts = np.append(np.arange(0, 700, 60), 700)
    bits = np.packbits(np.ones((150, len(starts) - 1), bool), axis=1)
    shelf = kernel.Shelf(x, ids, codes, starts, x, x, kernel.squared_sum(x))
    for k, skip_self in ((1, False), (4, True), (90, False)):
        best = kernel.find_in_blocks(q, qids, shelf, bits, k, skip_self, np.full(150, np.inf))
        again = kernel.find_in_blocks(q, qids, shelf, bits, k, skip_self, best.dist[:, -1].copy())
        for i in range(150):
            d = kernel.squared_sum(x - q[i])
            order = [a for a in np.lexsort((ids, d)) if not (skip_self and a == i)][:k]
            for got in (best, again):
                assert got.ids[i].tolist() == order and got.dist[i].tolist() == d[order].tolist()
                assert got.codes[i].tolist() == codes[order].tolist()
    assert set(products) == {np.dtype(np.float32)}


def test_auto_takes_pivots_for_wide_vectors(spark):
    from nearspark.operators.knn import _Job

    tight = KnnLimits(broadcast_bytes=1000)
    for dims, want in ((12, "pivots"), (4, "cells")):
        t = make(spark, *sample(25, 300, dims)[:3])
        assert _Job(t, t, 3, "id", "id", "features", "label", None, False, [], "auto", tight).plan == want
    with pytest.raises(ValueError, match="strata"):
        knn_join(t, t, 1, qid="id", tid="id", by="stratum", plan="pivots")


def test_leading_blocks_are_those_of_a_stable_sort():
    from nearspark.operators.grid import leading

    rng = np.random.default_rng(47)
    bound, own = rng.integers(0, 3, (60, 50)).astype(float), rng.integers(0, 4, (60, 50)).astype(float)
    bound[:, ::7] = np.inf
    order = np.lexsort((own, bound), axis=-1)
    for count in (0, 1, 8, 49, 50):
        want = np.zeros(bound.shape, bool)
        np.put_along_axis(want, order[:, :count], True, axis=1)
        assert (leading(bound, own, count) == want).all()


def test_lower_bounds_never_exceed_distances():
    from nearspark.operators.grid import distances, far_apart, lower_bounds
    from nearspark.operators.kernel import squared_sum

    rng = np.random.default_rng(5)
    for scale in (1e-8, 1.0, 1e8):
        x = rng.normal(size=(300, 20)) * scale + scale * 1e3
        pivots = far_apart(x, 6)
        d = distances(x, pivots)
        bound = lower_bounds(d, d, d, 20)  # every row a block of its own
        true = np.stack([squared_sum(x - y) for y in x], axis=1)
        assert (bound <= true).all()
        assert len(np.unique(pivots, axis=0)) == 6


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("grid", [False, True])
def test_strips_find_what_all_pairs_hold(skip_self, grid):
    from nearspark.operators.kernel import build_shelf, find_nearest

    rng = np.random.default_rng(5)
    for n, dims, k in [(1, 2, 1), (20, 1, 3), (700, 3, 4), (5_000, 4, 9), (900, 2, 40)]:
        t = rng.normal(size=(n, dims)) * [1000.0, 1.0, 0.1, 0.1][:dims]
        t = np.round(t) if grid else t
        t[: n // 5] = t[0]  # copies: more of them than a strip holds
        q = np.concatenate([t[:150], rng.normal(size=(50, dims)) * 500])
        ids, qids = rng.permutation(n), np.concatenate([np.arange(min(n, 150)), 10_000 + np.arange(50)])
        got = find_nearest(q, qids, build_shelf(t, ids, ids % 3), k, skip_self)
        for i in range(len(q)):
            d = np.zeros(n)
            for j in range(dims):
                d += (q[i, j] - t[:, j]) * (q[i, j] - t[:, j])
            order = [a for a in np.lexsort((ids, d)) if not (skip_self and ids[a] == qids[i])][:k]
            assert got.ids[i, : len(order)].tolist() == ids[order].tolist()
            assert got.dist[i, : len(order)].tolist() == d[order].tolist()
            assert got.codes[i, : len(order)].tolist() == (ids[order] % 3).tolist()
        bound = got.dist[:, -1].copy()
        again = find_nearest(q, qids, build_shelf(t, ids, ids % 3), k, skip_self, within=bound)
        assert (again.ids == got.ids).all() and (again.dist == got.dist).all()


def test_rows_apart_on_one_axis_need_no_leaves(monkeypatch):
    from nearspark.operators import kernel

    rng = np.random.default_rng(6)
    x = np.stack([rng.uniform(0, 1e5, 4_000), rng.uniform(0, 1, 4_000)], axis=1)
    scanned = []
    monkeypatch.setattr(kernel, "_scan_tile", lambda *a: scanned.append(len(a[3]) * len(a[4])))
    kernel.find_nearest(x, np.arange(4_000), kernel.build_shelf(x, np.arange(4_000)), 3, True)
    assert sum(scanned) == 0  # by leaves: over a hundred pairs a query


def test_cells_within_a_block_are_not_counted_by_distinct_rows(spark, monkeypatch):
    from nearspark.operators import knn

    monkeypatch.setattr(knn.F, "approx_count_distinct", lambda *a: pytest.fail("no cell is above a block"))
    q, t = make(spark, *sample(23, 50, 2)), make(spark, *sample(24, 600, 2))
    got = result(join(q, t, 4, "cells", limits=KnnLimits(block_rows=400)))
    assert got == brute(rows(q), rows(t), 4)


def test_line_items_are_split_once(spark):
    import __spark_entry__  # noqa: F401
    from nearspark.catalog import neighbours

    rows_ = spark.range(100).select("id")
    train, test = neighbours.stored_split(rows_)
    assert (train.count(), test.count(), train.union(test).distinct().count()) == (80, 20, 100)
    for part in (train, test):  # a plain scan: no draw is made again
        assert "md5" not in part._jdf.queryExecution().toString()


def test_line_items_have_partners_in_the_whole_table(spark, tmp_path):
    """Above some 2,000 line items the partners used to be those of a random stratum."""
    import duckdb

    import __spark_entry__ as entry

    n, rng = 2_500, np.random.default_rng(46)
    x = np.stack([rng.integers(1, 6, n), rng.integers(900, 1_500, n), rng.integers(0, 3, n) / 100, rng.integers(0, 3, n) / 100], axis=1)
    x[-60:] = x[:60]  # copies far apart in the order of the key
    flags = rng.choice(["A", "N", "R"], n).tolist()
    items = [(i, i % 7, i % 5, 1, *map(float, v), f) for i, (v, f) in enumerate(zip(x, flags))]
    df = spark.createDataFrame(
        items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
    ).withColumn("l_shipdate", F.lit("1996-09-13").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = result(entry.queries()["knn_self_join_lineitem"](spark, str(tmp_path)))

    want = {}
    for i in range(n):
        dist = np.zeros(n)
        for j in range(4):
            dist += (x[:, j] - x[i, j]) * (x[:, j] - x[i, j])
        dist[i] = np.inf
        for rank, t in enumerate(np.lexsort((np.arange(n), dist))[:3], 1):
            want[i, rank] = (t, "ANR".index(flags[t]), dist[t])
    assert got == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    sql = con.sql(f"SELECT qid, rank, tid, label, dist FROM ({entry.oracle_sql()['knn_self_join_lineitem']})")
    assert {(q, rank): found for q, rank, *found in map(list, sql.fetchall())} == {key: list(found) for key, found in want.items()}


# ---- lists of cells --------------------------------------------------------------------------------------------


def lists_of(q, t, k, limits):
    found = nearest_lists(q, t, k, qid="id", tid="id", label="label", carry=["stratum"], plan="cells", limits=limits)
    return found, {r["qid"]: (r["stratum"], [(e["tid"], e["label"], e["dist"]) for e in r["neighbors"]]) for r in found.collect()}


def test_lists_of_cells_are_merged_whole(spark):
    """A query's lists are merged as lists: no window over a row for every neighbour, no join for the carried columns."""
    q = make(spark, *sample(41, 120, 2))
    odd = [(900, [float("nan"), 1.0], 1, 7), (901, None, 2, 8), (902, [float("inf"), 0.0], 3, 9)]
    q = q.union(spark.createDataFrame(odd, q.schema))
    t = make(spark, *sample(42, 900, 2))
    found, got = lists_of(q, t, 5, KnnLimits(block_rows=64))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and "Join LeftOuter, (qid" not in plan
    usual = [r for r in rows(q) if r[0] < 900]
    want = brute(usual, rows(t), 5)
    assert {(i, n): e for i, (_, entries) in got.items() for n, e in enumerate(entries, 1)} == want
    assert {i: s for i, (s, _) in got.items()} == {r[0]: r[3] for r in usual} | {900: 7, 901: 8, 902: 9}
    assert [got[i][1] for i in (900, 901, 902)] == [[], [], []]


def test_copies_are_moved_only_out_of_full_cells(spark, monkeypatch):
    from nearspark.operators.knn import _Job

    x, ids, labels, _ = sample(43, 600, 2)
    x[300:] = x[:300]  # copies, but no cell is above a block
    q, t, limits = make(spark, *sample(44, 40, 2)), make(spark, x, ids, labels), KnnLimits(block_rows=200)
    with monkeypatch.context() as patch:
        patch.setattr(_Job, "without_copies", lambda *a: pytest.fail("no cell is above a block"))
        assert result(join(q, t, 4, "cells", limits=limits)) == brute(rows(q), rows(t), 4)
    x[:350] = [1.0, 1.0]
    t, moved, usual = make(spark, x, ids, labels), [], _Job.without_copies
    monkeypatch.setattr(_Job, "without_copies", lambda job, t: moved.append(t.count()) or usual(job, t))
    assert result(join(q, t, 4, "cells", limits=limits)) == brute(rows(q), rows(t), 4)
    assert len(moved) == 1 and 350 <= moved[0] < 600


def test_copies_with_negative_zeros_keep_their_lowest_ids():
    from nearspark.operators.cells import lowest_copies

    x = np.array([[0.0, 0.0]] * 5 + [[-0.0, 0.0]] * 5 + [[0.0, -0.0]] * 5)
    ids = np.random.default_rng(45).permutation(15)
    assert sorted(ids[lowest_copies(x, ids, 3)]) == [0, 1, 2]
