"""Reduction against plain Python loops, and the invariants of fusion."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspark.operators import reduction as R
from nearspark.operators.knn import KnnLimits

SMALL = KnnLimits(block_rows=64)


def prototypes(spark, seed, n, strata=3, copies=0, classes=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 2)), 2)
    x[:copies] = [0.5, 0.5]
    rows = [
        (int(i), [float(v) for v in f], int(c), 1.0, int(s))
        for i, f, c, s in zip(rng.permutation(n), x, rng.integers(0, classes, n), rng.integers(0, strata, n))
    ]
    return spark.createDataFrame(rows, "pid bigint, features array<double>, label int, weight double, stratum int")


def edited(rows, by, guarded):
    keep = set()
    for pid, f, label, _, s in rows:
        inside = [r for r in rows if not by or r[4] == s]
        near = sorted((sum((a - b) ** 2 for a, b in zip(f, r[1])), r[0], r[2]) for r in inside if r[0] != pid)[:3]
        same = sum(c == label for _, _, c in near)
        few = sum(r[2] == label for r in inside) < 3
        if same >= 2 or (guarded and few):
            keep.add(pid)
    return keep


@pytest.mark.parametrize("plan", ["broadcast_train", "cells"])
@pytest.mark.parametrize("by", [None, "stratum"])
@pytest.mark.parametrize("guarded", [True, False])
def test_editing_matches_a_plain_loop(spark, plan, by, guarded):
    df = prototypes(spark, 1, 300, copies=100).union(
        spark.createDataFrame([(1000, [9.0, 9.0], 7, 1.0, 9), (1001, [0.0, 0.0], 8, 1.0, 0)], "a bigint, b array<double>, c int, d double, e int")
    )  # a lone row in its stratum, and a class with a single member
    got = {r["pid"] for r in R.edit_nearest(df, by, guarded, plan=plan, limits=SMALL).collect()}
    assert got == edited([tuple(r) for r in df.collect()], by, guarded)


def test_one_stratum_equals_the_union(spark):
    df = prototypes(spark, 2, 150, strata=1)
    a, b = R.edit_nearest(df, "stratum"), R.edit_nearest(df)
    assert sorted(a.select("pid").collect()) == sorted(b.select("pid").collect())


def test_class_with_two_members_is_kept(spark):
    rows = [(i, [float(i), 0.0], 0, 1.0) for i in range(6)] + [(10, [0.1, 0.0], 1, 1.0), (11, [5.1, 0.0], 1, 1.0)]
    df = spark.createDataFrame(rows, "pid bigint, features array<double>, label int, weight double")
    assert {10, 11} <= {r["pid"] for r in R.edit_nearest(df).collect()}
    assert not {10, 11} & {r["pid"] for r in R.edit_nearest(df, guarded=False).collect()}


def centroids(df, by):
    weighted = df.select(*by, "weight", *[(F.col("features")[i] * F.col("weight")).alias(f"s{i}") for i in range(2)])
    out = weighted.groupBy(*by).agg(F.sum("weight"), F.sum("s0"), F.sum("s1"))
    return {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in out.collect()}


@pytest.mark.parametrize("by", [None, "stratum"])
def test_fusion_invariants(spark, by):
    df = prototypes(spark, 3, 240, copies=80)
    keys = ["stratum", "label"] if by else ["label"]
    one, many = R.fuse(df, by, max_rounds=1), R.fuse(df, by, max_rounds=6)
    assert df.count() > one.count() > many.count()
    before = centroids(df, keys)
    for fused in (one, many):
        after = centroids(fused, keys)
        assert before.keys() == after.keys()
        for k, sums in before.items():
            assert after[k] == pytest.approx(sums, abs=1e-9)
    assert {r["pid"] for r in many.collect()} <= {r["pid"] for r in df.collect()}


def test_fusion_merges_mutual_pairs_of_a_class_only(spark):
    rows = [(1, [0.0], 0, 1.0), (2, [1.0], 0, 3.0), (3, [10.0], 0, 1.0), (4, [10.5], 1, 1.0), (5, [20.0], 1, 1.0), (6, [20.0], 1, 1.0)]
    df = spark.createDataFrame(rows, "pid bigint, features array<double>, label int, weight double")
    got = sorted(map(tuple, R.fusion_round(df).select("pid", "features", "label", "weight").collect()))
    assert got == [(1, [0.75], 0, 4.0), (3, [10.0], 0, 1.0), (4, [10.5], 1, 1.0), (5, [20.0], 1, 2.0)]


def test_small_strata_are_not_fused(spark):
    df = prototypes(spark, 4, 200).withColumn("stratum", F.when(F.col("pid") < 15, 0).otherwise(1))
    fused = R.reduce_training(df, "fusion", by="stratum", max_rounds=2)
    assert fused.where("stratum = 0").count() == 15
    assert 0 < fused.where("stratum = 1").count() < 185
    few = df.where("pid < 15")
    assert R.fuse(few, min_rows=R.FUSION_MIN_ROWS).count() == 15


def test_methods_and_union(spark):
    df = prototypes(spark, 5, 40)
    assert R.reduce_training(df, "join").count() == 40
    assert R.union_reduced(df, df).count() == 80
    with pytest.raises(ValueError, match="unknown method"):
        R.reduce_training(df, "shrink")


def test_strata_and_keys(spark):
    df = R.stratify(spark.range(4000), "id", 8, seed=1)
    sizes = [r["count"] for r in df.groupBy("stratum").count().collect()]
    assert len(sizes) == 8 and min(sizes) > 400
    assert sorted(df.collect()) == sorted(R.stratify(spark.range(4000).repartition(7), "id", 8, seed=1).collect())
    row = spark.range(1).select(R.stratum_key(F.lit(12), F.lit(345)).alias("k"))
    assert tuple(row.select("k", *R.split_stratum_key(F.col("k"))).first()) == (1200345, 12, 345)
    members = R.class_members(prototypes(spark, 6, 50), by="stratum")
    assert members.agg(F.sum("n")).first()[0] == 50


@pytest.mark.parametrize("by,plan", [(None, "auto"), ("stratum", "auto"), (None, "cells")])
def test_fusion_keeps_nearest_and_gives_the_same(spark, by, plan):
    """Searching again only what a merge has touched gives what searching everything in every round gives."""
    df = prototypes(spark, 7, 260, copies=60)
    limits = R.KnnLimits(block_rows=64) if plan == "cells" else R.KnnLimits()
    whole = df.select(R._columns(by))
    rounds = 0
    while True:
        after = R.cut_lineage(R.fusion_round(whole, by).select(R._columns(by)))
        rounds += 1
        done, whole = after.count() == whole.count(), after
        if done:
            break
    progress = []
    got = R.fuse(df, by, plan=plan, limits=limits, progress=progress)
    assert sorted(map(str, got.select(R._columns(by)).collect())) == sorted(map(str, whole.collect()))
    for step in progress:  # the work follows the merges: each moves one prototype and takes the nearest from a few
        assert step["pairs"] <= step["rows"] * 8 * max(1, step["moved"])
        assert step["pairs"] < step["rows"] ** 2 / 2
    assert len(progress) >= 2 and progress[-1]["pairs"] < progress[0]["pairs"]


def test_fusion_of_a_chain_searches_little_again(spark):
    """Gaps that double: one pair merges in a round, so all but a few prototypes keep their nearest."""
    rows = [(i, [float(2**i)], 0, 1.0) for i in range(14)]
    df = spark.createDataFrame(rows, "pid bigint, features array<double>, label int, weight double")
    progress = []
    assert R.fuse(df, progress=progress).count() == 1
    assert len(progress) >= 6
    assert all(step["moved"] <= 2 and step["searched"] <= 4 for step in progress)


def looked_up(rows, kept, by):
    """For each row, its four nearest others among ``kept`` as (id, same class)."""
    lists = {}
    for pid, f, label, _, s in rows:
        inside = [r for r in rows if r[0] in kept and r[0] != pid and (not by or r[4] == s)]
        near = sorted((sum((a - b) ** 2 for a, b in zip(f, r[1])), r[0], r[2]) for r in inside)[:4]
        lists[pid] = [(i, c == label) for _, i, c in near]
    return lists


def is_right(near):
    return sum(same for _, same in near[:3]) >= 2


def needed_only(rows, by, max_rounds=None):
    """Rounds of taking out, row by row; also how many rows were right before each round."""
    classes = {}
    for pid, _, label, _, s in rows:
        classes.setdefault((s if by else None, label), []).append(pid)
    guarded = {i for ids in classes.values() for i in sorted(ids)[:3]}
    kept, right, rounds = {r[0] for r in rows}, [], 0
    while max_rounds is None or rounds < max_rounds:
        lists, rounds = looked_up(rows, kept, by), rounds + 1
        right.append(sum(map(is_right, lists.values())))
        able = {}
        for p in kept - guarded:
            associates = [near for near in lists.values() if p in [i for i, _ in near[:3]]]
            before = sum(map(is_right, associates))
            after = sum(is_right([e for e in near if e[0] != p]) for near in associates)
            if after >= before:
                digest = hashlib.md5(f"{R.RT2_SEED}:{p}".encode()).hexdigest()
                able[p] = (-sum(same for _, same in lists[p]), int(digest[:15], 16), p)
        beaten = set()
        for near in lists.values():
            held = sorted(able[i] for i, _ in near if i in able)
            beaten |= {place[2] for place in held[1:]}
        if not able.keys() - beaten:
            break
        kept -= able.keys() - beaten
    return kept, right


def test_taking_out_matches_a_plain_loop(spark):
    df = prototypes(spark, 5, 60, copies=15)
    rows, progress = [tuple(r) for r in df.collect()], []
    got = {r["pid"] for r in R.edit_associates(df, "stratum", progress=progress).collect()}
    kept, right = needed_only(rows, "stratum")
    assert got == kept
    assert right == sorted(right)  # the number of right rows never falls
    assert progress[-1]["taken"] == 0 and len(progress) == len(right)
    assert progress[-1]["searched"] < len(rows)


@pytest.mark.parametrize("by", [None, "stratum"])
def test_taking_out_in_cells_matches_a_plain_loop(spark, by):
    df = prototypes(spark, 9, 300, copies=100)
    got = R.edit_associates(df, by, max_rounds=2, plan="cells", limits=SMALL)
    assert {r["pid"] for r in got.collect()} == needed_only([tuple(r) for r in df.collect()], by, 2)[0]


def test_taking_out_empties_the_inside_of_classes(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, size=(240, 2))
    rows = [(i, [float(a), float(b)], int(a > 5), 1.0) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "pid bigint, features array<double>, label int, weight double")
    kept = R.edit_associates(df, max_rounds=2)
    assert kept.columns == df.columns and kept.count() < 220
    assert {r["pid"] for r in kept.collect()} == needed_only([(*r, 0) for r in rows], None, 2)[0]


def test_taking_out_of_small_and_empty_tables(spark):
    df = prototypes(spark, 7, 60, strata=1)
    assert R.edit_associates(df.limit(0)).count() == 0
    few = df.where("label = 0").orderBy("pid").limit(3)
    assert sorted(few.collect()) == sorted(R.edit_associates(few).collect())


def test_fusion_and_taking_out(spark):
    df = prototypes(spark, 8, 30)
    fused = R.fuse(df.drop("stratum"))
    got = R.reduce_training(df.drop("stratum"), "fusion_rt2")
    rows = [(*tuple(r), 0) for r in fused.select("pid", "features", "label", "weight").collect()]
    assert {r["pid"] for r in got.collect()} == needed_only(rows, None)[0]
