"""Training-set reduction: edited nearest neighbours and prototype fusion, per stratum or over the whole table.

Prototypes are rows ``(pid, features, label, weight)`` plus an optional stratum column; ``label`` is an integer code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.functions.vectors import draw
from nearspark.operators.knn import KnnLimits, nearest_lists
from nearspark.session import cut_lineage

STRATUM_BASE = 100_000  # fixed value: a stratum key is partition * 100000 + number
ENN_NEIGHBORS = 3  # fixed value
ENN_MIN_SAME = 2  # fixed value: half of the neighbours, rounded down, plus one
FUSION_MIN_ROWS = 15  # fixed value: only strata with more prototypes are fused
RT2_SEED = 42
METHODS = ("join", "enn", "fusion", "fusion_rt2")


def stratify(df: DataFrame, id_col: str, strata: int, seed: int, name: str = "stratum") -> DataFrame:
    """Assign each row to one of ``strata`` parts by a hash of its id, the same on every run."""
    return df.withColumn(name, F.pmod(draw(seed, id_col), F.lit(strata)).cast("int"))


def stratum_key(partition: Column, number: Column) -> Column:
    return partition.cast("bigint") * STRATUM_BASE + number


def split_stratum_key(key: Column) -> tuple[Column, Column]:
    """Partition and number of a stratum key; valid for numbers below 100000."""
    return F.floor(key / STRATUM_BASE).cast("bigint"), F.pmod(key, F.lit(STRATUM_BASE))


def class_members(df: DataFrame, label: str = "label", by: str | None = None) -> DataFrame:
    """Number of prototypes of each class that is present, per stratum when ``by`` is given."""
    keys = [by, label] if by else [label]
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def edit_nearest(
    df: DataFrame,
    by: str | None = None,
    guarded: bool = True,
    label: str = "label",
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
) -> DataFrame:
    """Edited nearest neighbours: keep a prototype if at least 2 of its 3 nearest others share its class.

    All decisions are taken against the unedited table. With ``guarded``, classes with fewer than 3 members (in the
    stratum, with ``by``) are never removed. Keeps the columns of ``df``.
    """
    others = [c for c in df.columns if c != "pid"]
    rows = nearest_lists(
        df, df, ENN_NEIGHBORS, qid="pid", tid="pid", label=label, by=by, exclude_self=True, carry=others, plan=plan,
        limits=limits,
    ).withColumnRenamed("qid", "pid")
    keep = F.size(F.filter("neighbors", lambda e: e["label"] == F.col(label))) >= ENN_MIN_SAME
    if guarded:
        # a protected class has one or two members, so their ids are its smallest and largest id
        keys = [by, label] if by else [label]
        few = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pid").alias("a"), F.max("pid").alias("b"))
        few = few.where(F.col("n") < ENN_NEIGHBORS).select(F.explode(F.array("a", "b")).alias("pid")).distinct()
        few = cut_lineage(few)  # mostly a few rows: written, Spark sees whether they fit a broadcast
        rows = rows.join(few.withColumn("__few", F.lit(True)), "pid", "left")
        keep = keep | F.col("__few").isNotNull()
    return rows.where(keep).select(df.columns)


def fusion_round(
    df: DataFrame, by: str | None = None, plan: str = "auto", limits: KnnLimits = KnnLimits()
) -> DataFrame:
    """One round of fusion: equal prototypes of a class become one, then mutual nearest pairs of a class are merged.

    A merged prototype has the weighted mean of the vectors, the sum of the weights and the smaller id.
    """
    single = cut_lineage(_collapsed(df, by))  # read several times below
    return _merged(_nearest(single, single, by, plan, limits), by)


def _columns(by: str | None) -> list[str]:
    return ["pid", *([by] if by else []), "features", "label", "weight"]


def _collapsed(df: DataFrame, by: str | None) -> DataFrame:
    """Equal prototypes of a class as one, with the lowest id and the sum of the weights."""
    keys = [by] if by else []
    single = df.groupBy(*keys, "label", "features").agg(F.min("pid").alias("pid"), F.sum("weight").alias("weight"))
    return single.select(_columns(by))


def _nearest(df: DataFrame, others: DataFrame, by: str | None, plan: str, limits: KnnLimits, carry: tuple = ()) -> DataFrame:
    """Add the nearest of ``others`` but itself, as ``near`` and ``near_dist`` (NULL if there is none)."""
    found = nearest_lists(
        df, others, 1, qid="pid", tid="pid", by=by, exclude_self=True, carry=[*_columns(by)[1:], *carry], plan=plan, limits=limits
    ).withColumnRenamed("qid", "pid")
    first = F.try_element_at("neighbors", F.lit(1))
    return found.select(*_columns(by), *carry, first["tid"].alias("near"), first["dist"].alias("near_dist"))


def _merged(nearest: DataFrame, by: str | None) -> DataFrame:
    """Prototypes with their nearest, ``near`` -> those left when mutual pairs of a class are merged."""
    keys = [by] if by else []
    other = F.coalesce("near", "pid")
    pairs = nearest.withColumn("lo", F.least("pid", other)).withColumn("hi", F.greatest("pid", other))
    # both ends of a mutual pair have the same (lo, hi), so a group holds one or two prototypes
    merged = pairs.groupBy(*keys, "label", "lo", "hi").agg(
        F.array_sort(F.collect_list(F.struct("pid", "weight", "features"))).alias("m")
    )
    a, b = F.col("m")[0], F.try_element_at("m", F.lit(2))
    weight = a["weight"] + F.coalesce(b["weight"], F.lit(0.0))
    mean = F.zip_with(
        a["features"], b["features"], lambda x, y: (x * a["weight"] + y * b["weight"]) / (a["weight"] + b["weight"])
    )
    return merged.select(
        a["pid"].alias("pid"),
        *keys,
        F.when(F.size("m") == 2, mean).otherwise(a["features"]).alias("features"),
        "label",
        weight.alias("weight"),
    )


def _nearest_again(
    old: DataFrame, df: DataFrame, by: str | None, plan: str, limits: KnnLimits, progress: list | None
) -> DataFrame:
    """The nearest of every prototype of ``df``, from the nearest that were known for ``old``, the table before its merges.

    A prototype that is new or was moved, or whose nearest is gone or was moved, searches the whole table. Any other
    still has its nearest, unless a new or moved prototype is nearer: it searches only among those.
    """
    before = old.select("pid", F.col("features").alias("was"), "near", "near_dist")
    now = df.join(before, "pid", "left").withColumn("moved", ~F.col("was").eqNullSafe(F.col("features"))).drop("was")
    now = cut_lineage(now)
    stays = now.where("NOT moved").select(F.col("pid").alias("near"), F.lit(True).alias("stays"))
    again = F.col("moved") | (F.col("near").isNotNull() & F.col("stays").isNull())
    now = cut_lineage(now.join(stays, "near", "left").withColumn("again", again))

    moved = now.where("moved").select(_columns(by))
    searched = _nearest(now.where("again").select(_columns(by)), now.select(_columns(by)), by, plan, limits)
    rest = now.where("NOT again")
    known = rest.select(*_columns(by), F.struct(F.col("near_dist").alias("d"), F.col("near").alias("n")).alias("known"))
    met = _nearest(known, moved, by, plan, limits, ("known",))
    nearer = F.struct(F.col("near_dist").alias("d"), F.col("near").alias("n"))
    best = F.array_min(F.filter(F.array("known", nearer), lambda e: e["n"].isNotNull()))
    met = met.select(*_columns(by), best["n"].alias("near"), best["d"].alias("near_dist"))
    if progress is not None:
        count = lambda c: F.count(F.when(c, 1))
        rows, full, new = now.agg(F.count("*"), count(F.col("again")), count(F.col("moved"))).first()
        progress.append({"rows": rows, "searched": full, "moved": new, "pairs": full * rows + (rows - full) * new})
    return cut_lineage(searched.unionByName(met))


def fuse(
    df: DataFrame,
    by: str | None = None,
    max_rounds: int | None = None,
    min_rows: int | None = None,
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
    progress: list | None = None,
) -> DataFrame:
    """Fuse prototypes until nothing merges, or for ``max_rounds`` rounds if given; strata of ``min_rows`` or fewer stay.

    Rounds are those of ``fusion_round``, but each prototype keeps its nearest: after the first round only those search the
    whole table that were merged, or whose nearest was; the others look among the merged ones. It ends by itself: a round
    that merges nothing leaves as many rows, all others fewer. ``progress`` gets the sizes of every search after the first.

    Every round is written to the shared folder, which keeps the plan short and survives the loss of executors.
    """
    columns = _columns(by)
    df = df.select(columns)
    untouched = None
    if min_rows is not None:
        if by:
            sizes = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") <= min_rows)
            small = cut_lineage(sizes.select(by))
            untouched, df = df.join(small, by, "left_semi").select(columns), df.join(small, by, "left_anti").select(columns)
        elif df.count() <= min_rows:
            return df
    rows, rounds, known = None, 0, None
    while max_rounds is None or rounds < max_rounds:
        single = cut_lineage(_collapsed(df, by))
        if known is None:
            known = cut_lineage(_nearest(single, single, by, plan, limits))
        else:
            known = _nearest_again(known, single, by, plan, limits, progress)
        df = cut_lineage(_merged(known, by).select(columns))
        left, rounds = df.count(), rounds + 1
        if left == rows:
            break
        rows = left
    return df if untouched is None else union_reduced(untouched, df)


def edit_associates(
    df: DataFrame,
    by: str | None = None,
    max_rounds: int | None = None,
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
    progress: list | None = None,
) -> DataFrame:
    """Take out the prototypes that no other needs, in rounds, until a round takes out none.

    All prototypes of ``df``, those already taken out too, are looked up among the ones left: a prototype is right if at
    least 2 of its 3 nearest others share its class. The associates of p are those that have p among these 3. p can go if
    no fewer of them are right without it, when their fourth neighbour moves up. The three lowest ids of a class (in the
    stratum, with ``by``) always stay.

    A round takes out an independent set, in a written order: most neighbours of its own class among its four first, then by
    the hash draw of the id, then by id. Of those that can go, p goes if it comes first in every list of four that holds it.
    So no list loses two members in a round, every decision of the round holds for all of them together, and the number of
    prototypes of ``df`` that are right never falls. A round that takes out none has no prototype that can go.

    Only lists that lost a member are searched again. Reverse lists are sums over (prototype, neighbour) rows, four a
    prototype; no reverse list is gathered, so one that is near to everything costs a partial sum a task. ``progress`` gets
    how many of a round were left, searched and taken out. Keeps the columns of ``df``.
    """
    keys = [by] if by else []
    lowest = Window.partitionBy(*keys, "label").orderBy("pid")
    guarded = df.select("pid", *keys, "label").withColumn("place", F.row_number().over(lowest))
    guarded = cut_lineage(guarded.where(F.col("place") <= ENN_NEIGHBORS).select("pid", F.lit(True).alias("guarded")))
    everyone = df.select("pid", "features", "label", *keys)

    def look_up(queries: DataFrame, kept: DataFrame) -> DataFrame:
        found = nearest_lists(
            queries, kept, ENN_NEIGHBORS + 1, qid="pid", tid="pid", label="label", by=by, exclude_self=True, carry=["label"],
            plan=plan, limits=limits,
        )
        near = F.transform("neighbors", lambda e: F.struct(e["tid"].alias("tid"), (e["label"] == F.col("label")).alias("same")))
        return found.select(F.col("qid").alias("pid"), "label", near.alias("near"))

    kept, lists, rounds, searched = df, cut_lineage(look_up(everyone, everyone)), 0, None
    while max_rounds is None or rounds < max_rounds:
        gone, hit = _independent(lists, kept, guarded)
        taken, rounds = gone.count(), rounds + 1
        if progress is not None:
            progress.append({"kept": kept.count(), "searched": searched, "taken": taken})
        if taken == 0:
            break
        kept = cut_lineage(kept.join(gone, "pid", "left_anti").select(df.columns))
        if rounds == max_rounds:
            break
        again = cut_lineage(everyone.join(hit, "pid", "left_semi"))
        searched = again.count() if progress is not None else None
        found = look_up(again, kept.select("pid", "features", "label", *keys))
        lists = cut_lineage(lists.join(hit, "pid", "left_anti").unionByName(found))
    return kept


def _independent(lists: DataFrame, kept: DataFrame, guarded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round on ``(pid, label, near)``: the prototypes that go, ``(pid)``, and those whose lists hold one, ``(pid)``."""
    count = lambda a: F.size(F.filter(a, lambda e: e["same"]))
    counted = lists.select(
        "pid", "near", count(F.slice("near", 1, ENN_NEIGHBORS)).alias("now"), count(F.col("near")).alias("same")
    )
    seen = counted.select("pid", "now", "same", F.posexplode("near").alias("at", "e"))
    right = (F.col("now") >= ENN_MIN_SAME).cast("int")
    without = (F.col("same") - F.col("e")["same"].cast("int") >= ENN_MIN_SAME).cast("int")
    losses = seen.where(F.col("at") < ENN_NEIGHBORS).groupBy(F.col("e")["tid"].alias("pid"))
    losses = losses.agg(F.sum(right - without).alias("loss"))
    order = F.struct((-F.col("same")).alias("s"), draw(RT2_SEED, "pid").alias("d"), F.col("pid").alias("p"))
    able = counted.select("pid", "same").join(kept.select("pid"), "pid", "left_semi")
    able = able.join(guarded, "pid", "left_anti").join(losses, "pid", "left").where("coalesce(loss, 0) <= 0")
    able = cut_lineage(able.select("pid", order.alias("place")))

    holds = seen.select(F.col("pid").alias("holder"), F.col("e")["tid"].alias("pid")).join(able, "pid")
    first = F.min("place").over(Window.partitionBy("holder"))  # four rows at most
    holds = cut_lineage(holds.withColumn("first", first).select("holder", "pid", (F.col("place") == F.col("first")).alias("first")))
    gone = cut_lineage(able.select("pid").join(holds.where("NOT first"), "pid", "left_anti"))
    hit = cut_lineage(holds.join(gone, "pid", "left_semi").select(F.col("holder").alias("pid")).distinct())
    return gone, hit


def union_reduced(*parts: DataFrame) -> DataFrame:
    """All prototypes of several reduced sets, copies included."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reduce_training(
    df: DataFrame,
    method: str,
    by: str | None = None,
    guarded: bool = True,
    max_rounds: int | None = None,
    plan: str = "auto",
    limits: KnnLimits = KnnLimits(),
) -> DataFrame:
    """Reduce per stratum (``by``) or over the union: ``join`` keeps everything, ``enn`` edits, ``fusion`` merges,
    ``fusion_rt2`` merges and then takes out what no other needs."""
    if method == "join":
        return df
    if method == "enn":
        return edit_nearest(df, by, guarded, plan=plan, limits=limits)
    if method in ("fusion", "fusion_rt2"):
        fused = fuse(df, by, max_rounds, FUSION_MIN_ROWS if by else None, plan, limits)
        return fused if method == "fusion" else edit_associates(cut_lineage(fused), by, plan=plan, limits=limits)
    raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
