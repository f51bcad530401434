"""Queries on strata, edited nearest neighbours, fusion and scoring against reduced sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nearspark.catalog.neighbours import (
    LINES_DIST,
    LINES_SPLIT_SQL,
    LINES_SQL,
    PLANE_DIST,
    WIDE_DIST,
    embedding_vectors,
    lineitem_strata,
    near_lines_sql,
    near_sql,
    numbered_items,
    split,
    stored_split,
    stratified_items,
)
from nearspark.catalog.registry import query, sql_draw, table
from nearspark.functions.vectors import features_of
from nearspark.operators import reduction as R
from nearspark.plans.jobs import classify_1nn, reduce_then_classify
from nearspark.session import cut_lineage, scratch_root
from nearspark.sources import store

# Parts with five size classes, a tenth of them mislabelled: the case that editing is made for.
SIGNAL_SQL = f"""WITH v0 AS (SELECT p_partkey AS id, [p_size::double, p_retailprice] AS x, (p_size - 1) // 10 AS clean FROM part),
v AS (SELECT id, x, (CASE WHEN id % 10 = 3 THEN (clean + 1) % 5 ELSE clean END)::int AS label,
{sql_draw(42, "id")} % 7 AS stratum FROM v0)"""


def signal(spark, sf_dir):
    clean = F.floor((F.col("p_size") - 1) / 10).cast("int")
    label = F.when(F.col("p_partkey") % 10 == 3, (clean + 1) % 5).otherwise(clean)
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pid"),
        features_of("p_size", "p_retailprice").alias("features"),
        label.alias("label"),
        F.lit(1.0).alias("weight"),
    )
    return R.stratify(rows, "pid", 7, seed=42)


def shown(df):
    """Prototypes with one column per input."""
    f = F.col("features")
    return df.select("pid", F.round(f[0], 6).alias("f1"), F.round(f[1], 6).alias("f2"), "label", "weight")


SHOWN_SQL = "SELECT id AS pid, round(x[1], 6) AS f1, round(x[2], 6) AS f2, label, {w} AS weight FROM {t}"


# ---- strata ----------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {sql_draw(42, 'o_orderkey')} % 12 AS stratum FROM orders")
def stratify(spark, sf_dir):
    rows = R.stratify(table(spark, sf_dir, "orders"), "o_orderkey", 12, seed=42)
    return rows.select("o_orderkey", F.col("stratum").cast("bigint").alias("stratum"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 100000 + l_linenumber AS strata_id, l_orderkey AS partition_no, "
       "l_linenumber::bigint AS number_no FROM lineitem")  # fmt: skip
def stratum_key(spark, sf_dir):
    key = R.stratum_key(F.col("l_orderkey"), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("strata_id"))
    partition, number = R.split_stratum_key(F.col("strata_id"))
    return rows.withColumn("partition_no", partition).withColumn("number_no", number.cast("bigint"))


@query(SIGNAL_SQL + "SELECT stratum, label, count(*) AS n FROM v GROUP BY ALL")
def class_members(spark, sf_dir):
    return R.class_members(signal(spark, sf_dir), by="stratum").withColumn("stratum", F.col("stratum").cast("bigint"))


# ---- edited nearest neighbours ---------------------------------------------------------------------------------


def edited_sql(source: str, where: str, classes: str, guarded: bool, dist: str = PLANE_DIST, rows: str = "v") -> str:
    guard = f"OR (SELECT count(*) FROM {rows} g WHERE {classes}) < 3" if guarded else ""
    return (
        source
        + near_sql(3, dist, where, rows, rows)
        + f""", same AS (SELECT qid, count(*) FILTER (n.label = v.label) AS same FROM n JOIN {rows} v ON qid = v.id GROUP BY qid),
kept AS (SELECT v.* FROM {rows} v LEFT JOIN same ON id = qid WHERE coalesce(same, 0) >= 2 {guard}) """
    )


UNION_SQL = ("q.id <> t.id", "g.label = v.label")
STRATA_SQL = ("q.id <> t.id AND q.stratum = t.stratum", "g.label = v.label AND g.stratum = v.stratum")
KEPT_SQL = SHOWN_SQL.format(w="1.0::double", t="kept")


@query(edited_sql(SIGNAL_SQL, *UNION_SQL, guarded=False) + KEPT_SQL)
def enn_global_unguarded(spark, sf_dir):
    return shown(R.edit_nearest(signal(spark, sf_dir), guarded=False))


@query(edited_sql(SIGNAL_SQL, *UNION_SQL, guarded=True) + KEPT_SQL)
def enn_global(spark, sf_dir):
    return shown(R.edit_nearest(signal(spark, sf_dir)))


@query(edited_sql(SIGNAL_SQL, *STRATA_SQL, guarded=True) + KEPT_SQL)
def enn_strata(spark, sf_dir):
    return shown(R.edit_nearest(signal(spark, sf_dir), by="stratum"))


@query(edited_sql("WITH v AS (SELECT vec_id AS id, embedding::double[] AS x, label FROM embeddings)", *UNION_SQL, True,
                  WIDE_DIST) + "SELECT id AS pid, label FROM kept")
def enn_embeddings(spark, sf_dir):
    return R.edit_nearest(embedding_vectors(spark, sf_dir).withColumnRenamed("id", "pid")).select("pid", "label")


@query(edited_sql(LINES_SQL, *STRATA_SQL, True, LINES_DIST, "w") + "SELECT id AS pid, label, stratum FROM kept")
def enn_lineitem(spark, sf_dir):
    rows = lineitem_strata(spark, sf_dir).withColumnRenamed("id", "pid")
    return R.edit_nearest(rows, by="stratum").select("pid", "label", F.col("stratum").cast("bigint").alias("stratum"))


# ---- fusion ----------------------------------------------------------------------------------------------------


def fused_sql(where: str, keys: str) -> str:
    """CTE ``fused``: equal rows of a class collapsed, then mutual nearest pairs of a class merged, once."""
    return (
        f""", u AS (SELECT min(id) AS id, x, label, {keys} count(*)::double AS w FROM v0v GROUP BY ALL)"""
        + near_sql(1, PLANE_DIST, where, "u", "u")
        + """, e AS (SELECT u.*, least(u.id, coalesce(n.tid, u.id)) AS lo, greatest(u.id, coalesce(n.tid, u.id)) AS hi
FROM u LEFT JOIN n ON u.id = n.qid),
g AS (SELECT lo, hi, label, list({'id': id, 'x': x, 'w': w} ORDER BY id) AS m FROM e GROUP BY lo, hi, label),
fused AS (SELECT m[1].id AS id, label, list_sum(list_transform(m, lambda z: z.w)) AS w,
CASE WHEN len(m) = 1 THEN m[1].x ELSE [(m[1].x[1]*m[1].w + m[2].x[1]*m[2].w) / (m[1].w + m[2].w),
(m[1].x[2]*m[1].w + m[2].x[2]*m[2].w) / (m[1].w + m[2].w)] END AS x FROM g) """
    )


V0V = ", v0v AS (SELECT * FROM v)"
FUSED_SHOWN = SHOWN_SQL.format(w="w", t="fused")


@query(SIGNAL_SQL + V0V + fused_sql("q.id <> t.id", "") + FUSED_SHOWN)
def fusion_round(spark, sf_dir):
    return shown(R.fusion_round(signal(spark, sf_dir)))


def fused_rounds_sql(rounds: int) -> str:
    """``rounds`` fusion rounds one after the other; rounds behind the last merge change nothing."""
    sql = ", f0 AS (SELECT id, x, label, 1.0::double AS w FROM v)"
    for i in range(1, rounds + 1):
        u, n = f"u{i}", f"n{i}"
        near = near_sql(1, PLANE_DIST, "q.id <> t.id", u, u, n).replace(f"{n}_k AS (", f"{n}_k AS MATERIALIZED (")
        sql += f""", {u} AS MATERIALIZED (SELECT min(id) AS id, x, label, sum(w) AS w FROM f{i - 1} GROUP BY x, label)""" + near
        sql += f""", e{i} AS (SELECT u.*, least(u.id, coalesce(n.tid, u.id)) AS lo, greatest(u.id, coalesce(n.tid, u.id)) AS hi
FROM {u} u LEFT JOIN {n} n ON u.id = n.qid),
g{i} AS (SELECT lo, hi, label, min(id) AS a, max(id) AS b, arg_min(x, id) AS xa, arg_max(x, id) AS xb, arg_min(w, id) AS wa,
arg_max(w, id) AS wb FROM e{i} GROUP BY lo, hi, label),
f{i} AS MATERIALIZED (SELECT a AS id, label, CASE WHEN a = b THEN wa ELSE wa + wb END AS w, CASE WHEN a = b THEN xa
ELSE [(xa[1] * wa + xb[1] * wb) / (wa + wb), (xa[2] * wa + xb[2] * wb) / (wa + wb)] END AS x FROM g{i})"""
    return sql + " "


@query(SIGNAL_SQL + fused_rounds_sql(14) + SHOWN_SQL.format(w="w", t="f14"))
def fusion_global(spark, sf_dir):
    """Fusion over the whole table until nothing merges."""
    return shown(R.fuse(signal(spark, sf_dir)))


@query(SIGNAL_SQL + """, sized AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS c FROM v),
v0v AS (SELECT id, x, label, stratum FROM sized WHERE c > 15)"""
       + fused_sql("q.id <> t.id AND q.stratum = t.stratum", "stratum,")
       + FUSED_SHOWN + " UNION ALL " + SHOWN_SQL.format(w="1.0::double", t="sized WHERE c <= 15"))
def fusion_strata(spark, sf_dir):
    return shown(R.fuse(signal(spark, sf_dir), by="stratum", max_rounds=1, min_rows=R.FUSION_MIN_ROWS))


def associates_sql(rows: str, where: str, keys: str) -> str:
    """CTE ``left_over``: one round of taking out what no other row of ``rows`` needs."""
    place = f"{{'s': -same, 'd': {sql_draw(R.RT2_SEED, 'pid')}, 'p': pid}}"
    return (
        near_sql(4, PLANE_DIST, where, rows, rows, "l")
        + f""", c AS (SELECT a.id AS pid, count(*) FILTER (l.label = a.label AND l.rank <= 3) AS now,
count(*) FILTER (l.label = a.label) AS same FROM {rows} a LEFT JOIN l ON l.qid = a.id GROUP BY a.id),
loss AS (SELECT l.tid AS pid, sum((now >= 2)::int - (same - (l.label = a.label)::int >= 2)::int) AS loss
FROM l JOIN c ON c.pid = l.qid JOIN {rows} a ON a.id = l.qid WHERE l.rank <= 3 GROUP BY l.tid),
able AS (SELECT pid, {place} AS place FROM c LEFT JOIN loss USING (pid) WHERE coalesce(loss, 0) <= 0 AND pid NOT IN
(SELECT id FROM {rows} QUALIFY row_number() OVER (PARTITION BY {keys} label ORDER BY id) <= 3)),
holds AS (SELECT qid, pid, place = min(place) OVER (PARTITION BY qid) AS is_first FROM l JOIN able ON pid = tid),
left_over AS (SELECT * FROM {rows} WHERE id NOT IN
(SELECT pid FROM able WHERE pid NOT IN (SELECT pid FROM holds WHERE NOT is_first))) """
    )


@query(SIGNAL_SQL + V0V + fused_sql("q.id <> t.id", "") + associates_sql("fused", "q.id <> t.id", "")
       + SHOWN_SQL.format(w="w", t="left_over"))
def reduce_rt2(spark, sf_dir):
    """A round of fusion, then a round of taking out prototypes that no other needs."""
    fused = cut_lineage(R.fusion_round(signal(spark, sf_dir)))
    return shown(R.edit_associates(fused, max_rounds=1))


@query(SIGNAL_SQL + associates_sql("v", "q.id <> t.id AND q.stratum = t.stratum", "stratum,")
       + SHOWN_SQL.format(w="1.0::double", t="left_over"))
def reduce_rt2_strata(spark, sf_dir):
    return shown(R.edit_associates(cut_lineage(signal(spark, sf_dir)), by="stratum", max_rounds=1))


@query(SIGNAL_SQL + SHOWN_SQL.format(w="1.0::double", t="v"))
def reduce_join_only(spark, sf_dir):
    return shown(R.reduce_training(signal(spark, sf_dir), "join", by="stratum"))


@query(edited_sql(SIGNAL_SQL, *STRATA_SQL, guarded=True) + KEPT_SQL)
def union_reduced(spark, sf_dir):
    """The union of the strata's reduced sets, each edited by itself."""
    rows = signal(spark, sf_dir)
    return shown(R.union_reduced(*[R.edit_nearest(rows.where(F.col("stratum") == s)) for s in range(7)]))


@query(edited_sql(SIGNAL_SQL, *STRATA_SQL, guarded=True) + KEPT_SQL)
def reduced_roundtrip(spark, sf_dir):
    path = f"{scratch_root(spark)}/reduced-{uuid.uuid4().hex}"
    store.save_table(R.edit_nearest(signal(spark, sf_dir), by="stratum"), path)
    return shown(store.load_table(spark, path))


# ---- reduce and score ------------------------------------------------------------------------------------------

TEST_SQL = f"""{SIGNAL_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY {sql_draw(42, "id")}, id)
<= (SELECT count(*) // 5 FROM v) AS test FROM v), q0 AS (SELECT * FROM s WHERE test), tr AS (SELECT * FROM s WHERE NOT test)"""
SCORE_SQL = ", q AS (SELECT id AS qid, label AS actual FROM q0) SELECT q.qid, actual, z.label AS predicted FROM q JOIN z USING (qid)"


def _signal_split(spark, sf_dir):
    train, test = split(signal(spark, sf_dir).withColumnRenamed("pid", "id"))
    return train.withColumnRenamed("id", "pid"), test


@query(edited_sql(TEST_SQL, *STRATA_SQL, guarded=True, rows="tr") + near_sql(1, PLANE_DIST, q="q0", t="kept", name="z")
       + SCORE_SQL)
def reduce_enn_1nn(spark, sf_dir):
    train, test = _signal_split(spark, sf_dir)
    return reduce_then_classify(train, test, "enn", by="stratum")


@query(TEST_SQL + ", v0v AS (SELECT * FROM tr)" + fused_sql("q.id <> t.id", "") + near_sql(1, PLANE_DIST, q="q0", t="fused", name="z")
       + SCORE_SQL)
def reduce_fusion_1nn(spark, sf_dir):
    train, test = _signal_split(spark, sf_dir)
    return reduce_then_classify(train, test, "fusion", max_rounds=1)


@query(edited_sql(LINES_SPLIT_SQL, *STRATA_SQL, True, LINES_DIST, "t") + near_lines_sql(1, t="kept", name="z")
       + "SELECT id AS qid, q.label AS actual, z.label AS predicted FROM q LEFT JOIN z ON q.id = z.qid")
def reduce_enn_1nn_lineitem(spark, sf_dir):
    """Edit the line items per stratum, then score a held-out fifth on what is left."""
    train, test = stored_split(stratified_items(spark, sf_dir))
    return reduce_then_classify(train.withColumnRenamed("id", "pid"), test, "enn", by="stratum")


@query(LINES_SPLIT_SQL + near_lines_sql(1, q="t", t="q", name="z")
       + "SELECT id AS qid, t.label AS actual, z.label AS predicted FROM t LEFT JOIN z ON t.id = z.qid")
def lookup_1nn_lineitem(spark, sf_dir):
    """Four fifths of the line items scored against the other fifth."""
    test, reference = stored_split(numbered_items(spark, sf_dir))
    return classify_1nn(test, reference.withColumnRenamed("id", "pid"))
