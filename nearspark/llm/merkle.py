"""Merkle manifest of a dataset, and a recursive climb that checks its rows.

``build`` hashes the rows into trees of fanout ``FANOUT``, one for each value of a column, whose roots are the leaves of
one more tree. Every level is grouped from the one below and written as parent-linked rows. ``climb`` is a recursive
query over them: it ascends from the leaves to the root, appends the siblings it passes and folds a digest on the way.
The up to ``FANOUT`` leaves of one run share all siblings above the first level, so a recursive row carries one list of
those for the run, and a digest for each of its leaves.

Rows are numbered inside their tree by ordered range buckets, so a tree that holds a third of all rows, or all of them,
is not sorted in one task; nothing but the root and the size of the largest tree reaches the driver.

Defined cases. NULL in a hashed column: ``-``, unlike any value; a NULL tree value is a tree of its own and stands first.
Rows with the same key, or without one (first): ordered by their leaf digest, so equal rows may change places but no
digest does. Empty and very long texts: hashed whole. A tree of one leaf: that leaf is its root. Empty input: no nodes,
no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspark.session import cut_lineage

FANOUT = 8
ROWS_PER_BUCKET = 200_000
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
TOP = "2"  # the tree over the trees; others are "0" (NULL) or "1" and their value, which keeps the order
PLACE_BITS = 33  # fixed value: the low bits of monotonically_increasing_id are the place inside a partition


def row_hash(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns: each its UTF-8 byte count, ``:`` and its value, or ``-`` if it is NULL."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def hash_of(digests: Column) -> Column:
    """The digest above an array of digests, which are hashed as hex text."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, _hex), ""), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@dataclass
class Manifest:
    """``runs``: the leaves, in runs of siblings. ``nodes``: the rows above them, each with the digests of its children.

    Rows of both have ``tree``, ``level``, ``idx`` and, under ``up_tree``, ``up_level``, ``up_idx`` and ``up_place``,
    where their parent is and where they stand in its run (NULL at the root). ``subroots``: one row a tree.
    """

    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, the place inside the tree by ``order``, and ``n``, the rows of the tree."""
    buckets = max(1, -(-rows.count() // ROWS_PER_BUCKET))
    ordered = rows.repartitionByRange(buckets, "tree", *order).sortWithinPartitions("tree", *order)
    placed = cut_lineage(ordered.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", PLACE_BITS))
    parts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree")  # one row a bucket at most
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("n", F.sum("rows").over(whole)).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    joined = placed.join(parts.drop("rows"), ["tree", "part"])
    return joined.withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


def _above(level: DataFrame, number: int, *carried: str) -> DataFrame:
    """The next level: one row for every run of siblings, with their digests in order."""
    child = F.struct((F.col("idx") % FANOUT).alias("place"), "digest", *carried)
    up = level.groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("run")).agg(F.sort_array(F.collect_list(child)).alias("members"))
    up = up.withColumn("children", F.col("members.digest"))
    alone = (F.col("n") == 1) & F.lit(number == 1)  # a tree of one leaf: its root is the leaf
    digest = F.when(alone, F.col("children")[0]).otherwise(hash_of(F.col("children")))
    size = F.expr(f"(n + {FANOUT - 1}) div {FANOUT}")
    members = ["members"] if carried else []
    return up.select("tree", F.lit(number).alias("level"), F.col("run").alias("idx"), size.alias("n"), "children", digest.alias("digest"), *members)


def _levels(first: DataFrame, most: int) -> list[DataFrame]:
    """Written levels from ``first`` (the number ``level``) up, until the largest tree, of ``most`` nodes, has one node."""
    levels = [first]
    while most > 1:
        levels.append(cut_lineage(_above(levels[-1].where("n > 1"), len(levels) + 1)))
        most = -(-most // FANOUT)
    return levels


def _linked(rows: DataFrame, tops: DataFrame | None) -> DataFrame:
    """Add where each node's parent is; roots of trees have theirs in the tree over the trees."""
    inside = F.col("n") > 1
    linked = rows.withColumns(
        {
            "up_tree": F.when(inside, F.col("tree")),
            "up_level": F.when(inside, F.col("level") + 1),
            "up_idx": F.when(inside, F.expr(f"idx div {FANOUT}")),
            "up_place": F.when(inside, F.col("idx") % FANOUT),
        }
    )
    if tops is None:
        return linked
    linked = linked.join(tops, "tree", "left")
    over = ~inside & (F.col("trees") > 1)
    return linked.withColumns(
        {
            "up_tree": F.when(over, F.lit(TOP)).otherwise(F.col("up_tree")),
            "up_level": F.when(over, F.lit(1)).otherwise(F.col("up_level")),
            "up_idx": F.when(over, F.expr(f"at div {FANOUT}")).otherwise(F.col("up_idx")),
            "up_place": F.when(over, F.col("at") % FANOUT).otherwise(F.col("up_place")),
        }
    ).drop("at", "trees")


def build(rows: DataFrame, by: str, key: str, leaf: Column, changed: Column) -> Manifest:
    """Trees over ``rows``: one for each value of ``by``, leaves in order of ``key``.

    ``leaf`` is the digest that the manifest holds, as hex; ``changed`` the digest that is to be checked against it later
    (the same, if the row is as it was).
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col(by).cast("string")), F.lit("0"))
    leaves = cut_lineage(rows.select(tree.alias("tree"), F.col(key).alias("key"), F.unhex(leaf).alias("digest"), F.unhex(changed).alias("changed")))
    numbered = _numbered(leaves, ["key", "digest"])
    runs = cut_lineage(_above(numbered, 1, "key", "changed"))
    most = runs.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest(_linked(runs, None), _linked(runs.drop("members"), None), runs.select("tree", "digest"), None)
    levels = _levels(runs, most)
    subroots = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    subroots = cut_lineage(subroots)

    tops = cut_lineage(_numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), "digest"), ["key"]))
    trees = tops.agg(F.max("n")).first()[0]
    places = tops.select(F.col("key").alias("tree"), F.col("idx").alias("at"), F.col("n").alias("trees"))
    nodes = None
    for level in levels[1:]:
        nodes = level if nodes is None else nodes.unionByName(level)
    nodes = _linked(nodes if nodes is not None else runs.drop("members").limit(0), places)
    root = subroots
    if trees > 1:
        over = _levels(cut_lineage(_above(tops, 1)), -(-trees // FANOUT))
        for level in over:
            nodes = nodes.unionByName(_linked(level, None))
        root = over[-1]
    digest = root.select(_hex(F.col("digest"))).first()[0]  # one row
    link = ["up_tree", "up_level", "up_idx", "up_place"]
    nodes = cut_lineage(nodes.select("tree", "level", "idx", "children", *link))
    return Manifest(_linked(runs, places), nodes, subroots, digest)


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, idx, up_tree, up_level, up_idx, up_place, folded, CAST('' AS BINARY) AS siblings FROM {starts}
  UNION ALL
  SELECT c.tree, c.idx, n.up_tree, n.up_level, n.up_idx, n.up_place,
    transform(c.folded, f -> unhex(sha2(concat(
      {before}, lower(hex(f)), {after}), 256))),
    concat(c.siblings, unhex({before}), unhex({after}))
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx
)
SELECT tree, idx, folded, siblings FROM climb WHERE up_tree IS NULL
"""
_JOINED = "array_join(transform(slice(n.children, {first}, {count}), d -> lower(hex(d))), '')"
_BEFORE = _JOINED.format(first="1", count="CAST(c.up_place AS INT)")
_AFTER = _JOINED.format(first="CAST(c.up_place AS INT) + 2", count="greatest(size(n.children) - CAST(c.up_place AS INT) - 1, 0)")


def climb(manifest: Manifest) -> DataFrame:
    """One row per leaf: key, tree, leaf, ``proof_sha256`` (of its siblings up to the root) and ``folded_root``, the root
    that follows from its changed digest and those siblings."""
    spark = manifest.runs.sparkSession
    own = F.transform(
        "members",
        lambda m: F.when(
            (F.size("children") > 1) | (F.col("n") > 1),  # all but the lone leaf of a tree
            hash_of(F.transform("members", lambda o: F.when(o["place"] == m["place"], m["changed"]).otherwise(o["digest"]))),
        ).otherwise(m["changed"]),
    )
    starts = manifest.runs.withColumn("folded", own)
    query = CLIMB.replace("{before}", _BEFORE).replace("{after}", _AFTER)
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # its default stops a recursion at a million rows
    try:
        ended = cut_lineage(spark.sql(query, starts=starts, nodes=manifest.nodes))
    finally:
        spark.conf.set(ROW_LIMIT, limit)
    joined = manifest.runs.select("tree", "idx", "members").join(ended, ["tree", "idx"])
    each = joined.select("tree", "members", "siblings", "folded", F.posexplode("members").alias("at", "m"))
    others = F.filter("members", lambda o: o["place"] != F.col("m.place"))
    beside = F.array_join(F.transform(others, lambda o: _hex(o["digest"])), "")
    return each.select(
        F.col("m.key").alias("key"),
        "tree",
        _hex(F.col("m.digest")).alias("leaf"),
        F.sha2(F.concat(beside, _hex(F.col("siblings"))), 256).alias("proof_sha256"),
        _hex(F.col("folded")[F.col("at")]).alias("folded_root"),
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, one tree a language, checked against a copy in which the text of every row whose
    unsigned crc32 of the decimal doc_id divides by 3 has its A-Z lower-cased."""
    def leaf(text: Column) -> Column:
        return row_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.col("text")
    changed = F.when(tampered & text.rlike("[A-Z]"), leaf(lower_ascii(text))).otherwise(F.col("leaf"))
    manifest = build(docs.withColumn("leaf", leaf(text)), "lang", "doc_id", F.col("leaf"), changed)
    subroots = manifest.subroots.select("tree", _hex(F.col("digest")).alias("subroot"))
    root = F.lit(manifest.root)
    return (
        climb(manifest)
        .join(subroots, "tree")
        .select(
            F.col("key").alias("doc_id"),
            "leaf",
            "subroot",
            root.alias("root"),
            "proof_sha256",
            "folded_root",
            (F.col("folded_root") == root).alias("verified"),
        )
    )
