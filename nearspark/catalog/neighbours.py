"""Queries on nearest neighbours, votes and evaluation."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from nearspark.catalog import tables
from nearspark.catalog.registry import query, sql_draw, table
from nearspark.catalog.tables import LABELS_SQL, LINEITEM_KEY
from nearspark.functions.vectors import draw, features_of
from nearspark.operators import encode as E
from nearspark.operators import evaluate as V
from nearspark.operators.knn import KnnLimits, first_k, knn_join, merge_top_k
from nearspark.operators.knn import neighbor_lists as as_lists
from nearspark.operators.reduction import stratify
from nearspark.operators.rowid import with_row_id
from nearspark.operators.sampling import random_split
from nearspark.operators.vote import majority_vote
from nearspark.plans.jobs import classify_1nn as score_1nn
from nearspark.plans.jobs import classify_knn, classify_text, classify_text_1nn, instances, run_scoring
from nearspark.session import cut_lineage, scratch_root
from nearspark.sources import store
from nearspark.sources.text import parse_lines, read_header, read_lines

# ---- fixtures: (id, features, label) tables and their SQL -------------------------------------------------------

SEGMENTS_SQL = LABELS_SQL.format("c_mktsegment", "customer")

VECTORS_SQL = "v AS (SELECT vec_id AS id, embedding::double[] AS x, label FROM embeddings)"
CUSTOMERS_SQL = f"""v AS (SELECT c_custkey AS id, [c_acctbal, c_nationkey::double] AS x, l.code AS label, c_mktsegment
FROM customer JOIN {SEGMENTS_SQL} l ON c_mktsegment = l.label)"""
PARTS_SQL = """v AS (SELECT p_partkey AS id, [p_size::double, p_retailprice] AS x, p_size // 10 AS label FROM part)"""
SPLIT_SQL = f""", s AS (SELECT *, row_number() OVER (ORDER BY {sql_draw(42, "id")}, id) <= (SELECT count(*) // 5 FROM v) AS test
FROM v), q AS (SELECT * FROM s WHERE test), t AS (SELECT * FROM s WHERE NOT test)"""
WIDE_DIST = "list_sum(list_transform(list_zip(q.x, t.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
PLANE_DIST = "(q.x[1] - t.x[1]) * (q.x[1] - t.x[1]) + (q.x[2] - t.x[2]) * (q.x[2] - t.x[2])"


def near_sql(k: int, dist: str, where: str = "true", q: str = "q", t: str = "t", name: str = "n") -> str:
    """CTE ``name(qid, rank, dist, tid, label)``: the k nearest by (distance, id)."""
    return f""", {name}_k AS (SELECT q.id AS qid, min({{'dist': {dist}, 'tid': t.id, 'label': t.label}}, {k}) AS m
FROM {q} q JOIN {t} t ON {where} GROUP BY q.id),
{name} AS (SELECT qid, rank, e.dist AS dist, e.tid AS tid, e.label AS label FROM
(SELECT qid, unnest(m) AS e, unnest(range(1, len(m) + 1)) AS rank FROM {name}_k))"""


VOTE_SQL = """, p AS (SELECT qid, label AS predicted, c AS votes FROM (SELECT qid, label, count(*) AS c FROM n GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) = 1)"""


def embedding_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    rows = E.encode_label(rows, E.label_dictionary(rows, "c_mktsegment"), "c_mktsegment", "label")
    return rows.select(
        F.col("c_custkey").alias("id"), features_of("c_acctbal", "c_nationkey").alias("features"), "label", "c_mktsegment"
    )


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        features_of("p_size", "p_retailprice").alias("features"),
        F.floor(F.col("p_size") / 10).cast("int").alias("label"),
    )


def lineitems(spark, sf_dir):
    """All line items with a dense id, four inputs and the return flag as class code; numbered and written once."""
    return cut_lineage(numbered_items(spark, sf_dir))


def numbered_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    rows = E.encode_label(items, E.label_dictionary(items, "l_returnflag"), "l_returnflag", "label")
    inputs = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return with_row_id(rows, LINEITEM_KEY, "id", keep=[*inputs, "label"]).select("id", features_of(*inputs).alias("features"), "label")


def split(df):
    """A fifth of the rows for testing, the rest for training."""
    test, train = random_split(df, "id", df.count() // 5, seed=42)
    return train, test


def stored_split(df):
    """The same for large tables: the rows are written with their draws, which are made once however often a side is read. The
    fifth is written again, so that nobody reads the whole table for it."""
    rows = cut_lineage(df.withColumn("draw", draw(42, "id")))
    test, train = random_split(rows, "id", rows.count() // 5, seed=42, drawn="draw")
    return train.drop("draw"), cut_lineage(test.drop("draw"))


def join(q, t, k, **options):
    return knn_join(q, t, k, qid="id", tid="id", label="label", **options)


# ---- joins -----------------------------------------------------------------------------------------------------


@query("WITH " + VECTORS_SQL + SPLIT_SQL + near_sql(5, WIDE_DIST)
       + "SELECT qid, rank, tid, label, round(dist, 6) AS dist FROM n")
def knn_join_k5(spark, sf_dir):
    train, test = split(embedding_vectors(spark, sf_dir))
    return join(test, train, 5).withColumn("dist", F.round("dist", 6))


@query("WITH " + CUSTOMERS_SQL + SPLIT_SQL + near_sql(9, PLANE_DIST) + "SELECT qid, rank, tid, label, dist FROM n")
def knn_join_tabular(spark, sf_dir):
    train, test = split(customers(spark, sf_dir))
    return join(test, train, 9)


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(4, PLANE_DIST) + "SELECT qid, rank, tid, label, dist FROM n")
def knn_join_blocked(spark, sf_dir):
    train, test = split(parts(spark, sf_dir))
    return join(test, train, 4, plan="broadcast_queries")


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(4, PLANE_DIST) + "SELECT qid, rank, tid, label, dist FROM n")
def knn_join_cells(spark, sf_dir):
    train, test = split(parts(spark, sf_dir))
    return join(test, train, 4, plan="cells", limits=KnnLimits(block_rows=512))


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(1, PLANE_DIST) + "SELECT qid, tid, label, dist FROM n")
def lookup_1nn(spark, sf_dir):
    reference, rows = split(parts(spark, sf_dir))
    return join(rows, reference, 1, plan="broadcast_train").drop("rank")


@query("WITH " + VECTORS_SQL + near_sql(3, WIDE_DIST, "q.id <> t.id", "v", "v")
       + "SELECT qid, rank, tid, label, round(dist, 6) AS dist FROM n")
def knn_self_join(spark, sf_dir):
    rows = embedding_vectors(spark, sf_dir)
    return join(rows, rows, 3, exclude_self=True).withColumn("dist", F.round("dist", 6))


@query("WITH " + VECTORS_SQL + SPLIT_SQL + near_sql(5, WIDE_DIST)
       + "SELECT qid, rank, tid, label, round(dist, 6) AS dist FROM n")
def knn_join_pivots(spark, sf_dir):
    """Wide vectors in a grid of small blocks around pivots."""
    train, test = split(embedding_vectors(spark, sf_dir))
    found = join(test, train, 5, plan="pivots", limits=KnnLimits(block_rows=64))
    return found.withColumn("dist", F.round("dist", 6))


@query("WITH " + VECTORS_SQL + near_sql(3, WIDE_DIST, "q.id <> t.id", "v", "v")
       + "SELECT qid, rank, tid, label, round(dist, 6) AS dist FROM n")
def knn_self_join_pivots(spark, sf_dir):
    rows = embedding_vectors(spark, sf_dir)
    found = join(rows, rows, 3, exclude_self=True, plan="pivots", limits=KnnLimits(block_rows=64))
    return found.withColumn("dist", F.round("dist", 6))


@query("WITH " + PARTS_SQL + f", w AS (SELECT *, {sql_draw(42, 'id')} % 7 AS stratum FROM v)"
       + near_sql(3, PLANE_DIST, "q.stratum = t.stratum AND q.id <> t.id", "w", "w")
       + "SELECT qid, rank, tid, label, dist FROM n")
def knn_self_join_strata(spark, sf_dir):
    rows = stratify(parts(spark, sf_dir), "id", 7, seed=42)
    return join(rows, rows, 3, by="stratum", exclude_self=True, plan="cells")


ITEMS_SQL = f"""WITH v AS (SELECT row_number() OVER (ORDER BY {', '.join(LINEITEM_KEY)}) - 1 AS id,
l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d,
CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem)"""
LINES_SQL = ITEMS_SQL + f""",
w AS (SELECT *, {sql_draw(42, 'id')} % greatest(1, (SELECT count(*) // 1000 FROM v)) AS stratum FROM v)"""
LINES_DIST = """(q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c)
+ (q.d - t.d) * (q.d - t.d)"""


LINES_SPLIT_SQL = LINES_SQL + f""", s AS (SELECT *, row_number() OVER (ORDER BY {sql_draw(42, "id")}, id)
<= (SELECT count(*) // 5 FROM v) AS test FROM w), q AS (SELECT * FROM s WHERE test), t AS (SELECT * FROM s WHERE NOT test)"""


def near_lines_sql(k: int, q: str = "q", t: str = "t", name: str = "n", others: str = "") -> str:
    """``near_sql`` for line items: the k rows on either side by price bound the k-th distance, so a range of prices is enough.
    ``others`` is a further condition on both."""
    return (
        f""", {name}_t AS (SELECT *, row_number() OVER (ORDER BY b, id) AS rn FROM {t}),
{name}_q AS (SELECT q.*, coalesce(t.rn, 0) AS rn FROM {q} q ASOF LEFT JOIN {name}_t t ON q.b >= t.b),
{name}_p AS (SELECT *, unnest(range(rn - {k}, rn + {k + 1})) AS near FROM {name}_q),
{name}_d AS (SELECT q.id, list_sort(list({LINES_DIST}))[{k}] AS kth FROM {name}_p q JOIN {name}_t t ON t.rn = near{others} GROUP BY q.id),
{name}_r AS (SELECT q.*, coalesce(sqrt(kth) * 1.000001 + 0.000001, 'inf'::double) AS r FROM {name}_q q LEFT JOIN {name}_d USING (id))"""
        + near_sql(k, LINES_DIST, f"t.b BETWEEN q.b - q.r AND q.b + q.r{others}", f"{name}_r", t, name)
    )


def lineitem_strata(spark, sf_dir):
    """The line items with their stratum, written as well."""
    return cut_lineage(stratified_items(spark, sf_dir))


def stratified_items(spark, sf_dir):
    """About 1,000 line items in each stratum."""
    strata = max(1, table(spark, sf_dir, "lineitem").count() // 1000)
    return stratify(numbered_items(spark, sf_dir), "id", strata, seed=42)


@query(ITEMS_SQL + near_lines_sql(3, "v", "v", others=" AND q.id <> t.id") + "SELECT qid, rank, tid, label, dist FROM n")
def knn_self_join_lineitem(spark, sf_dir):
    """The three nearest others of every line item, in the whole table."""
    rows = lineitems(spark, sf_dir)
    return join(rows, rows, 3, exclude_self=True)


@query(LINES_SPLIT_SQL + near_lines_sql(9) + "SELECT qid, rank, tid, label, dist FROM n")
def knn_join_lineitem(spark, sf_dir):
    """The nine nearest line items of a held-out fifth of them."""
    train, test = stored_split(numbered_items(spark, sf_dir))
    return join(test, train, 9)


# ---- merge, order, vote ----------------------------------------------------------------------------------------


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(3, PLANE_DIST) + "SELECT qid, rank, tid, label, dist FROM n")
def topk_merge(spark, sf_dir):
    train, test = split(parts(spark, sf_dir))
    first, second = random_split(train, "id", train.count() // 2, seed=7)
    partial = join(test, first, 3).unionByName(join(test, second, 3)).drop("rank")
    return merge_top_k(partial, 3)


@query("WITH " + CUSTOMERS_SQL + SPLIT_SQL + near_sql(4, PLANE_DIST) + VOTE_SQL + "SELECT qid, predicted, votes FROM p")
def vote_majority(spark, sf_dir):
    train, test = split(customers(spark, sf_dir))
    return majority_vote(join(test, train, 4))


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(4, PLANE_DIST)
       + "SELECT qid, string_agg(tid::varchar, ',' ORDER BY rank) AS tids, count(*) AS n FROM n GROUP BY qid")
def neighbor_lists(spark, sf_dir):
    train, test = split(parts(spark, sf_dir))
    lists = as_lists(join(test, train, 4), "label")
    tids = F.array_join(F.transform("neighbors", lambda e: e["tid"].cast("string")), ",")
    return lists.select("qid", tids.alias("tids"), F.size("neighbors").cast("bigint").alias("n"))


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(2, PLANE_DIST) + "SELECT qid, rank, tid, label, dist FROM n",
       name="first_k")
def first_two(spark, sf_dir):
    train, test = split(parts(spark, sf_dir))
    return first_k(join(test, train, 5), 2)


# ---- jobs ------------------------------------------------------------------------------------------------------


def _classified(k: int, source: str, dist: str) -> str:
    return (
        "WITH " + source + SPLIT_SQL + near_sql(k, dist) + VOTE_SQL
        + ", c AS (SELECT id AS qid, label AS actual, predicted FROM q LEFT JOIN p ON q.id = p.qid) "
    )


def _register_classify(k: int):
    @query(_classified(k, VECTORS_SQL, WIDE_DIST) + "SELECT qid, actual, predicted FROM c", name=f"classify_knn_k{k}")
    def classify(spark, sf_dir):
        train, test = split(embedding_vectors(spark, sf_dir))
        return classify_knn(train, test, k)


for _k in (1, 5, 9):
    _register_classify(_k)


def customer_predictions(spark, sf_dir):
    train, test = split(customers(spark, sf_dir))
    return classify_knn(train, test, 5)


CUSTOMER_PREDICTIONS_SQL = _classified(5, CUSTOMERS_SQL, PLANE_DIST)


@query(CUSTOMER_PREDICTIONS_SQL + "SELECT qid, actual, predicted FROM c")
def classify_knn_tabular(spark, sf_dir):
    return customer_predictions(spark, sf_dir)


@query(LINES_SPLIT_SQL + near_lines_sql(9) + VOTE_SQL
       + "SELECT id AS qid, label AS actual, predicted FROM q LEFT JOIN p ON q.id = p.qid")
def classify_knn_lineitem(spark, sf_dir):
    """Nine-neighbour classification of a held-out fifth of the line items."""
    train, test = stored_split(numbered_items(spark, sf_dir))
    return classify_knn(train, test, 9)


# Text in, predictions out: categories are coded by the training lines, classes by the header, and test records with a
# missing value keep their place without a prediction.
FIFTH_SQL = f"QUALIFY row_number() OVER (ORDER BY {sql_draw(42, 'id')}, id) <= (SELECT count(*) // 5 FROM lines)"


def text_sql(cut: str, number: str = "id") -> str:
    """Records of the text: those of ``cut`` are asked for, the others are known by ``number``."""
    return tables.LINES_SQL + f""", cut AS (SELECT id FROM lines {cut}),
tr AS (SELECT * FROM st WHERE id NOT IN (SELECT id FROM cut) AND status = 'ok'),
te AS (SELECT * FROM st WHERE id IN (SELECT id FROM cut) AND status IN ('ok', 'missing')),
d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT k[4] AS v FROM tr)),
h AS {tables.TYPES_DESC_SQL},
t AS (SELECT {number} AS id, [k[2]::double, k[3]::double, d.c::double] AS x, h.code AS label FROM tr JOIN d ON k[4] = v JOIN h ON k[5] = h.label),
q0 AS (SELECT te.id, status, [try_cast(k[2] AS double), try_cast(k[3] AS double), coalesce(d.c, -1)::double] AS x, h.code AS label
  FROM te LEFT JOIN d ON k[4] = v JOIN h ON k[5] = h.label),
q AS (SELECT * FROM q0 WHERE status = 'ok')"""


TEXT_SQL = text_sql(FIFTH_SQL)
SPACE_DIST = PLANE_DIST + " + (q.x[3] - t.x[3]) * (q.x[3] - t.x[3])"


@query(TEXT_SQL + near_sql(5, SPACE_DIST) + VOTE_SQL
       + "SELECT id AS qid, label AS actual, predicted FROM q0 LEFT JOIN p ON id = qid")
def classify_knn_text(spark, sf_dir):
    lines = tables.part_lines(spark, sf_dir)
    test, train = random_split(lines, "id", lines.count() // 5, seed=42)
    labels = read_header(tables.header_lines(table(spark, sf_dir, "part"), "p_type"))
    return classify_text(train, test, tables.PART, labels, 5)


# Three files: two of known records, one of records to classify. Lines are numbered per file, known records over both files.
FILES_SQL = text_sql("WHERE id % 3 = 2", "(id % 3) * 1000000000 + id") + """,
numbered AS (SELECT id, row_number() OVER (PARTITION BY id % 3 ORDER BY id) - 1 AS line FROM lines)"""


def text_files(spark, sf_dir) -> list[DataFrame]:
    """Known and unknown records, written as text files and read back."""
    path = f"{scratch_root(spark)}/lines-{uuid.uuid4().hex}"
    lines = tables.part_lines(spark, sf_dir).withColumn("src", F.col("id") % 3)
    ordered = lines.repartition(3, "src").sortWithinPartitions("src", "id").select("src", "value")
    ordered.write.partitionBy("src").text(path)
    return [read_lines(spark, [f"{path}/src={i}" for i in files], whole_path=True) for files in ((0, 1), (2,))]


@query(FILES_SQL + near_sql(5, SPACE_DIST) + VOTE_SQL
       + """SELECT 'src=2' AS input_file, line, label AS actual, predicted FROM q0 JOIN numbered USING (id)
LEFT JOIN p ON id = qid""")  # fmt: skip
def classify_text_files(spark, sf_dir):
    """Text files to predictions, saved per input file."""
    known, asked = text_files(spark, sf_dir)
    labels = read_header(tables.header_lines(table(spark, sf_dir, "part"), "p_type"))
    asked = asked.withColumn("input_file", F.element_at(F.split("input_file", "/"), -2))
    found = classify_text(known, asked, tables.PART, labels, 5, carry=["input_file", "line"])
    path = f"{scratch_root(spark)}/by-file-{uuid.uuid4().hex}"
    store.save_predictions_by_file(found, path, "line")
    return store.load_table(spark, path).select("input_file", "line", "actual", "predicted")


@query(FILES_SQL + near_sql(1, SPACE_DIST)
       + """SELECT line, q0.label AS actual, n.label AS predicted FROM q0 JOIN numbered USING (id)
LEFT JOIN n ON q0.id = n.qid""")  # fmt: skip
def score_text_files(spark, sf_dir):
    """Text scored on a saved set, coded by a saved description."""
    known, asked = text_files(spark, sf_dir)
    labels = read_header(tables.header_lines(table(spark, sf_dir, "part"), "p_type"))
    path = f"{scratch_root(spark)}/model-{uuid.uuid4().hex}"
    records = parse_lines(known, tables.PART)
    store.save_description(records.withColumn("p_partkey", F.lit(None)), tables.PART, f"{path}/description")
    attributes, dictionary, _ = store.load_description(spark, f"{path}/description")
    vectors = instances(records, attributes, dictionary, labels).where("label IS NOT NULL")
    store.save_table(vectors.withColumnRenamed("id", "pid"), f"{path}/reduced")
    found = classify_text_1nn(asked, attributes, dictionary, labels, store.load_table(spark, f"{path}/reduced"), carry=["line"])
    return found.select("line", "actual", "predicted")


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(1, PLANE_DIST)
       + "SELECT id AS qid, q.label AS actual, n.label AS predicted FROM q LEFT JOIN n ON q.id = n.qid")
def classify_1nn(spark, sf_dir):
    reduced, rows = split(parts(spark, sf_dir))
    return score_1nn(rows, reduced.withColumnRenamed("id", "pid"))


@query("WITH " + PARTS_SQL + SPLIT_SQL
       + ", g AS (SELECT * FROM q WHERE label < 4)" + near_sql(3, PLANE_DIST, q="g") + VOTE_SQL
       + "SELECT id AS qid, label AS actual, predicted, coalesce(predicted, 0) AS filled FROM q LEFT JOIN p ON id = qid")
def truth_left_join(spark, sf_dir):
    train, test = split(parts(spark, sf_dir))
    votes = majority_vote(join(test.where("label < 4"), train, 3))  # leaves test rows without a prediction
    filled = V.with_truth(test, votes, "id", "label", missing_class=0).select("qid", F.col("predicted").alias("filled"))
    return V.with_truth(test, votes, "id", "label").join(filled, "qid")


# ---- evaluation ------------------------------------------------------------------------------------------------


def _codes(spark, sf_dir):
    return V.class_codes(E.label_dictionary(table(spark, sf_dir, "customer"), "c_mktsegment"))


# Every 13th prediction is missing, and the last class is not listed.
GAPS_SQL = f""", l AS (SELECT code FROM {SEGMENTS_SQL} WHERE code < 4 UNION ALL SELECT NULL),
m AS (SELECT CASE WHEN qid % 13 > 0 AND predicted < 4 THEN predicted END AS predicted,
CASE WHEN actual < 4 THEN actual END AS actual FROM c)"""


def predictions_with_gaps(spark, sf_dir):
    predicted = F.when(F.col("qid") % 13 > 0, F.col("predicted"))
    return customer_predictions(spark, sf_dir).withColumn("predicted", predicted), _codes(spark, sf_dir)[:-1]


@query(CUSTOMER_PREDICTIONS_SQL + GAPS_SQL + """SELECT a.code AS predicted, b.code AS actual, (SELECT count(*) FROM m
WHERE m.predicted IS NOT DISTINCT FROM a.code AND m.actual IS NOT DISTINCT FROM b.code) AS n FROM l a JOIN l b ON true""")  # fmt: skip
def confusion_long(spark, sf_dir):
    return V.confusion_long(*predictions_with_gaps(spark, sf_dir))


@query(CUSTOMER_PREDICTIONS_SQL + GAPS_SQL
       + f"""SELECT code AS predicted, {", ".join(f'count(*) FILTER (actual = {i}) AS "{i}"' for i in range(4))},
count(*) FILTER (found AND actual IS NULL) AS "none"
FROM l LEFT JOIN (SELECT *, true AS found FROM m) m ON predicted IS NOT DISTINCT FROM code GROUP BY code""")  # fmt: skip
def confusion_pivot(spark, sf_dir):
    return V.confusion_matrix(*predictions_with_gaps(spark, sf_dir))


@query(CUSTOMER_PREDICTIONS_SQL + """SELECT count(*) AS n, count(*) FILTER (predicted = actual) AS correct,
count(*) FILTER (predicted = actual) / count(*) AS accuracy FROM c""")  # fmt: skip
def accuracy(spark, sf_dir):
    return V.accuracy(customer_predictions(spark, sf_dir))


@query(CUSTOMER_PREDICTIONS_SQL + f""", l AS {SEGMENTS_SQL},
r AS (SELECT a.label AS x, upper(b.label) AS y FROM c JOIN l a ON actual = a.code JOIN l b ON predicted = b.code)
SELECT count(*) AS n, count(*) FILTER (lower(x) = lower(y)) AS correct,
count(*) FILTER (lower(x) = lower(y)) / count(*) AS accuracy FROM r""")  # fmt: skip
def accuracy_labels(spark, sf_dir):
    labels = E.label_dictionary(table(spark, sf_dir, "customer"), "c_mktsegment")
    rows = customer_predictions(spark, sf_dir)
    rows = E.decode_label(rows.withColumnRenamed("actual", "a"), labels, "a", "actual")
    rows = E.decode_label(rows.withColumnRenamed("predicted", "p"), labels, "p", "predicted")
    return V.accuracy_labels(rows.withColumn("predicted", F.upper("predicted")))


# Every 7th document has no prediction.
BINARY_SQL = """WITH b AS (SELECT quality AS a, CASE WHEN doc_id % 7 > 0 THEN (n_chars >= 1500)::int END AS p
FROM labels JOIN documents USING (doc_id)),
r AS (SELECT (count(*) FILTER (a = 1) < count(*) FILTER (a = 0))::int AS positive,
count(*) FILTER (a = 0 AND p = 0)::double / count(*) FILTER (a = 0) AS r0,
count(*) FILTER (a = 1 AND p = 1)::double / count(*) FILTER (a = 1) AS r1 FROM b) """


def quality_predictions(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return rows.select(
        F.col("doc_id").alias("qid"), F.col("quality").alias("actual"),
        F.when(F.col("doc_id") % 7 > 0, (F.col("n_chars") >= 1500).cast("int")).alias("predicted"),
    )


@query(BINARY_SQL + "SELECT positive, (r0 + r1) / 2 AS auc FROM r")
def binary_auc(spark, sf_dir):
    return V.binary_auc(quality_predictions(spark, sf_dir))


@query(BINARY_SQL + "SELECT positive, sqrt(r0 * r1) AS gmean FROM r")
def binary_gmean(spark, sf_dir):
    return V.binary_gmean(quality_predictions(spark, sf_dir))


# ---- sinks -----------------------------------------------------------------------------------------------------


@query(CUSTOMER_PREDICTIONS_SQL + "SELECT qid, actual, predicted FROM c")
def predictions_table(spark, sf_dir):
    path = f"{scratch_root(spark)}/predictions-{uuid.uuid4().hex}"
    store.save_predictions(customer_predictions(spark, sf_dir), path)
    return spark.read.schema("qid bigint, actual int, predicted int").csv(path, header=True)


@query(CUSTOMER_PREDICTIONS_SQL + "SELECT qid, actual, predicted FROM c ORDER BY qid")
def predictions_ordered(spark, sf_dir):
    return V.ordered(customer_predictions(spark, sf_dir))


@query(CUSTOMER_PREDICTIONS_SQL + "SELECT 'nation-' || c_nationkey AS input_file, qid, predicted "
       "FROM c JOIN customer ON qid = c_custkey")  # fmt: skip
def predictions_by_file(spark, sf_dir):
    path = f"{scratch_root(spark)}/by-file-{uuid.uuid4().hex}"
    files = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("qid"), F.concat(F.lit("nation-"), F.col("c_nationkey")).alias("input_file")
    )
    predictions = customer_predictions(spark, sf_dir).select("qid", "predicted")
    store.save_predictions_by_file(predictions.join(files, "qid"), path)
    return store.load_table(spark, path).select("input_file", "qid", "predicted")


@query(CUSTOMER_PREDICTIONS_SQL + GAPS_SQL
       + f"""SELECT code AS predicted, {", ".join(f'count(*) FILTER (actual = {i})::int AS "{i}"' for i in range(4))},
count(*) FILTER (found AND actual IS NULL)::int AS "none", (SELECT count(*) FROM m) AS n,
(SELECT count(*) FILTER (predicted = actual) FROM m) AS correct
FROM l LEFT JOIN (SELECT *, true AS found FROM m) m ON predicted IS NOT DISTINCT FROM code GROUP BY code""")  # fmt: skip
def report_files(spark, sf_dir):
    """The report of a run, written and read back: confusion matrix and accuracy."""
    predictions, codes = predictions_with_gaps(spark, sf_dir)
    known = F.when(F.col("predicted").isin(codes), F.col("predicted"))
    path = f"{scratch_root(spark)}/report-{uuid.uuid4().hex}"
    store.save_report(predictions.withColumn("predicted", known), codes, path)
    matrix = spark.read.csv(f"{path}/confusion", header=True, schema="predicted int, `0` int, `1` int, `2` int, `3` int, none int")
    shares = spark.read.json(f"{path}/accuracy", schema="n bigint, correct bigint, accuracy double").first()  # one row
    return matrix.withColumns({"n": F.lit(shares["n"]), "correct": F.lit(shares["correct"])})


@query("WITH " + PARTS_SQL + SPLIT_SQL + near_sql(1, PLANE_DIST)
       + """, s1 AS (SELECT id AS qid, q.label AS actual, n.label AS predicted FROM q LEFT JOIN n ON q.id = n.qid)
SELECT 'part-' || qid % 4 AS input_file, qid, actual, predicted, (SELECT count(*) FILTER (predicted = actual) FROM s1) AS correct,
true AS refused FROM s1""")  # fmt: skip
def scoring_run(spark, sf_dir):
    """A scoring job: predictions per input file and a report; a second run into the same output is refused."""
    reduced, rows = split(parts(spark, sf_dir))
    reduced = cut_lineage(reduced.withColumnRenamed("id", "pid"))
    rows = rows.withColumn("input_file", F.concat(F.lit("part-"), F.col("id") % 4))
    codes = [r["label"] for r in reduced.select("label").distinct().collect()]
    path = f"{scratch_root(spark)}/scoring-{uuid.uuid4().hex}"
    found = run_scoring(rows, reduced, sorted(codes), path)
    try:
        run_scoring(rows, reduced, sorted(codes), path)
        refused = False
    except AnalysisException:
        refused = True
    correct = spark.read.json(f"{path}/report/accuracy").first()["correct"]
    return found.select("input_file", "qid", "actual", "predicted", F.lit(correct).alias("correct"), F.lit(refused).alias("refused"))
