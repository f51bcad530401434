"""Queries on sources, filters, dictionaries, profiles, arrays and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.catalog.registry import query, sql_draw, table
from nearspark.functions import vectors as V
from nearspark.operators import encode as E
from nearspark.operators import predicates as P
from nearspark.operators import profile as R
from nearspark.operators import roles as A
from nearspark.operators import sampling as S
from nearspark.operators.rowid import with_row_id
from nearspark.session import scratch_root
from nearspark.sources import store, text

PART = A.Attributes.of("I 2 N C L", ["p_partkey", "p_size", "p_retailprice", "p_brand", "p_type"])
ORDERS = A.Attributes.of("I I C N I L", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                         "o_orderpriority"])

# Every part becomes one line of text; faults are put into some lines so that each rule of the reader is met.
LINES_SQL = """
WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN '?' WHEN p_partkey % 19 = 0 THEN 'x'
             ELSE p_retailprice::varchar END AS price, CASE WHEN p_partkey % 5 = 1 THEN ' ' ELSE ',' END AS sep, *
           FROM part),
lines AS (SELECT id, CASE WHEN p_partkey % 23 = 0 THEN ''
            WHEN p_partkey % 29 = 0 THEN concat_ws(sep, p_partkey, p_size, price)
            WHEN p_partkey % 31 = 0 THEN concat_ws(sep, p_partkey, p_size, price, p_brand, p_type) || sep
            ELSE concat_ws(sep, p_partkey, p_size, price, p_brand, p_type) END AS value FROM f),
tok AS (SELECT id, value, regexp_split_to_array(regexp_replace(value, '[, ]+$', ''), '[, ]') AS k FROM lines),
st AS (SELECT *, CASE WHEN value = '' THEN 'empty' WHEN len(k) <> 5 THEN 'arity'
         WHEN k[2] = '?' OR k[3] = '?' OR k[4] = '?' OR k[5] = '?' THEN 'missing'
         WHEN try_cast(k[2] AS double) IS NULL OR try_cast(k[3] AS double) IS NULL THEN 'malformed'
         ELSE 'ok' END AS status FROM tok)
"""
FIELDS_SQL = "k[2]::double AS p_size, k[3]::double AS p_retailprice, k[4] AS p_brand, k[5] AS p_type"


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    price = F.when(key % 17 == 0, "?").when(key % 19 == 0, "x").otherwise(F.col("p_retailprice").cast("string"))
    joined = {
        sep: F.concat_ws(sep, "p_partkey", "p_size", price, "p_brand", "p_type") for sep in (",", " ")
    }
    short = {sep: F.concat_ws(sep, "p_partkey", "p_size", price) for sep in (",", " ")}

    def line(sep):
        return (
            F.when(key % 23 == 0, "")
            .when(key % 29 == 0, short[sep])
            .when(key % 31 == 0, F.concat(joined[sep], F.lit(sep)))
            .otherwise(joined[sep])
        )

    value = F.when(key % 5 == 1, line(" ")).otherwise(line(","))
    return table(spark, sf_dir, "part").select(key.alias("id"), value.alias("value"))


# ---- sources ---------------------------------------------------------------------------------------------------


@query(LINES_SQL + f"SELECT id, {FIELDS_SQL} FROM st WHERE status = 'ok'")
def src_parse_lines(spark, sf_dir):
    return text.parse_lines(part_lines(spark, sf_dir), PART)


@query(LINES_SQL + f"SELECT {FIELDS_SQL} FROM st WHERE status = 'ok'")
def src_text_files(spark, sf_dir):
    path = f"{scratch_root(spark)}/lines-{uuid.uuid4().hex}"
    part_lines(spark, sf_dir).select("value").write.text(path)
    return text.parse_lines(text.read_lines(spark, path), PART).drop("input_file", "line", "id")


@query(
    LINES_SQL
    + """, d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT k[4] v FROM st WHERE status='ok')),
l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT k[5] v FROM st WHERE status='ok'))
SELECT id, k[2]::double AS f1, k[3]::double AS f2, d.c::double AS f3, l.c::int AS label_code
FROM st JOIN d ON k[4] = d.v JOIN l ON k[5] = l.v WHERE status = 'ok'"""
)
def convert_instances(spark, sf_dir):
    rows = text.parse_lines(part_lines(spark, sf_dir), PART)
    dictionary = E.build_dictionary(rows, PART.categorical)
    coded = E.encode(rows, dictionary, {"p_brand": "brand_code", "p_type": "label_code"})
    vector = A.assemble(coded, ["p_size", "p_retailprice", "brand_code"])
    f = F.col("features")
    return vector.select("id", f[0].alias("f1"), f[1].alias("f2"), f[2].alias("f3"), "label_code")


@query("SELECT p_partkey, p_size::double AS p_size, p_retailprice, p_brand, p_type FROM part")
def src_apply_roles(spark, sf_dir):
    return A.apply_roles(table(spark, sf_dir, "part"), PART, "p_partkey")


@query("SELECT p_type AS label, (row_number() OVER (ORDER BY p_type DESC) - 1)::int AS code "
       "FROM (SELECT DISTINCT p_type FROM part)")  # fmt: skip
def src_header_labels(spark, sf_dir):
    return text.read_header(header_lines(table(spark, sf_dir, "part"), "p_type"))


def header_lines(df: DataFrame, label: str) -> DataFrame:
    """Header text of a table: its classes in descending order, after an ordinary attribute line."""
    classes = df.select(label).distinct().agg(F.sort_array(F.collect_list(label), asc=False).alias("c"))
    listed = F.concat(F.lit("@attribute Class {"), F.array_join("c", ", "), F.lit("}"))
    return classes.select(F.explode(F.array(F.lit("@attribute size real [1, 50]"), listed)).alias("value"))


PROFILE_SQL = (
    LINES_SQL
    + """, ok AS (SELECT * FROM st WHERE status = 'ok'),
v AS (SELECT DISTINCT 'p_brand' AS name, k[4] AS value FROM ok UNION ALL SELECT DISTINCT 'p_type', k[5] FROM ok),
a(attr, name, role) AS (VALUES (0,'p_partkey','I'),(1,'p_size','N'),(2,'p_retailprice','N'),(3,'p_brand','C'),(4,'p_type','L'))
SELECT attr, a.name, role, value, CASE WHEN value IS NOT NULL THEN
  (row_number() OVER (PARTITION BY a.name ORDER BY value) - 1)::int END AS code, (SELECT count(*) FROM ok) AS n_rows
FROM a LEFT JOIN v ON a.name = v.name"""
)


@query(PROFILE_SQL)
def profile_dataset(spark, sf_dir):
    return R.profile_table(text.parse_lines(part_lines(spark, sf_dir), PART), PART)


@query(PROFILE_SQL)
def profile_roundtrip(spark, sf_dir):
    path = f"{scratch_root(spark)}/profile-{uuid.uuid4().hex}"
    store.save_table(profile_dataset(spark, sf_dir), path)
    return store.load_table(spark, path)


LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


@query(f"SELECT row_number() OVER (ORDER BY {', '.join(LINEITEM_KEY)}) - 1 AS row_id, l_orderkey, l_partkey, "
       "l_quantity, l_extendedprice FROM lineitem")  # fmt: skip
def row_index(spark, sf_dir):
    numbered = with_row_id(table(spark, sf_dir, "lineitem"), LINEITEM_KEY)
    return numbered.select("row_id", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query(LINES_SQL + "SELECT id, value FROM st WHERE status <> 'empty'")
def filter_empty(spark, sf_dir):
    return text.drop_empty(part_lines(spark, sf_dir))


@query(LINES_SQL + "SELECT id, value, status FROM st WHERE status NOT IN ('empty', 'arity', 'missing')")
def filter_missing(spark, sf_dir):
    rows = text.with_status(part_lines(spark, sf_dir), PART).drop("tokens")
    return rows.where(~F.col("status").isin("empty", "arity", "missing"))


@query(LINES_SQL + "SELECT id, value FROM st WHERE status = 'malformed'")
def filter_malformed(spark, sf_dir):
    rows = text.with_status(part_lines(spark, sf_dir), PART)
    return rows.where("status = 'malformed'").select("id", "value")


@query(LINES_SQL + """SELECT id, status, CASE WHEN k[2] <> '?' THEN try_cast(k[2] AS double) END AS p_size,
CASE WHEN k[3] <> '?' THEN try_cast(k[3] AS double) END AS p_retailprice,
k[4] AS p_brand, k[5] AS p_type FROM st WHERE status <> 'empty'""")  # fmt: skip
def filter_arity(spark, sf_dir):
    return text.parse_lines(part_lines(spark, sf_dir), PART, mode="permissive", keep_missing=True)


@query("SELECT p_name, p_size, p_retailprice, p_brand, p_type FROM part")
def drop_ignored(spark, sf_dir):
    return A.drop_ignored(table(spark, sf_dir, "part"), PART)


# ---- predicates and look-ups -----------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 7")
def filter_eq(spark, sf_dir):
    return table(spark, sf_dir, "part").where(P.equals("p_size", 7)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice < 950")
def filter_lt(spark, sf_dir):
    return table(spark, sf_dir, "part").where(P.lesser("p_retailprice", 950)).select("p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000")
def filter_ge(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where(P.greater_or_equal("o_totalprice", 250000))
    return found.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders "
       "WHERE o_orderstatus = 'F' AND o_totalprice < 300000 AND o_totalprice >= 1000")  # fmt: skip
def subset_conjunction(spark, sf_dir):
    condition = (
        P.equals("o_orderstatus", "F") & P.lesser("o_totalprice", 300000) & P.greater_or_equal("o_totalprice", 1000)
    )
    return P.subset(table(spark, sf_dir, "orders"), condition).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders o WHERE EXISTS (SELECT 1 FROM
(SELECT o_orderkey + 1 AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders)
WHERE k = o.o_orderkey AND s = o.o_orderstatus AND p = o.o_orderpriority)""")  # fmt: skip
def contains_rows(spark, sf_dir):
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf_dir, "orders").select(columns)
    shifted = orders.withColumn("o_orderkey", F.col("o_orderkey") + 1)
    return P.contains_rows(shifted, orders, columns)


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice "
       "FROM orders QUALIFY row_id = 100")  # fmt: skip
def row_at(spark, sf_dir):
    found = P.row_at(table(spark, sf_dir, "orders"), 100, ["o_totalprice", "o_orderkey"])
    return found.select("row_id", "o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n_rows, count(*) = 0 AS is_empty FROM lineitem")
def table_size(spark, sf_dir):
    return P.table_size(table(spark, sf_dir, "lineitem"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS f1, l_extendedprice AS f2, l_discount AS f3, l_tax AS f4 "
       "FROM lineitem")  # fmt: skip
def assemble_features(spark, sf_dir):
    inputs = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = A.assemble(table(spark, sf_dir, "lineitem"), inputs)
    return rows.select("l_orderkey", "l_linenumber", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(4)])


@query("SELECT p_type FROM part")
def extract_labels(spark, sf_dir):
    return A.extract_labels(table(spark, sf_dir, "part"), PART)


@query("SELECT p_partkey, '1' AS feature, p_size::double AS value FROM part UNION ALL "
       "SELECT p_partkey, '2', p_retailprice FROM part")  # fmt: skip
def feature_names_long(spark, sf_dir):
    return A.feature_values(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query("""SELECT 2 AS attr, 'o_orderstatus' AS name, 'C' AS role, count(DISTINCT o_orderstatus) AS n_values,
count(*) AS n_rows FROM orders
UNION ALL SELECT 3, 'o_totalprice', 'N', 0, count(*) FROM orders
UNION ALL SELECT 5, 'o_orderpriority', 'L', count(DISTINCT o_orderpriority), count(*) FROM orders""")  # fmt: skip
def schema_summary(spark, sf_dir):
    return R.schema_summary(table(spark, sf_dir, "orders"), ORDERS)


# ---- dictionaries ----------------------------------------------------------------------------------------------

SEEN_SQL = f"""WITH p AS (SELECT *, {sql_draw(5, "p_partkey")} AS h FROM part),
tr AS (SELECT * FROM p QUALIFY row_number() OVER (ORDER BY h, p_partkey) <= (SELECT count(*) // 100 FROM part)),
d AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::int AS code FROM (SELECT DISTINCT p_brand FROM tr)) """


@query(SEEN_SQL + """SELECT p_partkey, part.p_brand, coalesce(d.code, -1) AS brand_code
FROM part LEFT JOIN d ON part.p_brand = d.p_brand""")  # fmt: skip
def encode_categorical(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    seen, _ = S.random_split(part, "p_partkey", part.count() // 100, seed=5)  # leaves some brands unseen
    coded = E.encode(part, E.build_dictionary(seen, ["p_brand"]), {"p_brand": "brand_code"})
    return coded.select("p_partkey", "p_brand", "brand_code")


LABELS_SQL = "(SELECT label, (row_number() OVER (ORDER BY label) - 1)::int AS code FROM (SELECT DISTINCT {} AS label FROM {}))"
TYPES_SQL = LABELS_SQL.format("p_type", "part")
TYPES_DESC_SQL = TYPES_SQL.replace("ORDER BY label", "ORDER BY label DESC")


@query(f"SELECT label, code, (SELECT count(DISTINCT p_type) FROM part) AS n_labels FROM {TYPES_SQL}")
def label_dictionary(spark, sf_dir):
    dictionary = E.build_dictionary(table(spark, sf_dir, "part"), ["p_type"])
    sizes = E.number_of_values(dictionary).withColumnRenamed("n_values", "n_labels")
    return dictionary.join(sizes, "name").select(F.col("value").alias("label"), "code", "n_labels")


@query(f"SELECT p_partkey, l.code, p.p_type AS label FROM part p JOIN {TYPES_SQL} l ON p.p_type = l.label "
       "UNION ALL SELECT p_partkey, NULL, 'unknown' FROM part WHERE p_size >= 40")  # fmt: skip
def decode_label(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    labels = E.label_dictionary(part, "p_type")
    coded = E.encode_label(part, labels, "p_type", "code").select("p_partkey", F.col("code").cast("double").alias("code"))
    unpredicted = part.where("p_size >= 40").select("p_partkey", F.lit(float("nan")).alias("code"))
    rows = E.decode_label(coded.union(unpredicted), labels, "code")
    code = F.when(~F.isnan("code"), F.col("code").cast("int"))
    return rows.select("p_partkey", code.alias("code"), "label")


@query(f"""SELECT p_partkey, a.code AS data_code, b.code AS header_code FROM part p
JOIN {TYPES_SQL} a ON p.p_type = a.label JOIN {TYPES_DESC_SQL} b ON p.p_type = b.label""")  # fmt: skip
def recode_label(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    data_labels = E.label_dictionary(part, "p_type")
    header_labels = text.read_header(header_lines(part, "p_type"))
    coded = E.encode_label(part, data_labels, "p_type", "data_code").select("p_partkey", "data_code")
    return E.recode(coded, data_labels, header_labels, "data_code", "header_code")


@query(f"SELECT p_partkey, p_type, l.code AS label_code FROM part p JOIN {TYPES_SQL} l ON p.p_type = l.label")
def dictionary_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return E.encode_label(part, E.label_dictionary(part, "p_type"), "p_type")


# ---- aggregates ------------------------------------------------------------------------------------------------


@query("""SELECT l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderpriority AS label FROM orders UNION ALL SELECT '9-NONE') l LEFT JOIN
(SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL) c
ON l.label = c.label""")  # fmt: skip
def label_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    labels = E.label_dictionary(orders, "o_orderpriority").select("label")
    labels = labels.unionByName(spark.createDataFrame([("9-NONE",)], "label string"))  # a class without rows
    return R.label_counts(orders, "o_orderpriority", labels)


@query("SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def majority_label(spark, sf_dir):
    return R.majority_label(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(f"""SELECT label, n FROM (SELECT label, count(*) AS n FROM (SELECT quality::varchar AS label FROM labels
UNION ALL SELECT (1 - quality)::varchar FROM labels) GROUP BY label)
ORDER BY n DESC, {sql_draw(3, "label")}, label LIMIT 1""")  # fmt: skip
def majority_label_seeded(spark, sf_dir):
    q = table(spark, sf_dir, "labels")
    both = q.select(F.col("quality").cast("string").alias("c")).union(
        q.select((1 - F.col("quality")).cast("string").alias("c"))
    )
    return R.majority_label(both, "c", tie_seed=3)


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::int AS top FROM embeddings")
def argmax_array(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.argmax_index("embedding").alias("top"))


@query("SELECT DISTINCT l_discount + 0::double AS l_discount FROM lineitem")
def distinct_values(spark, sf_dir):
    return R.distinct_values(table(spark, sf_dir, "lineitem"), "l_discount")


@query("SELECT min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value FROM lineitem")
def attr_min_max(spark, sf_dir):
    return R.min_max(table(spark, sf_dir, "lineitem"), "l_extendedprice")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT {i} AS attr, '{c}' AS name, min({c}) + 0::double AS min_value, max({c}) + 0::double "
                          f"AS max_value FROM lineitem" for i, c in enumerate(NUMERIC)))  # fmt: skip
def attr_ranges(spark, sf_dir):
    return R.ranges(table(spark, sf_dir, "lineitem"), NUMERIC)


@query("SELECT l_orderkey, min(l_linestatus) = max(l_linestatus) AND min(l_linenumber) = max(l_linenumber) "
       "AS is_identical FROM lineitem GROUP BY l_orderkey")  # fmt: skip
def is_identical(spark, sf_dir):
    return R.is_identical(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber"], ["l_orderkey"])


@query("SELECT l_partkey, min(l_returnflag) = max(l_returnflag) AS is_identical_label FROM lineitem GROUP BY l_partkey")
def is_identical_label(spark, sf_dir):
    return R.is_identical_label(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_partkey"])


# ---- arrays ----------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) AS total FROM embeddings")
def array_sum(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.array_sum("embedding"), 6).alias("total"))


def _line_vectors(spark, sf_dir):
    a = F.array("l_quantity", "l_extendedprice").alias("a")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", a, F.array("l_discount", "l_tax").alias("b")
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_discount AS v1, l_extendedprice + l_tax AS v2 FROM lineitem")
def array_add(spark, sf_dir):
    v = V.array_add("a", "b")
    rows = _line_vectors(spark, sf_dir).select("l_orderkey", "l_linenumber", v.alias("v"))
    return rows.select("l_orderkey", "l_linenumber", F.col("v")[0].alias("v1"), F.col("v")[1].alias("v2"))


@query("SELECT l_orderkey, l_linenumber, l_quantity - l_discount AS v1, l_extendedprice - l_tax AS v2 FROM lineitem")
def array_sub(spark, sf_dir):
    v = V.array_sub("a", "b")
    rows = _line_vectors(spark, sf_dir).select("l_orderkey", "l_linenumber", v.alias("v"))
    return rows.select("l_orderkey", "l_linenumber", F.col("v")[0].alias("v1"), F.col("v")[1].alias("v2"))


@query("""SELECT label, pos, round(sum(v), 4) AS total FROM (SELECT label, generate_subscripts(embedding, 1) AS pos,
unnest(embedding)::double AS v FROM embeddings) GROUP BY label, pos""")  # fmt: skip
def vector_sum_by_label(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    summed = R.vector_sum(rows, "label").select("label", F.posexplode("vector_sum").alias("pos", "v"))
    return summed.select("label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("v", 4).alias("total"))


@query("""SELECT p_partkey, (p_size - 25)::double * (p_size - 25) + (p_retailprice - 1000) * (p_retailprice - 1000)
AS dist FROM part""")  # fmt: skip
def squared_distance(spark, sf_dir):
    centre = F.array(F.lit(25.0), F.lit(1000.0))
    point = V.features_of("p_size", "p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", V.squared_distance(point, centre).alias("dist"))


# ---- samples ---------------------------------------------------------------------------------------------------

BAG_SQL = f"""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders),
d AS (SELECT {sql_draw(42, "i")} % (SELECT count(*) FROM orders) AS row_id
      FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i)),
c AS (SELECT row_id, count(*) AS times FROM d GROUP BY row_id) """


@query(BAG_SQL + "SELECT row_id, o_orderkey, o_totalprice FROM r JOIN d USING (row_id)")
def bagging(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.bagging(orders, ["o_orderkey"], seed=42)


@query(BAG_SQL + "SELECT row_id, o_orderkey, o_totalprice, coalesce(times, 0) AS times, times IS NOT NULL AS sampled "
       "FROM r LEFT JOIN c USING (row_id)")  # fmt: skip
def bagging_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.bagging_flags(orders, ["o_orderkey"], seed=42)


@query(BAG_SQL + "SELECT row_id, o_orderkey, o_totalprice FROM r WHERE row_id NOT IN (SELECT row_id FROM d)")
def out_of_bag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.out_of_bag(orders, ["o_orderkey"], seed=42)


SPLIT_SQL = f"""SELECT o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (ORDER BY {sql_draw(42, "o_orderkey")}, o_orderkey) """


@query(SPLIT_SQL + "<= (SELECT count(*) // 3 FROM orders)")
def rsplit_taken(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.random_split(orders, "o_orderkey", orders.count() // 3, seed=42)[0]


@query(SPLIT_SQL + "> (SELECT count(*) // 3 FROM orders)")
def rsplit_rest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.random_split(orders, "o_orderkey", orders.count() // 3, seed=42)[1]
