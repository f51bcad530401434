import pytest
from pyspark.sql import functions as F

from nearspark.functions import vectors as V
from nearspark.operators import predicates as P
from nearspark.operators import profile as R
from nearspark.operators import sampling as S


@pytest.mark.parametrize("take", [0, 1, 333, 999, 1000, 5000])
def test_random_split_is_exact_and_disjoint(spark, take):
    df = spark.range(1000)
    taken, rest = S.random_split(df, "id", take, seed=1)
    a, b = {r[0] for r in taken.collect()}, {r[0] for r in rest.collect()}
    assert len(a) == min(take, 1000) and not a & b and len(a | b) == 1000
    lowest = sorted((r["d"], r["id"]) for r in df.select("id", V.draw(1, "id").alias("d")).collect())[:take]
    assert a == {i for _, i in lowest}


def test_random_split_narrows_the_draw_in_steps(spark):
    df = spark.range(3000).select(V.draw(9, "id").alias("d"), F.col("id").alias("i"))
    want = sorted(map(tuple, df.collect()))
    for n in (1, 1500, 3000):
        assert tuple(S._nth_draw(df, n, bits=2, small=5)) == want[n - 1]


def test_split_parts_are_plain_filters(spark):
    taken, rest = S.random_split(spark.range(1000), "id", 100, seed=1)
    assert "Exchange" not in taken._jdf.queryExecution().toString() + rest._jdf.queryExecution().toString()


def test_draws_that_are_there_are_not_made_again(spark):
    from nearspark.functions.vectors import draw

    df = spark.range(1000)
    want = [sorted(r["id"] for r in part.collect()) for part in S.random_split(df, "id", 100, seed=1)]
    parts = S.random_split(df.withColumn("d", draw(1, "id")).localCheckpoint(), "id", 100, seed=9, drawn="d")
    assert [sorted(r["id"] for r in part.collect()) for part in parts] == want
    assert all("md5" not in part._jdf.queryExecution().toString() for part in parts)


def test_string_ids_and_seeds(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    a, b = (S.random_split(df, "k", 100, seed=s)[0].orderBy("k").collect() for s in (1, 2))
    assert len(a) == len(b) == 100 and a != b


def test_bagging_draws_n_rows(spark):
    df = spark.range(700).select((F.col("id") * 3).alias("key"))
    bag, oob = S.bagging(df, ["key"], 5), S.out_of_bag(df, ["key"], 5)
    assert bag.count() == 700
    inside, outside = {r["key"] for r in bag.collect()}, {r["key"] for r in oob.collect()}
    assert not inside & outside and len(inside | outside) == 700
    flags = S.bagging_flags(df, ["key"], 5)
    assert flags.agg(F.sum("times")).first()[0] == 700 and flags.where("sampled").count() == len(inside)


def test_bagging_of_an_empty_table(spark):
    assert S.bagging(spark.range(0), ["id"], 1).count() == 0


def test_array_functions(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 5.0], [1.0, 1.0, 1.0]), (2, [-1.0, -2.0, -3.0], [0.0, 0.0, 1.0])],
                               "id int, a array<double>, b array<double>")
    got = df.select(
        V.argmax_index("a").alias("top"), V.array_sum("a").alias("s"), V.array_add("a", "b").alias("p"),
        V.array_sub("a", "b").alias("m"), V.squared_distance("a", "b").alias("d"),
    ).collect()
    assert tuple(got[0]) == (1, 11.0, [2.0, 6.0, 6.0], [0.0, 4.0, 4.0], 32.0)
    assert tuple(got[1]) == (-1, -6.0, [-1.0, -2.0, -2.0], [-1.0, -2.0, -4.0], 21.0)
    assert df.select(V.array_sum(F.array(F.lit(1), F.lit(2)), "bigint")).first()[0] == 3
    drawn = spark.range(200).select(V.argmax_index(F.array(F.lit(2.0), F.lit(1.0), F.lit(2.0)), 7, "id").alias("i"))
    assert {r["i"] for r in drawn.distinct().collect()} == {0, 2}


def test_unequal_lengths_are_an_error(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    for f in (V.array_add, V.array_sub):
        with pytest.raises(Exception, match="arrays differ in length"):
            df.select(f("a", "b")).collect()


def test_vector_sum_and_features(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 4), ("b", 5.0, None)], "l string, x double, y int")
    df = df.withColumn("features", V.features_of("x", "y"))
    assert {r["l"]: r["vector_sum"] for r in R.vector_sum(df, "l").collect()} == {"a": [4.0, 6.0]}
    assert df.where("features IS NULL").count() == 1


def test_contains_and_conditions(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    probes = spark.createDataFrame([(1, "a"), (2, None), (2, "a"), (3, "z")], "k int, v string")
    assert sorted(P.contains_rows(df, probes, ["k", "v"]).collect(), key=str) == sorted(probes.collect()[:2], key=str)
    assert P.subset(df, P.equals("k", 1) & P.greater_or_equal("k", 1) & P.lesser("k", 2)).count() == 2
    assert P.table_size(df.where("false")).first()["is_empty"]
    assert P.row_at(spark.range(10), 3, ["id"]).first()["id"] == 3


def test_majority_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "l string")
    assert tuple(R.majority_label(df, "l").first()) == ("a", 2)
    assert {R.majority_label(df, "l", tie_seed=s).first()["label"] for s in range(8)} == {"a", "b"}
    labels = spark.createDataFrame([("a",), ("z",)], "label string")
    assert {r["label"]: r["n"] for r in R.label_counts(df, "l", labels).collect()} == {"a": 2, "z": 0}


def test_vector_sum_in_one_aggregation(spark, monkeypatch):
    from nearspark.operators import profile

    rows = [("a", [1.0, 2.0, 3.0]), ("a", [0.5, None, 1.0]), ("b", [7.0, 8.0]), ("c", None), (None, [1.0, 1.0, 1.0]), ("d", [])]
    df = spark.createDataFrame(rows, "l string, features array<double>")
    want = {"a": [1.5, 2.0, 4.0], "b": [7.0, 8.0], None: [1.0, 1.0, 1.0]}
    assert {r["l"]: r["vector_sum"] for r in profile.vector_sum(df, "l").collect()} == want
    plan = profile.vector_sum(df, "l", dims=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan and "Join" not in plan
    monkeypatch.setattr(profile, "SUMS_AT_ONCE", 2)
    assert {r["l"]: r["vector_sum"] for r in profile.vector_sum(df, "l").collect()} == want
    with pytest.raises(Exception, match="different lengths"):
        profile.vector_sum(df.union(df.where("l = 'b'").withColumn("l", F.lit("a"))), "l").collect()
    assert profile.vector_sum(df.limit(0), "l").collect() == []


def test_confusion_of_many_classes_is_not_listed_at_the_driver(spark):
    from nearspark.operators.evaluate import confusion_long

    predictions = spark.createDataFrame([(1, 1), (4999, 3), (None, 2), (7000, 0)], "predicted int, actual int")
    cells = confusion_long(predictions, list(range(5000)))
    total = cells.agg(F.count("*"), F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    assert tuple(total) == (5001 * 5001, 4, 4)
    assert sorted(map(str, confusion_long(predictions, []).collect())) == ["Row(predicted=None, actual=None, n=4)"]
