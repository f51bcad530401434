import numpy as np
import pytest

from nearspark.operators import evaluate as V
from nearspark.operators.roles import Attributes
from nearspark.operators.vote import majority_vote
from nearspark.plans import jobs
from nearspark.sources import store


def table(spark, seed, n):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(size=3)], int(c)) for i, c in enumerate(rng.integers(0, 3, n))]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int")


def expected(train, test, k):
    out = {}
    for qid, qf, actual in test:
        near = sorted((sum((a - b) ** 2 for a, b in zip(tf, qf)), tid, c) for tid, tf, c in train)[:k]
        votes = [c for _, _, c in near]
        out[qid] = (actual, min(set(votes), key=lambda c: (-votes.count(c), c)))
    return out


@pytest.mark.parametrize("k", [1, 4, 9])
@pytest.mark.parametrize("plan", ["broadcast_train", "broadcast_queries", "cells"])
def test_classification(spark, k, plan):
    train, test = table(spark, 1, 200), table(spark, 2, 60)
    got = {r["qid"]: (r["actual"], r["predicted"]) for r in jobs.classify_knn(train, test, k, plan=plan).collect()}
    assert got == expected([tuple(r) for r in train.collect()], [tuple(r) for r in test.collect()], k)


def test_vote_tie_goes_to_the_lowest_class(spark):
    near = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (1, 0), (2, 1)], "qid bigint, label int")
    assert {r["qid"]: (r["predicted"], r["votes"]) for r in majority_vote(near).collect()} == {1: (0, 2), 2: (1, 1)}
    with pytest.raises(ValueError, match="unknown vote"):
        majority_vote(near, vote="weighted")


def test_rows_without_a_vector_stay_unpredicted(spark):
    train = table(spark, 1, 20)
    test = spark.createDataFrame([(5, None, 1)], train.schema)
    assert tuple(jobs.classify_knn(train, test, 3).first()) == (5, 1, None)
    assert tuple(jobs.classify_knn(train, test, 3, missing_class=0).first()) == (5, 1, 0)
    assert tuple(jobs.classify_knn(train.where("false"), table(spark, 2, 1), 3).select("predicted").first()) == (None,)


def test_scoring_on_a_reduced_set(spark, tmp_path):
    train, test = table(spark, 3, 120), table(spark, 4, 30)
    same = jobs.classify_1nn(test, train.withColumnRenamed("id", "pid"))
    got = {r["qid"]: (r["actual"], r["predicted"]) for r in same.collect()}
    assert got == expected([tuple(r) for r in train.collect()], [tuple(r) for r in test.collect()], 1)
    kept = str(tmp_path / "reduced")
    scored = jobs.reduce_then_classify(train.withColumnRenamed("id", "pid"), test, "enn", save_to=kept)
    assert scored.count() == 30 and 0 < store.load_table(spark, kept).count() < 120


def test_run_writes_predictions_and_report(spark, tmp_path):
    out = str(tmp_path / "run")
    found = jobs.run_classification(table(spark, 5, 100), table(spark, 6, 40), 3, [0, 1, 2], out)
    lines = spark.read.csv(f"{out}/predictions_text", header=True, inferSchema=True)
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, found.collect()))
    assert [r["qid"] for r in lines.collect()] == sorted(r["qid"] for r in found.collect())
    matrix = spark.read.csv(f"{out}/report/confusion", header=True, inferSchema=True)
    assert sum(sum(r[c] for c in "012") for r in matrix.collect()) == 40
    assert spark.read.json(f"{out}/report/accuracy").first()["n"] == 40
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        jobs.run_classification(table(spark, 5, 10), table(spark, 6, 4), 3, [0, 1, 2], out)


def predictions(spark, cells):
    rows = [(a, p) for (a, p), n in cells.items() for _ in range(n)]
    return spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(rows)], "qid bigint, actual int, predicted int")


def test_confusion_and_accuracy(spark):
    df = predictions(spark, {(0, 0): 5, (0, 2): 1, (2, 2): 3, (1, 0): 2, (1, None): 1})
    matrix = {r["predicted"]: (r["0"], r["1"], r["2"]) for r in V.confusion_matrix(df, [0, 1, 2]).collect()}
    assert matrix == {0: (5, 2, 0), 1: (0, 0, 0), 2: (1, 0, 3), None: (0, 1, 0)}
    long = {(r["predicted"], r["actual"]): r["n"] for r in V.confusion_long(df, [0, 1, 2]).collect()}
    assert len(long) == 16 and long[0, 1] == 2 and long[1, 1] == 0 and long[None, 1] == 1 and sum(long.values()) == 12
    unlisted = {(r["predicted"], r["actual"]): r["n"] for r in V.confusion_long(df, [0, 1]).collect()}
    assert unlisted[None, None] == 3 and unlisted[None, 0] == 1 and sum(unlisted.values()) == 12
    assert tuple(V.accuracy(df).first()) == (12, 8, 8 / 12)
    assert V.accuracy(df.where("false")).first()["accuracy"] is None
    words = spark.createDataFrame([("Yes", "yes"), ("no", "yes"), ("no", None)], "actual string, predicted string")
    assert tuple(V.accuracy_labels(words).first()) == (3, 1, 1 / 3)


@pytest.mark.parametrize("swap", [False, True])
def test_binary_measures(spark, swap):
    cells = {(0, 0): 30, (0, 1): 10, (1, 1): 6, (1, 0): 4}
    if swap:
        cells = {(1 - a, 1 - p): n for (a, p), n in cells.items()}
    df = predictions(spark, cells)
    auc, gmean = V.binary_auc(df).first(), V.binary_gmean(df).first()
    assert auc["positive"] == gmean["positive"] == (0 if swap else 1)
    assert auc["auc"] == pytest.approx((1 + 0.6 - 0.25) / 2) and gmean["gmean"] == pytest.approx((0.6 * 0.75) ** 0.5)


def test_equal_classes_take_the_lower_code_as_positive(spark):
    assert V.binary_auc(predictions(spark, {(0, 0): 5, (1, 0): 5})).first()["positive"] == 0


def test_predictions_by_file_keep_record_order(spark, tmp_path):
    rows = [(i, f"f{i % 3}", i % 2) for i in range(90)]
    path = str(tmp_path / "by_file")
    store.save_predictions_by_file(spark.createDataFrame(rows, "qid bigint, input_file string, predicted int").repartition(5), path)
    one = spark.read.parquet(f"{path}/input_file=f1")
    assert [r["qid"] for r in one.collect()] == list(range(1, 90, 3))


def test_text_records(spark):
    def lines(*values):
        return spark.createDataFrame(list(enumerate(values)), "id bigint, value string")

    attributes = Attributes.of("N C L")
    labels = spark.createDataFrame([("yes", 0), ("no", 1)], "label string, code int")
    train = lines("0,red,yes", "10,red,no", "0,blue,yes", "?,blue,no", "10,blue,no")
    test = lines("1,red,yes", "9,blue,no", "?,red,no", "10,?,yes", "8,green,no")
    got = {r["qid"]: (r["actual"], r["predicted"]) for r in jobs.classify_text(train, test, attributes, labels, 1).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, None), 3: (0, None), 4: (1, 1)}
    assert jobs.classify_text(train, test, attributes, labels, 1, drop_missing=True).count() == 3
    no_categories = jobs.classify_text(lines("1,a,yes", "5,b,no"), lines("4,c,yes"), Attributes.of("N I L"), labels, 1)
    assert tuple(no_categories.first()) == (0, 0, 1)
