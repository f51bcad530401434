import pytest
from pyspark.sql import functions as F

from nearspark.operators import encode as E
from nearspark.operators import profile as R
from nearspark.operators import roles as A
from nearspark.sources import store, text


@pytest.fixture(scope="module")
def attributes():
    return A.Attributes.of("I N C L")


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line bigint, value string")


def parsed(df):
    return [tuple(r) for r in df.orderBy("line").collect()]


def test_role_descriptions():
    assert A.expand_roles("L 2 C N 4 I C 3 n") == list("LCCNIIIICNNN")
    assert A.expand_roles("n i l") == ["N", "I", "L"]
    for bad in ("N X L", "2 3 N", "0 N", "-1 N"):
        with pytest.raises(ValueError):
            A.expand_roles(bad)


def test_exactly_one_label():
    for bad in ("N N", "L N L"):
        with pytest.raises(ValueError, match="exactly one label"):
            A.Attributes.of(bad)
    with pytest.raises(ValueError, match="names"):
        A.Attributes.of("N L", ["only"])


def test_parse_rules(spark, attributes):
    df = lines(
        spark,
        "x,1.5,red,yes",  # a plain record
        "x 2 blue no",  # blanks separate too
        "",  # empty line
        "?,3,red,yes",  # missing value in an ignored field does not count
        "x,?,red,yes",  # missing value in a kept field
        "x,abc,red,yes",  # bad number
        "x, 4,red,yes",  # two separators make an empty field: wrong arity
        "x,5,red,yes,,",  # separators at the end do not
        "x,6,red,yes\r",  # control characters around a field are trimmed
        "x,7,red",
    )
    assert parsed(text.parse_lines(df, attributes)) == [
        (0, 1.5, "red", "yes"),
        (1, 2.0, "blue", "no"),
        (3, 3.0, "red", "yes"),
        (7, 5.0, "red", "yes"),
        (8, 6.0, "red", "yes"),
    ]
    status = [r["status"] for r in text.with_status(df, attributes).orderBy("line").collect()]
    assert status == ["ok", "ok", "empty", "ok", "missing", "malformed", "arity", "ok", "ok", "arity"]


def test_modes(spark, attributes):
    df = lines(spark, "x,1,red,yes", "x,?,red,yes", "x,abc,red,yes")
    kept = parsed(text.parse_lines(df, attributes, keep_missing=True))
    assert kept == [(0, 1.0, "red", "yes"), (1, None, "red", "yes")]
    flagged = parsed(text.parse_lines(df, attributes, mode="permissive"))
    assert flagged == [(0, "ok", 1.0, "red", "yes"), (2, "malformed", None, "red", "yes")]
    with pytest.raises(Exception, match="bad record"):
        text.parse_lines(df, attributes, mode="failfast").collect()
    good = lines(spark, "x,1,red,yes", "x,?,red,yes")
    assert len(parsed(text.parse_lines(good, attributes, mode="failfast"))) == 1
    with pytest.raises(ValueError, match="unknown mode"):
        text.parse_lines(df, attributes, mode="strict")


def test_regression_label_is_a_number(spark):
    attributes = A.Attributes.of("N L", regression=True)
    assert parsed(text.parse_lines(lines(spark, "1,2.5", "1,high"), attributes)) == [(0, 1.0, 2.5)]


def test_files_and_header(spark, attributes, tmp_path):
    (tmp_path / "a.csv").write_text("x,1,red,yes\n\nx,2,blue,no\n")
    (tmp_path / "b.csv").write_text("x,3,red,yes\n")
    found = text.parse_lines(text.read_lines(spark, str(tmp_path)), attributes)
    assert sorted(map(tuple, found.collect())) == [
        ("a.csv", 0, 0, 1.0, "red", "yes"), ("a.csv", 2, 2, 2.0, "blue", "no"), ("b.csv", 0, 3, 3.0, "red", "yes"),
    ]
    (tmp_path / "h.txt").write_text("@relation r\n@attribute size real [1, 2]\n@attribute CLASS { no, yes ,maybe}\n@data\n")
    labels = text.read_header(spark.read.text(str(tmp_path / "h.txt")))
    assert sorted(map(tuple, labels.collect())) == [("maybe", 2), ("no", 0), ("yes", 1)]


def test_values_of_rejected_rows_do_not_leak(spark, attributes):
    rows = text.parse_lines(lines(spark, "x,1,red,yes", "x,abc,green,no"), attributes)
    dictionary = R.profile_table(rows, attributes).where("value IS NOT NULL")
    assert sorted((r["name"], r["value"]) for r in dictionary.collect()) == [("a2", "red"), ("a3", "yes")]


def test_dictionary_over_many_values_equals_the_small_one(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("a"), (F.col("id") % 7).alias("b"))
    small, large = E.build_dictionary(df, ["a", "b"]), E.build_dictionary(df, ["a", "b"], window_rows=10)
    assert sorted(small.collect()) == sorted(large.collect())


def test_encode_decode(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    coded = E.encode(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), E.build_dictionary(train, ["c"]), {"c": "k"})
    assert {r["c"]: r["k"] for r in coded.collect()} == {"a": 0, "z": -1, None: -1}
    labels = E.label_dictionary(train, "c")
    decoded = E.decode_label(spark.createDataFrame([(1.0,), (float("nan"),)], "code double"), labels, "code")
    assert sorted(r["label"] for r in decoded.collect()) == ["b", "unknown"]
    other = spark.createDataFrame([("b", 0), ("a", 1)], "label string, code int")
    recoded = E.recode(spark.createDataFrame([(0,), (1,)], "k int"), labels, other, "k", "to")
    assert {r["k"]: r["to"] for r in recoded.collect()} == {0: 1, 1: 0}


def test_homogeneity(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "b"), (2, 3.0, "a")], "g int, v double, l string")
    assert {r["g"]: r["is_identical"] for r in R.is_identical(df, ["v", "l"], ["g"]).collect()} == {1: False, 2: True}
    assert R.is_identical(df.where("false"), ["v"]).first()[0] is True
    assert R.is_identical_label(df, "l").first()[0] is False


def test_schema_summary_and_counts(spark):
    attributes = A.Attributes.of("N C L", ["v", "c", "l"])
    df = spark.createDataFrame([(1.0, "x", "a"), (2.0, "y", "a")], "v double, c string, l string")
    got = {r["name"]: (r["role"], r["n_values"], r["n_rows"]) for r in R.schema_summary(df, attributes).collect()}
    assert got == {"v": ("N", 0, 2), "c": ("C", 2, 2), "l": ("L", 1, 2)}


def test_outputs_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "out")
    store.save_table(spark.range(3), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.save_table(spark.range(4), path)
    assert store.load_table(spark, path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.load_table(spark, str(tmp_path / "absent"))


def test_descriptions_and_tables_are_checked(spark, tmp_path):
    for bad in (("a", "L"), ("a", "L", "L")), (("a", "b"), ("L", "X")), (("a", "a"), ("L", "N")), (("a",), ("N",)):
        with pytest.raises(ValueError):
            A.Attributes(tuple(bad[0]), tuple(bad[1]))
    with pytest.raises(ValueError, match="at the end"):
        A.expand_roles("N L 3")
    attributes = A.Attributes.of("N C L", ["x", "c", "y"])
    df = spark.createDataFrame([(1.0, "a", "u"), (2.0, "b", "v")], "x double, c string, y string")
    store.save_description(df, attributes, str(tmp_path / "d"))
    loaded, dictionary, n_rows = store.load_description(spark, str(tmp_path / "d"))
    assert loaded == attributes and n_rows == 2
    R.validate(df, loaded, dictionary)
    with pytest.raises(ValueError, match="not listed"):
        R.validate(df.union(spark.createDataFrame([(1.0, "z", "u")], df.schema)), loaded, dictionary)
    with pytest.raises(ValueError, match="no values"):
        R.validate(df, loaded, dictionary.where("name = 'y'"))
    with pytest.raises(ValueError, match="not in the table"):
        R.validate(df.drop("x"), loaded, dictionary)
