import pytest
from pyspark.sql import functions as F

from trialwright.operators import evaluate, prep, stats, trials


def test_contiguous_folds(spark, rows):
    df = spark.range(13).toDF("k").repartition(4)
    for task_rows in (4, 1000):
        got = evaluate.assign_folds(df, 5, ["k"], contiguous=True, task_rows=task_rows)
        assert [f for _, f in rows(got, "k", "fold")] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_fewer_rows_than_folds(spark, rows):
    got = evaluate.assign_folds(spark.range(2).toDF("k"), 5, ["k"], contiguous=True)
    assert rows(got, "k", "fold") == [(0, 0), (1, 1)]


def test_hash_folds_are_stable_and_even(spark):
    df = spark.range(5000).toDF("k")
    a = {r[0]: r[1] for r in evaluate.assign_folds(df.repartition(7), 5, ["k"]).collect()}
    assert a == {r[0]: r[1] for r in evaluate.assign_folds(df, 5, ["k"]).collect()}
    assert all(abs(list(a.values()).count(f) - 1000) < 150 for f in range(5))


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (4.0, 4.2)], "label double, prediction double")
    mean = 7 / 3
    want = 1 - (0.01 + 0.01 + 0.04) / sum((y - mean) ** 2 for y in (1, 2, 4))
    assert df.agg(evaluate.r2()).first()[0] == pytest.approx(want)
    assert spark.createDataFrame([(1.0, 1.0)], "label double, prediction double").agg(evaluate.r2()).first()[0] is None


def _metrics(spark):
    data = [(1, 0, "r2", 0.5, True), (1, 1, "r2", 0.7, True), (1, 0, "r2", 0.9, False), (2, 0, "r2", 0.6, True),
            (2, 1, "r2", 0.6, True), (3, 0, "r2", 0.1, True), (3, 1, "r2", 0.1, True)]
    return spark.createDataFrame(data, "trial_id long, fold int, metric string, value double, isTest boolean")


def test_fold_summary(spark):
    got = {r["trial_id"]: r for r in evaluate.fold_summary(_metrics(spark)).collect()}
    assert got[1]["score"] == pytest.approx(0.6) and got[1]["std"] == pytest.approx(0.1)
    assert got[1]["splits"] == [0.5, 0.7]
    assert got[3]["rank"] == 3 and {got[1]["rank"], got[2]["rank"]} <= {1, 2}


def test_objective_sql(spark, rows):
    df = _metrics(spark)
    assert [(t, pytest.approx(v)) for t, v in rows(evaluate.objective_sql(df))] == [(1, 0.6), (2, 0.6), (3, 0.1)]
    worst = evaluate.objective_sql(df, "SELECT MIN(value) FROM __THIS__ WHERE isTest")
    assert rows(worst) == [(1, 0.5), (2, 0.6), (3, 0.1)]


def test_train_and_test(spark):
    df = evaluate.train_and_test(spark.createDataFrame([(0,), (1,), (1,)], "fold int"), 2)
    counts = {(r["fold"], r["isTest"]): r["n"] for r in df.groupBy("fold", "isTest").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, True): 1, (0, False): 2, (1, True): 2, (1, False): 1}


def test_one_hot_and_binarize(spark, rows):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0), (None, None)], "c string, x double")
    assert rows(prep.one_hot(df, "c"), "c_a", "c_b") == [(0, 0), (0, 1), (1, 0)]
    assert [r[0] for r in df.select(prep.binarize("x")).collect()] == [0, 1, 1]
    with pytest.raises(ValueError, match="categories"):
        prep.categories(spark.range(50), "id", 10)


def test_cast_rules(spark):
    df = spark.createDataFrame([("1", "true", "2.5")], "comments_a string, h_local_1 string, other string")
    got = prep.cast_columns(df, {"int": "comments_", "boolean": lambda c: c.startswith("h_local_")}, "double")
    assert got.dtypes == [("comments_a", "int"), ("h_local_1", "boolean"), ("other", "double")]
    assert trials.except_columns(df.columns, ["other"], ["h_local_1"]) == ["comments_a"]


def test_label_like_feature_is_kept(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "label_count double, x double, label double")
    assert list(prep.assemble_features(df).first()["features"]) == [1.0, 2.0]


def test_split_shuffle_sentinel(spark):
    df = spark.range(2000).toDF("k")
    train, test = prep.random_split(df, [0.7, 0.3], ["k"], 18)
    assert train.count() + test.count() == 2000 and train.join(test, "k").count() == 0
    assert train.count() == pytest.approx(1400, abs=100)
    order = [r[0] for r in prep.shuffle_rows(df, ["k"], 1).collect()]
    assert order != sorted(order) and order == [r[0] for r in prep.shuffle_rows(df.repartition(9), ["k"], 1).collect()]
    got = prep.missing_sentinel(spark.createDataFrame([(-999.0,), (1.0,)], "x double"), ["x"]).collect()
    assert [r[0] for r in got] == [None, 1.0]


def test_index_labels_by_frequency(spark, rows):
    df = spark.createDataFrame([("b",), ("c",), ("a",), ("c",)], "class string")
    assert rows(prep.index_labels(df, "class").distinct()) == [("a", 1.0), ("b", 2.0), ("c", 0.0)]
    assert prep.split_features_label(df.withColumn("y", F.lit(1))) == (["class"], "y")


def test_null_counts(spark, rows):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert rows(stats.null_counts(df)) == [("a", 1), ("b", 2)]


def test_union_fills_missing_columns(spark, rows):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert sorted(trials.union_trials(a, b).collect(), key=str) == sorted([(1, None), (2, 3)], key=str)
