"""The split plans give what a plain window gives, hot groups included."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialwright.operators.scan import join_runs, longest_run, number_rows, prefix_scan
from trialwright.operators.stats import describe_scores, exact_quantiles
from trialwright.operators.stop import stop_at_plateau
from trialwright.operators.trials import plateau_lengths, rank_trials, running_best, union_trials


@pytest.fixture(scope="module")
def skewed(spark):
    """One run with most of the rows, a few short ones, repeated scores, some of them missing."""
    rng = random.Random(3)
    rows = []
    for run, n in ((1, 400), (2, 37), (3, 1), (4, 60)):
        for i in range(1, n + 1):
            rows.append((run, i, None if rng.random() < 0.1 else float(rng.randint(0, 30)), rng.random()))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "run long, iter long, score double, noise double").repartition(5)


def test_number_rows_small_records_the_bound(skewed):
    numbered = number_rows(skewed, ["run"], ["noise"], "n")
    assert longest_run(numbered, "n", ["run"]) == 400
    assert longest_run(numbered, "n", ["run", "score"]) == 400
    assert longest_run(numbered, "n", ["score"]) is None
    assert longest_run(numbered.where("run > 1").select("run", "n"), "n", ["run"]) == 400


@pytest.mark.parametrize("keys", [["run"], []])
def test_number_rows_split_equals_window(skewed, rows, keys):
    expected = skewed.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("noise")).cast("long"))
    split = number_rows(skewed, keys, ["noise"], "n", task_rows=50)
    assert longest_run(split, "n", keys) is None
    assert rows(split, "noise", "n") == rows(expected, "noise", "n")


def test_number_rows_divides_the_hot_group(skewed):
    split = number_rows(skewed, ["run"], ["noise"], "n", task_rows=50)
    placed = [c for c in split.inputFiles()]
    assert len(placed) > 8


def test_number_rows_keeps_null_groups(spark, rows):
    df = spark.createDataFrame([(None, i) for i in range(100)] + [(1, i) for i in range(30)], "run long, x long")
    split = number_rows(df, ["run"], ["x"], "n", task_rows=10)
    assert rows(split.where("run IS NULL"), "x", "n") == [(i, i + 1) for i in range(100)]


def test_prefix_scan_split_equals_window(skewed, rows):
    w = W.partitionBy("run").orderBy("iter").rowsBetween(W.unboundedPreceding, 0)
    expected = skewed.withColumns({"best": F.max("score").over(w), "pos": F.count("score").over(w), "s": F.sum("noise").over(w)})
    got = prefix_scan(skewed, ["run"], {"best": ("max", "score"), "pos": ("count", "score"), "s": ("sum", "noise")}, task_rows=16)
    for c in ("best", "pos"):
        key = lambda df: sorted((r["run"], r["iter"], str(r[c])) for r in df.collect())  # noqa: B023, E731
        assert key(got) == key(expected)
    exact = {(r["run"], r["iter"]): r["s"] for r in expected.collect()}
    assert all(r["s"] == pytest.approx(exact[r["run"], r["iter"]]) for r in got.collect())


def test_split_scan_shuffles_by_piece(skewed):
    plan = running_best(skewed, ["run"], task_rows=16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in plan and "__piece" in plan


def shuffles_of(df, column):
    """How many exchanges by key move rows that have ``column``."""
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(StringIO()) as out:
        df.explain("formatted")
    return len(re.findall(rf"Exchange\nInput \[\d+\]: \[[^\]]*\b{column}#[^\]]*\]\nArguments: hashpartitioning", out.getvalue()))


def test_split_stop_shuffles_the_rows_once(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles_of(stop_at_plateau(skewed, 5, ["run"], task_rows=16), "noise") == 1
        assert shuffles_of(running_best(skewed, ["run"], task_rows=16), "noise") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_stop_with_null_runs(spark, rows):
    scores = {None: [1, 3, 2, 2, 2, 9], 1: [5, 4, None, 4, 4], 2: [None, None]}
    log = spark.createDataFrame([(r, i, None if s is None else float(s)) for r, found in scores.items() for i, s in enumerate(found, 1)],
                                "run long, iter long, score double")
    show = lambda df: sorted(map(str, df.select("run", "iter", "best", "pos").collect()))
    split = stop_at_plateau(log, 3, ["run"], task_rows=2)
    assert split.columns == [*log.columns, "best", "pos"]
    assert show(split) == show(stop_at_plateau(number_rows(log, ["run"], ["iter"], "iter"), 3, ["run"]))
    assert split.where("run IS NULL").count() == 4 and split.where("run = 2").count() == 2


def test_plateaus_do_not_depend_on_the_split(skewed, rows):
    assert rows(plateau_lengths(skewed, ["run"], task_rows=16)) == rows(plateau_lengths(skewed, ["run"]))


def test_rank_split_equals_rank(skewed, rows):
    whole = rank_trials(skewed, ["run"])
    split = rank_trials(skewed, ["run"], task_rows=25)
    assert rows(split, "run", "iter", "rank") == rows(whole, "run", "iter", "rank")


def test_quantiles_split(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "x", (0.0, 0.25, 0.503, 1.0), task_rows=10).collect()}
    assert got == pytest.approx({0.0: 0.0, 0.25: 25.0, 0.503: 50.3, 1.0: 100.0})
    row = describe_scores(df, "x", task_rows=10).first()
    assert (row["count"], row["min"], row["q50"], row["max"]) == (101, 0.0, 50.0, 100.0)


def test_one_value_in_most_rows(spark):
    """Nine of ten rows share a value: quantiles and ranks come from one row per value, and no task gets the whole tie."""
    df = spark.range(4000).select((F.col("id") % 4).alias("run"), F.col("id").alias("iter"),
                                  F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("score")).repartition(7)
    values = sorted(r[0] for r in df.select("score").collect())
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "score", (0.05, 0.5, 0.95), task_rows=50).collect()}
    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in (0.05, 0.5, 0.95)})
    ranked = rank_trials(df, [], task_rows=100)
    w = W.orderBy(F.desc("score"))
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, df.withColumn("rank", F.rank().over(w).cast("long")).collect()))
    # The tie is joined by broadcast where it lies; only rows of rare scores are dealt by score.
    tied = ranked.where("score = 5.0")
    sizes = tied.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 0.4 * tied.count()


def test_running_best_is_monotone_and_reaches_the_maximum(skewed):
    w = W.partitionBy("run").orderBy("iter")
    best = running_best(skewed, ["run"]).withColumn("before", F.lag("best").over(w))
    assert best.where("best < before").count() == 0
    assert best.groupBy("run").agg(F.max("best").alias("b"), F.max("score").alias("s")).where("NOT b <=> s").count() == 0


def test_union_adds_up_the_bounds(skewed):
    a = number_rows(skewed, ["run"], ["noise"], "iter")
    assert longest_run(union_trials(a, a), "iter", ["run"]) == 800
    assert longest_run(union_trials(a, skewed), "iter", ["run"]) is None


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_runs_split_equals_join(skewed, how):
    per_run = skewed.where("run < 3").groupBy("run").agg(F.max("score").alias("top"))
    show = lambda df: sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    assert show(join_runs(skewed, per_run, ["run"], how, task_rows=16)) == show(skewed.join(per_run, "run", how))
