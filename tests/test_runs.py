"""Searches of many runs against one plain loop per run."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialwright.operators import boost, evaluate, space
from trialwright.plans import runs, search

POINTS = [space.Param("x", "int", 0, 50), space.Param("y", "int", 0, 5)]
LATER = [space.Param("z", "int", 0, 20)]


def score_of(p):
    if (p["x"] + p["y"]) % 7 == 0:
        return None
    return float((int(p["x"]) * 37 + int(p["y"]) * 11 + int(p.get("z", 0)) * 5) % 101)


def objective(candidates):
    total = sum((F.col(c) * k for c, k in (("x", 37), ("y", 11), ("z", 5)) if c in candidates.columns), F.lit(0))
    scored = candidates.withColumn("score", F.when((F.col("x") + F.col("y")) % 7 != 0, (total % 101).cast("double")))
    return scored.where("score IS NOT NULL OR trial_id % 2 = 0")  # some failed trials have no row at all


def draws(spark, stage_space, table, seed):
    drawn = space.random_candidates(spark, stage_space, 400, seed, runs=table).collect()
    return {(r["run"], r["trial_id"]): {p.name: r[p.name] for p in stage_space} for r in drawn}


def plain(drawn, names, first, budget, n, rule):
    """{run: [(stage, iter, params, score)]} and the final parameters."""
    out, finals = {}, {}
    for run in names:
        frozen, used, length, rows = {}, 0, first, []
        for i, of in enumerate(drawn, 1):
            trials, best, held = [], None, 0
            for t in range(length):
                params = {**frozen, **of[run, t]}
                s = score_of(params)
                trials.append((params, s))
                if s is not None:
                    if best is None or s > best[0]:
                        best, held = (s, t), 0
                    else:
                        held += 1
                    if rule == "held" and held >= n:
                        break
            if rule == "best" and best:
                trials = trials[:best[1] + n]
            rows += [(i, used + t + 1, params, s) for t, (params, s) in enumerate(trials)]
            if best:
                frozen = trials[best[1]][0]
            used += len(trials)
            length = round((budget - used) / max(len(drawn) - i, 1))
        out[run], finals[run] = rows, frozen
    return out, finals


@pytest.mark.parametrize("rule, batch", [("held", 4), ("held", 100), ("best", 7)])
def test_against_loops(spark, rule, batch):
    names = [None, 1, 2, 3, 5, 8]
    table = spark.createDataFrame([(r,) for r in names], "run long")
    limit = {"max_no_improve": 5} if rule == "held" else {"global_best": 5}
    stages = [runs.RunStage(s, batch=batch, **limit) for s in (POINTS, LATER, LATER)]
    result = runs.search_runs(table, objective, stages, 24, 61, seed=2)
    drawn = [draws(spark, s, table, 2 + i) for i, s in enumerate((POINTS, LATER, LATER), 1)]
    expected, finals = plain(drawn, names, 24, 61, 5, rule)
    got = {}
    for r in result.log.collect():
        got.setdefault(r["run"], []).append((r["stage"], r["iter"], r["params"], r["score"]))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == expected
    assert len({len(v) for v in got.values()}) > 1
    for r in result.runs.collect():
        assert r["params"] == finals[r["run"]]
        assert r["trials"] == {i: sum(x[0] == i for x in expected[r["run"]]) for i in (1, 2, 3)}
        assert r["best"] == max(x[3] for x in expected[r["run"]] if x[3] is not None)


def test_budgets_are_dealt_by_rows(spark):
    """One run with nearly all candidates: they come from many tasks."""
    table = spark.createDataFrame([(1, 40_000), (2, 3), (3, 0)], "run long, budget long")
    dealt = runs.deal(table, F.lit(0), F.col("budget"), rows=100)
    assert dealt.groupBy("run").agg(F.count("*"), F.min("trial_id"), F.max("trial_id"), F.countDistinct("trial_id")).orderBy("run").collect() == [
        (1, 40_000, 0, 39_999, 40_000), (2, 3, 0, 2, 3)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        largest = runs.deal(table, F.lit(0), F.col("budget"), rows=100).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert largest < 15_000
    shifted = runs.deal(table.where("run = 2"), F.lit(150), F.lit(320), rows=100)
    assert sorted(r["trial_id"] for r in shifted.collect()) == list(range(150, 320))


@pytest.mark.parametrize("mode", ["ei", "tpe"])
def test_model_based_runs_home_in(spark, mode):
    """Each run has its own peak."""
    table = spark.createDataFrame([(2,), (8,)], "run long")
    peak = lambda c: c.withColumn("score", 1 - F.pow(F.col("x") - F.col("run") / 10, 2))
    stage = runs.RunStage([space.Param("x", "float", 0.0, 1.0)], mode, batch=4, initial=4, pool=60)
    got = runs.search_runs(table, peak, [stage], 16, 16, seed=1).log.toPandas()
    got["x"] = got["params"].map(lambda p: p["x"])
    for run in (2, 8):
        mine = got[got["run"] == run].sort_values("iter")
        assert list(mine["iter"]) == list(range(1, 17)) and mine["x"].nunique() == 16
        off = (mine["x"] - run / 10).abs()
        assert off[mine["iter"] > 4].median() < max(0.12, off[mine["iter"] <= 4].median())


def test_small_space_runs_out(spark):
    table = spark.createDataFrame([(1,), (2,)], "run long")
    few = [space.Param("x", "choice", values=(1.0, 2.0, 3.0))]
    stage = runs.RunStage(few, "tpe", batch=2, initial=2, pool=40)
    result = runs.search_runs(table, lambda c: c.withColumn("score", F.col("x")), [stage], 30, 30)
    assert all(len(set(r)) == 3 for r in result.log.groupBy("run").agg(F.collect_list(F.col("params")["x"]).alias("x")).toPandas()["x"])
    assert {r["params"]["x"] for r in result.runs.collect()} == {3.0}
    with pytest.raises(ValueError):
        runs.search_runs(table, lambda c: c, [stage], 0, 0)


def test_booster_tunes_runs_together(spark):
    draw = random.Random(0)
    pdf = pd.DataFrame({"id": range(300), "a": [draw.random() for _ in range(300)]})
    pdf["label"] = (pdf["a"] > 0.4) * 3.0 + (pdf["a"] > 0.8)
    data = boost.bin_table(evaluate.assign_folds(spark.createDataFrame(pdf), 2, ["id"]), ["a"], "label", ["id"], bins=8)
    table = spark.createDataFrame([(1,), (2,)], "run long")
    cv = runs.across_runs(search.cv_objective(data, 2)({"rounds": 2, "eta": 0.5}))
    stages = [runs.RunStage([space.Param("max_depth", "int", 1, 3)], batch=3), runs.RunStage([space.Param("lambda", "float", 0.0, 50.0)], batch=2)]
    result = runs.search_runs(table, cv, stages, 3, 5, carry=["std", "mean_fit_time"])
    rows = result.log.collect()
    assert len(rows) == 10 and all(r["std"] is not None and r["mean_fit_time"] > 0 for r in rows)
    for r in result.runs.collect():
        mine = [x for x in rows if x["run"] == r["run"]]
        assert set(r["params"]) == {"max_depth", "lambda"} and math.isclose(r["best"], max(x["score"] for x in mine))
        first = max((x for x in mine if x["stage"] == 1), key=lambda x: (x["score"], -x["iter"]))
        assert all(x["params"]["max_depth"] == first["params"]["max_depth"] for x in mine if x["stage"] == 2)


def test_metrics_of_a_search_are_kept(spark, tmp_path):
    pdf = pd.DataFrame({"id": range(200), "a": [i / 200 for i in range(200)]})
    pdf["label"] = (pdf["a"] > 0.5) * 1.0
    data = boost.bin_table(evaluate.assign_folds(spark.createDataFrame(pdf), 2, ["id"]), ["a"], "label", ["id"], bins=8)
    path = str(tmp_path / "metrics")
    scored = search.cv_objective(data, 2, pairs_per_pass=2, metrics_path=path)({"rounds": 3, "eta": 0.3})
    log = search.search_stage(spark, scored, search.Stage([space.Param("max_depth", "int", 1, 4)], 3, "distinct", batch=2, max_no_improve=9))
    metrics = spark.read.parquet(path)
    assert metrics.select("trial_id", "fold", "round", "isTest").distinct().count() == 3 * 2 * 3 * 2
    last = metrics.where("metric = 'r2' AND isTest AND round = 3").groupBy("trial_id").agg(F.avg("value").alias("v"), F.max(F.col("params")["max_depth"]).alias("d"))
    both = log.join(last, "trial_id").collect()
    assert len(both) == 3 and all(math.isclose(r["v"], r["score"], abs_tol=1e-9) and r["d"] == r["max_depth"] for r in both)
