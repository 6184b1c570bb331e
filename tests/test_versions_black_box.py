"""Logs replaced in one step, and objectives that are any function."""

import os
import time

import pytest
from pyspark.sql import functions as F

from trialwright.operators import space
from trialwright.plans import black_box, search
from trialwright.session import scratch_path
from trialwright.sources import records, trials, versions


@pytest.fixture
def steps(spark):
    return spark.createDataFrame([(r, i, float(r * 100 + i)) for r in range(4) for i in range(1, 11)], "run long, iter long, score double").repartition(4)


def test_replace_and_append(spark, steps, rows):
    path = scratch_path(spark, "log")
    with pytest.raises(FileNotFoundError):
        versions.read_log(spark, path)
    assert versions.replace_log(steps, path) == 1
    assert versions.append_log(steps.withColumn("run", F.col("run") + 10).withColumn("more", F.lit(1)), path) == 2
    assert rows(versions.read_log(spark, path)) == sorted(rows(steps) + [(r + 10, i, s) for r, i, s in rows(steps)])
    assert rows(versions.read_log(spark, path, 1)) == rows(steps)
    assert versions.rewrite_log(spark, path, lambda log: log.where("run > 9"), by=["run"]) == 3
    assert versions.read_log(spark, path).count() == 40 and versions.versions(spark, path) == [1, 2, 3]
    assert versions.drop_old_versions(spark, path) == 2
    assert versions.versions(spark, path) == [3] and versions.read_log(spark, path).where("run = 12").count() == 10
    versions.rewrite_log(spark, path, lambda log: log.where("run < 0"))
    assert versions.read_log(spark, path).columns == ["run", "iter", "score"] and versions.read_log(spark, path).count() == 0


def test_a_job_that_breaks_half_way_changes_nothing(spark, steps, rows):
    path = scratch_path(spark, "log")
    versions.replace_log(steps.withColumn("file_run", F.col("run") + 50), path)
    before = rows(versions.read_log(spark, path))
    with pytest.raises(Exception, match="lost"):
        trials.rewrite_runs(spark, path, F.when(F.col("iter") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("file_run")))
    assert rows(versions.read_log(spark, path)) == before and versions.versions(spark, path) == [1]
    trials.rewrite_runs(spark, path)
    assert {r[0] for r in rows(versions.read_log(spark, path), "run")} == {50, 51, 52, 53}


def test_two_writers_from_one_version(spark, steps):
    path = scratch_path(spark, "log")
    versions.replace_log(steps, path)

    def meanwhile(log):
        versions.append_log(steps, path)
        return log.where("run = 1")

    with pytest.raises(versions.LogChanged):
        versions.rewrite_log(spark, path, meanwhile)
    assert versions.read_log(spark, path).count() == 80


def test_a_resumed_part_is_numbered_on(spark, rows):
    path = scratch_path(spark, "log")
    first = spark.createDataFrame([(None, 1, 0.1), (None, 2, 0.2), (1, 1, 0.3)], "run long, iter long, score double")
    versions.replace_log(first, path)
    records.append_event_log(first, path)
    assert sorted(map(str, versions.read_log(spark, path).collect())) == sorted(map(str, [
        *first.collect(), *first.withColumn("iter", F.col("iter") + F.when(F.col("run").isNull(), 2).otherwise(1)).collect()]))


def test_raising_slow_and_dying_candidates(spark):
    def fn(x):
        if x == 1:
            raise ValueError("no luck")
        if x == 2:
            time.sleep(60)
        if x == 3:
            os._exit(3)
        return float("nan") if x == 4 else x * 10

    path = scratch_path(spark, "results")
    cand = spark.createDataFrame([(i, float(i % 7)) for i in range(9)], "trial_id long, x double")
    start = time.perf_counter()
    got = {r["trial_id"]: (r["score"], r["error"]) for r in black_box.function_objective(fn, path, seconds=1.5, retries=1, parallel=4)(cand).collect()}
    assert time.perf_counter() - start < 50
    assert [got[i][0] for i in range(9)] == [0.0, None, None, None, None, 50.0, 60.0, 0.0, None]
    assert "no luck" in got[1][1] and "no result after" in got[2][1] and "ended" in got[3][1] and "not a number" in got[4][1]
    kept = {r["x"]: r for r in spark.read.parquet(path).collect()}
    assert len(kept) == 7 and kept[1.0]["attempts"] == 2 and kept[5.0]["attempts"] == 1 and kept[2.0]["seconds"] > 2.9


def test_resumed_search_evaluates_only_what_is_new(spark):
    path, calls = scratch_path(spark, "results"), scratch_path(spark, "calls")
    os.makedirs(calls)

    def fn(x):
        open(f"{calls}/{x}-{time.time_ns()}", "w").close()
        return 1 - (x - 0.7) ** 2

    points = [space.Param("x", "choice", values=(0.1, 0.4, 0.7, 0.9))]
    objective = black_box.function_objective(fn, path, 30, 0)
    first = search.search_stage(spark, objective, search.Stage(points, 2, "distinct"), seed=1)
    again = search.search_stage(spark, objective, search.Stage(points, 4, "distinct"), seed=1)
    assert search.winner(again, ["x"]) == ({"x": 0.7}, 1.0) and first.count() == 2
    assert len(os.listdir(calls)) == 4


def test_each_candidate_is_a_task(spark):
    cand = spark.createDataFrame([(i, float(i)) for i in range(12)], "trial_id long, x double")
    out = black_box.evaluate_each(cand, lambda x: x, ["x"], 30, 0)
    assert out.rdd.getNumPartitions() == 12
    assert sorted(r["score"] for r in out.collect()) == [float(i) for i in range(12)]
