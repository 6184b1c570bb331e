import json

import pytest
from pyspark.sql import functions as F

from trialwright import schemas
from trialwright.functions.params import parse_params
from trialwright.operators import stop
from trialwright.plans import views
from trialwright.session import scratch_path
from trialwright.sources import features, records, trials
from trialwright.streaming import steps

HEADER = [f.name for f in schemas.TRIAL_LAYOUTS["random_stage_3"].fields]


def _line(iteration, score, run):
    values = {"mean_test_score": score, "iter_num": iteration, "run_number": run, "rank_test_score": 1,
              "experiment_name": "random search for 3 group", "params": "\"{'subsample': 0.5, 'colsample_bytree': 0.75}\"",
              "split0_test_score": 0.1, "split1_test_score": 0.2, "split2_test_score": 0.3}
    return ",".join(str(values.get(c, "")) for c in HEADER)


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "test logs"
    (where / "old").mkdir(parents=True)
    for stop_, run in ((10, 1), (10, 2), (50, 1)):
        text = "\n".join([",".join(HEADER), _line(5, 0.5, 9), _line(6, "NaN", 9)]) + "\n"
        (where / f"GR_S_3_group_with_{stop_}_{run}_house.csv").write_text(text)
    (where / "old" / "GR_S_3_group_with_10_7_house.csv").write_text(",".join(HEADER) + "\n" + _line(1, 0.9, 7) + "\n")
    (where / "scores_info.txt").write_text("{}")
    return str(where)


def test_read_trials(spark, folder, rows):
    log = trials.read_trials(spark, folder, "GR_S_", 10, "random_stage_3")
    assert rows(log, "file_run", "stop", "iter") == [(1, 10, 5), (1, 10, 6), (2, 10, 5), (2, 10, 6)]
    assert log.where("score IS NULL").count() == 2
    row = log.where("iter = 5").first()
    assert row["params"] == {"subsample": 0.5, "colsample_bytree": 0.75} and row["splits"] == [0.1, 0.2, 0.3]
    assert trials.read_trials(spark, folder, "GR_S_", layout="random_stage_3").select("stop").distinct().count() == 2


def test_wrong_layout_is_refused(spark, folder):
    with pytest.raises(Exception, match="(?i)header"):
        trials.read_trials(spark, folder, "GR_S_", 10, "bayes_stage_3").collect()


def test_only_needed_columns_are_read(spark, folder):
    log = trials.read_trials(spark, folder, "GR_S_", 10, "random_stage_3", columns=["iter", "score"])
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "mean_fit_time" not in plan.split("ReadSchema")[1]


def test_rewrite_and_write(spark, folder, rows):
    log = trials.read_trials(spark, folder, "GR_S_", 10, "random_stage_3")
    out = scratch_path(spark, "rewritten")
    trials.rewrite_run_number(log, out)
    back = spark.read.parquet(out).where("run = 2")
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(run" in back._jdf.queryExecution().executedPlan().toString()
    csv = scratch_path(spark, "csv")
    trials.write_trials(log, csv, ["run"], "csv")
    assert spark.read.option("header", True).csv(csv).count() == 4


def test_feature_readers(spark, tmp_path):
    iris = tmp_path / "iris.data"
    iris.write_text("5.1,3.5,1.4,0.2,setosa\n4.9,3.0,1.4,0.2,setosa\n\n")
    df = features.read_typed(spark, str(iris), schemas.IRIS)
    assert df.count() == 2 and df.first()["class"] == "setosa"
    assert len(schemas.COMMENT_VOLUME_NAMES) == 54 and schemas.COMMENT_VOLUME_NAMES[38] == "h_local"
    raw = tmp_path / "raw.csv"
    raw.write_text(",".join(str(i) for i in range(54)) + "\n")
    row = features.read_headerless(spark, str(raw), schemas.COMMENT_VOLUME_NAMES).first()
    assert row["target"] == 53.0 and row["page_statistics_24"] == 28.0
    named = tmp_path / "named.csv"
    named.write_text("a,b\n1,2\n")
    assert features.read_features(spark, str(named), features.double_schema(["a", "b"])).first()["b"] == 2.0


def test_summary_round_trip(spark, tmp_path, rows):
    text = '{"GRS_100": {"mean": 545.9, "std": 142.87}, "default": {"mean": 1.0, "std": 0.0}}'
    (tmp_path / "s.txt").write_text(text)
    got = records.read_summary(spark, str(tmp_path / "s.txt"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("GRS_100", 100, 545.9, 142.87), ("default", None, 1.0, 0.0)], key=str)
    out = scratch_path(spark, "summary")
    records.write_summary(got.select("method", "mean", "std"), out)
    assert json.loads(spark.read.text(out).first()[0]) == json.loads(text)


def test_event_logs(spark, rows):
    a, b = scratch_path(spark, "log"), scratch_path(spark, "log")
    log = spark.createDataFrame([("r", i, float(i)) for i in range(1, 4)], "run string, iter long, score double")
    steps.log_steps(log, a)
    steps.log_steps(log.where("iter < 3"), b)
    whole = records.concat_event_logs(records.read_event_log(spark, a), records.read_event_log(spark, b))
    assert rows(whole, "iter") == [(1,), (2,), (3,), (4,), (5,)]
    assert records.count_events(spark, a).agg(F.sum("steps")).first()[0] == 3
    assert rows(steps.remaining_budget(whole, 8)) == [("r", 3)]


def test_run_info(spark):
    out = scratch_path(spark, "info")
    for s in ("a", "b"):
        records.write_run_info(spark, out, s, 1.5, {"alpha": 0.1}, 0.7)
    assert spark.read.parquet(out).count() == 2


def _follow(spark, log, n, parts, **kwargs):
    """Stream the log in the given iteration ranges, one micro-batch each."""
    source, out = scratch_path(spark, "steps"), scratch_path(spark, "stops")
    for lo, hi in parts:
        steps.log_steps(log.where(F.col("iter").between(lo, hi)).coalesce(1), source)
        steps.live_stop(steps.read_steps(spark, source), n, out, **kwargs).awaitTermination()
    return steps.read_stops(spark, out)


def test_live_stop_equals_the_batch_rule(spark, rows):
    data = {"a": [1, 3, 2, 2, 4, 1, 1, 1], "b": [1, 2, 3, 4, 5, 6, 7, 8], "c": [5, None, 4, 4, 9, 9, 1, 1], "d": [1.0] * 8}
    log = spark.createDataFrame([(r, i, None if s is None else float(s)) for r, ss in data.items() for i, s in enumerate(ss, 1)],
                                "run string, iter long, score double")
    want = rows(stop.plateau_stop(log, 3, ["run"]).where("stopped").join(
        log.groupBy("run").count(), "run"), "run")
    got = _follow(spark, log, 3, [(1, 2), (3, 3), (4, 6), (7, 8)])
    assert rows(got) == [("a", 4, 3.0), ("c", 4, 5.0), ("d", 3, 1.0)]
    assert [r for (r, _, _) in rows(got)] == [r for (r,) in want]
    assert rows(_follow(spark, log, 3, [(1, 8)])) == rows(got)


def test_replayed_steps_are_ignored(spark, rows):
    log = spark.createDataFrame([("a", i, s) for i, s in enumerate([1.0, 2.0, 1.0, 1.0], 1)], "run string, iter long, score double")
    assert rows(_follow(spark, log, 3, [(1, 3), (1, 3), (2, 4)])) == [("a", 4, 2.0)]


def test_threshold_stops(spark, rows):
    log = spark.createDataFrame([("a", i, float(i)) for i in range(1, 9)], "run string, iter long, score double")
    assert rows(_follow(spark, log, 50, [(1, 3), (4, 8)], threshold=5.0)) == [("a", 5, 5.0)]


def test_on_step_stream_equals_batch(spark, rows):
    log = spark.createDataFrame([("a", i, float(i % 4)) for i in range(1, 9)] + [("b", 1, None)], "run string, iter long, score double")
    source = scratch_path(spark, "steps")
    steps.log_steps(log.repartition(4), source)
    got = steps.run_to_table(steps.on_step(steps.read_steps(spark, source, 1)), "update")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 8, 3.0, 3), ("b", 1, None, None)], key=str)


def test_follow_calls_back(spark):
    source, seen = scratch_path(spark, "steps"), []
    steps.log_steps(spark.createDataFrame([("a", 1, 0.5)], "run string, iter long, score double"), source)
    query = steps.follow(steps.on_step(steps.read_steps(spark, source)), lambda df, i: seen.extend(df.collect()), scratch_path(spark, "ck"))
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in seen] == [("a", 1, 0.5, 1)]


def test_props_parse_on_the_given_table(spark):
    ev = views.table(spark, "/root/testdata/sf0.001", "events")
    assert ev.where(parse_params("props")["k"].isNull()).count() == 0
