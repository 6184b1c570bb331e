"""Stop rules, cuts and stitching on hand-computed logs."""

import pytest
from pyspark.sql import functions as F

from trialwright.operators import curves, space, stop, trials
from trialwright.operators.scan import longest_run, number_rows

PLATEAU = [0.1, 0.3, 0.2, 0.2, 0.4, 0.1]


def test_plateau_and_global_best_disagree(log):
    df = log({1: PLATEAU})
    assert stop.plateau_stop(df, 3).first()["stop_pos"] == 4
    assert stop.global_best_stop(df, 3, 1, 6).first()["last_iter"] == 6
    assert stop.stop_rule(df, 3).first()["last_iter"] == 4
    assert stop.stop_rule(df, 3, "global_best").first()["last_iter"] == 6


def test_plateau_cut_is_a_prefix(log, rows):
    assert rows(stop.stop_at_plateau(log({1: PLATEAU}), 3), "iter", "best") == [(1, 0.1), (2, 0.3), (3, 0.3), (4, 0.3)]


def test_lowest_plateau_wins(log):
    df = log({1: [0.1, 0.1, 0.1, 0.5, 0.5, 0.5, 0.5]})
    assert stop.plateau_stop(df, 3).first()["stop_pos"] == 3


def test_no_plateau(log):
    df = log({1: [0.1, 0.2, 0.3]})
    kept = stop.plateau_stop(df, 2).first()
    assert (kept["stop_pos"], kept["stopped"]) == (3, False)
    assert stop.stop_at_plateau(df, 2).count() == 3
    with pytest.raises(Exception, match="no plateau"):
        stop.plateau_stop(df, 2, on_missing="error").collect()


def test_ties_go_to_the_first_iteration(log):
    df = log({1: [0.5, 0.5]})
    assert trials.best_per_run(df).first()["iter"] == 1
    assert trials.best_rows(df).count() == 2


def test_missing_score_never_wins_nor_counts(log):
    df = log({1: [0.1, None, 0.2, 0.2]})
    assert trials.best_per_run(df).first()["iter"] == 3
    assert [r["best"] for r in trials.running_best(df).orderBy("iter").collect()] == [0.1, 0.1, 0.2, 0.2]
    assert stop.plateau_stop(df, 2).first()["stop_pos"] == 3
    assert stop.stop_at_plateau(df, 2).count() == 4
    assert stop.global_best_stop(df, 1).first()["best_iter"] == 3


def test_split_run_stops_at_the_same_place(log):
    df = log({1: [float(i // 7) for i in range(100)], 2: PLATEAU})
    for n in (3, 7, 8):
        whole = sorted(map(tuple, stop.plateau_stop(df, n).collect()))
        assert sorted(map(tuple, stop.plateau_stop(df, n, task_rows=9).collect())) == whole


def test_window_cut_equals_joined_cut(log, rows):
    plain = log({1: [float(i // 7) for i in range(60)], 2: PLATEAU, 3: [None, 1.0, None, 1.0, 2.0, 2.0]})
    known = number_rows(plain, ["experiment", "run"], ["iter"])
    assert longest_run(known, "iter", ["experiment", "run"]) == 60
    for n in (2, 3, 7, 9):
        got = sorted(map(str, stop.stop_at_plateau(known, n).select("run", "iter", "best", "pos").collect()))
        assert got == sorted(map(str, stop.stop_at_plateau(plain, n).select("run", "iter", "best", "pos").collect()))
    with pytest.raises(Exception, match="no plateau"):
        stop.stop_at_plateau(known, 9, on_missing="error").collect()


def test_stop_within_bounds(log):
    df = log({1: [0.1, 0.9, 0.2, 0.3, 0.8, 0.1]})
    row = stop.global_best_stop(df, 10, 3, 5).first()
    assert (row["best_iter"], row["last_iter"]) == (5, 5)


def test_drop_overlap_modes(log, rows):
    stage2 = log({1: [0.1] * 10})
    stage3 = log({1: [0.2] * 6}).where("iter >= 4")
    kept = lambda mode: [i for (i,) in rows(trials.drop_overlap(stage2, stage3, mode=mode), "iter")]
    assert kept("intersect") == [1, 2, 3, 7, 8, 9, 10]
    assert kept("cut") == [1, 2, 3]


def test_longest_plateau_leaves_out_the_last(log):
    df = log({1: [1.0, 1.0, 2.0, 2.0, 2.0, 2.0], 2: [3.0]})
    assert trials.longest_plateau(df).first()["longest"] == 2
    assert trials.longest_plateau(log({1: [3.0, 1.0]})).first()["longest"] == 1


def test_stage_boundaries(spark, rows):
    df = spark.createDataFrame([(i,) for i in (1, 243, 244, 486, 487, 729)], "iter long")
    got = df.select("iter", trials.stage_of().alias("s"), trials.rebase_iter().alias("r"))
    assert [tuple(r)[1:] for r in got.orderBy("iter").collect()] == [(1, 1), (1, 243), (2, 1), (2, 243), (3, 1), (3, 243)]


def test_extend_runs_and_its_curve(log, rows):
    df = log({1: [0.1, 0.5, 0.2], 2: [0.3, 0.1, 0.4, 0.2, 0.6]})
    assert rows(curves.extend_runs(df), "run", "iter", "score") == [(1, 4, 0.5), (1, 5, 0.5)]
    padded = trials.union_trials(df, curves.extend_runs(df))
    want = {r["iter"]: r for r in curves.learning_curve(padded).collect()}
    for task_rows in (2, 1000):
        for r in curves.extended_curve(df, task_rows=task_rows).collect():
            for c in ("mean", "std", "runs", "lower", "upper"):
                assert r[c] == pytest.approx(want[r["iter"]][c])


def test_extend_runs_pads_within_a_method(spark, rows):
    data = [("a", 1, i, 0.1 * i) for i in (1, 2)] + [("a", 2, i, 0.2 * i) for i in (1, 2, 3)] + [("b", 1, i, 0.3) for i in range(1, 7)]
    df = spark.createDataFrame(data, "experiment string, run long, iter long, score double")
    assert rows(curves.extend_runs(df), "experiment", "run", "iter", "score") == [("a", 1, 3, 0.2)]
    assert curves.extend_runs(df, within=()).count() == 4 + 3
    padded = trials.union_trials(df, curves.extend_runs(df))
    want = {(r["experiment"], r["iter"]): r["mean"] for r in curves.learning_curve(padded).collect()}
    got = {(r["experiment"], r["iter"]): r["mean"] for r in curves.extended_curve(df, task_rows=2).collect()}
    assert got == pytest.approx(want)


# Falling, unscored and level runs, one of them without a number.
ODD_RUNS = {None: [float(60 - i) for i in range(40)], 1: [None] * 5, 2: [None, 0.5, 0.5, None, 0.5, 0.7, 0.7], 3: PLATEAU * 4, 4: [0.3] * 12}


@pytest.mark.parametrize("operator", [
    lambda df, **k: trials.running_best(df, **k).select("run", "iter", "best"),
    lambda df, **k: trials.scored_scan(df, **k).select("run", "iter", "best", "pos"),
    lambda df, **k: trials.plateau_lengths(df, **k).select("run", "best", "length", "first_pos", "first_iter"),
    lambda df, **k: trials.longest_plateau(df, per=["run"], **k).select("run", "longest"),
    lambda df, **k: stop.plateau_stop(df, 3, **k).select("run", "stop_pos", "end_pos", "stopped"),
    lambda df, **k: stop.stop_at_plateau(df, 3, **k).select("run", "iter", "best", "pos"),
    lambda df, **k: stop.stop_at_plateau(df, 4, **k).select("run", "iter", "best", "pos"),
    lambda df, **k: curves.learning_curve(df, **k).select("iter", F.round("mean", 9), F.round("std", 9), "runs")])
def test_size_does_not_change_the_answer(spark, operator):
    """Window plans of measured short runs, and split plans of pieces of 7 rows, agree on NULL runs, NULL scores and ties."""
    data = [("e", run, i, s) for run, scores in ODD_RUNS.items() for i, s in enumerate(scores, 1)]
    plain = spark.createDataFrame(data, "experiment string, run long, iter long, score double")
    known = number_rows(plain, ["experiment", "run"], ["iter"])
    assert longest_run(known, "iter", ["experiment", "run"]) == 40
    whole = sorted(map(str, operator(known).collect()))
    assert whole and sorted(map(str, operator(plain, task_rows=7).collect())) == whole
    assert sorted(map(str, operator(known, task_rows=7).collect())) == whole


def test_run_without_a_score_is_missing_under_both_plans(log):
    df = log({1: [None] * 4})
    known = number_rows(df, ["experiment", "run"], ["iter"])
    for frame, task_rows in ((known, 100), (df, 3)):
        assert stop.stop_at_plateau(frame, 2, task_rows=task_rows).count() == 4
        with pytest.raises(Exception, match="no plateau"):
            stop.stop_at_plateau(frame, 2, on_missing="error", task_rows=task_rows).collect()


def test_stitch_renumbers(log, rows):
    stages = [log({1: [0.1, 0.9, 0.2, 0.3]}), log({1: [0.5, 0.4, 0.3]}), log({1: [0.1, 0.2]})]
    got = stop.stitch_stages(stages, 2)
    assert rows(got, "iter", "stage", "stage_iter") == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 1), (5, 2, 2), (6, 3, 1), (7, 3, 2)]


def test_select_stage_log_takes_the_rerun_after_an_early_stop(log, rows):
    original, rerun = log({1: [0.1], 2: [0.2]}), log({1: [0.3], 2: [0.4]})
    stops = original.sparkSession.createDataFrame([(1, 243), (2, 100)], "run long, last_iter long")
    assert rows(stop.select_stage_log(original, rerun, [stops]), "run", "score") == [(1, 0.1), (2, 0.4)]


def test_incomplete_runs(log, rows):
    parts = [log({1: [0.1], 2: [0.1]}), log({1: [0.2]}), log({1: [0.3], 2: [0.3]})]
    assert rows(stop.assemble_group_logs(parts), "run", "stage") == [(1, 1), (1, 2), (1, 3)]
    assert rows(stop.missing_runs(parts[0], range(1, 5))) == [(3,), (4,)]


def test_budget_rounds_half_to_even(spark):
    df = spark.createDataFrame([(180, 300), (182, 300)], "a long, b long")
    two, three = space.stage_budget("a", "b")
    assert [tuple(r) for r in df.select(two, three).collect()] == [(274, 429), (274, 429)]


# Last iteration and best score of ten runs each of four recorded stop values (fixed values).
RECORDED = """
10 1 465 0.667092600100925
10 2 432 0.6677394210966182
10 3 387 0.6693661641653508
10 4 387 0.6689045814258278
10 5 383 0.6695679255859954
10 6 375 0.6673421420235272
10 7 685 0.6676134364668953
10 8 370 0.6690952702444608
10 9 510 0.6667125302128254
10 10 592 0.6669998351642157
25 1 423 0.6678513711671845
25 2 649 0.6701897608539047
25 3 576 0.6682004648870166
25 4 700 0.6678340455584854
25 5 403 0.6699298174492908
25 6 543 0.6682216804643306
25 7 600 0.6711111111582201
25 8 378 0.6674109892216735
25 9 386 0.6670882691226445
25 10 420 0.6668481098183217
50 1 398 0.6682260927960084
50 2 622 0.6671225201933444
50 3 407 0.6675321433573278
50 4 407 0.6693326352914759
50 5 578 0.6669000119223252
50 6 395 0.6688443116857797
50 7 478 0.6679583490622466
50 8 390 0.6686993256503098
50 9 399 0.670130404024028
50 10 433 0.6695973335429501
100 1 330 0.6697103495698085
100 2 729 0.6699178088246407
100 3 340 0.6677636269683015
100 4 629 0.6679583730777356
100 5 525 0.6661779363479912
100 6 424 0.6670100085472515
100 7 623 0.6662943406900266
100 8 729 0.6680510317960973
100 9 663 0.6697579624979136
100 10 467 0.6680099166785411
"""


def _recorded(spark):
    data = [line.split() for line in RECORDED.strip().splitlines()]
    rows = [(f"GRS_{stop_}", int(run), int(last), float(best)) for stop_, run, last, best in data]
    return spark.createDataFrame(rows, "experiment string, run long, iter long, score double")


def test_recorded_summary(spark):
    got = {r["experiment"]: r for r in curves.stop_summary(_recorded(spark)).collect()}
    # Published means and population deviations (fixed values).
    iters = {"GRS_10": (458.6, 101.61220399144976), "GRS_25": (507.8, 113.5057707784058),
             "GRS_50": (450.7, 79.16065942120493), "GRS_100": (545.9, 142.87858481941933)}
    scores = {"GRS_10": (0.6680433906486641, 0.0010225089107698568), "GRS_25": (0.6684685619701072, 0.0013655312193986838),
              "GRS_50": (0.6684343127525796, 0.0010214373531322479), "GRS_100": (0.6680651354998307, 0.0013008025390191303)}
    for name, r in got.items():
        assert (r["iters_mean"], r["iters_std"]) == pytest.approx(iters[name], rel=1e-12)
        assert (r["score_mean"], r["score_std"]) == pytest.approx(scores[name], rel=1e-9)


def test_summary_uses_population_and_method_sample_deviation(log):
    df = log({1: [1.0], 2: [3.0]})
    assert curves.stop_summary(df).first()["score_std"] == pytest.approx(1.0)
    assert curves.method_summary(df).first()["std"] == pytest.approx(2**0.5)


def test_curve_sizes(log):
    df = log({1: [1.0, 2.0], 2: [3.0, 3.0]})
    last = lambda **k: curves.learning_curve(df, **k).where(F.col("iter") == 2).first()
    assert last()["upper"] - last()["mean"] == pytest.approx(1.96 * 0.5**0.5 / 2**0.5)
    assert last(n=10, z=2.262)["upper"] - last()["mean"] == pytest.approx(2.262 * 0.5**0.5 / 10**0.5)
    assert last(n="measured")["upper"] == pytest.approx(last()["upper"])
    assert curves.learning_curve(log({1: [1.0]})).first()["lower"] == 1.0
