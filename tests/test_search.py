import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialwright.operators import boost, evaluate, propose, space
from trialwright.plans import search

SPACE = [space.Param("x", "float", 0.0, 1.0)]


def _objective(candidates):
    """Peak at x = 0.7."""
    return candidates.withColumn("score", 1 - (F.col("x") - 0.7) * (F.col("x") - 0.7))


def sums_of(spark, rows, space_=SPACE, features=propose.FEATURES, parts=1):
    history = spark.createDataFrame(rows, "x double, score double, weight long").repartition(parts)
    return propose.feature_sums(history, space_, [], propose.fourier_basis(len(space_), features)).toPandas()


def test_posterior_follows_the_kernel(spark):
    """The posterior is that of the Gaussian process whose kernel is the product of the features, which is about an RBF kernel."""
    x, y, noise, basis = np.array([0.0, 0.3, 0.5, 1.0]), np.array([0.0, 0.4, 1.0, 0.5]), 0.1, propose.fourier_basis(1)
    posterior = propose.Posterior(sums_of(spark, [(float(a), float(b), 1) for a, b in zip(x, y)]), propose.FEATURES, noise)
    at = np.array([0.5, 0.25, 0.9])
    of = lambda points: propose.basis_at(points[:, None], basis)
    mu, sd = posterior.at(of(at))
    inverse = np.linalg.inv(of(x) @ of(x).T + noise * np.eye(4))
    cross = of(at) @ of(x).T
    assert mu == pytest.approx(y.mean() + cross @ inverse @ (y - y.mean()), abs=1e-8)
    assert sd == pytest.approx(y.std() * np.sqrt((of(at) ** 2).sum(axis=1) - np.einsum("ij,jk,ik->i", cross, inverse, cross)), abs=1e-8)
    points = np.linspace(0, 1, 11)
    rbf = np.exp(-((points[:, None] - points[None, :]) ** 2) / (2 * propose.SCALE**2))
    assert np.abs(of(points) @ of(points).T - rbf).max() < 0.35


def test_repeats_equal_weights_and_parts_do_not_matter(spark):
    one = [(0.2, 1.0, 1), (0.2, 1.0, 1), (0.9, 0.0, 1)]
    a, b = (propose.Posterior(sums_of(spark, r, parts=p), propose.FEATURES, 0.1) for r, p in ((one, 3), ([(0.2, 1.0, 2), (0.9, 0.0, 1)], 1)))
    phi = propose.basis_at(np.linspace(0, 1, 7)[:, None], propose.fourier_basis(1))
    for p, q in zip(a.at(phi), b.at(phi)):
        assert p == pytest.approx(q, abs=1e-9)


def test_a_believed_trial_is_one_more_trial(spark):
    rows, point = [(0.1, 1.0, 1), (0.5, 3.0, 2), (0.8, 2.0, 1)], 0.35
    posterior, basis = propose.Posterior(sums_of(spark, rows), propose.FEATURES, 0.01), propose.fourier_basis(1)
    phi_of = lambda xs: propose.basis_at(np.array(xs)[:, None], basis)
    mean, deviation = posterior.mean, posterior.deviation
    posterior.believe(phi_of([point])[0], 2.5)
    x, y, w = np.array([r[0] for r in rows] + [point]), np.array([r[1] for r in rows] + [2.5]), np.array([1, 2, 1, 1])
    phi = phi_of(x)
    inverse = np.linalg.inv(np.eye(propose.FEATURES) + (phi * w[:, None]).T @ phi / 0.01)
    at = phi_of([0.2, 0.4, 0.6])
    mu, sd = posterior.at(at)
    assert mu == pytest.approx(mean + at @ inverse @ ((w * (y - mean)) @ phi) / 0.01, abs=1e-6)
    assert sd == pytest.approx(deviation * np.sqrt(np.einsum("ij,jk,ik->i", at, inverse, at)), abs=1e-6)


@pytest.mark.parametrize("keys", [["run"], []])
def test_batch_is_picked_one_after_another(spark, keys):
    """Eight picks equal eight single proposals, each with the ones before among the history at the believed score."""
    rows = [(float(i) / 9, 1 - (i / 9 - 0.7) ** 2, 1 + i % 2) for i in range(0, 10, 3)]
    history = spark.createDataFrame([("r", *r) for r in rows], "run string, x double, score double, weight long")
    runs = spark.createDataFrame([("r",), ("new",)] if keys else [("r",)], "run string")
    pool = space.random_candidates(spark, SPACE, 50, seed=2, runs=runs)
    running = spark.createDataFrame([("r", 0.72)], "run string, x double")
    got = propose.propose_batch(history, pool, SPACE, 8, keys, pending=running, lie="mean").collect()
    picked = [r["trial_id"] for r in sorted((r for r in got if r["run"] == "r"), key=lambda r: r["pick"])]
    basis, left = propose.fourier_basis(1), {r["trial_id"]: r["x"] for r in pool.where("run = 'r'").collect()}
    x, y, w = (np.array(c) for c in zip(*rows))
    mean = np.average(y, weights=w)
    dev = np.sqrt(np.average(y * y, weights=w) - mean**2)
    believed, expected = [0.72], []
    for _ in range(8):
        phi = propose.basis_at(np.append(x, believed)[:, None], basis)
        target, weight = np.append((y - mean) / dev, np.zeros(len(believed))), np.append(w, np.ones(len(believed)))
        inverse = np.linalg.inv(np.eye(propose.FEATURES) + (phi * weight[:, None]).T @ phi / propose.NOISE)
        ids = sorted(left)
        at = propose.basis_at(np.array([left[i] for i in ids])[:, None], basis)
        mu, sd = mean + dev * (at @ inverse @ ((weight * target) @ phi)) / propose.NOISE, dev * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", at, inverse, at), 1e-12))
        z = (mu - y.max()) / sd
        ei = (mu - y.max()) * np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]) + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        best = ids[int(np.argmax(ei))]
        expected.append(best)
        believed.append(left.pop(best))
    assert picked == expected
    if keys:
        assert [(r["trial_id"], r["ei"]) for r in got if r["run"] == "new"] == [(i, 1.0) for i in range(8)]
    with pytest.raises(ValueError):
        propose.propose_batch(history, pool, SPACE, 8, keys, lie="worst")


def test_long_history(spark):
    """Fifty thousand configurations in one run, for both models: no limit, and no group of rows."""
    history = spark.range(50_000).select(F.lit("r").alias("run"), (F.col("id") / 50_000).alias("x")).withColumns(
        {"score": 1 - F.pow(F.col("x") - 0.7, 2), "weight": F.lit(1).cast("long")})
    pool = space.random_candidates(spark, SPACE, 100, seed=2, runs=spark.createDataFrame([("r",)], "run string"))
    for scored, value in ((propose.propose_ei(history, pool, SPACE), "ei"), (propose.propose_tpe(history, pool, SPACE, task_rows=9_000), "log_ratio")):
        best = propose.top_proposals(scored, value, 3).collect()
        assert len(best) == 3 and all(abs(r["x"] - 0.7) < 0.15 for r in best)


def test_slices_and_blocks_do_not_change_the_scores(spark, rows, monkeypatch):
    history = spark.createDataFrame([("r", i / 10, 1 - (i / 10 - 0.7) ** 2) for i in range(0, 10, 2)], "run string, x double, score double")
    history = propose.config_history(history, ["x"])
    runs = spark.createDataFrame([("r",), ("new",)], "run string")
    cand = space.random_candidates(spark, SPACE, 60, seed=2, runs=runs)
    for fn, value, how in ((propose.propose_ei, "ei", {"slices": 1}), (propose.propose_tpe, "log_ratio", {})):
        one = rows(fn(history, cand, SPACE, **how), "run", "trial_id", value)
        monkeypatch.setattr(propose, "BLOCK", 5)
        many = rows(fn(history, cand, SPACE, **({"slices": 7} if how else {"task_rows": 2})), "run", "trial_id", value)
        assert [r[:2] for r in one] == [r[:2] for r in many] and len(one) == 120
        assert [r[2] for r in one] == pytest.approx([r[2] for r in many], abs=1e-6)
        best = propose.top_proposals(fn(history, cand, SPACE), value, 3).where("run = 'r'").collect()
        assert len(best) == 3 and all(0.4 < r["x"] <= 1.0 for r in best)


def test_top_proposals_breaks_ties_by_id(spark, rows):
    scored = spark.createDataFrame([("r", i, 1.0) for i in range(10)], "run string, trial_id long, ei double")
    assert rows(propose.top_proposals(scored, "ei", 2), "trial_id") == [(0,), (1,)]


def test_epsilon_greedy_keeps_every_row(spark):
    a = space.random_candidates(spark, SPACE, 400, 1).withColumn("x", F.lit(-1.0))
    b = space.random_candidates(spark, SPACE, 400, 2)
    got = propose.epsilon_greedy(a, b, 0.25, 3, ["trial_id"])
    assert got.count() == 400 and got.select("trial_id").distinct().count() == 400
    assert got.where("x >= 0").count() == pytest.approx(100, abs=35)
    assert propose.epsilon_greedy(a, b, 0.0, 3, ["trial_id"]).where("x >= 0").count() == 0


@pytest.mark.parametrize("mode", ["ei", "tpe"])
def test_model_based_search_homes_in(spark, mode):
    stage = search.Stage(SPACE, 14, mode, initial=5, batch=3, pool=100)
    log = search.search_stage(spark, _objective, stage, seed=3)
    got = log.toPandas().sort_values("iter")
    assert list(got["iter"]) == list(range(1, 15))
    assert got["x"].nunique() == 14
    first, rest = got[got.iter <= 5], got[got.iter > 5]
    assert abs(rest["x"] - 0.7).median() < abs(first["x"] - 0.7).median()


def test_resume_finishes_the_budget(spark):
    stage = search.Stage(SPACE, 12, "ei", initial=4, batch=4, pool=50)
    part = search.search_stage(spark, _objective, search.Stage(SPACE, 8, "ei", initial=4, batch=4, pool=50), seed=1)
    seen = []
    whole = search.search_stage(spark, _objective, stage, seed=1, finished=part, on_batch=lambda df, n: seen.append(n))
    assert whole.count() == 12 and seen == [12]
    assert part.join(whole, ["trial_id", "x"], "left_anti").count() == 0


def test_online_stop(spark):
    flat = lambda c: c.withColumn("score", F.when(F.col("trial_id") == 2, 1.0).otherwise(0.5))
    log = search.search_stage(spark, flat, search.Stage(SPACE, 100, "random", batch=5, max_no_improve=4))
    assert log.agg(F.max("iter")).first()[0] == 7  # the third is the best, the next four are not better
    assert log.count() == 7


def test_nan_never_wins(spark):
    bad = lambda c: _objective(c).withColumn("score", F.when(F.col("trial_id") == 2, F.lit(float("nan"))).otherwise(F.col("score")))
    log = search.search_stage(spark, bad, search.Stage(SPACE, 8, "random", batch=4, max_no_improve=7))
    best, score = search.winner(log, ["x"])
    assert log.count() == 8 and log.where("isnan(score)").count() == 0 and log.where("score IS NULL").count() == 1
    assert score == pytest.approx(log.agg(F.max("score")).first()[0]) and score <= 1.0


def test_left_out_candidates_stay_as_trials(spark):
    """An objective that scores even trials only, stopped and resumed: every id once, the budget counts all."""
    even = lambda c: _objective(c.where("trial_id % 2 = 0"))
    part = search.search_stage(spark, even, search.Stage(SPACE, 5, "tpe", initial=4, batch=3, pool=40), seed=1)
    whole = search.search_stage(spark, even, search.Stage(SPACE, 12, "tpe", initial=4, batch=3, pool=40), seed=1, finished=part)
    assert sorted(r[0] for r in whole.select("trial_id").collect()) == list(range(12))
    assert whole.where("score IS NULL").count() == 6 and whole.where("iter <> trial_id + 1").count() == 0
    # A log that lacks ids: new trials are numbered after the last, a grid's missing points come next.
    gaps = part.where("trial_id <> 1")
    more = search.search_stage(spark, even, search.Stage(SPACE, 6, "random"), finished=gaps)
    assert sorted(r[0] for r in more.select("trial_id").collect()) == [0, 2, 3, 4, 5, 6]
    grid = search.Stage([], 4, "grid", grid={"x": [0.1, 0.4, 0.7, 0.9]})
    done = search.search_stage(spark, _objective, grid).where("trial_id <> 1")
    assert search.search_stage(spark, _objective, grid, finished=done).count() == 4


def test_discrete_points_are_proposed_once_and_all(spark):
    points = [space.Param("x", "int", 0, 9, inclusive=True)]
    log = search.search_stage(spark, _objective, search.Stage(points, 20, "tpe", initial=1, batch=4, pool=16))
    assert sorted(r[0] for r in log.select("x").collect()) == [float(i) for i in range(10)]


def test_grid_and_distinct_modes(spark):
    grid = search.search_stage(spark, _objective, search.Stage([], 4, "grid", grid={"x": [0.1, 0.4, 0.7, 0.9]}))
    assert search.winner(grid, ["x"]) == ({"x": 0.7}, 1.0)
    small = [space.Param("x", "choice", values=(0.1, 0.4, 0.7))]
    got = search.search_stage(spark, _objective, search.Stage(small, 3, "distinct", batch=2, max_no_improve=50))
    assert got.select("x").distinct().count() == 3


def test_finished_configurations_are_not_rerun(spark, rows):
    cand = spark.createDataFrame([(0, 0.1), (1, 0.2)], "trial_id long, x double")
    assert rows(search.skip_finished(cand, cand.where("trial_id = 0"), ["x"])) == [(0.2, 1)]
    assert search.skip_finished(cand, None, ["x"]) is cand


def test_grouped_search_freezes_winners(spark):
    pdf = pd.DataFrame({"id": range(400), "a": np.linspace(0, 1, 400), "b": np.tile([0.0, 1.0], 200)})
    pdf["y"] = 5 * (pdf.a > 0.3) + pdf.b
    df = evaluate.assign_folds(spark.createDataFrame(pdf), 3, ["id"])
    data = boost.bin_table(df, ["a", "b"], "y", ["id"], bins=16)
    stages = [search.Stage([space.Param("max_depth", "int", 1, 4)], 3, "distinct"),
              search.Stage([], 2, "grid", grid={"alpha": [0.0, 500.0], "lambda": [1.0]}),
              search.Stage([space.Param("subsample", "float", 0.5, 0.9)], 2, "random")]
    result = search.grouped_search(spark, search.cv_objective(data, 3), stages, {"rounds": 3, "eta": 0.5})
    log = result.log.toPandas().sort_values("iter")
    assert list(log["iter"]) == list(range(1, 8)) and list(log["stage"]) == [1] * 3 + [2] * 2 + [3] * 2
    depth = result.stage_winners[0]["max_depth"]
    assert (log[log.stage > 1]["max_depth"] == depth).all()
    assert result.stage_winners[1]["alpha"] == 0.0
    assert (log[log.stage == 3]["alpha"] == 0.0).all()
    assert result.best_score == pytest.approx(log["score"].max())
    best = log.loc[log["score"].idxmax()]
    assert {k: best[k] for k in result.best_params} == result.best_params and "max_depth" in result.best_params
