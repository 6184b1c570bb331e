"""The booster against brute force, and the effect of each parameter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialwright.operators import boost, evaluate, kernels, prep


def _data(spark, n=600, seed=1, missing=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.randint(0, 5), rng.random()
        y = 10 * (a > 0.4) + 3 * b * (a <= 0.4) + 0.1 * rng.random()
        rows.append((i, None if missing and rng.random() < 0.3 else a, float(b), c, y))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


@pytest.fixture(scope="module")
def binned(spark):
    return boost.bin_table(evaluate.assign_folds(_data(spark), 3, ["id"]), ["a", "b", "c"], "y", ["id"], bins=16)


def _brute_force(x, y, depth, mcw, alpha, lam, eta, base):
    """Exhaustive tree on binned features; returns predictions on the same rows."""
    g = base - y

    def weight(idx):
        s = g[idx].sum()
        return -np.sign(s) * max(abs(s) - alpha, 0) / (len(idx) + lam)

    def quality(idx):
        s = max(abs(g[idx].sum()) - alpha, 0)
        return s * s / (len(idx) + lam)

    out = np.full(len(y), base)

    def grow(idx, level):
        best = None
        for f in range(x.shape[1]):
            for b in np.unique(x[idx, f]):
                left, right = idx[x[idx, f] <= b], idx[x[idx, f] > b]
                if min(len(left), len(right)) < max(mcw, 1):
                    continue
                gain = quality(left) + quality(right) - quality(idx)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, right)
        if best is None or level == depth:
            out[idx] += eta * weight(idx)
            return
        grow(best[1], level + 1)
        grow(best[2], level + 1)

    grow(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("p", [dict(), dict(alpha=20.0), dict(min_child_weight=60.0), {"lambda": 40.0, "max_depth": 3}])
def test_one_tree_matches_exhaustive_search(spark, binned, p):
    p = {"max_depth": 2, "rounds": 1, "eta": 0.5, "lambda": 1.0, "alpha": 0.0, "min_child_weight": 1.0, **p}
    rows = binned.table.orderBy("row_key").collect()
    x, y = np.array([r["bins"] for r in rows]), np.array([r["label"] for r in rows])
    want = _brute_force(x, y, p["max_depth"], p["min_child_weight"], p["alpha"], p["lambda"], p["eta"], y.mean())
    fit = boost.fit_boosted(binned, {0: p}).fits[0]
    assert fit.margins(x.astype(np.int16))[:, 0] == pytest.approx(want, abs=1e-4)


def test_penalties_matter(binned):
    trials = {0: {}, 1: {"lambda": 1e12}, 2: {"alpha": 1e12}, 3: {"lambda": 50.0}}
    fits = {f.trial: f for f in boost.fit_boosted(binned, {t: {"max_depth": 2, "rounds": 1, **p} for t, p in trials.items()}).fits}
    top = {t: max(abs(v) for v in f.rounds[0][0].value) for t, f in fits.items()}
    assert top[1] < 1e-6 and top[2] == 0 and 0 < top[3] < top[0]


def test_same_result_under_any_partitioning(spark, binned):
    p = {0: {"max_depth": 3, "rounds": 3, "subsample": 0.7, "colsample_bytree": 0.7, "eta": 0.3}}
    spread = boost.Binned(binned.table.repartition(13), binned.features, binned.edges, binned.unit, binned.centre, binned.fold_sums)
    a, b = boost.fit_boosted(binned, p, [0, 1]), boost.fit_boosted(spread, p, [0, 1])
    assert [f.rounds for f in a.fits] == [f.rounds for f in b.fits]


def test_trials_do_not_influence_each_other(binned):
    p, q = {"max_depth": 2, "rounds": 2, "eta": 0.3}, {"max_depth": 4, "rounds": 3, "subsample": 0.5}
    both = boost.fit_boosted(binned, {0: p, 1: q}, [0])
    assert both.fits[0].rounds == boost.fit_boosted(binned, {0: p}, [0]).fits[0].rounds
    assert both.fits[1].rounds == boost.fit_boosted(binned, {1: q}, [0]).fits[0].rounds


def test_written_margins_do_not_change_the_trees(binned, monkeypatch):
    p = {0: {"max_depth": 2, "rounds": 5, "eta": 0.3}}
    plain = boost.fit_boosted(binned, p, [0, 1])
    monkeypatch.setattr(boost, "REFRESH_ROUNDS", 2)
    assert [f.rounds for f in boost.fit_boosted(binned, p, [0, 1]).fits] == [f.rounds for f in plain.fits]


def test_uncombined_histograms_give_the_same_trees(binned, monkeypatch):
    p = {0: {"max_depth": 3, "rounds": 2, "eta": 0.3}}
    plain = boost.fit_boosted(binned, p)
    monkeypatch.setattr(boost, "DENSE_CELLS", 0)
    assert boost.fit_boosted(binned, p).fits[0].rounds == plain.fits[0].rounds


def test_scores_follow_the_predictions(spark, binned):
    fitted = boost.fit_boosted(binned, {0: {"max_depth": 3, "rounds": 4, "eta": 0.5}}, [0, 1, 2])
    scores = fitted.scores().where("metric = 'r2'").collect()
    by_round = {r["round"]: r["value"] for r in scores if r["fold"] == 1 and not r["isTest"]}
    assert by_round[1] < by_round[2] < by_round[3] < by_round[4]
    data = evaluate.assign_folds(_data(spark), 3, ["id"]).withColumnRenamed("y", "label")
    predicted = fitted.predict(data, 0, 1)
    for side in (True, False):
        rows = predicted.where((F.col("fold") == 1) == F.lit(side))
        want = next(r["value"] for r in scores if (r["fold"], r["round"], r["isTest"]) == (1, 4, side))
        assert rows.agg(evaluate.r2()).first()[0] == pytest.approx(want)


def test_missing_values_choose_a_side(spark):
    df = _data(spark, missing=True)
    data = boost.bin_table(df, ["a", "b", "c"], "y", ["id"], fold=None, bins=16)
    assert data.table.where(F.array_contains("bins", F.lit(kernels.MISSING_BIN).cast("smallint"))).count() > 100
    fitted = boost.fit_boosted(data, {0: {"max_depth": 4, "rounds": 6, "eta": 0.5}})
    assert fitted.scores().where("metric = 'r2' AND NOT isTest AND round = 6").first()["value"] > 0.6
    sides = {tree.missing_left[n] for trees in fitted.fits[0].rounds for tree in trees for n in range(len(tree.feature)) if tree.feature[n] == 0}
    assert sides


def test_sampling_is_seeded_by_row_and_round():
    keys = np.arange(10_000)
    u = kernels.mix(keys, 5)
    assert 0 <= u.min() and u.max() < 1 and u.mean() == pytest.approx(0.5, abs=0.02)
    assert abs(np.corrcoef(u, kernels.mix(keys, 6))[0, 1]) < 0.05
    assert boost._sampled_features(10, 0.7, 1, 2, 3) == boost._sampled_features(10, 0.7, 1, 2, 3)
    assert len(boost._sampled_features(10, 0.05, 1, 2, 3)) == 1


def test_batches_cover_all_trials():
    params = {t: {"max_depth": t % 15} for t in range(40)}
    batches = list(boost.pair_batches(params, range(5), 1, 20))
    assert [t for b in batches for t in b] == list(range(40))
    assert all(len(b) * 5 <= 20 for b in batches)


def test_softmax_separates_three_classes(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(c, 0.2), rng.random(), float(c)) for i in range(450) for c in [i % 3]]
    df = evaluate.assign_folds(spark.createDataFrame(rows, "id long, a double, b double, label double"), 3, ["id"])
    data = boost.bin_table(df, ["a", "b"], "label", ["id"], bins=96, classes=3)
    fitted = boost.fit_boosted(data, {0: {"max_depth": 2, "rounds": 4, "eta": 0.3}}, [0])
    assert fitted.scores().where("isTest AND round = 4").first()["value"] > 0.95
    out = fitted.predict(df.withColumnRenamed("label", "y"))
    assert out.where("prediction = y").count() > 420


def test_spark_learners(spark):
    df = prep.assemble_features(_data(spark).withColumnRenamed("y", "label"), ["a", "b"])
    with pytest.raises(ValueError, match="alpha or lambda"):
        boost.mllib_regressor({"lambda": 1.0})
    model = boost.mllib_regressor({"max_depth": 3, "rounds": 2, "eta": 0.5, "colsample_bytree": 0.7}).fit(df)
    assert model.transform(df).agg(evaluate.r2()).first()[0] > 0.2
    assert boost.mllib_classifier().getClassifier().getMaxDepth() == 2


@pytest.mark.parametrize("splits", [0, 1, 8, 9, 12, 13])
def test_routes_of_packed_rows(splits):
    draw = np.random.default_rng(splits)
    tree, leaves = kernels.Tree(), [0]
    for _ in range(splits):
        at = leaves.pop(draw.integers(len(leaves)))
        leaves += tree.split(at, int(draw.integers(3)), int(draw.integers(1, 9)), bool(draw.integers(2)), 1.0, 2.0)
    n = 20_000
    bins = draw.integers(0, 10, (n, 3)).astype(np.int16)

    def walk(row):
        i = 0
        while tree.feature[i] >= 0:
            b = row[tree.feature[i]]
            i = tree.left[i] if (tree.missing_left[i] if b == kernels.MISSING_BIN else b <= tree.bin[i]) else tree.right[i]
        return i

    packed = kernels.pack(np.arange(n), np.zeros(n), np.arange(n) / 2, bins)
    got = list(kernels.chunks(iter([packed.slice(0, 1), packed.slice(1)]), 3))
    assert np.concatenate([g[0] for g in got]).tolist() == list(range(n)) and np.concatenate([g[2] for g in got]).tolist() == (np.arange(n) / 2).tolist()
    assert np.concatenate([tree.route(g[3]) for g in got]).tolist() == [walk(r) for r in bins]


def test_partitions_of_a_learner_grow_in_number(spark, tmp_path):
    from trialwright.session import bounded, spread

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert spread(df, ["id"], 50).rdd.getNumPartitions() == 20
    assert bounded(df, ["id"], 100).rdd.getNumPartitions() == 10 and bounded(df, ["id"], 1000).rdd.getNumPartitions() == 1
