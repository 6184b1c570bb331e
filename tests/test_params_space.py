import numpy as np
import pytest
from pyspark.sql import functions as F

from trialwright.functions import params as P
from trialwright.functions.hashing import uniform
from trialwright.operators import space, trials


def test_parse_both_encodings(spark):
    df = spark.createDataFrame([
        ("{'alpha': 0.25, 'lambda': 1e-05}",), ("OrderedDict([('colsample_bytree', 0.5), ('subsample', 7.0)])",),
        ("{'max_depth': 3}",), ("not a dict",), (None,)], "t string")
    got = [r[0] for r in df.select(P.parse_params("t")).collect()]
    assert got == [{"alpha": 0.25, "lambda": 1e-05}, {"colsample_bytree": 0.5, "subsample": 7.0}, {"max_depth": 3.0}, None, None]


def test_columns_and_maps(spark):
    df = spark.createDataFrame([(1.0, None)], "param_a double, param_b double").withColumn("m", P.columns_to_params(["a", "b"]))
    assert df.first()["m"] == {"a": 1.0}
    wide = P.params_to_columns(df.select("m"), ["a", "b"], "m").first()
    assert (wide["param_a"], wide["param_b"]) == (1.0, None)


def test_constants_overwrite_or_fill(spark):
    df = spark.createDataFrame([("x", 5.0), ("y", 5.0), ("x", None)], "experiment string, param_a double")
    over = P.fill_params_const(df, {"x": {"a": 0.0}})
    fill = P.fill_params_const(df, {"x": {"a": 0.0}}, overwrite=False)
    assert [r["param_a"] for r in over.collect()] == [0.0, 5.0, 0.0]
    assert [r["param_a"] for r in fill.collect()] == [5.0, 5.0, 0.0]


def test_scalars(spark):
    row = spark.range(1).select(
        P.round_to_int(F.lit(2.5)).alias("a"), P.round_to_int(F.lit(3.5)).alias("b"),
        P.nan_replacement(F.lit(float("nan"))).alias("c"), P.nan_replacement(F.lit(None).cast("double")).alias("d"),
        P.loss(F.lit(0.75)).alias("e")).first()
    assert tuple(row) == (2, 4, -999.0, -999.0, 0.25)


def test_winner_fills_only_missing_parameters(spark, rows):
    df = spark.createDataFrame(
        [("e", 1, 1, 0.1, 1, 3.0, None, {"a": 3.0}), ("e", 1, 2, 0.9, 1, 4.0, None, {"a": 4.0}),
         ("e", 1, 3, 0.5, 2, None, 7.0, {"b": 7.0})],
        "experiment string, run long, iter long, score double, stage int, param_a double, param_b double, params map<string,double>")
    assert rows(trials.fill_params_from_best(df, ["a", "b"]), "iter", "param_a", "param_b") == [(1, 3.0, 7.0), (2, 4.0, 7.0), (3, 4.0, 7.0)]


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).toDF("k")
    one = {r[0]: r[1] for r in df.repartition(1).select("k", uniform("k", seed=4)).collect()}
    many = {r[0]: r[1] for r in df.repartition(17).select("k", uniform("k", seed=4)).collect()}
    assert one == many
    assert all(0 <= v < 1 for v in one.values())
    assert sum(one.values()) / 1000 == pytest.approx(0.5, abs=0.05)
    assert one != {r[0]: r[1] for r in df.select("k", uniform("k", seed=5)).collect()}


def test_ranges(spark):
    got = space.random_candidates(spark, space.SEARCH_SPACE, 500, seed=1).agg(*[
        f(p.name).alias(f"{n}_{p.name}") for p in space.SEARCH_SPACE for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for p in space.SEARCH_SPACE:
        assert p.lo <= got[f"lo_{p.name}"] and got[f"hi_{p.name}"] < p.hi
    assert (got["lo_max_depth"], got["hi_max_depth"]) == (1, 19)
    both = space.random_candidates(spark, [space.Param("x", "int", 1, 2, inclusive=True)], 50).select("x").distinct().count()
    assert both == 2


def test_grid_order(spark):
    got = [tuple(r) for r in space.grid_candidates(spark, {"a": [1, 2], "b": [5, 6, 7]}).orderBy("trial_id").collect()]
    assert got == [(0, 1.0, 5.0), (1, 1.0, 6.0), (2, 1.0, 7.0), (3, 2.0, 5.0), (4, 2.0, 6.0), (5, 2.0, 7.0)]


def test_distinct_draws(spark):
    small = [space.Param("a", "int", 1, 4), space.Param("b", "choice", values=(1.0, 2.0))]
    got = space.distinct_random_candidates(spark, small, 6)
    assert got.select("a", "b").distinct().count() == 6
    assert [r[0] for r in got.orderBy("trial_id").collect()] == list(range(6))
    with pytest.raises(ValueError, match="6 points"):
        space.distinct_random_candidates(spark, small, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Aggregate" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 350, 1009])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(space.permuted(F.col("id"), n, seed=3)).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert sum(a == b for a, b in enumerate(got)) < 10 and abs(np.corrcoef(range(n), got)[0, 1]) < 0.2


def test_distinct_draws_of_ranges_and_runs(spark):
    mixed = [*space.SEARCH_SPACE, space.Param("c", "choice", values=(2.0, 2.0, 5.0))]
    got = space.distinct_random_candidates(spark, mixed, 400, seed=1).toPandas()
    assert len(got.drop(columns="trial_id").drop_duplicates()) == 400 and set(got["c"]) == {2.0, 5.0}
    for p in space.SEARCH_SPACE:
        assert got[p.name].between(p.lo, p.hi).all() and got[p.name].nunique() > 15
    runs = spark.createDataFrame([(1,), (2,)], "run long")
    small = [space.Param("a", "int", 0, 30)]
    both = space.distinct_random_candidates(spark, small, 30, runs=runs).toPandas().sort_values("trial_id")
    orders = [list(both[both.run == r]["a"]) for r in (1, 2)]
    assert all(sorted(o) == list(range(30)) for o in orders) and orders[0] != orders[1]
    later = space.distinct_random_candidates(spark, small, 10, start=20, runs=runs).toPandas()
    assert set(later[later.run == 1]["a"]) == set(orders[0][20:])


def test_space_and_stage_tables(spark):
    assert space.space_table(spark, space.SEARCH_SPACE).where("stage = 2").count() == 2
    assert [p.name for p in space.stage_space(space.SEARCH_SPACE, 3)] == ["subsample", "colsample_bytree"]
    assert space.stage_modes(spark, ["random", "ei"], [243, 243]).count() == 2
    with pytest.raises(ValueError):
        space.stage_modes(spark, ["random"], [1, 2])
