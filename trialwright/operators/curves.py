"""Learning curves, confidence intervals and summaries of methods, times and iterations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialwright.operators.scan import prefix_scan
from trialwright.operators.trials import RUN, best_score_per_run, running_best
from trialwright.session import TASK_ROWS, materialize

Z_95 = 1.96
T_95_10_RUNS = 2.262


def learning_curve(log: DataFrame, z: float = Z_95, n: int | str = "count", by: Sequence[str] = ("experiment",),
                   run: str = "run", task_rows: int = TASK_ROWS) -> DataFrame:
    """Per iteration the mean running best over runs, sample std and half-width ``z * std / sqrt(n)``.

    ``n`` is a fixed number of runs, ``"count"`` (runs alive at the iteration) or ``"measured"`` (rows of
    the method over its last iteration).
    """
    by = list(by)
    curve = running_best(log, [*by, run], task_rows).groupBy(*by, "iter").agg(
        F.avg("best").alias("mean"), F.stddev_samp("best").alias("std"), F.count("best").alias("runs"))
    return _with_interval(curve, z, n, by)


def _with_interval(curve: DataFrame, z: float, n: int | str, by: list[str]) -> DataFrame:
    if n == "measured":
        size = curve.groupBy(*by).agg((F.sum("runs") / F.max("iter")).alias("__n"))
        curve, runs = curve.join(size, by), F.col("__n")
    else:
        runs = F.col("runs") if n == "count" else F.lit(n)
    half = F.coalesce(F.lit(z) * F.col("std") / F.sqrt(runs), F.lit(0.0))
    return curve.withColumn("half", half).select(
        *by, "iter", "mean", "std", "runs",
        (F.col("mean") - F.col("half")).alias("lower"), (F.col("mean") + F.col("half")).alias("upper"))


def extend_runs(log: DataFrame, keys: Sequence[str] = RUN, within: Sequence[str] = ("experiment",),
                expand: bool = True) -> DataFrame:
    """Rows that pad each stopped run to the longest run of its method with its last best.

    ``within`` names the columns inside which the longest run is taken (none: of all runs).  ``expand=False`` returns one row
    (from_iter, to_iter, score) per padded run; expanding writes runs x longest rows, which the curve
    does not need (see ``extended_curve``).
    """
    ends = log.groupBy(*keys).agg(F.max("iter").alias("last"), F.max("score").alias("score"))
    longest = ends.groupBy(*within).agg(F.max("last").alias("to_iter"))
    if within:
        padded = ends.join(longest, list(within))
    else:
        padded = ends.select("*", longest.scalar().alias("to_iter"))
    padded = padded.where(F.col("last") < F.col("to_iter")).select(
        *keys, (F.col("last") + 1).alias("from_iter"), "to_iter", "score")
    if not expand:
        return padded
    return padded.select(*keys, F.explode(F.sequence("from_iter", "to_iter")).alias("iter"), "score")


def extended_curve(log: DataFrame, z: float = Z_95, n: int | str = "count", by: Sequence[str] = ("experiment",),
                   run: str = "run", task_rows: int = TASK_ROWS) -> DataFrame:
    """The learning curve with every stopped run held at its last best, without writing the padding.

    At iteration i the finished runs contribute a running total over runs that ended before i.  Scores
    are centred first, which keeps the sums of squares well conditioned.  The runs' ends (one row per
    run) are written once, as they serve twice.
    """
    by = list(by)
    ends = materialize(log.groupBy(*by, run).agg(F.max("iter").alias("last"), F.max("score").alias("best")), "ends")
    centre = ends.select(F.avg("best").alias("c")).scalar()
    scan = running_best(log, [*by, run], task_rows).withColumn("c", centre)
    live = scan.groupBy(*by, "iter").agg(*_moments(F.col("best") - F.col("c")), F.max("c").alias("c"))
    ended = ends.withColumn("c", centre).groupBy(*by, (F.col("last") + 1).alias("iter")).agg(
        *[m.alias("e" + k) for k, m in zip("n12", _moments(F.col("best") - F.col("c")))])
    both = prefix_scan(live.join(ended, [*by, "iter"], "full"), by,
                       {"s" + k: ("sum", "e" + k) for k in "n12"}, task_rows=task_rows)
    total = {k: F.col("m" + k) + F.coalesce("s" + k, F.lit(0)) for k in "n12"}
    curve = both.where(F.col("mn").isNotNull()).select(*by, "iter", "c", *[total[k].alias("t" + k) for k in "n12"])
    var = (F.col("t2") - F.col("t1") * F.col("t1") / F.col("tn")) / (F.col("tn") - 1)
    curve = curve.select(
        *by, "iter", (F.col("c") + F.col("t1") / F.col("tn")).alias("mean"),
        F.when(F.col("tn") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"), F.col("tn").alias("runs"))
    return _with_interval(curve, z, n, by)


def _moments(x: Column) -> list[Column]:
    return [F.count(x).alias("mn"), F.sum(x).alias("m1"), F.sum(x * x).alias("m2")]


def ci_disjoint(curve: DataFrame, a: str, b: str) -> DataFrame:
    """Whether method a's lower bound is above method b's upper bound at their last iterations."""
    last = curve.groupBy("experiment").agg(F.max_by(F.struct("lower", "upper"), "iter").alias("v"))
    side = lambda name, m: last.where(F.col("experiment") == m).select(
        F.lit(1).alias("__k"), F.col("v.lower").alias(f"lower_{name}"), F.col("v.upper").alias(f"upper_{name}"))
    return side("a", a).join(side("b", b), "__k").select(
        F.lit(a).alias("a"), F.lit(b).alias("b"), "lower_a", "upper_b",
        (F.col("lower_a") > F.col("upper_b")).alias("disjoint"))


def ci_table(summary: DataFrame, z: float = Z_95, n: int = 10) -> DataFrame:
    half = F.lit(z) * F.col("std") / F.sqrt(F.lit(n))
    return summary.select("method", (F.col("mean") - half).alias("lower"),
                          (F.col("mean") + half).alias("upper")).orderBy("method")


# Summaries

def method_summary(log: DataFrame, value: str = "score", by: Sequence[str] = ("experiment",),
                   run: str = "run") -> DataFrame:
    """Mean, sample std, min and max over runs of the best ``value`` per run."""
    per_run = best_score_per_run(log.withColumn("score", F.col(value)), [*by, run])
    return per_run.groupBy(*by).agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"))


def stop_summary(cut: DataFrame, by: Sequence[str] = ("experiment",), run: str = "run") -> DataFrame:
    """Mean and population std, over runs, of iterations used and of best score."""
    per_run = cut.groupBy(*by, run).agg(F.max("iter").alias("iters"), F.max("score").alias("best"))
    return per_run.groupBy(*by).agg(
        F.avg("iters").alias("iters_mean"), F.stddev_pop("iters").alias("iters_std"),
        F.avg("best").alias("score_mean"), F.stddev_pop("best").alias("score_std"))


def iters_report(cut: DataFrame, by: Sequence[str] = ("experiment",), run: str = "run") -> DataFrame:
    """Rounded (half-even) min, mean and max of iterations used."""
    per_run = cut.groupBy(*by, run).agg(F.max("iter").alias("iters"))
    return per_run.groupBy(*by).agg(*[
        F.bround(f(F.col("iters").cast("double"))).cast("bigint").alias(f"iters_{name}")
        for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


TIME_COLUMNS = ("mean_fit_time", "std_fit_time", "mean_score_time", "std_score_time")


def time_totals(log: DataFrame, keys: Sequence[str] = RUN, times: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    """Sum of each time column, NULL counted as 0."""
    return log.groupBy(*keys).agg(*[F.sum(F.coalesce(t, F.lit(0.0))).alias(t) for t in times])


def time_bounds(totals: DataFrame, k: int = 5) -> DataFrame:
    """Total time of k folds: mean, upper and lower bound."""
    mean = F.col("mean_fit_time") + F.col("mean_score_time")
    spread = F.col("std_fit_time") + F.col("std_score_time")
    return totals.withColumns({"time_mean": k * mean, "time_upper": k * (mean + spread),
                               "time_lower": k * (mean - spread)})


def trial_time(k: int = 5) -> Column:
    return k * (F.col("mean_fit_time") + F.col("mean_score_time"))


def stage_time_summary(log: DataFrame, time: str = "trial_time", by: Sequence[str] = ("experiment",),
                       run: str = "run", stage: str = "stage") -> DataFrame:
    """Mean and population std over runs of the time per stage, with the stacked total in seconds and hours."""
    per_run = log.groupBy(*by, run, stage).agg(F.sum(time).alias("t"))
    stages = per_run.groupBy(*by, stage).agg(F.avg("t").alias("mean_time"), F.stddev_pop("t").alias("std_time"))
    upto = W.partitionBy(*by).orderBy(stage).rowsBetween(W.unboundedPreceding, W.currentRow)
    stacked = F.sum("mean_time").over(upto)
    return stages.select(*by, stage, "mean_time", "std_time", stacked.alias("stacked_time"),
                         (stacked / 3600).alias("stacked_hours"))
