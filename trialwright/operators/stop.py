"""Early-stop rules on recorded logs, and stitching of stage logs.

Two rules exist and do not agree.  ``plateau`` stops once the running best has held for N scored trials.
``global_best`` finds the best trial of the whole range and allows N - 1 more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialwright.operators.scan import PIECES, join_runs, longest_run, number_rows
from trialwright.operators.trials import RUN, STAGE_SIZE, best_per_run, scored_scan, union_trials
from trialwright.session import TASK_ROWS


def plateau_stop(log: DataFrame, n: int, keys: Sequence[str] = RUN, on_missing: str = "keep",
                 task_rows: int = TASK_ROWS) -> DataFrame:
    """``stop_pos`` per run: the n-th scored trial of its first plateau of at least n.

    Only plateau counts leave the scan, so this aggregates map-side however long a run is.  A run
    without such a plateau stops at its end (0 without a scored trial), or raises with ``on_missing="error"``.
    """
    scored = F.when(F.col("score").isNotNull(), F.col("pos"))
    plateaus = scored_scan(log, keys, task_rows).groupBy(*keys, "best").agg(
        F.count("score").alias("length"), F.min(scored).alias("first_pos"))
    first = F.min(F.when(F.col("length") >= n, F.col("first_pos"))) + (n - 1)
    end = F.coalesce(F.max(F.col("first_pos") + F.col("length") - 1), F.lit(0))
    missing = {"keep": F.col("end_pos"), "error": F.raise_error(F.lit(f"no plateau of {n} trials")).cast("bigint")}
    return plateaus.groupBy(*keys).agg(first.alias("__stop"), end.alias("end_pos")).select(
        *keys, F.coalesce("__stop", missing[on_missing]).alias("stop_pos"), "end_pos",
        F.col("__stop").isNotNull().alias("stopped"))


def stop_at_plateau(log: DataFrame, n: int, keys: Sequence[str] = RUN, on_missing: str = "keep",
                    task_rows: int = TASK_ROWS) -> DataFrame:
    """The log up to each run's plateau stop, with running best and position.

    Runs known to fit a task are cut by windows alone, over the one shuffle the scan needs; otherwise the
    stops are aggregated and joined back piece by piece, where the scan left the rows.
    """
    scan = scored_scan(log, keys, task_rows, keep_pieces=True)
    bound = longest_run(log, "iter", keys)
    if bound is not None and bound <= task_rows:
        plateau, run = W.partitionBy(*keys, "best"), W.partitionBy(*keys)
        counted = scan.withColumns({
            "__length": F.count("score").over(plateau),
            "__first": F.min(F.when(F.col("score").isNotNull(), F.col("pos"))).over(plateau)})
        reached = F.min(F.when(F.col("__length") >= n, F.col("__first"))).over(run) + (n - 1)
        cut = counted.withColumn("__stop", reached)
        missing = F.col("pos") if on_missing == "keep" else F.raise_error(F.lit(f"no plateau of {n} trials")).cast("bigint")
        return cut.where(F.col("pos") <= F.coalesce("__stop", missing)).select(scan.columns)
    stops = plateau_stop(log, n, keys, on_missing, task_rows).select(*keys, "stop_pos")
    return join_runs(scan, stops, keys, task_rows=task_rows).where(
        F.col("pos") <= F.coalesce("stop_pos", "pos")).select([c for c in scan.columns if c not in PIECES])


def global_best_stop(log: DataFrame, n: int, left: int | None = None, right: int | None = None,
                     keys: Sequence[str] = ("run",), carry: Sequence[str] = ()) -> DataFrame:
    """Best trial of each run within [left, right] and ``last_iter = min(iter + n - 1, right)``.

    Without ``right`` a run's own last iteration bounds it.
    """
    if left is not None:
        log = log.where(F.col("iter") >= left)
    if right is not None:
        log = log.where(F.col("iter") <= right)
    scored = F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("iter")))
    found = log.groupBy(*keys).agg(
        F.max_by(F.struct("score", "iter", *carry), scored).alias("b"), F.max("iter").alias("__end"))
    bound = F.lit(right).cast("bigint") if right is not None else F.col("__end")
    return found.select(*keys, F.col("b.iter").alias("best_iter"), F.col("b.score").alias("best_score"),
                        *[F.col(f"b.{c}").alias(c) for c in carry],
                        F.least(F.col("b.iter") + (n - 1), bound).alias("last_iter"))


def stop_rule(log: DataFrame, n: int, mode: str = "plateau", keys: Sequence[str] = ("run",),
              left: int | None = None, right: int | None = None) -> DataFrame:
    """(keys, last_iter) under either rule, so that methods can be cut alike."""
    if mode == "global_best":
        return global_best_stop(log, n, left, right, keys).select(*keys, "last_iter")
    if mode != "plateau":
        raise ValueError(f"unknown mode {mode!r}")
    if left is not None:
        log = log.where(F.col("iter") >= left)
    if right is not None:
        log = log.where(F.col("iter") <= right)
    return stop_at_plateau(log, n, keys).groupBy(*keys).agg(F.max("iter").alias("last_iter"))


def cut_stage(log: DataFrame, stops: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Rows up to ``last_iter`` of their run; runs without a stop stay whole."""
    stops = stops.select(*keys, F.col("last_iter").alias("__last"))
    return join_runs(log, stops, keys).where(
        F.col("iter") <= F.coalesce("__last", "iter")).select(log.columns)


def stitch_stages(stages: Sequence[DataFrame], n: int, mode: str = "global_best",
                  keys: Sequence[str] = ("run",)) -> DataFrame:
    """Cut every stage log at its stop, join them in order and renumber each run 1..n."""
    cut = [cut_stage(s, stop_rule(s, n, mode, keys), keys).withColumn("stage", F.lit(i))
           for i, s in enumerate(stages, 1)]
    joined = union_trials(*cut).withColumnRenamed("iter", "stage_iter")
    bounds = [longest_run(s, "iter", keys) for s in stages]
    return number_rows(joined, keys, ["stage", "stage_iter"], at_most=None if None in bounds else sum(bounds))


def select_stage_log(original: DataFrame, rerun: DataFrame, stops: Sequence[DataFrame],
                     stage_size: int = STAGE_SIZE, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Per run the original stage log if every earlier stage ran in full, else the rerun."""
    keys = list(keys)
    full = None
    for s in stops:
        ran = s.where(F.col("last_iter") == stage_size).select(*keys)
        full = ran if full is None else full.join(ran, keys)
    return union_trials(join_runs(original, full, keys, "left_semi"), join_runs(rerun, full, keys, "left_anti"))


def assemble_group_logs(stages: Sequence[DataFrame], keys: Sequence[str] = ("run",)) -> DataFrame:
    """One log per run from its stage logs; runs that miss a stage are left out."""
    log = union_trials(*[s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages, 1)])
    seen = log.groupBy(*keys, "stage").count().groupBy(*keys).agg(F.count("*").alias("__stages"))
    whole = seen.where(F.col("__stages") == len(stages)).select(*keys)
    return join_runs(log, whole, keys, "left_semi")


def missing_runs(log: DataFrame, expected: Sequence[int] | DataFrame = range(1, 11)) -> DataFrame:
    """Expected runs, listed or in a table's column run, without a row in the log."""
    spark = log.sparkSession
    if isinstance(expected, DataFrame):
        wanted = expected.select(F.col("run").cast("bigint").alias("run")).distinct()
    else:
        wanted = spark.range(min(expected), max(expected) + 1).toDF("run").where(F.col("run").isin(*expected))
    return wanted.join(log.select(F.col("run").cast("bigint").alias("run")).distinct(), "run", "left_anti")


def best_params_and_stop(log: DataFrame, n: int, left: int, right: int, mode: str = "global_best",
                         keys: Sequence[str] = ("run",)) -> DataFrame:
    """Winning parameters per run within [left, right] and the last iteration to count."""
    inside = log.where(F.col("iter").between(left, right))
    if mode == "global_best":
        return global_best_stop(inside, n, right=right, keys=keys, carry=["params"])
    cut = stop_at_plateau(inside, n, keys)
    best = best_per_run(cut, keys, carry=["params"])
    last = cut.groupBy(*keys).agg(F.max("iter").alias("last_iter"))
    return best.join(last, list(keys)).select(
        *keys, F.col("iter").alias("best_iter"), F.col("score").alias("best_score"), "params", "last_iter")
