"""Relational operators on trial logs.

A trial log has one row per (experiment, run, iter): ``score`` and, as needed, ``stage``, ``params`` and
``param_*`` columns.  NaN scores must be NULL (the readers see to it), so that a failed trial never wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialwright.operators.scan import LONGEST, LONGEST_KEYS, bounded, join_keys, join_runs, longest_run, number_rows, prefix_scan
from trialwright.session import TASK_ROWS, materialize

RUN = ("experiment", "run")
STAGE_SIZE = 243


# Selection and labels

def select_trials(log: DataFrame, experiment: str | None = None, contains: str | None = None,
                  runs: Sequence | None = None, iters: tuple[int, int] | None = None,
                  exclude: Column | None = None) -> DataFrame:
    """Rows matching every given predicate; ``iters`` is inclusive on both ends."""
    if experiment is not None:
        log = log.where(F.col("experiment") == experiment)
    if contains is not None:
        log = log.where(F.col("experiment").contains(contains))
    if runs is not None:
        log = log.where(F.col("run").isin(*runs))
    if iters is not None:
        log = log.where(F.col("iter").between(*iters))
    return log if exclude is None else log.where(~exclude)


def relabel(log: DataFrame, contains: str, label: str) -> DataFrame:
    exp = F.col("experiment")
    return log.withColumn("experiment", F.when(exp.contains(contains), label).otherwise(exp))


def drop_all_null_rows(log: DataFrame) -> DataFrame:
    return log.na.drop(how="all")


def stage_of(iteration="iter", stage_size: int = STAGE_SIZE, stages: int = 3) -> Column:
    """Stage 1..stages of an iteration; the last stage takes everything beyond."""
    iteration = F.col(iteration) if isinstance(iteration, str) else iteration
    return F.least(F.floor((iteration - 1) / stage_size) + 1, F.lit(stages)).cast("int")


def rebase_iter(iteration="iter", stage_size: int = STAGE_SIZE, stages: int = 3) -> Column:
    """Iteration counted from the start of its own stage."""
    iteration = F.col(iteration) if isinstance(iteration, str) else iteration
    return iteration - (stage_of(iteration, stage_size, stages) - 1) * F.lit(stage_size)


def number_trials(log: DataFrame, order: Sequence, keys: Sequence[str] = RUN) -> DataFrame:
    """Iteration 1..n of each run in the given total order."""
    return number_rows(log, keys, order)


# Running best and plateaus

def running_best(log: DataFrame, keys: Sequence[str] = RUN, task_rows: int = TASK_ROWS) -> DataFrame:
    return prefix_scan(log, keys, {"best": ("max", "score")}, task_rows=task_rows)


def scored_scan(log: DataFrame, keys: Sequence[str] = RUN, task_rows: int = TASK_ROWS, keep_pieces: bool = False) -> DataFrame:
    """Running best and ``pos``, the number of scored trials so far."""
    return prefix_scan(log, keys, {"best": ("max", "score"), "pos": ("count", "score")}, task_rows=task_rows, keep_pieces=keep_pieces)


def plateau_lengths(log: DataFrame, keys: Sequence[str] = RUN, task_rows: int = TASK_ROWS) -> DataFrame:
    """Scored trials per running-best value: length, first position and first iteration."""
    scan = scored_scan(log, keys, task_rows).where(F.col("score").isNotNull())
    return scan.groupBy(*keys, "best").agg(
        F.count("*").alias("length"), F.min("pos").alias("first_pos"), F.min("iter").alias("first_iter"))


def longest_plateau(log: DataFrame, keys: Sequence[str] = RUN, per: Sequence[str] = (),
                    task_rows: int = TASK_ROWS) -> DataFrame:
    """Longest plateau that still ended in an improvement, at least 1."""
    plateaus = plateau_lengths(log, keys, task_rows)
    bound = longest_run(log, "iter", keys)
    if bound is not None and bound <= task_rows:
        plateaus = plateaus.withColumn("__final", F.max("best").over(W.partitionBy(*keys)))
    else:
        plateaus = join_keys(plateaus, log.groupBy(*keys).agg(F.max("score").alias("__final")), keys, "inner")
    ended = F.when(F.col("best") < F.col("__final"), F.col("length"))
    return plateaus.groupBy(*per).agg(F.greatest(F.max(ended), F.lit(1)).alias("longest"))


# Best trials

def best_score_per_run(log: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return log.groupBy(*keys).agg(F.max("score").alias("score"))


def best_per_run(log: DataFrame, keys: Sequence[str] = RUN, carry: Sequence[str] = ()) -> DataFrame:
    """Earliest trial with the best score per group, in one pass; ``carry`` adds columns of that trial."""
    best = F.max_by(F.struct("score", "iter", *carry), F.struct(F.col("score"), -F.col("iter")))
    return log.where(F.col("score").isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def best_per_group(log: DataFrame, keys: Sequence[str] = RUN, group: str = "stage") -> DataFrame:
    return best_per_run(log, [*keys, group])


def best_info(log: DataFrame, name: str) -> DataFrame:
    """(run, iter, score, name) of each run's best trial."""
    return best_per_run(log, ["run"]).select("run", "iter", "score", F.lit(name).alias("name"))


def best_rows(log: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Every trial that reaches its run's best score, ties included."""
    return log.join(best_score_per_run(log, keys), [*keys, "score"])


def last_iter_rows(log: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    last = log.groupBy(*keys).agg(F.max("iter").alias("iter"))
    return log.join(last, [*keys, "iter"])


def rank_trials(log: DataFrame, keys: Sequence[str] = ("run", "stage"), task_rows: int = TASK_ROWS) -> DataFrame:
    """Rank by score, best = 1, ties share the lowest rank.

    Groups known to fit a task are ranked by a window.  Otherwise ranks come from the counts of the scores and are joined to the rows:
    scores of more than ``task_rows`` rows, of which there are at most rows / ``task_rows``, by broadcast, the others by shuffle.
    """
    from trialwright.operators.stats import cumulative_counts

    keys = list(keys)
    bound = longest_run(log, "iter", keys) if "iter" in log.columns else None
    if bound is not None and bound <= task_rows:
        window = W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc_nulls_last("score"))
        return log.withColumn("rank", F.rank().over(window).cast("bigint"))
    counts = cumulative_counts(log, "score", keys, True, task_rows)
    ranks = materialize(counts.select(*keys, "score", "n", (F.col("upto") - F.col("n") + 1).alias("rank")), "ranks")
    hot = F.broadcast(ranks.where(F.col("n") > task_rows).drop("n"))
    ranked = join_keys(log, hot, [*keys, "score"])
    rest = join_keys(ranked.where("rank IS NULL").drop("rank"), ranks.where(F.col("n") <= task_rows).drop("n"), [*keys, "score"], "inner")
    return ranked.where("rank IS NOT NULL").unionByName(rest)


def top_k(log: DataFrame, k: int = 5, tie_break: Sequence[str] = ("experiment", "run", "iter")) -> DataFrame:
    return log.orderBy(F.desc_nulls_last("score"), *tie_break).limit(k)


# Combining logs

def union_trials(*logs: DataFrame) -> DataFrame:
    """Concatenate logs by column name; columns a log lacks become NULL."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    if "iter" not in out.columns:
        return out
    # The logs may share runs: a run is at most as long as its parts together.
    measured = [log.schema["iter"].metadata if "iter" in log.columns else {} for log in logs]
    same = all(m.get(LONGEST) is not None and m[LONGEST_KEYS] == measured[0][LONGEST_KEYS] for m in measured)
    bound = sum(m[LONGEST] for m in measured) if same else None
    keys = measured[0][LONGEST_KEYS] if same else []
    return out.select(*[bounded("iter", "iter", bound, keys) if c == "iter" else c for c in out.columns])


def intersect_iters(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    return a.select(*keys, "iter").intersect(b.select(*keys, "iter"))


def drop_overlap(earlier: DataFrame, later: DataFrame, keys: Sequence[str] = ("run",), mode: str = "cut") -> DataFrame:
    """Rows of the earlier stage that the later stage leaves standing.

    ``cut`` ends a run's earlier stage where its later stage begins.  ``intersect`` only removes rows
    whose iteration number occurs in both, so a longer earlier stage keeps its tail.
    """
    keys = list(keys)
    if mode == "intersect":
        return earlier.join(later.select(*keys, "iter").distinct(), [*keys, "iter"], "left_anti").select(earlier.columns)
    if mode != "cut":
        raise ValueError(f"unknown mode {mode!r}")
    return truncate_stage1(earlier, later, keys, keep_unmatched=True)


def truncate_stage1(first: DataFrame, later: DataFrame, keys: Sequence[str] = ("run",),
                    keep_unmatched: bool = False) -> DataFrame:
    """Rows before the run's first iteration in ``later``."""
    keys = list(keys)
    starts = later.groupBy(*keys).agg(F.min("iter").alias("__start"))
    joined = join_runs(first, starts, keys, "left" if keep_unmatched else "inner")
    before = F.col("iter") < F.col("__start")
    return joined.where(F.coalesce(before, F.lit(True)) if keep_unmatched else before).select(first.columns)


def merge_on_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on every column name the two sides share."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("no shared columns")
    return a.join(b, shared)


def distinct_configs(trials: DataFrame, params: Sequence[str], trial_id: str = "trial_id") -> DataFrame:
    """One row per configuration, the lowest trial id kept."""
    return trials.groupBy(*params).agg(F.min(trial_id).alias(trial_id)).select(trial_id, *params)


def except_columns(columns: Sequence[str], *others: Sequence[str]) -> list[str]:
    drop = {c for o in others for c in o}
    return [c for c in columns if c not in drop]


def ordered_summary(summary: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Rows of the named methods in the named order."""
    order = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    return summary.where(F.col("method").isin(*methods)).withColumn("ord", order.cast("int")).orderBy("ord")


# Parameters of winners

def fill_params_from_best(log: DataFrame, names: Sequence[str], keys: Sequence[str] = RUN,
                          prefix: str = "param_") -> DataFrame:
    """NULL parameter columns take the value of the winner of the stage that searched the parameter."""
    winners = best_per_run(log, [*keys, "stage"], carry=["params"])
    per_run = winners.groupBy(*keys).agg(
        *[F.max(F.col("params")[n]).alias(f"__{n}") for n in names])
    filled = {prefix + n: F.coalesce(F.col(prefix + n), F.col(f"__{n}")) for n in names}
    return join_runs(log, per_run, keys).withColumns(filled).select(log.columns)


def fill_from_stage(later: DataFrame, earlier: DataFrame, columns: Sequence[str],
                    keys: Sequence[str] = ("run",)) -> DataFrame:
    """Give the rows of a later stage the columns of the earlier stage's last trial of the same run."""
    last = last_iter_rows(earlier, keys).select(*keys, *columns)
    return join_runs(later.drop(*columns), last, keys, "inner")
