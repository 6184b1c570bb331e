"""Searches: batches of candidates, stages that freeze their winners, early stop, resume.

The driver holds the stage state only.  A batch of candidates is a table; cross-validation of all its
(trial, fold) pairs is one dataflow; finished trials are a log on disk.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialwright.operators.boost import Binned, fit_boosted, pair_batches
from trialwright.operators.evaluate import fold_summary
from trialwright.operators.propose import (
    config_history, epsilon_greedy, propose_batch, propose_ei, propose_tpe, top_proposals)
from trialwright.operators.space import Param, distinct_random_candidates, grid_candidates, random_candidates
from trialwright.operators.stop import plateau_stop
from trialwright.operators.trials import distinct_configs, union_trials
from trialwright.session import materialize, scratch_path

MAX_TRIALS = 100_000
PAIRS_PER_PASS = 64

# DataFrame of candidates (trial_id and one column per parameter) to a log with trial_id, score, ...
Objective = Callable[[DataFrame], DataFrame]


def candidate_params(candidates: DataFrame, frozen: Mapping[str, float] | None = None, max_trials: int = MAX_TRIALS) -> dict[int, dict[str, float]]:
    """The batch as driver state; its size is a search budget and is checked."""
    rows = candidates.limit(max_trials + 1).collect()
    if len(rows) > max_trials:
        raise ValueError(f"more than {max_trials} candidates in one batch")
    names = [c for c in candidates.columns if c not in ("trial_id", "run")]
    return {r["trial_id"]: {**(frozen or {}), **{n: r[n] for n in names}} for r in rows}


def cross_validate(data: Binned, candidates: DataFrame, k: int, frozen: Mapping[str, float] | None = None,
                   seed: int = 0, pairs_per_pass: int = PAIRS_PER_PASS) -> tuple[DataFrame, DataFrame]:
    """(log, metrics) of every candidate over folds 0..k-1.

    ``metrics`` is (trial_id, fold, round, isTest, metric, value) for every boosting round; the log takes
    the last.  Times are the pass's wall time divided by its fits.
    """
    spark = data.table.sparkSession
    params = candidate_params(candidates, frozen)
    parts, times = [], []
    for batch in pair_batches(params, range(k), max(data.classes, 1), pairs_per_pass):
        start = time.perf_counter()
        fitted = fit_boosted(data, batch, range(k), seed)
        fit_seconds = (time.perf_counter() - start) / (len(batch) * k)
        start = time.perf_counter()
        parts.append(materialize(fitted.scores(), "metrics"))
        score_seconds = (time.perf_counter() - start) / (len(batch) * k)
        times += [(t, fit_seconds, score_seconds) for t in batch]
    metrics = union_trials(*parts)
    final = metrics.groupBy("trial_id", "fold", "isTest", "metric").agg(F.max_by("value", "round").alias("value"))
    summary = fold_summary(final, "accuracy" if data.classes else "r2")
    seconds = spark.createDataFrame(times, "trial_id long, mean_fit_time double, mean_score_time double")
    log = candidates.join(summary, "trial_id").join(F.broadcast(seconds), "trial_id")
    for name, value in (frozen or {}).items():
        log = log.withColumn(name, F.lit(float(value)))
    return log, metrics


def cv_objective(data: Binned, k: int, seed: int = 0, pairs_per_pass: int = PAIRS_PER_PASS,
                 metrics_path: str | None = None) -> Callable[[Mapping[str, float]], Objective]:
    """Objective factory of the booster: frozen parameters to cross-validated scores of candidates.

    ``pairs_per_pass`` is the number of (trial, fold) pairs that grow together.  With ``metrics_path`` the metrics of every round are
    appended there, one set of files a batch.
    """

    def factory(frozen: Mapping[str, float]) -> Objective:
        def objective(candidates: DataFrame) -> DataFrame:
            log, metrics = cross_validate(data, candidates, k, frozen, seed, pairs_per_pass)
            if metrics_path is not None:
                params = {c for c in candidates.columns if c != "trial_id"}
                named = metrics.join(candidates, "trial_id").withColumns({n: F.lit(float(v)) for n, v in frozen.items() if n not in params})
                columns = sorted(set(named.columns) - set(metrics.columns))
                pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
                named.select(*metrics.columns, pairs.alias("params")).write.mode("append").parquet(metrics_path)
            return log

        return objective

    return factory


def nan_to_null(score: str) -> Column:
    """A NaN score would sort above every other; NULL never wins."""
    return F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))


def skip_finished(candidates: DataFrame, finished: DataFrame | None, params: Sequence[str]) -> DataFrame:
    """Candidates whose configuration has no finished trial."""
    if finished is None:
        return candidates
    return candidates.join(finished.select(*params).distinct(), list(params), "left_anti")


@dataclass
class Stage:
    """One group of parameters: how it is proposed, its budget and its online stop."""

    space: Sequence[Param]
    budget: int
    mode: str = "random"  # random, distinct, grid, ei or tpe
    grid: Mapping[str, Sequence[float]] | None = None
    initial: int = 10
    batch: int = 10
    pool: int = 256
    epsilon: float = 0.0
    max_no_improve: int | None = None
    believe: str | None = None  # mean or best: trials of a batch are picked one after another, each believed (mode ei)


@dataclass
class SearchResult:
    log: DataFrame
    best_params: dict[str, float]
    best_score: float | None
    seconds: float
    stage_winners: list[dict[str, float]] = field(default_factory=list)


def propose(spark: SparkSession, stage: Stage, finished: DataFrame | None, done: int, n: int, seed: int,
            start: int | None = None) -> DataFrame:
    """The next n candidates of a stage after ``done`` trials, numbered from ``start`` (``done`` if not given).

    Grids and distinct draws have their numbers from the start; the lowest ones without a trial come next.
    """
    start = done if start is None else start
    if stage.mode in ("grid", "distinct"):
        every = (grid_candidates(spark, stage.grid) if stage.mode == "grid" else
                 distinct_random_candidates(spark, stage.space, stage.budget, seed))
        left = every if finished is None else every.join(finished.select("trial_id"), "trial_id", "left_anti")
        return left.orderBy("trial_id").limit(n)
    fresh = random_candidates(spark, stage.space, n, seed, start=start)
    if stage.mode == "random" or finished is None or done < stage.initial:
        return fresh
    names = [p.name for p in stage.space]
    history = config_history(finished, names, ())
    if math.prod(p.size for p in stage.space) <= max(stage.pool, 2 * done):
        # Draws could all be finished; so few points are all looked at.
        pool = grid_candidates(spark, {p.name: p.points for p in stage.space})
    else:
        pool = random_candidates(spark, stage.space, stage.pool, seed + 1, start=start * stage.pool)
    pool = skip_finished(distinct_configs(pool, names), finished, names)
    if stage.mode == "ei" and stage.believe:
        best = propose_batch(history, pool, stage.space, n, (), stage.believe).drop("ei", "pick")
    else:
        scored, value = ((propose_tpe(history, pool, stage.space, ()), "log_ratio") if stage.mode == "tpe"
                         else (propose_ei(history, pool, stage.space, ()), "ei"))
        best = top_proposals(scored, value, n, ()).drop(value)
    best = _renumber(best, start)
    return epsilon_greedy(best, fresh, stage.epsilon, seed, ["trial_id"]) if stage.epsilon else best


def _renumber(candidates: DataFrame, start: int) -> DataFrame:
    from trialwright.operators.scan import number_rows

    numbered = number_rows(candidates.withColumnRenamed("trial_id", "__id"), [], ["__id"], "trial_id")
    return numbered.withColumn("trial_id", F.col("trial_id") - 1 + start).select(
        "trial_id", *[c for c in candidates.columns if c != "trial_id"])


def search_stage(spark: SparkSession, objective: Objective, stage: Stage, seed: int = 0,
                 finished: DataFrame | None = None,
                 on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run one stage to its budget or stop and return its log (iter = trial_id + 1).

    ``finished`` resumes: its trials count against the budget and feed the proposals, and new ones are numbered
    after them.  A candidate whose score is NaN or that the objective leaves out is a trial with a NULL score.
    """
    log, done, start, path, batches = finished, 0, 0, scratch_path(spark, "log"), 0
    if finished is not None:
        done, last = finished.agg(F.count("*"), F.max("trial_id")).first()
        start = 0 if last is None else last + 1
    model_based = stage.mode in ("ei", "tpe")
    while done < stage.budget:
        if stage.max_no_improve or model_based:
            n = stage.batch if done >= stage.initial or not model_based else stage.initial - done
            n = min(n, stage.budget - done)
        else:
            n = stage.budget - done
        batch = materialize(propose(spark, stage, log, done, n, seed, start), "candidates")
        got, last = batch.agg(F.count("*"), F.max("trial_id")).first()
        if not got:
            break
        scored = materialize(objective(batch).withColumn("score", nan_to_null("score")), "scored")
        unscored = batch.join(scored.select("trial_id"), "trial_id", "left_anti")
        scored = union_trials(scored, unscored).withColumn("iter", F.col("trial_id") + 1)
        # Each batch is written once, beside those before it.
        scored.write.mode("overwrite").parquet(f"{path}/batch={batches}")
        batches += 1
        new = spark.read.schema(scored.schema).parquet(path).select(scored.columns)
        log = new if finished is None else union_trials(finished, new)
        done, start = done + got, max(start, last + 1)
        if on_batch:
            on_batch(log, done)
        if stage.max_no_improve and no_improvement(log, stage.max_no_improve):
            break
    if stage.max_no_improve and no_improvement(log, stage.max_no_improve):
        stop = plateau_stop(log.withColumn("run", F.lit(1)), stage.max_no_improve + 1, ["run"]).first()["stop_pos"]
        log = log.where(F.col("iter") <= stop)
    return log


def no_improvement(log: DataFrame, n: int) -> bool:
    """Whether some best trial was followed by n trials without a better one."""
    row = plateau_stop(log.withColumn("run", F.lit(1)), n + 1, ["run"]).first()
    return bool(row and row["stopped"])


def winner(log: DataFrame, params: Sequence[str]) -> tuple[dict[str, float], float | None]:
    row = log.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "iter").select("score", *params).first()
    return ({}, None) if row is None else ({p: row[p] for p in params}, row["score"])


def grouped_search(spark: SparkSession, objective: Callable[[Mapping[str, float]], Objective], stages: Sequence[Stage],
                   fixed: Mapping[str, float] | None = None, seed: int = 0,
                   on_batch: Callable[[DataFrame, int], None] | None = None) -> SearchResult:
    """Tune one group of parameters after another; each stage starts from the winners of those before.

    ``objective`` makes a stage's objective from the parameters frozen so far (``cv_objective`` for the booster).
    """
    start = time.perf_counter()
    frozen: dict[str, float] = dict(fixed or {})
    logs, winners, offset = [], [], 0
    best: tuple[dict[str, float], float | None] = ({}, None)
    for i, stage in enumerate(stages, 1):
        names = [p.name for p in stage.space] or list(stage.grid or {})
        log = search_stage(spark, objective(dict(frozen)), stage, seed + i, on_batch=on_batch)
        values, score = winner(log, names)
        frozen.update(values)
        winners.append(values)
        if best[1] is None or (score is not None and score > best[1]):
            best = ({n: v for n, v in frozen.items() if n not in (fixed or {})}, score)
        logs.append(log.withColumns({"stage": F.lit(i), "iter": F.col("iter") + offset}))
        offset += log.count()
    return SearchResult(union_trials(*logs), best[0], best[1], time.perf_counter() - start, winners)
