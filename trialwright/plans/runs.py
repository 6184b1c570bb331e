"""Many runs of a staged search at once.

Every run is a row of a frontier table: its stage budget, the trials done, its best score, when it was reached, and the
winning parameters frozen so far.  One batch of all runs is one candidate table and one call of the objective; the frontier
is advanced by aggregates over that batch alone and one join.  Runs whose best has held leave the frontier by an anti-join.
Budgets are columns, so runs may differ in the length of every stage: a stage that ends early leaves more to the next.

The driver holds the number of open runs and nothing else.  Scored batches are files of one log, each written once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialwright.functions.hashing import uniform
from trialwright.operators.propose import config_history, propose_ei, propose_tpe, top_proposals
from trialwright.operators.scan import join_keys, number_rows, prefix_scan
from trialwright.operators.space import BUDGET, Param, shared_budget
from trialwright.plans.search import Objective, nan_to_null
from trialwright.session import materialize, scratch_path

# Candidates that one row of a run's budget becomes at once; longer budgets are dealt out in several rows first.
DEAL_ROWS = 1_000
FRONTIER = "offset bigint, budget bigint, done bigint, scored bigint, best double, best_pos bigint, best_trial bigint, frozen map<string,double>"

# Candidates (run, trial_id, one column per parameter, frozen ones too) to rows (run, trial_id, score, ...).
RunsObjective = Callable[[DataFrame], DataFrame]


@dataclass
class RunStage:
    """One group of parameters of all runs, and when a run leaves it.

    ``max_no_improve`` ends a run's stage online, after so many scored trials without a better one.  ``global_best`` lets every
    run use its budget and afterwards cuts it ``global_best - 1`` trials after the best trial of the whole stage.
    """

    space: Sequence[Param]
    mode: str = "random"  # random, ei or tpe
    batch: int = 50
    initial: int = 10
    pool: int = 256
    max_no_improve: int | None = None
    global_best: int | None = None


@dataclass
class RunsResult:
    """``log``: (run, stage, iter, trial_id, params, score, carried columns).  ``runs``: (run, stages' trials, params, best score)."""

    log: DataFrame
    runs: DataFrame


def deal(runs: DataFrame, first: Column, end: Column, name: str = "trial_id", rows: int = DEAL_ROWS) -> DataFrame:
    """Every row of ``runs`` once for each number from ``first`` to ``end`` - 1, in pieces of ``rows`` numbers that any task may take."""
    spans = runs.withColumns({"__first": first.cast("bigint"), "__end": end.cast("bigint")}).where("__first < __end")
    piece = F.explode(F.sequence(F.floor(F.col("__first") / rows), F.floor((F.col("__end") - 1) / rows)))
    pieces = spans.withColumn("__piece", piece).repartition("run", "__piece")
    numbers = F.sequence(F.greatest("__first", F.col("__piece") * rows), F.least(F.col("__end"), (F.col("__piece") + 1) * rows) - 1)
    return pieces.withColumn(name, F.explode(numbers)).drop("__first", "__end", "__piece")


def open_runs(runs: DataFrame, budget: int) -> DataFrame:
    """The frontier of runs (column run) before their first trial."""
    start = {"offset": 0, "budget": budget, "done": 0, "scored": 0, "best": None, "best_pos": None, "best_trial": None}
    kinds = dict(c.split(" ") for c in FRONTIER.split(", ")[:-1])
    return runs.select("run", *[F.lit(v).cast(kinds[c]).alias(c) for c, v in start.items()],
                       F.create_map().cast("map<string,double>").alias("frozen"))


def draw(frontier: DataFrame, stage: RunStage, first: Column, end: Column, seed: int) -> DataFrame:
    """(run, trial_id, parameters): random draws numbered from ``first`` to ``end`` - 1 of each run."""
    numbered = deal(frontier.select("run", "done", "budget"), first, end).select("run", "trial_id")
    return numbered.select("run", "trial_id", *[p.draw(uniform("run", "trial_id", F.lit(p.name), seed=seed)).alias(p.name) for p in stage.space])


def next_candidates(frontier: DataFrame, stage: RunStage, log: DataFrame | None, seed: int) -> DataFrame:
    """(run, trial_id, parameters of the stage): each open run's next trials, up to a batch and its budget."""
    n = stage.batch if log is not None or stage.mode == "random" else min(stage.batch, stage.initial)
    end = F.least(F.col("done") + n, F.col("budget"))
    if stage.mode == "random" or log is None:
        return draw(frontier, stage, F.col("done"), end, seed)
    names = [p.name for p in stage.space]
    history = config_history(log.select("run", *[F.col("params")[c].alias(c) for c in names], "score"), names)
    tried = log.select("run", *[F.col("params")[c].alias(c) for c in names]).distinct()
    pool = draw(frontier, stage, F.col("done") * stage.pool, F.col("done") * stage.pool + stage.pool, seed + 1)
    pool = pool.groupBy("run", *names).agg(F.min("trial_id").alias("trial_id"))
    pool = join_keys(pool, tried, ["run", *names], "left_anti")
    scored, value = ((propose_tpe(history, pool, stage.space), "log_ratio") if stage.mode == "tpe" else (propose_ei(history, pool, stage.space), "ei"))
    best = number_rows(top_proposals(scored, value, n).withColumnRenamed("trial_id", "__id"), ["run"], [F.desc_nulls_last(value), "__id"], "__k")
    numbered = join_keys(best.select("run", "__k", *names), frontier.select("run", "done", "budget"), ["run"], "inner")
    return numbered.withColumn("trial_id", F.col("done") + F.col("__k") - 1).where("trial_id < budget").select("run", "trial_id", *names)


def advance(frontier: DataFrame, scored: DataFrame, n: int | None) -> tuple[DataFrame, DataFrame]:
    """(frontier, rows kept) after a batch of scored trials (run, trial_id, score, ...); ``n`` is the online stop.

    A run's best and its place go on from the frontier.  The run stops at the n-th scored trial after a best that none
    of them beats; what was scored beyond is dropped.  Trials without a score count against the budget only.
    """
    carried = {"scored": "__c_scored", "best": "__c_best", "best_pos": "__c_pos", "best_trial": "__c_trial"}
    rows = join_keys(scored, frontier.select("run", *[F.col(c).alias(a) for c, a in carried.items()]), ["run"], "inner")
    scan = prefix_scan(rows, ["run"], {"top": ("max", "score"), "pos": ("count", "score")}, order="trial_id")
    scan = materialize(scan.withColumns({"top": F.greatest("top", "__c_best"), "pos": F.col("pos") + F.col("__c_scored")}), "scan")
    # Plateaus follow one another: a later one has a higher best, place and trial, so the last of each is a maximum.
    held = F.col("top") == F.col("__c_best")
    plateaus = scan.where(F.col("score").isNotNull()).groupBy("run", "top").agg(
        F.coalesce(F.max(F.when(held, F.col("__c_pos"))), F.min("pos")).alias("first_pos"),
        F.coalesce(F.max(F.when(held, F.col("__c_trial"))), F.min("trial_id")).alias("first_trial"), F.max("pos").alias("last_pos"))
    reached = F.when(F.col("last_pos") >= F.col("first_pos") + n, F.col("first_pos") + n) if n else F.lit(None).cast("bigint")
    stops = plateaus.groupBy("run").agg(F.min(reached).alias("__stop"))
    before = F.col("__stop").isNull() | (F.col("first_pos") <= F.col("__stop"))
    ahead = join_keys(plateaus, stops, ["run"]).where(before).groupBy("run").agg(
        F.max("top").alias("__top"), F.max("first_pos").alias("__first"), F.max("first_trial").alias("__at"))
    kept = join_keys(scan, stops, ["run"]).where(
        F.col("__stop").isNull() | (F.col("pos") < F.col("__stop")) | ((F.col("pos") == F.col("__stop")) & F.col("score").isNotNull()))
    done = kept.groupBy("run").agg((F.max("trial_id") + 1).alias("__done"), F.max("pos").alias("__now"), F.max("__stop").alias("__stop"))
    out = join_keys(join_keys(frontier, done, ["run"]), ahead, ["run"]).select(
        # A run that stopped, or got no candidate any more, has used its budget up.
        "run", "offset", F.when(F.col("__stop").isNotNull() | F.col("__done").isNull(), F.coalesce("__done", "done")).otherwise(F.col("budget")).alias("budget"),
        F.coalesce("__done", "done").alias("done"), F.coalesce("__now", "scored").alias("scored"), F.coalesce("__top", "best").alias("best"),
        F.coalesce("__first", "best_pos").alias("best_pos"), F.coalesce("__at", "best_trial").alias("best_trial"), "frozen")
    return out, kept.select(scored.columns)


def run_stage(frontier: DataFrame, objective: RunsObjective, stage: RunStage, frozen: Sequence[str], seed: int, path: str,
              carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(frontier, log) after all runs have left the stage.  ``frozen`` names the parameters of earlier stages.

    Without any budget left there is no log.
    """
    spark, names = frontier.sparkSession, [p.name for p in stage.space]
    number, log = 0, None
    active, ended = frontier.where("done < budget"), frontier.where("done >= budget")
    while not active.isEmpty():
        batch = next_candidates(active, stage, log, seed)
        batch = join_keys(batch, active.select("run", "frozen"), ["run"], "inner")
        batch = materialize(batch.select("run", "trial_id", *names, *[F.col("frozen")[c].alias(c) for c in frozen if c not in names]), "candidates")
        got = objective(batch).select("run", "trial_id", nan_to_null("score").alias("score"), *carry)
        params = F.create_map(*[x for c in batch.columns[2:] for x in (F.lit(c), F.col(c).cast("double"))]).alias("params")
        scored = join_keys(batch.select("run", "trial_id", params), got, ["run", "trial_id"])
        ahead, kept = advance(active, materialize(scored, "scored"), stage.max_no_improve)
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")
        ahead = materialize(ahead, "frontier")
        left = ahead.where("done >= budget")
        ended = ended.unionByName(left)
        active = join_keys(ahead, left.select("run"), ["run"], "left_anti")
        number += 1
        log = spark.read.schema(kept.schema).parquet(path)
    ended = materialize(ended, "frontier")
    if stage.global_best and log is not None:
        last = F.least(F.col("best_trial") + stage.global_best, F.col("done"))
        ended = ended.withColumn("done", F.coalesce(last, "done"))
        log = join_keys(log, ended.select("run", F.col("done").alias("__done")), ["run"], "inner").where("trial_id < __done").drop("__done")
    return ended, log


def search_runs(runs: DataFrame, objective: RunsObjective, stages: Sequence[RunStage], first_budget: int = BUDGET // 3, budget: int = BUDGET,
                fixed: dict[str, float] | None = None, seed: int = 0, carry: Sequence[str] = ()) -> RunsResult:
    """Search all ``runs`` (column run) stage by stage; each run freezes its own winners and keeps its own budgets.

    The first stage has ``first_budget`` trials; each later one has its share of what is left of ``budget``: half, to even,
    before the last of three stages, all in the last.  ``carry`` names columns of the objective's result that the log keeps.
    """
    spark = runs.sparkSession
    path = scratch_path(spark, "runs")
    frontier = materialize(open_runs(runs.select("run").distinct(), first_budget), "frontier")
    known = list(fixed or {})
    if known:
        constants = F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), F.lit(float(v)))])
        frontier = frontier.withColumn("frozen", constants)
    logs, summary = [], None
    for i, stage in enumerate(stages, 1):
        after, log = run_stage(frontier, objective, stage, known, seed + i, f"{path}/stage={i}", carry)
        if log is None:
            break
        log = materialize(join_keys(log, after.select("run", "offset"), ["run"], "inner").select(
            "run", F.lit(i).alias("stage"), (F.col("offset") + F.col("trial_id") + 1).alias("iter"), "trial_id", "params", "score", *carry), "stage_log")
        logs.append(log)
        winners = join_keys(after, log.select("run", F.col("trial_id").alias("best_trial"), "params"), ["run", "best_trial"])
        known += [p.name for p in stage.space if p.name not in known]
        used = F.col("offset") + F.col("done")
        frontier = materialize(winners.select(
            "run", used.alias("offset"), shared_budget(used, len(stages) - i, budget).alias("budget"), F.lit(0).cast("bigint").alias("done"),
            F.lit(0).cast("bigint").alias("scored"), *[F.lit(None).cast(t).alias(c) for c, t in (("best", "double"), ("best_pos", "bigint"), ("best_trial", "bigint"))],
            F.coalesce("params", "frozen").alias("frozen"), F.col("best").alias("__best"), F.col("done").alias("__trials")), "frontier")
        stage_best = frontier.select("run", F.lit(i).alias("stage"), F.col("__best").alias("best"), F.col("__trials").alias("trials"))
        summary = stage_best if summary is None else summary.unionByName(stage_best)
        frontier = frontier.drop("__best", "__trials")
    if not logs:
        raise ValueError("no run has a budget")
    trials = summary.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "trials")))).alias("trials"), F.max("best").alias("best"))
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return RunsResult(out, join_keys(trials, frontier.select("run", F.col("frozen").alias("params")), ["run"]))


def across_runs(objective: Objective) -> RunsObjective:
    """An objective over (trial_id, parameters) for candidates of many runs: they are numbered through and named back."""

    def score(candidates: DataFrame) -> DataFrame:
        numbered = materialize(number_rows(candidates, [], ["run", "trial_id"], "__id"), "numbered")
        scored = objective(numbered.drop("run", "trial_id").withColumnRenamed("__id", "trial_id")).drop(*[c for c in candidates.columns if c != "trial_id"])
        return numbered.select("run", F.col("trial_id").alias("__trial"), "__id").join(scored.withColumnRenamed("trial_id", "__id"), "__id").drop("__id").withColumnRenamed("__trial", "trial_id")

    return score
