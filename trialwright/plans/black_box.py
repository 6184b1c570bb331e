"""Objectives that are any function of the parameters: one candidate per task, with a time limit and retries.

A candidate runs in a process of its own beside the task's worker, so one that raises, hangs or dies becomes a trial without a
score.  Candidates go out in waves; every wave's results are written before the next starts, and a resumed search
evaluates only configurations that have no result yet.
"""

from __future__ import annotations

import math
import multiprocessing
import sys
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialwright.operators.scan import number_rows
from trialwright.operators.trials import distinct_configs
from trialwright.plans.search import Objective
from trialwright.session import materialize

# Tasks receive this module's functions with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESULT = "score double, error string, attempts int, seconds double"


def _attempt(fn: Callable[..., float], params: dict[str, float], seconds: float) -> tuple[float | None, str | None]:
    """(score, error) of one call in a process that is killed after ``seconds``."""
    context = multiprocessing.get_context("fork")
    receive, send = context.Pipe(duplex=False)

    def child() -> None:
        try:
            send.send((float(fn(**params)), None))
        except BaseException as error:  # any failure is the candidate's result
            send.send((None, f"{type(error).__name__}: {error}"))

    process = context.Process(target=child)
    process.start()
    send.close()
    try:
        if not receive.poll(seconds):
            return None, f"no result after {seconds:g} s"
        score, error = receive.recv()
    except EOFError:
        return None, "the process ended without a result"
    finally:
        process.kill()
        process.join()
    return (None, error or "not a number") if score is None or math.isnan(score) else (score, None)


def evaluate_each(candidates: DataFrame, fn: Callable[..., float], params: Sequence[str], seconds: float, retries: int) -> DataFrame:
    """(params, score, error, attempts, seconds): ``fn(**params)`` of every row, each row a task of its own."""
    params = list(params)
    numbered = number_rows(candidates.select(*params), [], params, "__n")
    numbered = materialize(numbered, "wave")
    n = numbered.count()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame[params].to_dict("records"):
                start, score, error, attempt = time.perf_counter(), None, None, 0
                while attempt <= retries:
                    attempt += 1
                    score, error = _attempt(fn, row, seconds)
                    if error is None:
                        break
                yield pd.DataFrame([{**row, "score": score, "error": error, "attempts": attempt, "seconds": time.perf_counter() - start}]).astype({"score": float})

    fields = ", ".join(f"`{p}` {t}" for p, t in candidates.select(*params).dtypes)
    each = numbered.repartitionById(max(n, 1), (F.col("__n") - 1).cast("int"))
    return each.mapInPandas(run, f"{fields}, {RESULT}")


def results(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All results so far; ``like`` has the parameters' types."""
    fields = ", ".join(f"`{c}` {t}" for c, t in like.dtypes)
    try:
        return spark.read.schema(f"{fields}, {RESULT}").parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"{fields}, {RESULT}")


def function_objective(fn: Callable[..., float], path: str, seconds: float = 3600.0, retries: int = 1, parallel: int = 64) -> Objective:
    """The objective ``fn(**parameters)``, higher is better; results are kept under ``path``.

    A call that raises, returns no number or takes over ``seconds`` is tried ``retries`` times more and then has no score.
    ``parallel`` candidates make a wave.  A configuration is evaluated once, however often and in whichever search it is asked for.
    """

    def objective(candidates: DataFrame) -> DataFrame:
        spark = candidates.sparkSession
        params = [c for c in candidates.columns if c not in ("trial_id", "run")]
        like = candidates.select(*params)
        while True:
            known = results(spark, path, like)
            left = distinct_configs(candidates, params).join(known, params, "left_anti")
            wave = materialize(left.orderBy("trial_id").limit(parallel), "wave")
            if wave.isEmpty():
                return candidates.join(known, params, "left").select(*candidates.columns, "score", "error")
            evaluate_each(wave, fn, params, seconds, retries).write.mode("append").parquet(path)

    return objective
