"""Early stop of searches that run, on keyed state.

Each task first packs the steps it reads into segments, one per run and stretch, with what the rule needs of them: how many scored
steps, and where the best rose.  Only segments reach a run's state, so a busy run's steps are read by many tasks and its state is
advanced by one segment at a time.  The steps travel inside the segment and are unpacked only where segments overlap, repeat steps
already seen, or hold the stop itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Tasks receive this module's functions with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Steps of one segment.
SEGMENT = 10_000
# Steps that a task packs at once: the more, the fewer segments a run has.
FRAME = 100_000
_STATE = "best double, held long, last long, stopped boolean"
SEGMENTS = "first long, last long, scored long, rise_at binary, rise_to binary, iters binary, scores binary"


def pack(iters: np.ndarray, scores: np.ndarray) -> dict[str, Any]:
    """A segment from steps in ascending order; NaN is a step without a score."""
    known = ~np.isnan(scores)
    best = np.maximum.accumulate(scores[known])
    rises = np.flatnonzero(np.append(True, best[1:] > best[:-1])) if len(best) else np.zeros(0, np.int64)
    return {"first": int(iters[0]), "last": int(iters[-1]), "scored": int(known.sum()), "rise_at": rises.astype(np.int64).tobytes(),
            "rise_to": best[rises].tobytes(), "iters": iters.tobytes(), "scores": scores.tobytes()}


def unpack(segment: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(segment["iters"], np.int64), np.frombuffer(segment["scores"], np.float64)


def joined(segments: list[dict[str, Any]], after: int) -> Iterator[dict[str, Any]]:
    """The segments in order, none overlapping another, without steps up to ``after`` and without repeated ones (the first counts)."""
    held: list[dict[str, Any]] = []

    def out() -> Iterator[dict[str, Any]]:
        if len(held) == 1 and held[0]["first"] > after:
            yield held[0]
            return
        iters, scores = (np.concatenate(c) for c in zip(*map(unpack, held)))
        order = np.argsort(iters, kind="stable")
        iters, scores = iters[order], scores[order]
        keep = np.append(True, iters[1:] != iters[:-1]) & (iters > after)
        if keep.any():
            yield pack(iters[keep], scores[keep])

    for segment in sorted(segments, key=lambda s: (s["first"], s["last"])):
        if held and segment["first"] > max(s["last"] for s in held):
            yield from out()
            held = []
        held.append(segment)
    if held:
        yield from out()


def advance(best: float | None, held: int, segment: dict[str, Any], n: int, threshold: float | None) -> tuple[float | None, int, int | None]:
    """(best, steps that have held it, iteration of the stop or None) after a segment."""
    at, to = np.frombuffer(segment["rise_at"], np.int64), np.frombuffer(segment["rise_to"], np.float64)
    if best is not None:
        at, to = at[to > best], to[to > best]
    seen = 0  # scored steps of the segment that are counted
    for place, value in [*zip(at.tolist(), to.tolist()), (segment["scored"], None)]:
        if best is not None and held + place - seen >= n:
            return best, n, _iteration(segment, seen + n - held - 1)
        held += place - seen
        if value is not None:
            best, held, seen = value, 1, place + 1
            if threshold is not None and best >= threshold or n <= 1:
                return best, held, _iteration(segment, place)
    return best, held, None


def _iteration(segment: dict[str, Any], place: int) -> int:
    iters, scores = unpack(segment)
    return int(iters[~np.isnan(scores)][place])


def stop_rule(n: int, threshold: float | None, forget_ms: int | None):
    """State of a run: its best, how long it has held, its last step, and whether it has stopped."""

    def rule(key: Any, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, held, last, stopped = state.get if state.exists else (None, 0, -1, False)
        found = [s for frame in rows for s in frame.to_dict("records")]
        if not stopped:
            for segment in joined(found, last):
                best, held, at = advance(best, held, segment, n, threshold)
                last = segment["last"]
                if at is not None:
                    stopped = True
                    yield pd.DataFrame({"run": [None if pd.isna(key[0]) else key[0]], "stop_iter": [at], "best": [best]})
                    break
        state.update((best, held, last, stopped))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)

    return rule


def segments(steps: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(run, segment) of the steps each task reads."""

    def pieces(frames: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        code, runs = pd.factorize(frame["run"], use_na_sentinel=False)
        iters, scores = frame["iter"].to_numpy(np.int64), frame["score"].to_numpy(np.float64)
        order = np.lexsort((iters, code))  # stable: the first of repeated steps counts
        code, iters, scores = code[order], iters[order], scores[order]
        new = np.append(True, (code[1:] != code[:-1]) | (iters[1:] != iters[:-1]))
        code, iters, scores = code[new], iters[new], scores[new]
        cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)).tolist()
        places = [(a, min(a + size, end)) for start, end in zip(cuts, cuts[1:]) for a in range(start, end, size)]
        names = [None if pd.isna(r) else r for r in runs]
        return pd.DataFrame([{"run": names[code[a]], **pack(iters[a:b], scores[a:b])} for a, b in places])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            rows += len(frame)
            if rows >= FRAME:
                yield pieces(held)
                held, rows = [], 0
        if held:
            yield pieces(held)

    narrow = steps.select("run", F.col("iter").cast("long").alias("iter"), F.col("score").cast("double").alias("score")).where("iter IS NOT NULL")
    return narrow.mapInPandas(run, f"run {steps.schema['run'].dataType.simpleString()}, {SEGMENTS}")


def stops(steps: DataFrame, n: int, threshold: float | None = None, forget_minutes: float | None = None) -> DataFrame:
    """The stream of (run, stop_iter, best) of runs whose best has held for n scored steps, itself included, or reached a threshold.

    Steps at or before a run's last one are repeats and are ignored.  A run of which nothing is heard for ``forget_minutes``
    loses its state.
    """
    spark = steps.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    run_type = steps.schema["run"].dataType.simpleString()
    rule = stop_rule(n, threshold, None if forget_minutes is None else int(forget_minutes * 60_000))
    timeout = GroupStateTimeout.NoTimeout if forget_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    # The state travels with a run's segments: many runs go to a Python worker at once, without a call back for each.
    return segments(steps).groupBy("run").applyInPandasWithState(
        rule, f"run {run_type}, stop_iter long, best double", _STATE, "append", timeout)
