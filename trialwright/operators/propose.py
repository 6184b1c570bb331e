"""Model-based proposals: expected improvement over a Gaussian process, and tree-structured Parzen.

Both score a candidate table against the finished trials of its run.  Repeated trials of one configuration are first averaged
into a row with a weight, which is exact for both models.  Neither holds a run's history: the process lives in the weights of a
fixed feature basis, so a history is D x D sums, and the Parzen estimator is a sum of kernels per candidate.  Both kinds of sums
are combined map-side, so a history may have any length.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trialwright.functions.hashing import hash52, uniform
from trialwright.operators.scan import join_keys, join_runs, number_rows
from trialwright.operators.space import Param
from trialwright.session import TASK_ROWS, materialize

# Tasks receive this module's functions with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Features of the basis, the length scale of the kernel they stand for, and the noise of one trial.
FEATURES, SCALE, NOISE = 64, 0.3, 1e-3
# Candidates scored at once, and candidates of one run that travel together.
BLOCK = 1_000


def config_history(log: DataFrame, params: Sequence[str], keys: Sequence[str] = ("run",)) -> DataFrame:
    """(keys, params, score, weight): mean score and number of trials per distinct configuration."""
    scored = log.where(F.col("score").isNotNull())
    return scored.groupBy(*keys, *params).agg(F.avg("score").alias("score"), F.count("*").alias("weight"))


def _bounds(space: Sequence[Param]) -> list[tuple[str, float, float]]:
    return [(p.name, *((min(p.values), max(p.values)) if p.kind == "choice" else (p.lo, p.hi))) for p in space]


def _unit_cube(frame: pd.DataFrame, bounds: list[tuple[str, float, float]]) -> np.ndarray:
    return np.stack([(frame[n].to_numpy(dtype=float) - lo) / ((hi - lo) or 1.0) for n, lo, hi in bounds], axis=1)


def fourier_basis(dimensions: int, features: int = FEATURES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (features x dimensions) and phases of cosines whose products average to an RBF kernel; the same ones always."""
    draw = np.random.default_rng(20240301)
    return draw.normal(0, 1 / scale, (features, dimensions)), draw.uniform(0, 2 * math.pi, features)


def basis_at(points: np.ndarray, basis: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    frequencies, phases = basis
    return np.sqrt(2 / len(phases)) * np.cos(points @ frequencies.T + phases)


# Rows of the sums: cells (i, j) of the feature products, then these by feature or alone.
WITH_SCORE, ALONE, TOTALS = -1, -2, -3


def feature_sums(history: DataFrame, space: Sequence[Param], keys: Sequence[str], basis: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(keys, i, j, value, top): weighted sums over a run's history of feature products, of features with and without the
    score, and of weight, score and squared score; ``top`` is the best score.  Tasks send one row a cell, whatever they read."""
    keys, bounds = list(keys), _bounds(space)
    columns = [*keys, *[n for n, _, _ in bounds], "score", "weight"]
    size = len(basis[1])
    upper = np.triu_indices(size)

    def cells(frame: pd.DataFrame) -> dict:
        w, y = frame["weight"].to_numpy(dtype=float), frame["score"].to_numpy(dtype=float)
        phi = basis_at(_unit_cube(frame, bounds), basis)
        every = np.arange(size)
        i = np.concatenate([upper[0], every, every, [0, 1, 2]])
        j = np.concatenate([upper[1], np.full(size, WITH_SCORE), np.full(size, ALONE), np.full(3, TOTALS)])
        value = np.concatenate([((phi * w[:, None]).T @ phi)[upper], (w * y) @ phi, w @ phi, [w.sum(), w @ y, w @ (y * y)]])
        return {"i": i, "j": j, "value": value, "top": y.max()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict] = {}
        for frame in frames:
            for key, part in (frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]):
                new, old = cells(part), held.get(key)
                if old is not None:
                    old["value"] += new["value"]
                    old["top"] = max(old["top"], new["top"])
                else:
                    held[key] = new
            if len(held) > 64:  # many runs: what is held leaves, Spark adds it up
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held: dict) -> Iterator[pd.DataFrame]:
        for key, found in held.items():
            yield pd.DataFrame({**{k: [None if pd.isna(v) else v] * len(found["i"]) for k, v in zip(keys, key)}, **found})

    schema = StructType([*[history.schema[k] for k in keys], *[StructField(c, LongType()) for c in "ij"], StructField("value", DoubleType()), StructField("top", DoubleType())])
    sums = history.select(*columns).mapInPandas(run, schema)
    return sums.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"), F.max("top").alias("top"))


class Posterior:
    """Weights of the basis given the sums of a history; scores have their weighted mean and deviation taken out."""

    def __init__(self, sums: pd.DataFrame, size: int, noise: float):
        i, j, value = (sums[c].to_numpy() for c in ("i", "j", "value"))
        s = np.zeros((size, size))
        inner = j >= 0
        s[i[inner], j[inner]] = s[j[inner], i[inner]] = value[inner]
        at = lambda kind, n: np.bincount(i[j == kind], value[j == kind], minlength=n)
        weight, total, squares = at(TOTALS, 3)
        self.mean = total / weight
        self.deviation = math.sqrt(max(squares / weight - self.mean**2, 0)) or 1.0
        self.top, self.noise = float(sums["top"].max()), noise
        self.covariance = np.linalg.inv(np.eye(size) + s / noise)
        self.target = (at(WITH_SCORE, size) - self.mean * at(ALONE, size)) / self.deviation / noise

    def believe(self, phi: np.ndarray, score: float) -> None:
        """One more trial, as if it had this score; mean, deviation and best score stay those of the finished ones."""
        moved = self.covariance @ phi
        self.covariance = self.covariance - np.outer(moved, moved) / (self.noise + phi @ moved)
        self.target = self.target + phi * ((score - self.mean) / self.deviation / self.noise)

    def at(self, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mu = self.mean + self.deviation * (phi @ (self.covariance @ self.target))
        return mu, self.deviation * np.sqrt(np.maximum(((phi @ self.covariance) * phi).sum(axis=1), 1e-12))

    def improvement(self, phi: np.ndarray, jitter: float) -> np.ndarray:
        mu, sd = self.at(phi)
        gain = mu - self.top - jitter
        z = gain / sd
        cdf = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
        return gain * cdf + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def propose_ei(history: DataFrame, candidates: DataFrame, space: Sequence[Param], keys: Sequence[str] = ("run",), jitter: float = 0.0,
               slices: int = 8, features: int = FEATURES, noise: float = NOISE) -> DataFrame:
    """Candidates with their expected improvement ``ei`` over the run's best score.

    A run's sums become one small solve in each slice of its candidates.  A run without history gives every candidate the same value.
    """
    keys, bounds, basis = list(keys), _bounds(space), fourier_basis(len(space), features)
    left = candidates.withColumn("__slice", F.pmod(hash52(*keys, "trial_id"), F.lit(slices)).cast("int"))
    sums = materialize(feature_sums(history, space, keys, basis), "sums").withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    columns, block = candidates.columns, BLOCK

    def run(cand: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        out = cand[columns].copy()
        out["ei"] = np.ones(len(cand))
        if len(cand) and len(sums):
            posterior = Posterior(sums, features, noise)
            out["ei"] = np.concatenate([posterior.improvement(basis_at(_unit_cube(cand.iloc[i:i + block], bounds), basis), jitter)
                                        for i in range(0, len(cand), block)])
        return out

    schema = candidates.select("*", F.lit(0.0).alias("ei")).schema
    return left.groupBy(*keys, "__slice").cogroup(sums.groupBy(*keys, "__slice")).applyInPandas(run, schema)


def propose_batch(history: DataFrame, candidates: DataFrame, space: Sequence[Param], n: int, keys: Sequence[str] = ("run",), lie: str = "mean",
                  pending: DataFrame | None = None, jitter: float = 0.0, features: int = FEATURES, noise: float = NOISE) -> DataFrame:
    """``n`` candidates per run to be tried at the same time, with ``pick`` 1..n and their ``ei`` when picked.

    One candidate after another is picked by expected improvement, ties to the lower ``trial_id``; each then counts as a trial with a believed score, so
    that the next is picked elsewhere.  The belief is a constant: the run's weighted mean score (``lie="mean"``) or its best
    (``lie="best"``).  ``pending`` (keys, parameters) are trials that still run: they are believed first.  A run's pool of
    candidates is one group, of the size the caller draws it.
    """
    if lie not in ("mean", "best"):
        raise ValueError(f"unknown belief {lie!r}")
    keys, bounds, basis = list(keys), _bounds(space), fourier_basis(len(space), features)
    names, columns = [p.name for p in space], candidates.columns
    pool = candidates.select("*", F.lit(False).alias("__runs"))
    if pending is not None:
        pool = pool.unionByName(pending.select(*keys, *names, F.lit(True).alias("__runs")), allowMissingColumns=True)
    sums, by = feature_sums(history, space, keys, basis), keys or ["__all"]
    if not keys:
        pool, sums = pool.withColumn("__all", F.lit(0)), sums.withColumn("__all", F.lit(0))

    def run(cand: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        running, left = cand[cand["__runs"]], cand[~cand["__runs"]].sort_values("trial_id", ignore_index=True)
        if not len(sums):
            return left[columns].head(n).assign(ei=1.0, pick=np.arange(1, min(n, len(left)) + 1))
        posterior = Posterior(sums, features, noise)
        belief = posterior.mean if lie == "mean" else posterior.top
        for phi in basis_at(_unit_cube(running, bounds), basis):
            posterior.believe(phi, belief)
        phi = basis_at(_unit_cube(left, bounds), basis)
        free, picked, values = np.ones(len(left), bool), [], []
        while len(picked) < n and free.any():
            ei = np.where(free, posterior.improvement(phi, jitter), -np.inf)
            best = int(np.argmax(ei))
            picked.append(best)
            values.append(ei[best])
            free[best] = False
            posterior.believe(phi[best], belief)
        return left[columns].iloc[picked].assign(ei=values, pick=np.arange(1, len(picked) + 1))

    schema = candidates.select("*", F.lit(0.0).alias("ei"), F.lit(0).cast("bigint").alias("pick")).schema
    return pool.groupBy(*by).cogroup(sums.groupBy(*by)).applyInPandas(run, schema)


def propose_tpe(history: DataFrame, candidates: DataFrame, space: Sequence[Param], keys: Sequence[str] = ("run",), gamma: float = 0.25,
                bandwidth: float = 0.2, task_rows: int = TASK_ROWS) -> DataFrame:
    """Candidates with ``log_ratio``, the log density among good configurations over that among the rest.

    The best ``ceil(gamma * n)`` configurations are good (ties by parameter values); each density is a weighted product of
    Gaussian kernels with a uniform floor.  A run's candidates travel to its configurations in blocks, and each task adds up
    the kernels of what it reads, so only one row per candidate and task leaves it.
    """
    keys, names = list(keys), [p.name for p in space]
    if not keys:  # one run: a key that is always 0, though no constant to the optimizer
        one = lambda df, c: df.withColumn("__all", F.pmod(F.xxhash64(c), F.lit(1)))
        return propose_tpe(one(history, "score"), one(candidates, "trial_id"), space, ["__all"], gamma, bandwidth, task_rows).drop("__all")
    unit = {n: (F.col(n) - lo) / ((hi - lo) or 1.0) for n, lo, hi in _bounds(space)}
    placed = number_rows(history, keys, [F.desc("score"), *names], "__pos", task_rows)
    sizes = history.groupBy(*keys).agg(F.count("*").alias("__n"))
    known = join_runs(placed, sizes, keys, "inner", "__pos", task_rows).select(
        *keys, "__pos", "weight", (F.col("__pos") <= F.ceil(F.lit(gamma) * F.col("__n"))).alias("__good"), *[u.alias(f"__x_{n}") for n, u in unit.items()])
    point = F.struct("trial_id", *[u.alias(n) for n, u in unit.items()])
    blocks = candidates.groupBy(*keys, F.floor(F.col("trial_id") / BLOCK).alias("__block")).agg(F.collect_list(point).alias("__points"))
    pairs = join_runs(known, blocks, keys, "inner", "__pos", task_rows).withColumn("__c", F.explode("__points"))
    distance = sum(((F.col(f"__c.{n}") - F.col(f"__x_{n}")) ** 2 for n in names), F.lit(0.0))
    kernel = F.col("weight") * F.exp(-distance / (2 * bandwidth**2)) / (bandwidth * math.sqrt(2 * math.pi)) ** len(names)
    sums = pairs.groupBy(*keys, F.col("__c.trial_id").alias("trial_id")).agg(
        *[f(F.when(F.col("__good") == good, v)).alias(f"__{what}_{good}") for good in (True, False) for what, f, v in (("k", F.sum, kernel), ("w", F.sum, F.col("weight")))])
    density = {good: F.log((1 + F.coalesce(f"__k_{good}", F.lit(0.0))) / (1 + F.coalesce(f"__w_{good}", F.lit(0)))) for good in (True, False)}
    return join_keys(candidates, sums, [*keys, "trial_id"]).select(*candidates.columns, (density[True] - density[False]).alias("log_ratio"))


def top_proposals(scored: DataFrame, value: str, batch: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """The ``batch`` best candidates per run, ties to the lower trial id.

    A rank filter over a window lets Spark keep only ``batch`` rows per run in each map task.
    """
    order = W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc_nulls_last(value), "trial_id")
    return scored.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= batch).drop("__rank")


def epsilon_greedy(proposed: DataFrame, random: DataFrame, epsilon: float, seed: int = 0,
                   keys: Sequence[str] = ("run", "trial_id")) -> DataFrame:
    """Rows of ``proposed``, each replaced by the ``random`` row of the same key with probability epsilon."""
    keys = list(keys)
    pick: Column = uniform(*keys, F.lit("epsilon"), seed=seed) < epsilon
    columns = [c for c in random.columns if c in proposed.columns]
    return proposed.where(~pick).select(columns).unionByName(random.where(pick).select(columns))
