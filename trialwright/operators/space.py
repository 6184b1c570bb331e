"""Search spaces and candidate tables.

A candidate table has ``trial_id`` and one column per parameter.  Draws are functions of
(run, trial, parameter, seed), so a candidate is the same under any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialwright import schemas
from trialwright.functions.hashing import hash52, uniform

BUDGET = 729


@dataclass(frozen=True)
class Param:
    """``int`` draws from [lo, hi) or [lo, hi] if inclusive, ``float`` from [lo, hi), ``choice`` from values."""

    name: str
    kind: str
    lo: float = 0.0
    hi: float = 0.0
    values: tuple = ()
    stage: int = 1
    inclusive: bool = False

    @property
    def size(self) -> float:
        if self.kind == "choice":
            return len(self.points)
        return self.hi - self.lo + self.inclusive if self.kind == "int" else math.inf

    @property
    def points(self) -> list[float]:
        """All values of a parameter that has finitely many."""
        if self.kind == "choice":
            return list(dict.fromkeys(float(v) for v in self.values))
        return [float(int(self.lo) + i) for i in range(int(self.size))]

    def draw(self, u: Column) -> Column:
        if self.kind == "choice":
            options = F.array(*[F.lit(float(v)) for v in self.values])
            return F.element_at(options, (F.floor(u * len(self.values)) + 1).cast("int"))
        if self.kind == "int":
            return (F.lit(int(self.lo)) + F.floor(u * int(self.size))).cast("double")
        return F.lit(float(self.lo)) + u * F.lit(float(self.hi - self.lo))


# The search ranges of the six boosting parameters in three groups (fixed values).
SEARCH_SPACE = (
    Param("max_depth", "int", 1, 20, stage=1),
    Param("min_child_weight", "int", 1, 20, stage=1),
    Param("alpha", "float", 0.0, 1.0, stage=2),
    Param("lambda", "float", 0.0, 1.0, stage=2),
    Param("subsample", "float", 0.5, 0.9, stage=3),
    Param("colsample_bytree", "float", 0.5, 0.9, stage=3),
)


def space_table(spark: SparkSession, space: Sequence[Param]) -> DataFrame:
    rows = [(p.name, p.kind, float(p.lo), float(p.hi), [float(v) for v in p.values], p.stage) for p in space]
    return spark.createDataFrame(rows, schemas.SPACE)


def stage_space(space: Sequence[Param], stage: int) -> list[Param]:
    return [p for p in space if p.stage == stage]


def grid_candidates(spark: SparkSession, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Full product of the value lists; the first parameter varies slowest."""
    total = math.prod(len(v) for v in grid.values())
    columns, stride = [], total
    for name, values in grid.items():
        stride //= len(values)
        options = F.array(*[F.lit(float(v)) for v in values])
        position = F.pmod(F.floor(F.col("trial_id") / stride), F.lit(len(values)))
        columns.append(F.element_at(options, (position + 1).cast("int")).alias(name))
    return spark.range(total).toDF("trial_id").select("trial_id", *columns)


def random_candidates(spark: SparkSession, space: Sequence[Param], n: int, seed: int = 0, start: int = 0,
                      runs: DataFrame | None = None) -> DataFrame:
    """n draws numbered from ``start``; with a ``runs`` table (column run), n draws for every run."""
    ids = spark.range(start, start + n).toDF("trial_id")
    keys = ["trial_id"]
    if runs is not None:
        ids = runs.select("run", F.explode(F.sequence(
            F.lit(start).cast("bigint"), F.lit(start + n - 1).cast("bigint"))).alias("trial_id"))
        keys = ["run", "trial_id"]
    return ids.select(*keys, *[p.draw(uniform(*keys, F.lit(p.name), seed=seed)).alias(p.name) for p in space])


# Points of a space that are numbered; hashed numbers stay far above, so that remainders are even.
POINTS = 1 << 44


def permuted(x: Column, n: int, *keys, seed: int = 0) -> Column:
    """Where a keyed permutation of 0 .. n - 1 takes ``x``.

    Each round pairs every number with another one (key - x, modulo n) and swaps the pair if a hashed bit of the larger one says
    so.  A round is its own inverse, so any number of rounds is a permutation, whatever n is.
    """
    rounds = 6 * max(1, (n - 1).bit_length())

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(hash52(*keys, r, F.lit("pair"), seed=seed) - at, F.lit(n))
        return F.when(F.pmod(hash52(*keys, r, F.greatest(at, other), seed=seed), F.lit(2)) == 1, other).otherwise(at)

    return F.reduce(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("bigint"), step)


def _levels(space: Sequence[Param]) -> dict[str, int]:
    """How many values of each parameter are numbered; one that finds no room any more is left out."""
    room, out = POINTS, {}
    for p in sorted(space, key=lambda p: p.size):
        left = sum(q.size == math.inf for q in space if q.name not in out)
        levels = int(p.size) if p.size < math.inf else 1 << (room.bit_length() - 1) // left
        if 0 < levels <= room:
            out[p.name] = levels
            room //= levels
    return out


def distinct_random_candidates(spark: SparkSession, space: Sequence[Param], n: int, seed: int = 0, start: int = 0,
                               runs: DataFrame | None = None) -> DataFrame:
    """n distinct draws numbered from ``start``; with a ``runs`` table (column run), n for every run, each in its own order.

    The points of the space are numbered and draw i is the point that a keyed permutation takes i to, so draws never repeat
    and none is looked up, counted or sorted.  A range of real numbers is cut into even steps, their middles drawn.  A
    space with fewer points than are asked for is refused.
    """
    levels = _levels(space)
    points = math.prod(levels.values())
    if points < start + n:
        raise ValueError(f"the space has only {points} points, {start + n} distinct ones were asked for")
    keys = ["trial_id"] if runs is None else ["run", "trial_id"]
    ids = spark.range(start, start + n).toDF("trial_id") if runs is None else runs.select("run", F.explode(
        F.sequence(F.lit(start).cast("bigint"), F.lit(start + n - 1).cast("bigint"))).alias("trial_id"))
    return points_of(ids, space, seed, keys[:-1]).select(*keys, *[p.name for p in space])


def points_of(numbered: DataFrame, space: Sequence[Param], seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Add the parameters of the distinct draw that each row's ``trial_id`` names, within the row's ``keys``."""
    levels = _levels(space)
    points = stride = math.prod(levels.values())
    out = numbered.withColumn("__point", permuted(F.col("trial_id"), points, *keys, seed=seed))
    columns = {}
    for p in space:
        if p.name not in levels:
            columns[p.name] = p.draw(uniform(*keys, "trial_id", F.lit(p.name), seed=seed))
            continue
        stride //= levels[p.name]
        digit = F.pmod(F.floor(F.col("__point") / stride), F.lit(levels[p.name]))
        if p.kind == "float":
            columns[p.name] = F.lit(float(p.lo)) + (digit + 0.5) * F.lit((p.hi - p.lo) / levels[p.name])
        elif p.kind == "int":
            columns[p.name] = (digit + int(p.lo)).cast("double")
        else:
            columns[p.name] = F.element_at(F.array(*[F.lit(v) for v in p.points]), (digit + 1).cast("int"))
    return out.withColumns(columns).drop("__point")


def default_config(spark: SparkSession, params: Mapping[str, float] | None = None) -> DataFrame:
    values = params or {"max_depth": 3.0}
    return spark.range(1).toDF("trial_id").select("trial_id", *[F.lit(float(v)).alias(k) for k, v in values.items()])


def stage_budget(stop1: Column | str, stop2: Column | str, budget: int = BUDGET) -> tuple[Column, Column]:
    """Trials left for stage 2 (half of what stage 1 left, half-even) and stage 3."""
    stop1 = F.col(stop1) if isinstance(stop1, str) else stop1
    stop2 = F.col(stop2) if isinstance(stop2, str) else stop2
    return shared_budget(stop1, 2, budget), shared_budget(stop2, 1, budget)


def shared_budget(used: Column, stages: int, budget: int = BUDGET) -> Column:
    """Trials of the next stage where ``stages`` are to come: an equal share of what is left, half to even."""
    return F.bround((F.lit(budget) - used) / max(stages, 1)).cast("bigint")


def stage_modes(spark: SparkSession, modes: Sequence[str], budgets: Sequence[int]) -> DataFrame:
    rows = [(i, m, b) for i, (m, b) in enumerate(zip(modes, budgets, strict=True), 1)]
    return spark.createDataFrame(rows, "stage int, mode string, budget int")
