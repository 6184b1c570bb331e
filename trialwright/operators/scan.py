"""Numbering and running aggregates that stay parallel inside one large group.

A window partitioned by run puts a whole run in one task.  These operators split a run into pieces,
work inside the pieces and carry one pre-aggregated row per piece to the next.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialwright.session import TASK_ROWS, materialize

# Column metadata that records the measured length of the longest run, and what a run is.
LONGEST, LONGEST_KEYS = "longest_run", "longest_run_keys"

# What a split scan's rows are partitioned by.
PIECES = "__key", "__piece"

# ``monotonically_increasing_id`` holds the partition above this many bits of row position.
PART_BITS = 33

_FUNCTIONS = {"max": F.max, "sum": F.sum, "count": F.count}


def _columns(items) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "iter",
                task_rows: int = TASK_ROWS, at_most: int | None = None) -> DataFrame:
    """Add 1..n per group in the given total order.

    Group sizes are measured first (one column, map-side combined) unless a bound is known.  While the largest fits a task this
    is a plain ``row_number``.  Otherwise rows are range-partitioned and sorted over (keys, order), which
    divides a large group between tasks, and written with their place.  A row's number is its distance
    from its group's start in the part, plus the group's rows in the parts before: one small aggregate
    joined back.  Places are written, so they cannot change when a task is retried.
    """
    keys, order = list(keys), _columns(order)
    longest, total = at_most, at_most
    if at_most is None or at_most > task_rows:
        sizes = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
        longest, total = sizes[0] or 0, sizes[1] or 0
    if longest <= task_rows:
        window = W.partitionBy(*(keys or [F.lit(1)])).orderBy(*order)
        number = F.row_number().over(window).cast("bigint")
        return df.withColumn("__n", number).select(
            *[c for c in df.columns if c != name], bounded("__n", name, int(longest), keys))
    shuffle_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle_parts, math.ceil(2 * total / task_rows))
    by = [*_columns(keys), *order]
    placed = materialize(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(
        "__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", PART_BITS))
    before = W.partitionBy(*(keys or [F.lit(1)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__count"), F.min("__at").alias("__start"))
    offsets = starts.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__part").alias("__in"), "__start", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"))
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys] + [F.col("__part") == F.col("__in")]
    return placed.join(offsets, same).select(
        *[c for c in df.columns if c != name],
        (F.col("__at") - F.col("__start") + F.col("__offset") + 1).alias(name))


def bounded(column: str, name: str, longest: int | None, keys: Sequence[str]) -> Column:
    """The order column with the measured bound attached (None says there is none)."""
    return F.col(column).alias(name, metadata={LONGEST: longest, LONGEST_KEYS: list(keys)})


def longest_run(log: DataFrame, order: str, keys: Sequence[str]) -> int | None:
    """Measured bound on the rows of a group, if the groups are those measured or parts of them."""
    metadata = log.schema[order].metadata
    longest = metadata.get(LONGEST)
    return longest if longest is not None and set(metadata[LONGEST_KEYS]) <= set(keys) else None


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of which any may be NULL: the columns of ``left``, then the others of ``right``."""
    there = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(there, same, how).drop(*[f"__right_{k}" for k in keys])


def join_runs(log: DataFrame, per_run: DataFrame, keys: Sequence[str], how: str = "left", order: str = "iter",
              task_rows: int = TASK_ROWS) -> DataFrame:
    """Join a table of one row per run to the rows of a log; NULL is a run like any other.

    A run longer than a task is met piece by piece: its one row is sent to each piece the log has, so the
    join's key is (keys, piece).  A log whose scan kept its pieces is joined where the scan left it, without
    another shuffle of its rows; its pieces are dropped.
    """
    keys = list(keys)
    if PIECES[1] in log.columns:
        found = per_run.withColumn("__key", _key(keys)).drop(*keys)
        there = log.select(*PIECES).distinct().join(found, "__key")
        return log.join(there, list(PIECES), how).drop(*PIECES)
    bound = longest_run(log, order, keys)
    if bound is not None and bound <= task_rows:
        return join_keys(log, per_run, keys, how)
    pieces = log.withColumn("__piece", F.floor(F.col(order) / task_rows))
    there = pieces.select(*keys, "__piece").distinct()
    return join_keys(pieces, join_keys(there, per_run, keys, "inner"), [*keys, "__piece"], how).drop("__piece")


def _key(keys: Sequence[str]) -> Column:
    """All keys as one value that is never NULL, so that NULL runs meet under plain equality."""
    return F.struct(*keys) if keys else F.lit(1)


def prefix_scan(log: DataFrame, keys: Sequence[str], running: Mapping[str, tuple[str, str]], order: str = "iter",
                task_rows: int = TASK_ROWS, keep_pieces: bool = False) -> DataFrame:
    """Add running aggregates (``{"best": ("max", "score")}``) in ``order`` within each group.

    ``order`` is an iteration number (unique in its group), so ``order / task_rows`` cuts a group into
    bounded pieces.  Piece totals are combined map-side and scanned; the rows themselves shuffle once,
    by (keys, piece).  A log whose measured longest run fits one task skips the second level.
    Keys may be NULL: pieces are keyed by the struct of all keys, which is equal where NULLs meet.  With
    ``keep_pieces`` a split scan keeps the columns its rows are partitioned by, for ``join_runs``.
    """
    keys = list(keys)
    to_here = (W.unboundedPreceding, W.currentRow)
    bound = longest_run(log, order, keys)
    if bound is not None and bound <= task_rows:
        window = W.partitionBy(*keys).orderBy(order).rowsBetween(*to_here)
        return log.withColumns({n: _FUNCTIONS[f](c).over(window) for n, (f, c) in running.items()})
    pieces = log.withColumns({"__key": _key(keys), "__piece": F.floor(F.col(order) / task_rows)})
    window = W.partitionBy("__key", "__piece").orderBy(order).rowsBetween(*to_here)
    inside = pieces.withColumns({n: _FUNCTIONS[f](c).over(window) for n, (f, c) in running.items()})
    before = W.partitionBy("__key").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    totals = pieces.groupBy("__key", "__piece").agg(
        *[_FUNCTIONS[f](c).alias(f"__{n}") for n, (f, c) in running.items()])
    carry = totals.select("__key", "__piece", *[
        (F.max if f == "max" else F.sum)(f"__{n}").over(before).alias(f"__{n}") for n, (f, _) in running.items()])
    joined = inside.join(carry, list(PIECES), "left")
    merged = {n: F.greatest(n, f"__{n}") if f == "max" else F.col(n) + F.coalesce(f"__{n}", F.lit(0))
              for n, (f, _) in running.items()}
    return joined.withColumns(merged).select(*log.columns, *[n for n in running if n not in log.columns], *(PIECES if keep_pieces else ()))
