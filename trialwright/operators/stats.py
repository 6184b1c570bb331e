"""Statistics of parameters, columns and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.operators.scan import join_runs, number_rows, prefix_scan
from trialwright.operators.trials import RUN, best_per_run
from trialwright.session import TASK_ROWS, materialize


def param_stats(log: DataFrame, keys: Sequence[str] = RUN, by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Mean and sample std over runs of each winner's parameter values."""
    winners = best_per_run(log, keys, carry=["params"])
    values = winners.select(*by, F.explode("params").alias("param", "value"))
    return values.groupBy(*by, "param").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("runs"))


def param_long(log: DataFrame, params: Sequence[str], ids: Sequence[str] = ("experiment", "score")) -> DataFrame:
    """(ids, param, value) per searched parameter, for influence plots."""
    wide = log.select(*ids, *[F.col(p).cast("double").alias(p) for p in params])
    return wide.unpivot(list(ids), list(params), "param", "value").where(F.col("value").isNotNull())


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns or df.columns])
    return counts.unpivot([], counts.columns, "column", "nulls")


def cumulative_counts(df: DataFrame, value: str, keys: Sequence[str] = (), descending: bool = False,
                      task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, value, __i, n, upto): rows per value, and rows up to and with it in the order of values, NULL last.

    Rows are counted map-side and written as one row per value; only those are sorted and scanned, in pieces where a group
    has many.  A value that most rows share is one row.
    """
    counts = materialize(df.groupBy(*keys, value).agg(F.count("*").alias("n")), "counts")
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    numbered = number_rows(counts, keys, [order], "__i", task_rows)
    return prefix_scan(numbered, keys, {"upto": ("sum", "n")}, order="__i", task_rows=task_rows)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                    task_rows: int = TASK_ROWS) -> DataFrame:
    """Linear-interpolated quantiles, one row per (keys, prob), from the counts of the values."""
    keys = list(keys)
    counts = cumulative_counts(df.where(F.col(value).isNotNull()), value, keys, task_rows=task_rows)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__n")).where("__n IS NOT NULL")
    with_total = (join_runs(counts, total, keys, "inner", "__i", task_rows) if keys else
                  counts.withColumn("__n", total.select("__n").scalar()).where("__n IS NOT NULL"))
    at = [F.lit(float(p)) * (F.col("__n") - 1) + 1 for p in probs]
    ends = [F.min(F.when(F.col("upto") >= end(a), F.col(value))) for a in at for end in (F.floor, F.ceil)]
    found = with_total.groupBy(*keys, "__n").agg(*[e.alias(f"__{i}") for i, e in enumerate(ends)])
    rows = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.col(f"__{2 * i}") + (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}")) * (a - F.floor(a)))
                              .alias("quantile")) for i, (p, a) in enumerate(zip(probs, at))])
    return found.select(*keys, F.inline(rows))


def describe_scores(df: DataFrame, value: str = "score", keys: Sequence[str] = (),
                    task_rows: int = TASK_ROWS) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quart = exact_quantiles(df, value, (0.25, 0.5, 0.75), keys, task_rows).groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    if keys:
        return base.join(quart, keys, "left")
    return base.withColumn("__k", F.lit(1)).join(quart.withColumn("__k", F.lit(1)), "__k").drop("__k")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_summary(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values and the count of the most frequent one."""
    return value_counts(df, column).agg(F.count(column).alias("distinct_values"), F.max("n").alias("max_count"))


def column_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.max(c).alias(c) for c in columns])


def row_max(columns: Sequence[str]):
    return F.greatest(*columns)
