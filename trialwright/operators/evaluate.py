"""Folds, fold metrics and objectives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialwright.functions.hashing import hash52
from trialwright.operators.scan import number_rows
from trialwright.session import TASK_ROWS, materialize


def assign_folds(df: DataFrame, k: int, key: Sequence[str], seed: int = 0, contiguous: bool = False,
                 task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``fold`` in 0..k-1.

    By default a hash of the key, which needs no shuffle.  ``contiguous`` cuts the key order into k runs of
    rows, the first n mod k of them one row longer.
    """
    if not contiguous:
        return df.withColumn("fold", F.pmod(hash52(*key, seed=seed), F.lit(k)).cast("int"))
    numbered = number_rows(df, [], list(key), "__pos", task_rows)
    n = numbered.select(F.count("*").alias("n")).scalar()
    sized = numbered.withColumn("__n", n)
    i, base, extra = F.col("__pos") - 1, F.floor(F.col("__n") / k), F.pmod(F.col("__n"), F.lit(k))
    cut = extra * (base + 1)
    fold = F.when(i < cut, F.floor(i / (base + 1))).otherwise(
        extra + F.floor((i - cut) / F.greatest(base, F.lit(1))))
    return sized.withColumn("fold", fold.cast("int")).drop("__pos", "__n")


def r2(label="label", prediction="prediction") -> Column:
    """Aggregate expression: 1 - squared error over squared deviation from the mean."""
    y = F.col(label) if isinstance(label, str) else label
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    return 1 - F.sum((y - p) * (y - p)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))


def rmse(label="label", prediction="prediction") -> Column:
    y = F.col(label) if isinstance(label, str) else label
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.sqrt(F.avg((y - p) * (y - p)))


METRICS: dict[str, Callable[..., Column]] = {"r2": r2, "rmse": rmse}


def fold_metrics(predictions: DataFrame, metrics: dict[str, Callable[..., Column]] | None = None,
                 keys: Sequence[str] = ("trial_id", "fold", "isTest")) -> DataFrame:
    """Long table (trial_id, fold, isTest, metric, value); a metric is any aggregate-column builder."""
    metrics = metrics or METRICS
    wide = predictions.groupBy(*keys).agg(*[f().alias(name) for name, f in metrics.items()])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def train_and_test(data: DataFrame, k: int) -> DataFrame:
    """Each row once per fold, flagged ``isTest`` in its own fold."""
    out = data.withColumnRenamed("fold", "__own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn("isTest", F.col("fold") == F.col("__own")).drop("__own")


def fold_summary(metrics: DataFrame, metric: str = "r2", keys: Sequence[str] = ("trial_id",)) -> DataFrame:
    """Mean and population std over test folds, the fold values in order, and min-rank by mean."""
    tests = metrics.where((F.col("metric") == metric) & F.col("isTest"))
    ordered = F.array_sort(F.collect_list(F.struct("fold", "value")))
    summary = tests.groupBy(*keys).agg(
        F.avg("value").alias("score"), F.stddev_pop("value").alias("std"),
        F.transform(ordered, lambda s: s["value"]).alias("splits"))
    # One row per trial of a search: the window holds a budget of rows, not the data.
    best_first = W.partitionBy(*(keys[:-1] or [F.lit(1)])).orderBy(F.desc_nulls_last("score"))
    return summary.withColumn("rank", F.rank().over(best_first).cast("bigint"))


def last_round(metrics: DataFrame, metric: str = "r2") -> DataFrame:
    """Mean test metric of the final boosting round, per trial."""
    tests = metrics.where((F.col("metric") == metric) & F.col("isTest"))
    final = tests.groupBy("trial_id", "fold").agg(F.max_by("value", "round").alias("value"))
    return final.groupBy("trial_id").agg(F.avg("value").alias("score"))


OBJECTIVE = "SELECT AVG(value) FROM __THIS__ WHERE metric = 'r2' AND isTest"


def objective_sql(metrics: DataFrame, query: str = OBJECTIVE) -> DataFrame:
    """Evaluate a user's SQL over each trial's own metric rows: (trial_id, score).

    The query becomes a lateral subquery over ``__THIS__``, so all trials are one plan.  The metric rows
    (trials x folds x metrics) are written first, as the plan reads them twice.
    """
    metrics = materialize(metrics, "metrics")
    own = "(SELECT * FROM {metrics} AS m WHERE m.trial_id = t.trial_id)"
    text = f"""SELECT t.trial_id, o.score
        FROM {{trials}} AS t, LATERAL ({query.replace('__THIS__', own)}) AS o(score)"""
    return metrics.sparkSession.sql(text, metrics=metrics, trials=metrics.select("trial_id").distinct())


def configurations(log: DataFrame, params: Sequence[str]) -> DataFrame:
    """Trials with their parameters and objective, best first."""
    return log.select("trial_id", *params, "score").orderBy(F.desc_nulls_last("score"), "trial_id")
