"""Summaries, step logs and run records on disk."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialwright.operators.scan import join_runs
from trialwright.schemas import STEP
from trialwright.sources.trials import file_name
from trialwright.sources.versions import append_log, read_log

SUMMARY_MAP = "map<string,struct<mean:double,std:double>>"
MAX_METHODS = 10_000


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """{"method": {"mean": .., "std": ..}} to (method, stop, mean, std)."""
    entries = spark.read.text(path).select(F.explode(F.from_json("value", SUMMARY_MAP)).alias("key", "v"))
    return entries.select(
        F.col("key").alias("method"), F.regexp_extract("key", r"_(\d+)$", 1).try_cast("int").alias("stop"),
        "v.mean", "v.std")


def summary_json(summary: DataFrame, max_methods: int = MAX_METHODS) -> DataFrame:
    """The summary as one JSON object in column ``value``; one row per method, so the size is checked."""
    if summary.limit(max_methods + 1).count() > max_methods:
        raise ValueError("a summary has one row per method")
    entry = F.struct(F.col("method").alias("key"), F.struct("mean", "std").alias("value"))
    return summary.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    summary_json(summary).write.text(path)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEP).json(path)


def count_events(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Number of objects per file, or per folder (column folder) of many files."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).alias("folder")
    return lines.groupBy(folder if folders else file_name().alias("file")).agg(F.count("*").alias("steps"))


def concat_event_logs(first: DataFrame, resumed: DataFrame) -> DataFrame:
    """Append a resumed log, its step numbers shifted by the last step of the first part."""
    last = first.groupBy("run").agg(F.max("iter").alias("__last"))
    shifted = join_runs(resumed, last, ["run"]).withColumn("iter", F.col("iter") + F.coalesce("__last", F.lit(0)))
    return first.unionByName(shifted.drop("__last"))


def append_event_log(resumed: DataFrame, path: str) -> int:
    """Append a resumed part to a versioned step log, its steps numbered on; the steps that are there are not rewritten."""
    spark = resumed.sparkSession
    first = read_log(spark, path)
    last = first.groupBy("run").agg(F.max("iter").alias("__last"))
    shifted = join_runs(resumed, last, ["run"]).withColumn("iter", F.col("iter") + F.coalesce("__last", F.lit(0)))
    return append_log(shifted.select(*first.columns), path)


def write_run_info(spark: SparkSession, path: str, search: str, seconds: float, best_params: dict[str, float],
                   best_score: float) -> None:
    """Append one record per search: total time and best configuration."""
    row = (search, float(seconds), float(best_score), {k: float(v) for k, v in best_params.items()},
           datetime.now(timezone.utc))
    schema = "search string, seconds double, score double, params map<string,double>, finished timestamp"
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)
