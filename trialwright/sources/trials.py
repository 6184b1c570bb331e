"""Trial logs on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialwright.functions.params import nan_to_null, parse_params
from trialwright.schemas import TRIAL_LAYOUTS
from trialwright.sources.versions import rewrite_log

RENAMES = {"mean_test_score": "score", "std_test_score": "score_std", "rank_test_score": "rank",
           "iter_num": "iter", "experiment_name": "experiment", "run_number": "run"}


def file_name() -> Column:
    """Decoded name of the file a row came from."""
    return F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def run_from_filename(name: Column | None = None) -> Column:
    """``..._{stop}_{run}`` or ``..._{stop}_{run}_{dataset}.csv`` to the run id."""
    return F.regexp_extract(file_name() if name is None else name, r"_with_\d+_(\d+)", 1).cast("bigint")


def stop_from_filename(name: Column | None = None) -> Column:
    return F.regexp_extract(file_name() if name is None else name, r"_with_(\d+)_", 1).cast("bigint")


def read_trials(spark: SparkSession, path: str, method: str = "", stop: int | None = None,
                layout: str | StructType = "random_stages_2_3", columns: Sequence[str] | None = None) -> DataFrame:
    """All logs in a folder whose file name starts with ``method`` and, if given, names the stop value.

    Files are chosen while listing, so the others are never opened; only the needed columns are parsed.
    Headers are checked against the layout.  NaN scores become NULL.
    """
    schema = TRIAL_LAYOUTS[layout] if isinstance(layout, str) else layout
    pattern = f"{method}*" if stop is None else f"{method}*_with_{stop}_*"
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, pathGlobFilter=pattern)
    raw = raw.withColumns({"file_run": run_from_filename(), "stop": stop_from_filename()})
    log = raw.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in raw.columns})
    log = log.withColumns({"score": nan_to_null("score"), "params": parse_params("params")})
    splits = [c for c in log.columns if c.startswith("split")]
    log = log.withColumn("splits", F.array(*splits)).drop(*splits)
    return log.select(*columns) if columns else log


def write_trials(log: DataFrame, path: str, by: Sequence[str] = ("experiment", "run"), fmt: str = "parquet") -> None:
    """One folder per (experiment, run), so that reading a run lists only its own files."""
    if fmt == "csv":
        maps = {c: F.to_json(c) for c, t in log.dtypes if t.startswith(("map", "array", "struct"))}
        log = log.withColumns(maps)
    log.write.partitionBy(*by).format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def rewrite_run_number(log: DataFrame, path: str, by: Sequence[str] = ("experiment", "run")) -> None:
    """Write the log to a new path with the run id its file name gives."""
    fixed = log.withColumn("run", F.coalesce("file_run", "run"))
    write_trials(fixed, path, by)


def rewrite_runs(spark: SparkSession, path: str, run: Column | None = None, by: Sequence[str] = ()) -> int:
    """Give a versioned log new run ids in place (those of its file names); readers see the old log until the new one is whole."""
    new = F.coalesce("file_run", "run") if run is None else run
    return rewrite_log(spark, path, lambda log: log.withColumn("run", new), by)
