"""Session settings and the one way this library cuts lineage: a table written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Rows of one group that a single task may sort.  Larger groups take the split plans.
TASK_ROWS = 1_000_000
# Rows of a partition that a learner keeps in memory.
FIT_ROWS = 600_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="trialwright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The result has no lineage, survives lost executors and keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: Sequence[str], task_rows: int | None = None) -> DataFrame:
    """Deal out the rows of a source with fewer files than cores by their key; larger sources are read in place.

    With ``task_rows`` partitions grow in number with the rows, so that one holds about so many at most.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if task_rows is None:
        return df.repartition(cores, *key) if len(df.inputFiles()) < cores else df
    n = max(cores, -(-df.count() // task_rows))
    few = len(df.inputFiles()) < cores
    return df.repartition(n, *key) if few or df.rdd.getNumPartitions() < n else df


def bounded(df: DataFrame, key: Sequence[str], task_rows: int = FIT_ROWS) -> DataFrame:
    """``df`` in place, or dealt out by its key where its partitions would hold more than about ``task_rows`` rows."""
    n = -(-df.count() // task_rows)
    return df.repartition(n, *key) if df.rdd.getNumPartitions() < n else df
