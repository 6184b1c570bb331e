"""Following a search while it runs: a step log that grows on disk, read with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trialwright.schemas import STEP
from trialwright.session import scratch_path
from trialwright.streaming.live import stops


def log_steps(log: DataFrame, path: str) -> None:
    """Append finished steps to a folder of newline-delimited JSON."""
    log.write.mode("append").json(path)


def read_steps(spark: SparkSession, path: str, max_files: int | None = None, schema: StructType = STEP) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def on_step(steps: DataFrame) -> DataFrame:
    """Per run: steps so far, best score and its earliest iteration.  Map-side combined, so a busy run is cheap."""
    best = F.max(F.when(F.col("score").isNotNull(), F.struct(F.col("score"), (-F.col("iter")).alias("i"))))
    return steps.groupBy("run").agg(F.count("*").alias("steps"), best.alias("b")).select(
        "run", "steps", F.col("b.score").alias("best_score"), (-F.col("b.i")).alias("best_iter"))


def live_stop(steps: DataFrame, n: int, path: str, threshold: float | None = None, forget_minutes: float | None = None, **trigger) -> StreamingQuery:
    """Write (run, stop_iter, best) once a run's best has held for n scored steps or reached a threshold.

    A run's state is four numbers in the state store; only runs with new steps are read and written.  A restart goes on from
    the checkpoint under ``path``, and a batch that is run again writes its stops once.  Steps at or before a run's last one are
    repeats and are ignored.  The state of a run without new steps for ``forget_minutes`` is dropped; as that needs a query that goes on,
    such a query looks for steps every ten seconds until it is stopped.
    """
    if forget_minutes is not None:
        if "availableNow" in trigger or "once" in trigger:
            raise ValueError("a query that forgets runs until it is stopped")
        trigger = trigger or {"processingTime": "10 seconds"}
    return stops(steps, n, threshold, forget_minutes).writeStream.format("parquet").option("path", f"{path}/stops").option(
        "checkpointLocation", f"{path}/progress").trigger(**(trigger or {"availableNow": True})).start()


def read_stops(spark: SparkSession, path: str, run_type: str = "string") -> DataFrame:
    return spark.read.schema(f"run {run_type}, stop_iter long, best double").parquet(f"{path}/stops")


def run_to_table(stream: DataFrame, mode: str = "append", key: str = "run") -> DataFrame:
    """Drain what is there and return the result as a written table.

    In ``update`` mode every micro-batch writes its changed rows and the latest row per key is kept.
    """
    spark = stream.sparkSession
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumn("__batch", F.lit(0)).schema
    out = spark.read.schema(schema).parquet(f"{path}/batch=*")
    if mode == "append":
        return out.drop("__batch")
    rest = [c for c in stream.columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(key, "r.*")


def follow(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Call back with each micro-batch of changed rows; a restart goes on from the checkpoint.  Without a trigger it goes on for ever."""
    writer = stream.writeStream.outputMode("update").foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def remaining_budget(log: DataFrame, budget: int) -> DataFrame:
    """Trials each run still has after the finished steps of a reloaded log."""
    return log.groupBy("run").agg(F.greatest(F.lit(budget) - F.count("*"), F.lit(0)).alias("remaining"))
