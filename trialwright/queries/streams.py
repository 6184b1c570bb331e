"""Logs on disk and logs that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialwright.functions.params import parse_params
from trialwright.operators import curves, stop
from trialwright.plans import views
from trialwright.queries.registry import EV, LI, OD, query, rounded
from trialwright.queries.stops import _stop_sql
from trialwright.schemas import TRIAL_LAYOUTS
from trialwright.session import materialize, scratch_path
from trialwright.sources import features, records, trials, versions
from trialwright.streaming import steps


# Steps of one file of a log that is written as files.
FILE_STEPS = 500_000


def _event_stream(spark, sf):
    """The events table as a stream of steps: a user's events in id order."""
    schema = views.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return stream.select(F.col("user_id").alias("run"), F.col("event_id").alias("iter"), F.col("value").alias("score"))


@query("q_on_step", """SELECT user_id AS run, count(*) AS steps, max(value) AS best_score,
    min(event_id) FILTER (value = top) AS best_iter FROM (
    SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY user_id""")
def _(spark, sf):
    return steps.run_to_table(steps.on_step(_event_stream(spark, sf)), "update")


@query("q_follow", """SELECT user_id AS run, count(*) AS steps, max(value) AS best_score,
    min(event_id) FILTER (value = top) AS best_iter FROM (
    SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY user_id""")
def _(spark, sf):
    """A callback that keeps the changed rows of every micro-batch; the last row of each run is its state."""
    path = scratch_path(spark, "follow")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/number={batch_id}")

    stream = steps.on_step(_event_stream(spark, sf))
    steps.follow(stream, keep, f"{path}/progress", availableNow=True).awaitTermination()
    rows = spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{path}/rows")
    last = rows.groupBy("run").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["run", "batch"]).select("run", "steps", "best_score", "best_iter")


@query("q_live_stop", f"""WITH e AS (SELECT 'e' AS experiment, user_id AS run, event_id AS iter, value AS score FROM events),
    {_stop_sql('e', 10)} SELECT s.run, s.iter AS stop_iter, s.best FROM scan s JOIN stops t ON s.run = t.run WHERE s.pos = t.stop""")
def live_stop(spark, sf):
    path = scratch_path(spark, "live-stop")
    steps.live_stop(_event_stream(spark, sf), 10, path).awaitTermination()
    return steps.read_stops(spark, path, "bigint")


@query("q_live_stop_files", f"""WITH {EV}, {_stop_sql('ev', 7)} SELECT s.run, s.iter AS stop_iter, s.best FROM scan s JOIN stops t ON s.run = t.run WHERE s.pos = t.stop""")
def _(spark, sf):
    """A search that goes on in five files (sets of files where there are many steps), one micro-batch each, half of the second one
    written twice; the query is stopped and started again after the third."""
    log = materialize(views.events_log(spark, sf).select("run", "iter", "score"), "log")
    files = -(-log.count() // FILE_STEPS) or 1
    source, path = scratch_path(spark, "steps"), scratch_path(spark, "live-stop")
    schema = "run long, iter long, score double"
    for part in range(5):
        inside = (F.col("iter") > part * 12) & ((F.col("iter") <= part * 12 + 12) | F.lit(part == 4))
        again = F.col("iter").between(18, 24) if part == 2 else F.lit(False)
        # A run's steps of a part are in one file, so that they are never in two micro-batches.
        rows = log.where(inside | again)
        (rows.repartition(files, "run") if files > 1 else rows.coalesce(1)).write.mode("append").json(source)
        if part in (2, 4):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
            steps.live_stop(stream, 7, path).awaitTermination()
    return steps.read_stops(spark, path, "bigint")


@query("q_step_log", f"""WITH {EV} SELECT run, count(*) AS steps, greatest(80 - count(*), 0) AS remaining, round(sum(score), 4) AS total,
    round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 4) AS k FROM ev GROUP BY run""")
def _(spark, sf):
    """Steps appended to a JSON log in two parts, the second numbered from 1 again, then resumed."""
    log = views.events_log(spark, sf, "props").select(
        F.col("run").cast("string").alias("run"), "iter", "score", parse_params("props").alias("params"),
        F.lit(None).cast("timestamp").alias("ts"))
    first, second = scratch_path(spark, "steps"), scratch_path(spark, "steps")
    steps.log_steps(log.where("iter <= 30"), first)
    steps.log_steps(log.where("iter > 30").withColumn("iter", F.col("iter") - 30), second)
    whole = records.concat_event_logs(records.read_event_log(spark, first), records.read_event_log(spark, second))
    left = steps.remaining_budget(whole, 80)
    sums = whole.groupBy("run").agg(F.max("iter").alias("steps"), F.sum("score").alias("total"), F.sum(F.col("params")["k"]).alias("k"))
    return rounded(sums.join(left, "run").withColumn("run", F.col("run").cast("bigint")), "total", "k", places=4)


@query("q_stream_log", f"""WITH {OD} SELECT run, count(*) AS steps, max(score) AS best_score,
    min(iter) FILTER (score = top) AS best_iter FROM (SELECT *, max(score) OVER (PARTITION BY run) AS top FROM od) GROUP BY run""")
def _(spark, sf):
    """Orders written as a JSON step log and followed as a stream."""
    path = scratch_path(spark, "steps")
    steps.log_steps(views.orders_log(spark, sf).select(F.col("run").cast("string").alias("run"), "iter", "score"), path)
    out = steps.run_to_table(steps.on_step(steps.read_steps(spark, path, 2)), "update")
    return out.withColumn("run", F.col("run").cast("bigint"))


@query("q_trial_files", f"""WITH {LI} SELECT experiment, run, count(*) AS n, max(iter) AS last, max(score) AS best FROM li GROUP BY ALL""")
def _(spark, sf):
    """A log written by experiment and read back."""
    path = scratch_path(spark, "trials")
    trials.write_trials(views.lines_log(spark, sf), path, ["experiment"])
    back = spark.read.schema("run long, iter long, score double, experiment string").parquet(path)
    return back.groupBy("experiment", "run").agg(F.count("*").alias("n"), F.max("iter").alias("last"), F.max("score").alias("best"))


@query("q_summary_file", f"""WITH {OD}, p AS (SELECT experiment, run, max(score) AS best FROM od GROUP BY ALL)
    SELECT experiment AS method, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS std FROM p GROUP BY experiment""")
def _(spark, sf):
    path = scratch_path(spark, "summary")
    summary = curves.stop_summary(stop.stop_at_plateau(views.orders_log(spark, sf), 1000)).select(
        F.col("experiment").alias("method"), F.col("score_mean").alias("mean"), F.col("score_std").alias("std"))
    records.write_summary(summary, path)
    return rounded(records.read_summary(spark, path).drop("stop"), "mean", "std")


@query("q_run_from_filename", f"""WITH {OD} SELECT DISTINCT run, run % 4 * 25 AS stop FROM od""")
def _(spark, sf):
    """Run and stop value out of log names with and without a data-set suffix."""
    runs = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    name = F.concat(F.lit("GR_S_2_and_3_groups_with_"), (F.col("id") % 4 * 25).cast("string"), F.lit("_"), F.col("id").cast("string"),
                    F.when(F.col("id") % 2 == 0, "_house_prices.csv").otherwise(""))
    return runs.select(trials.run_from_filename(name).alias("run"), trials.stop_from_filename(name).alias("stop"))


@query("q_feature_files", """SELECT kind, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 2) AS tax
    FROM lineitem, (SELECT unnest(['header', 'headerless', 'typed']) AS kind) GROUP BY kind""")
def _(spark, sf):
    """Feature tables as CSV with a header, by position, and with explicit types."""
    li = views.table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_returnflag")
    numeric = li.select("l_quantity", "l_tax")
    paths = {k: scratch_path(spark, k) for k in ("header", "headerless", "typed")}
    numeric.write.csv(paths["header"], header=True)
    numeric.write.csv(paths["headerless"])
    li.write.csv(paths["typed"])
    read = {"header": features.read_features(spark, paths["header"], numeric.schema),
            "headerless": features.read_headerless(spark, paths["headerless"], numeric.columns),
            "typed": features.read_typed(spark, paths["typed"], li.schema).drop("l_returnflag")}
    out = None
    for kind, df in read.items():
        part = df.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax")).select(
            F.lit(kind).alias("kind"), "n", "quantity", "tax")
        out = part if out is None else out.unionAll(part)
    return rounded(out, "quantity", "tax", places=2)


@query("q_event_log_counts", "SELECT event_type AS run, count(*) AS steps, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(spark, sf):
    """Steps counted per log, a folder of files per event type."""
    path = scratch_path(spark, "steps")
    ev = views.table(spark, sf, "events").select("event_type", F.col("event_id").alias("iter"), F.col("value").alias("score"),
                                                  F.col("event_type").alias("run"))
    ev.write.partitionBy("event_type").json(path)
    counts = records.count_events(spark, f"{path}/*", folders=True).select(F.regexp_extract("folder", "=(.*)$", 1).alias("run"), "steps")
    totals = records.read_event_log(spark, f"{path}/*").groupBy("run").agg(F.sum("score").alias("total"))
    return rounded(counts.join(totals, "run"), "total", places=4)


def _trial_lines(spark, sf):
    """Orders as lines of a recorded log's layout, with the file each belongs to; every file claims run 0."""
    layout = TRIAL_LAYOUTS["random_stage_3"]
    od = views.orders_log(spark, sf)
    known = {"param_subsample": F.lit(0.5), "params": F.concat(F.lit("{'subsample': 0.5, 'colsample_bytree': "), (F.col("iter") % 4 / 4).cast("string"), F.lit("}")),
             "split0_test_score": F.col("score") - 1, "split1_test_score": F.col("score"), "split2_test_score": F.col("score") + 1,
             "mean_test_score": F.when(F.col("iter") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("score")), "rank_test_score": F.lit(1),
             "iter_num": F.col("iter"), "experiment_name": F.col("experiment"), "run_number": F.lit(0)}
    file = F.concat(F.lit("RS_3_group_with_"), (F.col("run") % 2 * 25 + 25).cast("string"), F.lit("_"), (F.col("run") % 16).cast("string"), F.lit("_orders"))
    fields = [known.get(f.name, F.lit(0.25)).cast(f.dataType).alias(f.name) for f in layout]
    return od.select(*fields, file.alias("file")), layout


def _trial_folder(spark, sf):
    """A folder of CSV logs with a header, one folder a file name; the reader takes the run and the stop value out of the name."""
    lines, layout = _trial_lines(spark, sf)
    path = scratch_path(spark, "trial-files")
    lines.write.partitionBy("file").csv(path, header=True)
    return path, layout


_TRIALS = f"""WITH {OD} SELECT run % 16 AS run, run % 2 * 25 + 25 AS stop, iter, CASE WHEN iter % 5 <> 0 THEN score END AS score,
    iter % 4 / 4.0::DOUBLE AS colsample, score - 1 AS first_split FROM od"""


@query("q_read_trials", f"SELECT stop, iter % 4 AS k, count(*) AS n, count(score) AS scored, round(sum(score), 2) AS total, round(sum(colsample), 2) AS colsample, "
       f"round(sum(first_split), 2) AS first_split FROM ({_TRIALS}) WHERE stop = 25 GROUP BY ALL")
def _(spark, sf):
    """Logs with the stop value 25 in their name, read with their header checked, NaN scores as NULL."""
    path, layout = _trial_folder(spark, sf)
    found = trials.read_trials(spark, f"{path}/file=RS_3_group_with_25_*", "part", layout=layout)
    found = found.groupBy(F.lit(25).cast("bigint").alias("stop"), (F.col("iter") % 4).alias("k")).agg(
        F.count("*").alias("n"), F.count("score").alias("scored"), F.sum("score").alias("total"),
        F.sum(F.col("params")["colsample_bytree"]).alias("colsample"), F.sum(F.col("splits")[0]).alias("first_split"))
    return rounded(found, "total", "colsample", "first_split", places=2)


@query("q_rewrite_runs", f"SELECT run, count(*) AS n, count(score) AS scored, round(sum(score), 2) AS total FROM ({_TRIALS}) GROUP BY run")
def _(spark, sf):
    """A versioned log whose rows all claim run 0 gets the run ids of its file names, in one step."""
    path, layout = _trial_folder(spark, sf)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"file=([^/]+)", 1)
    raw = spark.read.schema(layout).csv(f"{path}/file=*", header=True, enforceSchema=False)
    kept = raw.select(F.lit(0).cast("bigint").alias("run"), trials.run_from_filename(name).alias("file_run"),
                      trials.nan_to_null("mean_test_score").alias("score"))
    where = scratch_path(spark, "versioned")
    versions.replace_log(kept.where("score IS NULL"), where)
    versions.append_log(kept.where("score IS NOT NULL"), where)
    trials.rewrite_runs(spark, where)
    versions.drop_old_versions(spark, where)
    back = versions.read_log(spark, where)
    return rounded(back.groupBy("run").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.sum("score").alias("total")), "total", places=2)


@query("q_append_steps", f"""WITH {EV} SELECT run, count(*) AS steps, max(iter) AS last_iter, round(sum(iter * score), 2) AS weighted FROM ev GROUP BY run""")
def _(spark, sf):
    """A step log resumed twice: each part is numbered from 1 again and appended without rewriting the log."""
    log = views.events_log(spark, sf).select("run", "iter", "score")
    where = scratch_path(spark, "step-log")
    versions.replace_log(log.where("iter <= 10"), where)
    records.append_event_log(log.where("iter BETWEEN 11 AND 30").withColumn("iter", F.col("iter") - 10), where)
    records.append_event_log(log.where("iter > 30").withColumn("iter", F.col("iter") - 30), where)
    back = versions.read_log(spark, where)
    return rounded(back.groupBy("run").agg(F.count("*").alias("steps"), F.max("iter").alias("last_iter"), F.sum(F.col("iter") * F.col("score")).alias("weighted")),
                   "weighted", places=2)
