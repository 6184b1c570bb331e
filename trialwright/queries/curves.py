"""Learning curves, intervals and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialwright.operators import curves, stop
from trialwright.plans import views
from trialwright.queries.registry import EV, LI, OD, query, rounded, scan_sql
from trialwright.queries.stops import _stop_sql

INTERVAL = ("mean", "std", "lower", "upper")


def curve_sql(log: str, z: float, n: str) -> str:
    return f"""{scan_sql(log)}, c AS (
        SELECT experiment, iter, avg(best) AS mean, stddev_samp(best) AS std, count(best) AS runs
        FROM scan GROUP BY experiment, iter), i AS (
        SELECT c.*, coalesce({z} * std / sqrt({n}), 0) AS half FROM c)"""


# A mean of cents over 32, 64, .. runs can end exactly half way between two sixth decimals; the nudge puts
# such values on one side in both engines.
NUDGE = 1e-9
CURVE = """SELECT experiment, iter, round(mean + 1e-9, 6) AS mean, round(std, 6) AS std, runs,
    round(mean - half + 1e-9, 6) AS lower, round(mean + half + 1e-9, 6) AS upper FROM i"""


def shown(curve):
    return rounded(curve.withColumns({c: F.col(c) + NUDGE for c in ("mean", "lower", "upper")}), *INTERVAL)


@query("q_learning_curve", f"WITH {EV}, {curve_sql('ev', 1.96, 'runs')} {CURVE}")
def learning_curve(spark, sf):
    return shown(curves.learning_curve(views.events_log(spark, sf)))


@query("q_learning_curve_t", f"WITH {LI}, {curve_sql('li', 2.262, '10')} {CURVE}")
def _(spark, sf):
    return shown(curves.learning_curve(views.lines_log(spark, sf), curves.T_95_10_RUNS, 10))


@query("q_learning_curve_measured", f"""WITH {EV}, {curve_sql('ev', 1.96,
    '(SELECT sum(d.runs) / max(d.iter) FROM c d WHERE d.experiment = c.experiment)')} {CURVE}""")
def _(spark, sf):
    return shown(curves.learning_curve(views.events_log(spark, sf), n="measured"))


@query("q_extend_runs", f"""WITH {EV}, e AS (SELECT run, max(iter) AS last, max(score) AS score FROM ev GROUP BY run)
    SELECT run, last + 1 AS from_iter, (SELECT max(last) FROM e) AS to_iter, score FROM e
    WHERE last < (SELECT max(last) FROM e)""")
def _(spark, sf):
    return curves.extend_runs(views.events_log(spark, sf), expand=False).select("run", "from_iter", "to_iter", "score")


@query("q_extended_rows", f"""WITH {OD}, e AS (SELECT experiment, run, max(iter) AS last, max(score) AS score FROM od GROUP BY ALL), m AS (
    SELECT experiment, max(last) AS longest FROM e GROUP BY experiment)
    SELECT experiment, run, unnest(range(last + 1, longest + 1)) AS iter, score FROM e JOIN m USING (experiment)""")
def _(spark, sf):
    """The rows that pad every stopped run to the longest one of its method."""
    return curves.extend_runs(views.orders_log(spark, sf)).select("experiment", "run", "iter", "score")


@query("q_extended_curve", f"""WITH {EV}, {_stop_sql('ev', 10)}, e AS (
    SELECT experiment, run, max(iter) AS last, max(score) AS best FROM cut GROUP BY ALL), padded AS (
    SELECT experiment, iter, best FROM cut
    UNION ALL SELECT e.experiment, g.range AS iter, e.best FROM e JOIN range(1, 1000) g ON g.range > e.last
        AND g.range <= (SELECT max(last) FROM e)), c AS (
    SELECT experiment, iter, avg(best) AS mean, stddev_samp(best) AS std, count(best) AS runs FROM padded GROUP BY ALL), i AS (
    SELECT c.*, coalesce(1.96 * std / sqrt(runs), 0) AS half FROM c) {CURVE}""")
def _(spark, sf):
    cut = stop.stop_at_plateau(views.events_log(spark, sf), 10).select("experiment", "run", "iter", "score")
    return shown(curves.extended_curve(cut))


@query("q_ci_disjoint", f"""WITH {LI}, {curve_sql('li', 1.96, 'runs')}, l AS (
    SELECT experiment, mean - half AS lower, mean + half AS upper FROM (
        SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY iter DESC) AS k FROM i) WHERE k = 1)
    SELECT 'A' AS a, 'N' AS b, round(a.lower, 6) AS lower_a, round(b.upper, 6) AS upper_b, a.lower > b.upper AS disjoint
    FROM l a, l b WHERE a.experiment = 'A' AND b.experiment = 'N'""")
def _(spark, sf):
    return rounded(curves.ci_disjoint(curves.learning_curve(views.lines_log(spark, sf)), "A", "N"), "lower_a", "upper_b")


PER_RUN = """p AS (SELECT experiment, run, max(iter) AS iters, max(score) AS best FROM {log} GROUP BY experiment, run)"""


@query("q_ci_table", f"""WITH {OD}, {PER_RUN.format(log='od')}, s AS (
    SELECT experiment AS method, avg(best) AS mean, stddev_pop(best) AS std FROM p GROUP BY experiment)
    SELECT method, round(mean - 1.96 * std / sqrt(10), 6) AS lower, round(mean + 1.96 * std / sqrt(10), 6) AS upper FROM s""")
def _(spark, sf):
    summary = curves.stop_summary(views.orders_log(spark, sf)).select(
        F.col("experiment").alias("method"), F.col("score_mean").alias("mean"), F.col("score_std").alias("std"))
    return rounded(curves.ci_table(summary), "lower", "upper")


@query("q_method_summary", f"""WITH {OD}, {PER_RUN.format(log='od')} SELECT experiment, round(avg(best), 6) AS mean,
    round(stddev_samp(best), 6) AS std, min(best) AS min, max(best) AS max FROM p GROUP BY experiment""")
def _(spark, sf):
    return rounded(curves.method_summary(views.orders_log(spark, sf)), "mean", "std")


@query("q_stop_summary", f"""WITH {LI}, {_stop_sql('li', 10)}, {PER_RUN.format(log='cut')}
    SELECT experiment, round(avg(iters), 6) AS iters_mean, round(stddev_pop(iters), 6) AS iters_std,
           round(avg(best), 6) AS score_mean, round(stddev_pop(best), 6) AS score_std FROM p GROUP BY experiment""")
def _(spark, sf):
    cut = stop.stop_at_plateau(views.lines_log(spark, sf), 10)
    return rounded(curves.stop_summary(cut), "iters_mean", "iters_std", "score_mean", "score_std")


@query("q_iters_report", f"""WITH {EV}, {_stop_sql('ev', 5)}, {PER_RUN.format(log='cut')}
    SELECT experiment, CAST(round_even(min(iters), 0) AS BIGINT) AS iters_min, CAST(round_even(avg(iters), 0) AS BIGINT) AS iters_mean,
           CAST(round_even(max(iters), 0) AS BIGINT) AS iters_max FROM p GROUP BY experiment""")
def _(spark, sf):
    return curves.iters_report(stop.stop_at_plateau(views.events_log(spark, sf), 5))


TIMES_SQL = """t AS (SELECT l_returnflag AS experiment, l_suppkey AS run, CAST(l_linenumber % 3 + 1 AS INTEGER) AS stage,
    l_quantity AS mean_fit_time, l_tax AS std_fit_time, CASE WHEN l_discount > 0.02 THEN l_discount END AS mean_score_time,
    l_discount * 0.5 AS std_score_time FROM lineitem),
    totals AS (SELECT experiment, run, sum(mean_fit_time) AS mean_fit_time, sum(std_fit_time) AS std_fit_time,
    sum(coalesce(mean_score_time, 0)) AS mean_score_time, sum(std_score_time) AS std_score_time FROM t GROUP BY experiment, run)"""


def _times(spark, sf):
    """Line items as timed trials: quantity and discount stand for seconds."""
    return views.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("experiment"), F.col("l_suppkey").alias("run"),
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("stage"), F.col("l_quantity").alias("mean_fit_time"),
        F.col("l_tax").alias("std_fit_time"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("mean_score_time"),
        (F.col("l_discount") * 0.5).alias("std_score_time"))


@query("q_time_bounds", f"""WITH {TIMES_SQL} SELECT experiment, run, round(5 * (mean_fit_time + mean_score_time), 6) AS time_mean,
    round(5 * (mean_fit_time + mean_score_time + std_fit_time + std_score_time), 6) AS time_upper,
    round(5 * (mean_fit_time + mean_score_time - std_fit_time - std_score_time), 6) AS time_lower FROM totals""")
def _(spark, sf):
    bounds = curves.time_bounds(curves.time_totals(_times(spark, sf)), 5)
    return rounded(bounds, "time_mean", "time_upper", "time_lower").select(
        "experiment", "run", "time_mean", "time_upper", "time_lower")


@query("q_stage_time_summary", f"""WITH {TIMES_SQL}, r AS (
    SELECT experiment, run, stage, sum(3 * (mean_fit_time + coalesce(mean_score_time, 0))) AS t FROM t GROUP BY ALL), s AS (
    SELECT experiment, stage, avg(t) AS m, stddev_pop(t) AS d FROM r GROUP BY ALL), w AS (
    SELECT *, sum(m) OVER (PARTITION BY experiment ORDER BY stage) AS c FROM s)
    SELECT experiment, stage, round(m, 6) AS mean_time, round(d, 6) AS std_time, round(c, 6) AS stacked_time,
           round(c / 3600, 6) AS stacked_hours FROM w""")
def _(spark, sf):
    timed = _times(spark, sf).na.fill(0.0, ["mean_score_time"]).withColumn("trial_time", curves.trial_time(3))
    return rounded(curves.stage_time_summary(timed), "mean_time", "std_time", "stacked_time", "stacked_hours")
