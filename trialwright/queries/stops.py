"""Plateaus, stop rules, cuts and stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialwright.functions.params import parse_params
from trialwright.operators import space, stop, trials
from trialwright.plans import views
from trialwright.queries.registry import EV, LI, query, scan_sql

KEYS = "experiment, run"


@query("q_running_best", f"""WITH {EV} SELECT run, iter, score,
    max(score) OVER (PARTITION BY run ORDER BY iter ROWS UNBOUNDED PRECEDING) AS best FROM ev""")
def _(spark, sf):
    return trials.running_best(views.events_log(spark, sf)).select("run", "iter", "score", "best")


@query("q_plateaus", f"WITH {LI}, {scan_sql('li')} SELECT experiment, run, best, length, first_pos, first_iter FROM plateaus")
def _(spark, sf):
    return trials.plateau_lengths(views.lines_log(spark, sf))


@query("q_longest_plateau", f"""WITH {EV}, {scan_sql('ev')}, f AS (
    SELECT run, length, best < max(best) OVER (PARTITION BY experiment, run) AS ended FROM plateaus)
    SELECT greatest(max(CASE WHEN ended THEN length END), 1) AS longest FROM f""")
def _(spark, sf):
    return trials.longest_plateau(views.events_log(spark, sf))


@query("q_longest_plateau_by_group", f"""WITH {EV}, {scan_sql('ev', 'experiment, run, stage')}, f AS (
    SELECT stage, length, best < max(best) OVER (PARTITION BY experiment, run, stage) AS ended FROM plateaus)
    SELECT stage, greatest(max(CASE WHEN ended THEN length END), 1) AS longest FROM f GROUP BY stage""")
def _(spark, sf):
    return trials.longest_plateau(views.staged_events(spark, sf), ["experiment", "run", "stage"], ["stage"])


def _stop_sql(log: str, n: int, keys: str = KEYS) -> str:
    on = " AND ".join(f"s.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    return f"""{scan_sql(log, keys)}, stops AS (
        SELECT {keys}, min(CASE WHEN length >= {n} THEN first_pos END) + {n} - 1 AS stop,
               max(first_pos + length - 1) AS end_pos FROM plateaus GROUP BY {keys}),
    cut AS (SELECT s.* FROM scan s JOIN stops t ON {on} WHERE s.pos <= coalesce(t.stop, s.pos))"""


for _n in (5, 10):
    @query(f"q_stop_plateau_{_n}", f"WITH {EV}, {_stop_sql('ev', _n)} SELECT run, iter, score, best, pos FROM cut")
    def _(spark, sf, n=_n):
        return stop.stop_at_plateau(views.events_log(spark, sf), n).select("run", "iter", "score", "best", "pos")


@query("q_stop_table", f"""WITH {EV}, {_stop_sql('ev', 10)} SELECT run, coalesce(stop, end_pos) AS stop_pos, end_pos,
    stop IS NOT NULL AS stopped FROM stops""")
def _(spark, sf):
    return stop.plateau_stop(views.events_log(spark, sf), 10).select("run", "stop_pos", "end_pos", "stopped")


@query("q_stop_plateau_by_group", f"""WITH {EV}, {_stop_sql('ev', 5, 'experiment, run, stage')}
    SELECT run, stage, iter, score FROM cut""")
def _(spark, sf):
    return stop.stop_at_plateau(views.staged_events(spark, sf), 5, ["experiment", "run", "stage"]).select(
        "run", "stage", "iter", "score")


@query("q_stop_global_best_10", f"""WITH {EV}, b AS (
    SELECT run, iter AS best_iter, score AS best_score FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, iter) AS k FROM ev WHERE iter BETWEEN 1 AND 50)
    WHERE k = 1)
    SELECT run, best_iter, best_score, least(best_iter + 9, 50) AS last_iter FROM b""")
def _(spark, sf):
    return stop.global_best_stop(views.events_log(spark, sf), 10, 1, 50)


@query("q_best_params_and_stop", f"""WITH {EV}, b AS (
    SELECT run, iter AS best_iter, score AS best_score, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, iter) AS r FROM ev WHERE iter BETWEEN 21 AND 60)
    WHERE r = 1)
    SELECT run, best_iter, best_score, k, least(best_iter + 4, 60) AS last_iter FROM b""")
def _(spark, sf):
    log = views.events_log(spark, sf, "props").withColumn("params", parse_params("props"))
    found = stop.best_params_and_stop(log, 5, 21, 60)
    return found.select("run", "best_iter", "best_score", F.col("params")["k"].alias("k"), "last_iter")


@query("q_best_params_and_stop_plateau", f"""WITH {EV}, part AS (SELECT * FROM ev WHERE iter BETWEEN 1 AND 40),
    {_stop_sql('part', 5, 'run')}, b AS (
    SELECT run, iter AS best_iter, score AS best_score, max(iter) OVER (PARTITION BY run) AS last_iter,
           CAST(json_extract(props, '$.k') AS DOUBLE) AS k, row_number() OVER (PARTITION BY run ORDER BY score DESC, iter) AS r
    FROM cut)
    SELECT run, best_iter, best_score, k, last_iter FROM b WHERE r = 1""")
def _(spark, sf):
    log = views.events_log(spark, sf, "props").withColumn("params", parse_params("props"))
    found = stop.best_params_and_stop(log, 5, 1, 40, mode="plateau")
    return found.select("run", "best_iter", "best_score", F.col("params")["k"].alias("k"), "last_iter")


_STAGE_STOP = """{name} AS (SELECT run, least(iter + {n} - 1, last) AS last_iter FROM (
    SELECT run, iter, max(iter) OVER (PARTITION BY run) AS last,
           row_number() OVER (PARTITION BY run ORDER BY score DESC, iter) AS k FROM ev WHERE stage = {stage}) WHERE k = 1)"""


@query("q_cut_stage", f"""WITH {EV}, {_STAGE_STOP.format(name='s', n=5, stage=1)}
    SELECT ev.run, ev.iter, ev.score FROM ev JOIN s ON ev.run = s.run WHERE ev.stage = 1 AND ev.iter <= s.last_iter""")
def _(spark, sf):
    log = views.staged_events(spark, sf).where("stage = 1")
    return stop.cut_stage(log, stop.stop_rule(log, 5, "global_best")).select("run", "iter", "score")


@query("q_stitch", f"""WITH {EV}, {', '.join(_STAGE_STOP.format(name=f's{i}', n=5, stage=i) for i in (1, 2, 3))}, cut AS (
    {' UNION ALL '.join(f"SELECT ev.run, ev.iter AS stage_iter, ev.score, {i} AS stage FROM ev JOIN s{i} ON ev.run = s{i}.run WHERE ev.stage = {i} AND ev.iter <= s{i}.last_iter" for i in (1, 2, 3))})
    SELECT run, stage, stage_iter, score, row_number() OVER (PARTITION BY run ORDER BY stage, stage_iter) AS iter FROM cut""")
def _(spark, sf):
    log = views.staged_events(spark, sf)
    stages = [log.where(F.col("stage") == i) for i in (1, 2, 3)]
    return stop.stitch_stages(stages, 5).select("run", "stage", "stage_iter", "score", "iter")


@query("q_select_stage_log", f"""WITH {EV}, {_STAGE_STOP.format(name='s', n=10, stage=1)}, full_runs AS (
    SELECT run FROM s WHERE last_iter = 20)
    SELECT run, iter, score FROM ev WHERE stage = 3 AND run IN (SELECT run FROM full_runs)
    UNION ALL SELECT run, iter, score FROM ev WHERE stage = 2 AND run NOT IN (SELECT run FROM full_runs)""")
def _(spark, sf):
    log = views.staged_events(spark, sf)
    stage = [log.where(F.col("stage") == i).select("run", "iter", "score") for i in (1, 2, 3)]
    return stop.select_stage_log(stage[2], stage[1], [stop.stop_rule(stage[0], 10, "global_best")], views.STAGE)


@query("q_assemble_group_logs", f"""WITH {EV}, parts AS (
    SELECT run, iter, score, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS stage FROM ev
    WHERE event_type = 'click' OR (event_type = 'view' AND score > 20) OR (event_type = 'purchase' AND score > 20))
    SELECT run, iter, score, CAST(stage AS INTEGER) AS stage FROM parts
    WHERE run IN (SELECT run FROM parts GROUP BY run HAVING count(DISTINCT stage) = 3)""")
def _(spark, sf):
    log = views.events_log(spark, sf, "event_type")
    parts = [log.where("event_type = 'click'"), log.where("event_type = 'view' AND score > 20"),
             log.where("event_type = 'purchase' AND score > 20")]
    return stop.assemble_group_logs([p.select("run", "iter", "score") for p in parts])


@query("q_missing_runs", """SELECT c_custkey AS run FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE value > 30)""")
def _(spark, sf):
    log = views.table(spark, sf, "events").where("value > 30").select(F.col("user_id").alias("run"))
    return stop.missing_runs(log, views.table(spark, sf, "customer").select(F.col("c_custkey").alias("run")))


@query("q_stage_budget", f"""WITH {EV}, {_STAGE_STOP.format(name='s1', n=5, stage=1)}, {_STAGE_STOP.format(name='s2', n=5, stage=2)}
    SELECT s1.run, CAST(round_even((60 - s1.last_iter) / 2, 0) AS BIGINT) AS stage2, 60 - s2.last_iter AS stage3
    FROM s1 JOIN s2 ON s1.run = s2.run""")
def _(spark, sf):
    log = views.staged_events(spark, sf)
    one, two = [stop.stop_rule(log.where(F.col("stage") == i), 5, "global_best").withColumnRenamed("last_iter", f"stop{i}")
                for i in (1, 2)]
    stage2, stage3 = space.stage_budget("stop1", "stop2", 60)
    return one.join(two, "run").select("run", stage2.alias("stage2"), stage3.alias("stage3"))
