"""Selecting, joining, aggregating and ranking trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialwright.functions import params as P
from trialwright.operators import stats, trials
from trialwright.plans import views
from trialwright.queries.registry import EV, LI, OD, query, rounded


@query("q_number_trials", f"WITH {LI} SELECT experiment, run, iter, score FROM li")
def _(spark, sf):
    return views.lines_log(spark, sf)


@query("q_select_trials", f"""WITH {OD} SELECT run, iter, score FROM od
    WHERE experiment LIKE '%H%' AND iter BETWEEN 2 AND 6 AND NOT (score < 100000)""")
def _(spark, sf):
    log = views.orders_log(spark, sf)
    kept = trials.select_trials(log, contains="H", iters=(2, 6), exclude=F.col("score") < 100000)
    return kept.select("run", "iter", "score")


@query("q_relabel", f"""WITH {OD}, x AS (
    SELECT CASE WHEN experiment LIKE '%-%' AND experiment LIKE '%H%' THEN 'group search' ELSE experiment END AS experiment
    FROM od) SELECT experiment, count(*) AS n FROM x GROUP BY experiment""")
def _(spark, sf):
    return stats.value_counts(trials.relabel(views.orders_log(spark, sf), "H", "group search"), "experiment")


@query("q_drop_all_null_rows", """SELECT p, q FROM (
    SELECT CASE WHEN l_discount > 0.05 THEN l_quantity END AS p, CASE WHEN l_tax > 0.04 THEN l_partkey END AS q
    FROM lineitem) WHERE p IS NOT NULL OR q IS NOT NULL""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem")
    return trials.drop_all_null_rows(li.select(
        F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("p"),
        F.when(F.col("l_tax") > 0.04, F.col("l_partkey")).alias("q")))


@query("q_rebase_iter", f"""WITH {EV} SELECT run, iter, stage,
    CAST(iter - (stage - 1) * 20 AS BIGINT) AS stage_iter FROM ev""")
def _(spark, sf):
    return views.staged_events(spark, sf).select(
        "run", "iter", "stage", trials.rebase_iter("iter", views.STAGE).cast("bigint").alias("stage_iter"))


@query("q_best_score_per_run", f"WITH {OD} SELECT experiment, run, max(score) AS score FROM od GROUP BY ALL")
def _(spark, sf):
    return trials.best_score_per_run(views.orders_log(spark, sf))


@query("q_best_per_run", f"""WITH {OD} SELECT experiment, run, score, iter FROM (
    SELECT *, row_number() OVER (PARTITION BY experiment, run ORDER BY score DESC, iter) AS k FROM od) WHERE k = 1""")
def _(spark, sf):
    return trials.best_per_run(views.orders_log(spark, sf))


@query("q_best_info", f"""WITH {OD} SELECT run, iter, score, 'orders' AS name FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, iter) AS k FROM od) WHERE k = 1""")
def _(spark, sf):
    return trials.best_info(views.orders_log(spark, sf), "orders")


@query("q_best_per_group", f"""WITH {EV} SELECT experiment, run, stage, score, iter FROM (
    SELECT *, row_number() OVER (PARTITION BY experiment, run, stage ORDER BY score DESC, iter) AS k FROM ev) WHERE k = 1""")
def _(spark, sf):
    return trials.best_per_group(views.staged_events(spark, sf))


@query("q_best_rows", f"""WITH {OD} SELECT od.experiment, od.run, od.iter, od.score FROM od JOIN (
    SELECT experiment, run, max(score) AS score FROM od GROUP BY ALL) b
    ON od.experiment = b.experiment AND od.run = b.run AND od.score = b.score""")
def _(spark, sf):
    return trials.best_rows(views.orders_log(spark, sf)).select("experiment", "run", "iter", "score")


@query("q_last_iter_rows", f"""WITH {EV} SELECT run, iter, score, event_type FROM (
    SELECT *, max(iter) OVER (PARTITION BY run) AS last FROM ev) WHERE iter = last""")
def _(spark, sf):
    return trials.last_iter_rows(views.events_log(spark, sf, "event_type")).select("run", "iter", "score", "event_type")


@query("q_fill_from_stage", f"""WITH {EV}, two AS (
    SELECT run, score AS winner FROM (SELECT *, max(iter) OVER (PARTITION BY run) AS last FROM ev WHERE stage = 2)
    WHERE iter = last)
    SELECT ev.run, ev.iter, ev.score, two.winner FROM ev JOIN two ON ev.run = two.run WHERE stage = 3""")
def _(spark, sf):
    log = views.staged_events(spark, sf).withColumn("winner", F.col("score"))
    later, earlier = log.where("stage = 3"), log.where("stage = 2")
    return trials.fill_from_stage(later, earlier, ["winner"]).select("run", "iter", "score", "winner")


def _overlapping(spark, sf):
    """Stage 2 runs over iterations 11-50; stage 3 restarts at 31 and only goes to 40."""
    log = views.events_log(spark, sf)
    return log.where(F.col("iter").between(11, 50)), log.where(F.col("iter").between(31, 40))


@query("q_drop_overlap_intersect", f"""WITH {EV} SELECT run, iter, score FROM ev a WHERE iter BETWEEN 11 AND 50
    AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.run = a.run AND b.iter = a.iter AND b.iter BETWEEN 31 AND 40)""")
def _(spark, sf):
    return trials.drop_overlap(*_overlapping(spark, sf), mode="intersect").select("run", "iter", "score")


@query("q_drop_overlap_cut", f"""WITH {EV} SELECT a.run, a.iter, a.score FROM ev a LEFT JOIN (
    SELECT run, min(iter) AS start FROM ev WHERE iter BETWEEN 31 AND 40 GROUP BY run) s ON a.run = s.run
    WHERE a.iter BETWEEN 11 AND 50 AND (s.start IS NULL OR a.iter < s.start)""")
def _(spark, sf):
    return trials.drop_overlap(*_overlapping(spark, sf), mode="cut").select("run", "iter", "score")


@query("q_truncate_stage1", f"""WITH {EV}, s AS (SELECT run, min(iter) AS start FROM ev WHERE event_type = 'click' GROUP BY run)
    SELECT ev.run, ev.iter, ev.score FROM ev JOIN s ON ev.run = s.run WHERE ev.iter < s.start""")
def _(spark, sf):
    log = views.events_log(spark, sf, "event_type")
    return trials.truncate_stage1(log, log.where("event_type = 'click'")).select("run", "iter", "score")


@query("q_merge_on_shared", f"""WITH {OD} SELECT experiment, run, iter, score, total FROM od
    JOIN (SELECT run, count(*) AS total FROM od GROUP BY run) t USING (run)""")
def _(spark, sf):
    log = views.orders_log(spark, sf)
    return trials.merge_on_shared(log, log.groupBy("run").agg(F.count("*").alias("total")))


@query("q_rank", f"""WITH {EV} SELECT run, stage, iter, score,
    rank() OVER (PARTITION BY run, stage ORDER BY score DESC) AS rank FROM ev""")
def _(spark, sf):
    return trials.rank_trials(views.staged_events(spark, sf).select("run", "stage", "iter", "score"))


@query("q_rank_ties", f"""WITH {LI} SELECT experiment, run, iter, rank() OVER (PARTITION BY experiment ORDER BY l.score DESC) AS rank
    FROM (SELECT experiment, run, iter, floor(score / 20000) AS score FROM li) l""")
def _(spark, sf):
    """Few different scores, each of very many rows: ranks come from counts."""
    log = views.lines_log(spark, sf).withColumn("score", F.floor(F.col("score") / 20000))
    return trials.rank_trials(log, ["experiment"]).drop("score")


@query("q_topk", f"WITH {LI} SELECT experiment, run, iter, score FROM li ORDER BY score DESC, experiment, run, iter LIMIT 5")
def _(spark, sf):
    return trials.top_k(views.lines_log(spark, sf), 5)


@query("q_union_trials", f"""WITH {EV}, {OD}, u AS (
    SELECT experiment, run, iter, score, event_type FROM ev
    UNION ALL SELECT experiment, run, iter, score, NULL FROM od)
    SELECT experiment, count(*) AS n, count(event_type) AS typed, round(sum(score), 2) AS total FROM u GROUP BY experiment""")
def _(spark, sf):
    both = trials.union_trials(views.events_log(spark, sf, "event_type"), views.orders_log(spark, sf))
    return rounded(both.groupBy("experiment").agg(
        F.count("*").alias("n"), F.count("event_type").alias("typed"), F.sum("score").alias("total")), "total", places=2)


@query("q_intersect_iters", f"""WITH {EV} SELECT run, iter FROM ev WHERE event_type = 'click'
    INTERSECT SELECT run, iter FROM ev WHERE score > 10""")
def _(spark, sf):
    log = views.events_log(spark, sf, "event_type")
    return trials.intersect_iters(log.where("event_type = 'click'"), log.where("score > 10"))


@query("q_distinct_configs", """SELECT min(event_id) AS trial_id, event_type, k FROM (
    SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type, k""")
def _(spark, sf):
    ev = views.table(spark, sf, "events").select(
        "event_id", "event_type", P.parse_params("props")["k"].alias("k"))
    return trials.distinct_configs(ev, ["event_type", "k"], "event_id").withColumnRenamed("event_id", "trial_id")


@query("q_except_columns", f"""WITH {EV} SELECT run, stage, round(avg(score), 6) AS score, max(iter) AS iter FROM ev GROUP BY ALL""")
def _(spark, sf):
    """Columns of a log but for the ids and texts, each with its own aggregate."""
    log = views.staged_events(spark, sf, "event_type")
    left = trials.except_columns(log.columns, ["experiment", "event_type"], ["run", "stage"])
    return rounded(log.groupBy("run", "stage").agg(*[{"score": F.avg, "iter": F.max}[c](c).alias(c) for c in left]), "score")


@query("q_ordered_summary", f"""WITH {OD}, b AS (SELECT experiment AS method, run, max(score) AS s FROM od GROUP BY ALL)
    SELECT method, round(avg(s), 6) AS mean, CAST(CASE method WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS INTEGER) AS ord
    FROM b WHERE method IN ('5-LOW', '1-URGENT', '3-MEDIUM') GROUP BY method""")
def _(spark, sf):
    best = trials.best_score_per_run(views.orders_log(spark, sf))
    summary = best.groupBy(F.col("experiment").alias("method")).agg(F.round(F.avg("score"), 6).alias("mean"))
    return trials.ordered_summary(summary, ["5-LOW", "1-URGENT", "3-MEDIUM"])


# Parameters

@query("q_params_map", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events""")
def _(spark, sf):
    ev = views.table(spark, sf, "events").withColumn("params", P.parse_params("props"))
    return P.params_to_columns(ev, ["k"], prefix="").select("event_id", "k")


@query("q_params_ordered_dict", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value AS v FROM events""")
def _(spark, sf):
    ev = views.table(spark, sf, "events").withColumn("text", F.format_string(
        "OrderedDict([('k', %s), ('v', %s)])", F.get_json_object("props", "$.k"), F.col("value").cast("string")))
    return ev.select("event_id", P.parse_params("text").alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["v"].alias("v"))


def _param_events(spark, sf):
    log = views.staged_events(spark, sf, "event_type", "props").withColumn("params", P.parse_params("props"))
    return log.withColumn("experiment", F.col("event_type"))


@query("q_param_stats", f"""WITH {EV}, w AS (
    SELECT event_type AS experiment, CAST(json_extract(props, '$.k') AS DOUBLE) AS v,
           row_number() OVER (PARTITION BY event_type, run ORDER BY score DESC, iter) AS r FROM ev)
    SELECT experiment, 'k' AS param, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS runs
    FROM w WHERE r = 1 GROUP BY experiment""")
def _(spark, sf):
    return rounded(stats.param_stats(_param_events(spark, sf)), "mean", "std")


@query("q_param_long", """SELECT l_returnflag AS experiment, l_extendedprice AS score, param, value FROM (
    SELECT l_returnflag, l_extendedprice, 'l_discount' AS param, l_discount AS value FROM lineitem
    UNION ALL SELECT l_returnflag, l_extendedprice, 'l_quantity', l_quantity FROM lineitem
    UNION ALL SELECT l_returnflag, l_extendedprice, 'l_tax', l_tax FROM lineitem)""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "experiment", "l_extendedprice": "score"})
    return stats.param_long(li, ["l_discount", "l_quantity", "l_tax"])


@query("q_fill_params_const", """SELECT event_id,
    CASE event_type WHEN 'click' THEN 0.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE k END AS param_k,
    CASE event_type WHEN 'view' THEN 9.0::DOUBLE END AS param_lambda
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)""")
def _(spark, sf):
    ev = views.table(spark, sf, "events").withColumn("param_k", P.parse_params("props")["k"])
    filled = P.fill_params_const(ev, {"click": {"k": 0.0}, "view": {"k": 0.5, "lambda": 9.0}}, "event_type")
    return filled.select("event_id", "param_k", "param_lambda")


@query("q_fill_params_from_best", f"""WITH {EV}, w AS (
    SELECT run, stage, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
           row_number() OVER (PARTITION BY run, stage ORDER BY score DESC, iter) AS r FROM ev)
    SELECT ev.run, ev.iter,
           coalesce(CASE WHEN ev.stage = 1 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END, a.k) AS param_a,
           coalesce(CASE WHEN ev.stage = 2 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END, b.k) AS param_b
    FROM ev LEFT JOIN (SELECT * FROM w WHERE r = 1 AND stage = 1) a ON ev.run = a.run
            LEFT JOIN (SELECT * FROM w WHERE r = 1 AND stage = 2) b ON ev.run = b.run""")
def _(spark, sf):
    k = P.parse_params("props")["k"]
    log = views.staged_events(spark, sf, "props").withColumns({
        "param_a": F.when(F.col("stage") == 1, k), "param_b": F.when(F.col("stage") == 2, k)})
    log = log.withColumn("params", P.columns_to_params(["a", "b"]))
    return trials.fill_params_from_best(log, ["a", "b"]).select("run", "iter", "param_a", "param_b")


@query("q_scalar_functions", """SELECT event_id, CAST(round_even(value, 0) AS INTEGER) AS whole,
    coalesce(CASE WHEN value > 5 THEN value END, -999.0) AS replaced, 1 - value AS loss,
    round_even(value * 0.25, 0) AS quantised, event_type || ' ' || CAST(user_id AS VARCHAR) || ' run' AS label FROM events""")
def _(spark, sf):
    ev = views.table(spark, sf, "events")
    score = F.when(F.col("value") > 5, F.col("value")).otherwise(F.lit(float("nan")))
    return ev.select(
        "event_id", P.round_to_int("value").alias("whole"), P.nan_replacement(score).alias("replaced"),
        P.loss("value").alias("loss"), P.quantise_param("value", 0.25).alias("quantised"),
        P.format_label("event_type", "user_id").alias("label"))


# Columns

@query("q_null_counts", """SELECT 'a' AS "column", CAST(count_if(l_tax > 0.04) AS BIGINT) AS nulls FROM lineitem
    UNION ALL SELECT 'b', CAST(count_if(l_returnflag = 'A') AS BIGINT) FROM lineitem
    UNION ALL SELECT 'c', CAST(count_if(l_partkey IS NULL) AS BIGINT) FROM lineitem""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem")
    return stats.null_counts(li.select(
        F.when(F.col("l_tax") <= 0.04, 1).alias("a"), F.when(F.col("l_returnflag") != "A", 1).alias("b"),
        F.col("l_partkey").alias("c")))


@query("q_describe", """SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
    round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
    round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
    round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem""")
def _(spark, sf):
    out = stats.describe_scores(views.table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(out, "mean", "std", "q25", "q50", "q75")


@query("q_describe_by", """SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean,
    round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max,
    round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.5), 6) AS q50,
    round(quantile_cont(l_quantity, 0.75), 6) AS q75 FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    out = stats.describe_scores(views.table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    return rounded(out, "mean", "std", "q25", "q50", "q75")


@query("q_value_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return stats.value_counts(views.table(spark, sf, "events"), "event_type", "user_id")


@query("q_distinct_summary", """SELECT count(*) AS distinct_values, max(n) AS max_count FROM (
    SELECT value, count(*) AS n FROM events GROUP BY value)""")
def _(spark, sf):
    return stats.distinct_summary(views.table(spark, sf, "events"), "value")


@query("q_column_max", """SELECT max(l_quantity) AS l_quantity, max(l_discount) AS l_discount,
    max(greatest(l_tax, l_discount)) AS row_max FROM lineitem""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumn("row_max", stats.row_max(["l_tax", "l_discount"]))
    return stats.column_max(li, ["l_quantity", "l_discount", "row_max"])
