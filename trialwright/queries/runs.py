"""Searches of many runs at once.  A run is a nation; a line number, a supplier group and a month are tuned one after another."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trialwright.operators import space
from trialwright.plans import black_box, runs, views
from trialwright.queries.registry import query, rounded, uniform_sql
from trialwright.session import scratch_path

# Name, first value, number of values.
TUNED = [("line", 1, 7), ("grp", 0, 10), ("month", 1, 12)]
FIRST, BUDGET, SEED = 30, 90, 11

_DATA = """data AS (SELECT l_linenumber::DOUBLE AS line, (l_suppkey % 10)::DOUBLE AS grp, month(l_shipdate)::DOUBLE AS month, l_quantity AS q FROM lineitem)"""


def _stage_sql(i: int, stop: int, global_best: bool) -> str:
    """Tables c, s, w of stage ``i``: its trials with scores, its kept trials, and each run's winner and trials used."""
    names = [n for n, _, _ in TUNED[:i]]
    name, low, size = TUNED[i - 1]
    before = f"w{i - 1}" if i > 1 else f"(SELECT n_nationkey AS run, 0 AS used, {FIRST}::BIGINT AS next FROM nation)"
    value = f"{low} + floor({uniform_sql('run', 't', repr(name), seed=SEED + i)} * {size})"
    frozen = "".join(f", {n}" for n in names[:-1])
    left = {1: 2, 2: 1, 3: 1}[i]
    # The first plateau that held ends a run; the rule of the best trial counts all trials after it.
    held = f"(SELECT run, min(CASE WHEN last - first >= {stop} THEN first + {stop} END) AS stop FROM p{i} GROUP BY run)"
    best = f"(SELECT run, arg_min(t, (-score, t)) + {stop} AS stop FROM x{i} WHERE score IS NOT NULL GROUP BY run)"
    cut, kept = (best, "t < stop") if global_best else (held, "stop IS NULL OR pos < stop OR (pos = stop AND score IS NOT NULL)")
    return f""", c{i} AS (
    SELECT run, used AS base, t, {value}::DOUBLE AS {name}{frozen} FROM (SELECT *, unnest(range(0, next)) AS t FROM {before})), m{i} AS (
    SELECT {', '.join(names)}, avg(q) AS score FROM data GROUP BY ALL), x{i} AS (
    SELECT c.*, m.score, max(m.score) OVER run AS best, count(m.score) OVER run AS pos FROM c{i} c LEFT JOIN m{i} m USING ({', '.join(names)})
    WINDOW run AS (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING)), p{i} AS (
    SELECT run, best, min(pos) AS first, max(pos) AS last FROM x{i} WHERE score IS NOT NULL GROUP BY run, best), s{i} AS (
    SELECT x.* FROM x{i} x JOIN {cut} e USING (run) WHERE {kept}), w{i} AS (
    SELECT run, max(base) + max(t) + 1 AS used, round_even(({BUDGET} - (max(base) + max(t) + 1)) / {left}.0, 0)::BIGINT AS next,
           {', '.join(f"arg_min({n}, (-score, t)) AS {n}" for n in names)} FROM s{i} GROUP BY run)"""


def _search_sql(stop: int, global_best: bool = False) -> str:
    stages = "".join(_stage_sql(i, stop, global_best) for i in range(1, len(TUNED) + 1))
    rows = " UNION ALL ".join(
        f"SELECT run, {i} AS stage, base + t + 1 AS iter, {', '.join((n if k < i else 'NULL::DOUBLE') + ' AS ' + n for k, (n, _, _) in enumerate(TUNED))}, "
        f"round(score, 6) AS score FROM s{i}" for i in range(1, len(TUNED) + 1))
    return f"WITH {_DATA}{stages} {rows}"


def _objective(spark, sf):
    """Mean quantity of the line items that a candidate's parameters pick."""
    li = views.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("line"), (F.col("l_suppkey") % 10).cast("double").alias("grp"),
        F.month("l_shipdate").cast("double").alias("month"), "l_quantity")

    def score(candidates):
        names = candidates.columns[2:]
        return candidates.join(li.groupBy(*names).agg(F.avg("l_quantity").alias("score")), names)

    return score


def _search(spark, sf, **how):
    stages = [runs.RunStage([space.Param(n, "int", low, low + size)], **how) for n, low, size in TUNED]
    nations = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("run"))
    return runs.search_runs(nations, _objective(spark, sf), stages, FIRST, BUDGET, seed=SEED)


def _log(result):
    return rounded(result.log.select("run", "stage", "iter", *[F.col("params")[n].alias(n) for n, _, _ in TUNED], "score"), "score")


@query("q_search_runs", _search_sql(6))
def _(spark, sf):
    """Every run stops each stage once its best has held for six trials; later stages have what is left."""
    return _log(_search(spark, sf, batch=10, max_no_improve=6))


@query("q_search_runs_cut", _search_sql(9, True))
def _(spark, sf):
    """Every stage in full, cut eight trials after its best one; the cuts set the next budgets."""
    return _log(_search(spark, sf, batch=BUDGET, global_best=9))


@query("q_search_runs_summary", f"""{_search_sql(6).rpartition(" SELECT run, 1 AS stage")[0]}
    SELECT run, (SELECT count(*) FROM s1 WHERE s1.run = w3.run) AS trials_1, (SELECT count(*) FROM s2 WHERE s2.run = w3.run) AS trials_2,
           (SELECT count(*) FROM s3 WHERE s3.run = w3.run) AS trials_3, line, grp, month FROM w3""")
def _(spark, sf):
    """Each run's trials per stage and its winning parameters."""
    found = _search(spark, sf, batch=30, max_no_improve=6).runs
    return found.select("run", *[F.col("trials")[i].alias(f"trials_{i}") for i in (1, 2, 3)], *[F.col("params")[n].alias(n) for n, _, _ in TUNED])


@query("q_function_objective", """SELECT n_nationkey AS trial_id, CAST(n_regionkey AS DOUBLE) AS x, CAST(n_nationkey % 5 AS DOUBLE) AS y,
    round(CASE WHEN n_regionkey <> 3 THEN 10 - (n_regionkey - 2) ** 2 + sin(n_nationkey % 5) END, 6) AS score FROM nation""")
def _(spark, sf):
    """Any Python function as objective, one configuration a task; one that raises has no score."""

    def fn(x, y):
        if x == 3:
            raise ValueError("refused")
        return 10 - (x - 2) ** 2 + math.sin(y)

    nations = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("trial_id"), F.col("n_regionkey").cast("double").alias("x"),
                                                      (F.col("n_nationkey") % 5).cast("double").alias("y"))
    scored = black_box.function_objective(fn, scratch_path(spark, "results"), 60, 0)(nations)
    return rounded(scored.select("trial_id", "x", "y", "score"), "score")
