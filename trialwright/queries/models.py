"""Boosting, cross-validation, searches and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialwright.functions.params import parse_params
from trialwright.operators import boost, evaluate, prep, propose, space
from trialwright.plans import search, views
from trialwright.queries.data import KEY_SQL, LABEL_SQL
from trialwright.queries.registry import EV, hash_sql, query, rounded, uniform_sql
from trialwright.session import FIT_ROWS, bounded, scratch_path, spread
from trialwright.sources import records

NUMERIC = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]
FOLDS = 3


def binned_lines(spark, sf, features=None, binning="quantile", bins=32):
    data = evaluate.assign_folds(spread(views.lines_features(spark, sf), views.LINE_KEYS), FOLDS, views.LINE_KEYS)
    return boost.bin_table(data, features or views.FEATURES, "label", views.LINE_KEYS, bins=bins, binning=binning)


# One round of stumps on equal-width bins: (trial, fold) -> r2 on the held-out and the training rows.
STUMPS = {0: (0.0, 1.0), 1: (5e7, 0.0), 2: (0.0, 20000.0)}


def _stump_sql(final: str, held_from: int = 0, held_to: int = FOLDS, bins: int = 16) -> str:
    """Common table expressions that fit the stumps of STUMPS for every held-out fold, then ``final``."""
    features = ", ".join(NUMERIC)
    long = " UNION ALL ".join(f"SELECT fold, y, {i} AS feature, {c} AS v FROM x" for i, c in enumerate(NUMERIC))
    trials = " UNION ALL ".join(f"SELECT {t} AS trial_id, {a}::DOUBLE AS alpha, {lam}::DOUBLE AS lam" for t, (a, lam) in STUMPS.items())
    shrink = lambda g: f"sign({g}) * greatest(abs({g}) - alpha, 0)"
    above = " + ".join(f"CAST(lo + (hi - lo) * {i} / {bins} < v AS INTEGER)" for i in range(1, bins))
    routed = " ".join(f"WHEN {i} THEN x.{c}" for i, c in enumerate(NUMERIC))
    return f"""WITH x AS (SELECT CAST({hash_sql(*KEY_SQL)} % {FOLDS} AS INTEGER) AS fold, l_returnflag, {features}, {LABEL_SQL} AS y FROM lineitem),
    unit AS (SELECT 1048576 / (max(y) - min(y)) AS unit, (min(y) + max(y)) / 2 AS centre FROM x),
    pairs AS (SELECT * FROM ({trials}), (SELECT CAST(range AS INTEGER) AS held FROM range({held_from}, {held_to}))),
    bases AS (SELECT held, sum(CAST(round_even(y * unit, 0) AS BIGINT)) / max(unit) / count(*) AS base
              FROM x, unit, (SELECT CAST(range AS INTEGER) AS held FROM range({held_from}, {held_to})) h WHERE x.fold <> h.held GROUP BY held),
    long AS ({long}), ends AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature),
    edges AS (SELECT feature, range AS i, lo + (hi - lo) * range / {bins} AS edge FROM ends, range(1, {bins})),
    binned AS (SELECT fold, y, feature, 1 + {above} AS bin FROM long JOIN ends USING (feature)),
    cells AS (SELECT held, feature, bin, CAST(sum(CAST(round_even((base - y) * unit, 0) AS BIGINT)) AS DOUBLE) AS g, count(*)::DOUBLE AS h
              FROM binned, unit, bases WHERE fold <> held GROUP BY held, feature, bin),
    p AS (SELECT held, feature, bin, sum(g) OVER w / unit AS gl, sum(h) OVER w AS hl,
                 sum(g) OVER (PARTITION BY held, feature) / unit AS gt, sum(h) OVER (PARTITION BY held, feature) AS ht
          FROM cells, unit WINDOW w AS (PARTITION BY held, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT p.*, trial_id, lam, {shrink('gl')} AS sl, {shrink('(gt - gl)')} AS sr, {shrink('gt')} AS sn FROM p JOIN pairs USING (held)),
    q AS (SELECT *, sl * sl / nullif(hl + lam, 0) + sr * sr / nullif(ht - hl + lam, 0) - sn * sn / nullif(ht + lam, 0) AS gain FROM s
          WHERE hl >= 1 AND ht - hl >= 1),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, held ORDER BY gain DESC, feature, bin) AS k FROM q WHERE gain > 0)
             WHERE k = 1),
    trees AS (SELECT pairs.trial_id, pairs.held, base, best.feature, best.bin, edge, -0.3 * sl / (hl + best.lam) AS wl,
                     -0.3 * sr / (ht - hl + best.lam) AS wr
              FROM pairs JOIN bases ON bases.held = pairs.held
                   LEFT JOIN best ON best.held = pairs.held AND best.trial_id = pairs.trial_id
                   LEFT JOIN edges e ON e.feature = best.feature AND e.i = best.bin),
    scored AS (SELECT trial_id, held AS fold, x.fold = held AS isTest, l_returnflag, y,
                      base + CASE WHEN trees.feature IS NULL THEN 0 WHEN (CASE trees.feature {routed} END) <= edge THEN wl ELSE wr END AS pred FROM x, trees)
    {final}"""


_R2 = "1 - sum((y - pred) ** 2) / (var_pop(y) * count(*))"
_STUMP = {"max_depth": 1, "rounds": 1, "eta": 0.3}


@query("q_boost_stump_cv", _stump_sql(f"""SELECT CAST(trial_id AS BIGINT) AS trial_id, fold, isTest, round({_R2}, 6) AS r2
    FROM scored GROUP BY ALL"""))
def _(spark, sf):
    data = binned_lines(spark, sf, NUMERIC, "width", 16)
    params = {t: {**_STUMP, "alpha": a, "lambda": lam} for t, (a, lam) in STUMPS.items()}
    scores = boost.fit_boosted(data, params, range(FOLDS)).scores()
    return scores.where("metric = 'r2'").select("trial_id", "fold", "isTest", F.round("value", 6).alias("r2"))


@query("q_cross_validate", _stump_sql(f""", r AS (SELECT trial_id, fold, {_R2} AS r2 FROM scored WHERE isTest GROUP BY ALL),
    m AS (SELECT trial_id, avg(r2) AS score, stddev_pop(r2) AS std, list(r2 ORDER BY fold) AS splits FROM r GROUP BY trial_id)
    SELECT CAST(trial_id AS BIGINT) AS trial_id, alpha, lam AS "lambda", round(score, 6) AS score, round(std, 6) AS std,
           round(splits[2], 6) AS split1, rank() OVER (ORDER BY score DESC) AS rank
    FROM m JOIN (SELECT DISTINCT trial_id, alpha, lam FROM pairs) USING (trial_id)"""))
def _(spark, sf):
    """Trial log of candidates (alpha, lambda) with the other parameters frozen."""
    rows = [STUMPS[t] for t in sorted(STUMPS)]
    log, _ = search.cross_validate(binned_lines(spark, sf, NUMERIC, "width", 16), _candidates(spark, rows, ["alpha", "lambda"]), FOLDS, _STUMP)
    return rounded(log.select("trial_id", "alpha", "lambda", "score", "std", F.col("splits")[1].alias("split1"), "rank"), "score", "std", "split1")


def _rounds_sql(rounds: int, final: str, bins: int = 16) -> str:
    """The stumps of STUMPS boosted for some rounds: tables m1, m2, .. of every row's margin after each, then ``final``."""
    shrink = lambda g: f"sign({g}) * greatest(abs({g}) - alpha, 0)"
    head, routed = _stump_sql("").rpartition("cells AS (")[0], " ".join(f"WHEN {i} THEN x.{c}" for i, c in enumerate(NUMERIC))
    head = head.replace("WITH x AS (SELECT", "WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid,", 1).replace("SELECT fold, y,", "SELECT rid,")
    head = head.replace("SELECT fold, y, feature, 1 +", "SELECT rid, feature, 1 +")
    text = head + f"""m0 AS (SELECT rid, x.fold, y, trial_id, pairs.held, alpha, lam, base AS m FROM x, pairs JOIN bases ON bases.held = pairs.held)"""
    for r in range(1, rounds + 1):
        text += f""", cells{r} AS (
    SELECT trial_id, held, alpha, lam, feature, bin, CAST(sum(CAST(round_even((m - y) * unit, 0) AS BIGINT)) AS DOUBLE) / max(unit) AS g, count(*)::DOUBLE AS h
    FROM m{r - 1} JOIN binned USING (rid), unit WHERE fold <> held GROUP BY ALL), p{r} AS (
    SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY trial_id, held, feature) AS gt, sum(h) OVER (PARTITION BY trial_id, held, feature) AS ht
    FROM cells{r} WINDOW w AS (PARTITION BY trial_id, held, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)), s{r} AS (
    SELECT *, {shrink('gl')} AS sl, {shrink('(gt - gl)')} AS sr, {shrink('gt')} AS sn FROM p{r}), q{r} AS (
    SELECT *, sl * sl / nullif(hl + lam, 0) + sr * sr / nullif(ht - hl + lam, 0) - sn * sn / nullif(ht + lam, 0) AS gain FROM s{r}), best{r} AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, held ORDER BY gain DESC, feature, bin) AS k FROM q{r}
                   WHERE gain > 0 AND hl >= 1 AND ht - hl >= 1) WHERE k = 1), root{r} AS (
    SELECT trial_id, held, max(-0.3 * sn / (ht + lam)) AS w FROM s{r} WHERE feature = 0 GROUP BY ALL), tree{r} AS (
    SELECT root.trial_id, root.held, root.w, b.feature, edge, -0.3 * sl / (hl + b.lam) AS wl, -0.3 * sr / (ht - hl + b.lam) AS wr
    FROM root{r} root LEFT JOIN best{r} b ON b.trial_id = root.trial_id AND b.held = root.held LEFT JOIN edges e ON e.feature = b.feature AND e.i = b.bin), m{r} AS (
    SELECT m.rid, m.fold, m.y, m.trial_id, m.held, m.alpha, m.lam,
           m + CASE WHEN t.feature IS NULL THEN w WHEN (CASE t.feature {routed} END) <= edge THEN wl ELSE wr END AS m
    FROM m{r - 1} m JOIN x USING (rid) JOIN tree{r} t ON t.trial_id = m.trial_id AND t.held = m.held)"""
    return text + final


_ROUNDS = 3
_ROUND_R2 = " UNION ALL ".join(f"SELECT trial_id, held AS fold, {r} AS round, fold = held AS isTest, 1 - sum((y - m) ** 2) / (var_pop(y) * count(*)) AS r2 FROM m{r} GROUP BY ALL"
                               for r in range(1, _ROUNDS + 1))
_SEVERAL = {**_STUMP, "rounds": _ROUNDS}


@query("q_boost_rounds", _rounds_sql(_ROUNDS, f" SELECT CAST(trial_id AS BIGINT) AS trial_id, fold, round, isTest, round(r2, 6) AS r2 FROM ({_ROUND_R2})"))
def _(spark, sf):
    """Held-out and training metric of every boosting round, all trials and folds together."""
    params = {t: {**_SEVERAL, "alpha": a, "lambda": lam} for t, (a, lam) in STUMPS.items()}
    scores = boost.fit_boosted(binned_lines(spark, sf, NUMERIC, "width", 16), params, range(FOLDS)).scores()
    return scores.where("metric = 'r2'").select("trial_id", "fold", "round", "isTest", F.round("value", 6).alias("r2"))


@query("q_last_round", _rounds_sql(_ROUNDS, f" SELECT CAST(trial_id AS BIGINT) AS trial_id, round(avg(r2), 6) AS score FROM ({_ROUND_R2}) WHERE round = {_ROUNDS} AND isTest GROUP BY trial_id"))
def _(spark, sf):
    """Mean held-out metric of the last round, from the metrics that cross-validation keeps."""
    rows = [STUMPS[t] for t in sorted(STUMPS)]
    _, metrics = search.cross_validate(binned_lines(spark, sf, NUMERIC, "width", 16), _candidates(spark, rows, ["alpha", "lambda"]), FOLDS, _SEVERAL)
    return rounded(evaluate.last_round(metrics), "score")


@query("q_default_stump", _stump_sql(f""", r AS (SELECT fold, {_R2} AS r2 FROM scored WHERE isTest AND trial_id = 0 GROUP BY ALL)
    SELECT CAST(0 AS BIGINT) AS trial_id, 1::DOUBLE AS max_depth, round(avg(r2), 6) AS score, round(stddev_pop(r2), 6) AS std FROM r"""))
def _(spark, sf):
    """The one configuration of the trainer's defaults, but for the depth."""
    log, _ = search.cross_validate(binned_lines(spark, sf, NUMERIC, "width", 16), space.default_config(spark, {"max_depth": 1.0}), FOLDS, {"rounds": 1, "eta": 0.3})
    return rounded(log.select("trial_id", "max_depth", "score", "std"), "score", "std")


def _class_sql(held: int = 0, bins: int = 16) -> str:
    """One round of softmax stumps for the return flag, one stump a class, and the accuracy on both sides of a fold."""
    long = " UNION ALL ".join(f"SELECT rid, fold, label, {i} AS feature, {c} AS v FROM x" for i, c in enumerate(NUMERIC))
    above = " + ".join(f"CAST(lo + (hi - lo) * {i} / {bins} < v AS INTEGER)" for i in range(1, bins))
    routed, unit = " ".join(f"WHEN {i} THEN x.{c}" for i, c in enumerate(NUMERIC)), "1048576"
    leaf = lambda k: f"sum(CASE WHEN t.k = {k} THEN CASE WHEN t.feature IS NULL THEN w WHEN (CASE t.feature {routed} END) <= edge THEN wl ELSE wr END END)"
    return f"""WITH names AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS INTEGER) AS label FROM lineitem GROUP BY l_returnflag),
    x AS MATERIALIZED (SELECT row_number() OVER () AS rid, CAST({hash_sql(*KEY_SQL)} % {FOLDS} AS INTEGER) AS fold, label, {', '.join(NUMERIC)}
                       FROM lineitem JOIN names USING (l_returnflag)),
    long AS ({long}), ends AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature),
    edges AS (SELECT feature, range AS i, lo + (hi - lo) * range / {bins} AS edge FROM ends, range(1, {bins})),
    binned AS (SELECT rid, fold, label, feature, 1 + {above} AS bin FROM long JOIN ends USING (feature)),
    cells AS (SELECT k, feature, bin, sum(CAST(round_even((1.0::DOUBLE / 3 - CAST(label = k AS INTEGER)) * {unit}, 0) AS BIGINT)) / {unit}::DOUBLE AS g,
                     sum(CAST(round_even((1.0::DOUBLE / 3 * (1 - 1.0::DOUBLE / 3)) * {unit}, 0) AS BIGINT)) / {unit}::DOUBLE AS h
              FROM binned, range(0, 3) c(k) WHERE fold <> {held} GROUP BY ALL),
    p AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY k, feature) AS gt, sum(h) OVER (PARTITION BY k, feature) AS ht
          FROM cells WINDOW w AS (PARTITION BY k, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM p),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, feature, bin) AS place FROM q
                            WHERE gain > 0 AND hl >= 1 AND ht - hl >= 1) WHERE place = 1),
    t AS (SELECT r.k, r.w, b.feature, edge, -0.3 * b.gl / (b.hl + 1) AS wl, -0.3 * (b.gt - b.gl) / (b.ht - b.hl + 1) AS wr
          FROM (SELECT k, max(-0.3 * gt / (ht + 1)) AS w FROM q WHERE feature = 0 GROUP BY k) r LEFT JOIN best b ON b.k = r.k
               LEFT JOIN edges e ON e.feature = b.feature AND e.i = b.bin),
    z AS (SELECT x.rid, x.fold, x.label, {', '.join(f'{leaf(k)} AS z{k}' for k in range(3))} FROM x, t GROUP BY ALL)
    SELECT 1 AS round, fold = {held} AS isTest, round(avg(CAST(label = CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS DOUBLE)), 6) AS accuracy
    FROM z GROUP BY ALL"""


@query("q_class_stumps", _class_sql())
def _(spark, sf):
    """One round of softmax boosting of the return flag."""
    li = spread(views.table(spark, sf, "lineitem").withColumns({f"__k{i}": c.cast("string") for i, c in enumerate(views.line_key())}), views.LINE_KEYS)
    data = evaluate.assign_folds(prep.index_labels(li, "l_returnflag"), FOLDS, views.LINE_KEYS)
    table = boost.bin_table(data, NUMERIC, "label", views.LINE_KEYS, bins=16, binning="width", classes=3)
    fitted = boost.fit_boosted(table, {0: {"max_depth": 1, "eta": 0.3, "rounds": 1}}, [0])
    return rounded(fitted.scores().select("round", "isTest", F.col("value").alias("accuracy")), "accuracy")


@query("q_predict", _stump_sql(f"""SELECT CAST(l_returnflag = 'A' AS INTEGER) AS l_returnflag_A, count(*) AS n,
    round(avg(pred), 4) AS mean, round({_R2}, 6) AS r2 FROM scored WHERE trial_id = 0 GROUP BY ALL""", -1, 0))
def _(spark, sf):
    """Predictions of a model fitted on all rows, summarised by flag."""
    model = boost.fit_boosted(binned_lines(spark, sf, NUMERIC, "width", 16), {0: {**_STUMP, "alpha": 0.0, "lambda": 1.0}})
    out = model.predict(views.lines_features(spark, sf)).groupBy("l_returnflag_A").agg(
        F.count("*").alias("n"), F.round(F.avg("prediction"), 4).alias("mean"), evaluate.r2().alias("r2"))
    return rounded(out, "r2")


def _candidates(spark, rows, names):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"trial_id long, {', '.join(n + ' double' for n in names)}")


@query("q_boost_cv")
def boost_cv(spark, sf):
    """Four configurations, all six parameters in play, three folds in one pass."""
    rows = [(3, 1, 0, 1, 1.0, 1.0), (2, 50, 0, 1, 0.7, 1.0), (3, 1, 1000, 50, 1.0, 0.6), (1, 1, 0, 0, 0.6, 0.8)]
    names = ["max_depth", "min_child_weight", "alpha", "lambda", "subsample", "colsample_bytree"]
    log, _ = search.cross_validate(binned_lines(spark, sf), _candidates(spark, rows, names), FOLDS, {"rounds": 4, "eta": 0.3})
    return rounded(log.drop("splits", "mean_fit_time", "mean_score_time"), "score", "std")


@query("q_cv_last_round")
def _(spark, sf):
    """Per trial the last and the best round of the test metric."""
    log, metrics = search.cross_validate(
        binned_lines(spark, sf, NUMERIC), _candidates(spark, [(2, 1), (1, 10)], ["max_depth", "min_child_weight"]), FOLDS,
        {"rounds": 3, "eta": 0.3})
    return rounded(evaluate.last_round(metrics), "score")


@query("q_default_config")
def _(spark, sf):
    log, _ = search.cross_validate(binned_lines(spark, sf, NUMERIC), space.default_config(spark), FOLDS, {"rounds": 2})
    return rounded(log.select("trial_id", "max_depth", "score", "std"), "score", "std")


@query("q_mllib_regressor")
def _(spark, sf):
    li = bounded(views.lines_features(spark, sf), views.LINE_KEYS)
    data = prep.assemble_features(li.select(*NUMERIC, "label", *views.LINE_KEYS), NUMERIC, keep=views.LINE_KEYS)
    train, test = prep.random_split(data, [0.7, 0.3], views.LINE_KEYS, 18)
    model = boost.mllib_regressor({"max_depth": 3, "rounds": 3, "eta": 0.3, "lambda": 0.0}).fit(train)
    return rounded(model.transform(test).agg(F.count("*").alias("rows"), evaluate.r2().alias("r2")), "r2")


def _price_classes(spark, sf, task_rows=None):
    """Line items in three classes by price tercile."""
    li = spread(views.lines_features(spark, sf), views.LINE_KEYS, task_rows)
    low, high = li.select(F.percentile_approx("l_extendedprice", [1 / 3, 2 / 3], 10_000)).first()[0]
    price = F.col("l_extendedprice")
    return li.withColumn("class", F.when(price <= low, "low").when(price <= high, "mid").otherwise("top"))


@query("q_boost_classifier")
def _(spark, sf):
    """Softmax boosting of the price class: accuracy per round on held-out and training rows."""
    data = prep.index_labels(_price_classes(spark, sf).drop("label"), "class")
    data = evaluate.assign_folds(data, FOLDS, views.LINE_KEYS)
    table = boost.bin_table(data, NUMERIC, "label", views.LINE_KEYS, classes=3)
    fitted = boost.fit_boosted(table, {0: {"max_depth": 2, "eta": 0.3, "rounds": 3}}, [0])
    return rounded(fitted.scores().select("round", "isTest", F.col("value").alias("accuracy")), "accuracy")


@query("q_mllib_classifier")
def _(spark, sf):
    """One boosted binary model per class, scored on a held-out part."""
    data = prep.index_labels(_price_classes(spark, sf, FIT_ROWS).drop("label"), "class")
    data = prep.assemble_features(data.select(*NUMERIC, "label", *views.LINE_KEYS), NUMERIC, keep=views.LINE_KEYS)
    train, test = prep.random_split(data, [0.7, 0.3], views.LINE_KEYS, 18)
    out = boost.mllib_classifier(2, 2, 0.3).fit(train).transform(test)
    return rounded(out.agg(F.count("*").alias("rows"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")), "accuracy")


@query("q_grouped_search")
def grouped_search(spark, sf):
    """Three stages: depth and child weight at random, penalties from a grid, sampling by expected improvement."""
    s = space.SEARCH_SPACE
    depth = [space.Param("max_depth", "int", 1, 4), s[1]]
    stages = [
        search.Stage(depth, 4, "distinct"),
        search.Stage([], 4, "grid", grid={"alpha": [0.0, 1000.0], "lambda": [0.0, 1.0]}),
        search.Stage(s[4:], 4, "ei", initial=2, batch=2, pool=64, epsilon=0.1, max_no_improve=3),
    ]
    result = search.grouped_search(spark, search.cv_objective(binned_lines(spark, sf), FOLDS), stages, {"rounds": 2, "eta": 0.5})
    return rounded(result.log.select("stage", "iter", "max_depth", "min_child_weight", "alpha", "lambda", "subsample",
                                     "colsample_bytree", "score"), "score")


# Staged search over a table objective, so that SQL can follow it: a line number is tuned by the mean quantity
# of its line items, then a supplier group with the line number frozen.

_SEARCH_TABLE = """SELECT l_linenumber AS line, l_suppkey % 10 AS grp, l_quantity AS q FROM lineitem"""


@query("q_search_stage", f"""WITH x AS ({_SEARCH_TABLE}), s AS (SELECT line, avg(q) AS score FROM x GROUP BY line), c AS (
    SELECT range AS trial_id, CAST(1 + floor({uniform_sql('range', "'line'", seed=4)} * 7) AS DOUBLE) AS line FROM range(0, 30))
    SELECT trial_id + 1 AS iter, c.line, round(score, 6) AS score FROM c JOIN s ON c.line = s.line""")
def _(spark, sf):
    means = views.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("line")).agg(F.avg("l_quantity").alias("score"))
    stage = search.Stage([space.Param("line", "int", 1, 8)], 30, "random", batch=15)
    log = search.search_stage(spark, lambda c: c.join(means, "line"), stage, 4)
    return rounded(log.select("iter", "line", "score"), "score")


@query("q_grouped_objective", f"""WITH x AS ({_SEARCH_TABLE}), one AS (
    SELECT line, avg(q) AS score, row_number() OVER (ORDER BY avg(q) DESC, line) AS k FROM x GROUP BY line), two AS (
    SELECT x.grp, avg(q) AS score FROM x JOIN one ON x.line = one.line AND one.k = 1 GROUP BY x.grp)
    SELECT 1 AS stage, CAST(line AS BIGINT) AS iter, CAST(line AS DOUBLE) AS line, NULL::DOUBLE AS grp, round(score, 6) AS score FROM one
    UNION ALL SELECT 2, CAST(two.grp + 8 AS BIGINT), CAST(one.line AS DOUBLE), CAST(two.grp AS DOUBLE), round(two.score, 6)
    FROM two, one WHERE one.k = 1""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("line"), (F.col("l_suppkey") % 10).cast("double").alias("grp"), "l_quantity")

    def objective(frozen):
        """Mean quantity of the line items a candidate and the frozen parameters pick."""
        kept = li.where(F.col("line") == frozen["line"]) if frozen else li

        def score(candidates):
            names = [c for c in candidates.columns if c != "trial_id"]
            out = candidates.join(kept.groupBy(*names).agg(F.avg("l_quantity").alias("score")), names)
            return out.withColumns({k: F.lit(v) for k, v in frozen.items()})

        return score

    stages = [search.Stage([], 7, "grid", grid={"line": range(1, 8)}), search.Stage([], 10, "grid", grid={"grp": range(10)})]
    log = search.grouped_search(spark, objective, stages).log
    return rounded(log.select("stage", "iter", "line", "grp", "score"), "score")


@query("q_initial_design", f"""WITH x AS ({_SEARCH_TABLE}), s AS (SELECT line, avg(q) AS score FROM x GROUP BY line), c AS (
    SELECT range AS trial_id, CAST(1 + floor({uniform_sql('range', "'line'", seed=8)} * 7) AS DOUBLE) AS line FROM range(0, 12))
    SELECT trial_id + 1 AS iter, c.line, round(score, 6) AS score FROM c JOIN s ON c.line = s.line""")
def _(spark, sf):
    """The random trials a model-based stage begins with."""
    means = views.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("line")).agg(F.avg("l_quantity").alias("score"))
    stage = search.Stage([space.Param("line", "int", 1, 8)], 12, "ei", initial=12, batch=4)
    return rounded(search.search_stage(spark, lambda c: c.join(means, "line"), stage, 8).select("iter", "line", "score"), "score")


def _line_objective(spark, sf):
    """Mean quantity of the line items a candidate and the frozen parameters pick."""
    li = views.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("line"), (F.col("l_suppkey") % 10).cast("double").alias("grp"), "l_quantity")

    def objective(frozen):
        kept = li
        for name, value in frozen.items():
            kept = kept.where(F.col(name) == value)

        def score(candidates):
            names = [c for c in candidates.columns if c != "trial_id"]
            return candidates.join(kept.groupBy(*names).agg(F.avg("l_quantity").alias("score")), names)

        return score

    return objective


@query("q_stage_modes", f"""WITH x AS ({_SEARCH_TABLE}), draws AS (
    SELECT range AS t, CAST(1 + floor({uniform_sql('range', "'line'", seed=1)} * 7) AS DOUBLE) AS line FROM range(0, 9)), one AS (
    SELECT t, draws.line, m.score FROM draws JOIN (SELECT line, avg(q) AS score FROM x GROUP BY line) m ON m.line = draws.line), best AS (
    SELECT line FROM one ORDER BY score DESC, t LIMIT 1)
    SELECT 1 AS stage, 'random' AS mode, t + 1 AS iter, round(score, 6) AS score FROM one
    UNION ALL SELECT 2, 'grid', CAST(x.grp + 10 AS BIGINT), round(avg(q), 6) FROM x JOIN best USING (line) GROUP BY x.grp""")
def _(spark, sf):
    """A search whose stages, modes and budgets come out of a table."""
    spaces = {1: {"space": [space.Param("line", "int", 1, 8)]}, 2: {"space": [], "grid": {"grp": range(10)}}}
    table = space.stage_modes(spark, ["random", "grid"], [9, 10])
    stages = [search.Stage(budget=r["budget"], mode=r["mode"], **spaces[r["stage"]]) for r in table.orderBy("stage").collect()]
    log = search.grouped_search(spark, _line_objective(spark, sf), stages).log
    return rounded(log.join(F.broadcast(table.select("stage", "mode")), "stage").select("stage", "mode", "iter", "score"), "score")


@query("q_run_info", f"""WITH x AS ({_SEARCH_TABLE}) SELECT 'lines' AS search, true AS timed, round(max(score), 6) AS score, arg_max(line, (score, -line))::DOUBLE AS line
    FROM (SELECT line, avg(q) AS score FROM x GROUP BY line)""")
def _(spark, sf):
    """The record of a search: its time, best score and best parameters, written and read back."""
    stages = [search.Stage([], 7, "grid", grid={"line": range(1, 8)})]
    found = search.grouped_search(spark, _line_objective(spark, sf), stages)
    path = scratch_path(spark, "run-info")
    records.write_run_info(spark, path, "lines", found.seconds, found.best_params, found.best_score)
    back = spark.read.parquet(path)
    return rounded(back.select("search", (F.col("seconds") > 0).alias("timed"), "score", F.col("params")["line"].alias("line")), "score")


# Proposals.  A run is an event type, a configuration its k.

K_SPACE = [space.Param("k", "float", 0.0, 100.0)]


def _k_history(spark, sf):
    ev = views.table(spark, sf, "events").select(
        F.col("event_type").alias("run"), parse_params("props")["k"].alias("k"), F.col("value").alias("score"))
    return propose.config_history(ev, ["k"])


def _k_candidates(spark, sf, n=200):
    runs = views.table(spark, sf, "events").select(F.col("event_type").alias("run")).distinct()
    return space.random_candidates(spark, K_SPACE, n, seed=5, runs=runs)


@query("q_config_history", f"""SELECT event_type AS run, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, round(avg(value), 6) AS score,
    count(*) AS weight FROM events GROUP BY ALL""")
def _(spark, sf):
    return rounded(_k_history(spark, sf), "score")


def _numbers(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _ei_sql(features: int) -> str:
    """Expected improvement in SQL: the sums of the features, their system solved by elimination, and the normal distribution as a series."""
    (frequencies, phases), n = propose.fourier_basis(1, features), features
    phi = lambda x: f"list_transform(range(1, {n + 1}), lambda i: sqrt({2 / n!r}::DOUBLE) * cos(w[i] * {x} + p[i]))"
    dot = lambda a, b: f"list_sum(list_transform(range(1, {n + 1}), lambda i: {a}[i] * {b}[i]))"
    row = f"list_transform(range(1, {2 * n + 2}), lambda j: (m[k][j] / m[k][k]))"
    erf = """(CASE WHEN abs(x) > 6 THEN sign(x) WHEN x = 0 THEN 0 ELSE sign(x) * 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 150),
        lambda i: exp(i * ln(4) + lgamma(i + 1) - lgamma(2 * i + 2) + (2 * i + 1) * ln(abs(x))))) END)"""
    return f"""WITH RECURSIVE basis AS (SELECT {_numbers(frequencies[:, 0])} AS w, {_numbers(phases)} AS p), h AS (
    SELECT event_type AS run, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, avg(value) AS score, count(*) AS weight FROM events GROUP BY ALL), t AS (
    SELECT run, sum(weight * score) / sum(weight) AS mean, sqrt(greatest(sum(weight * score * score) / sum(weight) - (sum(weight * score) / sum(weight)) ** 2, 0)) AS dev,
           max(score) AS top FROM h GROUP BY run), f AS (
    SELECT h.run, weight, (score - mean) / dev AS y, {phi('(k / 100)')} AS phi FROM h JOIN t USING (run), basis), cells AS (
    SELECT run, i, j, CAST(i = j AS INTEGER) + sum(weight * phi[i] * phi[j]) / {propose.NOISE} AS v FROM f, range(1, {n + 1}) a(i), range(1, {n + 1}) b(j) GROUP BY run, i, j), lines AS (
    SELECT run, i, list(v ORDER BY j) AS v FROM cells GROUP BY run, i), rhs AS (
    SELECT run, i, sum(weight * phi[i] * y) / {propose.NOISE} AS r FROM f, range(1, {n + 1}) a(i) GROUP BY ALL), solve AS (
    SELECT run, 1 AS k, list(list_concat(v, [r], list_transform(range(1, {n + 1}), lambda j: CAST(j = i AS DOUBLE))) ORDER BY i) AS m FROM lines JOIN rhs USING (run, i) GROUP BY run
    UNION ALL SELECT run, k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k THEN row ELSE
           list_transform(range(1, {2 * n + 2}), lambda j: m[i][j] - m[i][k] * row[j]) END) FROM (SELECT *, {row} AS row FROM solve WHERE k <= {n})), done AS (
    SELECT run, list_transform(m, lambda r: r[{n + 1}]) AS mu, list_transform(m, lambda r: r[{n + 2}:]) AS inv FROM solve WHERE k = {n + 1}), c AS (
    SELECT run, trial_id, {uniform_sql('run', 'trial_id', "'k'", seed=5)} * 100.0::DOUBLE AS k
    FROM (SELECT DISTINCT event_type AS run FROM events), (SELECT range AS trial_id FROM range(0, 200))), spots AS (
    SELECT c.*, mu, inv, mean, dev, top, {phi('(c.k / 100)')} AS phi FROM c JOIN done USING (run) JOIN t USING (run), basis), post AS (
    SELECT run, trial_id, k, mean + dev * {dot('phi', 'mu')} - top AS gain,
           dev * sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda a: phi[a] * list_sum(list_transform(range(1, {n + 1}), lambda b: inv[a][b] * phi[b])))), 1e-12)) AS sd
    FROM spots), scored AS (
    SELECT *, gain * 0.5 * (1 + {erf}) + sd * exp(-x * x) / sqrt(2 * pi()) AS ei FROM (SELECT *, gain / sd / sqrt(2) AS x FROM post))
    SELECT run, trial_id, round(k, 6) AS k, round(ei, 6) AS ei FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY ei DESC, trial_id) AS place FROM scored) WHERE place <= 5"""


@query("q_propose_ei", _ei_sql(propose.FEATURES))
def _(spark, sf):
    scored = propose.propose_ei(_k_history(spark, sf), _k_candidates(spark, sf), K_SPACE)
    return rounded(propose.top_proposals(scored, "ei", 5), "k", "ei")


@query("q_propose_batch")
def _(spark, sf):
    """Eight candidates per run to be tried together, each picked as if those before it had the run's mean score."""
    return rounded(propose.propose_batch(_k_history(spark, sf), _k_candidates(spark, sf), K_SPACE, 8), "k", "ei")


_KERNEL = "exp(-1 * ((c.k - h.k) / 100) ** 2 / (2 * 0.2 ** 2)) / (0.2 * sqrt(2 * pi()))"


@query("q_propose_tpe", f"""WITH h AS (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, k) <= ceil(0.25 * count(*) OVER (PARTITION BY run)) AS good FROM (
        SELECT event_type AS run, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, avg(value) AS score, count(*) AS weight
        FROM events GROUP BY ALL)), c AS (
    SELECT run, trial_id, {uniform_sql('run', 'trial_id', "'k'", seed=5)} * 100.0::DOUBLE AS k
    FROM (SELECT DISTINCT event_type AS run FROM events), (SELECT range AS trial_id FROM range(0, 200))), d AS (
    SELECT c.run, c.trial_id, c.k, good, (1 + sum(weight * {_KERNEL})) / (1 + sum(weight)) AS density
    FROM c JOIN h ON c.run = h.run GROUP BY ALL)
    SELECT run, trial_id, round(k, 6) AS k, round(ln(max(density) FILTER (good)) - ln(max(density) FILTER (NOT good)), 6) AS log_ratio
    FROM d GROUP BY run, trial_id, k""")
def _(spark, sf):
    scored = propose.propose_tpe(_k_history(spark, sf), _k_candidates(spark, sf), K_SPACE)
    return rounded(scored, "k", "log_ratio")


@query("q_epsilon_greedy", f"""WITH r AS (SELECT DISTINCT user_id AS run FROM events), c AS (
    SELECT run, trial_id, {uniform_sql('run', 'trial_id', "'k'", seed=1)} * 100.0::DOUBLE AS a,
           {uniform_sql('run', 'trial_id', "'k'", seed=2)} * 100.0::DOUBLE AS b,
           {uniform_sql('run', 'trial_id', "'epsilon'", seed=9)} < 0.1 AS pick
    FROM r, (SELECT range AS trial_id FROM range(0, 20)))
    SELECT run, trial_id, round(CASE WHEN pick THEN b ELSE a END, 6) AS k FROM c""")
def _(spark, sf):
    runs = views.table(spark, sf, "events").select(F.col("user_id").alias("run")).distinct()
    one, two = [space.random_candidates(spark, K_SPACE, 20, seed=s, runs=runs) for s in (1, 2)]
    return rounded(propose.epsilon_greedy(one, two, 0.1, 9), "k")


@query("q_skip_finished", f"""WITH {EV} SELECT DISTINCT event_type, iter FROM ev
    EXCEPT SELECT event_type, iter FROM ev WHERE stage = 2 OR score > 50""")
def _(spark, sf):
    log = views.staged_events(spark, sf, "event_type")
    candidates = log.select("event_type", "iter").distinct()
    return search.skip_finished(candidates, log.where("stage = 2 OR score > 50"), ["event_type", "iter"])
