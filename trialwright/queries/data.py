"""Feature preparation, candidates, folds and metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trialwright.functions.hashing import uniform
from trialwright.operators import boost, evaluate, prep, space
from trialwright.operators.scan import number_rows
from trialwright.plans import views
from trialwright.queries.registry import hash_sql, query, rounded, uniform_sql

KEY_SQL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "strftime(l_shipdate, '%Y-%m-%d')",
           "CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(l_quantity AS INTEGER)")
ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LABEL_SQL = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


# Preparation

@query("q_cast_columns", """SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_partkey AS INTEGER) AS l_partkey,
    l_linenumber % 2 = 0 AS flag_even, l_quantity AS label FROM lineitem""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_partkey").cast("string").alias("l_partkey"),
        (F.col("l_linenumber") % 2 == 0).cast("string").alias("flag_even"), F.col("l_quantity").cast("string").alias("target"))
    return prep.cast_columns(prep.rename(li), {"int": "key", "boolean": "flag_"}, default="double")


@query("q_drop_and_move", "SELECT l_tax, l_quantity, l_discount, l_extendedprice AS target FROM lineitem")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumnRenamed("l_extendedprice", "target")
    kept = prep.drop_columns(li, [c for c in li.columns if c.endswith(("key", "number", "flag", "status", "date"))])
    return prep.move_column_last(kept)


@query("q_one_hot", f"""SELECT {ROW}, CAST(l_returnflag = 'A' AS INTEGER) AS flag_A, CAST(l_returnflag = 'N' AS INTEGER) AS flag_N,
    CAST(l_returnflag = 'R' AS INTEGER) AS flag_R FROM lineitem""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").select(*ROW.split(", "), "l_returnflag")
    return prep.one_hot(li, "l_returnflag", "flag")


@query("q_ratio", f"""SELECT {ROW}, l_quantity / (l_linenumber + 1) AS comm_part_1,
    (l_quantity - l_tax) / (l_tax + 1) AS comm_part_4, (l_quantity - l_tax) / (l_linenumber + 1) AS comm_part_5 FROM lineitem""")
def _(spark, sf):
    li = prep.ratio_features(views.table(spark, sf, "lineitem"), "l_quantity", "l_linenumber", "l_tax")
    return li.select(*ROW.split(", "), "comm_part_1", "comm_part_4", "comm_part_5")


@query("q_binarize", f"SELECT {ROW}, CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS any_discount FROM lineitem")
def _(spark, sf):
    return views.table(spark, sf, "lineitem").select(*ROW.split(", "), prep.binarize("l_discount").alias("any_discount"))


@query("q_drop_duplicate_rows", "SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_tax FROM lineitem")
def _(spark, sf):
    return prep.drop_duplicate_rows(views.table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax"))


@query("q_shuffle_rows", f"""SELECT o_orderkey, row_number() OVER (ORDER BY {uniform_sql('o_orderkey', seed=7)}, o_orderkey) AS position
    FROM orders""")
def _(spark, sf):
    return prep.shuffle_rows(views.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7, "position")


@query("q_split_features_label", """SELECT 'l_quantity,l_discount' AS features, 'l_tax' AS label, count(*) AS n,
    round(sum(l_quantity) + sum(l_discount), 4) AS feature_sum, round(sum(l_tax), 4) AS label_sum FROM lineitem""")
def _(spark, sf):
    """The label is the last column, whatever it is called."""
    li = prep.move_column_last(views.table(spark, sf, "lineitem").select("l_tax", "l_quantity", "l_discount"), "l_tax")
    names, label = prep.split_features_label(li)
    sums = li.agg(F.count("*").alias("n"), sum(F.sum(c) for c in names).alias("feature_sum"), F.sum(label).alias("label_sum"))
    return rounded(sums.select(F.lit(",".join(names)).alias("features"), F.lit(label).alias("label"), "*"), "feature_sum", "label_sum", places=4)


@query("q_random_split", f"""SELECT o_orderkey, CASE WHEN {uniform_sql('o_orderkey', seed=18)} < 0.7 THEN 'train' ELSE 'test' END AS side
    FROM orders""")
def _(spark, sf):
    train, test = prep.random_split(views.table(spark, sf, "orders"), [0.7, 0.3], ["o_orderkey"], 18)
    return train.select("o_orderkey", F.lit("train").alias("side")).unionAll(test.select("o_orderkey", F.lit("test")))


@query("q_missing_sentinel", f"SELECT {ROW}, CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS line FROM lineitem")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumn("line", F.col("l_linenumber"))
    return prep.missing_sentinel(li, ["line"], 3).select(*ROW.split(", "), "line")


@query("q_index_labels", """SELECT o_orderkey, CAST(k AS DOUBLE) AS label FROM orders JOIN (
    SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS k
    FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)""")
def _(spark, sf):
    return prep.index_labels(views.table(spark, sf, "orders"), "o_orderpriority").select("o_orderkey", "label")


@query("q_assemble_features", f"""SELECT l_extendedprice AS label, l_quantity AS f0, l_discount AS f1, l_tax AS f2 FROM lineitem""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    out = prep.assemble_features(li).withColumn("v", vector_to_array("features"))
    return out.select("label", *[F.col("v")[i].alias(f"f{i}") for i in range(3)])


@query("q_prep_pipeline", """SELECT CAST(k AS DOUBLE) AS label, l_quantity AS f0, l_tax AS f1 FROM lineitem JOIN (
    SELECT l_returnflag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS k FROM lineitem GROUP BY l_returnflag)
    USING (l_returnflag)""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_returnflag")
    out = prep.prep_pipeline("l_returnflag", ["l_quantity", "l_tax"]).fit(li).transform(li)
    return out.withColumn("v", vector_to_array("features")).select(
        "label", F.col("v")[0].alias("f0"), F.col("v")[1].alias("f1"))


# Candidates.  The ranges come from the tables.

GRID_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice", "l_suppkey"]


@query("q_grid", "WITH " + ", ".join(
    f"""v{i} AS (SELECT unnest([lo, (lo + hi) / 2, hi]) AS {c}, unnest([0, 1, 2]) AS i{i}
        FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem))"""
    for i, c in enumerate(GRID_COLUMNS))
    + " SELECT CAST(" + " + ".join(f"i{i} * {3 ** (5 - i)}" for i in range(6)) + " AS BIGINT) AS trial_id, "
    + ", ".join(GRID_COLUMNS) + " FROM " + ", ".join(f"v{i}" for i in range(6)))
def _(spark, sf):
    ends = views.table(spark, sf, "lineitem").agg(*[
        f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in GRID_COLUMNS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    grid = {c: [ends[f"{c}_lo"], (ends[f"{c}_lo"] + ends[f"{c}_hi"]) / 2, ends[f"{c}_hi"]] for c in GRID_COLUMNS}
    return space.grid_candidates(spark, grid)


SPACE = [space.Param("max_depth", "int", 1, 20), space.Param("alpha", "float", 0.0, 1.0),
         space.Param("subsample", "float", 0.5, 0.9), space.Param("eta", "choice", values=(0.05, 0.1, 0.3))]


def _draw_sql(param: str, seed: int = 0) -> str:
    return uniform_sql("run", "trial_id", f"'{param}'", seed=seed)


RANDOM_SQL = f"""SELECT run, trial_id, CAST(1 + floor({_draw_sql('max_depth')} * 19) AS DOUBLE) AS max_depth,
    {_draw_sql('alpha')} * 1.0::DOUBLE AS alpha, 0.5::DOUBLE + {_draw_sql('subsample')} * 0.4::DOUBLE AS subsample,
    [0.05::DOUBLE, 0.1, 0.3][CAST(floor({_draw_sql('eta')} * 3) AS INTEGER) + 1] AS eta
    FROM (SELECT DISTINCT user_id AS run FROM events), (SELECT range AS trial_id FROM range(0, 20))"""


@query("q_random_candidates", f"SELECT run, trial_id, max_depth, round(alpha, 9) AS alpha, round(subsample, 9) AS subsample, eta FROM ({RANDOM_SQL})")
def _(spark, sf):
    runs = views.table(spark, sf, "events").select(F.col("user_id").alias("run")).distinct()
    return rounded(space.random_candidates(spark, SPACE, 20, runs=runs), "alpha", "subsample", places=9)


_OTHER = f"((n + ({hash_sql('r', "'pair'")} - spot) % n) % n)"


@query("q_random_distinct", f"""WITH e AS (SELECT min(l_linenumber)::BIGINT AS a, min(l_quantity)::BIGINT AS c, (max(l_linenumber) - min(l_linenumber) + 1)::BIGINT AS lines,
    (max(l_quantity) - min(l_quantity) + 1)::BIGINT AS quantities FROM lineitem), points AS (
    WITH RECURSIVE walk(trial_id, n, r, spot) AS (
        SELECT t, lines * quantities, 0::BIGINT, t FROM (SELECT *, unnest(range(0, lines * quantities)) AS t FROM e) UNION ALL
        SELECT trial_id, n, r + 1, CASE WHEN {hash_sql('r', f'greatest(spot, {_OTHER})')} % 2 = 1 THEN {_OTHER} ELSE spot END
        FROM walk WHERE r < 6 * (floor(log2(n - 1)) + 1))
    SELECT trial_id, spot FROM walk WHERE r = 6 * (floor(log2(n - 1)) + 1))
    SELECT trial_id, (a + spot // quantities)::DOUBLE AS line, (c + spot % quantities)::DOUBLE AS quantity FROM points, e""")
def _(spark, sf):
    """All points of a space, in a random order, each once."""
    ends = views.table(spark, sf, "lineitem").agg(
        F.min("l_linenumber"), F.max("l_linenumber"), F.min("l_quantity"), F.max("l_quantity")).first()
    found = [space.Param("line", "int", ends[0], ends[1], inclusive=True), space.Param("quantity", "int", ends[2], ends[3], inclusive=True)]
    return space.distinct_random_candidates(spark, found, int(found[0].size * found[1].size))


# Folds and metrics

@query("q_kfold_hash", f"SELECT o_orderkey, CAST({hash_sql('o_orderkey', seed=3)} % 5 AS INTEGER) AS fold FROM orders")
def _(spark, sf):
    return evaluate.assign_folds(views.table(spark, sf, "orders"), 5, ["o_orderkey"], 3).select("o_orderkey", "fold")


@query("q_kfold_contiguous", """SELECT event_id, CAST(ntile(7) OVER (ORDER BY event_id) - 1 AS INTEGER) AS fold FROM events""")
def _(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id")
    return evaluate.assign_folds(ev, 7, ["event_id"], contiguous=True)


# Metric rows of four ways to guess the label from the price.
PREDICTED = f"""d AS (
    SELECT {LABEL_SQL} AS label, l_suppkey % 4 AS trial_id,
           CAST({hash_sql(*KEY_SQL)} % 3 AS INTEGER) AS fold, l_extendedprice * (1 - 0.01 * (l_suppkey % 4)) AS prediction FROM lineitem),
    e AS (SELECT trial_id, f.range AS fold, d.fold = f.range AS isTest, label, prediction FROM d, range(0, 3) f),
    m AS (SELECT trial_id, CAST(fold AS INTEGER) AS fold, isTest, 1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)) AS r2,
          sqrt(avg((label - prediction) ** 2)) AS rmse FROM e GROUP BY ALL),
    metrics AS (SELECT trial_id, fold, isTest, 'r2' AS metric, r2 AS value FROM m
                UNION ALL SELECT trial_id, fold, isTest, 'rmse', rmse FROM m)"""


def _predictions(spark, sf):
    """Four ways of guessing the label from the price, one per quarter of the suppliers."""
    li = evaluate.assign_folds(views.table(spark, sf, "lineitem"), 3, views.line_key())
    data = li.select(views.line_label().alias("label"), (F.col("l_suppkey") % 4).alias("trial_id"), "fold", F.col("l_extendedprice").alias("p"))
    return data.withColumn("prediction", F.col("p") * (1 - 0.01 * F.col("trial_id")))


def _metrics(spark, sf):
    return evaluate.fold_metrics(evaluate.train_and_test(_predictions(spark, sf), 3))


@query("q_fold_metrics", f"WITH {PREDICTED} SELECT trial_id, fold, isTest, metric, round(value, 6) AS value FROM metrics")
def _(spark, sf):
    return rounded(_metrics(spark, sf), "value")


@query("q_r2", f"""SELECT l_returnflag, round(1 - sum((l - p) ** 2) / (sum(l ** 2) - sum(l) ** 2 / count(*)), 6) AS r2 FROM (
    SELECT l_returnflag, {LABEL_SQL} AS l, l_extendedprice AS p FROM lineitem) GROUP BY l_returnflag""")
def _(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumn("label", views.line_label())
    return rounded(li.groupBy("l_returnflag").agg(evaluate.r2("label", "l_extendedprice").alias("r2")), "r2")


@query("q_custom_metric", f"""WITH {PREDICTED} SELECT trial_id, fold, round(avg(abs(label - prediction)), 6) AS mae
    FROM e WHERE isTest GROUP BY ALL""".replace("f.range AS fold", "CAST(f.range AS INTEGER) AS fold"))
def _(spark, sf):
    """A metric of the user's own is a column expression."""
    mae = {"mae": lambda: F.avg(F.abs(F.col("label") - F.col("prediction")))}
    scored = evaluate.fold_metrics(evaluate.train_and_test(_predictions(spark, sf), 3), mae)
    return rounded(scored.where("isTest").select("trial_id", "fold", F.col("value").alias("mae")), "mae")


@query("q_fold_summary", f"""WITH {PREDICTED}, s AS (
    SELECT trial_id, avg(value) AS score, stddev_pop(value) AS std, list(value ORDER BY fold) AS splits
    FROM metrics WHERE metric = 'r2' AND isTest GROUP BY trial_id)
    SELECT trial_id, round(score, 6) AS score, round(std, 6) AS std, round(splits[1], 6) AS split0, round(splits[3], 6) AS split2,
           rank() OVER (ORDER BY score DESC) AS rank FROM s""")
def _(spark, sf):
    out = evaluate.fold_summary(_metrics(spark, sf))
    return rounded(out.select("trial_id", "score", "std", F.col("splits")[0].alias("split0"), F.col("splits")[2].alias("split2"), "rank"),
                   "score", "std", "split0", "split2")


@query("q_objective_sql", f"""WITH {PREDICTED} SELECT trial_id, round(avg(value), 6) AS score FROM metrics
    WHERE metric = 'r2' AND isTest GROUP BY trial_id""")
def _(spark, sf):
    return rounded(evaluate.objective_sql(_metrics(spark, sf)), "score")


@query("q_configurations", f"""WITH {PREDICTED} SELECT trial_id, CAST(trial_id AS DOUBLE) * 0.01 AS shrink, round(avg(value), 6) AS score
    FROM metrics WHERE metric = 'rmse' AND isTest GROUP BY trial_id""")
def _(spark, sf):
    scored = evaluate.objective_sql(_metrics(spark, sf), "SELECT AVG(value) FROM __THIS__ WHERE metric = 'rmse' AND isTest")
    log = scored.withColumn("shrink", F.col("trial_id").cast("double") * 0.01)
    return rounded(evaluate.configurations(log, ["shrink"]), "score")


# One level of split finding

BINS = 16


@query("q_hist_split", f"""WITH x AS (
    SELECT l_returnflag AS run, l_quantity, l_discount, l_tax, l_extendedprice, {LABEL_SQL} AS label FROM lineitem),
    base AS (SELECT run, avg(label) AS base FROM x GROUP BY run), long AS (
    SELECT run, label, 0 AS feature, l_quantity AS v FROM x UNION ALL SELECT run, label, 1, l_discount FROM x
    UNION ALL SELECT run, label, 2, l_tax FROM x UNION ALL SELECT run, label, 3, l_extendedprice FROM x),
    ends AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature), binned AS (
    SELECT run, feature, CAST(least(floor((v - lo) / (hi - lo) * {BINS}), {BINS - 1}) + 1 AS INTEGER) AS bin,
           CAST(round_even((base - label) * 1024, 0) AS BIGINT) AS g
    FROM long JOIN ends USING (feature) JOIN base USING (run)),
    cells AS (SELECT run, feature, bin, CAST(sum(g) AS BIGINT) AS g, count(*) AS h FROM binned GROUP BY ALL), p AS (
    SELECT run, feature, bin, sum(g) OVER w / 1024 AS gl, CAST(sum(h) OVER w AS DOUBLE) AS hl,
           sum(g) OVER (PARTITION BY run, feature) / 1024 AS gt, CAST(sum(h) OVER (PARTITION BY run, feature) AS DOUBLE) AS ht
    FROM cells WINDOW w AS (PARTITION BY run, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)), s AS (
    SELECT *, greatest(abs(gl) - 1000, 0) AS sl, greatest(abs(gt - gl) - 1000, 0) AS sr, greatest(abs(gt) - 1000, 0) AS sn FROM p), q AS (
    SELECT *, sl * sl / (hl + 5) + sr * sr / nullif(ht - hl + 5, 0) - sn * sn / (ht + 5) AS gain FROM s
    WHERE hl >= 20 AND ht - hl >= 20), r AS (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY gain DESC, feature, bin) AS k FROM q WHERE gain > 0)
    SELECT run, feature, bin, round(gl, 3) AS gl, hl, round(gain / 1000000, 3) AS gain FROM r WHERE k = 1""")
def _(spark, sf):
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    li = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), *names, views.line_label().alias("label"))
    bases = li.groupBy("run").agg(F.avg("label").alias("base")).where(F.col("run").isin("A", "N", "R")).collect()
    li = li.withColumn("base", F.coalesce(*[F.when(F.col("run") == r["run"], F.lit(r["base"])) for r in bases]))
    ends = li.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]).first()
    width = lambda c: F.least(
        F.floor((F.col(c) - ends[f"{c}_lo"]) / (ends[f"{c}_hi"] - ends[f"{c}_lo"]) * BINS), F.lit(BINS - 1)) + 1
    cells = li.select("run", F.bround((F.col("base") - F.col("label")) * 1024).cast("bigint").alias("g"),
                      F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), width(c).cast("int").alias("bin"))
                                          for i, c in enumerate(names)])).alias("c"))
    # Summed here, before the split search, so that only cells are shuffled.
    runs = ["A", "N", "R"]
    tree = F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run")).cast("int")
    cells = cells.groupBy(tree.alias("tree"), F.lit(0).alias("node"), "c.feature", "c.bin").agg(
        F.sum("g").alias("g"), F.count("*").alias("h"))
    settings = boost.settings_table(spark, [{"alpha": 1000, "lambda": 5, "min_child_weight": 20}] * 3, start=1)
    found = boost.best_splits(cells, settings, 1024.0, combined=False).where("feature IS NOT NULL")
    return found.select(F.element_at(F.array(*[F.lit(r) for r in runs]), F.col("tree")).alias("run"), "feature", "bin",
                        F.round("gl", 3).alias("gl"), "hl", F.round(F.col("gain") / 1000000, 3).alias("gain"))
