"""Gradient-boosted trees on DataFrames: all (trial, held-out fold) pairs of a batch grow together.

Rows are binned once and written in packed blocks.  For every tree level one job adds up histograms map-side, shuffles
only (tree, node, feature, bin) sums and finds the best split of every node with window prefix sums.
The shuffle and what reaches the driver depend on trees x features x bins, never on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialwright.operators import kernels
from trialwright.operators.kernels import (
    DENSE_CELLS, GRADIENT_UNIT, MISSING_BIN, Fit, Tree, bin_rows, histogram_rows, margin_rows, open_cells,
    pack_rows, predict_rows, score_rows, single_rows)
from trialwright.session import materialize

# Tasks receive the helpers with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(kernels)

# Trainer defaults of the searched parameters (fixed values).
DEFAULTS = {"max_depth": 3, "min_child_weight": 1.0, "alpha": 0.0, "lambda": 1.0, "subsample": 1.0,
            "colsample_bytree": 1.0, "eta": 0.1, "rounds": 10}
MAX_NODES = 1_000_000
REFRESH_ROUNDS = 8
_ROWS = "row_key long, fold int, label double, bins array<smallint>"
_BLOCKS = "row_key binary, fold binary, label binary, bins binary"


@dataclass
class Binned:
    """A binned feature table (row_key, fold, label, bins) and what is needed to bin new rows alike.

    ``blocks`` is the same table packed, as the tasks of the booster read it.
    """

    table: DataFrame
    features: list[str]
    edges: list[np.ndarray]
    unit: float
    centre: float
    fold_sums: dict[int, tuple[float, int]]
    classes: int = 0
    blocks: DataFrame | None = None

    @property
    def width(self) -> int:
        return 2 + max(len(e) for e in self.edges)

    def packed(self) -> DataFrame:
        if self.blocks is None:
            self.blocks = materialize(self.table.mapInArrow(pack_rows, _BLOCKS), "binned")
        return self.blocks


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 32, binning: str = "quantile") -> list[np.ndarray]:
    """Inner edges per feature from one pass: mergeable quantile sketches, or equal widths."""
    if binning == "quantile":
        at = [i / bins for i in range(1, bins)]
        row = df.agg(*[F.percentile_approx(c, at, 100 * bins).alias(c) for c in features]).first()
        return [np.unique(np.array(row[c] or [], dtype=float)) for c in features]
    if binning != "width":
        raise ValueError(f"unknown binning {binning!r}")
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}")
                    for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for c in features:
        lo, hi = ends[f"{c}__lo"], ends[f"{c}__hi"]
        out.append(np.unique([lo + (hi - lo) * i / bins for i in range(1, bins)]) if lo is not None else np.array([]))
    return out


def bin_table(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str | Column], fold: str | None = "fold",
              bins: int = 32, binning: str = "quantile", classes: int = 0) -> Binned:
    """Bin every feature and write the table; NULL or NaN is a bin of its own.

    ``key`` identifies a row and seeds its row sampling.  ``fold`` may be None to train on all rows.
    """
    features = list(features)
    as_double = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in features]
    fold_column = F.col(fold).cast("int") if fold else F.lit(0)
    names = [f"__f{i}" for i in range(len(features))]
    narrow = df.select(F.xxhash64(*key).alias("row_key"), fold_column.alias("fold"),
                       F.col(label).cast("double").alias("label"), *[c.alias(n) for c, n in zip(as_double, names)])
    # Written once: the edges and the bins are two passes.
    table = materialize(narrow, "features")
    clean = table.select(*[F.nanvl(F.col(n), F.lit(None).cast("double")).alias(n) for n in names])
    edges = bin_edges(clean, names, bins, binning)
    blocks = materialize(table.mapInArrow(bin_rows(edges), _BLOCKS), "binned")
    lo, hi = table.agg(F.min("label"), F.max("label")).first()
    spread = (hi - lo) or 1.0
    unit = GRADIENT_UNIT if classes else GRADIENT_UNIT / spread
    whole = F.sum(F.rint(F.col("label") * unit).cast("bigint"))
    sums = {r["fold"]: (r["s"] / unit, r["n"]) for r in table.groupBy("fold").agg(
        whole.alias("s"), F.count("*").alias("n")).collect()}
    return Binned(blocks.mapInArrow(single_rows(len(features)), _ROWS), features, edges, unit, (lo + hi) / 2, sums, classes, blocks)


def _sampled_features(m: int, fraction: float, trial: int, round_: int, seed: int) -> list[int]:
    if fraction >= 1:
        return list(range(m))
    order = sorted(range(m), key=lambda f: hashlib.md5(f"{f}|{trial}|{round_}|{seed}".encode()).digest())
    return sorted(order[:max(1, int(fraction * m))])


# soft(G) = sign(G) * max(|G| - alpha, 0); a side's quality is soft(G)^2 / (H + lambda).
_SPLIT_SQL = """
WITH cells AS (
  SELECT tree, node, feature, bin, SUM(g) AS g, SUM(h) AS h FROM {{histogram}} GROUP BY tree, node, feature, bin
), scanned AS (
  SELECT tree, node, feature, bin,
         SUM(g) OVER upto AS gl, SUM(h) OVER upto AS hl, SUM(g) OVER whole AS g, SUM(h) OVER whole AS h,
         SUM(IF(bin = {missing}, g, 0)) OVER whole AS gm, SUM(IF(bin = {missing}, h, 0)) OVER whole AS hm
  FROM cells
  WINDOW whole AS (PARTITION BY tree, node, feature),
         upto AS (PARTITION BY tree, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)
), sides AS (
  SELECT tree, node, feature, bin, missing_left, g / {g_unit} AS g, h / {h_unit} AS h,
         IF(missing_left, gl, gl - gm) / {g_unit} AS gl, IF(missing_left, hl, hl - hm) / {h_unit} AS hl
  FROM scanned LATERAL VIEW EXPLODE(ARRAY(FALSE, TRUE)) AS missing_left
), shrunk AS (
  SELECT /*+ BROADCAST(p) */ s.*, lambda, min_child_weight,
         SIGN(gl) * GREATEST(ABS(gl) - alpha, 0D) AS sl, SIGN(g - gl) * GREATEST(ABS(g - gl) - alpha, 0D) AS sr,
         SIGN(g) * GREATEST(ABS(g) - alpha, 0D) AS sn
  FROM sides AS s JOIN {{settings}} AS p ON s.tree = p.tree
), gains AS (
  SELECT *, sl * sl / NULLIF(hl + lambda, 0D) + sr * sr / NULLIF(h - hl + lambda, 0D)
            - sn * sn / NULLIF(h + lambda, 0D) AS gain
  FROM shrunk
), tried AS (
  SELECT *, bin <> {missing} AND gain > 0 AND hl > 0 AND h - hl > 0
            AND hl >= min_child_weight AND h - hl >= min_child_weight AS valid
  FROM gains
), best AS (
  SELECT tree, node, MAX(g) AS g, MAX(h) AS h, MAX(valid) AS found,
         MAX_BY(STRUCT(feature, bin, missing_left, gl, hl, gain),
                IF(valid, STRUCT(gain, -feature, -bin, NOT missing_left), NULL)) AS b
  FROM tried GROUP BY tree, node
)
SELECT tree, node, IF(found, b.feature, NULL) AS feature, b.bin, b.missing_left, b.gl, b.hl, b.gain, g, h FROM best
"""


def best_splits(histogram: DataFrame, settings: DataFrame, g_unit: float = 1.0, h_unit: float = 1.0,
                combined: bool = True) -> DataFrame:
    """Best split of every node from (tree, node, feature, bin, g, h).

    ``settings`` has one row per tree: alpha, lambda, min_child_weight.  Rows in the missing bin are tried
    on both sides.  A node without an admissible split has a NULL feature and its totals.  ``combined``
    says that a task's rows are already summed, so that one exchange serves the sums and the window.
    """
    if combined:
        histogram = histogram.repartition("tree", "node", "feature")
    text = _SPLIT_SQL.format(missing=MISSING_BIN, g_unit=f"{float(g_unit)!r}D", h_unit=f"{float(h_unit)!r}D")
    return histogram.sparkSession.sql(text, histogram=histogram, settings=settings)


def settings_table(spark: SparkSession, params: Sequence[Mapping[str, float]], start: int = 0) -> DataFrame:
    """(tree, alpha, lambda, min_child_weight) as a literal relation, which is broadcast without a job."""
    rows = ", ".join(f"({i}, {float(p['alpha'])!r}D, {float(p['lambda'])!r}D, {float(p['min_child_weight'])!r}D)"
                     for i, p in enumerate(params, start))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tree, alpha, lambda, min_child_weight)")


def leaf_weight(g: float, h: float, alpha: float, lam: float) -> float:
    shrunk = np.sign(g) * max(abs(g) - alpha, 0.0)
    return float(-shrunk / (h + lam)) if h + lam > 0 else 0.0


@dataclass
class Boosted:
    """Fitted trees of a batch, in the order of its (trial, held-out fold) pairs."""

    data: Binned
    fits: list[Fit]
    params: dict[int, dict[str, float]]

    def scores(self) -> DataFrame:
        """(trial_id, fold, round, isTest, metric, value) for every finished round."""
        sums = self.data.packed().mapInArrow(
            score_rows(self.fits, len(self.data.features), self.data.classes, self.data.centre),
            "fit int, round int, isTest boolean, n double, sy double, syy double, sse double, hits double")
        total = sums.groupBy("fit", "round", "isTest").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "sse", "hits")])
        total = total.where(F.col("n") > 0)
        index = self.data.table.sparkSession.createDataFrame(
            [(i, f.trial, f.held_out) for i, f in enumerate(self.fits)], "fit int, trial_id long, fold int")
        keys = ["trial_id", "fold", "round", "isTest"]
        if self.data.classes:
            wide, names = {"accuracy": F.col("hits") / F.col("n")}, ["accuracy"]
        else:
            deviation = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
            wide = {"r2": 1 - F.col("sse") / F.nullif(deviation, F.lit(0.0)), "rmse": F.sqrt(F.col("sse") / F.col("n"))}
            names = ["r2", "rmse"]
        joined = total.join(F.broadcast(index), "fit").withColumn("round", F.col("round") + 1)
        return joined.select(*keys, *[v.alias(k) for k, v in wide.items()]).unpivot(keys, names, "metric", "value")

    def predict(self, df: DataFrame, trial: int | None = None, held_out: int | None = None) -> DataFrame:
        """``df`` with a prediction column from one fit."""
        fit = next(f for f in self.fits if trial in (None, f.trial) and held_out in (None, f.held_out))
        packed = df.withColumn("features", F.array(*[
            F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.data.features]))
        fields = [f for f in df.schema.fields if f.name != "features"]
        schema = df.select(*[f.name for f in fields], F.lit(0.0).alias("prediction")).schema
        return packed.mapInArrow(predict_rows(fit, self.data.edges, self.data.classes), schema)


def pair_batches(params: Mapping[int, Mapping[str, float]], folds: Sequence[int], outputs: int,
                 pairs_per_pass: int) -> Iterator[dict[int, dict[str, float]]]:
    """Trials per pass, so that neither the pairs nor the nodes that may be open exceed their limits."""
    batch: dict[int, dict[str, float]] = {}
    nodes = 0
    for trial, given in params.items():
        p = {**DEFAULTS, **{k: v for k, v in given.items() if v is not None}}
        more = len(folds) * outputs * 2 ** int(p["max_depth"])
        if batch and ((len(batch) + 1) * len(folds) > pairs_per_pass or nodes + more > MAX_NODES):
            yield batch
            batch, nodes = {}, 0
        batch[trial], nodes = p, nodes + more
    if batch:
        yield batch


def fit_boosted(data: Binned, params: Mapping[int, Mapping[str, float]], folds: Sequence[int] = (-1,),
                seed: int = 0) -> Boosted:
    """Grow every (trial, held-out fold) pair together; fold -1 holds nothing out.

    Finished rounds are replayed from the binned rows, and every few rounds their margins are written
    next to the bins, so no lineage grows and the replay stays short.
    """
    spark = data.table.sparkSession
    outputs = max(data.classes, 1)
    params = {t: {**DEFAULTS, **p} for t, p in params.items()}
    fits = [Fit(t, held, _base(data, held), float(p["subsample"])) for t, p in params.items() for held in folds]
    h_unit = float(GRADIENT_UNIT) if data.classes else 1.0
    settings = settings_table(spark, [params[f.trial] for f in fits for _ in range(outputs)])
    table, written, m = data.packed(), 0, len(data.features)
    for round_ in range(max(int(p["rounds"]) for p in params.values())):
        if round_ - written >= REFRESH_ROUNDS:
            table = materialize(table.mapInArrow(margin_rows(fits, m, written), f"{_BLOCKS}, margins binary"), "margins")
            written = round_
        live = [f for f in fits if round_ < int(params[f.trial]["rounds"])]
        for f in live:
            p = params[f.trial]
            f.growing = [Tree() for _ in range(outputs)]
            f.active = [{0: 0} for _ in range(outputs)]
            f.features = _sampled_features(m, float(p["colsample_bytree"]), f.trial, round_, seed)
        depth = 0
        while any(a for f in live for a in f.active):
            partial = table.mapInArrow(
                histogram_rows(fits, m, data.width, data.unit, data.classes, written, (seed * 1000 + round_) * 100_003),
                "tree int, node int, feature int, bin int, g long, h long")
            combined = open_cells(fits, data.width) <= DENSE_CELLS
            splits = best_splits(partial, settings, data.unit, h_unit, combined).collect()
            depth += 1
            _grow(fits, splits, params, depth, outputs)
        for f in live:
            f.rounds.append(f.growing)
            f.growing, f.active = [], []
    return Boosted(data, fits, params)


def _base(data: Binned, held_out: int) -> list[float]:
    if data.classes:
        return [0.0] * data.classes
    kept = [v for fold, v in data.fold_sums.items() if fold != held_out]
    n = sum(v[1] for v in kept)
    return [sum(v[0] for v in kept) / n if n else 0.0]


def _grow(fits: list[Fit], splits: list, params: Mapping, depth: int, outputs: int) -> None:
    """Apply one level's splits (one row per open node) and open the children that may still split."""
    opened: dict[tuple[int, int], dict[int, int]] = {}
    for s in splits:
        fit, k = fits[s["tree"] // outputs], s["tree"] % outputs
        p, tree = params[fit.trial], fit.growing[k]
        eta, alpha, lam = float(p["eta"]), float(p["alpha"]), float(p["lambda"])
        if s["feature"] is None:
            if s["node"] == 0:
                tree.value[0] = eta * leaf_weight(s["g"], s["h"], alpha, lam)
            continue
        left = eta * leaf_weight(s["gl"], s["hl"], alpha, lam)
        right = eta * leaf_weight(s["g"] - s["gl"], s["h"] - s["hl"], alpha, lam)
        children = tree.split(s["node"], s["feature"], s["bin"], s["missing_left"], left, right)
        if depth < int(p["max_depth"]):
            opened.setdefault((s["tree"] // outputs, k), {}).update({c: 0 for c in children})
    for i, f in enumerate(fits):
        f.active = [opened.get((i, k), {}) for k in range(len(f.active))]


# Spark ML learners under the same parameter names

def mllib_regressor(params: Mapping[str, float], features: str = "features", label: str = "label",
                    seed: int = 0) -> GBTRegressor:
    """Spark's own boosted trees.  They have no L1 or L2 penalty, so a non-zero one is refused."""
    p = {**DEFAULTS, "alpha": 0.0, "lambda": 0.0, **params}
    if p["alpha"] or p["lambda"]:
        raise ValueError("this learner has no alpha or lambda; use fit_boosted")
    return GBTRegressor(
        featuresCol=features, labelCol=label, maxDepth=int(p["max_depth"]), maxIter=int(p["rounds"]),
        minInstancesPerNode=max(1, int(p["min_child_weight"])), subsamplingRate=float(p["subsample"]),
        featureSubsetStrategy=str(float(p["colsample_bytree"])), stepSize=float(p["eta"]), seed=seed)


def mllib_classifier(max_depth: int = 2, rounds: int = 10, eta: float = 0.1, seed: int = 0) -> OneVsRest:
    """One boosted binary model per class."""
    return OneVsRest(classifier=GBTClassifier(maxDepth=max_depth, maxIter=rounds, stepSize=eta, seed=seed))
