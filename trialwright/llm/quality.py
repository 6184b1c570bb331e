"""Quality rules: base limits per document, then robust multivariate outliers.

Five transformed statistics of every document form a vector.  Per language and source a minimum-covariance-determinant
estimate is grown by concentration steps over all vectors: distances under the present estimate, the cut that keeps the
nearest share of the group (from exact counts of binned distances), moments of the kept rows.  Vectors too far from
their group's final estimate are rejected.  Everything but the statistics themselves is map-side combined aggregation
over the small table of vectors, so a hot source is no larger a task than any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trialwright.llm import kernels
from trialwright.llm.common import chunks, materialize, prepare, table, utf8, with_column
from trialwright.llm.registry import query

STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_text_lines bigint"
NAMES = [field.split()[0] for field in STATS.split(", ")]
VECTOR = ["x_length", "x_word", "x_symbol", "x_line", "x_repeat"]
# Spread below which a statistic does not count as varied: most clean documents have no symbol and no repeated line.
FLOORS = [1.0, 0.4, 0.04, 0.08, 0.04]
# Median of the chi-square distribution with five degrees of freedom.
CHI2_MEDIAN = 4.3515
# Distances are counted in bins of 2 ** (1 / BINS).
BINS = 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def text_stats(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(documents x 6) counts of the base rules for a stretch of documents."""
    n = len(places) - 1
    out = np.zeros((n, 6), np.int64)
    if not len(data):
        return out
    starts, ends, doc = kernels.words(data, places)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~kernels.IS_BLANK[data] & ~_CONTINUES[data], out=total[1:])
    out[:, 0] = np.bincount(doc, minlength=n)
    out[:, 1] = total[places[1:]] - total[places[:-1]]
    np.cumsum(_SYMBOL[data], out=total[1:])
    out[:, 2] = total[places[1:]] - total[places[:-1]]
    hashes = kernels.word_hashes(data, starts, ends)
    grams = kernels.windows(hashes, 5)
    if len(grams):
        whole = np.flatnonzero(doc[:len(grams)] == doc[4:4 + len(grams)])
        key = kernels.mix(grams[whole] ^ kernels.mix(doc[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out[:, 4] = np.bincount(doc[kernels.union_of_runs(whole[twice], 5, len(doc))], minlength=n)
    # Lines with a word: a line begins at its document's start and after every line feed.
    line_starts = np.unique(np.concatenate([places[:-1][places[:-1] < places[1:]], np.flatnonzero(data == 10) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_doc = np.searchsorted(places, line_starts, "right") - 1
    values = kernels.BYTE_VALUES[data]
    values[data == 10] = 0
    offset = np.arange(len(data), dtype=np.int64)
    offset[line_starts[0]:] -= np.repeat(line_starts, line_ends - line_starts)
    values *= kernels.powers(int(offset.max()) + 1)[offset]
    line = kernels.mix(np.add.reduceat(values, line_starts))
    n_word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~kernels.IS_BLANK[data], out=n_word[1:])
    filled = n_word[line_ends] > n_word[line_starts]
    line, line_doc = line[filled], line_doc[filled]
    out[:, 5] = np.bincount(line_doc, minlength=n)
    if len(line):
        key = kernels.mix(line ^ kernels.mix(line_doc.astype(np.uint64) + np.uint64(1)))
        first = np.unique(key, return_index=True)[1]
        out[:, 3] = out[:, 5] - np.bincount(line_doc[first], minlength=n)
    return out


def with_stats(docs: DataFrame, into: str) -> DataFrame:
    """All columns of ``docs`` and a struct ``into`` of counts per document."""
    at = docs.columns.index("text")

    def count(batches):
        for batch in batches:
            data, places = utf8(batch.column(at).cast(pa.string()).fill_null(""))
            parts = [text_stats(data[places[a]:places[b]], places[a:b + 1] - places[a]) for a, b in chunks(places)]
            counts = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
            struct = pa.StructArray.from_arrays([pa.array(c) for c in counts.T.copy()], NAMES)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, into])

    return with_column(docs, count, StructField(into, StructType.fromDDL(STATS)))


def vector(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column,
           n_text_lines: Column) -> list[Column]:
    """The transformed statistics.  Shares are drawn towards a usual value in short texts, where one word or line is a large share."""
    return [F.log(n_words + 1), (word_chars + 40 * 6) / (n_words + 40), F.sqrt(n_symbols / (word_chars + 100)),
            n_dup_lines / (n_text_lines + 5), n_repeat_words / (n_words + 40)]


def group_names(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, group): a group is a language and source, the language's small sources together, or all that is left."""
    size = rows.groupBy("lang", "source").count().withColumn("small", F.col("count") < min_rows)
    size = size.withColumn("rest", F.sum(F.when(F.col("small"), F.col("count"))).over(Window.partitionBy("lang")))
    name = (F.when(~F.col("small"), F.to_json(F.struct(F.lit(1).alias("level"), "lang", "source")))
            .when(F.col("rest") >= min_rows, F.to_json(F.struct(F.lit(2).alias("level"), "lang")))
            .otherwise(F.lit("{}")))
    return size.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), name.alias("__group"))


def named(rows: DataFrame, names: DataFrame, lang: Column, source: Column) -> DataFrame:
    return rows.join(names, lang.eqNullSafe(F.col("__lang")) & source.eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")


MODEL = "group string, model array<double>"


def solve(moments: DataFrame) -> DataFrame:
    """Mean and inverse covariance (25 values, then 5) of each group from its sums."""
    p = len(VECTOR)

    def invert(frames):
        for frame in frames:
            models = []
            for row in frame.itertuples(index=False):
                n, sums, squares = row.n, np.array(row.sums, float), np.array(row.squares, float)
                mean = sums / n
                covariance = np.zeros((p, p))
                covariance[np.triu_indices(p)] = squares / n
                covariance = covariance + np.triu(covariance, 1).T - np.outer(mean, mean)
                covariance += np.diag(np.square(FLOORS))
                models.append([*mean, *np.linalg.inv(covariance).ravel()])
            yield pd.DataFrame({"group": frame["group"], "model": models})

    return moments.mapInPandas(invert, MODEL)


def moments(rows: DataFrame) -> DataFrame:
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(VECTOR) for b in VECTOR[i:]]
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in VECTOR]).alias("sums"),
                                     F.array(*products).alias("squares"))


def distance(values: list[Column], model: Column) -> Column:
    """Squared Mahalanobis distance of a vector under ``model``."""
    p, d = len(values), [x - model[i] for i, x in enumerate(values)]
    return sum((model[p + i * p + j] * d[i] * d[j] for i in range(p) for j in range(p)), F.lit(0.0))


def quantile_bins(rows: DataFrame, share: float, name: str) -> DataFrame:
    """Per group the smallest bin of the distance at which ``share`` of the rows is reached."""
    counts = rows.groupBy("group", "bin").count()
    order = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("upto", F.sum("count").over(order)).withColumn("all", F.sum("count").over(Window.partitionBy("group")))
    return reached.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("group").agg(F.min("bin").alias(name))


def binned() -> Column:
    return F.floor(F.log2(F.greatest(distance([F.col(x) for x in VECTOR], F.col("model")), F.lit(1e-9))) * BINS).cast("int")


def fit_mcd(vectors: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """(group, model, scale): robust centre and scatter of each group, and what its distances are divided by.

    ``vectors``: (group, five statistics).  Starts from median and median absolute deviation and takes ``steps``
    concentration steps, each over all rows of all groups at once.
    """
    rounded = [F.round(x, 3) for x in VECTOR]
    centre = vectors.groupBy("group").agg(*[F.median(r).alias(f"m_{x}") for r, x in zip(rounded, VECTOR)])
    off = vectors.join(centre, "group").groupBy("group").agg(
        *[F.first(f"m_{x}").alias(f"m_{x}") for x in VECTOR],
        *[F.median(F.round(F.abs(F.col(x) - F.col(f"m_{x}")), 3)).alias(f"d_{x}") for x in VECTOR])
    inverse = [F.lit(1.0) / ((F.col(f"d_{x}") * 1.4826) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0)
               for i, x in enumerate(VECTOR) for j in range(len(VECTOR))]
    model = materialize(off.select("group", F.array(*[F.col(f"m_{x}") for x in VECTOR], *inverse).alias("model")), "mcd")
    for _ in range(steps):
        rows = vectors.join(model, "group").withColumn("bin", binned()).drop("model")
        near = rows.join(quantile_bins(rows, share, "cut"), "group").filter(F.col("bin") <= F.col("cut"))
        model = materialize(solve(moments(near)), "mcd")
    rows = vectors.join(model, "group").withColumn("bin", binned())
    middle = quantile_bins(rows, 0.5, "middle")
    # Floors make distances smaller than chi-square's; they are only ever scaled down.
    scale = F.pow(F.lit(2.0), (F.col("middle") + 1) / BINS) / CHI2_MEDIAN
    return materialize(model.join(middle, "group").select("group", "model", F.greatest(scale, F.lit(1.0)).alias("scale")), "mcd")


def judge_quality(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, cut: float = 25.745,
                  min_rows: int = 300, into: str = "quality") -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: the counts, ``base_failed``, ``distance`` and ``kept``.

    ``cut`` is the largest squared Mahalanobis distance kept: the 0.9999 quantile of chi-square with five degrees of
    freedom.  Groups with fewer than ``min_rows`` documents that pass the base rules share an estimate with the other
    small sources of their language, or with all that is left.  NULL and empty texts have no words and fail the base
    rule; NULL languages and sources are groups of their own; repeated rows count as often as they occur; an empty
    table gives an empty one.  A column named ``into`` is replaced.
    """
    prepare(docs.sparkSession)
    counted = materialize(with_stats(docs.drop(into) if into in docs.columns else docs, into), "stats")
    lang, source = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    of = {n: F.col(f"{into}.{n}") for n in NAMES}
    failed = (of["n_words"] < min_words) | (100 * of["n_repeat_words"] > max_repeat_percent * of["n_words"])
    columns = [v.alias(x) for v, x in zip(vector(**of), VECTOR)]
    vectors = counted.filter(~failed).select(lang.alias("lang"), source.alias("source"), *columns)
    names = materialize(group_names(vectors, min_rows), "groups")
    vectors = named(vectors, names, F.col("lang"), F.col("source")).withColumnRenamed("__group", "group")
    model = fit_mcd(vectors).select(F.col("group").alias("__model_group"), F.col("model").alias("__model"), F.col("scale").alias("__scale"))
    judged = named(counted, names, lang, source).join(model, F.col("__group") == F.col("__model_group"), "left")
    far = distance(vector(**of), F.col("__model")) / F.col("__scale")
    verdict = F.struct(*[of[n].alias(n) for n in NAMES], failed.alias("base_failed"), far.alias("distance"),
                       (~failed & F.coalesce(far <= cut, F.lit(True))).alias("kept"))
    return judged.select(*[F.col(f"`{c}`") for c in counted.columns if c != into], verdict.alias(into))


@query("op8_quality_rules")
def op8(spark, sf_dir):
    out = judge_quality(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[f"quality.{n}" for n in NAMES[:5]], "quality.base_failed", "quality.kept",
                      F.round("quality.distance", 3).alias("distance"))
