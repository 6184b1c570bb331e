"""Feature preparation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialwright.functions.hashing import uniform
from trialwright.operators.scan import number_rows

MAX_CATEGORIES = 1000


def rename(df: DataFrame, old: str = "target", new: str = "label") -> DataFrame:
    return df.withColumnRenamed(old, new)


def cast_columns(df: DataFrame, types: Mapping[str, str | Callable[[str], bool] | Sequence[str]],
                 default: str | None = None) -> DataFrame:
    """Cast columns by rule in one projection.

    ``types`` maps a type to a name substring, a list of names or a predicate; the first rule that
    matches a column wins and ``default`` types the rest.
    """
    def target(name: str) -> str | None:
        for dtype, rule in types.items():
            hit = rule(name) if callable(rule) else rule in name if isinstance(rule, str) else name in rule
            if hit:
                return dtype
        return default

    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) if (t := target(c)) else F.col(f"`{c}`") for c in df.columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct values; refuses a column with more than ``limit``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, column: str, prefix: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Replace a column by one 0/1 column per category."""
    values = categories(df, column) if values is None else values
    flags = [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{prefix or column}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *flags)


def ratio_features(df: DataFrame, last: str, before_base: str, previous: str,
                   names: Sequence[str] = ("comm_part_1", "comm_part_4", "comm_part_5")) -> DataFrame:
    """Share of the last day, its relative growth, and its growth over the whole period."""
    a, b, c = F.col(last), F.col(before_base), F.col(previous)
    return df.withColumns(dict(zip(names, (a / (b + 1), (a - c) / (c + 1), (a - c) / (b + 1)))))


def binarize(column: str) -> Column:
    """0 stays 0, anything else (a missing value too) becomes 1."""
    return F.when(F.col(column) == 0, 0).otherwise(1)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int = 0, position: str | None = None) -> DataFrame:
    """Repeatable random order; ``position`` names a column for a row's place in it, from 1, which needs no sorted output."""
    if position is None:
        return df.orderBy(uniform(*keys, seed=seed), *keys)
    return number_rows(df.withColumn("__u", uniform(*keys, seed=seed)), [], ["__u", *keys], position).drop("__u")


def move_column_last(df: DataFrame, column: str = "target") -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], column)


def split_features_label(df: DataFrame) -> tuple[list[str], str]:
    """The last column is the label."""
    return df.columns[:-1], df.columns[-1]


def _features(df: DataFrame, features: Sequence[str] | None, label: str) -> list[str]:
    return list(features) if features is not None else [c for c in df.columns if c != label]


def assemble_features(df: DataFrame, features: Sequence[str] | None = None, label: str = "label",
                      keep: Sequence[str] = ()) -> DataFrame:
    """(features vector, label); every column other than the label is a feature unless named."""
    out = VectorAssembler(inputCols=_features(df, features, label), outputCol="features").transform(df)
    return out.select("features", label, *keep)


def index_labels(df: DataFrame, column: str, output: str = "label") -> DataFrame:
    """Most frequent class 0.0, then by count, ties alphabetical."""
    indexer = StringIndexer(inputCol=column, outputCol=output, stringOrderType="frequencyDesc")
    return indexer.fit(df).transform(df)


def prep_pipeline(class_column: str, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol=class_column, outputCol="label", stringOrderType="frequencyDesc"),
        VectorAssembler(inputCols=list(features), outputCol="features")])


def random_split(df: DataFrame, weights: Sequence[float], keys: Sequence[str], seed: int = 0) -> list[DataFrame]:
    """Split by a hash of the key: the same row lands on the same side however the table is partitioned."""
    total, edge, bounds = float(sum(weights)), 0.0, []
    for w in weights:
        bounds.append((edge, edge + w / total))
        edge = bounds[-1][1]
    bounds[-1] = (bounds[-1][0], 1.0)
    u = uniform(*keys, seed=seed)
    return [df.where((u >= lo) & (u < hi)) for lo, hi in bounds]


def missing_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float = -999.0) -> DataFrame:
    """A sentinel value becomes NULL, which the booster gives a bin of its own."""
    return df.withColumns({c: F.when(F.col(c) != sentinel, F.col(c)) for c in columns})
