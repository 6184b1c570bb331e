"""Feature tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StructField, StructType


def double_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def read_features(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return spark.read.schema(schema).format(fmt).load(path)


def read_headerless(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Positional names, every column numeric."""
    return spark.read.schema(double_schema(names)).csv(path, header=False)


def read_typed(spark: SparkSession, path: str, schema: StructType, header: bool = False) -> DataFrame:
    """Explicit types; wholly empty lines are skipped."""
    return spark.read.schema(schema).csv(path, header=header).na.drop(how="all")
