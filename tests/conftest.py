import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Trial log from {run: [scores]}; iterations count from 1."""

    def make(runs, experiment="e"):
        rows = [(experiment, run, i, score) for run, scores in runs.items() for i, score in enumerate(scores, 1)]
        return spark.createDataFrame(rows, "experiment string, run long, iter long, score double")

    return make


@pytest.fixture
def rows():
    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted(tuple(r) for r in picked.collect())

    return get
