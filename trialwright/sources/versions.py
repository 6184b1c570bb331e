"""Logs that are replaced in one step.

A log is a folder of data folders and numbered manifests; a manifest names the data folders that are the log.  Writers put
new data beside the old and then add the next manifest by a rename, so a job that is lost half-way leaves the log as it was, and
readers see one manifest or the next and nothing between.  Of two writers that began from the same manifest the second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"


class LogChanged(RuntimeError):
    """Another writer replaced the log meanwhile."""


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _child(spark: SparkSession, path: str, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the log's manifests, oldest first."""
    _, fs = _files(spark, path)
    folder = _child(spark, path, MANIFESTS)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(number, {"schema": .., "folders": [..]}) of the current or a given manifest."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no log in {path}")
    version = known[-1] if version is None else version
    _, fs = _files(spark, path)
    stream = fs.open(_child(spark, path, MANIFESTS, f"{version:010d}.json"))
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    _, fs = _files(spark, path)
    draft = _child(spark, path, MANIFESTS, f"_{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    target = _child(spark, path, MANIFESTS, f"{version:010d}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception as error:
        if version in versions(spark, path):
            fs.delete(draft, False)
            raise LogChanged(f"version {version} of {path} was written by another") from error
        raise


def _write(df: DataFrame, path: str, by: Sequence[str]) -> str:
    name = f"data-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(f"{path.rstrip('/')}/{name}")
    return name


def read_log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The log as its current (or a given) manifest has it."""
    _, content = manifest(spark, path, version)
    schema = StructType.fromJson(content["schema"])
    if not content["folders"]:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{f}") for f in content["folders"]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*schema.names)


def replace_log(df: DataFrame, path: str, by: Sequence[str] = (), version: int | None = None) -> int:
    """Make ``df`` the log; it may be read from the log itself.  ``version`` is the manifest that ``df`` came from, if it did."""
    spark = df.sparkSession
    known = versions(spark, path)
    last = (known[-1] if known else 0) if version is None else version
    folder = _write(df, path, by)
    _commit(spark, path, last + 1, {"schema": df.schema.jsonValue(), "folders": [folder]})
    return last + 1


def append_log(df: DataFrame, path: str, by: Sequence[str] = ()) -> int:
    """Add rows; what the log holds is neither read nor written."""
    spark = df.sparkSession
    version, content = manifest(spark, path)
    schema = StructType.fromJson(content["schema"])
    folder = _write(df.select(*[F.col(f.name).cast(f.dataType) for f in schema]), path, by)
    _commit(spark, path, version + 1, {**content, "folders": [*content["folders"], folder]})
    return version + 1


def rewrite_log(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> int:
    """Replace the log by ``change`` of it."""
    version, _ = manifest(spark, path)
    return replace_log(change(read_log(spark, path, version)), path, by, version)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` manifests, and data that none of those kept names; returns the folders deleted.

    For times without readers of old versions and without writers, as their unfinished data is not named yet.
    """
    folder, fs = _files(spark, path)
    known = versions(spark, path)
    kept = set().union(*(manifest(spark, path, v)[1]["folders"] for v in known[-keep:]))
    gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in kept]
    for v in known[:-keep]:
        fs.delete(_child(spark, path, MANIFESTS, f"{v:010d}.json"), False)
    for f in gone:
        fs.delete(f, True)
    return len(gone)
