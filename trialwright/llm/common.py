"""What the document operators share: session settings, tables, block numbers and batches of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trialwright.session import scratch_path

# White space between words: space and the five controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
# Bytes of text that a task turns into arrays at once.  Longer single texts are taken whole.
CHUNK_BYTES = 2 << 20
# Bytes of text in a block of documents that travels as one group.
BLOCK_BYTES = 2 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, and nothing to lose with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Settings for long texts: small Arrow batches, and shuffle files that go when their job has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) of any table of documents; a missing text is an empty one."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def with_column(docs: DataFrame, run, added: StructField) -> DataFrame:
    """``docs`` through ``run`` over Arrow batches, which adds a column; other columns may have any names, dots too."""
    plain = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, StructType([*plain.schema.fields, added])).toDF(*docs.columns, added.name)


def text_key(docs: DataFrame) -> Column:
    """Hash of the whole text; with the id it names a row, up to repeated rows."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are ("left_semi") or are not ("left_anti") among ``rows`` (doc_id, text_key)."""
    named = rows.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__doc")) & (text_key(docs) == F.col("__key"))
    return docs.join(named, same, how)


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text): documents dealt into blocks of about ``BLOCK_BYTES`` by a hash of id and text.

    The number of blocks follows the bytes of the table, so a block stays as large when the table grows.  A
    repeated id is spread by its texts.  The same row always gets the same block number.
    """
    rows = texts(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, total // BLOCK_BYTES + 1)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"), "doc_id", "text")


def crc32_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and the n + 1 places where they begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[places[0]:places[-1]], places - places[0]


def chunks(places: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold at most ``most`` bytes, or one document."""
    at, n = 0, len(places) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(places, places[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def ints(column: pa.Array | pa.ChunkedArray, null: int = -(1 << 63)) -> np.ndarray:
    """Integers of an Arrow column, with a stand-in for NULL."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)
