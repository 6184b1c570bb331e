"""Token store: raw id files in ascending order of id, and a minimal perfect hash index over their keys.

Documents are range-partitioned by id; each task encodes its range and writes shards: a header, the places of the
documents, then all ids as little-endian unsigned integers of 16 or 32 bits, as they need.  A second job deals the keys into index parts and
builds one minimal perfect hash per part: bit arrays in which each key ends alone in some level, ranks over them, a
32-bit fingerprint per key and the places of its documents.  A lookup hashes the key, ranks one bit, compares the
fingerprint and reads one range of one shard.

A file's name holds the attempt that wrote it, and only names that finished tasks returned are ever used, so a lost
executor or a repeated task leaves at most an unused file.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialwright.llm.common import materialize, prepare, table, texts
from trialwright.llm.encode import Encoder
from trialwright.llm.kernels import mix
from trialwright.llm.registry import query
from trialwright.session import scratch_path

MAGIC = np.frombuffer(b"TOKSHARD", "<u8")[0]
# Bytes of text per writing task, ids per shard and keys per index part.
TASK_BYTES, SHARD_IDS, PART_KEYS = 24 << 20, 8 << 20, 50_000


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_file(path: str, *parts) -> None:
    system, at = filesystem(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as out:
        for part in parts:
            out.write(part)


def read_file(path: str) -> memoryview:
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        return memoryview(f.read())


def write_shard(path: str, documents: list[bytes]) -> None:
    """A shard of documents given as 32-bit ids; ids that all fit are stored in 16 bits."""
    places = np.zeros(len(documents) + 1, "<u8")
    np.cumsum([len(d) // 4 for d in documents], out=places[1:])
    ids = np.frombuffer(b"".join(documents), "<u4")
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    write_file(path, np.array([MAGIC, len(documents), width], "<u8").tobytes(), places.tobytes(), ids.astype(f"<u{width}").tobytes())


def read_shard(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shard's documents, and all its ids."""
    data = read_file(path)
    _, n, width = np.frombuffer(data, "<u8", 3).tolist()
    return np.frombuffer(data, "<u8", n + 1, 24), np.frombuffer(data, f"<u{width}", offset=24 + 8 * (n + 1)).astype("<u4", copy=False)


def read_ids(path: str, ordinal: int) -> np.ndarray:
    """Ids of one document: its two places, then its range."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        _, n, width = np.frombuffer(f.read_at(24, 0), "<u8").tolist()
        start, end = np.frombuffer(f.read_at(16, 24 + 8 * ordinal), "<u8").tolist()
        return np.frombuffer(f.read_at(width * (end - start), 24 + 8 * (n + 1) + width * start), f"<u{width}").astype("<u4", copy=False)


def key_hash(keys: np.ndarray) -> np.ndarray:
    """64-bit hash of 64-bit keys; different keys have different hashes."""
    return mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def _level(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over different hashes: a key's bit is in the first level where it stands alone."""
    levels, left = [], hashes
    while len(left):
        size = max(64, 2 * len(left))
        at = _level(left, len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        levels.append(bits)
        left = left[~alone]
    return levels


def find(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Number of each key, from 0; -1 where no level knows it.  A strange key may get a number: compare fingerprints."""
    out, before, left = np.full(len(hashes), -1, np.int64), 0, np.arange(len(hashes))
    for level, bits in enumerate(levels):
        at = _level(hashes[left], level, len(bits))
        rank, hit = np.cumsum(bits), bits[at]
        out[left[hit]] = before + rank[at[hit]] - 1
        before, left = before + int(rank[-1]), left[~hit]
    return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def pack_part(rows: pd.DataFrame) -> bytes:
    """One index part from (doc_id, part, seq, ordinal, n) rows, as an uncompressed array file."""
    rows = rows.sort_values(["doc_id", "part", "seq"], kind="stable")
    keys, first = np.unique(rows["doc_id"].to_numpy(), return_index=True)
    hashes = key_hash(keys)
    levels = build_hash(hashes)
    number = find(levels, hashes)
    prints, starts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    prints[number], starts[number] = fingerprint(hashes), first
    counts = np.zeros(len(keys), np.int64)
    counts[number] = np.diff([*first, len(rows)])
    out = io.BytesIO()
    np.savez(out, bits=np.packbits(np.concatenate(levels)), sizes=[len(x) for x in levels], prints=prints, starts=starts,
             counts=counts, **{c: rows[c].to_numpy() for c in ("part", "seq", "ordinal", "n")})
    return out.getvalue()


class Part:
    """An index part read from its file."""

    def __init__(self, path: str):
        self.data = dict(np.load(io.BytesIO(read_file(path)), allow_pickle=False))
        sizes = self.data["sizes"]
        bits = np.unpackbits(self.data["bits"], count=int(sizes.sum())).astype(bool)
        self.levels = np.split(bits, np.cumsum(sizes)[:-1])

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key with documents: which key (its place in ``keys``), and which rows of the part's places."""
        hashes = key_hash(keys)
        number = find(self.levels, hashes)
        known = number >= 0
        known[known] = self.data["prints"][number[known]] == fingerprint(hashes[known])
        number, which = number[known], np.flatnonzero(known)
        counts = self.data["counts"][number]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(which, counts), np.repeat(self.data["starts"][number], counts) + within


@dataclass
class TokenStore:
    """Files of a written store.  ``shards``: (part, seq, file, ids, base); ``index``: (bucket, file)."""

    shards: DataFrame
    index: DataFrame
    buckets: int

    def bucket(self):
        return F.when(F.col("doc_id").isNull(), self.buckets).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, part, seq, ordinal, n) of the documents of ``keys`` (doc_id), by the index."""
        asked = keys.select("doc_id").distinct().withColumn("bucket", self.bucket()).join(self.index, "bucket")

        def look(rows: pd.DataFrame) -> pd.DataFrame:
            part = Part(rows["file"].iloc[0])
            ids = rows["doc_id"].astype("Int64")
            which, places = part.places(ids.fillna(0).to_numpy(np.int64))
            return pd.DataFrame({"doc_id": ids.iloc[which].reset_index(drop=True), **{c: part.data[c][places] for c in ("part", "seq", "ordinal", "n")}})

        return asked.groupBy("bucket").applyInPandas(look, "doc_id bigint, part int, seq int, ordinal int, n int")

    def digests(self, keys: DataFrame) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of the documents of ``keys``, read from the files."""
        shards = self.shards.select("part", "seq", "file", "base")
        located = self.locate(keys).join(shards, ["part", "seq"])

        def read(rows: pd.DataFrame) -> pd.DataFrame:
            places, ids = read_shard(rows["file"].iloc[0])
            out = []
            for row in rows.itertuples(index=False):
                for k in range(row.ordinal, row.ordinal + row.n):
                    start, end = int(places[k]), int(places[k + 1])
                    out.append((row.doc_id, row.base + start, end - start, zlib.crc32(ids[start:end])))
            return pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

        return located.groupBy("part", "seq").applyInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def ids(self, doc_id: int) -> list[np.ndarray]:
        """Ids of one document (of each, where the id repeats), without a scan."""
        found = self.locate(self.shards.sparkSession.createDataFrame([(doc_id,)], "doc_id bigint"))
        rows = found.join(self.shards, ["part", "seq"]).orderBy("part", "seq", "ordinal").collect()
        return [read_ids(r["file"], k) for r in rows for k in range(r["ordinal"], r["ordinal"] + r["n"])]


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, task_bytes: int = TASK_BYTES, shard_ids: int = SHARD_IDS,
                part_keys: int = PART_KEYS) -> TokenStore:
    """Encode every whole text, append ``end_id`` and write shards and index to the shared folder.

    Documents stand in ascending order of id, rows without an id first, rows of one id by hash of text and text; a much
    repeated id may fill many shards.  NULL and empty texts are the end id alone.  An empty table gives a store without
    documents.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "tokens")
    rows = texts(docs)
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange(max(1, math.ceil(size / task_bytes)), *order[:2]).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encode, part, seq = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, documents = [], []

        def flush():
            path = f"{folder}/ids/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            write_shard(path, documents)
            n = len(documents)
            return pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()),
                 "file": [path] * n, "ordinal": pa.array(range(n), pa.int32()), "n_tokens": pa.array([len(d) // 4 for d in documents], pa.int64())})

        held = 0
        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids.append(key)
                documents.append(found + end)
                held += len(found) // 4 + 1
                if held >= shard_ids:
                    yield flush()
                    ids, documents, held, seq = [], [], 0, seq + 1
        if documents:
            yield flush()

    written = materialize(ranged.mapInArrow(
        write, "doc_id bigint, part int, seq int, file string, ordinal int, n_tokens bigint"), "token_places")
    shards = written.groupBy("part", "seq", "file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = materialize(shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token_shards")
    store = TokenStore(shards, shards, max(1, math.ceil(count / part_keys)))
    runs = written.groupBy("doc_id", "part", "seq").agg(F.min("ordinal").alias("ordinal"), F.count("*").cast("int").alias("n"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/index/{rows['bucket'].iloc[0]:06d}-{uuid.uuid4().hex}.mph"
        rows["doc_id"] = rows["doc_id"].astype("Int64").fillna(0).astype(np.int64)
        write_file(path, pack_part(rows))
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "file": [path]})

    index = runs.withColumn("bucket", store.bucket()).groupBy("bucket").applyInPandas(build, "bucket int, file string")
    store.index = materialize(index, "token_index")
    return store


@query("op1_token_store")
def op1(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"))
    return store.digests(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")))
