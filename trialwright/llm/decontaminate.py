"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is contained in a document if at least 0.8 of its five-word shingles occur there, so a short item may hide in a
very long text, where the Jaccard similarity of the two sets is tiny.  Two things bring it back into reach.  Shingles that
no item has cannot count, so a bitmap of fixed size over all items' shingles thins out each document's set first (a
false hit only enlarges the set).  The sets that remain are partitioned by size; for each pair of a size class and an
item class the containment bound becomes a Jaccard bound by the class's largest size, and with it as many MinHash bands
as are needed to miss less than one pair in a million.  Where 128 hash functions are not enough, the shingles themselves
are the keys.  Candidates are verified on the sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.llm import kernels
from trialwright.llm.common import chunks, materialize, prepare, table, utf8
from trialwright.llm.registry import query

SHINGLE, THRESHOLD, HASHES, MISS = 5, 0.8, 128, 1e-6
# Bits of the bitmap of item shingles: 4 MiB for any number of items.
FILTER_BITS = 25

# ASCII characters that are neither letters nor digits separate words here; texts come lower-cased.
_SPLIT = np.array([not chr(c).isalnum() if c < 128 else False for c in range(256)])
_PLAIN = np.where(_SPLIT, 32, np.arange(256)).astype(np.uint8)


def doc_shingles(data: np.ndarray, places: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of n words for n in ``sizes``."""
    data = _PLAIN[data]
    starts, ends, doc = kernels.words(data, places)
    hashes = kernels.word_hashes(data, starts, ends)
    docs, out = [], []
    for n in sizes:
        grams = kernels.windows(hashes, n)
        inside = doc[:len(grams)] == doc[n - 1:n - 1 + len(grams)]
        docs.append(doc[:len(grams)][inside])
        out.append(kernels.mix(grams[inside] + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(out)


def sets_of(rows: DataFrame, sizes: list[int] | None, bitmap=None, least: int = 1) -> DataFrame:
    """(id, text_key, n, shingles) of (id, text_key, text): distinct shingles, those in ``bitmap`` only if there is one.

    ``sizes`` None: an item of fewer than five words is one shingle of all its words.  Sets of fewer than ``least`` are left out.
    """

    def run(batches):
        for batch in batches:
            data, places = utf8(batch.column(2))
            for a, b in chunks(places):
                part, at = data[places[a]:places[b]], places[a:b + 1] - places[a]
                if sizes is None:
                    n_words = np.bincount(kernels.words(_PLAIN[part], at)[2], minlength=b - a)
                    doc, found = doc_shingles(part, at, [SHINGLE])
                    for n in set(n_words[n_words < SHINGLE].tolist()) - {0}:
                        short_doc, short = doc_shingles(part, at, [n])
                        mine = n_words[short_doc] == n
                        doc, found = np.append(doc, short_doc[mine]), np.append(found, short[mine])
                else:
                    doc, found = doc_shingles(part, at, sizes)
                if bitmap is not None:
                    bits = found >> np.uint64(64 - FILTER_BITS)
                    hit = (bitmap.value[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    doc, found = doc[hit], found[hit]
                order = np.lexsort((found, doc))
                doc, found = doc[order], found[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (found[1:] != found[:-1]))[:len(doc)]
                doc, found = doc[new], found[new].view(np.int64)
                counts = np.bincount(doc, minlength=b - a)
                which = np.flatnonzero(counts >= least)
                ends = np.cumsum(counts)
                lists = [found[ends[i] - counts[i]:ends[i]] for i in which]
                piece = batch.slice(a, b - a)
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(take), piece.column(1).take(take), pa.array(counts[which], pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["id", "text_key", "n", "shingles"])

    return rows.mapInArrow(run, "id bigint, text_key bigint, n bigint, shingles array<bigint>")


def bands(size_class: int, item_class: int) -> tuple[int, int]:
    """(rows, bands) for sets of at most 2 ** size_class and items of at least 2 ** item_class shingles; (0, 0): too far apart."""
    jaccard = THRESHOLD / (2.0 ** size_class / 2.0 ** item_class + 1 - THRESHOLD)
    for r in (4, 3, 2, 1):
        need = math.ceil(math.log(MISS) / math.log1p(-min(jaccard ** r, 1 - 1e-12)))
        if r * need <= HASHES:
            return r, need
    return 0, 0


def keyed(sets: DataFrame, item_classes: list[int], size_classes: list[int], item: bool) -> DataFrame:
    """(who, size_class, item_class, band, key): where a set stands in the index, or where an item asks."""

    def run(batches):
        seeds = kernels.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            out = [[] for _ in range(5)]
            for who, n, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = found.values.to_numpy(zero_copy_only=False).view(np.uint64)
                least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
                for a in range(0, len(values), 4096):
                    least = np.minimum(least, kernels.mix(values[a:a + 4096, None] ^ seeds).min(axis=0))
                own = int(n).bit_length() - 1  # of an item: 2 ** own <= n
                upper = (int(n) - 1).bit_length()  # of a set: n <= 2 ** upper
                pairs = [(s, own) for s in size_classes] if item else [(upper, i) for i in item_classes]
                for s, i in pairs:
                    if 2 ** s < THRESHOLD * 2 ** i:
                        continue  # the set is too small to hold so much of the item
                    r, b = bands(s, i)
                    if r:
                        keys, band = np.zeros(b, np.uint64), np.arange(b)
                        for k in range(r):
                            keys = kernels.mix(keys ^ least[k * b:(k + 1) * b])
                    else:
                        keys, band = values, np.full(len(values), -1)
                    for column, value in zip(out, ([who] * len(keys), [s] * len(keys), [i] * len(keys), band.tolist(), keys.view(np.int64).tolist())):
                        column += value
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if 0 < k < 4 else pa.int64()) for k, c in enumerate(out)],
                                             ["who", "size_class", "item_class", "band", "key"])

    return sets.select("who", "n", "shingles").mapInArrow(run, "who bigint, size_class int, item_class int, band int, key bigint")


def text_rows(df: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("text_key"), F.lower(text).alias("text"))


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, containment): documents and the items of which they hold at least 0.8.

    Items are ``benchmark``'s (item_id, text).  Words are runs of letters and digits, lower-cased.  Items without a word, NULL
    and empty texts match nothing; items of fewer than five words match where their words stand in sequence.
    ``text_key`` (xxhash64 of the text) tells rows of one id apart and finds rows without an id; repeated rows give repeated
    results.  Empty tables give an empty result.  Other columns of both tables are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = materialize(sets_of(text_rows(benchmark, "item_id"), None).withColumn("who", F.monotonically_increasing_id()), "item_sets")
    shape = items.agg(F.min("n"), F.max("n")).first()
    empty = spark.createDataFrame([], "doc_id bigint, text_key bigint, item_id bigint, containment double")
    if not shape[0]:
        return empty
    least = max(1, math.ceil(THRESHOLD * shape[0] - 1e-9))
    bits = items.select(F.explode("shingles").alias("s")).select(F.shiftrightunsigned("s", 64 - FILTER_BITS).alias("bit"))
    lit = bits.groupBy(F.shiftright("bit", 3).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1, CAST(bit & 7 AS INT))")).alias("bits")).collect()  # at most the bitmap's bytes
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bitmap[[r["at"] for r in lit]] = [r["bits"] for r in lit]
    # Items of fewer than five words have one shingle; their lengths decide which other runs of words are looked up.
    shorter = benchmark_lengths(benchmark)
    sets = sets_of(text_rows(docs, "doc_id"), [SHINGLE, *shorter], spark.sparkContext.broadcast(bitmap), least)
    sets = materialize(sets.withColumn("who", F.monotonically_increasing_id()), "document_sets")
    size_classes = [r[0] for r in sets.select(F.expr("CAST(ceil(log2(n) - 1e-9) AS INT)")).distinct().collect()]
    item_classes = sorted({r[0] for r in items.select(F.expr("CAST(floor(log2(n) + 1e-9) AS INT)")).distinct().collect()})
    on = ["size_class", "item_class", "band", "key"]
    index, asked = keyed(sets, item_classes, size_classes, False), keyed(items, item_classes, size_classes, True)
    pairs = index.join(asked.withColumnRenamed("who", "item"), on).select("who", "item").distinct()
    pairs = materialize(pairs, "candidates")
    of_items = items.select(F.col("who").alias("item"), F.col("id").alias("item_id"), F.col("n").alias("item_n"), F.col("shingles").alias("item_shingles"))
    held = F.size(F.array_intersect("shingles", "item_shingles")) / F.col("item_n")
    found = pairs.join(sets, "who").join(of_items, "item").withColumn("containment", held)
    return found.filter(F.col("containment") >= THRESHOLD).select(F.col("id").alias("doc_id"), "text_key", "item_id", "containment")


def benchmark_lengths(benchmark: DataFrame) -> list[int]:
    """Numbers of words, from 1 to 4, that some item has."""
    n = F.size(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))
    return sorted(r[0] for r in benchmark.select(n.alias("n")).filter((F.col("n") > 0) & (F.col("n") < SHINGLE)).distinct().collect())


@query("op3_decontamination")
def op3(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.round("containment", 6).alias("containment"))
