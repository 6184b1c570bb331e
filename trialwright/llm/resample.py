"""Target-distribution importance resampling with bit-sliced aggregation.

Words and pairs of neighbouring words fall into buckets.  How much more often the target texts use a bucket than the
documents do is its gain, a whole number.  A document's bucket counts become bit planes, one bit a bucket: plane k holds
the k-th binary digit of every count.  The gains become signed bit planes likewise.  The sum of count times gain over
all buckets is then the sum of 2 ** (j + k) times the population count of plane k AND gain plane j, exact in integers.
A document's weight is that sum over its number of features; the draw without replacement adds a hashed Gumbel value to
the weight and takes the highest.

Two passes over the texts: one adds up bucket counts in each task and leaves one row per task and bucket, the other
weighs each document where it lies.  Only numbers are sorted for the draw, in ranges and not in one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.llm.common import chunks, materialize, only, prepare, table, text_key, texts, utf8
from trialwright.llm.registry import query
from trialwright.operators.scan import number_rows

BUCKETS = 10_000
# Documents whose bucket counts are held side by side.
TOGETHER = 128
# Rows of one sorted range of the draw.
RANGE_ROWS = 20_000
# Bytes of a word that are hashed for all words at once; what is left of longer ones is hashed word by word.
STEPS = 40

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0"):ord("9") + 1] = IN_WORD[ord("a"):ord("z") + 1] = IN_WORD[128:] = True


def crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> np.uint32(1) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


CRC = crc_table()


def step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC[(state ^ byte) & 0xFF] ^ state >> np.uint32(8)


class Words:
    """Words of a batch of texts: where they begin and end, longest first, and the document of each."""

    def __init__(self, data: np.ndarray, places: np.ndarray):
        self.data = data = LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[places] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.lengths = ends - self.starts
        self.doc = np.searchsorted(places, self.starts, "right") - 1
        # How many of the words, longest first, have more than k bytes.
        self.longest_first = np.argsort(-self.lengths, kind="stable")
        sizes = np.bincount(np.minimum(self.lengths, STEPS), minlength=STEPS + 1)
        self.longer = len(self.starts) - np.cumsum(sizes)

    def advance(self, state: np.ndarray, which: np.ndarray) -> np.ndarray:
        """CRC states (before the final inversion), one a word, taken on over the bytes of each word; ``which``: words that count."""
        order = self.longest_first
        state, at = state[order], self.starts[order]
        for k in range(STEPS):
            n = int(self.longer[k])
            if not n:
                break
            state[:n] = step(state[:n], self.data[at[:n] + k])
        out = np.empty_like(state)
        out[order] = state
        for i in np.flatnonzero((self.lengths > STEPS) & which).tolist():
            a = int(self.starts[i])
            rest = self.data[a + STEPS:a + int(self.lengths[i])].tobytes()
            out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        return out


def features(data: np.ndarray, places: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every word and every pair of neighbouring words, and the words of each document."""
    found = Words(data, places)
    n = len(found.starts)
    of = np.bincount(found.doc, minlength=len(places) - 1)
    one = found.advance(np.full(n, 0xFFFFFFFF, np.uint32), np.ones(n, bool))
    # A pair goes on from its first word over a space and the second word.
    pairs = np.zeros(n, bool)
    pairs[1:] = found.doc[1:] == found.doc[:-1]
    before = np.zeros(n, np.uint32)
    before[1:] = step(one[:-1], 32)
    two = found.advance(before, pairs)[pairs]
    hashes = np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)
    return (hashes % np.uint32(buckets)).astype(np.int64), np.concatenate([found.doc, found.doc[pairs]]), of


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket, for buckets that have any; each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, places = utf8(batch.column(0))
            for a, b in chunks(places):
                at = places[a:b + 1]
                total += np.bincount(features(data[at[0]:at[-1]], at - at[0], buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = texts(docs).select("text").mapInArrow(run, "bucket bigint, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, item_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: a thousand times the logarithm of the target's share over the documents', rounded down.

    Both shares are smoothed by one feature a bucket.  Two tables of at most ``buckets`` rows reach the driver, whatever the input's size.
    """
    spare = target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(item_text).alias("text"))
    counts = np.zeros((2, buckets))
    for row, rows in enumerate((bucket_counts(docs, buckets), bucket_counts(spare, buckets))):
        for bucket, n in rows.collect():
            counts[row, bucket] = n
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def plane(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit numbers."""
    packed = np.packbits(bits, axis=-1)
    width = -(-packed.shape[-1] // 8) * 8
    out = np.zeros((*packed.shape[:-1], width), np.uint8)
    out[..., :packed.shape[-1]] = packed
    return out.view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, bit plane) of the gains: their sum over the planes, bucket by bucket, is the gain."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        out += [(sign << j, plane(size >> j & 1 == 1)) for j in range(int(size.max()).bit_length())]
    return out


def weigh(counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of count times gain for each row of ``counts`` (documents x buckets), by planes."""
    total = np.zeros(len(counts), np.int64)
    for k in range(int(counts.max(initial=0)).bit_length()):
        digits = plane((counts >> k & 1).astype(bool))
        for power, mask in planes:
            total += (power << k) * np.bitwise_count(digits & mask).sum(axis=1, dtype=np.int64)
    return total


def gumbel(seed: int, doc_id: int) -> int:
    """The hashed random part of a document's score."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score) of every row of ``docs``."""
    buckets, planes = len(gain), gain_planes(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = utf8(batch.column(1))
            sizes, sums = [], []
            for a, b in chunks(places):
                at = places[a:b + 1]
                bucket, doc, words = features(data[at[0]:at[-1]], at - at[0], buckets)
                sizes.append(np.stack([words, np.bincount(doc, minlength=b - a)]))
                order = np.argsort(doc, kind="stable")
                bucket, doc = bucket[order], doc[order]
                for c in range(0, b - a, TOGETHER):
                    n = min(TOGETHER, b - a - c)
                    lo, hi = np.searchsorted(doc, [c, c + n])
                    cells = np.bincount((doc[lo:hi] - c) * buckets + bucket[lo:hi], minlength=n * buckets)
                    sums.append(weigh(cells.reshape(n, buckets), planes))
            words, n = np.concatenate(sizes, axis=1) if sizes else np.zeros((2, 0), np.int64)
            total = np.concatenate(sums) if sums else np.zeros(0, np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = [None if i is None else w + gumbel(seed, i) for i, w in zip(batch.column(0).to_pylist(), weight.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words), pa.array(n), pa.array(weight), pa.array(score, pa.int64())],
                                             ["doc_id", "text_key", "n_words", "n_features", "weight", "score"])

    rows = texts(docs, text_key(docs).alias("text_key"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS,
             range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is NULL for rows not drawn.

    Drawn are ``percent`` in a hundred, rounded down, of the documents of at least ``min_words`` words: those of the
    highest scores, ties to the smaller id, then to the larger weight and the smaller hash of the text.  NULL and empty texts, and
    texts without letters or digits, have no features and weight 0.  Texts of any length are read whole.  Rows without an
    id count as texts, have a weight but no score, and are never drawn nor counted among those that may be.  Repeated
    rows and ids are rows like any other, with the same random part.  Without any target the gains come from the
    smoothing alone.  An empty table gives an empty one.  Other columns of ``docs`` and ``target`` are ignored.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    prepare(docs.sparkSession)
    found = materialize(weights(docs, gains(docs, target, buckets=buckets), seed), "weights")
    may = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    n = found.filter(may).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id"), F.col("weight").desc(), F.col("text_key")]
    placed = number_rows(found.filter(may), [], order, "rank", task_rows=range_rows)
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(found.filter(~may).withColumn("rank", F.lit(None).cast("bigint")))


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns."""
    return only(docs, resample(docs, target, **how).filter("rank IS NOT NULL"), "left_semi")


@query("op13_importance_resampling")
def op13(spark, sf_dir):
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
