"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms.  Its score is the logistic of a bias, a weight per term and an interaction per
pair of terms, the inner product of two short vectors, so that an insult beside a group's name can weigh more than both
alone.  Term counts that select the features cover all labelled training rows, by map-side combined aggregation; the machine is fitted
on at most ``max_rows`` of them (a documented bound) and applied to all texts inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from trialwright.llm import kernels
from trialwright.llm.common import chunks, crc32_of_id, materialize, prepare, table, utf8, with_column
from trialwright.llm.registry import query

HASH_BITS = 22
# Buckets of the hash that picks the fitted rows.
SAMPLE_BUCKETS = 4096

_LOWER = np.arange(256).astype(np.uint8)
_LOWER[65:91] += 32
# ASCII characters that are neither letters nor digits separate terms.
_PLAIN = np.where([c < 128 and not chr(c).isalnum() for c in range(256)], 32, _LOWER).astype(np.uint8)


def terms(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed term), each pair once, in order of document."""
    data = _PLAIN[data]
    starts, ends, doc = kernels.words(data, places)
    term = kernels.word_hashes(data, starts, ends) >> np.uint64(64 - HASH_BITS)
    pair = np.unique((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | term)
    return (pair >> np.uint64(HASH_BITS)).astype(np.int64), (pair & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def labelled_terms(rows: DataFrame) -> DataFrame:
    """(label, terms) of rows (label, text)."""

    def run(batches):
        for batch in batches:
            data, places = utf8(batch.column(1))
            for a, b in chunks(places):
                doc, term = terms(data[places[a]:places[b]], places[a:b + 1] - places[a])
                lists = np.split(term.astype(np.int32), np.cumsum(np.bincount(doc, minlength=b - a))[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lists, pa.list_(pa.int32()))], ["label", "terms"])

    return rows.mapInArrow(run, "label int, terms array<int>")


@dataclass
class Machine:
    """Weights of the kept terms: ``number`` maps a hashed term to its row, or to -1."""

    number: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias) + np.bincount(doc, self.weights[row], n)
        for f in self.factors.T:
            v = f[row]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def score(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        doc, term = terms(data, places)
        row = self.number[term]
        return 1 / (1 + np.exp(-np.clip(self.logits(doc[row >= 0], row[row >= 0], len(places) - 1), -30, 30)))


def fit(examples: list[tuple[int, np.ndarray]], kept: np.ndarray, factors: int, epochs: int, l2: float, seed: int = 7) -> Machine:
    """Full-batch Adam on the logistic loss over (label, terms) examples; only terms in ``kept`` count."""
    number = np.full(1 << HASH_BITS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    lists = [number[t] for _, t in examples]
    lists = [r[r >= 0] for r in lists]
    y = np.array([label for label, _ in examples], float)
    n, m = len(y), len(kept)
    doc = np.repeat(np.arange(n), [len(r) for r in lists])
    row = np.concatenate(lists) if n else np.zeros(0, np.int64)
    rate = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    machine = Machine(number, 0.0, np.zeros(m), np.random.default_rng(seed).normal(0, 0.02, (m, factors)))
    first = [np.zeros(1), np.zeros(m), np.zeros((m, factors))]
    second = [np.zeros(1), np.zeros(m), np.zeros((m, factors))]
    for step in range(1, epochs + 1 if n and m else 1):
        sums = np.stack([np.bincount(doc, machine.factors[row, f], n) for f in range(factors)], axis=1)
        logits = machine.logits(doc, row, n)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) * weight / max(n, 1)
        beside = error[doc]
        pull = np.stack([np.bincount(row, beside * sums[doc, f], m) for f in range(factors)], axis=1)
        plain = np.bincount(row, beside, m)
        gradients = [np.array([error.sum()]), plain + l2 * machine.weights,
                     pull - machine.factors * plain[:, None] + 4 * l2 * machine.factors]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
        moves = [0.1 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8) for a, b in zip(first, second)]
        machine.bias -= float(moves[0][0])
        machine.weights = machine.weights - moves[1]
        machine.factors = machine.factors - 0.1 * moves[2]
    return machine


def train(examples: DataFrame, max_rows: int = 12_000, max_terms: int = 2048, min_chi2: float = 25.0, factors: int = 4,
          epochs: int = 60, l2: float = 2e-5) -> Machine:
    """Machine from all rows (label, text) of ``examples``.

    Terms are ranked by the chi-square of their counts under both labels, over all rows; the best ``max_terms`` of at least
    ``min_chi2`` are kept.  Both labels weigh the same in the loss.  At most ``max_rows`` rows, whole buckets of a hash of all their terms, are fitted on the driver.
    NULL labels do not count, NULL texts are empty.  Without rows the machine scores every text 0.5.
    """
    rows = examples.filter("label IS NOT NULL").select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(labelled_terms(rows), "labelled_terms")
    total, positive = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    gap = p * total - n * positive
    spread = F.greatest(n * (total - n) * max(positive, 1) * max(total - positive, 1), F.lit(1.0))
    chi2 = gap * gap * total / spread
    best = counts.filter(chi2 >= min_chi2).orderBy(chi2.desc(), "term").limit(max_terms)
    kept = np.array(sorted(r["term"] for r in best.select("term").collect()), np.int64)
    known = np.zeros(1 << HASH_BITS, bool)
    known[kept] = True
    known = found.sparkSession.sparkContext.broadcast(np.packbits(known))

    def only_kept(batches):
        flags = np.unpackbits(known.value).astype(bool)
        for batch in batches:
            lists = [t[flags[t]] for t in (x.values.to_numpy(zero_copy_only=False) for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), batch.column(2)], ["label", "terms", "bucket"])

    hashed = found.select("label", "terms", F.pmod(F.xxhash64("terms"), F.lit(SAMPLE_BUCKETS)).alias("bucket"))
    slim = materialize(hashed.mapInArrow(only_kept, "label int, terms array<int>, bucket bigint"), "kept_terms")
    # Whole buckets of the hash, as many as fit; with few rows that is all of them.
    taken, room = [], max_rows
    for bucket, n in sorted(tuple(r) for r in slim.groupBy("bucket").count().collect()):
        if n <= room:
            taken.append(bucket)
            room -= n
    data = [(r[0], np.array(r[1], np.int64)) for r in slim.filter(F.col("bucket").isin(taken)).select("label", "terms").collect()]
    data.sort(key=lambda e: (e[0], e[1].tobytes()))
    return fit(data, kept, factors, epochs, l2)


def score_texts(docs: DataFrame, machine: Machine, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and a column ``into``: the score of the whole text, from 0 to 1.

    NULL and empty texts score as a text without a known term.  A column named ``into`` is replaced; an empty table
    gives an empty one; rows are scored one by one.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(into) if into in docs.columns else docs
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(
        (machine.number, machine.bias, machine.weights, machine.factors))  # 2 ** HASH_BITS row numbers and max_terms rows

    def run(batches):
        machine = Machine(*sent.value)
        for batch in batches:
            data, places = utf8(batch.column(at).cast(pa.string()).fill_null(""))
            parts = [machine.score(data[places[a]:places[b]], places[a:b + 1] - places[a]) for a, b in chunks(places)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, into])

    return with_column(docs, run, StructField(into, DoubleType()))


def held_out() -> Column:
    """Rows that are kept for measuring: crc32 of the id as text, modulo 3, is 1.  Rows without an id are not."""
    return F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))


@query("op4_toxicity")
def op4(spark, sf_dir):
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").alias("label"))
    # The same join at every size: only rows that may be learned from are dealt by id.
    machine = train(docs.filter(~held_out()).join(labels.hint("merge"), "doc_id").select("label", "text"))
    out = score_texts(docs, machine)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
