"""Line dedup: levelled sorted runs of line keys.

Documents come in batches, those with the largest ids first.  A run is a table of line keys, bucketed and sorted by
key: in how many documents of its batches a key stands, and the largest of their ids (only where no earlier run knows
the key).  Each new batch is merge-anti-joined with the runs, so that it learns which of its keys are new, and becomes a
run of level 0.  As soon as a level holds ``fanout`` runs they are compacted into one of the next level.  The runs left
at the end say which keys are frequent and who keeps them; the documents are then rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialwright.llm.common import BLANKS, materialize, prepare, table
from trialwright.llm.registry import query
from trialwright.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key as (a, b); NULL for keys shorter than ``min_chars``."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


class LineRuns:
    """Runs of line keys in levels.  A run is (a, b, n_docs, keeper), bucketed and sorted by a."""

    def __init__(self, spark, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # Dealt as the buckets are, so that a task writes one file for each of its buckets.
        rows.repartition(self.buckets, "a", "b").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", scratch_path(self.spark, name)).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (a, b, doc_id), each once, of documents whose ids are all smaller than those of the batches before."""
        own = batch.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        for i, run in enumerate(self.runs()):
            # An anti-join that leaves the known keys in place, to be counted, but without a keeper.
            known = run.select("a", "b", F.lit(True).alias(f"known_{i}")).hint("merge")
            own = own.join(known, ["a", "b"], "left").withColumn("keeper", F.when(F.col(f"known_{i}").isNull(), F.col("keeper"))).drop(f"known_{i}")
        self._push(0, self._write(own))

    def _push(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged([self.spark.table(r) for r in self.levels[level]]))
            self.levels[level] = []
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        # Outer merge joins follow the buckets; a union of bucketed tables need not keep them.
        rows = runs[0]
        for run in runs[1:]:
            other = run.withColumnsRenamed({"n_docs": "more_docs", "keeper": "other_keeper"}).hint("merge")
            rows = rows.join(other, ["a", "b"], "full").select(
                "a", "b", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))).alias("n_docs"),
                F.greatest("keeper", "other_keeper").alias("keeper"))
        return rows

    def drop(self) -> None:
        """Forget the runs; nothing may read them later."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []

    def frequent(self, min_docs: int) -> DataFrame:
        """(a, b, keeper) of keys in at least ``min_docs`` documents."""
        return self._merged(self.runs()).filter(F.col("n_docs") >= min_docs).select("a", "b", "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, into: str = "lines") -> DataFrame:
    """Drop lines whose key stands in at least ``min_docs`` documents, except in the largest of their ids.

    Returns the columns of ``docs`` with ``text`` rewritten, and a struct ``into`` (n_lines, n_dropped); a column of that
    name is replaced.  A NULL or empty text is one empty line and stays NULL or empty.  Rows that share an id are one
    document: they count once and keep or lose a line together.  Rows without an id count nowhere and lose nothing.
    An empty table gives an empty one.  Ties cannot occur: keys are compared by 128 bits of hash.
    """
    spark = docs.sparkSession
    prepare(spark)
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    hashes = F.array_distinct(F.filter(F.transform(split, lambda x: key_hash(x, min_chars)), lambda x: x.isNotNull()))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = F.lit(batches - 1)
    for cut in cuts:
        batch = batch - (F.col("doc_id") > cut).cast("int")
    lines = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(hashes).alias("h"))
        .filter("doc_id IS NOT NULL").select("doc_id", "h.a", "h.b", batch.alias("batch")).distinct(), "lines")
    runs = LineRuns(spark, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).select("a", "b", "doc_id"))
    lost = (lines.join(runs.frequent(min_docs), ["a", "b"]).filter(F.col("doc_id") != F.col("keeper"))
            .groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("__lost")))
    lost = materialize(lost, "lost_lines").withColumnRenamed("doc_id", "__doc")
    runs.drop()
    named = docs.drop(into) if into in docs.columns else docs
    # Never broadcast: how many documents lose lines grows with the table.
    joined = named.join(lost.hint("merge"), F.col("doc_id").cast("bigint") == F.col("__doc"), "left")
    kept = F.when(F.col("__lost").isNull(), split).otherwise(
        F.filter(split, lambda x: ~F.coalesce(F.array_contains("__lost", key_hash(x, min_chars)), F.lit(False))))
    out = joined.withColumn("__kept", kept)
    stats = F.struct(F.size(split).cast("bigint").alias("n_lines"),
                     (F.size(split) - F.size("__kept")).cast("bigint").alias("n_dropped"))
    text = F.when(F.col("text").isNotNull(), F.array_join("__kept", "\n")).alias("text")
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in named.columns], stats.alias(into))


SQL = r"""
WITH line AS (
  SELECT doc_id, i, x, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, i, x, keeper IS NOT NULL AND doc_id <> keeper AS lost FROM line LEFT JOIN frequent USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query("op7_line_dedup", SQL)
def op7(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
