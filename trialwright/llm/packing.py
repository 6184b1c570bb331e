"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous rounds.

A round range-sorts the unplaced pieces and the gaps of open sequences by size, largest first, gaps before pieces of
their size.  Each task sweeps its range with a stack: a piece takes the smallest gap that is large enough and still free,
so of several pieces with the same successor the first by rank gets it and the others go on to the next larger gap; what
is left of a gap is a gap again.  Pieces whose successor lies in an earlier range are matched by rank from the tasks'
leftover counts of each size, and what they leave of a gap goes on to shorter pieces, so a round places as much however
many ranges it has.  Gaps are then updated.  Pieces longer than every gap open new sequences, the longest first and no more than their tokens need.
Rounds repeat until every piece has its place.  A piece that opens a sequence gives it its number.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialwright.llm.common import materialize, prepare, table, texts
from trialwright.llm.encode import Encoder
from trialwright.llm.registry import query

# Rows (gaps and pieces) that one task sweeps.
SWEEP_ROWS = 500_000
# Ranks (of one range and size) that a row of the matches between ranges covers at most.
RANKS = 1024
GAP, PIECE, PLACED = 0, 1, 2
STATE = "kind int, key bigint, size int, sequence_id bigint, offset int, part int, rank bigint"
PIECES = "key bigint, doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32): the pieces of every document; only the first may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode, key = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (start, stop) in enumerate(zip(edges, edges[1:])):
                    out.append((key, doc_id, i, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    key += 1
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PIECES.split(", ")])

    return texts(docs).mapInArrow(cut, PIECES)


def sweep(capacity: int):
    """One task's range, largest first: matched pieces leave with their sequence, the others with their rank in their size."""

    def run(frames):
        part, stack, rests, waiting, done = TaskContext.get().partitionId(), [], [], Counter(), []
        for frame in frames:
            for kind, key, size in zip(frame["kind"].tolist(), frame["key"].tolist(), frame["size"].tolist()):
                while rests and -rests[0][0] >= size:  # what is left of a gap comes again in its place
                    free, sequence = heapq.heappop(rests)
                    stack.append((sequence, -free))
                if kind == GAP:
                    stack.append((key, size))
                elif stack:
                    sequence, free = stack.pop()
                    done.append((PLACED, key, size, sequence, capacity - free, part, 0))
                    if free > size:
                        heapq.heappush(rests, (size - free, sequence))
                else:
                    done.append((PIECE, key, size, 0, 0, part, waiting[size]))
                    waiting[size] += 1
            yield pd.DataFrame(done, columns=[f.split()[0] for f in STATE.split(", ")])
            done = []
        left, gaps = [], Counter()
        for key, size in [*reversed(stack), *((key, -free) for free, key in rests)]:
            left.append((GAP, key, size, 0, 0, part, gaps[size]))
            gaps[size] += 1
        yield pd.DataFrame(left, columns=[f.split()[0] for f in STATE.split(", ")])

    return run


def across(left: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches between ranges, from (range, waiting pieces, free gaps, largest of those pieces, least of those gaps).

    Gives (piece range, first rank, gap range, first rank, pieces, pieces in each gap): waiting pieces take the least of the
    earlier gaps, and as many go into one gap as fit whatever their sizes are.  What they leave of it is a gap again, so a gap may
    be in several matches; its pieces lie in it in the order of these.
    """
    stack, rests, out = [], [], []

    def back(size):  # what is left of gaps comes again in its place
        while rests and -rests[0][0] >= size:
            free, source, taken, count = heapq.heappop(rests)
            stack.append((source, taken, count, -free))

    for part, pieces, gaps, largest, least in sorted(left, key=lambda row: row[0]):
        at = 0
        if pieces:
            back(largest)
        while at < pieces and stack:
            source, taken, count, free = stack.pop()
            each = free // largest
            n = min(pieces - at, count * each)
            out.append((part, at, source, taken, n, each))
            at += n
            full, more = divmod(n, each)
            for used, first, held in ((full, taken, each), (min(more, 1), taken + full, more)):
                if used and free > held * largest:
                    heapq.heappush(rests, (held * largest - free, source, first, used))
            if (used := full + min(more, 1)) < count:
                stack.append((source, taken + used, count - used, free))
        if gaps:
            back(least)
            stack.append((part, 0, gaps, least))
    return out


def match(state: DataFrame, rows: int, capacity: int) -> DataFrame:
    """One sweep over all gaps and pieces, and the matches between its ranges."""
    parts = max(1, math.ceil(rows / SWEEP_ROWS))
    order = [F.col("size").desc(), F.col("kind").asc(), F.col("key").asc()]
    ranged = state.select("kind", "key", "size").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    swept = materialize(ranged.mapInPandas(sweep(capacity), STATE), "swept")
    # Of each range and size the pieces that wait and the gaps left, in the order of the sweep: at most a few rows a range and size.
    left = swept.filter(F.col("kind") != PLACED).groupBy("size", "kind", "part").count().collect()
    left = sorted(((size, kind, part, n) for size, kind, part, n in left), key=lambda r: (-r[0], *r[1:]))
    matches = across([(i, n, 0, size, None) if kind == PIECE else (i, 0, n, None, size) for i, (size, kind, _, n) in enumerate(left)])
    if not matches:
        return swept
    # Places of both sides in one numbering of the gaps matched: (range, size, rank) -> number.
    spark, sides, used = state.sparkSession, [], {}
    for _, _, gap, first, n, each in matches:
        used[gap] = max(used.get(gap, 0), first - (-n // each))
    number = dict(zip(used, accumulate(used.values(), initial=0)))
    every = [(gap, 0, n, 1, number[gap], 0) for gap, n in used.items()]
    every += [(piece, rank, n, each, number[gap] + first, turn) for turn, (piece, rank, gap, first, n, each) in enumerate(matches, 1)]
    for i, rank, n, *more in every:
        size, kind, part, _ = left[i]
        sides += [(kind, part, size, block, rank, n, *more) for block in range(rank // RANKS, (rank + n - 1) // RANKS + 1)]
    names = ["m_kind", "m_part", "m_size", "m_block", "m_rank", "m_n", "m_each", "m_number", "turn"]
    sides = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*sides)], names))
    here = ((F.col("kind") == F.col("m_kind")) & (F.col("part") == F.col("m_part")) & (F.col("size") == F.col("m_size"))
            & (F.expr(f"rank div {RANKS}") == F.col("m_block")) & (F.col("rank") >= F.col("m_rank")) & (F.col("rank") < F.col("m_rank") + F.col("m_n")))
    marked = swept.join(F.broadcast(sides), here, "left").withColumn("number", F.col("m_number") + F.expr("(rank - m_rank) div m_each"))
    marked = marked.select(*[f.split()[0] for f in STATE.split(", ")], "number", "turn")
    # A gap and its pieces, no more of them than fit, the gap first.
    order = Window.partitionBy("number").orderBy("turn", "rank")
    together = marked.filter(F.col("number").isNotNull()).withColumn(
        "free", F.sum(F.when(F.col("kind") == GAP, F.col("size")).otherwise(-F.col("size"))).over(order).cast("int")).withColumn(
        "sequence", F.first("key").over(order)).withColumn("last", F.lead("kind").over(order).isNull())
    zero, columns = F.lit(0).cast("bigint"), [f.split()[0] for f in STATE.split(", ")]
    piece = F.struct(F.lit(PLACED).alias("kind"), "key", "size", F.col("sequence").alias("sequence_id"),
                     (capacity - F.col("free") - F.col("size")).alias("offset"), "part", "rank")
    rest = F.struct(F.lit(GAP).alias("kind"), F.col("sequence").alias("key"), F.col("free").alias("size"), zero.alias("sequence_id"),
                    F.lit(0).alias("offset"), F.lit(-1).alias("part"), zero.alias("rank"))
    both = F.array_compact(F.array(F.when(F.col("kind") == PIECE, piece), F.when(F.col("last") & (F.col("free") > 0), rest)))
    filled = together.select(F.explode(both).alias("r")).select(*[f"r.{c}" for c in columns])
    return materialize(marked.filter(F.col("number").isNull()).drop("number", "turn").union(filled), "swept")


def opened(state: DataFrame, sizes: list[tuple[int, int, int]], capacity: int, turn: int) -> DataFrame | None:
    """Let pieces longer than every gap open sequences, as many as the tokens of all such pieces need; None if there are none."""
    widest = max([size for kind, size, _ in sizes if kind == GAP], default=0)
    longer = sorted([(size, n) for kind, size, n in sizes if kind == PIECE and size > widest], reverse=True)
    need = math.ceil(sum(size * n for size, n in longer) / capacity)
    if not need:
        return None
    cut, share = 0, 1.0
    for size, n in longer:
        if size <= capacity // 2 and n >= need:
            cut, share = size, need / n
            break
        need = max(need - n, 1)
    dealt = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    first = (F.col("kind") == PIECE) & (F.col("size") > widest) & ((F.col("size") > cut) | ((F.col("size") == cut) & dealt))
    zero = F.lit(0).cast("bigint")
    rows = state.select(F.explode(F.when(first, F.array(
        F.struct(F.lit(PLACED).alias("kind"), "key", "size", F.col("key").alias("sequence_id"), F.lit(0).alias("offset"), F.lit(0).alias("part"), zero.alias("rank")),
        F.struct(F.lit(GAP).alias("kind"), "key", (capacity - F.col("size")).alias("size"), zero.alias("sequence_id"), F.lit(0).alias("offset"), F.lit(-1).alias("part"), zero.alias("rank")),
    )).otherwise(F.array(F.struct(F.col("kind"), "key", "size", "sequence_id", "offset", "part", "rank")))).alias("r"))
    return rows.select("r.*").filter((F.col("kind") != GAP) | (F.col("size") > 0))


def place(lengths: DataFrame, capacity: int) -> DataFrame:
    """(key, sequence_id, offset) for rows (key, length), lengths from 1 to ``capacity``."""
    zero = F.lit(0).cast("bigint")
    state = lengths.filter(F.col("length") < capacity).select(
        F.lit(PIECE).alias("kind"), "key", F.col("length").cast("int").alias("size"), zero.alias("sequence_id"), F.lit(0).alias("offset"), F.lit(0).alias("part"), zero.alias("rank"))
    done = lengths.filter(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).alias("offset"))
    turn, fresh = 0, True
    while True:
        rows = state if fresh else state.filter(F.col("kind") != PLACED)
        sizes = [tuple(r) for r in rows.groupBy("kind", "size").count().collect()]  # at most two rows per size
        if not any(kind == PIECE for kind, *_ in sizes):
            return done
        begun = opened(rows, sizes, capacity, turn)
        if begun is not None:
            done = done.union(begun.filter(F.col("kind") == PLACED).select("key", "sequence_id", "offset"))
            rows = begun.filter(F.col("kind") != PLACED)
        # A gap below the shortest piece is full.
        least = min(size for kind, size, _ in sizes if kind == PIECE)
        rows = rows.filter((F.col("kind") == PIECE) | (F.col("size") >= least))
        state, turn, fresh = match(rows, sum(n for *_, n in sizes), capacity), turn + 1, False
        done = done.union(state.filter(F.col("kind") == PLACED).select("key", "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document and its place.

    A document is the ids of its whole text and ``end_id``; NULL and empty texts are the end id alone.  Only documents of more
    than ``capacity`` ids are cut.  Rows without an id and repeated rows are documents of their own; equal lengths are
    told apart by row.  An empty table gives an empty one.  Other columns of ``docs`` are ignored.
    """
    prepare(docs.sparkSession)
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    placed = place(pieces.select("key", "length"), capacity)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
                                             "sequence_id", F.col("offset").cast("bigint").alias("offset"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
