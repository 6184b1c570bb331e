"""Suffix-array dedup over bytes: blockwise sorting of the suffixes at a cover sample.

Sorting every suffix of the corpus would hold many times its bytes, so only the suffixes of a cover sample are sorted: the
anchors of ``recurrence``, a choice of places such that every 50-byte string holds one, at the same place in every equal
string.  (A difference cover has this only for pairs of residues, so its ranks give no key to shuffle by; the content-defined
cover does.)  Samples that stand in one document only are dropped.  The others are dealt into suffix buckets by the hash
of their first 25 bytes, each with the bytes on both sides that a 50-byte string over it can have.  One task sorts one
bucket: suffixes by what follows, and reversed prefixes by what precedes, each to the depth that still matters.  Adjacent
common lengths turn into ranks per depth, and a 50-byte string is the pair of the rank of its part before the sample
and the rank of its part behind it; ranks, not bytes, settle long ties.  The smallest document of each such pair is the
one that keeps the string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.llm import kernels
from trialwright.llm.common import ints, materialize, prepare, table
from trialwright.llm.recurrence import PACKED, Block, Items, Recurrence, gathered, grouped, packed, recurring_places, rows_table, runs_of, target, unpack
from trialwright.llm.registry import query

WINDOW, GRAM = 50, 25
SIDE = WINDOW - GRAM
EVERY = np.uint32((1 << (SIDE + 1)) - 1)
_BYTES = np.dtype((np.void, SIDE))
# Samples that are sorted at once; those of one hash stay together.
SORT_ROWS = 1 << 16


def byte_items(block: Block) -> Items:
    doc = np.repeat(np.arange(len(block.ids)), np.diff(block.places))
    return Items(block, kernels.BYTE_VALUES[block.data], doc, GRAM, WINDOW)


def sides(found: Items, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before (nearest first) and behind each sample, zero beyond the document, and how many there are of each."""
    data, doc = found.block.data, found.doc[places]
    before = np.minimum(places - found.block.places[doc], SIDE)
    behind = np.minimum(found.end[places] - places - GRAM, SIDE)
    step = np.arange(SIDE)
    left = np.where(step < before[:, None], data[np.maximum(places[:, None] - 1 - step, 0)], 0)
    right = np.where(step < behind[:, None], data[np.minimum(places[:, None] + GRAM + step, len(data) - 1)], 0)
    return left.astype(np.uint8), right.astype(np.uint8), before.astype(np.uint8), behind.astype(np.uint8)


def possible(before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Bit o: the string that begins o bytes before the sample lies in the document."""
    out = np.zeros(len(before), np.uint32)
    for o in range(SIDE + 1):
        out |= ((o <= before) & (SIDE - o <= behind)).astype(np.uint32) << np.uint32(o)
    return out


def columns_of(bytes_: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian integers, first column first."""
    wide = np.zeros((len(bytes_), 32), np.uint8)
    wide[:, :SIDE] = bytes_
    return list(wide.view(">u8").astype(np.uint64).T)


def ranks(hashes: np.ndarray, bytes_: np.ndarray):
    """Sorts suffixes by (hash, bytes); gives a function from a depth to each suffix's rank at that depth."""
    order = np.lexsort([*reversed(columns_of(bytes_)), hashes])
    ordered, keys = bytes_[order], hashes[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
    common[keys[1:] != keys[:-1]] = -1

    def at(depth: int) -> np.ndarray:
        out = np.zeros(len(order), np.int64)
        out[order[1:]] = np.cumsum(common < depth)
        return out

    return at


def parts_of(hashes: np.ndarray, most: int = SORT_ROWS) -> list[np.ndarray]:
    """Entries in parts of about ``most``; entries of one hash are in one part."""
    order = np.argsort(hashes, kind="stable")
    starts, _ = runs_of(hashes[order])
    cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, len(order), most), "right") - 1])[1:] if len(order) else []
    return [part for part in np.split(order, cuts) if len(part)]


def earlier(hashes: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Bit o of each sample: its string that begins o bytes before also starts in a document with a smaller id."""
    out = np.zeros(len(hashes), np.uint32)
    if not len(hashes):
        return out
    # Where all samples of a hash have the same sides, the smallest document has every string.
    by = np.argsort(hashes, kind="stable")
    starts, run = runs_of(hashes[by])
    least = np.minimum.reduceat(doc[by], starts)[run]
    sides_ = np.concatenate([left, right], axis=1)[by]
    alike = np.logical_and.reduceat((sides_ == sides_[starts][run]).all(axis=1), starts)[run]
    out[by[alike]] = np.where(least[alike] < doc[by][alike], may[by][alike], 0)
    rest = by[~alike]
    if not len(rest):
        return out
    hashes, doc, may = hashes[rest], doc[rest], may[rest]
    before, behind = ranks(hashes, left[rest]), ranks(hashes, right[rest])
    found = np.zeros(len(rest), np.uint32)
    for o in range(SIDE + 1):
        able = np.flatnonzero(may >> np.uint32(o) & np.uint32(1))
        if not len(able):
            continue
        pair = before(o)[able] * np.int64(len(rest) + 1) + behind(SIDE - o)[able]
        order = np.argsort(pair, kind="stable")
        starts, run = runs_of(pair[order])
        least = np.minimum.reduceat(doc[able][order], starts)[run]
        hit = able[order[least < doc[able][order]]]
        found[hit] |= np.uint32(1 << o)
    out[rest] = found
    return out


def removed(masks: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Mask of the bytes that the strings in ``masks`` (bit o: from places - o on) cover."""
    change = np.zeros(n + 1, np.int64)
    for o in range(SIDE + 1):
        starts = places[(masks >> np.uint32(o) & np.uint32(1)) > 0] - o
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, spans, n_bytes): the bytes left of every document, and the runs (start, length) that were removed.

    A byte goes if some 50-byte string over it also starts in a document with a smaller id; strings are those of the input and
    lie in one document.  ``kept`` is binary, for a cut may fall inside a character.  NULL texts are empty; texts of fewer
    than 50 bytes lose nothing.  Rows of one id never judge each other, but are judged alike; rows without an id neither lose bytes
    nor judge.  An empty table gives an empty one.  Other columns of ``docs`` are ignored.
    """
    prepare(docs.sparkSession)
    work = Recurrence(docs, byte_items)
    targets = work.targets
    entry = ("u8", "i8", "u4", _BYTES, _BYTES, "u4")

    def samples(block: Block, sent: list[bytes]) -> pa.Table:
        found = byte_items(block)
        places = found.places[at := recurring_places(found, sent)]
        if not len(places):
            return rows_table([])
        hashes, doc = found.anchors[at], block.ids[found.doc[places]]
        left, right, before, behind = sides(found, places)
        may = possible(before, behind)
        # Samples alike in hash and sides leave the block once, for their smallest document; in the others all is repeated.
        order = np.lexsort([doc, may, *reversed(columns_of(right)), *reversed(columns_of(left)), hashes])
        hashes, doc, left, right, may, places = (x[order] for x in (hashes, doc, left, right, may, places))
        new = np.ones(len(hashes), bool)
        new[1:] = ((hashes[1:] != hashes[:-1]) | (may[1:] != may[:-1]) | (left[1:] != left[:-1]).any(axis=1)
                   | (right[1:] != right[:-1]).any(axis=1))
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        later = doc > doc[starts][run]
        local = [(1, block.number, block.number, places[later].astype("u4").tobytes() + may[later].tobytes())] if later.any() else []
        # Rows of the smallest id itself stand for one another only if there is one of them.
        first = ~later
        hashes, doc, left, right, may, places = (x[first] for x in (hashes, doc, left, right, may, places))
        out = [hashes, doc, places.astype("u4"), left.reshape(-1).view(_BYTES), right.reshape(-1).view(_BYTES), may]
        return rows_table(packed(target(hashes, targets), 0, block.number, *out) + local)

    def sort_bucket(group: pa.Table) -> pa.Table:
        source, (hashes, doc, places, left, right, may) = gathered(group, *entry)
        split = lambda x: np.frombuffer(x.tobytes(), np.uint8).reshape(-1, SIDE)
        masks = np.zeros(len(hashes), np.uint32)
        for some in parts_of(hashes):
            masks[some] = earlier(hashes[some], doc[some], split(left[some]), split(right[some]), may[some])
        keep = np.flatnonzero(masks)
        blocks = ints(group.column("block"))[source[keep]]
        by = np.argsort(blocks, kind="stable")
        return rows_table(packed(blocks[by], 1, 0, places[keep][by], masks[keep][by]))

    def rewrite(block: Block, sent: list[bytes]) -> pa.Table:
        n = len(block.data)
        lost = np.zeros(n, bool)
        if sent:
            places, masks = (np.concatenate(c) for c in zip(*[unpack(d, "u4", "u4") for d in sent]))
            lost = removed(masks, places.astype(np.int64), n)
        kept, spans = [], []
        for a, b in zip(block.places.tolist(), block.places[1:].tolist()):
            mine = lost[a:b]
            kept.append(block.data[a:b][~mine].tobytes())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            spans.append([{"start": s, "length": e - s} for s, e in edges.reshape(-1, 2).tolist()])
        return pa.table([pa.array(block.ids, mask=~block.has_id), pa.array(kept, pa.binary()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(np.diff(block.places))],
                        names=["doc_id", "kept", "spans", "n_bytes"])

    sent = materialize(work.with_blocks(work.recurring, samples, PACKED), "samples")
    sorted_ = grouped(sent, 0).applyInArrow(sort_bucket, PACKED)
    every = materialize(sorted_.union(sent.filter(F.col("kind") == 1)), "repeated")
    return work.with_blocks(every, rewrite, "doc_id bigint, kept binary, spans array<struct<start:bigint,length:bigint>>, n_bytes bigint")


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
