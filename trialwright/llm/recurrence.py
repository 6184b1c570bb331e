"""Stretches of 50 items (bytes or words) that stand in several documents: what both substring operators share.

Documents travel in blocks.  Of every 50-item window the least of its short grams (by hash) is its anchor, so equal windows
have equal anchors at equal places, and about one gram in fifteen is an anchor.  An anchor that only one document has
cannot lie in a repeated window.  Each block sends the hashes of its anchors, each once, packed by range of hash; per range
one task finds those of several documents and sends each block its own.  A hash that every document has is one entry per
block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.llm import kernels
from trialwright.llm.common import in_blocks, ints, materialize, utf8

PACKED = "kind int, to bigint, block bigint, data binary"
NO_ID = np.iinfo(np.int64).max


class Block:
    """The documents of one block in a fixed order, those without an id last: ids, bytes and places."""

    def __init__(self, group: pa.Table):
        text, ids = group.column("text").combine_chunks(), ints(group.column("doc_id"), NO_ID)
        data, places = utf8(text)
        rows = [data[a:b].tobytes() for a, b in zip(places, places[1:])]
        order = sorted(range(len(rows)), key=lambda i: (ids[i], rows[i]))
        self.ids = ids[order]
        self.has_id = ~np.array(group.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False))[order]
        self.data = np.frombuffer(b"".join(rows[i] for i in order), np.uint8)
        self.places = np.append(0, np.cumsum([len(rows[i]) for i in order])).astype(np.int64)
        self.number = int(group.column("block")[0].as_py())


class Items:
    """Items of a block as hashes: ``doc`` of each, ``end`` of its document, and the anchors' places."""

    def __init__(self, block: Block, hashes: np.ndarray, doc: np.ndarray, gram: int, window: int):
        self.block, self.hashes, self.doc, self.gram, self.window = block, hashes, doc, gram, window
        n = len(block.ids)
        edges = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
        self.end = edges[1:][doc]
        grams = kernels.windows(hashes, gram)
        whole = (np.arange(len(grams)) + window <= self.end[:len(grams)]) & block.has_id[doc[:len(grams)]]
        self.places = kernels.anchors(grams, whole, window - gram + 1)
        # An anchor is a least hash, so most are small; mixed again they fill all ranges alike.
        self.anchors = kernels.mix(grams[self.places])


def packed(to: np.ndarray, kind: int, block: int, *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows (kind, to, block, data): the columns' entries, already sorted by ``to``, one row for each target."""
    if not len(to):
        return []
    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(starts[1:], len(to))
    return [(kind, int(to[a]), block, b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)) for a, b in zip(starts, ends)]


def rows_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "to", "block", "data"])


def target(hashes: np.ndarray, targets: int) -> np.ndarray:
    """Range of hash, from 0; ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int64)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    """Columns of one packed row, from the item types."""
    kinds = [np.dtype(k) for k in kinds]
    n, at, out = len(data) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * k.itemsize
    return out


def gathered(group: pa.Table, *kinds) -> tuple[np.ndarray, list[np.ndarray]]:
    """All entries that one target got: the number of the row each came from, and the columns."""
    rows = [unpack(d.as_buffer(), *kinds) for d in group.column("data").combine_chunks()]
    sizes = [len(r[0]) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), [np.concatenate(c) for c in zip(*rows)]


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values in a sorted array, and the number of each entry's run."""
    new = np.append(True, values[1:] != values[:-1])[:len(values)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def grouped(rows: DataFrame, kind: int) -> DataFrame:
    return rows.filter(F.col("kind") == kind).select("to", "block", "data").groupBy("to")


class Recurrence:
    """Blocks of ``docs`` and, per block, the anchors that several documents have."""

    def __init__(self, docs: DataFrame, items: Callable[[Block], Items]):
        self.docs = in_blocks(docs)
        # The range count follows the number of blocks, so what one task gathers stays as large when the table grows.
        blocks = max(1, int(self.docs.agg(F.max("block")).first()[0] or 0) + 1)
        self.targets = targets = max(12, blocks // 6)

        def send(group: pa.Table) -> pa.Table:
            block = Block(group)
            found = items(block)
            doc = block.ids[found.doc[found.places]]
            order = np.lexsort((doc, found.anchors))
            hashes, doc = found.anchors[order], doc[order]
            starts, _ = runs_of(hashes)
            ends = np.append(starts[1:], len(hashes)) - 1
            several = (doc[starts] != doc[ends]) if len(hashes) else np.zeros(0, bool)
            hashes = hashes[starts]
            return rows_table(packed(target(hashes, targets), 0, block.number, hashes, several.astype(np.uint8)))

        def several_documents(group: pa.Table) -> pa.Table:
            source, (hashes, several) = gathered(group, "u8", "u1")
            order = np.argsort(hashes, kind="stable")
            starts, run = runs_of(hashes[order])
            often = np.bincount(run, several[order]) + (np.bincount(run) > 1) > 0
            keep = np.sort(order[often[run]])
            blocks = ints(group.column("block"))[source[keep]]
            by = np.argsort(blocks, kind="stable")
            return rows_table(packed(blocks[by], 1, 0, hashes[keep][by]))

        sent = self.docs.groupBy("block").applyInArrow(send, PACKED)
        self.recurring = materialize(grouped(sent, 0).applyInArrow(several_documents, PACKED), "recurring")

    def with_blocks(self, rows: DataFrame, run: Callable[[Block, list[bytes]], Iterator | pa.Table], schema: str) -> DataFrame:
        """``run`` on every block and the packed rows sent to it."""

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.Table.from_pylist([], empty)
            return run(Block(left), [d.as_buffer() for d in right.column("data").combine_chunks()])

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        empty = to_arrow_schema(StructType.fromDDL(schema))
        right = rows.select("to", "data").groupBy("to")
        return self.docs.groupBy("block").cogroup(right).applyInArrow(both, schema)


def recurring_places(found: Items, sent: list[bytes]) -> np.ndarray:
    """Which of the block's anchor places hold an anchor that several documents have."""
    if not sent:
        return np.zeros(0, np.int64)
    known = np.sort(np.concatenate([np.frombuffer(d, "u8") for d in sent]))
    at = np.minimum(np.searchsorted(known, found.anchors), len(known) - 1)
    return np.flatnonzero(known[at] == found.anchors)
