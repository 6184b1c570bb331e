"""SimHash near-dedup: fingerprints, a positional byte index with count filtering, components.

Two 64-bit fingerprints that differ in at most k < 8 bits agree in at least 8 - k of their 8 bytes, place by place.  The
index is keyed by the bytes at 8 - k chosen places, for every choice of places: fingerprints meet under such a key
exactly when the tally of their shared positional bytes reaches the guaranteed minimum, so the count filter is applied
by the shuffle and no pair below it is ever made.  Only distinct fingerprints are indexed.  Under a key the bits are
compared, and the linked ones leave as a tree, not as all pairs.  A key of very many fingerprints is divided further, by
half bytes of the other places, until a part holds no more than 2 ** 16.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialwright.llm.common import materialize, prepare, table, text_key, texts
from trialwright.llm.components import components
from trialwright.llm.registry import query

# Fingerprints under one key that are compared in place.
KEY_ROWS = 20_000
_LINKS = "kind int, a bigint, b bigint"
LINK, DIVIDE = 0, 1


def fingerprint(text: str, size: int) -> int:
    """SimHash of the XXH64 (seed 42) of ``size``-word shingles, A-Z lower-cased; 0 without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - size + 1)
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        m = min(n, at + (1 << 16)) - at
        pairs = zip(starts[at:at + m].tolist(), ends[min(size, len(words)) - 1 + at:][:m].tolist())
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in pairs), np.uint64, m)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, fp): the hash that tells texts of one id apart, and the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], ["doc_id", "text_key", "fp"])

    return texts(docs, text_key(docs).alias("text_key")).mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def masks(places: int, width: int, chosen: int) -> list[int]:
    """Bit masks of every choice of ``chosen`` of ``places`` places of ``width`` bits."""
    one = (1 << width) - 1
    return [sum(one << (width * p) for p in c) for c in combinations(range(places), chosen)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def tree(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what can be reached over links of at most ``max_bits`` bits, one fewer than the fingerprints of each part."""
    left, out = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            root = front.pop()
            near = np.bitwise_count(left ^ root) <= max_bits
            if near.any():
                found = left[near]
                out += [(int(x), int(root)) for x in found.view(np.int64)]
                front += list(found)
                left = left[~near]
    return [(a, signed(b)) for a, b in out]


def scan(max_bits: int, most: int | None):
    """Runs of equal (choice, key) in sorted rows: links of each, or the rows themselves where there are over ``most``."""

    def flush(fps: np.ndarray, choice: int, divide: bool = False):
        if divide or most is not None and len(fps) > most:
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(fps), DIVIDE, np.int32)), "a": pa.array(fps.view(np.int64)),
                                               "b": pa.array(np.full(len(fps), choice, np.int64))})
        edges = np.array(tree(fps, max_bits), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(edges), LINK, np.int32)), "a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    def run(batches):
        held: list[np.ndarray] = []  # fingerprints of the run that may go on
        last, dividing = None, False  # dividing: rows of this run have left to be divided, so the rest follows them
        for batch in batches:
            if not batch.num_rows:
                continue
            choice, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.astype(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(fp))
            if last is not None and (int(choice[0]), int(key[0])) != last:
                if dividing or sum(map(len, held)) > 1:
                    yield flush(np.concatenate(held), last[0], dividing)
                held, dividing = [], False
            if len(starts) > 1:
                first = np.concatenate([*held, fp[:ends[0]]])
                if dividing or len(first) > 1:
                    yield flush(first, int(choice[0]), dividing)
                held, dividing = [], False
                inner, upto = starts[1:-1], ends[1:-1]
                size = upto - inner
                pairs = inner[size == 2]
                near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_bits
                a, b = fp[pairs[near]].view(np.int64), fp[pairs[near] + 1].view(np.int64)
                edges = [(int(x), int(y)) for x, y in zip(a, b)]
                for i, j, c in zip(inner[size > 2].tolist(), upto[size > 2].tolist(), choice[inner[size > 2]].tolist()):
                    if most is not None and j - i > most:
                        yield flush(fp[i:j], int(c))
                    else:
                        edges += tree(fp[i:j], max_bits)
                edges = np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(edges), LINK, np.int32)), "a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})
            held.append(fp[starts[-1]:])
            last = int(choice[-1]), int(key[-1])
            if most is not None and sum(map(len, held)) > most:  # a long run leaves as it comes
                every = np.concatenate(held)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(every), DIVIDE, np.int32)), "a": pa.array(every.view(np.int64)),
                                                  "b": pa.array(np.full(len(every), last[0], np.int64))})
                held, dividing = [every[:0]], True
        if dividing or sum(map(len, held)) > 1:
            yield flush(np.concatenate(held), last[0], dividing)

    return run


def by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("choice", "key").sortWithinPartitions("choice", "key")


def links(fps: DataFrame, max_bits: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges (a, b) over the distinct values of ``fps`` (fp) that connect all values linked by at most ``max_bits`` bits."""
    choices = masks(8, 8, 8 - max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in choices])).alias("choice", "key"))
    found = materialize(by_key(keyed.select("choice", "key", "fp")).mapInArrow(scan(max_bits, key_rows), _LINKS), "links")
    edges = found.filter(F.col("kind") == LINK).select("a", "b")
    again = found.filter(F.col("kind") == DIVIDE)
    if not again.isEmpty():
        # The other bytes as half bytes: 2r places of which at most ``max_bits`` differ.
        finer = []
        for m in choices:
            halves = [h for h in range(16) if not m >> (4 * h) & 15]
            finer.append([signed(m | sum(15 << (4 * h) for h in c)) for c in combinations(halves, len(halves) - max_bits)])
        masks_of: Column = F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in finer]), (F.col("b") + 1).cast("int"))
        keyed = again.select(F.col("a").alias("fp"), F.col("b"), F.posexplode(masks_of).alias("place", "mask"))
        keyed = keyed.select((F.col("b") * 10_000 + F.col("place")).cast("int").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        edges = edges.union(materialize(by_key(keyed).mapInArrow(scan(max_bits, None), _LINKS), "links").select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame, size: int = 4, max_bits: int = 4, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) for every row of ``docs``; ``text_key`` is a hash of the whole text.

    ``component_id`` is the smallest id that can be reached over fingerprints of at most ``max_bits`` (1 to 7) differing bits.
    NULL and empty texts, and texts of blanks, have fingerprint 0.  Rows without an id are linked like others and never
    name a component; a component of such rows only has none.  Repeated rows and ids are in the component of their text.
    An empty table gives an empty one.  Other columns of ``docs`` are ignored.
    """
    if not 1 <= max_bits <= 7:
        raise ValueError("max_bits must be from 1 to 7")
    prepare(docs.sparkSession)
    found = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    part = materialize(components(links(distinct, max_bits, key_rows)), "fingerprint_parts")
    known = distinct.join(part, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(known.select("fp", "root").join(named, "root").select(F.col("fp").alias("__fp"), "component_id"), "components")
    return found.join(of, F.col("fp") == F.col("__fp")).select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, max_bits=4).drop("text_key")
