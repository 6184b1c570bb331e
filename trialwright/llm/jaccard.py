"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists, and the components of its links.

Two sets of n and m shingles link when they share T = ceil(p (n + m) / (100 + p)) or more.  DivideSkip answers that from
the inverted lists of a set's shingles: the L longest lists are set aside, the others are merged on a heap that skips
what cannot reach T - L occurrences, and what reaches it is probed in the long lists by binary search.  In a fixed order
from rare to frequent shingles, the short lists are the first n - T + k of a set, so that T - L = k.

1. Texts of equal sets are one class; one text of each goes on.
2. Blocks of texts send their shingles' hashes once each, packed by range; ranges send back those of several texts and
   their counts.  A shingle of one text has no list, and a text with too few others can link with nothing.
3. Near groups: sets meet under a few minimum hashes, large groups in parts of bounded size, and DivideSkip over the lists of
   the part finds links within.  Only the edges of a tree leave a part.  This joins most sets of a large group of near copies.
4. The exact search: lists in which two different parts of step 3 stand are cut by part and slice; a set's short lists
   of the other parts are merged on the heap, and the rest is probed in the sorted shingles of each candidate.  Sets that are
   joined already never meet, so a large group of near copies is not compared pair by pair.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.llm import kernels
from trialwright.llm.common import chunks, in_blocks, materialize, prepare, table, text_key, texts, utf8
from trialwright.llm.components import components
from trialwright.llm.recurrence import PACKED, Block, gathered, packed, rows_table, runs_of, target, unpack
from trialwright.llm.registry import query

# Minimum hashes under which sets meet, and the sets of a part.
MEETINGS, PART_SETS = 3, 100
# Entries of one slice of an inverted list.  Parts of fewer sets than the second number share their slices.
SLICE, SMALL_PART = 4096, 64
# The weight of probing against merging in DivideSkip's choice of L.
MU = 0.01
LOW = np.uint64((1 << 40) - 1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending within the text, and the n + 1 places where texts begin and end.

    A text of fewer than ``size`` words has one shingle, all its words; one without words has none.
    """
    data = _LOWER[data]
    starts, ends, doc = kernels.words(data, places)
    hashes = kernels.word_hashes(data, starts, ends)
    n = len(places) - 1
    counts = np.bincount(doc, minlength=n)
    edges = np.append(0, np.cumsum(counts))
    grams = kernels.windows(hashes, size)
    whole = np.arange(len(grams)) + size <= edges[1:][doc[:len(grams)]]
    found, of = grams[whole], doc[:len(grams)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    alone = [kernels.windows(hashes[edges[i]:edges[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in short.tolist()]
    found, of = np.concatenate([found, np.array(alone, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1]))[:len(found)]
    found, of = found[new], of[new]
    return found, np.append(0, np.cumsum(np.bincount(of, minlength=n)))


def classes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, text, n, class): the size of each row's set and a 64-bit hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = utf8(batch.column(1))
            sizes, digests = [], []
            for a, b in chunks(places):
                found, edges = shingle_sets(data[places[a]:places[b]], places[a:b + 1] - places[a], size)
                total = np.append(np.uint64(0), np.cumsum(kernels.mix(found)))
                sizes.append(np.diff(edges))
                digests.append(kernels.mix(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(np.uint64)))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(np.concatenate(sizes or none)),
                                              pa.array(np.concatenate(digests or none).view(np.int64))], ["doc_id", "text_key", "text", "n", "class"])

    rows = texts(docs, text_key(docs).alias("text_key"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, text string, n bigint, class bigint")


class Limits:
    """What a similarity of ``percent`` in a hundred asks of two sets, all in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def shared(self, n: int, m: int) -> int:
        """Shingles that sets of n and m must share."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def least(self, n):
        """Size of the smallest set that may link with one of n; also the least they must share."""
        return -(-self.percent * n // 100)

    def among_larger(self, n: int) -> int:
        """Shingles to share with a set at least as large."""
        return self.shared(n, n)

    def occurrences(self, n: int) -> int:
        """k: occurrences that are asked for in the short lists of a set of n, by DivideSkip's rule at lists of SLICE entries."""
        t = self.least(n)
        return max(1, t - int(t / (MU * log2(SLICE) + 1)))


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(entry, occurrences) of entries in at least ``need`` of the ascending ``lists``, by a heap that skips."""
    at = [0] * len(lists)
    heap = [(entries[0], i) for i, entries in enumerate(lists) if entries]
    heapq.heapify(heap)
    while len(heap) >= need:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= need:
            yield top, len(taken)
            for i in taken:
                at[i] += 1
        else:
            # No entry before the one that is now (need - 1 lists further on) can reach the number.
            while heap and len(taken) < need - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
            for i in taken:
                at[i] = bisect_left(lists[i], goal, at[i])
        for i in taken:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def divide_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(entry, occurrences) of entries in at least ``need`` of the ascending ``lists``."""
    lists = sorted((entries for entries in lists if entries), key=len)
    if len(lists) < need:
        return
    long = min(need - 1, int(need / (MU * log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[:len(lists) - long], lists[len(lists) - long:]
    for entry, count in merge_skip(short, need - len(long)):
        for left, entries in zip(range(len(long), 0, -1), reversed(long)):
            if count + left < need:
                break
            i = bisect_left(entries, entry)
            count += i < len(entries) and entries[i] == entry
        if count >= need:
            yield entry, count


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Entries that two ascending arrays without repeats share."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def tree(limits: Limits, sizes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges, one fewer than the members of each component, of the links among ``sets`` (ascending shingles of several texts)."""
    order = sorted(range(len(sets)), key=lambda i: sizes[i])
    lengths = [len(sets[i]) for i in order]
    every, of = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), lengths)
    by = np.argsort(every, kind="stable")  # lists in the order of the sets
    starts, number = runs_of(every[by])
    entries = of[by]
    list_of, edges = np.empty(len(every), np.int64), np.append(0, np.cumsum(lengths))
    list_of[by] = number
    place = np.empty(len(every), np.int64)
    place[by] = np.arange(len(every))
    parent, leaders, out = list(range(len(order))), [], []
    root = np.arange(len(order))

    def join(a: int, b: int) -> None:
        out.append((order[a], order[b]))
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
        root[root == b] = a

    for q in range(len(order)):
        n = sizes[order[q]]
        need = max(1, limits.least(n))
        # The entries of earlier sets of each list: from the list's start to this set's own place.
        begin, size = starts[list_of[edges[q]:edges[q + 1]]], place[edges[q]:edges[q + 1]]
        size = size - begin
        # The first sets of the components so far are tried one by one, then all sets of the others by their lists.
        for x in leaders[:8]:
            if root[x] != root[q] and sizes[order[x]] >= need and common(sets[order[q]], sets[order[x]]) >= limits.shared(n, sizes[order[x]]):
                join(q, x)
        flat = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
        which, entry = np.repeat(np.arange(len(size)), size), entries[flat]
        others = root[entry] != root[q]
        which, entry = which[others], entry[others]
        if len(entry):
            cuts = np.append(0, np.cumsum(np.bincount(which, minlength=len(size)))).tolist()
            entry = entry.tolist()
            for x, shared in divide_skip([entry[a:b] for a, b in zip(cuts, cuts[1:])], need):
                if root[x] != root[q] and shared >= limits.shared(n, sizes[order[x]]):
                    join(q, x)
        if root[q] == q:
            leaders.append(q)
    return out


def recurring(sets: DataFrame, size: int, limits: Limits) -> DataFrame:
    """(class, n, u, shingles): sets that may link with another, ``u`` of whose shingles no other has; the others, rare ones first."""
    docs = in_blocks(sets.select(F.col("class").alias("doc_id"), "text"))
    blocks = max(1, int(docs.agg(F.max("block")).first()[0] or 0) + 1)
    targets = max(12, blocks // 6)

    def send(group: pa.Table) -> pa.Table:
        block = Block(group)
        hashes = np.sort(shingle_sets(block.data, block.places, size)[0])
        starts, _ = runs_of(hashes)
        several = np.diff(np.append(starts, len(hashes))) > 1
        hashes = hashes[starts]
        rows = []
        # Ranges go by the upper bits, so 40 lower ones tell hashes of a range apart; a meeting of two only counts too much.
        for kind, chosen in ((0, hashes[~several]), (1, hashes[several])):
            low = chosen & LOW
            rows += packed(target(chosen, targets), kind, block.number, low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8))
        return rows_table(rows)

    def count(group: pa.Table) -> pa.Table:
        source, (low, high) = gathered(group, "u4", "u1")
        keys = low | high.astype(np.uint64) << np.uint64(32)
        weight = 1 + np.array(group.column("kind").combine_chunks().to_numpy(zero_copy_only=False), np.int64)[source]
        order = np.argsort(keys, kind="stable")
        _, run = runs_of(keys[order])
        total = np.bincount(run, weight[order]).astype(np.int64)
        found = np.empty(len(keys), np.int64)
        found[order] = total[run]
        keep = np.flatnonzero(found > 1)
        blocks = np.array(group.column("block").combine_chunks().to_numpy(zero_copy_only=False), np.int64)[source[keep]]
        by = np.argsort(blocks, kind="stable")
        keep, blocks = keep[by], blocks[by]
        return rows_table(packed(blocks, 2, int(group.column("to")[0].as_py()), low[keep], high[keep], np.minimum(found[keep], (1 << 32) - 1).astype(np.uint32)))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["class", "n", "u", "shingles"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=names)
        block = Block(left)
        hashes, edges = shingle_sets(block.data, block.places, size)
        known, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for to, data in zip(right.column("block").to_pylist(), right.column("data").combine_chunks()):
            low, high, c = unpack(data.as_buffer(), "u4", "u1", "u4")
            known.append(low | high.astype(np.uint64) << np.uint64(32) | np.uint64(to % (1 << 24)) << np.uint64(40))
            counts.append(c)
        known, counts = np.concatenate(known), np.concatenate(counts)
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        mine = hashes & LOW | (target(hashes, targets) % (1 << 24)).astype(np.uint64) << np.uint64(40)
        at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
        frequency = np.where(known[at] == mine, counts[at], 1) if len(known) else np.ones(len(mine), np.int64)
        several = np.append(0, np.cumsum(frequency > 1))[edges]
        n, r = np.diff(edges), np.diff(several)
        rows = np.flatnonzero((r >= limits.least(n)) & (n > 0))
        out = []
        for i in rows.tolist():
            h, f = hashes[edges[i]:edges[i + 1]], frequency[edges[i]:edges[i + 1]]
            h, f = h[f > 1], f[f > 1]
            out.append(h[np.lexsort((h, f))].tobytes())
        return pa.table([pa.array(block.ids[rows]), pa.array(n[rows]), pa.array((n - r)[rows]), pa.array(out, pa.binary())], names=names)

    sent = docs.groupBy("block").applyInArrow(send, PACKED)
    known = materialize(sent.select("kind", "to", "block", "data").groupBy("to").applyInArrow(count, PACKED), "shingle_counts")
    back = known.select("to", "block", "data").groupBy("to")
    return docs.groupBy("block").cogroup(back).applyInArrow(choose, "class bigint, n bigint, u bigint, shingles binary")


def near_groups(live: DataFrame, limits: Limits, meetings: int, part_sets: int) -> DataFrame:
    """Edges (a, b) of links between sets that meet under a minimum hash, and in one part of those that meet there."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [], [], [], []
            for a, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = np.frombuffer(data.as_buffer(), np.uint64)
                if not len(shingles):
                    continue
                for way in range(meetings):
                    key = kernels.mix(shingles + np.uint64(way * 0x9E3779B97F4A7C15 % (1 << 64))).min()
                    for column, value in zip(rows, (a, way, int(key.view(np.int64)), len(shingles))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["class", "way", "key", "r"])

    met = materialize(live.select("class", "shingles").mapInArrow(keys, "class bigint, way int, key bigint, r bigint"), "meetings")
    # The set of the most shared shingles goes to every part: copies that resemble it alone meet it there.
    groups = met.groupBy("way", "key").agg(F.count("*").alias("members"), F.max(F.struct("r", "class"))["class"].alias("hub")).filter("members > 1")
    groups = groups.withColumn("parts", F.ceil(F.col("members") / part_sets))
    part = F.pmod(F.xxhash64("class", "way"), F.col("parts"))
    members = met.join(groups, ["way", "key"]).select("class", "way", "key", part.alias("part"))
    hubs = groups.filter("parts > 1").select(F.col("hub").alias("class"), "way", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    placed = materialize(members.union(hubs).distinct(), "parts")

    def links(group: pa.Table) -> pa.Table:
        a, n = (group.column(c).combine_chunks().to_pylist() for c in ("class", "n"))
        sets = [np.sort(np.frombuffer(d.as_buffer(), np.uint64)) for d in group.column("shingles").combine_chunks()]
        edges = tree(limits, n, sets)
        return pa.table([pa.array([a[i] for i, _ in edges], pa.int64()), pa.array([a[j] for _, j in edges], pa.int64())], names=["a", "b"])

    return placed.join(live.select("class", "n", "shingles"), "class").groupBy("way", "key", "part").applyInArrow(links, "a bigint, b bigint")


def exact_links(live: DataFrame, parts: DataFrame, limits: Limits) -> DataFrame:
    """Edges (a, b) of all links between sets that ``parts`` (node, root) does not join already."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The short lists' entries of each set: as the smaller one of a pair (listed), and as the larger one (asking)."""
        for batch in batches:
            columns = [[] for _ in range(7)]
            for a, root, n, u, big, data in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                shingles = np.frombuffer(data.as_buffer(), np.int64)
                k = limits.occurrences(n)
                asking = max(0, n - limits.least(n) + k - u)
                listed = max(0, n - limits.among_larger(n) + k - u) if len(shingles) >= limits.among_larger(n) else 0
                for is_asking, upto in ((True, asking), (False, listed)):
                    upto = min(upto, len(shingles))
                    columns[0].append(shingles[:upto])
                    for column, value in zip(columns[1:], (is_asking, a, root, n, len(shingles), big)):
                        column.append(np.full(upto, value))
            kinds = np.int64, np.bool_, np.int64, np.int64, np.int64, np.int64, np.int64
            arrays = [pa.array(np.concatenate([np.zeros(0, k), *c]).astype(k)) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["shingle", "asking", "class", "root", "n", "r", "big"])

    rooted = live.join(parts, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"), "n", "u", "shingles")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("sets")).filter(F.col("sets") >= SMALL_PART)
    big = F.coalesce(F.ceil(F.col("sets") / SLICE), F.lit(0)).cast("bigint").alias("big")
    rooted = materialize(rooted.join(sizes, "root", "left").select("class", "root", "n", "u", big, "shingles"), "rooted")
    entries = materialize(rooted.mapInArrow(lists, "shingle bigint, asking boolean, class bigint, root bigint, n bigint, r bigint, big bigint"), "list_entries")
    mixed = entries.groupBy("shingle").agg(F.min("root").alias("first"), F.max("root").alias("last")).filter("first <> last").select("shingle")
    open_lists = materialize(entries.join(mixed, "shingle"), "open_lists")
    # A large part has slices of its own, which its own sets never read; the others share some.  All entries of a set are in
    # slices of one number.
    listed = open_lists.filter("NOT asking")
    longest = listed.filter("big = 0").groupBy("shingle").count().agg(F.max("count")).first()[0] or 0
    slices = F.when(F.col("big") > 0, F.col("big")).otherwise(F.lit(longest // SLICE + 1))
    cut = listed.groupBy("shingle", F.when(F.col("big") > 0, F.col("root")).alias("other"), F.pmod(F.xxhash64("class"), slices).alias("slice")).agg(
        F.collect_list(F.struct("class", "root", "n", "r")).alias("list"))
    asking = open_lists.filter("asking").select("shingle", "class", "root", "n", "r")
    asked = asking.join(cut, "shingle").filter("other IS NULL OR other <> root")
    # Only entries that may link by size: the smaller set is listed, ties go by the class.
    may = F.filter("list", lambda x: (x.root != F.col("root")) & ((x.n < F.col("n")) | ((x.n == F.col("n")) & (x["class"] < F.col("class")))) & (
        F.least("r", x.r) * (100 + limits.percent) >= limits.percent * (x.n + F.col("n"))))
    asked = asked.select("class", "slice", "n", F.transform(may, lambda x: x["class"]).alias("list")).filter(F.size("list") > 0)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = []
        last = None

        def found():
            # Sets of this size and of the smallest partner's share so many short lists at least.
            need = min(limits.occurrences(last[2]), limits.occurrences(limits.least(last[2])))
            return [x for x, _ in merge_skip(held, need)]

        def out(asked: list[int], sets: list[int]):
            return pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(sets, pa.int64())], ["a", "b"])

        for batch in batches:
            a, b = [], []
            for *key, entries in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != last:
                    if held:
                        sets = found()
                        a += [last[0]] * len(sets)
                        b += sets
                    last, held = key, []
                held.append(sorted(entries))
            yield out(a, b)
        if held:
            sets = found()
            yield out([last[0]] * len(sets), sets)

    pairs = materialize(asked.repartition("class", "slice").sortWithinPartitions("class", "slice").mapInArrow(search, "a bigint, b bigint").distinct(), "candidates")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probes the shingles of one set in the sorted shingles of the other."""
        for batch in batches:
            keep = [common(np.sort(np.frombuffer(x.as_buffer(), np.uint64)), np.sort(np.frombuffer(y.as_buffer(), np.uint64))) >= limits.shared(n, m)
                    for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = rooted.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a"))
    two = rooted.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")
    return both.mapInArrow(verify, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, meetings: int = MEETINGS, part_sets: int = PART_SETS) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, component_id) for every row of ``docs``; ``text_key`` is a hash of the whole text.

    Rows link when their sets of distinct ``size``-word shingles (A-Z lower-cased) have a Jaccard similarity of ``percent``
    in a hundred or more; ``class`` is a hash of the set, equal sets are one class.  A text of fewer words is one shingle, its words in order.  NULL and
    empty texts, and texts of blanks, have no shingles, link with nothing and are a component each, named by their own id.
    ``component_id`` is the smallest id that can be reached.  Rows without an id are linked like others and never name a
    component; a component of such rows only has none.  Repeated rows are in one class; an id with several texts is in the
    component of each.  Texts of any length are read whole.  An empty table gives an empty one.  Other columns of ``docs`` are
    ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    prepare(docs.sparkSession)
    limits = Limits(percent)
    rows = classes(docs, size)
    found = materialize(rows.select("doc_id", "text_key", "n", "class"), "classes")
    sets = materialize(rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("text").alias("text")), "sets")
    live = materialize(recurring(sets, size, limits), "live_sets")
    near = materialize(near_groups(live, limits, meetings, part_sets), "near_links")
    joined = materialize(components(near), "near_parts")
    further = materialize(exact_links(live, joined, limits), "further_links")
    parts = materialize(components(near.union(further)), "link_parts")
    known = sets.select("class", "least").join(parts, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"), "least")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(known.select("class", "root").join(named, "root").select(F.col("class").alias("__class"), "component_id"), "set_components")
    out = found.filter("n > 0").join(of, F.col("class") == F.col("__class")).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class", "component_id")
    return out.union(found.filter("n = 0").select("doc_id", "text_key", "n", "class", "doc_id"))


@query("op11_jaccard_join", """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN edge e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op11(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
