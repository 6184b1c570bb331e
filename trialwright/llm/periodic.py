"""Periodic runs of words by recompression, and texts with their repeats collapsed.

A batch of texts becomes one sequence of word numbers with a sign of its own between texts.  Recompression turns it into
a run-length grammar: block compression replaces every longest block of one symbol by a symbol for (symbol, count), pair
compression splits the symbols into two halves and replaces every neighbouring pair from the first half and the second.
Both look at neighbouring symbols only, so equal stretches are replaced alike but for their ends, and each pair of steps
shortens the sequence by a constant factor.  The grammar answers "how far do the texts from i and j on agree" by climbing
while whole symbols agree and descending where they part, in a logarithmic number of comparisons, for all questions at once.

A run of period p and at least four periods covers a multiple of 3p whose equal lies p words on within the run.  Those places
of all periods together, a harmonic sum of n / 3p, are the candidates; the grammar's forward and backward answers extend
each to the whole run.  An interval found with several periods keeps the smallest.  Every text is one row's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialwright.llm import kernels
from trialwright.llm.common import chunks, prepare, table, texts, utf8
from trialwright.llm.registry import query

# Candidates whose runs are asked for at once.
ASKED = 1 << 20
RUN = "struct<start: bigint, length: bigint, period: bigint>"


@dataclass
class Level:
    """One sequence of the grammar.  ``first`` has each symbol's first place below and one entry more, ``parent`` its place above."""

    symbol: np.ndarray
    size: np.ndarray
    first: np.ndarray | None = None
    blocks: bool = False
    parent: np.ndarray | None = None


def above(level: Level, starts: np.ndarray, keys: np.ndarray, blocks: bool) -> Level:
    """The next sequence, whose symbols begin at ``starts`` and are equal where ``keys`` are."""
    number = np.unique(keys, return_inverse=True)[1]
    first = np.append(starts, len(level.symbol))
    level.parent = np.repeat(np.arange(len(starts)), np.diff(first))
    return Level(number, np.add.reduceat(level.size, starts), first, blocks)


def grammar(symbols: np.ndarray) -> list[Level]:
    """Sequences from ``symbols`` up to one in which no symbol stands twice."""
    levels = [Level(symbols, np.ones(len(symbols), np.int64))]
    while True:
        level = levels[-1]
        s = level.symbol
        if len(np.unique(s)) == len(s):
            return levels
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) < len(s):
            count = np.diff(np.append(starts, len(s)))
            levels.append(above(level, starts, s[starts] * (int(count.max()) + 1) + count, True))
            level = levels[-1]
            s = level.symbol
        # No neighbours are equal now, so a fixed split of the symbols leaves a quarter of the pairs or more, on average.
        half = (kernels.mix(s.astype(np.uint64) + np.uint64(len(levels) << 40)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(s), bool)
        pair[:-1] = ~half[:-1] & half[1:]
        second = np.append(False, pair[:-1])
        starts = np.flatnonzero(~second)
        if len(starts) == len(s):
            level.parent = np.arange(len(s))
            levels.append(Level(s, level.size, np.arange(len(s) + 1)))  # an unlucky split: the next one differs
            continue
        follow = np.where(pair[starts], s[np.minimum(starts + 1, len(s) - 1)] + 1, 0)
        levels.append(above(level, starts, s[starts] * (int(s.max()) + 2) + follow, False))


def agree(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols from places ``i`` and ``j`` on agree, one by one; backward: up to and with those places.  Nowhere i = j."""
    way = 1 if forward else -1
    i, j, got = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    # Climb: whole symbols that agree are passed, and both go up where both begin a symbol above.
    parted: list[np.ndarray] = []
    here = np.arange(len(i))
    for level, up in zip(levels, [*levels[1:], None]):
        higher, stay = [], []
        while len(here):
            step = np.ones(len(here), np.int64)
            if up is not None:
                a, b = i[here], j[here]
                in_a, in_b = level.parent[a], level.parent[b]
                # What is left of the symbols above, seen from here.
                left_a, left_b = (up.first[in_a + 1] - a, up.first[in_b + 1] - b) if forward else (a + 1 - up.first[in_a], b + 1 - up.first[in_b])
                edge = (left_a == up.first[in_a + 1] - up.first[in_a]) & (left_b == up.first[in_b + 1] - up.first[in_b])
                going = here[edge]
                i[going], j[going] = in_a[edge], in_b[edge]
                higher.append(going)
                here = here[~edge]
                if up.blocks:  # inside blocks all symbols are equal
                    step = np.minimum(left_a, left_b)[~edge]
                else:
                    step = step[~edge]
            equal = level.symbol[i[here]] == level.symbol[j[here]]
            stay.append(here[~equal])
            here, step = here[equal], step[equal]
            got[here] += step * level.size[i[here]]
            i[here] += way * step
            j[here] += way * step
        parted.append(np.concatenate(stay) if stay else here)
        here = np.concatenate(higher) if higher else here
    # Descend: what differs here may still agree in part below.
    here = np.zeros(0, np.int64)
    for h in range(len(levels) - 1, 0, -1):
        level, below = levels[h], levels[h - 1]
        here = np.concatenate([here, parted[h]])
        a, b = i[here], j[here]
        i[here], j[here] = (level.first[a], level.first[b]) if forward else (level.first[a + 1] - 1, level.first[b + 1] - 1)
        if level.blocks:  # two blocks of one symbol share the smaller count
            same = below.symbol[i[here]] == below.symbol[j[here]]
            at = here[same]
            least = np.minimum(level.first[a + 1] - level.first[a], level.first[b + 1] - level.first[b])[same]
            got[at] += least * below.size[i[at]]
            i[at] += way * least
            j[at] += way * least
        on, ended = here, []
        while len(on):
            equal = below.symbol[i[on]] == below.symbol[j[on]]
            ended.append(on[~equal])
            on = on[equal]
            got[on] += below.size[i[on]]
            i[on] += way
            j[on] += way
        here = np.concatenate(ended) if ended else on
    return got


def candidates(s: np.ndarray, longest: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) on the harmonic grid, in portions: places whose equal stands a period on and once more beside them."""
    held, n = [], 0
    for p in range(1, longest // exponent + 1):
        g = np.arange(0, len(s) - p, (exponent - 1) * p)
        g = g[s[g] == s[g + p]]
        if not len(g):
            continue
        # Of four periods, one more begins before this one or after the next.
        g = g[(s[np.maximum(g - p, 0)] == s[g]) | (s[np.minimum(g + 2 * p, len(s) - 1)] == s[g])]
        if len(g):
            held.append((g, np.full(len(g), p)))
            n += len(g)
        if n >= ASKED:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def runs(words: np.ndarray, edges: np.ndarray, min_length: int = 6, exponent: int = 4) -> np.ndarray:
    """Rows (start, end, period), by start and period: maximal stretches of smallest period p and length >= max(min_length, exponent * p).

    ``words`` are numbers of words, ``edges`` the n + 1 places where texts begin and end; no run crosses one.
    """
    n = len(edges) - 1
    longest = int(np.diff(edges).max(initial=0))
    if longest < min_length:
        return np.zeros((0, 3), np.int64)
    number = np.unique(words, return_inverse=True)[1]
    # A sign of its own stands before the first text and after every one.
    doc = np.repeat(np.arange(n), np.diff(edges))
    s = np.empty(len(words) + n + 1, np.int64)
    top = len(words) + 1
    s[0], s[edges[1:] + np.arange(1, n + 1)] = top, top + 1 + np.arange(n)
    at = np.arange(len(words)) + doc + 1
    s[at] = number
    levels, found = None, []
    for g, p in candidates(s, longest, exponent):
        levels = levels or grammar(s)
        end = g + p + agree(levels, g, g + p, True)
        start = g - agree(levels, g - 1, g + p - 1, False)  # the sign at place 0 is no candidate
        keep = end - start >= np.maximum(min_length, exponent * p)
        found.append(np.unique(np.stack([start, end, p], axis=1)[keep], axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    found = np.unique(np.concatenate(found), axis=0)  # in order of start, end, period
    smallest = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[:len(found)]
    found = found[smallest]
    shift = np.searchsorted(edges + np.arange(n + 1), found[:, 0], "left")  # the signs before the run
    found[:, :2] -= shift[:, None]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse_runs(docs: DataFrame, into: str = "runs", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, text, into): the words left, joined by one space, and every periodic run as (start, length, period), by start and period.

    A run is a stretch of words of smallest period p and at least ``max(min_length, exponent * p)`` words that no
    neighbouring word extends.  Words that some run holds after its first period go.  Words are counted from 0.  NULL and
    empty texts, and texts of blanks, have no runs and an empty text.  Texts of any length are read whole, each in one
    task, whose memory grows in proportion to the longest.  Rows are judged one by one: ids may be NULL or repeated, equal rows
    get equal results, hot groups do not matter.  An empty table gives an empty one.  Other columns of ``docs`` are ignored.
    """
    if exponent < 3:
        raise ValueError("exponent must be at least 3")
    prepare(docs.sparkSession)
    schema = f"doc_id bigint, text string, `{into}` array<{RUN}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, bounds = utf8(batch.column(1))
            for a, b in chunks(bounds):
                data, places = every[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
                starts, ends, doc = kernels.words(data, places)
                edges = np.append(0, np.cumsum(np.bincount(doc, minlength=b - a)))
                found = runs(kernels.word_hashes(data, starts, ends), edges, min_length, exponent)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 1], -1)
                left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                raw = data.tobytes()
                pieces = [raw[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist())]
                cut = np.searchsorted(left, edges).tolist()
                kept = [b" ".join(pieces[x:y]).decode() for x, y in zip(cut, cut[1:])]
                of = np.searchsorted(edges, found[:, 0], "right") - 1
                offsets = np.searchsorted(of, np.arange(b - a + 1))
                struct = pa.StructArray.from_arrays([pa.array(found[:, 0] - edges[of]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])],
                                                    ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(kept, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)],
                                                 ["doc_id", "text", into])

    return texts(docs).mapInArrow(run, schema)


def repeat_words(words: list, doc_id: int) -> list:
    """The words of a planted document: from place a on, the first p of them over and over."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with runs planted in the tenth of documents that the CRC of the id picks; rows without an id stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is not None and zlib.crc32(str(i).encode()) % 10 == 0:
                    text = b" ".join(repeat_words(text.encode().split(), i)).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id bigint, text string")


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    out = collapse_runs(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.reduce("runs", F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r.length > best.length), r).otherwise(best))
    out = out.withColumn("best", longest)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
                      F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
                      F.sha2("text", 256).alias("collapsed_sha256"))
