"""Substring dedup by repeated-phrase automata, over words.

Recurring anchors (see ``recurrence``) confirm which passages repeat.  Each block of documents compiles the phrases of its
recurring anchors into Aho-Corasick automata over word numbers, a bounded number of phrases in each, and streams all its
documents through them to locate every occurrence, word for word.  The 50-word windows around the occurrences are
compared between documents by fingerprint and smallest id, one entry per block and window, and the words of windows that
an earlier document has are removed.
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

WINDOW, GRAM = 50, 12
# Phrases in one automaton.
SHARD_PHRASES = 20_000


def word_items(block: Block) -> Items:
    starts, ends, doc = kernels.words(block.data, block.places)
    found = Items(block, kernels.word_hashes(block.data, starts, ends), doc, GRAM, WINDOW)
    found.starts, found.ends = starts, ends
    return found


def occurrences(found: Items, places: np.ndarray) -> np.ndarray:
    """Places of every occurrence in the block of the phrases at ``places``, located word for word by automata."""
    import ahocorasick

    data = found.block.data.tobytes()
    numbers: dict[bytes, int] = {}
    words = [numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(found.starts.tolist(), found.ends.tolist())]
    phrases = list({tuple(words[p:p + GRAM]) for p in places.tolist()})
    edges = np.append(0, np.cumsum(np.bincount(found.doc, minlength=len(found.block.ids)))).tolist()
    out = []
    for a in range(0, len(phrases), SHARD_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases[a:a + SHARD_PHRASES]:
            automaton.add_word(phrase)
        automaton.make_automaton()
        for start, stop in zip(edges, edges[1:]):
            if stop - start >= WINDOW:
                out += [start + last - GRAM + 1 for last, _ in automaton.iter(tuple(words[start:stop]))]
    return np.unique(np.array(out, np.int64))


def dedup_phrases(docs: DataFrame, into: str = "phrases") -> DataFrame:
    """(doc_id, text, into): the words left, joined by one space, and counts (n_words, n_removed).

    A word goes if some window of 50 consecutive words over it also starts in a document with a smaller id.  Windows are
    those of the input.  NULL and empty texts have no words; texts of fewer than 50 words lose none.  Rows of one id never
    judge each other, but are judged alike; rows without an id neither lose words nor judge.  An empty table gives an
    empty one.  Other columns of ``docs`` are ignored.
    """
    prepare(docs.sparkSession)
    work = Recurrence(docs, word_items)
    targets = work.targets

    def candidates(block: Block, sent: list[bytes]) -> pa.Table:
        found = word_items(block)
        places = found.places[recurring_places(found, sent)]
        if not len(places):
            return rows_table([])
        at = occurrences(found, places)
        near = kernels.union_of_runs(np.maximum(at - (WINDOW - GRAM), 0), WINDOW - GRAM + 1, len(found.hashes))
        near = np.flatnonzero(near & (np.arange(len(near)) + WINDOW <= found.end) & block.has_id[found.doc])
        hashes, doc = kernels.windows(found.hashes, WINDOW)[near], block.ids[found.doc[near]]
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        starts, _ = runs_of(hashes)
        several = doc[starts] != doc[np.append(starts[1:], len(doc)) - 1]
        hashes, doc = hashes[starts], doc[starts]
        return rows_table(packed(target(hashes, targets), 0, block.number, hashes, doc, several.astype(np.uint8)))

    def first_documents(group: pa.Table) -> pa.Table:
        source, (hashes, doc, several) = gathered(group, "u8", "i8", "u1")
        order = np.lexsort((doc, hashes))
        starts, run = runs_of(hashes[order])
        first = np.empty(len(hashes), np.int64)
        first[order] = doc[order][starts][run]
        keep = np.flatnonzero((first < doc) | (several > 0))
        blocks = ints(group.column("block"))[source[keep]]
        by = np.argsort(blocks, kind="stable")
        return rows_table(packed(blocks[by], 1, 0, hashes[keep][by], first[keep][by]))

    def rewrite(block: Block, sent: list[bytes]) -> pa.Table:
        found = word_items(block)
        n = len(found.hashes)
        lost = np.zeros(n, bool)
        if sent:
            rows = [unpack(d, "u8", "i8") for d in sent]
            known, first = (np.concatenate(c) for c in zip(*rows))
            order = np.argsort(known)
            known, first = known[order], first[order]
            hashes = kernels.windows(found.hashes, WINDOW)
            whole = (np.arange(len(hashes)) + WINDOW <= found.end[:len(hashes)]) & block.has_id[found.doc[:len(hashes)]]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = whole & (known[at] == hashes) & (first[at] < block.ids[found.doc[:len(hashes)]])
            lost = kernels.union_of_runs(np.flatnonzero(hit), WINDOW, n)
        data, edges = block.data.tobytes(), np.append(0, np.cumsum(np.bincount(found.doc, minlength=len(block.ids))))
        removed = np.append(0, np.cumsum(lost))[edges]
        texts = []
        for a, b in zip(edges, edges[1:]):
            keep = np.flatnonzero(~lost[a:b]) + a
            texts.append(b" ".join([data[s:e] for s, e in zip(found.starts[keep].tolist(), found.ends[keep].tolist())]).decode())
        return pa.table([pa.array(block.ids, mask=~block.has_id), pa.array(np.diff(edges)), pa.array(np.diff(removed)), pa.array(texts, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "text"])

    sent = work.with_blocks(work.recurring, candidates, PACKED)
    firsts = materialize(grouped(sent, 0).applyInArrow(first_documents, PACKED), "first_documents")
    out = work.with_blocks(firsts, rewrite, "doc_id bigint, n_words bigint, n_removed bigint, text string")
    return out.select("doc_id", "text", F.struct("n_words", "n_removed").alias(into))


@query("op9_substring_dedup", """
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
lost AS (SELECT DISTINCT doc_id, i + d AS i FROM (SELECT windows.doc_id, i FROM windows JOIN firsts USING (k) WHERE least < doc_id), range(0, 50) t(d)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT words.doc_id, count(lost.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (lost.i IS NULL) AS text
         FROM words LEFT JOIN lost ON lost.doc_id = words.doc_id AND lost.i = words.i GROUP BY words.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""")
def op9(spark, sf_dir):
    out = dedup_phrases(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "phrases.n_words", "phrases.n_removed", F.sha2("text", 256).alias("kept_sha256"))
