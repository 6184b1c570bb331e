"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialwright.llm import periodic
from trialwright.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def plain_runs(words, min_length=6, exponent=4):
    """(start, length, period): for each period all longest stretches, kept where the period is the smallest."""
    found = {}
    a = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    for p in range(1, len(words) // exponent + 1):
        equal = np.concatenate([[0], (a[:-p] == a[p:]).astype(int), [0]])
        change = np.diff(equal)
        for s, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if e + p - s >= max(min_length, exponent * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def planted(text, i):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    return words


def plain(text, i):
    words = planted(text, i)
    found = plain_runs(words)
    lost = {j for s, n, p in found for j in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, found and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{n},{p}\n" for s, n, p in found)),
            digest(" ".join(w for j, w in enumerate(words) if j not in lost)))


def found_by(texts, **how):
    edges = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    got = periodic.runs(np.array([x for t in texts for x in t], np.uint64), edges, **how)
    return [[(int(s - a), int(e - s), int(p)) for s, e, p in got if a <= s < b] for a, b in zip(edges, edges[1:])]


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_few_words(texts):
    assert found_by(texts) == [plain_runs(t) for t in texts]


@given(st.lists(st.lists(st.integers(0, 1), max_size=40), max_size=4), st.integers(3, 5), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_other_limits(texts, exponent, least):
    assert found_by(texts, min_length=least, exponent=exponent) == [plain_runs(t, least, exponent) for t in texts]


def test_nested_and_long_runs():
    draw = random.Random(3)
    unit = [1] * 8 + [2, 3] * 5 + [draw.randrange(50) for _ in range(70)]
    texts = [unit * 9 + [1, 1], [7] * 5000, [1, 2, 3] * 1500 + [9] + [1, 2, 3] * 1500, [draw.randrange(9) for _ in range(3000)], unit * 4, []]
    assert found_by(texts) == [plain_runs(t) for t in texts]


def test_agreement_both_ways():
    draw = np.random.default_rng(1)
    s = np.concatenate([[90], np.tile([1, 1, 1, 2, 1, 1, 2], 60), draw.integers(0, 3, 300), [91]]).astype(np.int64)
    levels = periodic.grammar(s)
    i, j = (draw.integers(1, len(s) - 1, 2000) for _ in range(2))
    i, j = i[i != j], j[i != j]
    on = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
    back = [next(k for k in range(len(s)) if s[a - k] != s[b - k]) for a, b in zip(i, j)]
    assert periodic.agree(levels, i, j, True).tolist() == on
    assert periodic.agree(levels, i, j, False).tolist() == back
    # The grammar is no larger than a few times the text, and its top has no symbol twice.
    assert sum(len(x.symbol) for x in levels) < 8 * len(s) and len(np.unique(levels[-1].symbol)) == len(levels[-1].symbol)


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == plain(text, i)
    assert sum(r.n_runs > 0 for r in got.values()) > 50


def test_operator(spark, docs, texts, strange):
    got = {r.doc_id: r for r in periodic.collapse_runs(docs).collect()}
    for i, text in texts.items():
        words = WORD.findall(text or "")
        found = plain_runs(words) if len(words) < 20_000 else []
        assert [tuple(x) for x in got[i].runs] == found
        lost = {j for s, n, p in found for j in range(s + p, s + n)}
        assert got[i].text == " ".join(w for j, w in enumerate(words) if j not in lost)
    assert got[52].text == "ab"
    rows = periodic.collapse_runs(strange, into="a").collect()
    assert len(rows) == strange.count() and all(r.a == [] for r in rows)
    assert sum(r.doc_id is None for r in rows) == 3
    assert sorted(r.doc_id or 0 for r in periodic.with_repeats(strange).collect()) == sorted(r.doc_id or 0 for r in strange.collect())
    assert periodic.collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.collapse_runs(docs, exponent=2)
