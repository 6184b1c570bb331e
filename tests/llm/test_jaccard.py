"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialwright.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def plain(texts, percent=80, size=5):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return {i: (len(sets[i]), root) for i, root in least_reachable(list(texts), links).items()}


def copies(n, words, edits, seed, base):
    """``n`` texts that each change some of ``words`` words of one text."""
    draw = random.Random(seed)
    text = [f"{base}{draw.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(text)
        for _ in range(draw.randrange(edits + 1)):
            t[draw.randrange(words)] = f"new{draw.randrange(10_000)}"
        out.append(" ".join(t[draw.randrange(3):]))
    return out


@pytest.fixture(scope="module")
def many(texts):
    out = dict(texts)
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    more = copies(60, 150, 4, 1, "a") + copies(25, 40, 2, 2, "b") + copies(12, 9, 1, 3, "c")
    more += [passage + " " + " ".join(f"q{draw.randrange(99)}" for _ in range(draw.randrange(30))) for _ in range(40)]
    more += ["one two", "One TWO", "one two three four", "one two three four five", "two one"]
    draw.shuffle(more)
    out.update(enumerate(more, 100))
    return out


def table_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, class string").repartition(4)


@pytest.mark.parametrize("meetings, part_sets", [(3, 100), (1, 2)])
def test_against_all_pairs(spark, many, meetings, part_sets):
    got = jaccard.jaccard_components(table_of(spark, many), meetings=meetings, part_sets=part_sets).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(many)
    assert len(got) == len(many)


def test_exact_search_alone(spark, many, monkeypatch):
    """Without any meeting the inverted lists find every link themselves."""
    monkeypatch.setattr(jaccard, "near_groups", lambda live, limits, meetings, part_sets: live.sparkSession.createDataFrame([], "a long, b long"))
    got = jaccard.jaccard_components(table_of(spark, many), percent=60, size=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(many, 60, 3)


lists = st.lists(st.lists(st.integers(0, 12), unique=True, max_size=10).map(sorted), max_size=9)


@given(lists, st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_occurrences(found, need):
    counts = {}
    for entries in found:
        for x in entries:
            counts[x] = counts.get(x, 0) + 1
    expected = {x: c for x, c in counts.items() if c >= need}
    assert dict(jaccard.merge_skip([list(x) for x in found], need)) == expected
    assert dict(jaccard.divide_skip(found, need)) == expected


@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=14), st.integers(40, 100))
@settings(max_examples=200, deadline=None)
def test_tree_of_a_part(sets, percent):
    limits = jaccard.Limits(percent)
    edges = jaccard.tree(limits, [len(s) for s in sets], [np.array(sorted(s), np.uint64) for s in sets])
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert all((max(e), min(e)) in links for e in edges)
    ids = list(range(len(sets)))
    reach = least_reachable(ids, links)
    assert least_reachable(ids, edges) == reach and len(edges) == len(ids) - len(set(reach.values()))


def test_odd_rows(spark, strange):
    got = jaccard.jaccard_components(strange).collect()
    assert len(got) == strange.count()
    by = [(r.doc_id, r.n_shingles, r.component_id) for r in got]
    assert by.count((5, 76, 5)) == 2 and by.count((None, 76, 5)) == 2 and (None, 0, None) in by
    assert (5, 1, 5) in by and (-3, 0, -3) in by and (7, 0, 7) in by


def test_rows_without_ids_alone(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = jaccard.jaccard_components(rows).collect()
    assert [r.component_id for r in got] == [None] * 3 and sorted(r.n_shingles for r in got) == [0, 2, 2]


def test_empty_table(docs):
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        jaccard.jaccard_components(docs, percent=0)
