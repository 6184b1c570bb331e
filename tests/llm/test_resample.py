"""Importance resampling against plain sums."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from trialwright.llm import resample
from trialwright.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"


def plain_features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    both = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in both]


def plain(docs, target):
    """{doc_id: (n_features, weight, score, rank)} of distinct ids."""
    parts = {i: plain_features(t) for i, t in docs.items()}
    s, t = [0] * 10000, [0] * 10000
    for _, found in parts.values():
        for b in found:
            s[b] += 1
    for text in target:
        for b in plain_features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    out = {}
    for i, (n, found) in parts.items():
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    may = sorted((i for i in parts if parts[i][0] >= 20), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(may[:25 * len(may) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def test_against_plain_sums(spark, docs, texts):
    target = [texts[12], "Punctuated, TEXT-with 42 numbers; ünïcödé", None, ""]
    got = resample.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), range_rows=5)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got.collect()} == plain(texts, target)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in QUERIES["op13_importance_resampling"](spark, SF).collect()}
    assert got == plain(docs, target)


def test_features_of_long_words_and_borders():
    texts = ["a" * 100 + " b", "", "b", "B--" + "é" * 60, "x" * 39, "x" * 40, "x" * 41 + "!y"]
    data = [t.encode() for t in texts]
    places = np.append(0, np.cumsum([len(d) for d in data]))
    bucket, doc, words = resample.features(np.frombuffer(b"".join(data), np.uint8), places, 10000)
    for i, text in enumerate(texts):
        n, found = plain_features(text)
        assert words[i] == n and sorted(bucket[doc == i]) == sorted(found)


def test_planes_give_exact_sums():
    draw = np.random.default_rng(0)
    gain = draw.integers(-20_000, 20_000, 777)
    gain[:3] = 0, -1, 1
    counts = draw.integers(0, 40, (9, 777)) * draw.integers(0, 2, (9, 777))
    counts[0], counts[1, 0], counts[2, 5] = 0, 1, 100_000
    assert (resample.weigh(counts, resample.gain_planes(gain)) == counts @ gain).all()


def test_odd_rows(spark, strange):
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    got = resample.resample(strange, target, percent=50, range_rows=2).collect()
    assert len(got) == strange.count()
    without = [r for r in got if r.doc_id is None]
    assert len(without) == 3 and all(r.score is None and r["rank"] is None for r in without)
    # Two equal rows have at least 20 words; one of them is drawn.
    assert [r["rank"] for r in got if r.doc_id == 5 and r.n_words >= 20 and r["rank"]] == [1]
    assert len({(r.weight, r.score) for r in got if r.doc_id == 5 and r.n_words >= 20}) == 1
    kept = resample.drawn_documents(strange, target, percent=50, range_rows=2)
    assert kept.columns == strange.columns and {r.doc_id for r in kept.collect()} == {5}
    with pytest.raises(ValueError):
        resample.resample(strange, target, percent=101)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert resample.resample(none, docs).collect() == []
    got = resample.resample(docs, none.select("text")).collect()
    assert len(got) == docs.count() and all(r.n_features or r.weight == 0 for r in got)
