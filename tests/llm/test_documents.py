"""Every document operator against a plain version of itself, and on rows that are odd or missing."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from trialwright.llm import decontaminate, lines, packing, phrases, pii, quality, simhash, store, suffixes, toxicity
from trialwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def covered(items, width, doc, first):
    """Which of ``items`` stand in a window of ``width`` that also starts in an earlier document."""
    out = [False] * len(items)
    for j in range(len(items) - width + 1):
        if first[tuple(items[j:j + width])] < doc:
            out[j:j + width] = [True] * width
    return out


def first_documents(parts, width):
    first = {}
    for i, items in parts.items():
        for j in range(len(items) - width + 1):
            k = tuple(items[j:j + width])
            first[k] = min(first.get(k, i), i)
    return first


def test_token_store(spark, docs, texts):
    encode = Tokenizer.from_file(WORD_BPE).encode
    kept = store.write_store(docs, WORD_BPE, task_bytes=5000, shard_ids=500, part_keys=10)
    got = {r.doc_id: r for r in kept.digests(docs.select("doc_id")).collect()}
    start = 0
    for i in sorted(texts):
        ids = np.array(encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [list(x) for x in kept.ids(4)] == [encode(texts[4], add_special_tokens=False).ids + [1]]
    assert kept.ids(999) == []


def well_packed(rows, capacity):
    found = collections.defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


def test_packing(docs, texts):
    encode = Tokenizer.from_file(BYTE_BPE).encode
    rows = packing.pack(docs, BYTE_BPE, 256).collect()
    n = well_packed(rows, 256)
    assert n <= 1.1 * sum(r.length for r in rows) / 256 + 1
    for i, text in texts.items():
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 256)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 256 or len(pieces) == 1)


def test_containment(spark, docs, texts):
    held = " ".join(texts[50].split()[20_000:20_012])
    near = " ".join(held.split()[:11] + ["changed"])
    items = [(1, held), (2, near), (3, None), (4, ""), (5, "one two three"), (6, "absent words of an item stand here"), (7, held)]
    got = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, round(r.containment, 3)) for r in got) == [(4, 5, 1.0), (50, 1, 1.0), (50, 2, 0.875), (50, 7, 1.0)]


def test_toxicity(spark):
    """Trained on two thirds of the labels, it ranks the other third."""
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op4_toxicity"](spark, SF).collect()
    out = [r for r in got if r.held_out and label.get(r.doc_id) is not None]
    yes, no = [r.score for r in out if label[r.doc_id]], [r.score for r in out if not label[r.doc_id]]
    assert np.mean([[(a > b) + (a == b) / 2 for b in no] for a in yes]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_interaction_of_terms():
    """Two terms that are harmless alone and bad together need a product of factors."""
    draw, examples = np.random.default_rng(0), []
    for _ in range(800):
        a, b = draw.integers(0, 2, 2)
        examples.append((int(a == b == 1), np.array([1] * a + [2] * b + [3], np.int64)))
    machine = toxicity.fit(examples, np.array([1, 2, 3]), 4, 60, 1e-4)
    score = lambda *rows: float(machine.logits(np.zeros(len(rows), np.int64), np.array(rows), 1)[0])
    assert score(0, 1, 2) > max(score(0, 2), score(1, 2), score(2))


def test_byte_dedup(docs, texts):
    parts = {i: (t or "").encode() for i, t in texts.items()}
    first = first_documents(parts, 50)
    for r in suffixes.dedup_substrings(docs).collect():
        b = parts[r.doc_id]
        lost = covered(b, 50, r.doc_id, first)
        assert bytes(r.kept) == bytes(x for x, gone in zip(b, lost) if not gone)
        assert len(r.spans) == sum(gone and (j == 0 or not lost[j - 1]) for j, gone in enumerate(lost))


def test_phrase_dedup(docs, texts):
    parts = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = first_documents(parts, 50)
    for r in phrases.dedup_phrases(docs).collect():
        lost = covered(parts[r.doc_id], 50, r.doc_id, first)
        assert (r.phrases.n_words, r.phrases.n_removed) == (len(lost), sum(lost))
        assert r.text == " ".join(x for x, gone in zip(parts[r.doc_id], lost) if not gone)


def print_of(text):
    words = WORD.findall(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, most):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    todo = sorted(root)
    for i, p in enumerate(todo):
        for q in todo[i + 1:]:
            if (p ^ q).bit_count() <= most:
                root[find(p)] = find(q)
    return {p: find(p) for p in todo}


@pytest.mark.parametrize("key_rows", [20_000, 10])
def test_near_duplicates(docs, texts, key_rows):
    prints = {i: print_of(t or "") for i, t in texts.items()}
    root = classes(prints.values(), 4)
    least = {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, 4, 4, key_rows).collect()}
    assert got == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


@pytest.mark.parametrize("more", [0, 1, 5])
@pytest.mark.parametrize("after", [False, True])
def test_a_long_key_is_divided_whole(more, after):
    """The rows of a key that come after its first part has left follow it, so that pairs across the cut meet again."""
    rows = [(0, 0, fp) for fp in range(12 + more)] + ([(0, 1 << 32, 1 << 32), (0, 1 << 32, (1 << 32) + 1)] if after else [])
    batches = [pa.RecordBatch.from_pydict(dict(zip(("choice", "key", "fp"), zip(*rows[i:i + 6])))) for i in range(0, len(rows), 6)]
    got = [r for b in simhash.scan(4, 10)(batches) for r in b.to_pylist()]
    assert sorted(r["a"] for r in got if r["kind"] == simhash.DIVIDE) == list(range(12 + more))
    assert [(r["a"], r["b"]) for r in got if r["kind"] == simhash.LINK] == ([((1 << 32) + 1, 1 << 32)] if after else [])


def test_links_across_the_cut_of_a_long_key(spark):
    """Pairs that meet under one key of 2100 fingerprints only, read in batches: every class of the plain version is one class."""
    fps = [int(x) for x in np.random.default_rng(3).integers(0, 1 << 32, 1050)]
    fps = sorted({*fps, *(f ^ 0x80808080 for f in fps)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {f: f for f in fps}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = simhash.links(df, 4, 300).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    for r in found:
        assert (r.a ^ r.b).bit_count() <= 4
        root[find(r.a)] = find(r.b)
    want = classes(fps, 4)
    assert len({find(f) for f in fps}) == len(set(want.values()))
    assert all(find(f) == find(want[f]) for f in fps)


def test_line_dedup(docs, texts):
    split = {i: (t or "").split("\n") for i, t in texts.items()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, found in split.items():
        for x in found:
            holders[key(x)].add(i)
    bad = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    assert bad
    for r in lines.dedup_lines(docs, into="a").collect():
        kept = [x for x in split[r.doc_id] if bad.get(key(x), r.doc_id) == r.doc_id]
        assert (r.a.n_lines, r.a.n_dropped) == (len(split[r.doc_id]), len(split[r.doc_id]) - len(kept))
        assert (r.text or "") == "\n".join(kept) and (r.text is None) == (texts[r.doc_id] is None)


def test_quality_counts(docs, texts):
    for r in quality.judge_quality(docs).collect():
        text, q = texts[r.doc_id] or "", r.quality
        words = WORD.findall(text)
        windows = [tuple(words[j:j + 5]) for j in range(len(words) - 4)]
        often, marked, seen, dup = collections.Counter(windows), set(), set(), 0
        for j, window in enumerate(windows):
            if often[window] > 1:
                marked.update(range(j, j + 5))
        for x in text.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        assert tuple(q)[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked))
        assert q.base_failed == (len(words) < 10 or 100 * len(marked) > 20 * len(words))
        assert not (q.base_failed and q.kept)


def test_quality_outliers(spark):
    """Of many alike documents the one made of symbols goes, the others stay."""
    rows = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60 + i % 40)), "en", "s") for i in range(600)]
    rows.append((600, " ".join("#$%&|<>*" * 6 for _ in range(60)) + " " + " ".join(f"q{j}" for j in range(400)), "en", "s"))
    lost = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("NOT quality.kept").collect()
    assert [r.doc_id for r in lost] == [600]


def test_pseudonyms(spark):
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", True)
    for text in ("card 4111 1111 1111 1111, 4111111111111111", "born 1980-02-29 or 31/12/1999", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789",
                 "+1 (988) 555-2485", "1.2.3.4", "ann.lee@example.org"):
        assert there(text) != text and back(there(text)) == text
        assert re.sub(r"\d+", "0", there(text)) == re.sub(r"\d+", "0", text) or "@" in text
    for text in ("", "no numbers here", "4111 1111 1111 1112", "31/02/1999x"):
        assert there(text) == text
    docs = spark.createDataFrame([(1, "mail ann.lee@example.org"), (2, "to ann.lee@example.org!"), (3, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, b"key").collect()}
    assert got[1].split()[1] == got[2].split()[1][:-1] and got[1] != "mail ann.lee@example.org"


OPERATORS = {
    "store": lambda d, spark: store.write_store(d, WORD_BPE).digests(d),
    "packing": lambda d, spark: packing.pack(d, BYTE_BPE),
    "containment": lambda d, spark: decontaminate.contained_items(d, spark.createDataFrame([(1, "x"), (None, None)], "item_id long, text string")),
    "suffixes": lambda d, spark: suffixes.dedup_substrings(d),
    "simhash": lambda d, spark: simhash.near_duplicates(d),
    "lines": lambda d, spark: lines.dedup_lines(d),
    "quality": lambda d, spark: quality.judge_quality(d),
    "phrases": lambda d, spark: phrases.dedup_phrases(d),
    "pii": lambda d, spark: pii.pseudonymise(d, b"key"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_no_rows(spark, strange, name):
    rows = OPERATORS[name](strange, spark).collect()
    if name in ("suffixes", "simhash", "lines", "quality", "phrases", "pii", "packing"):
        assert len(rows) == 8
    assert OPERATORS[name](strange.limit(0), spark).collect() == []


def test_toxicity_odd_rows(spark, strange):
    examples = spark.createDataFrame([(i % 2, "bad word" if i % 2 else "good word") for i in range(60)] + [(None, "x"), (1, None)], "label int, text string")
    machine = toxicity.train(examples)
    assert all(0 <= r.score <= 1 for r in toxicity.score_texts(strange, machine).collect())
    assert toxicity.score_texts(strange.limit(0), machine).collect() == []
    toxicity.train(examples.limit(0))
