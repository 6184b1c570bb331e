"""Anchors fill the ranges of hash alike, and buckets of samples are sorted in parts that keep a hash together."""

import numpy as np
import pyarrow as pa
import pytest

from trialwright.llm import suffixes
from trialwright.llm.recurrence import Block, target


@pytest.fixture
def block():
    draw = np.random.default_rng(3)
    texts = ["".join(map(chr, draw.integers(97, 123, 40_000))) for _ in range(3)]
    return Block(pa.table({"block": [0] * 3, "doc_id": [1, 2, 3], "text": texts}))


def test_ranges_are_alike(block):
    found = suffixes.byte_items(block)
    counts = np.bincount(target(np.sort(found.anchors), 40), minlength=40)
    assert counts.max() < 1.5 * counts.mean() and counts.min() > 0.5 * counts.mean()


@pytest.mark.parametrize("most", [1, 7, 100])
def test_parts_keep_a_hash_together(most):
    draw = np.random.default_rng(4)
    hashes = draw.integers(0, 60, 400).astype(np.uint64)
    parts = suffixes.parts_of(hashes, most)
    assert sorted(np.concatenate(parts).tolist()) == list(range(400))
    sets = [set(hashes[p].tolist()) for p in parts]
    assert sum(map(len, sets)) == len(set(hashes.tolist()))
    assert all(len(p) < most + np.bincount(hashes.astype(int)).max() for p in parts)
    assert suffixes.parts_of(hashes[:0], most) == []
