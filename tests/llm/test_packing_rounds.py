"""A gap takes several pieces in one round, in a sweep and across ranges; no place is given twice."""

import random

import pytest

from trialwright.llm import packing
from trialwright.llm.common import materialize


@pytest.mark.parametrize("sweep_rows", [60, 500_000])
def test_rounds(spark, sweep_rows, monkeypatch):
    draw = random.Random(6)
    lengths = {key: draw.choice([draw.randrange(1, 40), draw.randrange(1, 40), draw.randrange(1, 257)]) for key in range(600)}
    rounds, match = [], packing.match
    monkeypatch.setattr(packing, "SWEEP_ROWS", sweep_rows)
    monkeypatch.setattr(packing, "match", lambda *a: rounds.append(1) or match(*a))
    rows = materialize(packing.place(spark.createDataFrame(list(lengths.items()), "key long, length int"), 256), "placed").collect()
    assert sorted(r.key for r in rows) == sorted(lengths)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, lengths[r.key]))
    for pieces in sequences.values():
        pieces.sort()
        assert [at for at, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 256
    need = -(-sum(lengths.values()) // 256)
    assert len(sequences) <= need + max(3, need // 20)
    assert len(rounds) <= 8


def test_across():
    # Five waiting pieces of at most 30 and gaps of at least 70: two to a gap, the last gap one; the nearer range goes first.
    assert packing.across([(2, 5, 0, 30, None), (0, 0, 4, None, 100), (1, 0, 2, None, 70)]) == [(2, 0, 1, 0, 4, 2), (2, 4, 0, 0, 1, 3)]
    assert packing.across([(0, 3, 1, 50, 20), (1, 2, 0, 9, None)]) == [(1, 0, 0, 0, 2, 2)]


def test_what_is_left_of_a_gap_goes_on():
    # Pieces of 40 leave 20 of each gap; those of 20 take them, after the gap that is left of 60 and before the untouched one.
    left = [(0, 0, 2, None, 60), (1, 1, 0, 40, None), (2, 4, 0, 20, None)]
    assert packing.across(left) == [(1, 0, 0, 0, 1, 1), (2, 0, 0, 0, 1, 1), (2, 1, 0, 1, 3, 3)]


def test_as_few_rounds_with_many_ranges(spark, monkeypatch):
    draw = random.Random(3)
    lengths = {key: draw.choice([17, draw.randrange(1, 20), draw.randrange(1, 60)]) for key in range(2000)}
    rounds, match = [], packing.match
    monkeypatch.setattr(packing, "SWEEP_ROWS", 40)
    monkeypatch.setattr(packing, "RANKS", 8)
    monkeypatch.setattr(packing, "match", lambda *a: rounds.append(1) or match(*a))
    rows = materialize(packing.place(spark.createDataFrame(list(lengths.items()), "key long, length int"), 256), "placed").collect()
    assert sorted(r.key for r in rows) == sorted(lengths)
    ends = {}
    for sequence, offset, key in sorted((r.sequence_id, r.offset, r.key) for r in rows):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + lengths[key]
    assert max(ends.values()) <= 256 and len(ends) <= -(-sum(lengths.values()) // 256) + 2
    assert len(rounds) <= 3
