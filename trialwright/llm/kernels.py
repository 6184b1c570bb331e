"""Words, fingerprints and sliding minima of many texts at once, as numpy arrays inside a task."""

from __future__ import annotations

import sys
import types

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RANDOM.integers(1 << 62, 1 << 63)) * 2 % (1 << 64) | 5
INVERSE = pow(BASE, -1, 1 << 64)

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
WORD_VALUES = np.where(IS_BLANK, np.uint64(0), BYTE_VALUES)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the longest so far is kept while the worker lives."""
    kept = worker_cache("powers")
    if base not in kept or len(kept[base]) < n:
        out = np.full(max(1024, n), base, np.uint64)
        out[0] = 1
        kept[base] = np.multiply.accumulate(out)
    return kept[base][:n]


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    home = sys.modules.setdefault("_trialwright_llm_cache", types.ModuleType("_trialwright_llm_cache"))
    return home.__dict__.setdefault(name, {})


def words(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the document (its number) that holds it.  Words never cross documents."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    blank = IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(places, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each word's bytes, blanks left out."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    follow = np.append(starts[1:], len(data))
    place[starts[0]:] -= np.repeat(starts, follow - starts)
    weights = powers(int((ends - starts).max()) + 1)
    values = WORD_VALUES[data]
    values *= weights[np.minimum(place, len(weights) - 1)]
    return mix(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of ``size`` values (values are mixed already, or come from BYTE_VALUES)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(len(values)), out=total[1:])
    out = total[size:] - total[:-size]
    out *= powers(n, INVERSE)
    return mix(out)


def slide(values: np.ndarray, size: int, best=np.minimum) -> np.ndarray:
    """best of values[i : i + size] for every i, by doubling."""
    out, have = values, 1
    while have < size and len(out):
        step = min(have, size - have)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def anchors(grams: np.ndarray, inside: np.ndarray, span: int) -> np.ndarray:
    """Places of grams that are the least of some ``span`` consecutive grams of one document.

    ``inside[i]`` says that gram i lies in one document and the ``span`` grams from i on lie in that document too.
    The choice depends on those grams only, so equal stretches of text choose equal places; ties are all chosen.
    """
    if len(grams) < span:
        return np.zeros(0, np.int64)
    least = slide(grams, span)
    least = np.where(inside[:len(least)], least, np.uint64(0))
    wide = np.zeros(len(grams) + span - 1, np.uint64)
    wide[span - 1:span - 1 + len(least)] = least
    highest = slide(wide, span, np.maximum)
    return np.flatnonzero((highest == grams) & (highest > 0))


def union_of_runs(places: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask over n items of those in [p, p + size) for some p."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + size, n), -1)
    return np.cumsum(change[:-1]) > 0
