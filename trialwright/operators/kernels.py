"""Arrow-batch helpers of the booster: routing rows through trees and adding up histograms.

They run inside ``mapInArrow`` as the map-side combine; Spark partitions the rows, shuffles the partial
histograms and finds the splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

MISSING_BIN = 0
GRADIENT_UNIT = 2**20
DENSE_CELLS = 2_000_000
# Bytes of a block of packed rows, rows that are worked on at once, and splits up to which a tree is a table of their answers.
BLOCK_BYTES = 8192
CHUNK_ROWS = 16_384
FEW_SPLITS = 12
NO_FOLD = -(1 << 31)


@dataclass
class Tree:
    """Node arrays; ``feature`` is -1 at a leaf and ``value`` is already scaled by the learning rate."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    arrays: tuple | None = field(default=None, compare=False, repr=False)
    ends: np.ndarray | None = field(default=None, compare=False, repr=False)

    def split(self, node: int, feature: int, bin_: int, missing_left: bool, left: float, right: float) -> tuple[int, int]:
        a, b, self.arrays = len(self.feature), len(self.feature) + 1, None
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin_, missing_left
        self.left[node], self.right[node] = a, b
        for value in (left, right):
            self.feature.append(-1)
            self.bin.append(0)
            self.missing_left.append(False)
            self.left.append(0)
            self.right.append(0)
            self.value.append(value)
        return a, b

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Node each row of ``bins`` ends in."""
        if self.arrays is None:  # once per task, not once per batch
            self.arrays = tuple(np.asarray(v) for v in (self.feature, self.bin, self.missing_left, self.left, self.right))
            self.ends = self._ends()
        feature, cut, missing, left, right = self.arrays
        if self.ends is not None:
            splits = np.flatnonzero(feature >= 0).tolist()
            code = np.zeros(len(bins), dtype=np.uint8 if len(splits) <= 8 else np.uint16)
            for bit, i in enumerate(splits):
                b = bins[:, feature[i]]
                stays = b <= cut[i]
                if not missing[i]:  # the missing bin is the lowest, so it is left of every cut
                    stays &= b != MISSING_BIN
                code |= stays.astype(code.dtype) << code.dtype.type(bit)
            return self.ends[code]
        node = np.zeros(len(bins), dtype=np.int64)
        moving = np.arange(len(bins)) if feature[0] >= 0 else np.empty(0, dtype=np.int64)
        while len(moving):
            at = node[moving]
            b = bins[moving, feature[at]]
            node[moving] = np.where(np.where(b == MISSING_BIN, missing[at], b <= cut[at]), left[at], right[at])
            moving = moving[feature[node[moving]] >= 0]
        return node

    def _ends(self) -> np.ndarray | None:
        """Node for every combination of answers (one bit a split, set: left); None where there are too many."""
        splits = [i for i, f in enumerate(self.feature) if f >= 0]
        if len(splits) > FEW_SPLITS:
            return None
        codes, node = np.arange(1 << len(splits)), np.zeros(1 << len(splits), np.int64)
        for bit, i in enumerate(splits):  # parents stand before their children
            node = np.where(node == i, np.where(codes >> bit & 1, self.left[i], self.right[i]), node)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.route(bins)]


@dataclass
class Fit:
    """One (trial, held-out fold): its settings, finished rounds and growing trees (one per output)."""

    trial: int
    held_out: int
    base: list[float]
    subsample: float
    rounds: list[list[Tree]] = field(default_factory=list)
    growing: list[Tree] = field(default_factory=list)
    features: list[int] = field(default_factory=list)
    active: list[dict[int, int]] = field(default_factory=list)

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None, skip: int = 0) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds[skip:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.predict(bins)
        return out


def mix(rows: np.ndarray, salt: int) -> np.ndarray:
    """Uniform [0, 1) from 64-bit row keys and a salt (the splitmix64 finaliser)."""
    z = rows.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(2**53)


def gradients(margins: np.ndarray, label: np.ndarray, classes: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives as whole multiples of 1/unit, so sums are exact in any order."""
    if not classes:
        return np.rint((margins - label[:, None]) * unit), np.ones_like(margins)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    hit = label[:, None] == np.arange(classes)[None, :]
    return np.rint((p - hit) * unit), np.rint(np.maximum(p * (1 - p), 1e-6) * unit)


def pack(rows: np.ndarray, fold: np.ndarray, label: np.ndarray, bins: np.ndarray, margins: np.ndarray | None = None) -> pa.RecordBatch:
    """Blocks of rows, each column of a block one binary value: what a task reads at every tree level then costs no work per row."""
    n = len(rows)
    columns = {"row_key": rows.astype(np.int64), "fold": fold.astype(np.int32), "label": label.astype(np.float64), "bins": bins.astype(np.int16)}
    if margins is not None:
        columns["margins"] = margins.reshape(n, -1)
    columns = {k: np.ascontiguousarray(v) for k, v in columns.items()}
    size = max(1, BLOCK_BYTES * n // max(1, sum(v.nbytes for v in columns.values())))
    ends = np.append(np.arange(0, n, size), n)
    out = {k: pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * (v.nbytes // n)).astype(np.int32)), pa.py_buffer(v)])
           for k, v in columns.items()}
    return pa.RecordBatch.from_pydict(out)


def _values(column: pa.Array, dtype: type) -> np.ndarray:
    """The binary values of a column one after another; they lie so in its buffer."""
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, dtype, (int(places[-1]) - int(places[0])) // np.dtype(dtype).itemsize, int(places[0]))


def chunks(batches: Iterator[pa.RecordBatch], width: int, fits: int = 0):
    """(row_key, fold, label, bins, margins or None) of at most ``CHUNK_ROWS`` packed rows; ``bins`` lies column by column."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows, fold, label = (_values(batch.column(n), t) for n, t in (("row_key", np.int64), ("fold", np.int32), ("label", np.float64)))
        n = len(rows)
        bins = _values(batch.column("bins"), np.int16).reshape(n, width)
        margins = _values(batch.column("margins"), np.float64).reshape(n, fits, -1) if "margins" in batch.schema.names else None
        for a in range(0, n, CHUNK_ROWS):
            at = slice(a, a + CHUNK_ROWS)
            yield rows[at], fold[at], label[at], np.asfortranarray(bins[at]), None if margins is None else margins[at]


def _numbers(column: pa.Array, missing: float) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batch iterator function: blocks of single rows (row_key, fold, label, bins)."""
    for batch in batches:
        if batch.num_rows:
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pack(batch.column("row_key").to_numpy(zero_copy_only=False), _numbers(batch.column("fold"), NO_FOLD),
                       _numbers(batch.column("label"), np.nan), bins)


def single_rows(width: int):
    """Batch iterator function: the rows (row_key, fold, label, bins) of packed ones."""

    def run(batches):
        for rows, fold, label, bins, _ in chunks(batches, width):
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(fold, mask=fold == NO_FOLD), pa.array(label, from_pandas=True),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(bins.ravel()))], names=["row_key", "fold", "label", "bins"])

    return run


def open_cells(fits: list[Fit], width: int) -> int:
    """Histogram cells a task would hold for all open nodes."""
    return sum(len(a) * len(f.features) * width for f in fits for a in f.active)


def histogram_rows(fits: list[Fit], features: int, width: int, unit: float, classes: int, skip: int, salt: int):
    """Batch iterator function: partial (tree, node, feature, bin, g, h) sums over the rows of a task."""
    outputs = max(classes, 1)

    def emit(sums):
        for (tree, slots, used), (g, h) in sums.items():
            at = np.nonzero(h)[0]
            slot, rest = at // (len(used) * width), at % (len(used) * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), tree, dtype=np.int32)),
                 pa.array(np.asarray(slots, dtype=np.int32)[slot]),
                 pa.array(np.asarray(used, dtype=np.int32)[rest // width]),
                 pa.array((rest % width).astype(np.int32)),
                 pa.array(g[at].astype(np.int64)), pa.array(h[at].astype(np.int64))],
                names=["tree", "node", "feature", "bin", "g", "h"])

    hold = open_cells(fits, width) <= DENSE_CELLS

    def run(batches):
        sums: dict = {}
        for rows, fold, label, bins, start in chunks(batches, features, len(fits)):
            codes = [bins[:, j].astype(np.int64) for j in range(features)]
            drawn: dict = {}  # the rows a trial draws are the same for all its folds
            for i, fit in enumerate(fits):
                if not any(fit.active):
                    continue
                train = fold != fit.held_out
                if fit.subsample < 1:
                    if fit.trial not in drawn:
                        drawn[fit.trial] = mix(rows, salt + fit.trial)
                    train &= drawn[fit.trial] < fit.subsample
                margins = fit.margins(bins, None if start is None else start[:, i], skip)
                grad, hess = gradients(margins, label, classes, unit)
                m = len(fit.features)
                for k, active in enumerate(fit.active):
                    if not active:
                        continue
                    slot_of = np.full(len(fit.growing[k].feature), -1)
                    slot_of[list(active)] = np.arange(len(active))
                    slot = slot_of[fit.growing[k].route(bins)]
                    at = np.flatnonzero(train & (slot >= 0))
                    shift = slot[at] * width if len(active) > 1 else None
                    grad_at, hess_at = np.ascontiguousarray(grad[at, k]), np.ascontiguousarray(hess[at, k]) if classes else None
                    g = np.empty((len(active), m, width))
                    h = np.empty((len(active), m, width), float if classes else np.int64)
                    for place, j in enumerate(fit.features):
                        code = codes[j][at]
                        if shift is not None:
                            code += shift
                        g[:, place] = np.bincount(code, grad_at, len(active) * width).reshape(-1, width)
                        # Squared loss has second derivative 1: its sum is a count.
                        h[:, place] = np.bincount(code, hess_at, len(active) * width).reshape(-1, width)
                    g, h = g.ravel(), h.ravel()
                    key = (i * outputs + k, tuple(active), tuple(fit.features))
                    if key in sums:
                        sums[key] = (sums[key][0] + g, sums[key][1] + h)
                    else:
                        sums[key] = (g, h)
                if not hold:  # deep trees: hand each batch's sums to Spark instead of holding them
                    yield from emit(sums)
                    sums = {}
        yield from emit(sums)

    return run


def margin_rows(fits: list[Fit], features: int, skip: int):
    """Batch iterator function: the blocks with every fit's margins after its finished rounds."""

    def run(batches):
        for rows, fold, label, bins, start in chunks(batches, features, len(fits)):
            out = np.stack([f.margins(bins, None if start is None else start[:, i], skip)
                            for i, f in enumerate(fits)], axis=1)
            yield pack(rows, fold, label, bins, out)

    return run


def score_rows(fits: list[Fit], features: int, classes: int, centre: float):
    """Batch iterator function: per (fit, round, side) the sums that r2, rmse and accuracy need."""

    def run(batches):
        sums: dict = {}
        for _, fold, label, bins, _ in chunks(batches, features):
            y = label - centre
            of_fold: dict = {}
            for i, fit in enumerate(fits):
                if fit.held_out not in of_fold:
                    test = (fold == fit.held_out).astype(np.int64)
                    of_fold[fit.held_out] = test, [np.bincount(test, w, 2) for w in (None, y, y * y)]
                test, (n, sy, syy) = of_fold[fit.held_out]
                margins, none = np.tile(fit.base, (len(bins), 1)), np.zeros(2)
                for r, trees in enumerate(fit.rounds):
                    for k, tree in enumerate(trees):
                        margins[:, k] += tree.predict(bins)
                    if classes:
                        error, hits = none, np.bincount(test, margins.argmax(axis=1) == label, 2)
                    else:
                        error, hits = np.bincount(test, (label - margins[:, 0]) ** 2, 2), none
                    for side in (True, False):
                        part = np.array([v[int(side)] for v in (n, sy, syy, error, hits)], float)
                        sums[i, r, side] = sums.get((i, r, side), 0) + part
        keys = list(sums)
        values = np.array([sums[k] for k in keys]).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.bool_())] + [pa.array(values[:, j]) for j in range(5)],
            names=["fit", "round", "isTest", "n", "sy", "syy", "sse", "hits"])

    return run


def bin_values(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins 1.. by sorted edges (a value equal to an edge stays left of it); missing is bin 0."""
    out = np.empty(x.shape, dtype=np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING_BIN, np.searchsorted(e, x[:, j], side="left") + 1)
    return out


def feature_matrix(batch: pa.RecordBatch, name: str = "features") -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(batch.num_rows, -1)


def bin_rows(edges: list[np.ndarray]):
    """Batch iterator function: blocks of (row_key, fold, label, a column per feature) with the features' bins."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.empty((batch.num_rows, len(edges)))
            for j in range(len(edges)):
                x[:, j] = _numbers(batch.column(3 + j), np.nan)
            yield pack(batch.column(0).to_numpy(zero_copy_only=False), _numbers(batch.column(1), NO_FOLD),
                       _numbers(batch.column(2), np.nan), bin_values(x, edges))

    return run


def predict_rows(fit: Fit, edges: list[np.ndarray], classes: int):
    """Batch iterator function: replace ``features`` by ``prediction``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            margins = fit.margins(bin_values(feature_matrix(batch), edges))
            out = margins.argmax(axis=1).astype(np.float64) if classes else margins[:, 0]
            names = [n for n in batch.schema.names if n != "features"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(out)], names=[*names, "prediction"])

    return run
