"""Embedding whitening: exact distributed covariance, own symmetric eigensolver for the leading components, broadcast projection.

Vectors become whole numbers and the fit list holds each distinct one once. Tasks add up whole numbers only: sums first, then products of
vectors centred on the rounded mean, sent as 40-bit limbs, so that the covariance is exact whatever the order of the tasks. The driver
gets one number per pair of dimensions and finds the leading eigenpairs: Householder reflections make the matrix tridiagonal, Sturm counts
bisect the eigenvalues, inverse iteration finds the vectors and those of close eigenvalues are made orthogonal to one another.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopledger.llm.common import kept
from hopledger.llm.vectors import usable

COMPONENTS = 4
# Rows multiplied at once, and the entries up to which their products and sums are whole numbers of double precision.
SLICE_ROWS, EXACT = 4096, 1 << 20
LIMB_BITS = 40
LONG = 2**63 - 1
# Eigenvalues nearer than this share of the largest form a cluster.
CLUSTER = 1e-3
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, Householder vectors) of a symmetric matrix."""
    a, reflectors = matrix.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = math.copysign(np.linalg.norm(v), v[0])
        v[0] += size
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - v * (v @ p)
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = -size
        reflectors.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value of ``at``: negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny * 1e10
    below, pivot = np.zeros(at.size, int), np.ones_like(at)
    for i, a in enumerate(diagonal):
        pivot = a - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = diagonal.size
    radius = np.zeros(n)
    radius[1:] += np.abs(off)
    radius[:-1] += np.abs(off)
    wide = 1e-12 * max(np.abs(diagonal).max() + radius.max(), 1e-300)
    low = np.full(k, (diagonal - radius).min() - wide)
    high = np.full(k, (diagonal + radius).max() + wide)
    allowed = n - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        up = sturm_counts(diagonal, off, middle) <= allowed
        low, high = np.where(up, middle, low), np.where(up, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges; zero pivots become ``least``."""
    n = diagonal.size
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    lower, steps = off.tolist(), []
    for i in range(n - 1):
        swap = abs(lower[i]) > abs(main[i])
        if swap:
            factor = main[i] / lower[i]
            main[i], upper[i], second[i], main[i + 1], upper[i + 1] = (
                lower[i], main[i + 1], upper[i + 1], upper[i] - factor * main[i + 1], -factor * upper[i + 1])
        else:
            main[i] = main[i] if abs(main[i]) >= least else least
            factor = lower[i] / main[i]
            main[i + 1] -= factor * upper[i]
        steps.append((swap, factor))
    main[-1] = main[-1] if abs(main[-1]) >= least else least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
            else:
                x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            known = (upper[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] = (x[i] - known) / main[i]
        return np.array(x)

    return solve


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, at most ``k``; the largest entry of a vector is positive."""
    n = len(matrix)
    k = min(k, n)
    scale = np.abs(matrix).max(initial=0.0)
    if not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    eps, draw = np.finfo(float).eps, np.random.default_rng(11)
    vectors, cluster, shift = np.zeros((n, k)), 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        shift = min(value, shift - 10 * eps * norm) if j > cluster else value
        solve, x = _solver(diagonal, off, shift, eps * norm), draw.normal(size=n)
        earlier = vectors[:, cluster:j]
        for _ in range(6):
            x = solve(x / np.abs(x).max())
            for _ in range(2):
                x = x - earlier @ (earlier.T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * scale, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row positions, whole-number matrix) of the vectors of each length, in slices."""
    lists = batch.column("x")
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        for part in range(0, which.size, SLICE_ROWS):
            rows = which[part:part + SLICE_ROWS]
            yield rows, flat[begin[rows][:, None] + np.arange(size)]


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as it is where its entries stay below ``bound``, else as whole numbers without limit."""
    top = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    return x if top < bound else x.astype(object)


def _total(fit: DataFrame, cells: Callable[[np.ndarray], np.ndarray]) -> dict[int, dict[int, int]]:
    """length -> cell -> exact sum of what ``cells`` gives for the slices of the fit list; d^2 whole numbers at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                found = cells(x).astype(object)
                sums[x.shape[1]] = sums[x.shape[1]] + found if x.shape[1] in sums else found
        out: list[list[int]] = [[], [], [], []]
        for size, totals in sums.items():
            for cell, value in enumerate(totals.tolist()):
                sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
                while value:
                    for column, entry in zip(out, (size, cell, limb, sign * (value & (1 << LIMB_BITS) - 1)), strict=True):
                        column.append(entry)
                    value, limb = value >> LIMB_BITS, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["size", "cell", "limb", "value"])

    sent = fit.mapInArrow(run, "size long, cell long, limb long, value long")
    out: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for r in sent.groupBy("size", "cell", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
        out[r["size"]][r["cell"]] += r["value"] << LIMB_BITS * r["limb"]
    return out


@dataclass
class Model:
    """Mean and components of the vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = math.nan

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        room = LONG // (4 * max(1, self.n, *map(abs, self.sums)))
        x = _exact(x, room)
        return x * self.n - np.array(self.sums, x.dtype)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ self.components / np.sqrt(self.values)

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        """Sums of squares, held within a long."""
        c = _exact(centred, math.isqrt(LONG // max(1, centred.shape[1])))
        total = (c * c).sum(axis=1)
        return np.array([min(LONG, v) for v in total.tolist()], np.int64) if c.dtype == object else total


def fit_model(fit: DataFrame, k: int = COMPONENTS) -> dict[int, Model]:
    """length -> model, from a table of distinct whole-number vectors ``x`` that is read three times.

    Components whose variance is zero to double precision are left out: nothing can be divided by it.
    """
    sums = _total(fit, lambda x: np.append(_exact(x, LONG >> 13).sum(axis=0).astype(object), len(x)))
    middle = {size: [(2 * s[i] + s[size]) // (2 * s[size]) for i in range(size)] for size, s in sums.items()}

    def products(x: np.ndarray) -> np.ndarray:
        z = _exact(x, LONG >> 2)
        z = z - np.array(middle[x.shape[1]], z.dtype)
        z = _exact(z, EXACT)
        # Within EXACT a slice of products adds up below 2^53, so the fast product of doubles is exact.
        found = z.T.dot(z) if z.dtype == object else (z.astype(float).T @ z.astype(float)).astype(np.int64)
        return found[np.triu_indices(len(found))]

    models, crossed = {}, _total(fit, products)
    for size in sums:
        cells = crossed[size]
        n, s = sums[size][size], [sums[size][i] for i in range(size)]
        left = [v - n * m for v, m in zip(s, middle[size], strict=True)]
        v = np.zeros((size, size))
        for cell, (i, j) in enumerate(zip(*np.triu_indices(size), strict=True)):
            v[i, j] = v[j, i] = (n * cells[cell] - left[i] * left[j]) / (n * n)
        trace = sum(n * cells[c] - left[i] ** 2 for c, (i, j) in enumerate(zip(*np.triu_indices(size), strict=True)) if i == j) / (n * n)
        values, vectors = leading_eigenpairs(v, k)
        good = values > size * np.finfo(float).eps * trace
        models[size] = Model(n, s, vectors[:, good], values[good], values[good] / trace if trace else values[good])
    _measure(fit, models)
    return models


def _measure(fit: DataFrame, models: dict[int, Model]) -> None:
    """Fills ``identity_error`` from the covariance of the whitened fit list, one small row per task and length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                model = models.get(x.shape[1])
                if model is not None and model.values.size:
                    w = model.project(model.centred(x))
                    found = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
                    sums[x.shape[1]] = sums.get(x.shape[1], 0) + found
        at = [(size, cell, value) for size, totals in sums.items() for cell, value in enumerate(totals.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int64()), pa.array([a[1] for a in at], pa.int64()),
                                          pa.array([a[2] for a in at], pa.float64())], ["size", "cell", "value"])

    totals = fit.mapInArrow(run, "size long, cell long, value double").groupBy("size", "cell").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, float]] = defaultdict(dict)
    for r in totals.toLocalIterator():
        found[r["size"]][r["cell"]] = r["value"]
    for size, cells in found.items():
        model = models[size]
        k = model.values.size
        means = np.array([cells[i] for i in range(k)]) / model.n
        second = np.array([cells[k + i] for i in range(k * k)]).reshape(k, k) / model.n
        model.identity_error = float(np.abs(second - np.outer(means, means) - np.eye(k)).max())


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): ``k`` rows for each usable vector.

    Vectors that are null or hold null or non-finite entries are left out, empty ones have no components. Repeated rows, and rows without
    an id, come out as often as they occur, but count once in the fit. Vectors of different lengths are whitened apart, each length with
    its own n. A component without variance is not returned (one distinct vector gives no rows). Entries beyond a long, and deviations
    beyond it, are held at its ends. Extra columns do not matter; an empty table gives no rows. The driver gets d^2 numbers per length.
    """
    rows = usable(embeddings).select("vec_id", F.transform("v", lambda c: F.floor(256 * c)).alias("x"))
    models = fit_model(kept(rows.select("x").distinct()), k)
    shipped = embeddings.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shipped.value
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in _matrices(batch):
                model = models[x.shape[1]]
                each = model.values.size
                if not each:
                    continue
                centred = model.centred(x)
                total = len(at) * each
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(at, each))), pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(total, model.n)), pa.array(np.repeat(model.deviation(centred), each)),
                    pa.array(model.project(centred).ravel()), pa.array(np.tile(model.explained, len(at))),
                    pa.array(np.full(total, model.identity_error))], [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
