"""Whitening of vectors by a randomised range finder and Rayleigh-Ritz.

Vectors become whole numbers first, so that sums and means are exact. Their covariance V is never
formed while it can be avoided: a random basis of a few more columns than components are asked for (oversampling) is
multiplied by V, that is, by all centred rows and back, in one pass of the table. Each pass is a power step and a test at once: the
basis' Ritz vectors and their residuals come from the product that also is the next basis. A component is
good when its residual is small against the gap to its neighbours, as that bounds its error. If the residuals have not got there, or by their
rate won't in the passes that are left, the basis is widened to the full dimension, where the Ritz vectors are the eigenvectors.

Every pass is a job of its own over the given table: tasks add up their rows and hand on one number for each entry of
the basis, which are summed by entry. What the driver holds depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.vectors import dimension, matrix, pieces, usable

COMPONENTS = 8
OVERSAMPLING = 10
#: Power passes before the basis is widened to the full dimension.
PASSES = 5
#: A component's residual against the gap to its neighbours.
TOLERANCE = 1e-12
#: Vectors become floor(SCALE * entry) + SHIFT; greater numbers than MOST stand for MOST, so that each is exact as a double.
SCALE = 1024
SHIFT = 100_000
MOST = 2.0**53
#: Bits of the lower part of a number, summed apart from the upper one so that neither overflows.
LOW_BITS = 26
SEED = 20_240_613

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(col: pa.Array, width: int) -> np.ndarray:
    return np.clip(np.floor(SCALE * matrix(col, width)) + SHIFT, -MOST, MOST).astype(np.int64)


class Centre:
    """The exact mean ``total / n`` of whole vectors."""

    def __init__(self, total: list[int], n: int):
        self.n = n
        self.floor = np.array([s // n for s in total], dtype=np.int64)
        self.rest = np.array([s % n for s in total], dtype=np.int64)

    def off(self, x: np.ndarray) -> np.ndarray:
        """``x`` minus the mean: whole parts are subtracted exactly."""
        return (x - self.floor).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of ``(n x - total) ** 2`` over dimensions, exact; None if it is beyond a long."""
        rough = self.n * (x - self.floor).astype(np.float64) - self.rest
        fits = (rough**2).sum(axis=1) < 2.0**62
        out = ((self.n * (x - self.floor) - self.rest) ** 2).sum(axis=1).tolist()
        for i in np.flatnonzero(~fits).tolist():
            exact = sum((self.n * (a - b) - c) ** 2 for a, b, c in zip(x[i].tolist(), self.floor.tolist(), self.rest.tolist()))
            out[i] = exact if exact < 2**63 else None
        return out


def _sums(vectors: DataFrame, width: int, add: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``add`` makes of a block of whole vectors: ``size`` numbers. One job; tasks hand on their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        seen = False
        for batch in pieces(batches, width):
            total += add(_whole(batch.column(0), width)).ravel()
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["at", "value"])

    rows = vectors.select("embedding").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    out[[r["at"] for r in rows]] = [r["value"] for r in rows]
    return out


def _totals(vectors: DataFrame, width: int) -> list[int]:
    """The exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for batch in pieces(batches, width):
            x = _whole(batch.column(0), width)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(high), pa.array(low)], names=["at", "high", "low"])

    parts = vectors.select("embedding").mapInArrow(run, "at int, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    rows = sorted(parts.groupBy("at").agg(whole("high"), whole("low")).collect())
    return [(int(r["high"]) << LOW_BITS) + int(r["low"]) for r in rows]


def _good(values: np.ndarray, residuals: np.ndarray, k: int) -> tuple[bool, float]:
    """Whether the first k Ritz vectors are good, and by how much the worst of them misses."""
    gaps = np.abs(values[:k, None] - values[None, :])
    gaps[np.arange(k), np.arange(k)] = np.inf
    worst = float(np.max(residuals[:k] / np.maximum(gaps.min(axis=1), np.finfo(float).tiny)))
    return worst <= TOLERANCE, worst


def principal(vectors: DataFrame, width: int, centre: Centre, k: int, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """``(components, eigenvalues, trace, passes made)``: unit eigenvectors of the covariance as columns, by falling eigenvalue.

    ``vectors(embedding)`` are usable and of one length. Of each component the entry of greatest size is positive.
    """
    n, size = centre.n, k + oversampling

    def times(basis: np.ndarray | None) -> tuple[np.ndarray, float]:
        """V times a basis, or V itself, and its trace."""

        def add(x: np.ndarray) -> np.ndarray:
            c = centre.off(x)
            return np.append((c.T @ (c if basis is None else c @ basis)).ravel(), (c * c).sum())

        columns = width if basis is None else basis.shape[1]
        got = _sums(vectors, width, add, width * columns + 1) / n
        return got[:-1].reshape(width, columns), float(got[-1])

    made, last = 0, None
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, size)))[0] if size < width else None
    while basis is not None:
        product, trace = times(basis)
        made += 1
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residuals = np.linalg.norm(product @ turn - basis @ turn * values, axis=0)
        good, worst = _good(values, residuals, k)
        if good:
            vectors_ = basis @ turn[:, :k]
            break
        rate = worst / last if last else 0.0
        hopeless = rate and worst * min(rate, 1.0) ** (passes - made) > TOLERANCE
        last = worst
        basis = None if made >= passes or hopeless else np.linalg.qr(product)[0]
    else:
        whole, trace = times(None)
        made += 1
        values, turn = np.linalg.eigh((whole + whole.T) / 2)
        values, vectors_ = values[::-1], turn[:, ::-1][:, :k]
    greatest = vectors_[np.abs(vectors_).argmax(axis=0), np.arange(vectors_.shape[1])]
    return vectors_ * np.where(greatest < 0, -1.0, 1.0), np.maximum(values[: vectors_.shape[1]], 0.0), trace, made


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable row of ``vectors(vec_id, embedding)`` and component.

    A vector that is null or has null or non-finite entries takes no part, nor does one whose length isn't the commonest (of equally common ones the
    greatest); nor do vectors without entries. There are as many components as dimensions, if these are fewer.
    A component without variance has ``whitened`` null and ``explained`` 0 (null if nothing varies), and does not count for
    ``identity_error``. A deviation beyond a long is null; entries beyond 2 ** 43 count as that. Repeated rows count as
    often as they are there; a null vec_id is kept. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")))
    width, n = dimension(rows, "embedding")
    rows = rows.where(F.size("embedding") == width)
    if not width:
        return rows.sparkSession.createDataFrame([], OUT)
    centre = Centre(_totals(rows, width), n)
    k = min(components, width)
    basis, values, trace, _ = principal(rows, width, centre, k)
    varied = values > trace * width * np.finfo(float).eps
    scale = np.where(varied, 1 / np.sqrt(np.where(varied, values, 1.0)), 0.0)

    def white(x: np.ndarray) -> np.ndarray:
        return centre.off(x) @ basis * scale

    def moments(x: np.ndarray) -> np.ndarray:
        y = white(x)
        return np.append((y.T @ y).ravel(), y.sum(axis=0))

    got = _sums(rows, width, moments, k * k + k) / n
    off = got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :]) - np.eye(k)
    error = float(np.abs(off[np.ix_(varied, varied)]).max()) if varied.any() else None
    explained = (values / trace).tolist() if trace > 0 else [None] * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, width):
            x = _whole(batch.column(1), width)
            y = pa.array(white(x).ravel(), mask=np.tile(~varied, len(x)))
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(centre.deviation(x), pa.int64()).take(pa.array(each))
            m = len(each)
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(m, n), pa.int64()), deviation, y, pa.array(explained * len(x), pa.float64()), pa.array([error] * m, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return rows.mapInArrow(run, OUT)
