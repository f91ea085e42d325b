"""Embedding whitening by LOBPCG: the leading eigenvectors of the covariance, found by distributed products with blocks.

The covariance is never formed. A product with a block of vectors is one pass over the centred rows: each task adds up
(x - mean) ((x - mean) block) of its rows, and the sums of all tasks meet entry by entry. A round takes the residuals of the iterate, makes
them orthonormal to it and to the previous directions, multiplies them by the covariance, and solves the small (Rayleigh-Ritz) problem
on iterate, residuals and previous directions together; the products of the other two blocks follow from the same combination. When the
residuals are small, the iterate's product is computed afresh: only residuals certified so end the iteration, else it goes on from
there. Rows are then projected and scaled, and the covariance of the result is measured in one more pass.

Defined results: entries become whole numbers by floor(scale * entry) + shift; a vector that is null, empty, or holds a null or an
entry that is not finite (or whose whole number exceeds 2^52) is dropped; so are vectors of another dimension than most have, of equally frequent ones the largest;
repeated rows, null identifiers and ties are rows like others, each counted; of components with equal eigenvalues any basis; a
component without variance (an eigenvalue of no more than 1e-12 of the largest) cannot be scaled and is left out, so that equal rows alone
have no components; a deviation that does not fit 64 bits is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_LARGEST = 1 << 52
#: Sums of whole numbers are kept as high and low parts of so many bits.
_LOW_BITS = 26


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: unit eigenvectors, in columns
    trace: float
    residual: float  #: the greatest certified residual over the largest eigenvalue
    rounds: int


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_rows(rows: DataFrame, id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(id, x): the rows that are kept, in whole numbers."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    x = rows.select(F.col(id).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * scale) + shift).alias("x"), v.alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(_LARGEST)))
    x = cut(x.where(fits & (F.size("v") > 0)).select("id", "x"))
    most = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return x.join(F.broadcast(most), F.size("x") == F.col("d"), "left_semi")


def summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of partial(x), a matrix of the given shape, where x are some of the rows: each task adds up its own, equal entries of all tasks meet."""

    def each(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                part = partial(_matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["at", "v"])

    whole = np.zeros(shape, dtype=np.int64 if partial is _parts else np.float64)
    kind = "long" if partial is _parts else "double"
    for r in rows.select("x").mapInArrow(each, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect():  # the entries of one small matrix
        whole.reshape(-1)[r.at] = r.v
    return whole


def _parts(x: np.ndarray) -> np.ndarray:
    """Sums of the high and the low bits of each dimension, and the number of rows: exact for any number of rows."""
    return np.stack([(x >> _LOW_BITS).sum(axis=0), (x & ((1 << _LOW_BITS) - 1)).sum(axis=0), np.full(x.shape[1], len(x))])


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = 8, tolerance: float = 1e-14, rounds: int = 500, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, eigenvectors, greatest certified residual over the largest eigenvalue, rounds) of the k largest of a symmetric matrix that is known by its products with blocks.

    guard: vectors iterated beyond those asked for, so that these converge by the gap to the last guard. It ends when certified residuals are
    within the tolerance, or have stopped falling within 1e-11; an error otherwise."""
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, m)))[0]
    ax, p, ap, best, since = product(x), np.zeros((d, 0)), np.zeros((d, 0)), np.inf, 0
    values, turn = np.linalg.eigh(x.T @ ax)
    x, ax, values, fresh = x @ turn[:, ::-1], ax @ turn[:, ::-1], values[::-1], True
    for done in range(rounds):
        r = ax - x * values
        size = np.sqrt((r[:, :k] ** 2).sum(axis=0)).max(initial=0.0) / max(values[0], np.finfo(float).tiny)
        since = since + 1 if size > 0.5 * best else 0
        best = min(best, size)
        if size <= tolerance or (since >= 6 and size <= 1e-11) or m == d:
            if fresh:
                return values[:k], x[:, :k], float(size), done
            ax, p, ap, fresh = product(x), np.zeros((d, 0)), np.zeros((d, 0)), True
            continue
        # residuals, made orthonormal to the rest of the trial space; what is left of no size is dropped
        base = np.concatenate([x, p], axis=1)
        r = r / np.maximum(np.sqrt((r * r).sum(axis=0)), np.finfo(float).tiny)
        for _ in range(2):
            r = r - base @ (base.T @ r)
        u, s, _ = np.linalg.svd(r, full_matrices=False)
        r = u[:, s > 1e-10 * max(1.0, s[0])]
        r = np.linalg.qr(r - base @ (base.T @ r))[0] if r.shape[1] else r
        space, image = np.concatenate([base, r], axis=1), np.concatenate([ax, ap, product(r) if r.shape[1] else r], axis=1)
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        new, image_new = space @ turn, image @ turn
        # directions: what the step added to the old iterate, orthonormal to the new one, by combinations of the same columns
        step = np.concatenate([np.zeros((m, m)), turn[m:]])
        step = step - turn @ (turn.T @ step)
        u, s, _ = np.linalg.svd(step, full_matrices=False)
        u = u[:, s > 1e-8]
        u = np.linalg.qr(u - turn @ (turn.T @ u))[0] if u.shape[1] else u
        x, ax, p, ap, fresh = new, image_new, space @ u, image @ u, False
    raise ArithmeticError(f"residuals of {best:.1e} after {rounds} rounds")


def fit(x: DataFrame, components: int = 8, guard: int = 8, tolerance: float = 1e-14) -> Whitening | None:
    """The whitening of rows (x); None without rows."""
    first = x.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    high, low, count = summed(x, _parts, (3, d)).tolist()
    n, sums = count[0], [(h << _LOW_BITS) + w for h, w in zip(high, low)]
    mean = np.array([s / n for s in sums])

    def product(block: np.ndarray) -> np.ndarray:
        return summed(x, lambda v: (v - mean).T @ ((v - mean) @ block), (d, block.shape[1])) / n

    trace = float(summed(x, lambda v: ((v - mean) ** 2).sum(axis=0)[None], (1, d)).sum()) / n
    k = min(components, d)
    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, 0)
    values, vectors, residual, rounds = lobpcg(product, d, k, guard, tolerance)
    good = int((values > 1e-12 * values[0]).sum())
    return Whitening(n, sums, values[:good], vectors[:, :good], trace, residual, rounds)


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, guard: int = 8, tolerance: float = 1e-14) -> DataFrame:
    """A row for each of rows that is kept and each component: id, component (from 1), n, deviation (from the mean, squared, times n squared), whitened, explained, identity_error."""
    x = whole_rows(rows, id, vector, scale, shift)
    schema = f"`{id}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(x, components, guard, tolerance)
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], schema)
    mean, scaled = np.array([s / w.n for s in w.sums]), w.vectors / np.sqrt(w.values)
    k = len(w.values)
    error = float(np.abs(summed(x, lambda v: (y := (v - mean) @ scaled).T @ y, (k, k)) / w.n - np.eye(k)).max())
    n, sums, explained = w.n, w.sums, w.values / w.trace

    def project(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            y = (v - mean) @ scaled
            most = max(int(np.abs(v).max()) * n, *(abs(s) for s in sums)) * 2
            if most * most * v.shape[1] < 1 << 63:
                apart = n * v - np.array(sums)
                deviation = (apart * apart).sum(axis=1)
            else:  # exact in whole numbers of any size
                exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in v.tolist()]
                deviation = [e if e < 1 << 63 else None for e in exact]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(y.reshape(-1)), k).cast(pa.list_(pa.float64()))], ["id", "deviation", "y"])

    out = x.select("id", "x").mapInArrow(project, "id long, deviation long, y array<double>").select("id", "deviation", F.posexplode("y").alias("at", "whitened"))
    part = F.element_at(F.array(*(F.lit(float(e)) for e in explained)), F.col("at") + 1)
    return out.select(F.col("id").alias(id), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", part.alias("explained"), F.lit(error).alias("identity_error"))
