"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers x = floor(64 * entry) + 1000000 and are written once, packed by blocks. Their leading principal
components are found without their covariance matrix V: the only thing that visits the data is a pass
Y = sum of (x - mean)' ((x - mean) Q) / n for a thin block Q, summed inside tasks and then by cell of Y.

* A polynomial recurrence over such passes damps the part of the spectrum below the block and amplifies what is above.
  Its interval ends at the block's least Ritz value; it begins at a bound of the least eigenvalue, which a
  Lanczos vector finds that travels in the same passes. Its degree is bounded so that amplification stays within the range of a double.
* QR of the block and Rayleigh-Ritz follow; the pass that they need is the first of the next recurrence.
* It ends when every wanted vector is certified: its residual, which bounds its error times its distance from other
  eigenvalues, is small enough, or at the rounding of the pass. A block that improves too slowly is widened, at most to
  all dimensions, where Rayleigh-Ritz alone is exact; so it always ends.

The driver holds dimensions x block numbers, whatever the number of rows.

Defined results: rows with a null vector, or with a null, infinite or not-a-number entry, are dropped, and so are rows whose
length is not the most frequent one (ties: the longer) and rows with entries of 2**46 and more, whose x would not be exact. A component
whose eigenvalue is zero to rounding (at most 1e-12 of the largest) cannot be whitened and has no rows, so equal vectors and
empty tables give empty results. A deviation beyond a long is null. A null vec_id and repeated rows are kept; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 1000
GUARD = 16
DEGREE, SPREAD = 12, 1e12
ACCURACY, ROUNDING = 1e-11, 1e-14
ZERO = 1e-12
MOST_ENTRY = 2.0**46


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding array<double>) that can be whitened together."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)
    own = own.where(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= MOST_ENTRY)))
    sizes = own.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", "size")).alias("size"))
    return own.join(F.broadcast(sizes), F.size("embedding") == F.col("size")).select("vec_id", "embedding")


def packed(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors: m, d, their ids and x as 64-bit integers (m x d)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                m, entries = part.num_rows, part.column(1).flatten()
                x = np.floor(SCALE * entries.to_numpy()).astype(np.int64) + SHIFT
                ids = pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([len(x) // m], pa.int32()), ids, pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["m", "d", "ids", "x"])

    return written(usable(vectors).mapInArrow(run, "m int, d int, ids array<long>, x binary"), "vectors")


def _blocks(batches):
    """(ids, x) of each packed block; columns are d, ids, x."""
    for batch in batches:
        for k in range(batch.num_rows):
            d = batch.column(0)[k].as_py()
            yield batch.column(1)[k].values, np.frombuffer(batch.column(2)[k].as_buffer(), "<i8").reshape(-1, d)


def column_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""

    def run(batches):
        for _, x in _blocks(batches):
            # entries are below 2**53 and blocks have at most BLOCK_ROWS rows, so that a block's sum fits
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.sum(0)), pa.array(np.full(x.shape[1], len(x)))], names=["cell", "value", "m"])

    rows = blocks.select("d", "ids", "x").mapInArrow(run, "cell int, value long, m long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"), F.sum("m").alias("m")).orderBy("cell").collect()
    return (rows[0]["m"], [int(r["value"]) for r in rows]) if rows else (0, [])


def _summed(blocks: DataFrame, cells, size: int) -> np.ndarray:
    """Sum over all blocks of the `size` numbers that cells(x) makes of a block: inside each task, then by number."""

    def run(batches):
        total = np.zeros(size)
        for _, x in _blocks(batches):
            total += cells(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    rows = blocks.select("d", "ids", "x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).coalesce(2).toArrow()
    out = np.zeros(size)
    out[rows.column("cell").to_numpy()] = rows.column("value").to_numpy()
    return out


class Centred:
    """x minus the mean, of a block: the mean is a whole number and a rest, so that nothing is lost in x - mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


def covariance_times(blocks: DataFrame, centred: Centred, q: np.ndarray) -> np.ndarray:
    """V Q by one pass over the data."""

    def cells(x):
        z = centred(x)
        return (z.T @ (z @ q)).ravel()

    return _summed(blocks, cells, q.size).reshape(q.shape) / centred.n


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values falling, vectors, V vectors) of V on the span of the orthonormal q."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading_components(blocks: DataFrame, centred: Centred, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(eigenvalues falling, unit eigenvectors as columns, what it took) of the covariance, certified."""
    passes = 0

    def times(q):
        nonlocal passes
        passes += 1
        return covariance_times(blocks, centred, q)

    random = np.random.default_rng(11)
    width = min(d, wanted + GUARD)
    q = np.linalg.qr(random.standard_normal((d, width)))[0]
    values, q, vq = _ritz(q, times(q))
    line = [np.linalg.qr(random.standard_normal((d, 1)))[0][:, 0]]
    alpha, beta = [], []
    bottom, last = 0.0, math.inf
    while True:
        top = max(values[0], np.finfo(float).tiny)
        residual = np.linalg.norm(vq - q * values, axis=0)
        gap = np.full(len(values), np.inf)
        gap[:-1] = values[:-1] - values[1:]
        gap[1:] = np.minimum(gap[1:], gap[:-1])
        done = (residual <= ACCURACY * gap) | (residual <= ROUNDING * top) | (values <= ZERO * top)
        if width == d or done[:wanted].all():
            break
        error = float(residual[:wanted].max())
        if error > last / 4:  # too slow: a wider block leaves more of the spectrum to be damped
            more = min(d, 2 * width) - width
            q = np.linalg.qr(np.concatenate([q, random.standard_normal((d, more))], 1))[0]
            width += more
            values, q, vq = _ritz(q, times(q))
            last = math.inf
            continue
        last = error
        # damp [bottom, cut]; columns are scaled so that the first stays of length about 1
        cut = values[-1]
        half, mid = max((cut - bottom) / 2, ROUNDING * top), (cut + bottom) / 2
        growth = math.acosh(max(1 + 1e-9, (top - mid) / half))
        degree = max(2, min(DEGREE, int(math.log(SPREAD) / growth)))
        sigma = first = half / (top - mid) if top > mid else 1.0
        before, now = q, (vq - mid * q) * (sigma / half)
        for _ in range(degree - 1):
            lanczos = len(alpha) == len(line) - 1 and len(line) < min(d, DEGREE)
            product = times(np.concatenate([now, line[-1][:, None]], 1) if lanczos else now)
            if lanczos:
                w = product[:, -1]
                alpha.append(float(line[-1] @ w))
                for _ in range(2):
                    w = w - np.array(line).T @ (np.array(line) @ w)
                beta.append(float(np.linalg.norm(w)))
                if beta[-1] > ROUNDING * top:
                    line.append(w / beta[-1])
                product = product[:, :-1]
            following = 1 / (2 / first - sigma)
            before, now = now, 2 * (following / half) * (product - mid * now) - sigma * following * before
            sigma = following
        low, turn = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
        bottom = min(max(0.0, float(low[0] - beta[-1] * abs(turn[-1, 0]))), cut * 0.999)
        q = np.linalg.qr(now)[0]
        values, q, vq = _ritz(q, times(q))
    q = q[:, :wanted]
    q = q * np.where(q[np.abs(q).argmax(0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    return values[:wanted], q, {"passes": passes, "width": width, "residual": float((residual / top)[:wanted].max())}


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of vectors (vec_id, embedding), in long form.

    Per usable row and component (from 1, by falling variance): n vectors of the fit, deviation (exact sum of (n * x - S) ** 2),
    whitened coordinate, explained share of the total variance, and the measured identity_error of the whole result.
    The packed vectors stay in the shared folder, where the returned plan reads them.
    """
    blocks = packed(vectors)
    n, sums = column_sums(blocks)
    d = len(sums)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n == 0:
        drop_written(blocks)
        return vectors.sparkSession.createDataFrame([], schema)
    centred = Centred(n, sums)
    trace = float(_summed(blocks, lambda x: np.array([np.square(centred(x)).sum()]), 1)[0]) / n
    values, q, _ = leading_components(blocks, centred, d, min(components, d))
    k = int((values > ZERO * max(values[0], 0.0)).sum())
    values, map_to = values[:k], q[:, :k] / np.sqrt(values[:k])
    explained = values / trace if k else values

    def moments(x):
        w = centred(x) @ map_to
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    found = _summed(blocks, moments, k * k + k) / n
    mean = found[k * k :]
    identity_error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0

    def run(batches):
        for ids, x in _blocks(batches):
            m = len(x)
            w = centred(x) @ map_to
            deviation = deviations(x, n, sums)
            columns = [ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("d", "ids", "x").mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum over dimensions of (n * x - S) ** 2 for each row; null beyond a long."""
    whole = np.array([s // n for s in sums], np.int64)
    most = (float(np.abs(x - whole).max()) + 1) * n
    if most * most * x.shape[1] < 2.0**62:
        return pa.array(np.square(n * (x - whole) - np.array([s % n for s in sums], np.int64)).sum(1))
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
