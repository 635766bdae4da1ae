"""Embedding whitening: distributed centred covariance, leading components, broadcast projection.

Spark counts distinct vectors, sums them and adds up centred products; the covariance, one number for each pair of
dimensions, is decomposed on the driver by Householder tridiagonalisation, Sturm counts and inverse iteration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import saved

SCALE, SHIFT = 64.0, 1_000_000
#: Entries beyond this many steps count as this many, so that sums stay within 64 bits.
MOST = 1 << 40
COMPONENTS = 16
#: A component must hold more than this share of the whole variance; below it is rounding.
LEAST_SHARE = 1e-12


def steps(vector: Column, dim: int) -> Column:
    """floor(64 c) + 1000000 of each entry as longs; a vector shorter than ``dim`` reads as if zeros followed."""
    long = F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(vector)))
    return F.transform(long, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def added(df: DataFrame, partial, n: int, rows: int = 1) -> np.ndarray:
    """The sum of ``partial(x)``, (rows, n) doubles, over the blocks of the table; each task sends its own sum, added up by place."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = partial(b.column(0))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.array(list(total.reshape(rows, n)), pa.list_(pa.float64()))], names=["row", "sums"])

    cells = df.select("x").mapInArrow(own, "row long, sums array<double>").select("row", F.posexplode("sums").alias("at", "s"))
    got = cells.groupBy("row", "at").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((rows, n))
    out[got["row"].to_numpy(), got["at"].to_numpy()] = got["s"].to_numpy()
    return out


def column_sums(df: DataFrame, dim: int) -> list[int]:
    """The exact sum of each dimension: a sum for each Arrow batch, added up as decimals."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(matrix(b.column(0), dim).sum(0, dtype=np.int64))], names=["at", "s"])

    got = df.select("x").mapInArrow(own, "at long, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).toArrow().to_pydict()
    found = dict(zip(got["at"], got["s"], strict=True))
    return [int(found.get(k, 0)) for k in range(dim)]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections): Householder reflections, one a column, turn a symmetric matrix tridiagonal."""
    a, mirrors = a.copy(), []
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        long = np.linalg.norm(v)
        if long > 0:
            v /= long
            block = a[k + 1:, k + 1:]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = -np.copysign(size, a[k + 1, k])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(d: np.ndarray, e2: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each x: negative terms of the Sturm sequence."""
    least = np.finfo(float).tiny ** 0.5
    q, found = d[0] - x, np.zeros(len(x), np.int64)
    found += q < 0
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least, q)
        q = d[k] - x - e2[k - 1] / q
        found += q < 0
    return found


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: each place's interval is halved by Sturm counts until it holds no further double."""
    n = len(d)
    reach = np.zeros(n)
    reach[:-1] += np.abs(e)
    reach[1:] += np.abs(e)
    lo, hi = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    hi = hi + np.abs(hi) * 1e-15 + np.finfo(float).tiny
    place, e2 = n - 1 - np.arange(k), e * e
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        high = below(d, e2, mid) > place
        hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
    return lo + (hi - lo) / 2


def solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, small: float) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; a zero pivot is ``small``."""
    n = len(d)
    u, v, w, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    lower = e.copy()
    for k in range(n - 1):
        if abs(u[k]) < abs(lower[k]):
            u[k], lower[k] = lower[k], u[k]
            v[k], u[k + 1] = u[k + 1], v[k]
            w[k], v[k + 1] = v[k + 1], w[k]
            x[k], x[k + 1] = x[k + 1], x[k]
        u[k] = u[k] or small
        f = lower[k] / u[k]
        u[k + 1] -= f * v[k]
        v[k + 1] -= f * w[k]
        x[k + 1] -= f * x[k]
    u[n - 1] = u[n - 1] or small
    x[n - 1] /= u[n - 1]
    if n > 1:
        x[n - 2] = (x[n - 2] - v[n - 2] * x[n - 1]) / u[n - 2]
    for k in range(n - 3, -1, -1):
        x[k] = (x[k] - v[k] * x[k + 1] - w[k] * x[k + 2]) / u[k]
    return x


def directions(d: np.ndarray, e: np.ndarray, values: np.ndarray, seed: int = 7) -> np.ndarray:
    """(n, k) eigenvectors of the tridiagonal matrix by inverse iteration; those of a cluster of values are made orthogonal at every step."""
    n, scale = len(d), max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    eps = np.finfo(float).eps * scale
    start, out = np.random.default_rng(seed), np.zeros((n, len(values)))
    first, at = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * scale:
            first = k
        at = min(value, at - 2 * eps) if k > first else value
        x = start.uniform(-1, 1, n)
        for _ in range(6):
            x = solved(d, e, at, x / np.linalg.norm(x), eps)
            if not np.all(np.isfinite(x)):
                x = start.uniform(-1, 1, n)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def principal(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, (dim, k) unit eigenvectors) of a symmetric matrix, the k largest, falling."""
    n = len(v)
    k = min(k, n)
    if not k:
        return np.zeros(0), np.zeros((n, 0))
    scale = np.abs(v).max()
    if not scale:
        return np.zeros(k), np.eye(n, k)
    d, e, mirrors = tridiagonal(v / scale)
    values = leading(d, e, k)
    out = directions(d, e, values)
    for at in range(n - 3, -1, -1):
        out[at + 1:] -= 2 * np.outer(mirrors[at], mirrors[at] @ out[at + 1:])
    return values * scale, out / np.linalg.norm(out, axis=0)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every row with a usable vector, once for each component: key, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``.

    Fitted on each distinct vector once (n of them), however often it is repeated. ``identity_error`` is measured: the whitened
    fit list's own covariance against the identity. Rows whose vector is null or holds a null, NaN or infinite entry are dropped.
    The dimension is the longest vector's; shorter ones, the empty one included, read as if zeros followed. Entries beyond 2^40 steps
    count as 2^40. Components without variance (up to 1e-12 of all) have no direction and are not returned, so a table with one distinct
    vector, or none, gives an empty result. A deviation beyond 62 bits is null. Null and repeated keys are rows like any other;
    other columns are ignored.

    The driver and each task hold one matrix of the dimension squared; the projection sent to tasks has ``components`` vectors."""
    own = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    dim = own.agg(F.max(F.size("v"))).first()[0] or 0
    kind = own.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = saved(own.select("key", steps(F.col("v"), dim).alias("x")), "steps")
    fit = saved(rows.select("x").distinct(), "fit")
    n, sums = fit.count(), column_sums(fit, dim)
    middle = np.array([s // n for s in sums], np.int64) if n else np.zeros(dim, np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], np.int64)  # S = n * middle + rest, all exact

    def centred(column: pa.Array) -> np.ndarray:
        return (matrix(column, dim) - middle).astype(float) - rest / n

    values, vectors, trace = np.zeros(0), np.zeros((dim, 0)), 0.0
    if n and dim:
        cov = added(fit, lambda c: (lambda y: y.T @ y)(centred(c)), dim, dim) / n
        cov = (cov + cov.T) / 2
        trace = float(np.trace(cov))
        values, vectors = principal(cov, components)
        live = values > LEAST_SHARE * trace
        values, vectors = values[live], vectors[:, live]
    k = len(values)
    if not k:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    project = vectors / np.sqrt(values)
    spread = added(fit, lambda c: (lambda y: y.T @ y)(centred(c) @ project), k, k) / n
    error, explained = float(np.abs(spread - np.eye(k)).max()), values / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            near = matrix(b.column(1), dim) - middle
            far = near * n - rest
            squares = (far * far).sum(1)
            small = ((near.astype(float) * n) ** 2).sum(1) < 2.0**62
            w = centred(b.column(1)) @ project
            each = lambda x: np.repeat(x, k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each(np.arange(m)))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(each(squares), mask=each(~small)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, schema).withColumnRenamed("key", key)
