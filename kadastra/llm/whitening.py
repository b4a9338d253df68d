"""Embedding whitening by a two-pass covariance.

1. Every entry c becomes the integer floor(1024 * c) + 100000.  The first pass adds the integers up exactly.
2. The second pass centres the rows on that mean and sums their outer products, one NumPy matrix product a batch.
   Partial sums of both passes meet in ``treeAggregate``, so the driver merges few of them at any input.
3. LAPACK's symmetric solver gives eigenvalues and unit eigenvectors of the covariance; ``DIMENSIONS`` bounds its side.
   The projection (at most ``COMPONENTS`` columns) is broadcast, and rows are projected where they lie.
A third pass measures what was reached: the covariance of the projected rows, from centred partial sums that are
merged with their means.

Defined cases: rows whose vector is null, empty or holds null, NaN or infinite entries are dropped; so are rows of another
length than most (the shortest among equals).  Entries beyond 2^52 count as 2^52.  Repeated rows and null ids are rows like
others; an empty table gives no rows.  A component without variance (beyond rounding) has a null ``whitened``; if nothing
varies, ``explained`` is null too.  A deviation over 2^63 - 1 is null as a long and exact in ``deviation_digits``.  The
sign of a component makes its largest entry positive.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal, pa_schema, quoted

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Longest vector: the driver holds the square of it in doubles, four times.
DIMENSIONS = 4096
#: Rows turned into doubles at once.
ROWS = 2048
_FAR = 2.0**52
#: Eigenvalues under this part of the largest are rounding.
_NIL = 1e-12
_LONG = 1 << 63


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector as doubles, of the rows whose vector is whole."""
    e = quoted(column).cast("array<double>")
    finite = F.forall(e, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    return embeddings.filter(e.isNotNull() & (F.size(e) > 0) & finite).select("vec_id", e.alias("vector"))


def integers(vectors: pa.ListArray, d: int) -> np.ndarray:
    """The x-vectors of a column of whole vectors, as rows of 64-bit integers."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * c), -_FAR, _FAR).astype(np.int64) + SHIFT


def _each(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for big in batches:
        for at in range(0, big.num_rows, ROWS):
            b = big.slice(at, ROWS)
            yield b, integers(b.column(b.num_columns - 1), d)


def _gather(df: DataFrame, ddl: str, partial: Callable, merge: Callable):
    """What ``merge`` makes of the rows, one at most a task, that ``partial`` gives, or None."""
    schema = pa_schema(ddl)

    def run(batches):
        for row in partial(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    rows = df.mapInArrow(frugal(run), ddl).rdd.map(tuple)
    return rows.treeAggregate(None, lambda a, b: b if a is None else merge(a, b), lambda a, b: b if a is None else a if b is None else merge(a, b))


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the sum of the integers of each dimension."""

    def partial(batches):
        n, total = 0, [0] * d
        for _, x in _each(batches, d):
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]  # 2^53 * ROWS fits
        if n:
            yield n, list(map(str, total))

    def merge(a, b):
        return a[0] + b[0], [str(int(x) + int(y)) for x, y in zip(a[1], b[1], strict=True)]

    n, total = _gather(vectors.select("vector"), "n long, total array<string>", partial, merge) or (0, ["0"] * d)
    return n, list(map(int, total))


class Centre:
    """The mean as an integer and a rest below one, so that centring loses nothing of the integers."""

    def __init__(self, n: int, total: list[int]):
        whole = [s // n for s in total]
        self.whole = np.array(whole, np.int64)
        self.rest = np.array([(s - n * w) / n for s, w in zip(total, whole, strict=True)])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def _array(data) -> np.ndarray:
    return np.frombuffer(bytes(data), np.float64)


def covariance(vectors: DataFrame, d: int, n: int, centre: Centre) -> np.ndarray:
    """Mean outer product of the centred rows."""

    def partial(batches):
        total = np.zeros((d, d))
        for _, x in _each(batches, d):
            y = centre.rows(x)
            total += y.T @ y
        yield (total.tobytes(),)

    def merge(a, b):
        return ((_array(a[0]) + _array(b[0])).tobytes(),)

    (total,) = _gather(vectors.select("vector"), "total binary", partial, merge)
    return _array(total).reshape(d, d) / n


@dataclass
class Model:
    n: int
    total: list[int]
    centre: Centre
    values: np.ndarray  # eigenvalues of the components, falling
    explained: list[float | None]
    projection: np.ndarray  # a column a component, divided by the root of its eigenvalue; 0 where there is none

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.projection

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 of each row, exact."""
        n, d = self.n, x.shape[1]
        far = float(np.abs(x - self.centre.whole).max(initial=0)) + 1.0
        if d * (n * far) ** 2 < _LONG / 2 and n * float(np.abs(x).max(initial=0)) < _LONG / 2:
            y = n * x - np.array(self.total, np.int64)
            return (y * y).sum(axis=1).tolist()
        return [sum((n * a - s) ** 2 for a, s in zip(r, self.total, strict=True)) for r in x.tolist()]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Model:
    """Mean, eigenvalues and projection of ``usable`` rows of ``d`` entries."""
    n, total = exact_sums(vectors, d)
    centre = Centre(n, total)
    v = covariance(vectors, d, n, centre)
    values, units = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, units = values[order], units[:, order]
    units = units * np.sign(units[np.abs(units).argmax(axis=0), np.arange(len(order))])
    trace = float(np.trace(v))
    there = values > _NIL * max(float(values[0]), 0.0)
    projection = np.where(there, units / np.sqrt(np.where(there, values, 1.0)), 0.0)
    return Model(n, total, centre, np.where(there, values, 0.0), [float(e) / trace if trace > 0 else None for e in values], projection)


def identity_error(vectors: DataFrame, d: int, model: Model) -> float | None:
    """Largest absolute entry of the projected rows' covariance less the identity; null without components."""
    there = np.flatnonzero(model.values > 0)
    k = len(there)
    if not k:
        return None

    def merge(a, b):
        (n, p, v), (m, q, w) = ((x[0], _array(x[1]), _array(x[2]).reshape(k, k)) for x in (a, b))
        step = q - p
        return n + m, (p + step * (m / (n + m))).tobytes(), (v + w + np.outer(step, step) * (n * m / (n + m))).tobytes()

    def partial(batches):
        got = None
        for _, x in _each(batches, d):
            z = model.project(x)[:, there]
            mean = z.mean(axis=0)
            y = z - mean
            new = len(z), mean.tobytes(), (y.T @ y).tobytes()
            got = new if got is None else merge(got, new)
        if got:
            yield got

    n, _, total = _gather(vectors.select("vector"), "n long, mean binary, total binary", partial, merge)
    return float(np.abs(_array(total).reshape(k, k) / n - np.eye(k)).max())


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_digits string"
)


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component (numbered from 1): see ``SCHEMA``."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings, column)
    lengths = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], SCHEMA)
    d = lengths.d
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; the driver solves for {DIMENSIONS} at most")
    vectors = vectors.filter(F.size("vector") == d)
    model = fit(vectors, d, components)
    error = identity_error(vectors, d, model)
    k, schema = len(model.values), pa_schema(SCHEMA)
    share = spark.sparkContext.broadcast(model)  # d * components doubles

    def run(batches):
        m = share.value
        for b, x in _each(batches, d):
            dev, rows = m.deviation(x), len(x)
            z = m.project(x).ravel()
            none = np.tile(m.values <= 0, rows)
            each = np.repeat(np.arange(rows), k)
            exact = pa.array(list(map(str, dev))).take(pa.array(each))
            longs = pa.array([v if v < _LONG else None for v in dev], pa.int64()).take(pa.array(each))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, m.n)), longs, pa.array(z, mask=none), pa.array(m.explained * rows, pa.float64()),
                 pa.array([error] * (rows * k), pa.float64()), exact], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(frugal(run), SCHEMA)
