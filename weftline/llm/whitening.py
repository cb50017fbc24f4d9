"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are never decomposed in one place.  A pass over them gives the Gram matrix of the rows as they
are orthogonalised so far; its Cholesky factor R joins the ones before it, and the next pass sends the rows through
one more triangular solve.  The first Gram matrix is shifted, so that it has a factor however ill-conditioned the
rows are.  When the rows come out orthonormal, A = Q R for the composed R, and the singular values and right
singular vectors of that small R are those of A.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import summed

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries of this size and more count as not finite; their integers would not be exact in a double.
LIMIT = float(1 << 42)
#: Entries that a task works on at once.
BLOCK = 1 << 20
#: The shift of the first Gram matrix is at most this share of its trace.
MOST_SHIFT = 1e-8
#: Passes at most, and how near to orthonormal the rows must be before the last factor.
PASSES, NEAR = 6, 1e-8
#: Singular values below this share of the largest are zero: directions in which the rows do not differ.
NIL = 1e-10


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: the number and sums of the rows, and their components by falling variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # a unit vector in each row
    variances: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ self.components[:k].T / np.sqrt(self.variances[:k])


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x minus the mean, to full precision: the whole part of the mean goes in integers."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole).astype(float) - np.array([s % n for s in sums], dtype=float) / n


def usable(embeddings: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, v): the rows whose vector is there, not empty, and holds finite numbers only."""
    v = F.col(f"`{column}`").cast("array<double>")
    df = embeddings.select(F.col(f"`{key}`").cast("long").alias(key), v.alias("v"))
    return df.where((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False))))


def _blocks(batch: pa.RecordBatch, dim: int):
    """(first row, integers of the rows) in blocks of a bounded number of entries."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    step = max(1, BLOCK // dim)
    for at in range(0, len(flat), step):
        yield at, np.floor(flat[at : at + step] * SCALE).astype(np.int64) + OFFSET


def _solve(y: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """y times the inverse of an upper triangular factor, column by column."""
    out = np.empty_like(y)
    for j in range(y.shape[1]):
        out[:, j] = (y[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix; a larger shift where rounding leaves it without one."""
    eye = np.eye(len(gram))
    while True:
        try:
            return np.linalg.cholesky(gram + shift * eye).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).eps * np.trace(gram))


def fit(rows: DataFrame, dim: int) -> Whitening | None:
    """Learn from all rows of ``usable`` that have ``dim`` entries; None if there are none, or if all are equal."""

    def totals(batch):  # sums of the high and the low part of each entry: neither overflows
        out = np.zeros(1 + 2 * dim, dtype=np.int64)
        for _, x in _blocks(batch, dim):
            out += np.concatenate([[len(x)], (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)])
        return out

    found = summed(rows, totals, np.int64)
    if found is None:
        return None
    n = int(found[0])
    sums = tuple((int(a) << 20) + int(b) for a, b in zip(found[1 : dim + 1], found[dim + 1 :]))
    factors: list[np.ndarray] = []

    def gram(batch):
        out = np.zeros(dim * dim)
        for _, x in _blocks(batch, dim):
            y = _centred(x, n, sums)
            for factor in factors:
                y = _solve(y, factor)
            out += (y.T @ y).ravel()
        return out

    for number in range(PASSES):
        g = summed(rows, gram).reshape(dim, dim)
        if not np.trace(g):
            return None
        share = min(MOST_SHIFT, 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2)
        factors.append(_factor(g, share * np.trace(g) if number == 0 else 0.0))
        if np.abs(g - np.eye(dim)).max() <= NEAR:
            break
    composed = factors[0]
    for factor in factors[1:]:
        composed = factor @ composed
    _, singular, right = np.linalg.svd(composed)
    keep = singular > NIL * singular[0]
    singular, right = singular[keep], right[keep]
    largest = np.abs(right).argmax(axis=1)
    right = right * np.sign(right[np.arange(len(right)), largest])[:, None]
    squares = singular**2
    return Whitening(n, sums, right, squares / n, squares / squares.sum())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """For each row the exact sum of (n x - S)^2; None where that does not fit in 64 bits."""
    most = max(int(np.abs(x).max()) * n + max(map(abs, sums)), 1)
    if most < 1 << 62 and len(sums) * most * most < 1 << 63:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    exact = [sum((n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in x - whole]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(embeddings: DataFrame, k: int = 8, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), up to ``k`` rows for each usable vector.

    All usable vectors are the fit list.  Vectors that are null, empty or hold null or non-finite entries (or
    entries of 2^42 and more) are dropped, and so are those of another length than the commonest one (of equally
    common ones the shortest).  Repeated rows count, and come out, as often as they occur; a null key stays null.
    Directions without variance are no components: equal vectors, or a single one, give no rows, and an empty table
    none.  Equal variances leave the choice of their components open.  A deviation beyond 64 bits is null.
    Components have their largest entry positive.  Other columns are ignored.
    """
    spark = embeddings.sparkSession
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(embeddings, column, key)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    model = None
    if common:
        dim = common["dim"]
        rows = rows.where(F.size("v") == dim)
        model = fit(rows, dim)
    if model is None:
        return spark.createDataFrame([], schema)
    k = min(k, len(model.variances))

    def moments(batch):
        out = np.zeros(1 + k + k * k)
        for _, x in _blocks(batch, dim):
            w = model.whitened(x, k)
            out += np.concatenate([[len(w)], w.sum(axis=0), (w.T @ w).ravel()])
        return out

    found = summed(rows, moments)
    mean = found[1 : k + 1] / found[0]
    error = float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.outer(mean, mean) - np.eye(k)).max())

    def out(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for at, x in _blocks(batch, dim):
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(at, m).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, dtype=np.int64)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x, k).ravel()), pa.array(np.tile(model.explained[:k], m)), pa.array(np.full(m * k, error)),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)
