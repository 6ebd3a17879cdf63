"""Embedding whitening by mixed-precision refinement (operator 13).

The covariance is gathered by Spark: every task multiplies its own block of
centred vectors, and the rows of these products are summed by key.  Only one
matrix for each vector length reaches the driver; its size is the square of
the length, whatever the number of vectors.  Its eigenvectors are found in
float32 and corrected there by Ogita-Aishima iterations (matrix products only)
in extended precision; eigenvalues too close for that are told apart by a
sub-solve of the shifted matrix of their subspace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ship, written

#: Grid of the vectors: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Grid values beyond this are held at it.
LARGEST = 1 << 61
#: Matrices up to this order are refined in extended precision, larger ones in float64.
EXTENDED = 768
_ID, _X = "__whiten_id", "__whiten_x"


# ---- eigenvectors of one symmetric matrix

def eigenpairs(a: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Starts from float32 eigenvectors.  A step corrects x by x @ e, where
    e_ij = (s_ij + l_j r_ij) / (l_j - l_i) for eigenvalues that stand apart,
    with r = 1 - x'x and s = x'ax; it converges quadratically.  It is written
    here as r_ij / 2 and a rest that is antisymmetric, so that rounding cannot
    harm the orthogonality.  Close ones get the r_ij / 2 only; their cluster's
    matrix, shifted by its mean, is then solved by this function again.
    """
    n = len(a)
    high = np.longdouble if n <= EXTENDED else np.float64
    a = np.asarray(a, high)
    a = (a + a.T) / 2
    size = float(np.abs(a).max()) if n else 0.0
    if n < 2 or not size:
        return np.diag(a).copy(), np.eye(n, dtype=high)
    x = np.linalg.eigh((a / size).astype(np.float32))[1].astype(high)
    one, small = np.eye(n, dtype=high), float(np.finfo(high).eps) * n
    norm = np.sqrt((a * a).sum())
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = np.sqrt(((s - np.diag(np.diag(s))) ** 2).sum())
        if np.abs(r).max() <= small and off <= small * norm:
            break
        omega = max(2 * (off + norm * np.sqrt((r * r).sum())), norm * np.sqrt(small))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= omega
        turn = (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(near, 1, gap)
        x = x + x @ (r / 2 + np.where(near, 0, turn))
        if np.abs(one - x.T @ x).max() <= 1e-7:
            for g in (g for g in _clusters(values, omega) if len(g) > 1):
                part = x[:, g]
                inner = part.T @ (a @ part - values[g].mean() * part)
                if np.abs(inner - np.diag(np.diag(inner))).max() > small * norm / 4:
                    x[:, g] = part @ eigenpairs(inner, steps)[1]
    x = x @ (one * 3 - x.T @ x) / 2
    values = np.diag(x.T @ a @ x) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.sqrt((x * x).sum(axis=0))[order]


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Indices of eigenvalues in chains whose neighbours are at most ``near`` apart."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order]) > near) + 1)


# ---- what Spark gathers

@dataclass(frozen=True)
class Fit:
    """Of the distinct vectors of one length: how many, integer centre, exact rest S - n * centre, and the model."""

    n: int
    centre: np.ndarray
    rest: list[int]
    axes: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float | None = None

    @property
    def delta(self) -> np.ndarray:
        return np.array([float(Fraction(r, self.n)) for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the integer part exactly, then the rest, which is half at most."""
        return (x - self.centre).astype(np.float64) - self.delta

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly; null beyond a long."""
        y = x - self.centre
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 62:
            d = y * self.n - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        found = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y]
        return [v if v < 1 << 63 else None for v in found]


def grid(vector: Column) -> Column:
    """x = floor(64 c) + 1000000 of each entry, in double and then long."""
    on_grid = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)) + SHIFT
    return F.transform(vector, on_grid)


def taking_part(vector: Column) -> Column:
    """Vectors that are there, have entries, and of which every entry is finite."""
    finite = lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c), F.lit(False))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch cut into parts of one vector length, with their vectors as a matrix."""
    for batch in batches:
        lengths = pc.list_value_length(batch[column])
        for d in pc.unique(lengths).to_pylist():
            part = batch.filter(pc.equal(lengths, d))
            yield part, part[column].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length: number of vectors and exact sums, gathered as two halves so that no long overflows."""
    def run(batches):
        found = {}
        for _, x in _blocks(batches, _X):
            got = found.setdefault(x.shape[1], [0, 0, 0])
            got[0], got[1], got[2] = got[0] + len(x), got[1] + (x >> 31).sum(axis=0), got[2] + (x & 0x7FFFFFFF).sum(axis=0)
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int64()), "i": pa.array(range(d), pa.int64()), "n": pa.array([n] * d, pa.int64()), "high": pa.array(high), "low": pa.array(low)})

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.mapInArrow(run, "d long, i long, n long, high long, low long").groupBy("d", "i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: r["i"]):
        out.setdefault(r["d"], (r["n"], []))[1].append((int(r["high"]) << 31) + int(r["low"]))
    return out


def _products(fit: DataFrame, width: dict[int, int], block) -> dict[int, np.ndarray]:
    """Sum of block(d, x)' block(d, x) over all vectors, for each length d.

    A task gives the rows of its own product; rows of one number meet in one
    task, which adds them up one after another.
    """
    def multiply(batches):
        found: dict[int, np.ndarray] = {}
        for _, x in _blocks(batches, _X):
            y = block(x.shape[1], x)
            found[x.shape[1]] = found.get(x.shape[1], 0) + y.T @ y
        for d, g in found.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(g), pa.int64()), "i": pa.array(range(len(g)), pa.int64()), "g": pa.array(list(g), pa.list_(pa.float64()))})

    def add(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, g in zip(batch["d"].to_pylist(), batch["i"].to_pylist(), batch["g"], strict=True):
                found[d, i] = found.get((d, i), 0) + g.values.to_numpy()
        if found:
            yield pa.RecordBatch.from_pydict({"d": pa.array([k[0] for k in found], pa.int64()), "i": pa.array([k[1] for k in found], pa.int64()), "g": pa.array(list(found.values()), pa.list_(pa.float64()))})

    shape = "d long, i long, g array<double>"
    out = {d: np.zeros((k, k)) for d, k in width.items()}
    for r in fit.mapInArrow(multiply, shape).repartition("d", "i").mapInArrow(add, shape).collect():
        out[r["d"]][r["i"]] = r["g"]
    return out


def fitted(vectors: DataFrame, components: int = 16, vector_col: str = "embedding") -> dict[int, Fit]:
    """For each vector length the whitening of its distinct grid vectors.

    The axes are those of the largest eigenvalues; axes along which the
    vectors do not vary (eigenvalue 0, up to rounding) cannot be whitened and
    are left out.
    """
    ship(vectors.sparkSession)
    fit = written(vectors.where(taking_part(F.col(vector_col))).select(grid(F.col(vector_col)).alias(_X)).distinct(), "whiten-fit")
    fits = {}
    for d, (n, sums) in _sums(fit).items():
        centre = [round(Fraction(s, n)) for s in sums]
        fits[d] = Fit(n, np.array(centre, np.int64), [s - n * c for s, c in zip(sums, centre, strict=True)])
    whole = {d: (f.n, f.centre) for d, f in fits.items()}
    products = _products(fit, {d: d for d in fits}, lambda d, x: (x - whole[d][1]).astype(np.float64))
    models = {}
    for d, f in fits.items():
        delta = np.array([np.longdouble(r) / f.n for r in f.rest])
        v = products[d].astype(np.longdouble) / f.n - np.outer(delta, delta)
        values, axes = eigenpairs(v)
        trace = np.diag(v).sum()
        k = int((values[:components] > 64 * np.finfo(float).eps * max(trace, 0)).sum())
        models[d] = Fit(f.n, f.centre, f.rest, axes[:, :k].astype(float), values[:k].astype(float), (values[:k] / (trace or 1)).astype(float))
    again = _products(fit, {d: len(m.values) + 1 for d, m in models.items()}, lambda d, x: np.column_stack([models[d].whitened(x), np.ones(len(x))])) if models else {}
    return {d: Fit(m.n, m.centre, m.rest, m.axes, m.values, m.explained, _identity_error(again[d], m.n)) for d, m in models.items()}


def _identity_error(g: np.ndarray, n: int) -> float:
    """Largest entry of the covariance minus the identity; the last row of g holds the sums."""
    mean = g[-1, :-1] / n
    return float(np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one for each vector and component.

    Vectors that are null, empty, or hold a null or a non-finite entry take no
    part.  Ids may be null or repeated: every row is whitened.  Vectors of
    different lengths have a fit of their own each.  A fit of one distinct
    vector, or of fewer than there are dimensions, has fewer components: those
    whose eigenvalue is not 0.  Grid values are held within 2^61; a deviation
    beyond a long is null.  An empty table gives no rows; other columns are not
    looked at.
    """
    models = fitted(vectors, components, vector_col)
    rows = vectors.where(taking_part(F.col(vector_col))).select(F.col(id_col).alias(_ID), grid(F.col(vector_col)).alias(_X))

    def run(batches):
        for part, x in _blocks(batches, _X):
            m = models[x.shape[1]]
            k, each = len(m.values), len(x)
            if k:
                take = np.repeat(np.arange(each), k)
                yield pa.RecordBatch.from_pydict({
                    _ID: part[_ID].take(pa.array(take)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), each)), "n": pa.array(np.full(each * k, m.n)),
                    "deviation": pa.array(m.deviation(x), pa.int64()).take(pa.array(take)), "whitened": pa.array(m.whitened(x).ravel()),
                    "explained": pa.array(np.tile(m.explained, each)), "identity_error": pa.array(np.full(each * k, m.error)),
                })

    kind = rows.schema[_ID].dataType.simpleString()
    out = rows.mapInArrow(run, f"{_ID} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed(_ID, id_col)
