"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors become whole numbers x, floor(scale * c) + SHIFT. The fit list has each distinct vector once. Its sums, and its
scatter about the mean rounded to whole numbers, are sums of whole numbers: exact, and the same in whatever order tasks
end. The covariance V of d dimensions is the scatter, mended for the rounding and rounded to doubles once. Pivoted
Cholesky gives V = L L^T (rows of L in their old order), one-sided Jacobi turns the columns of L until they are
orthogonal: their squared norms are the eigenvalues of V, the normalised columns its unit eigenvectors.

What reaches the driver are d sums and d * d products, whatever the number of rows.

Vectors that are null or hold null or non-finite entries take no part. Vectors of different lengths are spaces of their
own, each with its own fit list. Entries beyond 2**61 / scale count as that. A component without variance to double
precision is none: equal vectors, a single vector, empty vectors and an empty table give no rows. A null id keeps its
rows, a repeated row gives its rows each time. deviation is null where it exceeds 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ready, table, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block of products, and sweeps of Jacobi at most (about ten are needed).
BLOCK, SWEEPS = 1024, 60
_EDGE = 2.0**61


@dataclasses.dataclass
class Fit:
    n: int
    sums: list[int]  # of x over the fit list
    values: np.ndarray  # falling eigenvalues of the covariance, those above zero
    vectors: np.ndarray  # a unit eigenvector in each column
    trace: float

    @property
    def center(self) -> np.ndarray:
        """The mean, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times the mean less n times the center."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, self.center)], object)

    def whiten(self, x: np.ndarray, most: int) -> np.ndarray:
        """Rows of x on the first components, over the square roots of their eigenvalues."""
        centred = (x - self.center).astype(np.float64) - self.rest.astype(np.float64) / self.n
        return centred @ (self.vectors[:, :most] / np.sqrt(self.values[:most]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sums) ** 2, in whole numbers."""
        y = x - self.center
        widest = self.n * int(np.abs(y).max(initial=0)) + self.n
        if widest * widest * max(1, x.shape[1]) < 2**63:
            d = self.n * y - self.rest.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * y.astype(object) - self.rest
        return [v if v < 2**63 else None for v in (d * d).sum(1).tolist()]


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L^T, by the largest remaining diagonal entry first; it has as many columns as `a` has rank. The
    rows of L without their pivots' order are a triangle."""
    a = a.copy()
    d = len(a)
    left = a.diagonal().copy()
    floor = left.max(initial=0.0) * d * np.finfo(float).eps
    out = np.zeros((d, d))
    done = np.zeros(d, bool)
    for k in range(d):
        p = int(np.where(done, -np.inf, left).argmax())
        if left[p] <= floor:
            return out[:, :k]
        column = (a[:, p] - out[:, :k] @ out[p, :k]) / np.sqrt(left[p])
        column[done] = 0.0
        column[p] = np.sqrt(left[p])
        out[:, k] = column
        done[p] = True
        left -= column * column
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared column norms, falling, and normalised columns of the factor after its columns are turned orthogonal, pair by
    pair. Disjoint pairs are turned at once, in the rounds of a tournament."""
    g = factor.copy()
    n = g.shape[1]
    if n == 0:
        return np.zeros(0), g
    seats = np.arange(n + n % 2)  # of an odd number one sits out
    limit = len(g) * np.finfo(float).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            play = (p < n) & (q < n)
            p, q = p[play], q[play]
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(ab) / np.sqrt(np.maximum(aa * bb, np.finfo(float).tiny))
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > limit
            if turn.any():
                p, q, a, b, aa, bb, ab = p[turn], q[turn], a[:, turn], b[:, turn], aa[turn], bb[turn], ab[turn]
                zeta = (bb - aa) / (2 * ab)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.sqrt(1 + t * t)
                g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= limit:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    values = values[order]
    return values, g[:, order] / np.sqrt(values)


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, dim, x) of the vectors that take part."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where("v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.greatest(F.least(c * float(scale), F.lit(_EDGE)), F.lit(-_EDGE))
    return rows.select("id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(held(c)) + F.lit(shift).cast("long")).alias("x"))


def _matrices(batch: pa.RecordBatch):
    """(dim, positions, rows as a matrix) of a batch with the columns dim and x."""
    dims, x = batch.column("dim").to_numpy(), batch.column("x")
    flat, starts = x.flatten().to_numpy(), np.cumsum(dims) - dims
    for dim in np.unique(dims).tolist():
        which = np.flatnonzero(dims == dim)
        yield dim, which, flat[starts[which][:, None] + np.arange(dim)]


def _products(y: np.ndarray) -> np.ndarray:
    """y^T y in whole numbers, by doubles as long as these hold every sum."""
    widest = int(np.abs(y).max(initial=0))
    if widest * widest * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if widest * widest * len(y) < 2**63:
        return y.T @ y
    y = y.astype(object)
    return y.T @ y


def _sum(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """a + b, beyond 64 bits where need be."""
    if a is None:
        return b
    if a.dtype == b.dtype == np.int64 and max(int(np.abs(a).max()), int(np.abs(b).max())) >= 2**62:
        a = a.astype(object)
    return a + b


def _scatter(listed: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """(dim, i, j, v): the products of the fit list about the centers, of each task."""
    shared = listed.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for dim, _, x in _matrices(batch.slice(at, BLOCK)):
                    if dim:
                        sums[dim] = _sum(sums.get(dim), _products(x - shared.value[dim]))
        for dim, s in sums.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(v)) for v in s[i, j]], pa.decimal128(38, 0))], ["dim", "i", "j", "v"])

    return listed.mapInArrow(run, "dim int, i int, j int, v decimal(38,0)")


def fit(rows: DataFrame) -> tuple[dict[int, Fit], DataFrame]:
    """The fit of each length of vectors, and the fit list (dim, x), written. rows: dim, x."""
    ready(rows.sparkSession)
    listed = written(rows.select("dim", "x").distinct(), "whitening-list")
    entries = listed.select("dim", F.posexplode("x").alias("i", "v")).groupBy("dim", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in entries.collect():  # one row for each dimension
        sums.setdefault(r.dim, {})[r.i] = (r.n, int(r.s))
    fits = {dim: Fit(of[0][0], [of[i][1] for i in range(dim)], np.zeros(0), np.zeros((dim, 0)), 0.0) for dim, of in sums.items()}
    products = _scatter(listed, {dim: f.center for dim, f in fits.items()}).groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    exact = {dim: np.zeros((dim, dim), object) for dim in fits}
    for r in products.collect():  # one row for each pair of dimensions
        exact[r.dim][r.i, r.j] = exact[r.dim][r.j, r.i] = int(r.v)
    for dim, f in fits.items():
        scatter = f.n * exact[dim] - np.outer(f.rest, f.rest)  # n * n times the covariance
        v = np.array([[float(x) for x in row] for row in scatter]) / float(f.n) ** 2
        f.values, f.vectors = one_sided_jacobi(pivoted_cholesky(v))
        f.trace = float(sum(scatter.diagonal())) / float(f.n) ** 2
    return fits, listed


def _identity_error(listed: DataFrame, fits: dict[int, Fit], most: int) -> dict[int, float]:
    """The largest absolute entry of the covariance of the whitened fit list less the identity."""
    shared = listed.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch):
                if dim:
                    # the fit list is centred; a column of ones carries what rounding leaves of its mean
                    z = np.concatenate([shared.value[dim].whiten(x, most), np.ones((len(x), 1))], 1)
                    sums[dim] = sums.get(dim, 0.0) + z.T @ z
        for dim, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["dim", "i", "j", "v"])

    error: dict[int, float] = {}
    sums = {dim: np.zeros((f.vectors[:, :most].shape[1] + 1,) * 2) for dim, f in fits.items()}
    for r in listed.mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.dim][r.i, r.j] = sums[r.dim][r.j, r.i] = r.v
    for dim, s in sums.items():
        mean = s[-1, :-1] / fits[dim].n
        cov = s[:-1, :-1] / fits[dim].n - np.outer(mean, mean)
        error[dim] = float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))
    return error


def whitened(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and each of its `most` largest components: the id, component (from 1), n (of the fit list),
    deviation, whitened, explained (share of the variance) and identity_error (of all its components)."""
    rows = whole(vectors, id_col, vector_col, scale, shift)
    fits, listed = fit(rows)
    error = _identity_error(listed, fits, most)
    shared = vectors.sparkSession.sparkContext.broadcast((fits, error))

    def run(batches):
        known, wrong = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for dim, which, x in _matrices(part):
                    f = known.get(dim)
                    k = f.vectors[:, :most].shape[1] if f else 0
                    if k:
                        m = len(which)
                        share = f.values[:k] / f.trace
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(pa.array(np.repeat(which, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)), pa.array([d for d in f.deviations(x) for _ in range(k)], pa.int64()),
                             pa.array(f.whiten(x, most).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, wrong[dim]))],
                            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                        )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
