"""Embedding whitening: vectors projected on the leading eigenvectors of their covariance, each scaled to unit variance.

The covariance is exact: vectors are whole numbers, their mean is rounded to whole numbers before rows are centred and
multiplied, and sums of products stay integers up to the one division at the end. Its leading eigenvalues are found by
spectrum slicing: the inertia of an LDL' factorisation of the shifted covariance counts the eigenvalues above the
shift, bisection on that count isolates one eigenvalue, Rayleigh quotient iteration converges to it, and two more counts
at both sides of the result certify its number; where they disagree the interval is cut further.

Rows are touched by Spark tasks only. What reaches the driver is a number for each pair of dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, tidy, written
from .vectors import integers, matrix, padded, usable

SCALE = 256
COMPONENTS = 4
_EXACT = 1 << 53  # whole numbers below it are exact as doubles
_ALPHA = (1 + math.sqrt(17)) / 8  # of Bunch and Parlett: which pivots hold growth down


@dataclass
class Whitening:
    """n different vectors of `dims` entries with sums `sums`; eigenvalues falling, a unit vector in each column of vectors;
    trace: of the covariance; identity_error: the largest entry of the whitened vectors' covariance minus the identity.
    """

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        """The mean, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64) if self.n else np.zeros(self.dims, np.int64)

    @property
    def rest(self) -> list[int]:
        """The sums of the vectors after `centre` was taken away."""
        return [s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)]

    @property
    def weights(self) -> np.ndarray:
        """A column for each component: its vector over the root of its eigenvalue; not a number where it has no variance."""
        floor = self.dims * np.finfo(float).eps * max(self.trace, 0.0)
        return self.vectors / np.sqrt(np.where(self.values > floor, self.values, np.nan))

    def project(self, rows: np.ndarray) -> np.ndarray:
        shift = np.array([r / self.n for r in self.rest]) if self.n else np.zeros(self.dims)
        return ((rows - self.centre) - shift) @ self.weights

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The sum of (n * x - sum)^2 over a row's entries, exact; None beyond a long."""
        y, n = rows - self.centre, self.n
        top = n * int(np.abs(y).max(initial=0)) + max((abs(r) for r in self.rest), default=0)
        if top * top * max(1, self.dims) < 1 << 63:
            return ((n * y - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        wide = ((n * y.astype(object) - np.array(self.rest, object)) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in map(int, wide)]


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix lie above shift: positive pivots of an LDL' factorisation of a - shift.

    Pivots are chosen from the whole rest; one of two rows always has one positive and one negative eigenvalue.
    """
    m, found = a - shift * np.eye(len(a)), 0
    while len(m):
        size = np.abs(m)
        own = int(size.diagonal().argmax())
        r, s = divmod(int((size - np.diag(size.diagonal())).argmax()), len(m))
        if size[own, own] >= _ALPHA * size[r, s]:
            if not m[own, own]:
                break
            found += m[own, own] > 0
            keep = np.delete(np.arange(len(m)), own)
            m = m[np.ix_(keep, keep)] - np.outer(m[keep, own], m[own, keep]) / m[own, own]
        else:
            found += 1
            keep = np.delete(np.arange(len(m)), [r, s])
            pair = m[np.ix_([r, s], [r, s])]
            m = m[np.ix_(keep, keep)] - m[np.ix_(keep, [r, s])] @ np.linalg.solve(pair, m[np.ix_([r, s], keep)])
        m = (m + m.T) / 2
    return int(found)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns; each one's largest entry is positive.

    Eigenvalues that differ by no more than rounding count as one of a higher multiplicity; any basis of theirs may come.
    """
    d = len(a)
    scale = float(np.abs(a).sum(1).max(initial=0.0))
    tiny = 4 * d * np.finfo(float).eps * scale
    values, vectors = np.zeros(k), np.zeros((d, k))
    for j in range(k):
        low, high = -scale - tiny, scale + tiny
        while True:
            low, high, alone = _isolated(a, j + 1, low, high, tiny)
            value, vector = _rayleigh(a, (low + high) / 2, vectors[:, :j])
            slack = max(float(np.linalg.norm(a @ vector - value * vector)), tiny)
            if not alone or (above(a, value - slack) > j >= above(a, value + slack) and low - slack <= value <= high + slack):
                break
            middle = (low + high) / 2
            low, high = (middle, high) if above(a, middle) > j else (low, middle)
        vector = vector * np.sign(vector[np.abs(vector).argmax()])
        values[j], vectors[:, j] = value, vector
    return values, vectors


def _isolated(a: np.ndarray, number: int, low: float, high: float, tiny: float) -> tuple[float, float, bool]:
    """An interval that holds eigenvalue `number` from the top; True if no other one lies in it."""
    up, down = above(a, low), above(a, high)
    while up - down > 1 or up < number:
        if high - low <= tiny:
            return low, high, False
        middle = (low + high) / 2
        count = above(a, middle)
        if count >= number:
            low, up = middle, count
        else:
            high, down = middle, count
    return low, high, high - low > tiny


def _rayleigh(a: np.ndarray, shift: float, found: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration after steps of inverse iteration at shift, at right angles to the vectors in found."""
    d, scale = len(a), float(np.abs(a).max(initial=0.0))
    v, value, best = np.random.default_rng(d + found.shape[1]).standard_normal(d), shift, None
    for step in range(40):
        v = v - found @ (found.T @ v)
        v /= np.linalg.norm(v)
        if step > 3 or not scale:
            value = float(v @ a @ v)
            error = float(np.linalg.norm(a @ v - value * v))
            if best is not None and error >= best[0]:
                break
            best = error, value, v
        v = _solved(a, value, v, scale)
    return best[1], best[2]


def _solved(a: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """v times the inverse of a - shift, as a unit vector; where that is singular, of a shift that differs by rounding."""
    nudge = 0.0
    while scale and nudge < scale:
        try:
            w = np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), v)
            if np.isfinite(w).all() and (size := np.linalg.norm(w)) > 0 and np.isfinite(size):
                return w / size
        except np.linalg.LinAlgError:
            pass
        nudge = max(2 * nudge, np.finfo(float).eps * scale)
    return v


def _added(fit_list: DataFrame, cells: int, per_batch, kind: str) -> list:
    """The sums over all rows of the numbers that per_batch makes from a matrix of rows, one for each cell."""

    @tidy
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = per_batch(batch)
                total = part if total is None else total + part
        if total is not None:
            out = pa.array(total.tolist(), pa.float64() if kind == "double" else pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(range(cells), pa.int32()), out], names=["cell", "part"])

    rows = lean(fit_list).mapInArrow(each, f"cell int, part {kind}").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    got = {r.cell: r.part for r in rows}
    return [got.get(i, 0) for i in range(cells)]


def fit(df: DataFrame, vector: str, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Learns from each different vector once. Rows whose vector is null or holds null or a number that is not finite are left
    out; vectors shorter than the longest one count as if they had zeros behind them. Without rows, or with vectors without
    entries alone, there are no components.
    """
    own = F.col(f"`{vector}`")
    rows = df.where(usable(own)).select(integers(own, scale).alias("x"))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return Whitening(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    distinct = written(rows.select(padded(F.col("x"), dims).alias("x")).distinct(), "vectors")
    n = distinct.count()
    sums = [int(s) for s in _added(distinct, dims, lambda b: matrix(b.column(0), dims).sum(0).astype(object), "decimal(38,0)")]
    model = Whitening(dims, n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    centre, upper = model.centre, np.triu_indices(dims)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = matrix(batch.column(0), dims) - centre
        exact = int(np.abs(y).max(initial=0)) ** 2 * len(y) < _EXACT
        y = y.astype(np.float64 if exact else object)
        return np.dot(y.T, y)[upper].astype(np.int64 if exact else object).astype(object)

    squares, rest = _added(distinct, len(upper[0]), products, "decimal(38,0)"), model.rest
    exact = {(i, j): n * int(q) - rest[i] * rest[j] for i, j, q in zip(*map(np.ndarray.tolist, upper), squares, strict=True)}
    cov = np.zeros((dims, dims))
    for (i, j), q in exact.items():
        cov[i, j] = cov[j, i] = q / (n * n)
    model.trace = sum(exact[i, i] for i in range(dims)) / (n * n)
    model.values, model.vectors = leading(cov, min(components, dims))
    varied = np.isfinite(model.weights).all(0)
    k = int(varied.sum())
    if k:

        def moments(batch: pa.RecordBatch) -> np.ndarray:
            z = model.project(matrix(batch.column(0), dims))[:, varied]
            return np.concatenate([z.sum(0), (z.T @ z).ravel()])

        got = np.array(_added(distinct, k + k * k, moments, "double"))
        mean = got[:k] / n
        model.identity_error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def transform(df: DataFrame, model: Whitening, vector: str, out: str = "whitened", deviation: str = "deviation", scale: int = SCALE) -> DataFrame:
    """Adds `out`, the whitened vector (null entries for components without variance), and `deviation`, the exact sum of
    (n * x - sum)^2 over the entries (null beyond a long). Both are null for rows that fit() leaves out. Entries beyond the
    model's dimensions are ignored. Columns already named so are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of dimensions

    @F.arrow_udf("struct<whitened:array<double>,deviation:long>")
    @tidy
    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            there = batch.is_valid().to_numpy(zero_copy_only=False)
            rows = matrix(batch.filter(pa.array(there)), own.dims)
            z, far = own.project(rows), own.deviations(rows)
            flat = pa.array(z.ravel(), mask=~np.isfinite(z.ravel()))
            sizes = np.where(there, z.shape[1], 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(~there, False))
            late = np.full(len(there), None, object)
            late[there] = far
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat), pa.array(late.tolist(), pa.int64())], names=["whitened", "deviation"])

    own, made = F.col(f"`{vector}`"), fresh(df, "_made")
    whole = F.when(usable(own), F.slice(padded_or_cut(integers(own, scale), model.dims), 1, model.dims)) if model.dims else F.lit(None).cast("array<long>")
    both = lean(df).withColumn(made, projected(whole))
    return both.withColumn(out, F.col(made)["whitened"]).withColumn(deviation, F.col(made)["deviation"]).drop(made)


def padded_or_cut(x: Column, dims: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(dims) - F.size(x), F.lit(0))))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of embeddings on the first four components, or on all if there are fewer dimensions.

    Repeated vectors count once in the fit and are all returned; rows that share a vec_id, or have none, are rows of their
    own; shorter vectors have zeros behind them. whitened is null, and explained 0, for a component without variance. An
    empty table gives no rows.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where(usable(F.col("embedding")))
    model = fit(rows, "embedding")
    share = [float(v) / model.trace if model.trace else 0.0 for v in model.values]
    explained = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    each = transform(rows, model, "embedding").select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return each.select(
        "vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("component")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
