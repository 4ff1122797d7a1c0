"""Whitening of embeddings by a matrix-free block Jacobi-Davidson eigensolver.

A vector c becomes whole numbers floor(64 * c) + 1000000. The fit list holds
each distinct one once, in blocks of narrow integers that are written once; every
product with the covariance is one Spark job over these blocks: tasks centre
their rows before they multiply and ship only partial sums of (length, width)
numbers, which Spark adds up. The covariance itself is never formed.

The solver keeps a subspace and the products of its vectors (Rayleigh-Ritz).
Each step solves the projected correction equations of the leading Ritz pairs
that have not converged by a few steps of MINRES, all pairs side by side, so
that an inner step is one distributed product; the corrections widen the
subspace, which is restarted from its best Ritz vectors when it gets wide.
Leading pairs are locked when their residuals reach double precision: LEVEL
units of rounding of the largest eigenvalue, or where they no longer fall below
STALLED. A last Rayleigh-Ritz step over the locked vectors ends it.

Defined results: rows whose vector is null, empty or holds null, non-finite or
entries of 2**40 and more take no part and give no rows; nor do vectors of another length than
most distinct ones have (the shorter on ties). Null and repeated ids are rows
like others; other columns are ignored. Components without variance, which can't
be whitened, give no rows, so one distinct vector or an empty table give none. A
deviation beyond the range of a long is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

COMPONENTS, GUARD, INNER, WIDEST, ROUNDS, SCALE, SHIFT = 16, 4, 6, 6, 60, 64, 1_000_000
BLOCK_BYTES, LARGEST = 1 << 20, float(1 << 40)
LEVEL, STALLED = 16, 1e-12


def _usable(column: pa.Array):
    """(rows, matrix of whole numbers without the shift) for each length among the usable vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are nan
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        whole = len(rows) * d == len(values)
        c = values.reshape(-1, d) if whole else values[starts[rows, None] + np.arange(d)]
        ok = (np.abs(c) < LARGEST).all(1)  # false for nan, too
        yield rows[ok], np.floor(c[ok] * SCALE).astype(np.int64)


def _width(x: np.ndarray) -> np.ndarray:
    """Bytes that each row's largest entry takes: 2, 4 or 8."""
    least, most = x.min(1), x.max(1)
    fits = lambda k: (least >= np.iinfo(k).min) & (most <= np.iinfo(k).max)
    return np.where(fits("i2"), 2, np.where(fits("i4"), 4, 8))


def _codes(it):
    """Vectors as bytes: the width of their integers, then these. Equal vectors have equal bytes."""
    for batch in it:
        for _, x in _usable(batch.column(0)):
            if not len(x):
                continue
            widths = _width(x)
            for w in np.unique(widths):
                part = x[widths == w].astype(f"<i{w}")
                raw = np.empty((len(part), 1 + part.shape[1] * w), np.uint8)
                raw[:, 0], raw[:, 1:] = w, part.view(np.uint8)
                ends = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])], ["code"])


def _blocks(it):
    """(dim, n, width, sums, data): distinct vectors of one length and width together."""
    held: dict[tuple[int, int], list] = {}

    def block(key):
        size, w = key
        x = np.frombuffer(b"".join(held.pop(key)), np.uint8).reshape(-1, size)[:, 1:].copy().view(f"<i{w}")
        sums = pa.array([x.sum(0, dtype=np.int64).tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([w], pa.int32()), sums, pa.array([x.tobytes()], pa.binary())], ["dim", "n", "width", "sums", "data"])

    for batch in it:
        for code in batch.column(0).to_pylist():
            key = (len(code), code[0])
            have = held.setdefault(key, [])
            have.append(code)
            if len(have) * len(code) >= BLOCK_BYTES:
                yield block(key)
    for key in list(held):
        yield block(key)


def fit_list(vectors: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """Each distinct vector of whole numbers once, in blocks."""
    kind = dict(vectors.dtypes)[vector_column]
    vector = F.col(vector_column) if kind in ("array<float>", "array<double>") else F.col(vector_column).cast("array<double>")
    return cut(vectors.select(vector.alias("v")).mapInArrow(_codes, "code binary").distinct().mapInArrow(_blocks, "dim int, n long, width int, sums array<bigint>, data binary"), "fit-list")


class Covariance:
    """The covariance of a fit list as an operator: products are Spark jobs."""

    def __init__(self, blocks: DataFrame):
        sizes = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        self.d, self.n = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (0, 0)
        self.blocks = blocks.filter(F.col("dim") == self.d).select("width", "data")
        sums = blocks.filter(F.col("dim") == self.d).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        self.sums = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]  # of vectors without the shift; exact
        self.low = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])
        self.products = 0

    def _reduced(self, partial, shape: tuple[int, int]) -> np.ndarray:
        """The sum of what partial makes of each block of centred rows, an array of this shape."""
        d, low, rest, cells = self.d, self.low, self.rest, shape[0] * shape[1]

        def run(it):
            total = None
            for batch in it:
                for w, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = np.frombuffer(data.as_buffer(), f"<i{w}").reshape(-1, d)
                    part = partial((x - low).astype(np.float64) - rest)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

        out = np.zeros(cells)
        for r in self.blocks.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            out[r["cell"]] = r["v"]
        self.products += 1
        return out.reshape(shape)

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._reduced(lambda x: x.T @ (x @ v), v.shape) / self.n

    def trace(self) -> float:
        return float(self._reduced(lambda x: (x * x).sum(0, keepdims=True), (1, self.d)).sum() / self.n)

    def of_projections(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the rows' projections on w's columns."""
        k = w.shape[1]

        def partial(x):
            z = x @ w
            return np.concatenate([z.T @ z, z.sum(0, keepdims=True)])

        both = self._reduced(partial, (k + 1, k)) / self.n
        return both[:k] - np.outer(both[k], both[k])


def _orthonormal(t: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """t's columns made orthonormal, and orthogonal to the others; those that depend on them go."""
    kept: list[np.ndarray] = []
    for column in t.T:
        size = np.linalg.norm(column)
        if not size or not np.isfinite(size):
            continue
        v = column / size
        for _ in range(3):
            for q in (*against, *([np.stack(kept, 1)] if kept else [])):
                v = v - q @ (q.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            kept.append(v)
    return np.stack(kept, 1) if kept else np.zeros((len(t), 0))


def minres(product, right: np.ndarray, steps: int, reduce_to: float) -> np.ndarray:
    """Solutions of one symmetric system for each column, by MINRES run side by side: a step is one product with a matrix."""
    beta = np.linalg.norm(right, axis=0)
    x, w_old, w, v_old = (np.zeros_like(right) for _ in range(4))
    alive = beta > 0
    v = np.where(alive, right / np.where(alive, beta, 1), 0)
    eta, first = beta.copy(), beta.copy()
    gamma_old, gamma, sigma_old, sigma = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)
    for _ in range(steps):
        if not (alive & (np.abs(eta) > reduce_to * first)).any():
            break
        p = product(v)
        alpha = (v * p).sum(0)
        new = p - alpha * v - last * v_old
        beta = np.linalg.norm(new, axis=0)
        delta = gamma * alpha - gamma_old * sigma * last
        rho1 = np.hypot(delta, beta)
        rho2 = sigma * alpha + gamma_old * gamma * last
        rho3 = sigma_old * last
        ok = alive & (rho1 > 0)
        safe = np.where(ok, rho1, 1)
        gamma_old, sigma_old = gamma, sigma
        gamma, sigma = np.where(ok, delta / safe, 1), np.where(ok, beta / safe, 0)
        w_old, w = w, np.where(ok, (v - rho3 * w_old - rho2 * w) / safe, 0)
        x = x + np.where(ok, gamma * eta, 0) * w
        eta = np.where(ok, -sigma * eta, eta)
        alive = ok & (beta > 1e-14 * np.abs(alpha))
        v_old, v, last = v, np.where(alive, new / np.where(alive, beta, 1), 0), beta
    return x


def leading_eigenpairs(times, d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residual norms) of the k largest eigenvalues of a symmetric positive operator by block Jacobi-Davidson."""
    k = min(k, d)
    block = min(d, k + GUARD)
    locked, values = np.zeros((d, 0)), []
    v = _orthonormal(np.random.default_rng(seed).standard_normal((d, block)), [])
    av, before, stalled = times(v), np.inf, 0
    for round_ in range(ROUNDS):
        theta, u = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        x, ax = v @ u, av @ u
        scale = max([abs(theta[0]), *values[:1]])
        r = ax - x * theta
        norms = np.linalg.norm(r, axis=0)
        want = k - len(values)
        target = LEVEL * np.finfo(float).eps * scale
        stalled = stalled + 1 if norms[:want].max() > before / 2 else 0
        before = norms[:want].max()
        whole = v.shape[1] + len(values) == d  # the subspace is everything: nothing is left to correct
        fine = norms <= (STALLED * scale if stalled >= 2 else target)
        done = want if whole else int(np.argmin(np.append(fine[:want], False)))
        locked, values = np.concatenate([locked, x[:, :done]], 1), [*values, *theta[:done]]
        v, av, theta, r = x[:, done:], ax[:, done:], theta[done:], r[:, done:]
        want -= done
        if not want:
            break
        if v.shape[1] + len(values) > WIDEST * block:
            keep = 2 * block
            v, av, theta, r = v[:, :keep], av[:, :keep], theta[:keep], r[:, :keep]
        open_ = [j for j in range(want) if np.linalg.norm(r[:, j]) > target] or [0]
        q = np.concatenate([locked, v[:, : want + min(GUARD, v.shape[1] - want)]], 1)
        project = lambda y, q=q: y - q @ (q.T @ y)
        shifts = theta[open_]
        free = d - q.shape[1]
        t = minres(lambda y, project=project, shifts=shifts: project(times(y) - y * shifts), -project(r[:, open_]), min(INNER, free), 2.0 ** -(round_ + 1)) if free else np.zeros((d, 0))
        new = _orthonormal(project(project(t)), [locked, v])
        if not new.shape[1]:  # corrections are lost in rounding: go on with any other direction
            new = _orthonormal(np.random.default_rng([seed, round_]).standard_normal((d, 1)), [locked, v])
        v, av = np.concatenate([v, new], 1), np.concatenate([av, times(new)], 1)
    else:
        raise ArithmeticError(f"{k - len(values)} eigenpairs have not converged in {ROUNDS} rounds")
    a = times(locked)
    theta, u = np.linalg.eigh((locked.T @ a + a.T @ locked) / 2)
    theta, u = theta[::-1], u[:, ::-1]
    x = np.linalg.qr(locked @ u)[0]
    x = x * np.where((x * (locked @ u)).sum(0) < 0, -1, 1)
    return theta, x, np.linalg.norm(a @ u - x * theta, axis=0)


def _projected(low, rest, w, n: int, sums: list[int]):
    """(id, deviation, whitened) of every usable row of the fitted length."""
    d = len(low)
    margin = 9.2e18

    def run(it):
        for batch in it:
            for rows, x in _usable(batch.column(1)):
                if x.shape[1] != d or not len(rows):
                    continue
                far = x - low
                z = (far.astype(np.float64) - rest) @ w
                away = far.astype(np.float64) * n - np.array([float(s % n) for s in sums])
                fits = (away**2).sum(1) < margin
                exact = far * np.int64(n) - np.array([s % n for s in sums], np.int64)  # overflows only where it does not fit
                deviation = pa.array(np.where(fits, (exact * exact).sum(1), 0), pa.int64(), mask=~fits)
                ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviation, pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], ["id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, residual) of every usable row and component."""
    covariance = Covariance(fit_list(vectors, vector_column))
    schema = f"{id_column} long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    total = covariance.trace() if covariance.n else 0.0
    if not total > 0:
        return vectors.sparkSession.createDataFrame([], schema)
    values, axes, residuals = leading_eigenpairs(covariance.times, covariance.d, components)
    real = values > covariance.d * np.finfo(float).eps * values[0]
    values, axes, residuals = values[real], axes[:, real], residuals[real]
    w = axes / np.sqrt(values)
    error = float(np.abs(covariance.of_projections(w) - np.eye(len(values))).max())
    kind = dict(vectors.dtypes)[vector_column]
    vector = F.col(vector_column) if kind in ("array<float>", "array<double>") else F.col(vector_column).cast("array<double>")
    z = vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("v")).mapInArrow(_projected(covariance.low, covariance.rest, w, covariance.n, covariance.sums), "id long, deviation long, whitened array<double>")
    per = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    each = z.select(F.col("id").alias(id_column), "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        id_column, (F.col("i") + 1).cast("int").alias("component"), F.lit(covariance.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(per(values / total), F.col("i")).alias("explained"), F.lit(error).alias("identity_error"), F.get(per(residuals / values[0]), F.col("i")).alias("residual"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
