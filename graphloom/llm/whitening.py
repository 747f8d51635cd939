"""Whitening of embeddings by their leading principal components, found matrix-free by Jacobi-Davidson.

The covariance is never formed.  Vectors are packed into blocks once; a product of the covariance with a few columns is one
Spark job over the blocks: every task centres its blocks, multiplies twice and sends (dimensions x columns) partial sums.
The driver holds columns of the length of a vector only, SUBSPACE times the block's at most, whatever the number of rows:

- Rayleigh-Ritz in the search space gives Ritz pairs and residuals;
- leading pairs whose residual is at double precision are locked, and the search goes on in their complement;
- for the others, projected correction equations (I - QQ')(V - theta I)(I - QQ') t = -r are solved by a few steps of MINRES,
  all columns in step, so that one job multiplies them all; Q holds the locked vectors and the pairs at work;
- the solutions expand the search space, which restarts from its best Ritz vectors when it is full.

Some pairs more than asked for are iterated (GUARD), and the end is confirmed by a fresh Rayleigh-Ritz step on the locked
vectors and by Ritz values outside them, so that no larger eigenvalue is passed over.

Defined cases: vectors that are null, or hold null or non-finite entries, take no part, nor do those with an entry whose whole
number no long holds (1024 c beyond 2**63); of vectors of several lengths the most frequent length takes part (of equally
frequent ones the largest), empty vectors never; repeated rows count each time; a null vec_id stays null; components with no
variance beyond rounding (fewer distinct vectors than dimensions, constant vectors, a single row) are left out, so there may
be fewer than asked for, and no row at all; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, stored

Product = Callable[[np.ndarray], np.ndarray]
EPS = float(np.finfo(np.float64).eps)
#: Pairs iterated beyond those asked for, the search space as a multiple of the block, steps of MINRES at most, and outer steps at most.
GUARD, SUBSPACE, INNER, OUTER = 8, 4, 6, 200
#: A residual of so many roundings of the largest eigenvalue is at double precision; MINRES stops at this part of a residual.
REACHED, LEAST_GOAL = 32, 1e-3


# vectors as blocks of whole numbers


@dataclass(frozen=True)
class Fit:
    """The fit list: packed blocks, number of rows, sums per dimension."""

    blocks: DataFrame
    n: int
    sums: list[int]

    @property
    def base(self) -> np.ndarray:
        """The means rounded down: x - base is exact."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what the means have beyond base: 0 <= rest < n."""
        return np.array([s % self.n for s in self.sums], dtype=np.int64)


def whole_blocks(rows: DataFrame, *, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """ids, n, x, sums: blocks of vectors as whole numbers floor(scale * c) + shift, x as little-endian longs row by row."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < 9.2e18)  # noqa: E731 - infinite ones don't fit either
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
    top = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = top["dims"] if top else 1

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.floor(scale * c).astype(np.int64) + shift
            sums = x.sum(axis=0) if np.abs(x, dtype=np.float64).max() * len(x) < 2**62 else x.astype(object).sum(axis=0)
            columns = [pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([len(x)], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([[int(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "n", "x", "sums"])

    bounded_batches(rows)
    return rows.filter(F.size("v") == dims).mapInArrow(pack, "ids array<long>, n int, x binary, sums array<decimal(38,0)>")


def fit(rows: DataFrame, **settings) -> Fit:
    blocks = stored(whole_blocks(rows, **settings))
    sums = blocks.select("n", F.posexplode("sums").alias("dim", "value")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()
    sums.sort(key=lambda r: r["dim"])
    return Fit(blocks, sums[0]["n"] if sums else 0, [int(r["value"]) for r in sums])


def _matrix(x: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(x, dtype="<i8").reshape(-1, dims)


def _cells(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums of (cell, value) rows as a matrix: shape[0] * shape[1] rows, whatever the input."""
    sums = df.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[sums["cell"].to_numpy()] = sums["value"].to_numpy()
    return out.reshape(shape)


def _send(total: np.ndarray):
    flat = total.reshape(-1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["cell", "value"])


def covariance_product(data: Fit) -> Product:
    """W -> V W: a job for each call."""
    base, part = data.base, data.rest / data.n

    def product(w: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros_like(w)
            for batch in batches:
                for x in batch.column(0):
                    centred = (_matrix(x.as_py(), len(base)) - base) - part
                    total += centred.T @ (centred @ w)
            yield from _send(total)

        return _cells(data.blocks.select("x").mapInArrow(run, "cell int, value double"), w.shape) / data.n

    return product


# eigenpairs, on the driver: columns as long as a vector


def _orthonormal(new: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """new without its parts in known, orthonormal; columns that vanish are left out."""
    for _ in range(2):
        for k in known:
            new = new - k @ (k.T @ new)
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for k in (*known, out):
                column = column - k @ (k.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10 * size and left > 0:
            out = np.column_stack([out, column / left])
    return out


def minres(apply: Product, rhs: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Columns t with apply(t) = rhs as nearly as a few Lanczos steps allow, for a symmetric operator; columns go in step."""
    beta = np.linalg.norm(rhs, axis=0)
    start = np.where(beta > 0, beta, 1)
    v_old, v = np.zeros_like(rhs), rhs / start
    w_old, w, t = (np.zeros_like(rhs) for _ in range(3))
    eta, b = beta.copy(), np.zeros_like(beta)
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    alive = beta > 0
    for _ in range(steps):
        next_v = apply(v)
        alpha = np.sum(v * next_v, axis=0)
        next_v = next_v - alpha * v - b * v_old
        next_b = np.linalg.norm(next_v, axis=0)
        delta = c * alpha - c_old * s * b
        rho = np.hypot(delta, next_b)
        ok = alive & (rho > 0)
        rho = np.where(ok, rho, 1)
        next_w = (v - s_old * b * w_old - (s * alpha + c_old * c * b) * w) / rho
        c_old, s_old, c, s = c, s, delta / rho, next_b / rho
        t = t + np.where(ok, c * eta, 0) * next_w
        eta = -s * eta
        w_old, w = w, next_w
        alive = ok & (next_b > 0)
        v_old, v, b = v, next_v / np.where(alive, next_b, 1), next_b
        if not np.any(alive & (np.abs(eta) > goal * beta)):
            break
    return t


def _rayleigh_ritz(space: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and their coordinates in the space."""
    h = space.T @ image
    theta, turn = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], turn[:, ::-1]


@dataclass(frozen=True)
class Pairs:
    """Eigenvalues, falling, their vectors as columns, residual norms, and the products that it took."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def leading_pairs(product: Product, dims: int, count: int, *, seed: int = 1) -> Pairs:
    """The count largest eigenpairs of a symmetric positive semidefinite operator."""
    calls = 0

    def times(w: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(w)

    count = min(count, dims)
    block = min(dims, count + GUARD)
    most = min(dims, SUBSPACE * block)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dims, block)))
    image = times(space)
    locked, values, size = np.zeros((dims, 0)), np.zeros(0), 0.0
    for step in range(OUTER):
        theta, turn = _rayleigh_ritz(space, image)
        ritz = space @ turn[:, :block]
        rest = image @ turn[:, :block] - ritz * theta[:block]
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        size = max(size, float(theta.max(initial=0)))
        goal = max(REACHED, np.sqrt(dims)) * EPS * size
        done = 0
        while done < len(norms) and len(values) + done < count and norms[done] <= goal:
            done += 1
        if done:
            locked, values = np.column_stack([locked, ritz[:, :done]]), np.append(values, theta[:done])
            space, image, theta, turn = space @ turn[:, done:], image @ turn[:, done:], theta[done:], np.eye(len(theta))[:, done:][done:]
            ritz, rest, norms = ritz[:, done:], rest[:, done:], norms[done:]
        if len(values) == count:
            fresh = times(locked)
            larger = len(theta) and theta[0] > values.min() + goal
            if not larger:
                theta, turn = _rayleigh_ritz(locked, fresh)
                vectors = locked @ turn
                norms = np.linalg.norm(fresh @ turn - vectors * theta, axis=0)
                if norms.max() <= 2 * goal:
                    return Pairs(theta, vectors, norms, calls)
            # a larger eigenvalue turned up outside, or rounding has piled up: all go on, from products made afresh
            space, image = (np.column_stack([locked, space]), np.column_stack([fresh, image])) if larger else (locked, fresh)
            locked, values = np.zeros((dims, 0)), np.zeros(0)
            continue
        if space.shape[1] + block > most:
            space, image, theta, turn = space @ turn[:, :block], image @ turn[:, :block], theta[:block], np.eye(min(block, len(theta)))
        at_work = np.flatnonzero(norms[: count - len(values) + GUARD] > goal)
        known, shifts = np.column_stack([locked, ritz]), theta[at_work]

        def projected(t: np.ndarray, known=known, shifts=shifts) -> np.ndarray:
            t = t - known @ (known.T @ t)
            t = times(t) - t * shifts
            return t - known @ (known.T @ t)

        right = -rest[:, at_work]
        right -= known @ (known.T @ right)
        steps = min(INNER, dims - known.shape[1])
        new = minres(projected, right, steps, max(LEAST_GOAL, 0.5 ** (step + 1))) if steps > 0 and len(at_work) else right
        new = _orthonormal(new, locked, space)
        if not new.shape[1] and space.shape[1] + locked.shape[1] < dims:
            new = _orthonormal(np.random.default_rng(seed + calls).standard_normal((dims, 1)), locked, space)
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, times(new)])
    raise ArithmeticError(f"{len(values)} of {count} components after {OUTER} steps")


# whitening


@dataclass(frozen=True)
class Whitener:
    """Projection of centred vectors: components as columns, over the roots of their eigenvalues."""

    data: Fit
    pairs: Pairs
    trace: float

    @property
    def weights(self) -> np.ndarray:
        return self.pairs.vectors / np.sqrt(self.pairs.values)


def whitener(rows: DataFrame, *, components: int = 8, **settings) -> Whitener:
    """Fit the leading components; those without variance are left out."""
    data = fit(rows, **settings)
    dims = len(data.sums)
    if not data.n:
        return Whitener(data, Pairs(np.zeros(0), np.zeros((dims, 0)), np.zeros(0), 0), 0.0)
    pairs = leading_pairs(covariance_product(data), dims, components)
    good = pairs.values > dims * EPS * max(float(pairs.values[0]), float(np.abs(np.array(data.sums, dtype=np.float64)).max() / data.n) * EPS)
    pairs = Pairs(pairs.values[good], pairs.vectors[:, good], pairs.residuals[good], pairs.products)
    base, part = data.base, data.rest / data.n

    def run(batches):
        total = np.zeros((1, 1))
        for batch in batches:
            for x in batch.column(0):
                total += (((_matrix(x.as_py(), dims) - base) - part) ** 2).sum()
        yield from _send(total)

    trace = _cells(data.blocks.select("x").mapInArrow(run, "cell int, value double"), (1, 1))[0, 0] / data.n
    return Whitener(data, pairs, float(trace))


def whitened_moments(w: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the whitened rows, centred before multiplying, by two passes."""
    base, part, weights = w.data.base, w.data.rest / w.data.n, w.weights
    k = weights.shape[1]

    def moment(mean: np.ndarray | None) -> np.ndarray:
        def run(batches):
            total = np.zeros((1 if mean is None else k, k))
            for batch in batches:
                for x in batch.column(0):
                    z = ((_matrix(x.as_py(), len(base)) - base) - part) @ weights
                    total += z.sum(axis=0) if mean is None else (z - mean).T @ (z - mean)
            yield from _send(total)

        return _cells(w.data.blocks.select("x").mapInArrow(run, "cell int, value double"), (1 if mean is None else k, k)) / w.data.n

    mean = moment(None)[0]
    return mean, moment(mean)


def deviations(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> list[int]:
    """Exact sums over dimensions of (n x - S)**2, with S = n base + rest."""
    y = x - base
    if (float(n) * (np.abs(y, dtype=np.float64).max() + 1)) ** 2 * len(base) >= 2**62:
        y, n, rest = y.astype(object), int(n), rest.astype(object)
    return [int(v) for v in ((n * y - rest) ** 2).sum(axis=1)]


def whiten(rows: DataFrame, *, components: int = 8, **settings) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    w = whitener(rows, components=components, **settings)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    k = len(w.pairs.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error = float(np.abs(whitened_moments(w)[1] - np.eye(k)).max())
    n, base, rest, weights, explained = w.data.n, w.data.base, w.data.rest, w.weights, w.pairs.values / w.trace
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for ids, x in zip(batch.column(0), batch.column(1), strict=True):
                own = _matrix(x.as_py(), len(base))
                z = ((own - base) - rest / n) @ weights
                far = deviations(own, n, base, rest)
                columns = [pa.array(ids.as_py(), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))), pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()), pa.array(np.full(len(own) * k, n)), pa.array([d for d in far for _ in range(k)], pa.decimal128(38, 0)), pa.array(z.reshape(-1)), pa.array(np.tile(explained, len(own))), pa.array(np.full(len(own) * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return w.data.blocks.select("ids", "x").mapInArrow(run, schema)
