"""Embedding whitening: distributed centred covariance, leading eigenpairs, broadcast projection.

An entry ``c`` of a vector counts as the long ``x = floor(64 c) + 1000000``. The fit takes two passes: exact sums
per dimension, then exact sums of the products of entries centred by the rounded mean; both are whole numbers, so
the covariance does not depend on how rows are dealt. The eigenpairs come from Householder tridiagonalisation, bisection by
Sturm counts, and inverse iteration with reorthogonalisation inside clusters of close eigenvalues. A third pass
measures the covariance of the whitened rows.

Rows whose vector is null or has a null, NaN or infinite entry are left out; equal rows count as often as they occur.
Vectors shorter than the longest are read as if zeros followed. Entries beyond 2^55 count as 2^55. A direction whose
variance is not above rounding (dimension times 2^-52 of the total) has no component, so constant or empty tables give no components.
``deviation`` is null where it exceeds a long. Only matrices of the dimension (``MAX_DIM`` at most) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIM = 2048
SCALE, SHIFT = 64, 1_000_000
_LIMB = 40  # sums travel as limbs of so many bits


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # of x, per dimension
    trace: float  # of the covariance
    values: np.ndarray = field(repr=False)  # eigenvalues, falling
    components: np.ndarray = field(repr=False)  # one unit eigenvector a row

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows that count, with the vector as doubles in ``_v``."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    return df.where(F.coalesce(fine, F.lit(False))).withColumn("_v", vector)


def _entries(column, dim: int) -> np.ndarray:
    """x - SHIFT of each row of an Arrow list column, rows by ``dim``."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(flat) == dim * len(lengths) and (lengths == dim).all():
        c = flat.reshape(len(lengths), dim)
    else:
        c = np.zeros((len(lengths), dim))
        c[np.arange(dim)[None, :] < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -(2.0**61), 2.0**61).astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """The sums of products of all pairs of columns, as Python ints; by blocks whose sums a double holds exactly."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    if not y.size:
        return total
    top = int(np.abs(y).max()) ** 2 or 1
    rows = (1 << 53) // top
    if not rows:
        wide = y.astype(object)
        return wide.T.dot(wide)
    for start in range(0, len(y), rows):
        part = y[start : start + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def exact_sums(y: np.ndarray) -> np.ndarray:
    if y.size and int(np.abs(y).max()) * len(y) >= 1 << 62:
        return y.astype(object).sum(axis=0)
    return y.sum(axis=0).astype(object)


def _collected(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Limbs summed over all tasks and put together."""
    rows = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(4)]).collect()
    return {(r.i, r.j): sum(r[f"l{k}"] << (_LIMB * k) for k in range(4)) for r in rows}


_PARTS = "i int, j int, l0 bigint, l1 bigint, l2 bigint, l3 bigint"


def _limbs(keys: list[tuple[int, int]], values: list[int]):
    import pyarrow as pa

    mask = (1 << _LIMB) - 1
    columns = [[k[0] for k in keys], [k[1] for k in keys], *[[(int(v) >> (_LIMB * k)) & mask for v in values] for k in range(3)], [int(v) >> (_LIMB * 3) for v in values]]
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["i", "j", "l0", "l1", "l2", "l3"])


def fit(df: DataFrame, vector_col: str = "embedding", k: int = 32) -> Whitening:
    """The leading ``k`` components of all usable rows, fewer where the rank is lower."""
    vectors = usable(df, vector_col).select("_v")
    dim = vectors.agg(F.max(F.size("_v"))).first()[0] or 0
    if dim > MAX_DIM:
        raise ValueError(f"vectors have {dim} entries; {MAX_DIM} at most")

    def sums(batches: Iterator) -> Iterator:
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            n, total = n + batch.num_rows, total + exact_sums(_entries(batch.column(0), dim))
        yield _limbs([(-1, -1), *[(i, -1) for i in range(dim)]], [n, *total])

    first = _collected(vectors.mapInArrow(sums, _PARTS))
    n = first.get((-1, -1), 0)
    if not n or not dim:
        return Whitening(n, (0,) * dim, 0.0, np.zeros(0), np.zeros((0, dim)))
    plain = [first[i, -1] for i in range(dim)]
    centre = np.array([s // n for s in plain], dtype=np.int64)

    def products(batches: Iterator) -> Iterator:
        total = np.zeros((dim, dim), dtype=object)
        for batch in batches:
            total += exact_products(_entries(batch.column(0), dim) - centre)
        keys = [(i, j) for i in range(dim) for j in range(i, dim)]
        yield _limbs(keys, [total[key] for key in keys])

    second = _collected(vectors.mapInArrow(products, _PARTS))
    rest = [s - n * int(m) for s, m in zip(plain, centre)]  # what rounding the mean left
    whole = np.empty((dim, dim), dtype=object)  # n^2 times the covariance
    for (i, j), s in second.items():
        whole[i, j] = whole[j, i] = n * s - rest[i] * rest[j]
    trace = sum(whole[i, i] for i in range(dim))
    if not trace:
        return Whitening(n, tuple(s + n * SHIFT for s in plain), 0.0, np.zeros(0), np.zeros((0, dim)))
    scaled = np.array([[int(v) / int(trace) for v in row] for row in whole])
    values, vectors_ = leading_eigenpairs(scaled, min(k, dim))
    values = np.array([_rayleigh(whole, v, trace) for v in vectors_])
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > dim * 2.0**-52]
    total_variance = int(trace) / (n * n)
    return Whitening(n, tuple(s + n * SHIFT for s in plain), total_variance, values[order] * total_variance, vectors_[order])


def _rayleigh(whole: np.ndarray, v: np.ndarray, trace: int) -> float:
    """The share of the trace along ``v``, from whole numbers, so that small eigenvalues keep their digits."""
    u = np.array([int(x) for x in np.ldexp(v, 60)], dtype=object)
    return int(u.dot(whole.dot(u))) / (int(trace) * int(u.dot(u)))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors of a symmetric matrix."""
    a, reflectors = a.copy(), []
    for c in range(len(a) - 2):
        x = a[c + 1 :, c]
        v = x.copy()
        v[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        rest = a[c + 1 :, c + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        reflected = x - 2 * v * (v @ x)
        a[c + 1 :, c] = a[c, c + 1 :] = reflected
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each value of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = np.concatenate([[0.0], off**2])
    below, q = np.zeros(len(at), dtype=np.int64), np.ones(len(at))
    for d, s in zip(diagonal, squares):
        q = d - at - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def bisected(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, all bisected at once."""
    n = len(diagonal)
    edge = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diagonal - edge).min()), np.full(k, (diagonal + edge).max())
    span = max(abs(low[0]), abs(high[0]))
    low, high = low - 1e-15 * span, high + 1e-15 * span
    rank = n - 1 - np.arange(k)  # so many eigenvalues lie below the wanted one
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, small: float):
    """Solves (T - shift) x = b by elimination with row exchanges; zero pivots become ``small``."""
    n = len(diagonal)
    main, up, up2 = list(diagonal - shift), [*off, 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(main[i]):
            swap, factor = True, main[i] / low
            old = up[i]
            main[i], up[i], up2[i] = low, main[i + 1], up[i + 1]
            main[i + 1], up[i + 1] = old - factor * up[i], -factor * up2[i]
        else:
            main[i] = main[i] if abs(main[i]) > small else math.copysign(small, main[i])
            swap, factor = False, low / main[i]
            main[i + 1] -= factor * up[i]
        steps.append((swap, factor))
    main[-1] = main[-1] if abs(main[-1]) > small else math.copysign(small, main[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        x = list(b)
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            s = x[i]
            if i + 1 < n:
                s -= up[i] * x[i + 1]
            if i + 2 < n:
                s -= up2[i] * x[i + 2]
            x[i] = s / main[i]
        return np.array(x)

    return solve


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors, one a row, of the ``k`` largest of a symmetric matrix."""
    n = len(a)
    diagonal, off, reflectors = tridiagonal(a)
    values = bisected(diagonal, off, k)
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0)) or 1.0
    eps, draws = np.finfo(float).eps, np.random.default_rng(1)
    found = np.zeros((k, n))
    begin, last = 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            begin = j  # a new cluster
        shift = min(value, last - 10 * eps * size) if j > begin else value
        last = shift
        solve = _solver(diagonal, off, shift, eps * size)
        x = draws.standard_normal(n)
        for _ in range(5):
            x = x / np.linalg.norm(x)
            x = solve(x)
            x = x / np.abs(x).max()
            for _ in range(2):
                x = x - found[begin:j].T @ (found[begin:j] @ x)
        found[j] = x / np.linalg.norm(x)
    for c in range(len(reflectors) - 1, -1, -1):
        v = reflectors[c]
        found[:, c + 1 :] -= 2 * np.outer(found[:, c + 1 :] @ v, v)
    return values, found / np.linalg.norm(found, axis=1, keepdims=True)


def _centred(y: np.ndarray, n: int, rest: list[int], centre: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n as doubles, and the sum of (n x - S)^2 of each row, exact."""
    y = y - centre
    top = (int(np.abs(y).max()) if y.size else 0) * n + n
    if top < 1 << 62 and top * top * y.shape[1] < 1 << 62:
        whole = y * n - np.array(rest, dtype=np.int64)
        return whole / n, (whole * whole).sum(axis=1).tolist()
    wide = y.astype(object) * n - np.array(rest, dtype=object)
    squares = [int(s) for s in (wide * wide).sum(axis=1)]
    return (y - np.array([r / n for r in rest])).astype(np.float64), [s if s < 1 << 63 else None for s in squares]


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row: the id, ``deviation`` and ``whitened``, the coordinates along the components."""
    dim, kind = len(model.sums), df.schema[id_col].dataType.simpleString()
    if id_col in ("deviation", "whitened"):
        raise ValueError(f"an id may not be called {id_col}")
    plain = [s - model.n * SHIFT for s in model.sums]
    centre = [s // model.n for s in plain] if model.n else []
    basis = model.components / np.sqrt(model.values)[:, None]
    sent = df.sparkSession.sparkContext.broadcast((np.array(centre, dtype=np.int64), [s - model.n * m for s, m in zip(plain, centre)], basis))
    n = model.n

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centre, rest, basis = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            centred, deviation = _centred(_entries(batch.column(1), dim), n, rest, centre)
            out = centred @ basis.T
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(basis)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "whitened"])

    rows = usable(df, vector_col).select(F.col(f"`{id_col}`").alias("id"), "_v")
    return rows.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>").withColumnRenamed("id", id_col)


def identity_error(whitened: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, over all rows; null without components."""

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums, products = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                w = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)  # centred already: x - S/n
                n, sums, products = n + len(w), sums + w.sum(axis=0), products + w.T @ w
        if n:
            k = len(sums)
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-2, *[-1] * k, *i], pa.int32()), pa.array([0, *range(k), *j], pa.int32()), pa.array([float(n), *sums, *products.ravel()])], names=["i", "j", "v"]
            )

    rows = whitened.select("whitened").where(F.size("whitened") > 0).mapInArrow(moments, "i int, j int, v double")
    got = {(r.i, r.j): r.v for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    if not got:
        return None
    n = got[-2, 0]
    return max(abs(v / n - got[-1, i] / n * (got[-1, j] / n) - (i == j)) for (i, j), v in got.items() if i >= 0)
