"""Whitening against numpy on the whole matrix, and the eigenpairs on hard matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from siftwell.llm import queries, whitening


def entries(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def check(rows, vectors, k=32):
    """rows of the query against the plain computation over ``vectors`` (a dict of id to entries, ids not repeated)."""
    x = np.array([entries(v) for v in vectors.values()], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1]
    rank = sum(values[:k] > 1e-9 * values.sum())
    assert len(rows) == n * rank
    got = {(r.vec_id, r.component): r for r in rows}
    w = np.array([[got[i, c].whitened for c in range(1, rank + 1)] for i in vectors])
    assert np.abs(w.T @ w / n - np.eye(rank)).max() < 1e-6
    basis = np.linalg.lstsq(centred, w * np.sqrt(values[:rank]), rcond=None)[0]
    assert np.abs(v @ basis - basis * values[:rank]).max() < 1e-8 * values[0]
    for i, row in zip(vectors, x):
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums)) and got[i, 1].n == n
    for c in range(1, rank + 1):
        assert got[next(iter(vectors)), c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-6


def stored(spark, path, rows, kind="array<float>"):
    spark.createDataFrame(rows, f"vec_id long, embedding {kind}, whitened int, deviation string").write.parquet(f"{path}/embeddings.parquet")
    return queries.op13_whitening(spark, str(path)).collect()


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check(queries.op13_whitening(spark, sf).collect(), vectors)


def test_bad_rows_go_and_copies_count(spark, tmp_path):
    draws = np.random.default_rng(3)
    good = {i: (draws.standard_normal(6) * [5, 3, 3, 1, 0.5, 0]).tolist() for i in range(40)}
    good[40] = good[41] = good[0]
    bad = [(50, None), (51, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (52, [math.nan] * 6), (53, [1.0, 1.0, 1.0, 1.0, 1.0, math.inf]), (54, [-math.inf] * 6)]
    rows = [(i, v, 7, "clash") for i, v in [*good.items(), *bad]]
    check(stored(spark, f"file://{tmp_path}/a", rows), good)
    null_id = [*rows, (None, good[5], 1, None)]
    assert sum(r.vec_id is None for r in stored(spark, f"file://{tmp_path}/b", null_id)) == 5


def test_ragged_huge_constant_and_empty(spark, tmp_path):
    ragged = {0: [1.0, 2.0], 1: [3.0], 2: [], 3: [0.0, 5.0, 9.0]}
    check(stored(spark, f"file://{tmp_path}/a", [(i, v, 1, "") for i, v in ragged.items()], "array<double>"), {i: [*v, 0, 0, 0][:3] for i, v in ragged.items()})
    huge = {0: [1e9, 0.5], 1: [-3e9, 0.25], 2: [2e9, 1e4]}
    got = stored(spark, f"file://{tmp_path}/b", [(i, v, 1, "") for i, v in huge.items()], "array<double>")
    assert len(got) == 6 and all(r.deviation is None and math.isfinite(r.whitened) for r in got)
    assert stored(spark, f"file://{tmp_path}/c", [(i, [1.5, 2.5], 1, "") for i in range(3)]) == []
    assert stored(spark, f"file://{tmp_path}/d", []) == []
    assert stored(spark, f"file://{tmp_path}/e", [(1, None, 1, "")]) == []


@pytest.mark.parametrize("name", ["random", "repeated", "identity", "blocks", "graded", "one", "two", "zero"])
def test_eigenpairs(name):
    draws = np.random.default_rng(5)
    q = np.linalg.qr(draws.standard_normal((40, 40)))[0]
    a = {
        "random": (lambda b: b @ b.T)(draws.standard_normal((40, 40))),
        "repeated": q @ np.diag([5.0] * 10 + [1.0] * 25 + [0.0] * 5) @ q.T,
        "identity": np.eye(40),
        "blocks": np.kron(np.eye(10), np.array([[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 3, 0], [0, 0, 0, 0]], dtype=float)),
        "graded": q @ np.diag(10.0 ** -np.arange(0, 10, 0.25)) @ q.T,
        "one": np.array([[3.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]), "zero": np.zeros((5, 5)),
    }[name]
    a, k = (a + a.T) / 2, min(32, len(a))
    values, vectors = whitening.leading_eigenpairs(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    size = max(1.0, np.abs(a).max())
    assert np.abs(values - want).max() < 1e-13 * size * 10
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-10
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12 * size


def test_exact_sums_of_wide_numbers():
    y = np.array([[3, 1 << 40], [-(1 << 50), 7], [5, -2]], dtype=np.int64)
    assert (whitening.exact_products(y) == y.astype(object).T.dot(y.astype(object))).all()
    assert list(whitening.exact_sums(np.array([[1 << 61]] * 6))) == [6 << 61]
