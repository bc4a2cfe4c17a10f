"""Whitening against a dense eigenvalue decomposition of the covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cohortlake.llm import whitening as wh
from cohortlake.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, n string, id string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)


def usable(v, dim):
    return v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)


def expected(rows, dim, wanted=16):
    """n, S, eigenvalues, components (columns), trace by dense arithmetic in exact whole numbers."""
    x = {tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) for _, v in rows if usable(v, dim)}
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    return n, sums, values[::-1][:wanted], columns[:, ::-1][:, :wanted], np.trace(cov)


def check(got, rows, dim, wanted=16, tolerance=1e-9):
    n, sums, values, columns, trace = expected(rows, dim, wanted)
    by_component: dict[int, list] = {}
    for r in got:
        by_component.setdefault(r.component, []).append(r)
    kept = [(i, v) for i, v in rows if usable(v, dim)]
    assert sorted(by_component) == list(range(1, min(wanted, dim) + 1))
    for k, own in by_component.items():
        assert len(own) == len(kept)
        want = {}
        for i, v in kept:
            x = [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            centred = np.array([(n * a - s) / n for a, s in zip(x, sums)])
            want.setdefault(i, []).append((deviation, centred @ columns[:, k - 1] / math.sqrt(values[k - 1])))
        sign = None
        for r in sorted(own, key=lambda r: -abs(r.whitened)):
            assert r.n == n and abs(r.explained / (values[k - 1] / trace) - 1) < 1e-10 and r.identity_error < 1e-10
            match = [w for d, w in want[r.vec_id] if d == r.deviation and abs(abs(w) - abs(r.whitened)) < tolerance]
            assert match, (r, want[r.vec_id])
            if sign is None:
                sign = np.sign(match[0]) * np.sign(r.whitened)
            assert abs(match[0] * sign - r.whitened) < tolerance


def some_rows(rng, n, dim, scale=None):
    scale = np.linspace(3, 0.5, dim) if scale is None else scale
    return [(i, (rng.standard_normal(dim) * scale).tolist()) for i in range(n)]


def test_query_on_odd_rows(spark, tmp_path):
    rows = some_rows(np.random.default_rng(1), 300, 24)
    rows += [(1000, None), (1001, [None] * 24), (1002, [1.0] * 23 + [float("nan")]), (1003, [float("inf")] + [0.0] * 23)]
    rows += [(1004, [1.0] * 5), (1005, []), (None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(2000 + i, rows[7][1]) for i in range(200)]  # copies count once
    table_of(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_embedding_whitening"](spark, str(tmp_path))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.columns == names
    check(got.collect(), rows, 24)


def test_few_dimensions(spark):
    rows = some_rows(np.random.default_rng(2), 50, 3)
    vectors = table_of(spark, rows)
    check(wh.whiten(vectors, wh.fit(vectors)).collect(), rows, 3)


def test_double_precision_without_the_whole_space():
    """Many columns, close and repeated eigenvalues: residuals reach rounding before the
    subspace is the whole space."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    values = np.r_[50, 49.999, 30, 30, 30, np.linspace(20, 1, 395)]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    calls = []

    def product(columns):
        calls.append(columns.shape[1])
        return matrix @ columns

    found, columns, residuals = wh.leading_eigenpairs(product, 400, 16)
    assert np.abs(found / values[:16] - 1).max() < 1e-12
    assert np.abs(columns.T @ columns - np.eye(16)).max() < 1e-13
    assert residuals.max() < 400 * wh.EPS * 50
    assert len(calls) < 150


def test_corrections_matter(monkeypatch):
    """The correction equation is what converges: residuals alone take more rounds."""
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    matrix = (q * np.r_[np.linspace(11, 10, 30), np.linspace(9.9, 0.1, 270)]) @ q.T
    wide = wh.leading_eigenpairs(lambda c: matrix @ c, 300, 8)
    assert np.abs(wide[0] - np.linspace(11, 10, 30)[:8]).max() < 1e-11
    monkeypatch.setattr(wh, "_minres", lambda product, shifts, right, against, steps: right)
    monkeypatch.setattr(wh, "ROUNDS", 6)
    with pytest.raises(RuntimeError):
        wh.leading_eigenpairs(lambda c: matrix @ c, 300, 8)


def test_minres_is_the_least_residual():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    against = np.linalg.qr(rng.standard_normal((40, 3)))[0]
    right = rng.standard_normal((40, 2))
    right -= against @ (against.T @ right)
    shifts = np.array([0.3, -1.2])
    got = wh._minres(lambda c: a @ c, shifts, right, against, 6)
    project = np.eye(40) - against @ against.T
    for j in range(2):
        op = project @ (a - shifts[j] * np.eye(40)) @ project
        krylov = [right[:, j]]
        for _ in range(5):
            krylov.append(op @ krylov[-1])
        k = np.linalg.qr(np.array(krylov).T)[0]
        y = np.linalg.lstsq(op @ k, right[:, j], rcond=None)[0]
        assert abs(np.linalg.norm(op @ k @ y - right[:, j]) - np.linalg.norm(op @ got[:, j] - right[:, j])) < 1e-9
        assert np.abs(against.T @ got[:, j]).max() < 1e-12


def test_deviations_are_exact():
    x = np.array([[5, -7], [1 << 40, 3]])
    sums = [1 << 41, -(1 << 40)]
    want = [sum((10**6 * a - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]
    assert wh._deviations(x, 10**6, sums) == [w if w < 1 << 63 else None for w in want]
    assert wh._deviations(x[:1], 3, [10, 2]) == [(15 - 10) ** 2 + (-21 - 2) ** 2]


def test_wide_entries(spark):
    """Vectors of 4 and 8 bytes an entry together, and null where a deviation has over 64 bits."""
    rng = np.random.default_rng(6)
    rows = some_rows(rng, 60, 4) + [(100, [2.0**33, 0.0, 1.0, -1.0]), (101, [2.0**60, 0.0, 0.0, 0.0])]
    vectors = table_of(spark, rows)
    model = wh.fit(vectors, wanted=2)
    assert model.n == 61 and model.sums[0] == 61000000 + sum(math.floor(64 * float(np.float32(v[0]))) for _, v in rows[:61])
    got = {r.vec_id: r.deviation for r in wh.whiten(vectors, model).collect()}
    assert 101 not in got and got[100] is None


def test_rank_and_empty_tables(spark):
    line = table_of(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)])
    model = wh.fit(line)
    assert len(model.eigenvalues) == 1 and model.identity_error < 1e-12
    assert wh.whiten(line, model).count() == 20
    for rows in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        vectors = table_of(spark, rows)
        assert wh.whiten(vectors, wh.fit(vectors)).collect() == []
