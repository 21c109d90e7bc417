from __future__ import annotations

import math

import numpy as np
import pytest

from rideflow.llm import whitening
from rideflow.llm.queries import QUERIES
from tests.llm.fixtures import FOLDER

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string"


def brute(rows, wanted=16):
    """Every row's x, n, S and the leading eigenpairs, by numpy's own solver."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    return xs, n, sums, values, axes, np.trace(y.T @ y / n)


def check(found, rows, wanted=16):
    xs, n, sums, values, axes, trace = brute(rows, wanted)
    some = values > 1e-12 * trace
    values, axes = values[some], axes[:, some]
    k = len(values)
    got = found.collect()
    assert len(got) == len(xs) * k
    assert {r.n for r in got} <= {n} and all(r.identity_error <= 1e-6 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained
    signs = {}
    for i, x in xs:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        for r in by_id[i]:
            assert r.deviation == deviation
            want = y @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1])
            if abs(want) > 1e-4:
                signs.setdefault(r.component, np.sign(want * r.whitened))
            assert abs(r.whitened - signs.get(r.component, 1) * want) < 1e-6


def test_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(QUERIES["op11_embedding_whitening"](spark, FOLDER), [tuple(r) for r in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    plain = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 5)).astype(np.float32))]
    odd = [
        (100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [nan] * 5),
        (104, [0.0, 0.0, inf, 0.0, 0.0]), (105, [0.0, 0.0, -inf, 0.0, 0.0]), (106, [1.0]),
    ]
    copies = [plain[0]] * 30 + [(None, plain[1][1])] * 2
    rows = spark.createDataFrame([(*r, "a", "b", "c") for r in plain + odd + copies], SCHEMA)
    got = whitening.whitened(rows, wanted=3)
    assert {r.vec_id for r in got.collect()} == {*range(40), None}
    same = [r for r in got.collect() if r.vec_id in (None, 1)]
    assert len({(r.component, r.whitened, r.deviation) for r in same}) == 3
    check(got, plain + copies, 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_tables_without_variance_give_no_rows(spark, rows):
    made = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    assert whitening.whitened(made).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [3e9, -2.0]), (3, [0.5, 7.0]), (4, [-1e12, 1.0])]
    made = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = {r.vec_id: r for r in whitening.whitened(made, wanted=1).collect()}
    assert got.keys() == {1, 2, 3, 4} and all(r.deviation is None for r in got.values())


def test_matrices_of_all_kinds_are_split():
    """Clustered, repeated, zero and widely spread eigenvalues."""
    rng = np.random.default_rng(8)
    for values in (
        np.arange(1.0, 33), np.ones(9), np.zeros(5), [5.0] * 4 + [1.0] * 4, np.geomspace(1, 1e-14, 20),
        [1.0, 1 + 1e-9, 1 + 2e-9, 0.5], [3.0], [2.0, 2.0, 1.0], [0.0, 0.0, 1.0, 2.0, 2.0], [-3.0, 0.0, 3.0],
    ):
        values = np.sort(np.array(values, float))[::-1]
        q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
        a = q * values @ q.T
        a = (a + a.T) / 2
        for wanted in (None, 2):
            got, axes = whitening.components(a, wanted)
            scale = max(abs(values).max(), 1e-300)
            assert np.abs(got - values[: len(got)]).max() <= 1e-13 * len(values) * scale
            assert np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-12
            assert np.abs(a @ axes - axes * got).max() <= 1e-12 * scale * len(values)
    diagonal, axes = whitening.components(np.diag([1.0, 4.0, 2.0]))
    assert np.allclose(diagonal, [4, 2, 1]) and np.allclose(np.abs(axes).sum(), 3)


def test_polar_factor_has_the_signs_of_the_eigenvalues():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    sign = whitening.polar_sign(a)
    assert np.allclose(sign @ sign, np.eye(12)) and np.allclose(sign @ a, a @ sign)
    assert np.linalg.eigvalsh(sign @ a).min() > 0
