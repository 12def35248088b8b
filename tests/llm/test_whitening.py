import math

import numpy as np
import pytest

from tabreg.llm.whitening import Moments, bit_planes, cross_products, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, vector int"


@pytest.fixture
def vectors(spark):
    def build(rows, parts=3, schema=SCHEMA):
        return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], schema).repartition(parts)
    return build


def integers(rows):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows], object)


def check(got, ids, rows, k):
    """Against whole-number arithmetic and numpy's eigh of the exact covariance."""
    x = integers(rows)
    n, s = len(x), x.sum(axis=0)
    gap = n * x - s
    v = np.array((gap.T @ gap) / (n ** 3), float)
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    order = {i: p for p, i in enumerate(ids)}
    w = np.zeros((n, k))
    for i, parts in by.items():
        assert sorted(parts) == list(range(1, k + 1))
        for c, r in parts.items():
            assert (r.n, r.deviation) == (n, sum(g * g for g in gap[order[i]]))
            assert r.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
            w[order[i], c - 1] = r.whitened
    want = np.array(gap / n, float) @ vecs[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        sign = np.sign((w[:, c] * want[:, c]).sum())
        assert np.allclose(w[:, c], sign * want[:, c], rtol=1e-7, atol=1e-7)
    cov = w.T @ w / n - np.outer(w.mean(0), w.mean(0))
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-8
    assert np.abs(cov - np.eye(k)).max() < 1e-8


def test_equals_whole_number_arithmetic(vectors):
    rng = np.random.default_rng(4)
    rows = (rng.normal(size=(500, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + 5).astype(np.float32).tolist()
    check(whiten(vectors(list(enumerate(rows)))).collect(), range(500), rows, 8)
    few = [[1.0, 2.0, 5.0], [2.0, 1.0, -7.5], [0.5, 0.5, 1.0], [9.0, -3.0, 2.0], [0.0, 0.0, 0.0]]
    check(whiten(vectors(list(enumerate(few)))).collect(), range(5), few, 3)


def test_left_out_rows_and_edges(vectors, spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [1.0, 2.0]]
    bad = [(10, None), (11, [None, 1.0]), (12, [float("nan"), 1.0]), (13, [float("inf"), 1.0]), (14, []), (15, [1.0]), (16, [1.0, 2.0, 3.0])]
    check(whiten(vectors([*enumerate(good), *bad])).collect(), range(4), good, 2)
    assert whiten(vectors([])).count() == 0
    assert whiten(vectors(bad[:4])).count() == 0
    assert whiten(vectors([(1, [1.0, 2.0])])).count() == 0       # no variance
    assert whiten(vectors([(1, [1.0, 2.0])] * 5)).count() == 0
    repeated = whiten(vectors([(1, [1.0, 5.0]), (1, [1.0, 5.0]), (None, [2.0, 0.0])])).collect()
    assert sorted(str(r.vec_id) for r in repeated) == ["1", "1", "None"] and {r.component for r in repeated} == {1}
    wide = whiten(vectors([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [1e300, 1.0])], schema=SCHEMA.replace("float", "double"))).collect()
    assert {r.vec_id for r in wide} == {1, 2} and all(r.deviation is None for r in wide)


def test_results_do_not_depend_on_partitions(vectors):
    rng = np.random.default_rng(9)
    rows = list(enumerate(rng.normal(size=(300, 5)).tolist()))
    one, two = ({(r.vec_id, r.component): r for r in whiten(vectors(rows, p)).collect()} for p in (1, 7))
    assert {k: (r.deviation, r.whitened, r.explained) for k, r in one.items()} == {k: (r.deviation, r.whitened, r.explained) for k, r in two.items()}


@pytest.mark.parametrize("high", [1, 2, 5000, 1 << 40])
def test_cross_products(high):
    rng = np.random.default_rng(1)
    y = rng.integers(0, high, (777, 6))
    y[:, 3] = 0
    sums, products = cross_products(y)
    exact = y.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist()
    assert (np.triu(products) == np.triu(exact.T @ exact)).all()
    planes, dim, bit = bit_planes(y)
    again = np.zeros_like(y)
    for p, d, b in zip(planes, dim, bit, strict=True):
        again[:, d] += np.unpackbits(p.view(np.uint8))[:777].astype(np.int64) << b
    assert (again == y).all()
    got = Moments.none(6)
    got.add(y[:300] - 17)
    got.add(y[300:] - 17)
    assert (np.triu(got.products) == np.triu((exact - 17).T @ (exact - 17))).all() and got.n == 777
