import numpy as np
import pytest

from tabreg.llm import vectors
from tabreg.llm.components import components
from tabreg.llm.vectors import near_duplicate_vectors


def brute(rows, threshold=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    name = np.array(ids)
    while True:
        new = np.minimum(name, np.where(link, name[None, :], 1 << 60).min(1))
        if (new == name).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), name, strict=True)}
        name = new


def near(rng, base, cosine):
    noise = rng.normal(size=base.shape)
    noise -= noise @ base / (base @ base) * base
    return base / np.linalg.norm(base) * cosine + noise / np.linalg.norm(noise) * np.sqrt(1 - cosine ** 2)


@pytest.mark.parametrize("kind,size", [("float", 64), ("double", 13)])
def test_equals_brute_force(spark, monkeypatch, kind, size):
    monkeypatch.setattr(vectors, "SHELF", 60)
    monkeypatch.setattr(vectors, "QUERIES", 150)
    monkeypatch.setattr(vectors, "LIST_SIZE", 40)
    monkeypatch.setattr(vectors, "PROBE", 99.0)  # all lists that can hold a neighbour: exact
    rng = np.random.default_rng(6)
    x = [rng.normal(size=size) for _ in range(250)]
    x += [near(rng, x[k % 20], c) for k, c in enumerate(rng.uniform(0.86, 0.97, 200))]
    x += [x[0]] * 30 + [x[1] * 2.5] + [near(rng, x[5], 0.999) for _ in range(80)]
    as_kind = np.float32 if kind == "float" else float
    rows = [(k * 3 + 1, v.astype(as_kind).tolist()) for k, v in enumerate(x)]
    table = spark.createDataFrame([(*r, 1, "a") for r in rows], f"vec_id long, embedding array<{kind}>, label int, `key` string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(table.repartition(5)).collect()}
    assert got == brute(rows)


def test_recall_with_usual_probes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    pairs = [(k, 3000 + k) for k in range(600)]
    every = np.r_[x, [near(rng, x[a], rng.uniform(0.9001, 0.95)) for a, _ in pairs]]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in near_duplicate_vectors(table).collect()}
    assert np.mean([got[a] == got[b] for a, b in pairs]) > 0.98


@pytest.mark.parametrize("rank,clusters", [(3, 0), (4, 25)])
def test_exact_on_few_directions(spark, rank, clusters):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, rank))
    if clusters:
        x = rng.normal(size=(clusters, rank))[rng.integers(0, clusters, 1500)] + 0.3 * x
    x = x @ rng.normal(size=(rank, 64)) + 0.02 * rng.normal(size=(1500, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(table).collect()}
    assert got == brute(rows)


def test_one_of_two_lists_asks_the_other():
    """Whatever both could see of each other is looked up once, and neither list does all the asking."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vectors.Index.fit(x, 400 * vectors.LIST_SIZE // 40)
    every = np.arange(len(index.centres))
    asks = np.zeros((len(every), len(every)), bool)
    own, codes, lost = index.encode(x)
    for c, row in zip(own, index.probes(x, own, every, 2.0), strict=True):
        asks[c] |= row
    assert len(every) == 10 and asks.diagonal().all() and not (asks & asks.T & ~np.eye(10, dtype=bool)).any()
    assert (asks | asks.T).all() and 2 <= asks.sum(1).min() and asks.sum(1).max() <= 8
    back, least = index.lookup(own, codes, lost + 0.4)
    exact = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) <= 0.16
    assert exact.any() and (x.astype(np.float32) @ back.T >= least.astype(np.float32)[None, :])[exact].all()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, nan]), (8, [float("inf"), 1.0]),
            (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01, 0.0]), (None, [1.0, 0.0]), (11, [1e-300, 0.0]), (12, [1e300, 1e299]), (2, [2.0, 0.0])]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    linked = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert linked[1] == (4, 1, True) and linked[2] == (4, 1, False) and linked[11] == (4, 1, False) and linked[12] == (4, 1, False)
    assert linked[9] == (1, 9, True) and linked[10] == (1, 9, False)
    assert all(linked[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8)) and linked[None] == (0, None, True)
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(300, 299), (5, 5)]
    edges += [tuple(sorted(rng.integers(1000, 1200, 2).tolist())) for _ in range(90)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i
    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: root(i) for i in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
