import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabreg.operators import impute, neighbors


def brute(x, d, k, metric=2, skip=None):
    """[(query, donor position, distance)] by a plain loop over shared cells."""
    out = []
    for i, a in enumerate(x):
        found = []
        for j, b in enumerate(d):
            both = ~np.isnan(a) & ~np.isnan(b)
            if not both.any() or (skip is not None and skip[i] == j):
                continue
            total = (np.abs(a - b)[both] ** metric).sum() * len(a) / both.sum()
            found.append((np.sqrt(total) if metric == 2 else total, j))
        out += [(i, j, dist) for dist, j in sorted(found)[:k]]
    return out


def table(n, seed, holes=0.0, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * 4) / 4  # exact in binary, so equal distances tie
    x[rng.random((n, 3)) < holes] = np.nan
    if copies:
        x[:copies] = [0.25, 0.5, 0.75]
    return pd.DataFrame(x, columns=list("abc")).assign(id=range(n))


@pytest.mark.parametrize("small", [0, 10_000])
@pytest.mark.parametrize("metric", [1, 2])
@pytest.mark.parametrize("holes,copies", [(0.0, 0), (0.3, 0), (0.0, 150)])
def test_exact_against_brute_force(make, monkeypatch, small, metric, holes, copies):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", 8)
    donors, queries = table(400, 1, holes, copies), table(60, 2, holes, copies // 5)
    got = neighbors.nearest(make(queries), make(donors), list("abc"), 4, "id", "id", payload="a", metric=metric,
                            small_donors=small).toPandas().sort_values(["id", "rank"])
    want = brute(queries[list("abc")].to_numpy(), donors[list("abc")].to_numpy(), 4, metric)
    assert list(zip(got["id"], got["neighbor"])) == [(i, j) for i, j, _ in want]
    np.testing.assert_allclose(got["dist"], [d for _, _, d in want], atol=1e-12)
    np.testing.assert_allclose(got["value"].astype(float), donors["a"].to_numpy()[got["neighbor"]])


@pytest.mark.parametrize("small", [0, 10_000])
def test_graph_leaves_the_row_itself_out(make, small):
    pdf = table(200, 3, copies=70)
    x = pdf[list("abc")].to_numpy()
    got = neighbors.nearest(make(pdf), make(pdf), list("abc"), 5, "id", "id", exclude_self=True,
                            small_donors=small).toPandas().sort_values(["id", "rank"])
    assert list(zip(got["id"], got["neighbor"])) == [(i, j) for i, j, _ in brute(x, x, 5, 2, range(len(x)))]


@pytest.mark.parametrize("exclude_self", [False, True])
def test_queries_that_lack_the_same_cell_meet_copies_of_what_is_compared_once(make, monkeypatch, exclude_self):
    held = []
    visit = neighbors._visit
    monkeypatch.setattr(neighbors, "_visit", lambda asks, blocks, *rest: (
        held.append(blocks.agg(F.sum(F.size("did"))).first()[0]), visit(asks, blocks, *rest))[1])
    rng = np.random.default_rng(11)
    donors = pd.DataFrame({"a": rng.integers(0, 6, 300) * 1.0, "b": rng.normal(size=300), "id": range(300)})
    donors.loc[:9, "b"] = np.nan
    queries = donors.head(60).assign(b=np.nan)
    got = neighbors.nearest(make(queries), make(donors), ["a", "b"], 4, "id", "id", exclude_self=exclude_self,
                            small_donors=0).toPandas().sort_values(["id", "rank"])
    want = brute(queries[["a", "b"]].to_numpy(), donors[["a", "b"]].to_numpy(), 4, skip=range(60) if exclude_self else None)
    assert list(zip(got["id"], got["neighbor"])) == [(i, j) for i, j, _ in want]
    np.testing.assert_allclose(got["dist"], [d for _, _, d in want])
    assert max(held) <= 6 * 5  # 6 values of a, k + 1 copies


def test_a_block_that_many_ask_for_is_held_once_for_many_chunks(make, monkeypatch):
    for name, value in (("BLOCK_ROWS", 64), ("CHUNK_ROWS", 4), ("SHARE", 3)):
        monkeypatch.setattr(neighbors, name, value)
    fed = []
    visit = neighbors._visit

    def spy(asks, blocks, *rest):
        assert asks.columns == ["group", "qid", "qx", "within"]
        fed.append(asks.agg(F.max(F.size("qid"))).first()[0])
        return visit(asks, blocks, *rest)

    monkeypatch.setattr(neighbors, "_visit", spy)
    rng = np.random.default_rng(12)
    donors = pd.DataFrame(rng.normal(size=(500, 3)), columns=list("abc")).assign(id=range(500))
    queries = donors.iloc[np.r_[np.full(150, 7), :40]].assign(id=range(190))  # most ask for the same place
    got = neighbors.nearest(make(queries), make(donors), list("abc"), 4, "id", "id", small_donors=0).toPandas().sort_values(["id", "rank"])
    want = brute(queries[list("abc")].to_numpy(), donors[list("abc")].to_numpy(), 4)
    assert list(zip(got["id"], got["neighbor"])) == [(i, j) for i, j, _ in want]
    assert max(v or 0 for v in fed) <= 4


def test_too_many_patterns_switch_the_boxes_off(make, monkeypatch):
    monkeypatch.setattr(neighbors, "MAX_GROUPS", 3)
    donors, queries = table(120, 4, 0.4), table(20, 5, 0.4)
    got = neighbors.nearest(make(queries), make(donors), list("abc"), 3, "id", "id", small_donors=0).toPandas()
    want = brute(queries[list("abc")].to_numpy(), donors[list("abc")].to_numpy(), 3)
    assert sorted(zip(got["id"], got["neighbor"])) == sorted((i, j) for i, j, _ in want)


def test_imputation_takes_neighbour_means_and_falls_back(make):
    pdf = table(150, 6, 0.15)
    pdf.loc[0, ["a", "b", "c"]] = np.nan
    got = impute.impute(make(pdf), "knn", 3, ["id"], list("abc")).toPandas().sort_values("id")
    x = pdf[list("abc")].to_numpy()
    want = x.copy()
    for j in range(3):
        donors = np.flatnonzero(~np.isnan(x[:, j]))
        for i in np.flatnonzero(np.isnan(x[:, j])):
            near = brute(x[i:i + 1], x[donors], 3)
            want[i, j] = np.mean([x[donors[k], j] for _, k, _ in near]) if near else np.nanmean(x[:, j])
    np.testing.assert_allclose(got[list("abc")].to_numpy(float), want, atol=1e-9)


def test_far_groups_are_never_visited(make, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 3)) + 100 * i for i in range(5)])
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))
    visits = []
    plain = neighbors._routes

    def spy(*args):
        out = plain(*args)
        visits.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "_routes", spy)
    got = neighbors.nearest(make(pdf), make(pdf), list("abc"), 3, "id", "id", small_donors=0)
    assert got.count() == 3 * len(x)
    groups = round(np.sqrt(len(x)) / 4)
    assert sum(visits) < 0.6 * len(x) * groups


def test_id_types(make, spark):
    pdf = table(50, 7)
    df = make(pdf).withColumn("name", F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 3, "0")))
    for small in (0, 1000):
        got = neighbors.nearest(df, df, list("abc"), 2, "name", "name", small_donors=small)
        assert got.where("rank = 1 AND id = neighbor").count() >= 45


def wide_rows(n, seed, p=12, copies=40):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, p)) * 2) / 2  # exact in binary, so equal distances tie
    x[:copies] = x[0]
    return pd.DataFrame(x, columns=[f"c{j}" for j in range(p)]).assign(id=range(n))


@pytest.mark.parametrize("small,share", [(0, 0.0), (0, 2.0), (10_000, 0.0)])
@pytest.mark.parametrize("same", [False, True])
def test_wide_rows_are_exact_without_plain_distances_of_all_pairs(make, monkeypatch, small, share, same):
    for name, value in (("BLOCK_ROWS", 32), ("CHUNK_ROWS", 16), ("TILE_ROWS", 64), ("TASK_BLOCKS", 4), ("FEW_GROUPS", share)):
        monkeypatch.setattr(neighbors, name, value)

    def refuse(*_):
        raise AssertionError("plain distances of a whole block")

    monkeypatch.setattr(neighbors, "distances", refuse)
    donors = wide_rows(500, 3)
    queries = donors if same else wide_rows(90, 4)
    cols = [c for c in donors.columns if c != "id"]
    got = neighbors.nearest(make(queries), make(donors), cols, 5, "id", "id", payload="c1", exclude_self=same,
                            small_donors=small).toPandas().sort_values(["id", "rank"])
    want = brute(queries[cols].to_numpy(), donors[cols].to_numpy(), 5, skip=queries["id"].to_numpy() if same else None)
    assert list(zip(got["id"], got["neighbor"])) == [(i, j) for i, j, _ in want]
    np.testing.assert_array_equal(got["dist"], [d for _, _, d in want])
    np.testing.assert_array_equal(got["value"].astype(float), donors["c1"].to_numpy()[got["neighbor"]])


def test_near_equals_plain_distances_bit_by_bit():
    rng = np.random.default_rng(9)
    x, d = rng.normal(3e4, 1e-3, (60, 16)), rng.normal(3e4, 1e-3, (300, 16))  # far from the origin: products lose most digits
    d[:50] = x[:50]
    qid, did = np.arange(60), rng.permutation(300)
    plain = neighbors.distances(x, d, 2)
    plain[qid[:, None] == did[None]] = np.inf
    order = np.lexsort((np.broadcast_to(did, plain.shape), plain), axis=1)[:, :7]
    for within in (None, np.take_along_axis(plain, order, 1)[:, -1], np.full(60, np.inf)):
        row, at, dist = neighbors._near(x, d, qid, did, 7, 2, True, within)
        np.testing.assert_array_equal(at, order.ravel())
        np.testing.assert_array_equal(row, np.repeat(qid, 7))
        np.testing.assert_array_equal(dist, np.take_along_axis(plain, order, 1).ravel())
    x[3, 2] = np.nan
    d[5, 4] = np.inf
    assert len(neighbors._near(x, d, qid, did, 7, 2, True)[0]) == 420
