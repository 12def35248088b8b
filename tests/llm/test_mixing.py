import random
import re

import numpy as np
import pytest

from tabreg.llm import mixing
from tabreg.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1.0, 2.0, 3.0), share=1.0, cap=3):
    """By source: shares by weight, those above the cap stopped and the rest shared again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    words, full = share * sum(sizes.values()), set()
    while True:
        rest = words - sum(cap * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        got = {s: cap * sizes[s] if s in full else rest * weight[s] / free for s in names}
        above = {s for s in names if s not in full and got[s] > cap * sizes[s]}
        if not above:
            return got
        full |= above


def best_rates(sizes, target, cap=3):
    """Bisection for the tilt of one source."""
    x = np.array([s for s in sizes if s], float)
    x /= x.mean()
    want = target / sum(sizes) * len(x)
    low, high = -1e4, 1e4
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if (x * np.minimum(cap, np.exp(np.minimum(mid * x, 50)))).sum() < want else (low, mid)
    return np.minimum(cap, np.exp(np.minimum(high * x, 50)))


@pytest.fixture
def table(spark):
    def build(rows, parts=3):
        return spark.createDataFrame([(*r, 1, 2, "x", 0) for r in rows],
                                     "doc_id long, text string, source string, no long, size long, late string, __salt int").repartition(parts)
    return build


def corpus(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "Z", "é", None, "tiny" if i % 9 == 0 else "a"])
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)) if i % 17 else "", source))
    return rows


@pytest.mark.parametrize("few", [100_000, 0])
def test_targets_rates_and_copies(table, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = corpus()
    got = {r.doc_id: r for r in mix_sources(table(rows)).collect()}
    assert len(got) == len(rows)
    size, by = {}, {}
    for i, t, s in rows:
        size[i] = len(WORD.findall(t))
        by.setdefault(s, []).append(i)
    want = targets({s: sum(size[i] for i in ids) for s, ids in by.items()})
    for s, ids in by.items():
        total = sum(size[i] for i in ids)
        rates = iter(best_rates([size[i] for i in ids], want[s]))
        for i in ids:
            r = got[i]
            assert (r.size, r.source_size) == (size[i], total)
            assert r.target == pytest.approx(want[s], rel=1e-12)
            assert r.rate == pytest.approx(next(rates) if size[i] else 0, rel=1e-6, abs=1e-6)
            assert r.taken == r.copies * r.size <= 3 * r.size
            assert int(r.rate - 1e-9) <= r.copies <= int(r.rate) + 1 or not r.size
        taken = sum(got[i].taken for i in ids)
        off = abs(want[s] - taken)
        assert off < 0.02 * want[s] or all(size[i] > off for i in ids if got[i].copies < got[i].rate)  # nothing more fits


def test_reruns_agree_on_any_partitions(table):
    rows = corpus(200)
    one, two = (sorted(map(tuple, mix_sources(table(rows, p)).collect())) for p in (1, 7))
    assert one == two


def test_edges(table, spark):
    assert mix_sources(table([])).count() == 0
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "b")]
    got = mix_sources(table(rows)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(k, 0, 0, 0.0, 0) for k in (1, 2, 3)]
    rows = [(1, "x " * 200_000, "a"), (None, "b c", "b"), (5, "d e f", None), (5, "d e f", None), (6, "g", "b")]
    got = mix_sources(table(rows)).collect()
    assert sum(r.size for r in got) == 200_009 and all(r.taken <= 3 * r.size for r in got)
    assert {r.target for r in got if r.doc_id in (5, 6, None)} == {9.0, 18.0}  # stopped at three times their source
    assert {r.taken for r in got if r.doc_id == 5} == {9}
    assert all(r.taken == 3 * r.size for r in got if r.source_size == 3)
