import random
import re

import numpy as np
import pytest

from tabreg.llm import minhash
from tabreg.llm.minhash import keep_one_of_each_group, near_duplicates, shingle_sets, signatures, similar_bits


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}


def brute(rows, size=4, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows]
    name = list(range(len(rows)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(x), root(y)
                name[max(p, q)] = min(p, q)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(low.get(root(k), 1 << 60), i)
    return sorted((i, len(s), low[root(k)], i == low[root(k)]) for k, (i, s) in enumerate(sets))


def corpus(rng, n=160):
    words = [a + b for a in "ka lo mi tu re".split() for b in "ra son ting la do vex".split()]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(n)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = [" ".join(b) for b in base]
    for k in range(n):  # copies with changes around the threshold
        x = list(base[k % 12])
        for _ in range(rng.randint(0, max(1, len(x) // 14))):
            x[rng.randrange(len(x))] = rng.choice(words)
        rows.append(" ".join(x).upper() if k % 3 else "\n".join(x))
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(3, 40))]) for _ in range(60)]
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(40):  # every text near its neighbours only
        chain = chain[3:] + [rng.choice(words) for _ in range(3)]
        rows.append(" ".join(chain))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[k] * 2 + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block", [256, 4])
def test_equals_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    rows = corpus(rng) + [(9001, "the same text twice over and over"), (9003, "the same text twice over and over")] + [
        (20_000 + k, "the same text twice over and over") for k in range(150)]
    assert sorted(tuple(r) for r in near_duplicates(docs(rows, 6)).collect()) == brute(rows)


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "two one"), (7, "É a b c"), (8, "é a b c"),
            (9, "word " * 30_000), (10, "word " * 50), (11, "a b c d e")]
    got = sorted(tuple(r) for r in near_duplicates(docs(rows)).collect())
    assert got == brute(rows)
    again = near_duplicates(docs([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in again) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(docs([])).count() == 0


def test_stage(docs):
    rng = random.Random(10)
    rows = corpus(rng, 60)
    table = docs(rows)
    kept = keep_one_of_each_group(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in brute(rows, 5) if k]


def test_sketches_judge_closely():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    for share in (0.8, 0.9):
        misses = 0
        for _ in range(60):
            both, rest = rng.sample(words, 200), round(200 / share - 200)
            texts = [" ".join(both), " ".join(both + rng.sample(words, rest))]
            h, ends = shingle_sets(texts, 1)
            _, sketch = signatures(h, ends)
            misses += int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) > similar_bits(0.8)
        assert misses == 0
    h, ends = shingle_sets([" ".join(words[:300]), " ".join(words[200:500])], 1)
    _, sketch = signatures(h, ends)
    assert int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) > similar_bits(0.8)


def test_only_pairs_between_components_go_to_the_other_hubs(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 7)], "a long, b long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)], "node long, component long")
    assert sorted(tuple(r) for r in minhash._apart(pairs, labels).collect()) == [(1, 3), (6, 7)]
