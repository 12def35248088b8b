import random

from tabreg.llm.decontaminate import Pieces, find_passages, normalise, without_passages

SIGNS = "abcdefghijklmnopqrstuvwxyz     "


def prose(rng, n):
    return "".join(rng.choice(SIGNS) for _ in range(n))


def plain(text):
    return "".join(map(chr, normalise([text])[0][:-1])).strip()


def distance_within(piece, text):
    """Least edits of a piece against any part of a text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(before[j - 1] + (c != x), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def edited(rng, text, times):
    x = list(text)
    for _ in range(times):
        k, kind = rng.randrange(len(x)), rng.random()
        if kind < 0.4:
            x[k] = rng.choice(SIGNS)
        elif kind < 0.7:
            x.insert(k, rng.choice(SIGNS))
        elif len(x) > 1:
            del x[k]
    return "".join(x)


def test_equals_brute_force():
    rng = random.Random(4)
    seen = set()
    for _ in range(120):
        item = plain(prose(rng, rng.choice([30, 50, 96, 100, 140, 220])))
        pieces = Pieces.build([(1, item)])
        if pieces is None:
            continue
        text = prose(rng, 150) + " " + edited(rng, item, rng.randint(0, max(1, len(item) // 7))) + " " + prose(rng, 90)
        want = any(distance_within("".join(map(chr, c)), plain(text)) <= b for c, b in zip(pieces.chars, pieces.budget, strict=True))
        assert bool(pieces.find([text])) == want
        seen.add(want)
    assert seen == {True, False}


def test_tables(spark, docs):
    rng = random.Random(5)
    items = [(k, prose(rng, 160)) for k in range(12)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (93, items[0][1]), (None, "x" * 99)],
                                  "item_id long, text string")
    rows = [(k, prose(rng, 300)) for k in range(40)]
    rows += [(100 + k, f"{prose(rng, 80)}\n{t.upper()}! {prose(rng, 50)}") for k, (_, t) in enumerate(items)]
    rows += [(200, items[3][1][20:140]), (201, None), (202, ""), (203, prose(rng, 100_000) + items[5][1]), (None, items[4][1]),
             (100, rows[40][1])]
    for chars in (1 << 20, 500):
        got = {(r.doc_id, r.item_id) for r in find_passages(docs(rows), bench, chars).collect()}
        assert got == {(100 + k, k) for k in range(12)} | {(100, 93), (200, 3), (203, 5), (None, 4)}
    place = find_passages(docs([(1, f"12345 {items[2][1]} end")]), bench).collect()[0]
    lead = len(items[2][1]) - len(items[2][1].lstrip())
    assert abs(place.first_char - 6 - lead) <= 1 and place.edits == 0
    table = docs(rows)
    kept = without_passages(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 201, 202]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert find_passages(docs(rows), nothing).count() == 0 and without_passages(table, nothing).count() == len(rows)
    assert find_passages(docs([]), bench).count() == 0


def test_excerpts_at_every_offset():
    rng = random.Random(6)
    item = plain(prose(rng, 260))
    pieces = Pieces.build([(1, item)])
    for size in (59, 70, 86, 110):
        for at in range(len(item) - size + 1):
            excerpt = item[at:at + size]
            assert pieces.find([f"{plain(prose(rng, 60))} {excerpt} {plain(prose(rng, 60))}"]), (size, at)
    for _ in range(60):  # one edit in twenty characters, anywhere
        at = rng.randrange(len(item) - 80)
        assert pieces.find([f"{prose(rng, 60)} {edited(rng, item[at:at + 80], 4)} {prose(rng, 60)}"])
    assert not pieces.find([prose(rng, 5000)])


def test_short_items_as_whole_words(spark, docs):
    bench = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "Cañón azul"), (3, "x"), (4, "?!"), (5, "blue whale " * 9), (5, "blue whale")],
                                  "item_id long, text string")
    rows = [(10, "so: what is 2+2"), (11, "what is 2 22"), (12, "el CAÑÓN  azul."), (13, "cañón azules"), (14, "a\nx"), (15, "xx ax xa"),
            (16, "blue whale, " * 12), (17, "What is 2 + 2? what is 2 2"), (18, ""), (19, None), (20, "x")]
    got = {(r.doc_id, r.item_id): r for r in find_passages(docs(rows), bench).collect()}
    assert set(got) == {(10, 1), (12, 2), (14, 3), (16, 5), (17, 1), (20, 3)}
    assert (got[17, 1].first_char, got[17, 1].end_char, got[10, 1].first_char, got[10, 1].edits) == (0, 26, 4, 0)
    assert sorted(r.doc_id for r in without_passages(docs(rows), bench).collect()) == [11, 13, 15, 18, 19]


def test_long_repetitive_text_in_bounded_memory(spark, docs):
    import tracemalloc

    pieces = Pieces.build([(1, "ab" * 60), (2, "the quick brown fox jumps over the lazy dog near the river bank today")])
    text = normalise(["ab" * 200_000])[0]
    tracemalloc.start()
    piece, _ = pieces.candidates(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(piece) and peak < 400e6
    rows = [(1, "ab" * 40_000), (2, None), (3, ""), (4, "clean words only here")]
    bench = spark.createDataFrame([(1, "ab" * 60)], "item_id long, text string")
    assert {r.doc_id for r in find_passages(docs(rows), bench).collect()} == {1}
    kept = without_passages(docs(rows), bench)
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == {2, 3, 4}
