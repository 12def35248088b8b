import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabreg.llm import token_files
from tabreg.llm.token_files import ByteEncoder, canonical_codes, code_lengths, pack_bits, token_file_digests, unpack_bits

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    rng = random.Random(2)
    signs = [*" \n\tabcdethinosrgAB.,!0123é中😀'\x85\xa0 　\x1c\x1f\x0b\r​", "  ", "the", "'s", "\r\n", "<|endoftext|>"]
    given = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(6000)] + ["", " ", "a\nb c.", "wörd, wörd."]
    flat, ends = ByteEncoder(PATH).encode(given)
    want = Tokenizer.from_file(PATH).encode_batch(given, add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [e.ids for e in want]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_CHUNKS", 20)
    encoder, plain = ByteEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    for _ in range(20):
        given = [" ".join(rng.choice(["one", "two.", "three,", f"w{rng.randint(0, 99)}"]) for _ in range(30)) for _ in range(5)]
        flat, ends = encoder.encode(given)
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [
            e.ids for e in plain.encode_batch(given, add_special_tokens=False)]


@pytest.mark.parametrize("counts,limit", [([5], 4), ([1, 1], 1), ([1, 2, 4, 8, 16, 32, 64, 128], 4), (list(range(1, 300)), 9),
                                          ([0, 7, 0, 7, 1], 3), ([2 ** k for k in range(30)], 6)])
def test_codes(counts, limit):
    counts = np.array(counts)
    lengths = code_lengths(counts, limit)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    order, codes = canonical_codes(lengths)
    words = [format(int(codes[i]), f"0{lengths[i]}b") for i in order]
    assert not any(b.startswith(a) for a in words for b in words if a is not b)
    ids = np.random.default_rng(0).choice(np.flatnonzero(counts), 5000).astype(np.uint32)
    raw, start = pack_bits(ids, codes, lengths)
    packed = zlib.compress(lengths.tobytes())
    for step in (1, 7, 512, 6000):
        marks = start[::step]
        size = np.minimum(step, len(ids) - step * np.arange(len(marks)))
        assert (unpack_bits(raw, marks, size, packed) == ids).all()


def test_lengths_are_best_without_a_limit():
    import heapq
    counts = np.random.default_rng(1).integers(1, 1000, 60)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (counts * code_lengths(counts, 18)).sum() == cost


def test_files(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 50)
    plain = Tokenizer.from_file(PATH)
    rows = [(k, f"text number {k} " + "word " * (k % 40)) for k in range(300)] + [(700, None), (701, ""), (702, "long text " * 5000)]
    got = [tuple(r) for r in token_file_digests(docs(rows, 7), PATH).orderBy("doc_id").collect()]
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    twice = token_file_digests(docs([(1, "a"), (1, "b c"), (None, "x")]), PATH).collect()
    assert sorted(r.start for r in twice) == [0, 2, 4] or sorted(r.start for r in twice) == [0, 2, 5]
    assert min(twice, key=lambda r: r.start).doc_id is None
    assert token_file_digests(docs([]), PATH).count() == 0
