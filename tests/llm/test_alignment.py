import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabreg.llm import alignment
from tabreg.llm.alignment import Csr, alignment_digests, letters_of_bytes, product_sizes, row_product, token_links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]


def brute(rows):
    """The contract by loops over tokens and bytes."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(letters_of_bytes())}
    second = sentencepiece.SentencePieceProcessor(model_file=B)

    def spans(pieces):
        out, at = [], 0
        for i, raw in pieces:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs = []
    for doc_id, text in rows:
        text = text or ""
        a = [(i, bytes(byte_of[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode())
             for i in second.encode(text)]
        want = f" {text}".encode()
        if not text or b"".join(r for _, r in a) != want or b"".join(r for _, r in b) != want:
            a = b = []
        docs.append((doc_id, spans(a), spans(b)))
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in docs]
    count = Counter(p for per in links for p in set(per))
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for (doc_id, a, b), per in zip(docs, links, strict=True):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [([str(x[0]) for x in a if s <= x[1] < e], [str(y[0]) for y in b if s <= y[1] < e])
                  for s, e in zip([0, *ends], ends, strict=False)]
        text = ";".join(f"{','.join(g)}|{','.join(h)}" for g, h in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(per), sum(count[p] == top[p[0]] for p in per), sum(count[p] for p in per),
                    hashlib.sha256(text.encode()).hexdigest() if text else "", sum(len(g) * len(h) for g, h in groups)))
    return out


def given():
    rng = random.Random(5)
    signs = [*" \n\tabcdethinosrgAB.,!0123éßñ中あ😀\x00\r", "  ", "the", "ing", "Hello", " world", "<s>", "<|endoftext|>", "====", "'s"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(60)]
    texts += [None, "", " ", "a▁b", "▁", "<|endoftext|>", "</s> <unk>", "Hello world", "Hello world", "x" * 400, "=" * 333, "中" * 50]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "Hello world"), (None, "Hello world"), (7, None)]


@pytest.mark.parametrize("block_pairs,chunk", [(200_000, 1 << 20), (50, 100)])
def test_equals_brute_force(spark, docs, monkeypatch, block_pairs, chunk):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block_pairs)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    rows = given()
    got = alignment_digests(docs(rows), A, B)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_long_texts_and_empty_tables(spark, docs):
    rows = [(1, "ab " * 60_000), (2, "\n" * 3_000), (3, "z" * 5_000), (4, "word"), (5, "word")]
    got = {r.doc_id: r for r in alignment_digests(docs(rows), A, B).collect()}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got.values())  # both cover the same bytes
    assert got[4].count_sum == 2 * got[4].n_links
    assert alignment_digests(docs([]), A, B).count() == 0
    assert alignment_digests(docs([(1, None), (2, "")]), A, B).filter("n_a + n_b + n_groups + n_links + count_sum = 0 and groups_sha256 = ''").count() == 2


def test_links(spark, docs):
    rows = [(1, "Hello world 中あ <s>"), (2, None), (3, "aaaa bbbb")]
    digests = {r.doc_id: r for r in alignment_digests(docs(rows), A, B).collect()}
    over = token_links(docs(rows), A, B).collect()
    assert Counter(r.doc_id for r in over) == {k: r.n_links for k, r in digests.items() if r.n_links}
    size = {k: len(f" {t}".encode()) for k, t in rows if t}
    assert {k: sum(r.n_bytes for r in over if r.doc_id == k) for k in size} == size
    assert len({(r.doc_id, r.a_at, r.b_at) for r in over}) == len(over)
    grouped = token_links(docs(rows), A, B, kind="group").collect()
    assert Counter(r.doc_id for r in grouped) == {k: r.n_group_links for k, r in digests.items() if r.n_group_links}
    assert {(r.doc_id, r.a_at, r.b_at) for r in over} <= {(r.doc_id, r.a_at, r.b_at) for r in grouped}
    with pytest.raises(ValueError):
        token_links(docs(rows), A, B, kind="none")


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_row_product(limit):
    rng = np.random.default_rng(3)
    a, b = (rng.random((9, 11)) < 0.3).astype(int), (rng.random((11, 6)) < 0.3).astype(int) * rng.integers(1, 5, (11, 6))

    def csr(m):
        i, j = np.nonzero(m)
        return Csr(np.r_[0, np.cumsum(np.bincount(i, minlength=len(m)))], j, m.shape[1], m[i, j])

    out = np.zeros((9, 6), int)
    for first, part in row_product(csr(a), csr(b), limit):
        out[part.rows() + first, part.cols] = part.value
    assert (out == a @ b).all()
    flipped = csr(b).transposed()
    again = np.zeros((6, 11), int)
    again[flipped.rows(), flipped.cols] = flipped.value
    assert (again == b.T).all()
    assert product_sizes(csr(a), csr(b)).tolist() == ((a > 0).astype(int) @ (b > 0).sum(axis=1)).tolist()
