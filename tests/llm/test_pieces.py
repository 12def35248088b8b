import hashlib
import random

import public_tokenizers
import sentencepiece

from tabreg.llm.pieces import Encoder, Vocabulary, decode_flat, decode_pieces, encode_pieces, round_trip_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(1)
    signs = [*" \n\t▁abcdethinosrgAB.,!0123éßñ中あ😀\x00\r", "  ", "   ", "the", "ing", "▁▁"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += [" " * n + "x" + " " * m for n in range(35) for m in (0, 1, 17, 33)] + ["a" * n for n in range(90)]
    return [*out, "ab" * 300, "the" * 400, "=" * 500, "x" * 5000, "word " * 3000]


def test_equals_the_library():
    model, vocab = sentencepiece.SentencePieceProcessor(model_file=PATH), Vocabulary(PATH)
    given = texts()
    flat, ends = Encoder(vocab).encode(given)
    want = model.encode(given)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    assert decode_flat(vocab, flat, ends) == model.decode(want)


def test_rows(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "long " * 20_000), (1, "Hello  world\n"), (None, "x")]
    got = round_trip_digests(docs(rows), PATH).collect()
    want = []
    for i, t in rows:
        ids = model.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = encode_pieces(docs(rows), PATH)
    assert sorted((r.doc_id or 0, r.text) for r in decode_pieces(ids, PATH).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert round_trip_digests(docs([]), PATH).count() == 0
    assert encode_pieces(docs([]), PATH).count() == 0
