"""Piece encoding and decoding with a public subword model, in vectorised merge rounds.

A text becomes words at places that no piece of the vocabulary crosses (before a run of spaces, around line ends, and inside
very long words between two characters that never stand side by side in a piece). All different words of a batch lie in flat
numpy arrays. Each round finds every word's best pair (segmented minimum of pair ranks), merges its leftmost non-overlapping
occurrences in all words at once, compacts the arrays and drops words without pairs. Where a merged piece can at once form a
better pair than the one just merged, only the first occurrence is merged in that round, so the order equals that of a queue
that always takes the best, then leftmost, pair.

Models: BPE with byte fallback, identity normalisation, a dummy prefix and kept spaces. NULL text counts as empty text and
gives no ids. NULL id lists decode to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tabreg.llm.common import narrow, pieces_of_batches

SPACE = "▁"
WORDS = re.compile(r" *[^ \n]+|\n| +")
NO_PAIR = np.int64(1 << 40)
CHARACTERS = 0x110000
LONG_WORD = 24
KEPT_WORDS = 100_000


class Vocabulary:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        is_byte = [model.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not (is_byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            if is_byte[i]:
                value = int(self.text[i][3:-1], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not model.is_control(i):
                self.bytes_of[i] = (" ⁇ " if model.is_unknown(i) else self.text[i].replace(SPACE, " ")).encode()
        score = {i: model.get_score(i) for i in normal}
        levels = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {i: levels[s] for i, s in score.items()}
        ids = {self.text[i]: i for i in normal}
        self.base = n + CHARACTERS
        self.symbol = np.arange(n, n + CHARACTERS, dtype=np.int64)  # a character without a piece is n + its code point
        pairs: dict[int, int] = {}
        better: set[int] = set()  # pieces that may at once form a pair as good as, or better than, the merge that made them
        beside: set[int] = set()
        for text, i in ids.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
            for k in range(1, len(text)):
                beside.add(ord(text[k - 1]) * CHARACTERS + ord(text[k]))
                a, b = ids.get(text[:k]), ids.get(text[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
                    better |= {x for x in (a, b) if rank[x] >= rank[i]}
        order = sorted(pairs)
        self.pair_key = np.array([*order, np.iinfo(np.int64).max], dtype=np.int64)
        self.pair_id = np.array([*(pairs[k] for k in order), -1], dtype=np.int64)
        self.rank = np.full(n + 1, NO_PAIR, dtype=np.int64)
        for i, r in rank.items():
            self.rank[i] = r
        # a level that several pieces share is merged one by one too
        count = np.bincount(np.fromiter(rank.values(), np.int64), minlength=len(levels))
        one_by_one = {rank[i] for i in better} | set(np.flatnonzero(count > 1).tolist())
        self.one_by_one = np.zeros(len(levels) + 1, dtype=bool)
        self.one_by_one[list(one_by_one)] = True
        self.beside = np.array(sorted(beside), dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.searchsorted(self.pair_key, key)
        merged = np.where(self.pair_key[at] == key, self.pair_id[at], -1)
        return self.rank[merged], merged

    def cut(self, word: str) -> list[str]:
        """A long word in parts between which no piece can reach."""
        cps = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        key = cps[:-1] * CHARACTERS + cps[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        ends = [0, *(np.flatnonzero(self.beside[at] != key) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and the offsets of each word's ids."""
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym = self.symbol[cps]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        merged = np.empty(0, np.int64)
        ranks = np.full(len(sym), NO_PAIR, dtype=np.int64)
        new_id = np.full(len(sym), -1, dtype=np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(sym) else merged
        ranks[inner], new_id[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(ranks, first)
            length = np.diff(np.r_[first, len(sym)])
            if not (best < NO_PAIR).all():  # words that are ready leave
                stay = np.repeat(best < NO_PAIR, length)
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                sym, word, ranks, new_id = sym[stay], word[stay], ranks[stay], new_id[stay]
                length, best = length[best < NO_PAIR], best[best < NO_PAIR]
                if not len(sym):
                    break
            of = np.repeat(np.arange(len(best)), length)
            hit = np.flatnonzero(ranks == best[of])
            run_start = np.r_[True, (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]])]
            in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
            word_start = np.r_[True, of[hit[1:]] != of[hit[:-1]]]
            hit = hit[np.where(self.one_by_one[best[of[hit]]], word_start, in_run % 2 == 0)]
            sym[hit] = new_id[hit]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, ranks, new_id = sym[stay], word[stay], ranks[stay], new_id[stay]
            at = place[hit]
            beside = np.zeros(len(sym), dtype=bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            fresh = np.flatnonzero(beside)
            ranks[fresh], new_id[fresh] = NO_PAIR, -1
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            ranks[fresh], new_id[fresh] = self.pair_ranks(sym[fresh], sym[fresh + 1])
        sym = np.concatenate([merged, *done_sym])
        word = np.concatenate([merged, *done_word]).astype(np.int64)
        order = np.argsort(word, kind="stable")
        return self._bytes_for_unknown(sym[order], word[order], len(words))

    def _bytes_for_unknown(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        missing = np.flatnonzero(sym >= len(self.text))
        if len(missing):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[missing] - len(self.text)).tolist()]
            times = np.ones(len(sym), np.int64)
            times[missing] = [len(b) for b in raw]
            start = np.cumsum(times) - times
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
            size = times[missing]
            where = np.repeat(start[missing] - (np.cumsum(size) - size), size) + np.arange(len(flat))
            sym[where] = self.byte_id[flat]
        return sym, np.r_[0, np.cumsum(np.bincount(word, minlength=n))].astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process; what it keeps serves later tasks too."""
    return Encoder(vocabulary(path))


class Encoder:
    """Encodes texts; ids of words seen before are kept, ``KEPT_WORDS`` words at most."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        parts, owner = [], []
        for k, w in enumerate(words):
            spaced = w.replace(" ", SPACE)
            cut = self.vocab.cut(spaced) if len(w) > LONG_WORD else [spaced]
            parts += cut
            owner += [k] * len(cut)
        flat, ends = self.vocab.encode_words(parts)
        sizes = np.bincount(np.array(owner), weights=np.diff(ends), minlength=len(words)).astype(np.int64)
        for w in words:
            self.index[w] = len(self.index)
        self.flat = np.r_[self.flat, flat]
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text."""
        if len(self.index) > KEPT_WORDS:
            self._forget()
        words: list[str] = []
        counts = []
        for t in texts:
            found = WORDS.findall(" " + (t.replace(SPACE, " ") if SPACE in t else t)) if t else []
            words += found
            counts.append(len(found))
        index = self.index
        fresh = [w for w in set(words) if w not in index]
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        size = self.ends[at + 1] - self.ends[at]
        total = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.repeat(self.ends[at] - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.r_[0, np.cumsum(np.array(counts, dtype=np.int64))].astype(np.int64)]


def decode_flat(vocab: Vocabulary, flat: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of id lists: pieces joined, byte pieces put together again, one leading space dropped."""
    out, ids, pieces = [], flat.tolist(), vocab.bytes_of
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        raw = b"".join([pieces[i] for i in ids[a:b]])
        out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
    return out


def encode_pieces(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of every row. NULL or empty text: an empty list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for batch in pieces_of_batches(batches, "text", 1 << 20):
            flat, ends = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(ends))], ["doc_id", "ids", "n_tokens"])

    rows = narrow(df, doc_id=f"{id_column}:long", text=f"{text_column}:string")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode_pieces(df: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, text) of every row's ids. NULL ids or an empty list: the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            texts = decode_flat(vocab, np.array([i for x in lists for i in x], dtype=np.int64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = narrow(df, doc_id=f"{id_column}:long", ids=f"{ids_column}:array<int>")
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids of every whole text, and the text that decoding those ids gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        vocab = encoder.vocab
        decimal = [str(i) for i in range(len(vocab.text))]
        for batch in pieces_of_batches(batches, "text", 1 << 20):
            flat, ends = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            ids, at = flat.tolist(), ends.tolist()
            written = [hashlib.sha256(",".join([decimal[i] for i in ids[a:b]]).encode()).hexdigest()
                       for a, b in zip(at[:-1], at[1:], strict=True)]
            read = [hashlib.sha256(t.encode()).hexdigest() for t in decode_flat(vocab, flat, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(written, pa.string()),
                                              pa.array(read, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = narrow(df, doc_id=f"{id_column}:long", text=f"{text_column}:string")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
