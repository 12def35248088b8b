"""Benchmark passages in documents: q-gram lemma filter over diagonal bands, verified by banded alignment.

Letters and digits are lower-cased, everything else becomes single spaces. An item is cut into pieces of ``PART`` characters, ``STEP``
apart, so that a verbatim excerpt of ``PART + STEP - 1`` characters (59, about ten words) holds a whole piece wherever it begins; an
item of up to ``PIECE`` characters is a piece itself, too. A piece of m characters occurs in a document if a part of it lies within
k = ``BUDGET`` * m edits. Then by the q-gram lemma at least (m - q + 1) - k*q of its q-grams occur there near one diagonal (document
place minus piece place), within k of each other. Shared q-grams are counted in overlapping bands of diagonals, each twice as wide
as k; bands that meet the bound are aligned with the piece, diagonals of the band and k more on either side, all candidates of a
batch at once.

The benchmark is a stated query set: it is taken in blocks of about ``BLOCK_CHARS`` characters, each of which goes to every task and
meets every whole text; texts themselves never move. Nothing is capped.

Rows: NULL or empty texts hold nothing. Items with fewer than ``LEAST`` letters and digits are searched exactly, as whole words.
Repeated documents give repeated rows; a NULL doc_id is kept as NULL. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import narrow, pieces_of_batches, release_memory

Q = 8
PIECE = 96  # longest piece
PART, STEP = 48, 12
BUDGET = 0.1
LEAST = 24
BLOCK_CHARS = 1 << 20
PAIRS_AT_ONCE = 1 << 20
STAGE_BYTES = 1 << 19   # text searched at a time as a stage of a pipeline, beside what other stages left in memory
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKS = 20  # bits of the table that most places of a text do not pass


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Code point to lower-case letter or digit; 32 for anything else."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        out[c] = ord(low[0]) if low[0].isalnum() else 32
    return out


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each followed by a 0; their places within their texts; the end of each text."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    every = np.zeros(int(size.sum()) + len(texts), np.uint32)
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    for r, s in zip(raw, starts.tolist(), strict=True):
        every[s:s + len(r)] = r
    out = _plain()[every]
    out[ends - 1] = 0
    blank = out == 32
    before = np.r_[np.uint32(0), out[:-1]]
    keep = ~(blank & ((before == 32) | (before == 0)))
    place = np.arange(len(every)) - np.repeat(starts, size + 1)
    return out[keep], place[keep], np.cumsum(np.add.reduceat(keep.astype(np.int64), starts)) if len(texts) else ends


def grams(chars: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` characters from each place on; 0 where fewer follow or a text ends among them."""
    h, width, power = chars.astype(np.uint64), 1, int(_BASE)
    valid = chars != 0
    while width < Q:
        h = h[:-width] * np.uint64(power) + h[width:]
        valid = valid[:-width] & valid[width:]
        width, power = 2 * width, power * power % (1 << 64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    h[~valid] = 0
    return np.r_[h, np.zeros(len(chars) - len(h), np.uint64)]


def _edits(piece: np.ndarray, text: np.ndarray) -> int:
    """Least edits of a piece against any part of a text."""
    cols, row = np.arange(len(text) + 1), np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(piece.tolist(), 1):
        row = np.r_[i, np.minimum(row[:-1] + (text != c), row[1:] + 1)]
        row = np.minimum.accumulate(row - cols) + cols
    return int(row.min())


@dataclass
class Pieces:
    item: np.ndarray      # of each piece
    chars: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    gram: np.ndarray      # sorted different hashes
    first: np.ndarray     # where each hash's (piece, place) pairs begin
    piece: np.ndarray
    place: np.ndarray
    marks: np.ndarray

    @staticmethod
    def build(items: list[tuple[int, str]]) -> Pieces | None:
        owner, chars = [], []
        for i, (_, text) in enumerate(items):
            c = normalise([text])[0][:-1]
            c = c[:-1] if len(c) and c[-1] == 32 else c
            if (c != 32).sum() < LEAST:
                continue
            if len(c) <= PIECE:
                owner.append(i)
                chars.append(c)
            if len(c) > PART:  # two halves of the last 96 characters among them
                for s in sorted({*range(0, len(c) - PART, STEP), max(len(c) - 2 * PART, 0), len(c) - PART}):
                    owner.append(i)
                    chars.append(c[s:s + PART])
        if not chars:
            return None
        size = np.array([len(c) for c in chars])
        budget = np.minimum((BUDGET * size).astype(np.int64), (size - Q) // Q)
        found = [grams(np.r_[c, np.uint32(0)])[:len(c) - Q + 1] for c in chars]
        h = np.concatenate(found)
        piece = np.repeat(np.arange(len(chars)), [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found])
        order = np.argsort(h, kind="stable")
        gram, first = np.unique(h[order], return_index=True)
        marks = np.zeros(1 << _MARKS, dtype=bool)
        marks[(gram >> np.uint64(64 - _MARKS)).astype(np.int64)] = True
        return Pieces(np.array([items[o][0] for o in owner], dtype=object), chars, budget, size - Q + 1 - budget * Q, gram,
                      np.r_[first, len(h)], piece[order], place[order], marks)

    def candidates(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first diagonal of a band) of every band that meets the bound."""
        h = grams(chars)
        at = np.flatnonzero(self.marks[(h >> np.uint64(64 - _MARKS)).astype(np.int64)] & (h != 0))
        k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        hit = self.gram[k] == h[at]
        at, k = at[hit], k[hit]
        least, reach = int(self.bound.min()), PIECE + int(self.budget.max())  # as many hits must lie within a piece's length
        near = np.searchsorted(at, at + reach, side="right") - np.arange(len(at)) >= least
        last = np.maximum.accumulate(np.where(near, at + reach, -1)) if len(at) else at
        at, k = at[at <= last], k[at <= last]
        times = self.first[k + 1] - self.first[k]
        ends = np.cumsum(times)
        key, count, start = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while start < len(at):  # so many (piece, place) pairs at a time, however often a q-gram repeats
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
            n, g = times[start:stop], k[start:stop]
            pair = np.repeat(self.first[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            piece = self.piece[pair]
            diagonal = np.repeat(at[start:stop], n) - self.place[pair] + PIECE  # not negative
            band = diagonal // (self.budget[piece] + 1)
            more = np.sort(np.concatenate([piece * (1 << 40) + band, piece * (1 << 40) + np.maximum(band - 1, 0)]))
            new = np.flatnonzero(np.r_[True, more[1:] != more[:-1]])
            key, count = np.r_[key, more[new]], np.r_[count, np.diff(np.r_[new, len(more)])]
            if start:
                key, at_key = np.unique(key, return_inverse=True)
                count = np.bincount(at_key, weights=count).astype(np.int64)
            start = stop
        piece = key >> 40
        good = count >= self.bound[piece]
        piece, band = piece[good], key[good] & ((1 << 40) - 1)
        return piece, band * (self.budget[piece] + 1) - PIECE

    def align(self, chars: np.ndarray, piece: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each candidate's piece in its band, and the (first, last) place of the text part."""
        edits, first, last = (np.full(len(piece), 1 << 20, np.int64) for _ in range(3))
        shape = np.array([len(self.chars[p]) * 1000 + self.budget[p] for p in piece])
        padded = np.r_[np.zeros(4 * PIECE, np.uint32), chars, np.zeros(4 * PIECE, np.uint32)]
        for s in np.unique(shape):  # pieces of one length together
            for part in np.array_split(own := np.flatnonzero(shape == s), len(own) // 4096 + 1):
                m, k = divmod(int(s), 1000)
                text = np.stack([self.chars[p] for p in piece[part]])
                low = diagonal[part] - k + 4 * PIECE
                wide = 2 * (k + 1) + 2 * k
                cols = np.arange(wide)
                cost = np.zeros((len(part), wide), np.int64)
                start = low[:, None] + cols  # where the path of a cell began
                for i in range(m):
                    here = padded[low[:, None] + i + cols]
                    same = cost + ((here != text[:, i:i + 1]) | (here == 0))
                    drop = np.c_[cost[:, 1:], np.full(len(part), 1 << 20)] + 1
                    new = np.minimum(same, drop)
                    origin = np.where(same <= drop, start, np.c_[start[:, 1:], start[:, -1:]])
                    run = new - cols
                    best = np.minimum.accumulate(run, axis=1)
                    source = np.maximum.accumulate(np.where(run == best, cols, 0), axis=1)
                    cost, start = best + cols, np.take_along_axis(origin, source, 1)
                end = cost.argmin(1)
                rows = np.arange(len(part))
                edits[part] = cost[rows, end]
                first[part] = start[rows, end] - 4 * PIECE
                last[part] = low + m + end - 1 - 4 * PIECE
        return edits, first, last

    def find(self, texts: list[str]) -> list[tuple[int, object, int, int, int, int]]:
        """(text number, item, first and end place, pieces, least edits) of every item found in a text."""
        chars, place, ends = normalise(texts)
        piece, diagonal = self.candidates(chars)
        edits, first, last = self.align(chars, piece, diagonal)
        good = edits <= self.budget[piece]
        out: dict[tuple[int, object], list] = {}
        for p, e, a, b in zip(piece[good].tolist(), edits[good].tolist(), first[good].tolist(), last[good].tolist(), strict=True):
            a, b, k = max(a, 0), min(b, len(chars) - 1), int(self.budget[p])
            t, until = (int(np.searchsorted(ends, x, side="right")) for x in (a, b))
            whole = t == until
            for t in range(t, until + 1):
                begin, end = int(ends[t - 1]) if t else 0, int(ends[t]) - 1
                x, y = max(a, begin), min(b, end)
                if not whole:  # the path crosses the end of a text
                    e = _edits(self.chars[p], chars[max(a - k, begin):min(b + k + 1, end)])
                    if e > k:
                        continue
                have = out.setdefault((t, self.item[p]), [1 << 60, 0, set(), 1 << 20])
                have[0], have[1], have[3] = min(have[0], int(place[x])), max(have[1], int(place[y]) + 1), min(have[3], e)
                have[2].add(p)
        return [(t, i, v[0], v[1], len(v[2]), v[3]) for (t, i), v in out.items()]


@dataclass
class Words:
    """Short items, found exactly between word borders: hashes of windows that begin with a word, by length."""
    size: dict[int, tuple[np.ndarray, list[list[tuple[object, np.ndarray]]]]]  # sorted hashes and the items of each

    @staticmethod
    def build(items: list[tuple[int, str]]) -> Words | None:
        found: dict[int, dict[int, list]] = {}
        for i, text in items:
            c = normalise([text])[0][:-1]
            c = c[:-1] if len(c) and c[-1] == 32 else c
            if 0 < (c != 32).sum() < LEAST:
                h = int((c.astype(np.uint64) * Words._powers(len(c), _BASE)).sum())
                found.setdefault(len(c), {}).setdefault(h, []).append((i, c))
        return Words({m: (np.array(sorted(t), np.uint64), [t[h] for h in sorted(t)]) for m, t in found.items()}) if found else None

    @staticmethod
    def _powers(n: int, base: np.uint64) -> np.ndarray:
        return np.r_[np.uint64(1), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))][:n]

    def find(self, texts: list[str]) -> list[tuple[int, object, int, int, int, int]]:
        """As Pieces.find; an item is one piece."""
        chars, place, ends = normalise(texts)
        blank = (chars == 0) | (chars == 32)
        begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        total = np.r_[np.uint64(0), np.cumsum(chars.astype(np.uint64) * self._powers(len(chars), _BASE))]
        back = self._powers(len(chars), np.uint64(pow(int(_BASE), -1, 1 << 64)))
        out: dict[tuple[int, object], list] = {}
        for m, (hashes, items) in self.size.items():
            at = begins[begins + m < len(chars)]
            at = at[blank[at + m]]
            h = (total[at + m] - total[at]) * back[at]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            for a, j in zip(at[same].tolist(), k[same].tolist(), strict=True):
                for item, c in items[j]:
                    if (chars[a:a + m] == c).all():
                        have = out.setdefault((int(np.searchsorted(ends, a, side="right")), item), [1 << 60, 0])
                        have[:] = min(have[0], int(place[a])), max(have[1], int(place[a + m - 1]) + 1)
        return [(t, i, v[0], v[1], 1, 0) for (t, i), v in out.items()]


@dataclass
class Block:
    parts: list[Pieces | Words]

    def find(self, texts: list[str]) -> list[tuple[int, object, int, int, int, int]]:
        if len(self.parts) == 1:
            return self.parts[0].find(texts)
        out: dict[tuple[int, object], tuple] = {}
        for t, i, a, b, n, e in (f for p in self.parts for f in p.find(texts)):
            x = out.get((t, i), (a, b, 0, e))
            out[t, i] = min(a, x[0]), max(b, x[1]), n + x[2], min(e, x[3])
        return [(*k, *v) for k, v in out.items()]


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark's pieces, block by block."""
    rows = narrow(benchmark, item_id="item_id:long", text="text:string").filter("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        own = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]
        parts = [p for p in (Pieces.build(items), Words.build(items)) if p is not None]
        if parts:
            yield Block(parts)


def find_passages(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, first_char, end_char, n_pieces, edits): every document that holds a passage of an item."""
    schema = "doc_id long, item_id long, first_char long, end_char long, n_pieces long, edits long"
    rows = narrow(docs, doc_id="doc_id:long", text="text:string")

    def search(pieces: Block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces_of_batches(batches, "text", 1 << 20):
                ids = batch.column(0).to_pylist()
                found = [(ids[t], *rest) for t, *rest in pieces.find([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(6)],
                                                 [c.split(" ")[0] for c in schema.split(", ")])
        return run

    out = None
    for pieces in benchmark_blocks(benchmark, block_chars):
        part = rows.mapInArrow(search(pieces), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, that hold no passage of the benchmark. NULL and empty texts hold none."""
    at = docs.columns.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string"))

    def clean(pieces: Block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_memory()
            for batch in pieces_of_batches(batches, "text", STAGE_BYTES):
                held = np.zeros(batch.num_rows, dtype=bool)
                for t, *_ in pieces.find([t or "" for t in batch.column(at).to_pylist()]):
                    held[t] = True
                yield batch.filter(pa.array(~held)) if held.any() else batch
        return run

    for pieces in benchmark_blocks(benchmark):
        docs = docs.mapInArrow(clean(pieces), docs.schema)
    return docs
