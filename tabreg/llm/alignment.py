"""Alignment of two tokenizers' ids over the same bytes, by products of sparse incidence matrices.

Over a run of texts, every token of either tokenizer covers some bytes. ``Csr`` matrices, built here from offsets, hold which token
covers which byte (A, B) and which token lies in which group (G, H); a group ends where tokens of both end. Gustavson's row product
adds up rows of the second factor for every entry of a row of the first:

    A x B'   overlap links: (A token, B token, bytes in common)
    G x H'   shared-group links: (A token, B token) of one group
    C x n    C holds how often a document has a linked pair of ids, n what is counted for that pair over the corpus

The corpus-wide counts never meet in one place. Tasks deal their documents into blocks and write, for every chunk of documents, the
matrix C, and for every block its different id pairs with the number of its documents that hold them. These are summed over
(pair, salt) and then over pairs, the highest count of each A id is taken, and both go back to the blocks that asked for them.

Rows: NULL or empty texts, and texts whose tokens of A or B do not give back a space and the text (a text with U+2581, which B reads as
a space), have no tokens: zeros, and '' for the digest. NULL, repeated and tied ids keep their rows; each row counts as a document.
Only id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import cut_lineage, narrow, pieces_of_batches
from tabreg.llm.pieces import Vocabulary, encoder_of
from tabreg.llm.token_files import byte_encoder

CHUNK_BYTES = 1 << 20        # text whose tokens are in numpy at a time
BLOCK_PAIRS = 200_000        # a block of chunks is closed once it has so many different id pairs
EXPANDED = 1 << 22           # entries that a row product holds before they are added up
SALTS = 64
SHIFT = 32                   # an id pair as one number: A's id in the high bits


@dataclass
class Csr:
    """Rows of column numbers: those of row i are ``cols[start[i]:start[i + 1]]``, with ``value`` beside them (None: ones)."""

    start: np.ndarray
    cols: np.ndarray
    n_cols: int
    value: np.ndarray | None = None

    @property
    def n_rows(self) -> int:
        return len(self.start) - 1

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.start))

    def values(self) -> np.ndarray:
        return np.ones(len(self.cols), np.int64) if self.value is None else self.value

    def transposed(self) -> Csr:
        by = np.argsort(self.cols, kind="stable")
        start = np.r_[0, np.cumsum(np.bincount(self.cols, minlength=self.n_cols))].astype(np.int64)
        return Csr(start, self.rows()[by], self.n_rows, None if self.value is None else self.value[by])


def row_product(a: Csr, b: Csr, limit: int = EXPANDED) -> Iterator[tuple[int, Csr]]:
    """Gustavson's product, a run of rows at a time: (first row, those rows of a x b). A run's rows of ``b`` together have about ``limit``
    entries; a single longer row stays whole."""
    size = np.diff(b.start)[a.cols]
    ends = np.r_[0, np.cumsum(size)]
    row_ends = ends[a.start]
    first = 0
    while first < a.n_rows:
        last = max(first + 1, int(np.searchsorted(row_ends, row_ends[first] + limit, side="right")) - 1)
        p, q = int(a.start[first]), int(a.start[last])
        times, total = size[p:q], int(ends[q] - ends[p])
        at = np.repeat(b.start[a.cols[p:q]] - (ends[p:q] - ends[p]), times) + np.arange(total)
        cols = b.cols[at]
        row = np.repeat(np.repeat(np.arange(last - first), np.diff(a.start[first:last + 1])), times)
        value = np.repeat(a.values()[p:q], times) * b.values()[at]
        key = row * b.n_cols + cols
        if total and (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            key, value = key[by], value[by]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.empty(0, np.int64)
        key = key[new]
        start = np.searchsorted(key, np.arange(last - first + 1) * b.n_cols)
        yield first, Csr(start, key % b.n_cols if total else key, b.n_cols, np.add.reduceat(value, new) if total else value)
        first = last


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries of every row of a x b where no two of its terms fall together."""
    ends = np.r_[0, np.cumsum(np.diff(b.start)[a.cols])]
    return np.diff(ends[a.start])


# ---- tokens and their bytes --------------------------------------------------------------------------------------------

class Tokens:
    """Ids of one tokenizer as bytes: those of id i are ``raw[start[i]:start[i + 1]]``."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after another."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.raw[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ids) else 0)]


def letters_of_bytes() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + unseen.index(b)) for b in range(256)]


class PlainByteIds:
    """Ids of a byte-level model, special tokens' strings in a text being plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        from tokenizers import Tokenizer

        self.usual = byte_encoder(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(letters_of_bytes())}
        pieces = [b""] * self.plain.get_vocab_size()
        for text, i in entries.items():
            pieces[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        self.tokens = Tokens(pieces)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [any(s in t for s in self.special) for t in texts]
        flat, ends = self.usual.encode(["" if o else t for t, o in zip(texts, odd, strict=True)])
        if not any(odd):
            return flat, ends
        parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in np.flatnonzero(odd).tolist():
            parts[k] = np.array(self.plain.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def piece_tokens(vocab: Vocabulary) -> Tokens:
    return Tokens(vocab.bytes_of)


@lru_cache(maxsize=1)
def tokenizers_of(byte_model: str, piece_model: str) -> tuple[PlainByteIds, object, Tokens]:
    """Both encoders and B's bytes, one of each per worker process."""
    pieces = encoder_of(piece_model)
    return PlainByteIds(byte_model), pieces, piece_tokens(pieces.vocab)


# ---- one run of texts --------------------------------------------------------------------------------------------------

@dataclass
class Aligned:
    """Tokens of a run of texts that can be aligned. ``*_doc`` are the tokens' offsets by text, ``groups_doc`` the groups'."""

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_end: np.ndarray    # the byte behind each token
    b_end: np.ndarray
    a_group: Csr         # A token x group
    b_group: Csr
    groups_doc: np.ndarray

    def cover(self, ends: np.ndarray) -> Csr:
        """Token x byte."""
        n = int(ends[-1]) if len(ends) else 0
        return Csr(np.r_[0, ends], np.arange(n), n)

    def overlaps(self) -> Iterator[tuple[int, Csr]]:
        """A x B' in runs of rows: tokens that share bytes, and how many."""
        return row_product(self.cover(self.a_end), self.cover(self.b_end).transposed())

    def shared_groups(self) -> Iterator[tuple[int, Csr]]:
        """G x H' in runs of rows: tokens of one group."""
        return row_product(self.a_group, self.b_group.transposed())


def _picked(flat: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(ends)
    return flat[np.repeat(keep, size)].astype(np.int64), np.r_[0, np.cumsum(np.where(keep, size, 0))].astype(np.int64)


def _same_bytes(tokens: Tokens, ids: np.ndarray, ends: np.ndarray, want: np.ndarray, want_ends: np.ndarray) -> np.ndarray:
    """By text: whether its ids' bytes are the wanted ones."""
    byte_ends = np.r_[0, np.cumsum(tokens.size[ids])][ends]
    same = np.diff(byte_ends) == np.diff(want_ends)
    if same.all():
        wrong = tokens.joined(ids) != want
        if wrong.any():
            same[np.searchsorted(want_ends, np.flatnonzero(wrong), side="right") - 1] = False
        return same
    for k in np.flatnonzero(same).tolist():
        same[k] = np.array_equal(tokens.joined(ids[ends[k]:ends[k + 1]]), want[want_ends[k]:want_ends[k + 1]])
    return same


def align(texts: list[str], byte_model: str, piece_model: str) -> Aligned:
    """Both tokenizers over all texts; those that cannot be aligned have no tokens."""
    first, second, second_tokens = tokenizers_of(byte_model, piece_model)
    spaced = [f" {t}" if t else "" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in spaced]
    want = np.frombuffer(b"".join(raw), np.uint8)
    want_ends = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    a, a_doc = first.encode(spaced)
    b, b_doc = second.encode(texts)
    keep = _same_bytes(first.tokens, a, a_doc, want, want_ends) & _same_bytes(second_tokens, b, b_doc, want, want_ends)
    a, a_doc = _picked(a, a_doc, keep)
    b, b_doc = _picked(b, b_doc, keep)
    a_end, b_end = np.cumsum(first.tokens.size[a]), np.cumsum(second_tokens.size[b])
    n = int(a_end[-1]) if len(a) else 0
    is_end = np.zeros(n + 1, dtype=np.int8)
    is_end[a_end] = 1
    is_end[b_end] += 1
    both = is_end == 2
    before = np.cumsum(both) - both  # groups that end before a byte's place
    a_in, b_in = before[a_end], before[b_end]
    n_groups = int(both.sum())
    groups_doc = np.r_[0, before + both][np.r_[0, a_end][a_doc] + 1].astype(np.int64)
    return Aligned(a, b, a_doc, b_doc, a_end, b_end, Csr(np.arange(len(a) + 1), a_in, n_groups), Csr(np.arange(len(b) + 1), b_in, n_groups),
                   groups_doc)


@lru_cache(maxsize=1)
def _written(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal ids followed by each of the signs ``,``, ``|``, ``;`` as rows of bytes, and their lengths."""
    words = [f"{i}{sign}".encode() for i in range(n) for sign in ",|;"]
    width = max(map(len, words))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width), np.array([len(w) for w in words])


def group_texts(x: Aligned) -> tuple[bytes, np.ndarray]:
    """The groups of all texts as ``a1,a2|b1;a3|b2,b3;`` and the offsets of each text (with a sign at its end)."""
    a_in, b_in, n_groups = x.a_group.cols, x.b_group.cols, x.a_group.n_cols
    a_before = np.r_[0, np.cumsum(np.bincount(a_in, minlength=n_groups))].astype(np.int64)
    b_before = np.r_[0, np.cumsum(np.bincount(b_in, minlength=n_groups))].astype(np.int64)
    code = np.empty(len(x.a) + len(x.b), np.int64)
    sign_a, sign_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    sign_a[a_before[1:] - 1] = 1
    sign_b[b_before[1:] - 1] = 2
    code[np.arange(len(x.a)) + b_before[a_in]] = x.a * 3 + sign_a
    code[np.arange(len(x.b)) + a_before[b_in + 1]] = x.b * 3 + sign_b
    table, sizes = _written(1 << max(int(max(x.a.max(initial=0), x.b.max(initial=0))).bit_length(), 16))
    size = sizes[code]
    written = table[code][np.arange(table.shape[1]) < size[:, None]].tobytes()
    return written, np.r_[0, np.cumsum(size)][x.a_doc + x.b_doc]


# ---- over a table ------------------------------------------------------------------------------------------------------

def token_links(df: DataFrame, byte_model: str, piece_model: str, kind: str = "overlap", id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """One row per link of every text: doc_id, a_at, b_at (places of the tokens in the text), a_id, b_id, n_bytes.

    ``kind`` is ``overlap`` (bytes in common) or ``group`` (tokens of one group; n_bytes is then NULL)."""
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind of link: {kind}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(batches, "text", CHUNK_BYTES):
            x = align([t or "" for t in batch.column(1).to_pylist()], byte_model, piece_model)
            for first, got in x.overlaps() if kind == "overlap" else x.shared_groups():
                i, j = got.rows() + first, got.cols
                doc = np.searchsorted(x.a_doc, i, side="right") - 1
                shared = pa.array(got.value) if kind == "overlap" else pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(i - x.a_doc[doc]), pa.array(j - x.b_doc[doc]), pa.array(x.a[i]),
                     pa.array(x.b[j]), shared], ["doc_id", "a_at", "b_at", "a_id", "b_id", "n_bytes"])

    rows = narrow(df, doc_id=f"{id_column}:long", text=f"{text_column}:string")
    return rows.mapInArrow(run, "doc_id long, a_at long, b_at long, a_id long, b_id long, n_bytes long")


#: Of a chunk of documents: its block, digests by document, and the matrix of documents and id pairs. Of a block: its pairs (chunk is NULL).
STAGED = ("block long, chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "n_group_links array<long>, groups_sha256 array<string>, matrix binary, pairs array<long>, docs array<long>")
FACTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256")


def _list(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _chunk_row(block: int, chunk: int, ids: pa.Array, x: Aligned, n_docs: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The row of a chunk; its different id pairs and the number of its documents that hold each."""
    links, key, doc = np.zeros(n_docs, np.int64), [], []
    a_of = np.repeat(np.arange(n_docs), np.diff(x.a_doc))
    for first, got in x.overlaps():
        i = got.rows() + first
        of = a_of[i]
        key.append(x.a[i] << SHIFT | x.b[got.cols])
        doc.append(of)
        links += np.bincount(of, minlength=n_docs)
    key, doc = np.concatenate([np.empty(0, np.int64), *key]), np.concatenate([np.empty(0, np.int64), *doc])
    code, pairs = pd.factorize(key)
    by = np.argsort(pairs, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    pairs = pairs[by]
    cell = np.sort(doc * max(len(pairs), 1) + place[code])  # documents x pairs
    new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][:len(cell)])
    cell, times = cell[new], np.diff(np.r_[new, len(cell)])
    row, col = np.divmod(cell, max(len(pairs), 1))
    matrix = b"".join((np.bincount(row, minlength=n_docs).astype("<u4").tobytes(), col.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
    written, at = group_texts(x)
    raw, at = memoryview(written), at.tolist()
    sha = [hashlib.sha256(raw[p:q - 1]).hexdigest() if q > p else "" for p, q in zip(at[:-1], at[1:], strict=True)]
    in_group = np.add.reduceat(np.r_[product_sizes(x.a_group, x.b_group.transposed()), 0], x.a_doc[:-1]) * (np.diff(x.a_doc) > 0)
    long, none = pa.int64(), pa.nulls(1, pa.list_(pa.int64()))
    columns = [pa.array([block], long), pa.array([chunk], long), _list(ids, long),
               *(_list(v, long) for v in (np.diff(x.a_doc), np.diff(x.b_doc), np.diff(x.groups_doc), links, in_group)),
               _list(sha, pa.string()), pa.array([matrix], pa.binary()), _list(pairs, long), none]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STAGED.split(", ")]), pairs, np.bincount(col, minlength=len(pairs))


def _block_row(block: int, pairs: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    long = pa.int64()
    none = [pa.nulls(1, pa.list_(long)) for _ in FACTS[:-1]]
    return pa.RecordBatch.from_arrays([pa.array([block], long), pa.nulls(1, long), *none, pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.binary()),
                                       _list(pairs, long), _list(docs, long)], [c.split()[0] for c in STAGED.split(", ")])


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of pairs with counts as one."""
    pairs, code = np.unique(np.r_[a[0], b[0]], return_inverse=True)
    return pairs, np.bincount(code, weights=np.r_[a[1], b[1]], minlength=len(pairs)).astype(np.int64)


def _staged(rows: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chunk = TaskContext.get().partitionId() << 32, 0
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        held = nothing
        for batch in pieces_of_batches(batches, "text", CHUNK_BYTES):
            x = align([t or "" for t in batch.column(1).to_pylist()], byte_model, piece_model)
            row, pairs, docs = _chunk_row(block, chunk, batch.column(0), x, batch.num_rows)
            yield row
            held, chunk = _added(held, (pairs, docs)), chunk + 1
            if len(held[0]) >= BLOCK_PAIRS:
                yield _block_row(block, *held)
                block, held = block + 1, nothing
        if len(held[0]):
            yield _block_row(block, *held)

    return rows.mapInArrow(run, STAGED)


def _counts(blocks: DataFrame) -> DataFrame:
    """(block, pairs, counts, best) of every block: each pair's corpus-wide count, and whether it is the highest of its A id."""
    asked = blocks.select("block", F.expr("inline(arrays_zip(pairs, docs))")).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    parts = asked.groupBy("pairs", "salt").agg(F.sum("docs").alias("n"))  # a pair that every block holds is dealt over the salts
    whole = cut_lineage(parts.groupBy("pairs").agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts")))
    first = F.shiftright("pairs", SHIFT)
    top = whole.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    known = whole.join(top, first == F.col("a")).select(
        F.col("pairs").alias("__pair"), F.explode("salts").alias("__salt"), "n", (F.col("n") == F.col("top")).alias("best"))
    back = asked.join(known, (F.col("pairs") == F.col("__pair")) & (F.col("salt") == F.col("__salt")))
    return back.groupBy("block").agg(F.collect_list(F.struct("pairs", "n", "best")).alias("known"))


def alignment_digests(df: DataFrame, byte_model: str, piece_model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair of ids is the most frequent of its A id, ties included),
    count_sum (over links, how many documents hold the pair), groups_sha256, n_group_links (shared-group links)."""
    rows = narrow(df, doc_id=f"{id_column}:long", text=f"{text_column}:string")
    staged = cut_lineage(_staged(rows, byte_model, piece_model))
    blocks, chunks = staged.filter("chunk is null"), staged.filter("chunk is not null").drop("docs")
    known = _counts(blocks).withColumnRenamed("block", "__block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                facts = [row[c].values for c in FACTS]
                n_docs, mine = len(facts[0]), row["pairs"].values.to_numpy(zero_copy_only=False)
                best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
                if len(mine):
                    got = row["known"].values
                    pairs = got.field("pairs").to_numpy(zero_copy_only=False)
                    by = np.argsort(pairs)
                    at = by[np.searchsorted(pairs, mine, sorter=by)]
                    n, is_best = (got.field(c).to_numpy(zero_copy_only=False)[at].astype(np.int64) for c in ("n", "best"))
                    flat = np.frombuffer(row["matrix"].as_py(), "<u4").astype(np.int64)
                    start = np.r_[0, np.cumsum(flat[:n_docs])]
                    col, times = flat[n_docs:].reshape(2, -1)
                    ends = np.r_[0, np.cumsum(times * n[col])][start], np.r_[0, np.cumsum(times * is_best[col])][start]
                    total, best = np.diff(ends[0]), np.diff(ends[1])
                yield pa.RecordBatch.from_arrays([*facts, pa.array(best), pa.array(total)], [*FACTS, "n_best", "count_sum"])

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, n_best long, count_sum long"
    joined = chunks.join(known, F.col("block") == F.col("__block"), "left").select(*FACTS, "matrix", "pairs", "known")
    return joined.mapInArrow(run, fields).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
