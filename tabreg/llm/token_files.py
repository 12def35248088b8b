"""Token ids in Huffman-coded files: global counts, canonical length-limited codes, independent blocks, table-driven reading.

Folder written::

    <path>/codes    one record: the code length of every id (zlib); canonical codes follow from the lengths
    <path>/blocks   records in ascending doc_id order, one block each

A block holds whole documents, about ``BLOCK_TOKENS`` ids: its place (file part, first id within the part), a table of its
documents, the bit offset of every ``STEP``-th id, and the bits. Any block can be read alone, and within a block every offset
is a place to start, so all of them advance together in numpy, one table lookup per id.

Rows: NULL or empty text gives just the end id. Rows with a NULL doc_id come first and keep it; rows that share an id keep an
order by text hash. Only id and text are read from the input table. An empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabreg.llm.common import cut_lineage, discard, narrow, pieces_of_batches, shared_path

LIMIT = 18            # longest code in bits; the reading table has 2**LIMIT entries
BLOCK_TOKENS = 1 << 16
STEP = 512
BLOCKS_PER_FILE = 64
KEPT_CHUNKS = 300_000
AT_ONCE = 256         # chunks joined to one text for the library
WORDS_AT_ONCE = 64
HEAD = struct.Struct("<4sIIQQIQ")
MAGIC = b"TKB1"
_BLANK = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
RARE_BLANK = re.compile("[" + _BLANK.replace("\t-\r ", "\t\x0b-\r") + "]")
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"  # whether signs beyond count as letters is left to the library
# fixed values: bytes without a sign of their own are written as letters from 256 on; a line end stands between words here
BYTE_LETTERS = np.arange(256, dtype="<u4")
BYTE_LETTERS[[*range(10), *range(11, 33), *range(127, 161), 173]] = [256 + k for k in range(68) if k != 10]
FIRST = "\r"  # marks a text's first chunk among the even ones, which hold no such sign


# ---- ids ---------------------------------------------------------------------------------------------------------------

class ByteEncoder:
    """Ids by the tokenizers library, which sees each different chunk (white space and the word after it) once while it is kept.

    No token of the pre-tokenizer's pattern goes from a word into white space, so chunks are encoded alike alone and in the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.model = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.model.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.sign = self.merges.encode("!", add_special_tokens=False).ids[0]
        special = [t for t in self.model.get_added_tokens_decoder().items() if t[1].special and not (t[1].lstrip or t[1].rstrip)]
        self.apart = special[0] if special else None
        signs = {c: self.model.encode(c, add_special_tokens=False).ids for c in ".,"}
        self.signs = {c: ids[0] for c, ids in signs.items()}
        self.index: dict[str, int] = {}
        self.flat, self.ends, self.uses = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of any chunks, joined for the library, which never joins a special token with its neighbours."""
        mark = self.apart[1].content if self.apart else None
        if mark is None or mark in "".join(chunks):
            lists = [e.ids for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        joined = [mark.join(chunks[k:k + AT_ONCE]) + mark for k in range(0, len(chunks), AT_ONCE)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.apart[0])
        return ids[ids != self.apart[0]], np.diff(np.r_[-1, ends]) - 1

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words of letters after a space, which the pre-tokenizer leaves whole: the library's merge model gets them
        in the letters by which byte-level models write bytes, cut at spaces, a sign that no word holds between them."""
        raw = np.frombuffer("\n".join(words).encode(), np.uint8)
        written = BYTE_LETTERS[raw].tobytes().decode("utf-32-le").split("\n")
        joined = ["\u0120" + " ! \u0120".join(written[k:k + WORDS_AT_ONCE]) + " !" for k in range(0, len(written), WORDS_AT_ONCE)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.sign)
        return ids[ids != self.sign], np.diff(np.r_[-1, ends]) - 1

    def _add(self, keys: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.flat = np.r_[self.flat, flat]
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(size)]
        self.uses = np.r_[self.uses, np.zeros(len(keys), np.int64)]
        at = len(self.index)
        self.index.update(zip(keys, range(at, at + len(keys)), strict=True))

    def _learn(self, fresh: list[str]) -> None:
        """A word of letters with a full stop or comma is the word and the sign: the pre-tokenizer always cuts between them."""
        given = pa.array(fresh, pa.string())
        words = strings(given.filter(pc.match_substring_regex(given, f"^{LETTERS}+$")))
        signed = strings(given.filter(pc.match_substring_regex(given, f"^{LETTERS}+[.,]$")))
        known = set(words)
        words += [c for c in {c[:-1] for c in signed} if c not in known and c not in self.index]
        rest = list(set(fresh).difference(signed).difference(words))
        if words:
            self._add(words, *self._encode_words(words))
        if rest:
            self._add(rest, *self._encode_chunks([c if c[:1] == "\n" else c[1:] if c[:1] == FIRST else f" {c}" for c in rest]))
        if signed:
            at = np.fromiter((self.index[c[:-1]] for c in signed), np.int64, len(signed))
            size = self.ends[at + 1] - self.ends[at]
            ends = np.cumsum(size + 1)
            flat = np.empty(int(ends[-1]), np.uint32)
            flat[ends - 1] = [self.signs[c[-1]] for c in signed]
            inside = np.ones(len(flat), dtype=bool)
            inside[ends - 1] = False
            total = np.cumsum(size)
            flat[inside] = self.flat[np.repeat(self.ends[at] - (total - size), size) + np.arange(int(total[-1]))]
            self._add(signed, flat, size + 1)

    def _shrink(self) -> None:
        """Forget the chunks that were met only once."""
        keep = self.uses > 1
        size = np.diff(self.ends)
        self.flat = self.flat[np.repeat(keep, size)]
        self.ends = np.r_[0, np.cumsum(size[keep])]
        self.uses = self.uses[keep] // 2
        self.index = dict(zip([c for c, k in zip(self.index, keep.tolist(), strict=True) if k], range(int(keep.sum())), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text.

        A key stands for the chunk of a space and the key, but for keys that begin with a line end (that chunk itself) or with
        ``FIRST`` (the chunk after the sign). Only texts with other white space, or with two of it in a row, are cut by a pattern."""
        if len(self.index) > KEPT_CHUNKS:
            self._shrink()
        smooth = [not t or even(t) for t in texts]
        whole = pa.array([t for t, e in zip(texts, smooth, strict=True) if e], pa.string())
        first = pc.binary_join_element_wise(pa.scalar(FIRST), pc.replace_substring(whole, "\n", " \n"), pa.scalar(""))
        parts = pc.split_pattern(first, " ")
        flat, ends = self._ids(parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        if all(smooth):
            return flat, ends
        found = [[FIRST + c for c in CHUNKS.findall(t)] for t, e in zip(texts, smooth, strict=True) if not e]
        flat2, ends2 = self._ids(pa.array(list(chain.from_iterable(found)), pa.string()), np.array([len(f) for f in found]))
        size = np.zeros(len(texts), np.int64)
        is_smooth = np.array(smooth)
        size[is_smooth], size[~is_smooth] = np.diff(ends), np.diff(ends2)
        out = np.empty(int(size.sum()), np.uint32)
        mine = np.repeat(is_smooth, size)
        out[mine], out[~mine] = flat, flat2
        return out, np.r_[0, np.cumsum(size)]

    def _ids(self, keys: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded = keys.dictionary_encode()
        different, index = strings(coded.dictionary), self.index
        places = list(map(index.get, different))
        fresh = [c for c, k in zip(different, places, strict=True) if k is None]
        if fresh:
            self._learn(fresh)
            places = [index[c] if k is None else k for c, k in zip(different, places, strict=True)]
        known = np.fromiter(places, np.int64, len(different))
        at = coded.indices.to_numpy()
        if len(known):
            self.uses[known] += np.bincount(at, minlength=len(known))
        at = known[at]
        size = self.ends[at + 1] - self.ends[at]
        total = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.repeat(self.ends[at] - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.r_[0, np.cumsum(counts)].astype(np.int64)]


def strings(values: pa.Array) -> list[str | None]:
    """As to_pylist, several times faster for many short strings."""
    return values.to_numpy(zero_copy_only=False).tolist()


def even(text: str) -> bool:
    """Whether all white space of a text is single spaces and line ends inside it."""
    if text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    if text.isascii():
        return not ("\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text)
    return not RARE_BLANK.search(text)


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder per worker process; what it keeps serves later tasks too."""
    return ByteEncoder(path)


def id_type(model_path: str, end_id: int) -> str:
    """Little-endian unsigned integers of 16 bits where all ids fit, else of 32."""
    return "<u2" if max(end_id, byte_encoder(model_path).model.get_vocab_size() - 1) < 1 << 16 else "<u4"


def token_ids(rows: DataFrame, model_path: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, tie, ids, counts): ids as integers of ``kind``, the end id last; and one row of each task with how often it met
    each id (``counts`` is true there, and ids are 64-bit numbers)."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = byte_encoder(model_path), np.array([end_id], kind).tobytes()
        total = np.zeros(max(end_id + 1, encoder.model.get_vocab_size()), np.int64)

        def out(ids: pa.Array, ties: pa.Array, raw: list[bytes], is_count: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, ties, pa.array(raw, pa.binary()), pa.array([is_count] * len(raw))],
                                              ["doc_id", "tie", "ids", "counts"])

        for batch in pieces_of_batches(batches, "text", 4 << 20):
            flat, ends = encoder.encode([t or "" for t in batch.column(2).to_pylist()])
            total += np.bincount(flat, minlength=len(total))
            total[end_id] += batch.num_rows
            raw, at = flat.astype(kind).tobytes(), (ends * width).tolist()
            yield out(batch.column(0), batch.column(1), [raw[a:b] + last for a, b in zip(at[:-1], at[1:], strict=True)], False)
        none = pa.array([None], pa.int64())
        yield out(none, none, [total.tobytes()], True)

    return rows.mapInArrow(run, "doc_id long, tie long, ids binary, counts boolean")


def id_counts(task_counts: DataFrame) -> DataFrame:
    """(id, n) over the whole table from the tasks' rows of counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = total + np.frombuffer(raw, np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return task_counts.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---- codes -------------------------------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best prefix code lengths of at most ``limit`` bits by package-merge; 0 for an id without a count."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids cannot have codes of {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    level, single = weight, [np.ones(len(weight), dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[weight, pairs]
        by = np.argsort(both, kind="stable")
        level = both[by]
        single.append(by < len(weight))
    need, lengths = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for leaves in reversed(single):
        taken = int(leaves[:need].sum())
        lengths[:taken] += 1
        need = 2 * (min(need, len(leaves)) - taken)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in code order, and each id's code (left in the low bits)."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype(np.int64)
    top = int(size.max()) if len(size) else 0
    start = np.r_[0, np.cumsum(np.int64(1) << (top - size))[:-1]] if len(size) else np.empty(0, np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (start >> (top - size)).astype(np.uint64)
    return order, codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bits, first bit highest, and the bit offset of every id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    wide = codes[ids] << (64 - size - (start & 31)).astype(np.uint64)
    word = start >> 5
    n = int(word[-1]) + 2
    total = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)
    total += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return total.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8], start


@lru_cache(maxsize=1)
def reading_table(packed: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
    order, _ = canonical_codes(lengths)
    size = lengths[order].astype(np.int64)
    top = int(size.max()) if len(size) else 1
    times = np.int64(1) << (top - size)
    ids, sizes = np.repeat(order, times).astype(np.uint32), np.repeat(size, times)
    free = (1 << top) - len(ids)  # a single code leaves half of the table unused
    return np.r_[ids, np.zeros(free, np.uint32)], np.r_[sizes, np.ones(free, np.int64)], top


def unpack_bits(raw: bytes, starts: np.ndarray, counts: np.ndarray, packed: bytes) -> np.ndarray:
    """Ids of all runs (bit offset, count) one after another; every step reads one id of each run."""
    ids, sizes, top = reading_table(packed)
    b = np.frombuffer(raw + b"\0" * 4, np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    by = np.argsort(-counts, kind="stable")
    pos, left = starts[by].astype(np.int64), counts[by]
    first = (np.cumsum(counts) - counts)[by]
    out = np.empty(int(counts.sum()), np.uint32)
    alive = len(by) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
    mask = np.uint32((1 << top) - 1)
    for step, k in enumerate(alive.tolist()):
        p = pos[:k]
        code = (window[p >> 3] >> (32 - top - (p & 7)).astype(np.uint32)) & mask
        out[first[:k] + step] = ids[code]
        pos[:k] = p + sizes[code]
    return out


# ---- files -------------------------------------------------------------------------------------------------------------

def _block(part: int, first: int, docs: list[tuple[int | None, bytes]], kind: str, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.frombuffer(b"".join(r for _, r in docs), kind)
    bits, start = pack_bits(ids, codes, lengths)
    table = b"".join((struct.pack("<qBQ", 0 if d is None else d, d is None, len(r) // ids.itemsize) for d, r in docs))
    marks = start[::STEP].astype("<u8").tobytes()
    return HEAD.pack(MAGIC, len(docs), len(marks) // 8, part, first, len(ids), len(bits)) + table + marks + bits


def write_token_files(df: DataFrame, path: str, model_path: str, end_id: int = 0, id_column: str = "doc_id",
                      text_column: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write all ids in ascending doc_id order."""
    spark = df.sparkSession
    rows = narrow(df, doc_id=f"{id_column}:long", text=f"{text_column}:string")
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    kind = id_type(model_path, end_id)
    width, staged = np.dtype(kind).itemsize, shared_path(spark, "ids")
    token_ids(rows, model_path, end_id, kind).write.option("compression", "zstd").parquet(staged)
    every = spark.read.schema("doc_id long, tie long, ids binary, counts boolean").parquet(staged)
    ids = every.filter("not counts").drop("counts")
    every._cut_path = staged  # freed by discard
    counts = id_counts(every.filter("counts")).collect()  # one row per id of the vocabulary at most
    n = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        n[r["id"]] = r["n"]
    packed = zlib.compress(code_lengths(n).tobytes(), 9)
    spark.createDataFrame([(bytearray(packed),)], "value binary").select(F.col("value").cast("string")).coalesce(1).write.text(
        f"{path}/codes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(zlib.decompress(packed), np.uint8)
        _, codes = canonical_codes(lengths)
        part, first, held, docs = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_block(part, first, docs, kind, lengths, codes)], pa.binary())], ["value"])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                docs.append((doc, raw))
                held += len(raw) // width
                if held >= BLOCK_TOKENS:
                    yield out()
                    first, held, docs = first + held, 0, []
        if docs:
            yield out()

    ordered = ids.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{path}/blocks"))
    discard(every)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted,
    ids (little-endian unsigned 32-bit integers)."""
    code_row = spark.read.format("binaryFile").load(f"{path}/codes").filter(F.col("length") > 0).select("content").collect()
    packed = bytes(code_row[0][0])[:-1] if code_row else b""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield _read_file(content, packed, with_ids)

    fields = "doc_id long, part long, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = spark.read.format("binaryFile").load(f"{path}/blocks").select("content").mapInArrow(run, fields)
    heads = (spark.read.format("binaryFile").load(f"{path}/blocks").select("content").mapInArrow(_part_sizes, "part long, n long")
             .groupBy("part").agg(F.sum("n").alias("n")))  # one row per writing task
    base = heads.select(F.col("part").alias("__part"), F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    joined = rows.join(F.broadcast(base), F.col("part") == F.col("__part"))
    return joined.select("doc_id", (F.col("__base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
                         *(["ids"] if with_ids else []))


def _blocks(content: bytes) -> Iterator[tuple[tuple, int, int]]:
    """Header, its end and the record's end of each block in a file."""
    at = 0
    while at < len(content):
        head = HEAD.unpack_from(content, at)
        if head[0] != MAGIC:
            raise ValueError("not a token file")
        body = at + HEAD.size
        end = body + head[1] * 17 + head[2] * 8 + head[6]
        yield head, body, end
        at = end + 1  # the line end after each record


def _part_sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(h[3], h[5]) for content in batch.column(0).to_pylist() for h, _, _ in _blocks(content)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                                         ["part", "n"])


DOCS = np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<u8")])


def _read_file(content: bytes, packed: bytes, with_ids: bool) -> pa.RecordBatch:
    docs, parts, offsets, starts, counts = [], [], [], [], []
    for head, body, end in _blocks(content):
        rows = np.frombuffer(content, DOCS, head[1], body)
        marks = np.frombuffer(content, "<u8", head[2], body + head[1] * 17).astype(np.int64)
        bits = body + head[1] * 17 + head[2] * 8
        docs.append(rows)
        parts += [head[3]] * head[1]
        offsets.append(head[4] + np.cumsum(rows["n"].astype(np.int64)) - rows["n"].astype(np.int64))
        starts.append(marks + bits * 8)
        counts.append(np.minimum(STEP, head[5] - STEP * np.arange(head[2])).astype(np.int64))
    none = np.empty(0, np.int64)
    ids = unpack_bits(content, np.concatenate([none, *starts]), np.concatenate([none, *counts]), packed) if docs else none
    table = np.concatenate(docs) if docs else np.empty(0, DOCS)
    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.r_[0, np.cumsum(table["n"].astype(np.int64)) * 4].tolist()
    runs = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    columns = [pa.array(table["doc"], mask=table["null"].astype(bool)), pa.array(parts, pa.int64()),
               pa.array(np.concatenate([none, *offsets])), pa.array(table["n"].astype(np.int64)),
               pa.array([zlib.crc32(r) for r in runs], pa.int64())]
    if with_ids:
        columns.append(pa.array([bytes(r) for r in runs], pa.binary()))
    names = ["doc_id", "part", "offset", "n_tokens", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays(columns, names[: len(columns)])


def token_file_digests(df: DataFrame, model_path: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder, read them back, and return (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_path(df.sparkSession, "token-files")
    write_token_files(df, path, model_path, end_id)
    return read_token_files(df.sparkSession, path, with_ids=False)
