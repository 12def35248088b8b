"""Near-duplicate documents: MinHash bands for candidates, odd sketches to judge them, full shingle sets to confirm.

1. Each whole text becomes its set of distinct word shingles (64-bit hashes), ``SAMPLES`` MinHash values, ``BANDS`` band keys and an
   odd sketch: a bitmap whose bits are the parities of the hashed samples. The exclusive-or of two sketches counts the samples in
   which they differ, so its population gives the similarity closely when it is high.
2. Documents with equal sets are one class, named by its smallest id.
3. In every band bucket each class is paired with the bucket's smallest class only: as many pairs as members. Pairs that sizes
   or sketches rule out go; the others are confirmed on full sets.
4. Confirmed pairs are joined to components. In two more rounds every bucket that still holds several components takes another
   member by hash, and each class outside its component meets up to four such members; groups of near copies fall together.
5. Buckets that still hold several components are compared between components, in cells of bounded size: first by sketches, then
   what passes by full sets inside the cell's task, each pair in the first of its common buckets. So every pair of a bucket is either confirmed, ruled out, or already connected, and nothing is
   capped.

With 32 bands of 4 a pair of similarity 0.8 shares no band with a chance of 5e-8. The sketch bound lies five deviations below.

Rows: NULL or empty text, or text of separators only, has an empty set (0 shingles) and links with nothing. Fewer words than a
shingle: the whole sequence is one. Rows that repeat a doc_id are one node. A NULL doc_id links with nothing and is kept. Only id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import SALTS, cut_lineage, discard, narrow, pieces_of_batches, with_ids, without_ids
from tabreg.llm.components import components

SAMPLES, BANDS, BITS = 128, 32, 512
SEED = 77
BLOCK = 256
ROUNDS = 2             # of step 4
MARGIN = 0.2           # below the threshold; the estimate's deviation at 0.8 is 0.04

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_R = np.uint64(0x165667B19E3779F9)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the offsets of each text."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    space = _SPLIT[raw]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    stop = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # words: polynomial of the bytes, from prefix sums modulo 2**64
    prefix = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(raw)))]
    word = (prefix[stop] - prefix[start]) * _powers(_INVERSE, len(raw) + 1)[start]
    word = _mix(word + (stop - start).astype(np.uint64) * _Q)
    text_end = np.cumsum([len(r) + 1 for r in raws])
    text = np.searchsorted(text_end, start, side="right")
    words = np.bincount(text, minlength=len(texts))
    first = np.cumsum(words) - words
    h = np.zeros(len(word), np.uint64)
    for k in range(size):  # position in the shingle matters
        moved = np.zeros(len(word), np.uint64)
        moved[: max(len(word) - k, 0)] = word[k:]
        h = h * _Q + moved
    place = np.arange(len(word)) - first[text]
    whole = (place <= words[text] - size)
    few = np.flatnonzero((words > 0) & (words < size))
    for t in few.tolist():  # the whole sequence as one
        value = _R
        for w in word[first[t]:first[t] + words[t]]:
            value = np.uint64((int(value) * int(_Q) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        h[first[t]], whole[first[t]] = value, True
    h, text = _mix(h[whole]), text[whole]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
    return h[new], np.r_[0, np.cumsum(np.bincount(text[new], minlength=len(texts)))].astype(np.int64)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64))


def signatures(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and odd sketches (texts x BITS/64) of non-empty sets."""
    mult, add = _constants()
    low = np.empty((len(ends) - 1, SAMPLES), np.uint64)
    for k in range(SAMPLES):
        low[:, k] = np.minimum.reduceat(h * mult[k] + add[k], ends[:-1])
    rows = SAMPLES // BANDS
    keys = np.zeros((len(low), BANDS), np.uint64)
    for k in range(rows):
        keys = _mix(keys * _Q + low[:, k::rows] + np.arange(BANDS, dtype=np.uint64)[None, :])
    bit = (_mix(low + np.arange(SAMPLES, dtype=np.uint64)[None, :] * _R) % np.uint64(BITS)).astype(np.int64)
    parity = np.zeros((len(low), BITS), np.uint8)
    np.add.at(parity, (np.repeat(np.arange(len(low)), SAMPLES), bit.ravel()), 1)
    return keys, np.packbits(parity & 1, axis=1).view(np.uint64).reshape(len(low), -1)


def similar_bits(threshold: float) -> int:
    """The largest number of differing sketch bits that leaves a pair possible."""
    differ = 2 * SAMPLES * (1 - (threshold - MARGIN))
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** differ) + 3 * np.sqrt(BITS) / 2)


def document_signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, sketch) of every whole text; the set's digest is set_a, set_b."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(batches, "text", 1 << 20):
            h, ends = shingle_sets([t or "" for t in batch.column(1).to_pylist()], shingle)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            keys = np.zeros((len(n), BANDS), np.uint64)
            sketch = np.zeros((len(n), BITS // 64), np.uint64)
            digest = np.zeros((2, len(n)), np.uint64)
            if len(full):
                at = np.r_[ends[full], len(h)]
                keys[full], sketch[full] = signatures(h, at)
                digest[0, full] = np.add.reduceat(_mix(h + _R), at[:-1])
                digest[1, full] = np.add.reduceat(_mix(h ^ _Q), at[:-1])

            def lists(x: np.ndarray) -> pa.Array:
                offsets = np.r_[0, np.cumsum(np.where(n > 0, x.shape[1], 0))].astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[full].view(np.int64).ravel()))

            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digest[0].view(np.int64)),
                                              pa.array(digest[1].view(np.int64)), lists(keys), lists(sketch)],
                                             ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    rows = narrow(docs, doc_id="doc_id:long", text="text:string")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _possible(threshold: float) -> Column:
    differ = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(BITS // 64)), F.lit(0))
    return ((100 * F.least("na", "nb") >= round(100 * threshold) * F.greatest("na", "nb")) & (differ <= similar_bits(threshold)))


def confirm(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts of the pairs' documents only take part."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    texts = with_ids(narrow(docs, doc_id="doc_id:long", text="text:string"), "doc_id", sides.select("id"))
    met = sides.join(texts, F.col("id") == F.col("doc_id"))  # a plain join: a class that is in many pairs may be split
    both = met.groupBy("a", "b").agg(F.max(F.when(F.col("id") == F.col("a"), F.col("text"))).alias("ta"),
                                     F.max(F.when(F.col("id") == F.col("b"), F.col("text"))).alias("tb"))
    percent = round(100 * threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(pieces_of_batches(batches, "ta", 1 << 20), "tb", 1 << 20):
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            texts = list(dict.fromkeys([*left, *right]))
            index = {t: k for k, t in enumerate(texts)}
            h, ends = shingle_sets([t or "" for t in texts], shingle)
            keep = []
            for x, y in zip(left, right, strict=True):
                i, j = index[x], index[y]
                own, other = h[ends[i]:ends[i + 1]], h[ends[j]:ends[j + 1]]
                same = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * same >= percent * (len(own) + len(other) - same) and same > 0)
            mask = np.array(keep, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a)[mask], pa.int64()), pa.array(np.array(b)[mask], pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


MEMBER = "rep long, component long, n_shingles long, sketch array<long>, bands array<long>, block int"


def _kept_pairs(members: dict[str, np.ndarray], key: int, i: int, j: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of members of blocks i and j that lie in different components, that sizes and sketches allow, and of whose common
    buckets this is the first."""
    rep, comp, n, block = (members[k] for k in ("rep", "component", "n_shingles", "block"))
    sketch, bands = members["sketch"].view(np.uint64), members["bands"]
    most, percent = similar_bits(threshold), round(100 * threshold)
    y = np.flatnonzero(block == j)
    for k in np.flatnonzero(block == i):
        near = y[(comp[y] != comp[k]) & ((rep[y] > rep[k]) | (i != j)) & (100 * np.minimum(n[y], n[k]) >= percent * np.maximum(n[y], n[k]))]
        near = near[np.bitwise_count(sketch[near] ^ sketch[k]).sum(1) <= most]
        if len(near):
            common = np.where(bands[near] == bands[k], bands[k], np.iinfo(np.int64).max).min(1)
            near = near[common == key]
            if len(near):
                yield int(k), near


def _between_components(docs: DataFrame, buckets: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (a, b) between different components of one bucket. Members meet in cells of two blocks of about ``BLOCK``; a first pass
    over sketches finds which members of a cell have anyone to meet, and a second, with their texts, confirms the pairs of a cell in
    its task. No row is made for a pair that is no link."""
    size = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    size = cut_lineage(size.filter("lo < hi").select(F.col("key").alias("__key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = buckets.join(size, F.col("key") == F.col("__key")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    names = [c.split(" ")[0] for c in MEMBER.split(", ")]
    cells = (own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
             .agg(F.collect_list(F.struct(*names)).alias("members")).filter(F.size("members") > 1))

    def arrays(rows: list[dict]) -> dict[str, np.ndarray]:
        return {c: np.array([m[c] for m in rows], dtype=np.int64) for c in names}

    def flag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.int32()]
        for batch in batches:
            out: list[tuple] = []
            for key, i, j, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                met: set[int] = set()
                for k, near in _kept_pairs(arrays(rows), key, i, j, threshold):
                    met.update([k, *near.tolist()])
                out += [(key, i, j, *(rows[k][c] for c in names)) for k in sorted(met)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.int32()) for k in (1, 2)),
                 *(pa.array([r[3 + k] for r in out], kind) for k, kind in enumerate(kinds))], ["key", "i", "j", *names])

    flagged = cut_lineage(cells.select("key", "i", "j", "members").mapInArrow(flag, f"key long, i int, j int, {MEMBER}"))
    texts = with_ids(narrow(docs, doc_id="doc_id:long", text="text:string"), "doc_id", flagged.select("rep"))
    percent = round(100 * threshold)

    def confirm_cell(cell: tuple, group: pa.Table) -> pa.Table:
        key, i, j = (v.as_py() for v in cell)
        rows = group.to_pylist()
        h, ends = shingle_sets([r["text"] or "" for r in rows], shingle)
        sets = [h[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        members = arrays(rows)
        left, right = [], []
        for k, near in _kept_pairs(members, key, i, j, threshold):
            for m in near.tolist():
                same = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                if same and 100 * same >= percent * (len(sets[k]) + len(sets[m]) - same):
                    left.append(min(rows[k]["rep"], rows[m]["rep"]))
                    right.append(max(rows[k]["rep"], rows[m]["rep"]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return (flagged.join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id").groupBy("key", "i", "j")
            .applyInArrow(confirm_cell, "a long, b long").distinct())


def _meet(rows: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(a, b) for one member of each bucket and the members of other components; at most four pairs per class and component met."""
    tagged = cut_lineage(rows.join(labels, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")))
    by = F.xxhash64(F.lit(turn), "key", "rep")
    met = cut_lineage(tagged.groupBy("key").agg(F.min(F.struct(by.alias("h"), "rep", "component")).alias("m"), F.min("component").alias("lo"),
                                                F.max("component").alias("hi")).filter("lo < hi")
                      .select(F.col("key").alias("__key"), F.col("m.rep").alias("met"), F.col("m.component").alias("its")))
    order = F.xxhash64(F.lit(turn), "met")
    some = F.array_distinct(F.array(F.min("met"), F.max("met"), F.min_by("met", order), F.max_by("met", order)))
    pairs = (tagged.join(met, F.col("key") == F.col("__key")).filter("component != its").groupBy("rep", "its").agg(some.alias("some"))
             .select("rep", F.explode("some").alias("met")))
    return pairs.select(F.least("rep", "met").alias("a"), F.greatest("rep", "met").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes lie in different components."""
    for c in "ab":
        named = labels.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"c{c}"))
        pairs = pairs.join(named, F.col(c) == F.col(f"n{c}"), "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c)).drop(f"n{c}")
    return pairs.filter("ca != cb").select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    signed = cut_lineage(document_signatures(docs, shingle).withColumn("salt", salt))
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(linked.groupBy("set_a", "set_b", "n_shingles")
                          .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"),
                               F.collect_set("salt").alias("salts")))
    rows = classes.select("rep", F.explode("bands").alias("key"))
    hubs = cut_lineage(rows.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last")
                       .select(F.col("key").alias("__key"), "hub"))
    shared = cut_lineage(rows.join(hubs, F.col("key") == F.col("__key")).select("key", "rep", "hub"))
    discard(hubs)

    def facts(s: str) -> DataFrame:
        return classes.select(F.col("rep").alias(f"r{s}"), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))

    def judged(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        """Pairs not tried before that sizes and sketches allow."""
        if tried is not None:
            old = tried.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
            pairs = pairs.join(old, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_anti")
        return cut_lineage(pairs.join(facts("b"), F.col("b") == F.col("rb")).join(facts("a"), F.col("a") == F.col("ra"))
                           .filter(_possible(threshold)).select("a", "b"))

    # a class meets its first hub, then the hubs of its other buckets that this left in another component
    to_hubs = shared.filter("hub < rep")
    tried = judged(to_hubs.groupBy("rep").agg(F.min("hub").alias("a")).select("a", F.col("rep").alias("b")), None)
    links = cut_lineage(confirm(docs, tried, shingle, threshold))
    labels = components(links)
    apart = _apart(to_hubs.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), labels)
    further = judged(apart, tried)
    if further.limit(1).count():
        tried = cut_lineage(tried.union(further))
        links = cut_lineage(links.union(confirm(docs, further, shingle, threshold)))
        labels = components(links)
    members = shared.select("key", "rep")
    for turn in range(ROUNDS):
        pairs = judged(_meet(members, labels, turn), tried)
        if not pairs.limit(1).count():
            break
        tried = cut_lineage(tried.union(pairs))
        found = cut_lineage(confirm(docs, pairs, shingle, threshold))
        if found.limit(1).count():
            links = cut_lineage(links.union(found))
            labels = components(links)

    named = members.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    named = named.join(classes.select(F.col("rep").alias("__rep"), "n_shingles", "sketch", "bands"), F.col("rep") == F.col("__rep"))
    late = cut_lineage(_between_components(docs, cut_lineage(named.drop("__rep")), shingle, threshold))
    final = components(links.union(late)) if late.limit(1).count() else labels

    named_class = (classes.select("set_a", "set_b", "n_shingles", "rep", "salts")
                   .join(final, F.col("rep") == F.col("node"), "left")
                   .select(F.col("set_a").alias("__a"), F.col("set_b").alias("__b"), F.col("n_shingles").alias("__n"),
                           F.explode("salts").alias("__s"), F.coalesce("component", "rep").alias("component_id")))
    own = (F.col("set_a") == F.col("__a")) & (F.col("set_b") == F.col("__b")) & (F.col("n_shingles") == F.col("__n")) & (
        F.col("salt") == F.col("__s"))
    found = linked.select("doc_id", "n_shingles", "set_a", "set_b", "salt").join(named_class, own).select(
        "doc_id", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    for t in (shared, tried, late, links):
        discard(t)
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each_group(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with their own columns, that are the smallest id of their group."""
    dropped = cut_lineage(near_duplicates(docs, shingle, threshold).filter(~F.col("kept")).select("doc_id"))
    return without_ids(docs, "doc_id", dropped)
