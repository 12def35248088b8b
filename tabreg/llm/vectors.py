"""Near-duplicate vectors: coarse inverted lists, product codes of residuals, table-lookup distances, exact cosine.

The index (list centres, code books) is fitted on at most about ``SAMPLE`` different vectors; every vector is then indexed. Equal
vectors are one class. A class is assigned to its nearest centre; the residual's subspaces become one byte each, and the length of
what the code loses is kept, so that the lookup distance gives a bound, not a guess: a member whose code lies farther than the
search radius plus its own loss cannot be a neighbour. All lists are probed whose border with the query's own list is within the
search radius, whatever direction a neighbour lies in, so no link is missed. That border is the same seen from either list, so of two
lists only one asks the other. Lookup distances of a block come from one product of the queries with the decoded members, in single
precision with its rounding allowed for. What remains is decided by the cosine in double precision.

Work is dealt in shelves of about ``SHELF`` members (several lists, or parts of a long one) against blocks of about ``QUERIES`` query
classes; each pair of classes is looked at once. A task sends numbers of links per class and a forest of links, never all pairs.

Rows: a vector that is NULL, empty, zero, or holds a NULL or non-finite component links with nothing, nor does a row with a NULL
id; these are kept, as their own component. Vectors link only with others of their length. Rows that repeat an id each count as a
vector. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import SALTS, cut_lineage
from tabreg.llm.components import components

SAMPLE = 20_000
LIST_SIZE, MAX_LISTS = 256, 16_384
CODES = 256
SUBSPACE = 8
PROBE = float("inf")  # deviations of a neighbour's offset in one direction; finite values assume vectors spread over all directions
SHELF, QUERIES = 4_096, 16_384
ROUNDS = 8
SEED = 5
CHUNK = 1_024


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squares(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]
    gap: np.ndarray          # distances between centres

    @staticmethod
    def fit(x: np.ndarray, n: int) -> Index:
        """``x``: unit vectors of the sample; ``n``: vectors to come."""
        rng = np.random.default_rng(SEED)
        centres = _centres(x, int(np.clip(round(n / LIST_SIZE), 1, MAX_LISTS)), rng)
        rest = x - centres[_squares(x, centres).argmin(1)]
        d = x.shape[1]
        cuts = [slice(k, min(k + SUBSPACE, d)) for k in range(0, d, SUBSPACE)]
        books = [_centres(rest[:, c], CODES, rng) for c in cuts]
        return Index(centres, books, cuts, np.sqrt(_squares(centres, centres)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and lost length of each unit vector."""
        own = _squares(x, self.centres).argmin(1)
        rest = x - self.centres[own]
        codes = np.stack([_squares(rest[:, c], b).argmin(1) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, radius: float) -> np.ndarray:
        """Which of ``lists`` each vector must visit."""
        reach = radius * min(1.0, PROBE / np.sqrt(x.shape[1]))
        here = ((x - self.centres[own]) ** 2).sum(1)[:, None]
        a, b = own[:, None], lists[None, :]
        border = _squares(x, self.centres[lists]) - here <= 2 * reach * self.gap[a, b] + 1e-9
        turn = (a < b) == ((a + b) % 2 == 0)  # one of two lists asks the other, either as often as not
        return border & turn | (a == b)

    def lookup(self, lists: np.ndarray, codes: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coded members as their codes give them back, and the product with a unit query from which on the lookup distance may be
        ``within``: the bound allows for products in single precision."""
        back = self.centres[lists] + np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        square = (back * back).sum(1)
        return back.astype(np.float32), (1 + square - within ** 2) / 2 - (back.shape[1] + 4) * 2.0 ** -22 * (1 + square)


def _unit(raw: list[bytes], kind: str, d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, d).astype(float)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the links in a block connect: the links themselves, or for dense blocks one per member."""
    i, j = np.nonzero(link)
    if len(i) <= 2 * (len(left) + len(right)):
        return left[i], right[j]
    rows, cols = np.unique(i), np.unique(j)
    part = link[np.ix_(rows, cols)]
    name = np.arange(len(rows))
    while True:
        col = np.where(part, name[:, None], len(rows)).min(0)
        new = np.where(part, col[None, :], len(rows)).min(1)
        if (new == name).all():
            break
        name = new
    first = left[rows]
    return np.r_[first, right[cols]], np.r_[first[name], first[col]]


def _shelves(counts: dict[int, int], index: Index) -> tuple[np.ndarray, np.ndarray, int]:
    """First shelf and number of shelves of each list; neighbouring lists share one."""
    k = len(index.centres)
    middle = index.centres - index.centres.mean(0)
    axis = np.linalg.svd(middle, full_matrices=False)[2][0] if k > 1 else np.zeros(middle.shape[1])
    first, parts, at, filled = np.zeros(k, np.int64), np.ones(k, np.int64), 0, 0
    for c in np.argsort(middle @ axis, kind="stable").tolist():
        n = counts.get(c, 0)
        if filled and filled + n > SHELF:
            at, filled = at + 1, 0
        first[c], parts[c] = at, max(1, -(-n // SHELF))
        filled += n
        if parts[c] > 1:
            at, filled = at + parts[c], 0
    return first, parts, at + 1


def _search(classes: DataFrame, d: int, kind: str, threshold: float, sample: int) -> DataFrame:
    """(a, b, n): numbers of links (b NULL) and connecting links (n NULL) between classes of vectors of ``d`` components."""
    radius = float(np.sqrt(2 - 2 * threshold))
    own = classes.filter(F.col("size") == d).select("key", "copies", "raw")
    n = own.count()
    some = own if n <= sample else own.filter(F.pmod(F.col("key"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    index = Index.fit(_unit([bytes(r[0]) for r in some.select("raw").orderBy("key").collect()], kind, d), n)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                lists, codes, lost = index.encode(_unit(b.column(2).to_pylist(), kind, d))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes]),
                                                  pa.array(lost)], ["key", "copies", "raw", "list", "codes", "lost"])

    members = cut_lineage(own.mapInArrow(encode, "key long, copies long, raw binary, list int, codes binary, lost double"))
    counts = {r["list"]: r["n"] for r in members.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one per list
    first, parts, shelves = _shelves(counts, index)
    blocks = max(1, -(-n // QUERIES))
    names = ["shelf", "block", "member", "key", "copies", "raw", "list", "codes", "lost"]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(index.centres))
        on = np.zeros((len(every), shelves), dtype=np.float32)
        for c in every:
            on[c, first[c]:first[c] + parts[c]] = 1
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                b = batch.slice(start, CHUNK)
                key = b.column(0).to_numpy()
                lists = b.column(3).to_numpy()
                x = _unit(b.column(2).to_pylist(), kind, d)
                who, shelf = np.nonzero(index.probes(x, lists, every, radius).astype(np.float32) @ on)
                yield _dealt(b, who, shelf, key[who] % blocks, False)
                where = first[lists] + (key // blocks) % parts[lists]
                who = np.repeat(np.arange(len(key)), blocks)
                yield _dealt(b, who, where[who], np.tile(np.arange(blocks), len(key)), True)

    def _dealt(b: pa.RecordBatch, who: np.ndarray, shelf: np.ndarray, block: np.ndarray, member: bool) -> pa.RecordBatch:
        rows = b.take(pa.array(who))
        return pa.RecordBatch.from_arrays([pa.array(shelf.astype(np.int32)), pa.array(block.astype(np.int32)),
                                           pa.array(np.full(len(who), member)), *rows.columns], names)

    def match(group: pa.Table) -> pa.Table:
        member = group.column("member").to_numpy()
        left, right = group.filter(pa.array(~member)), group.filter(pa.array(member))
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        x, y = (_unit(t.column("raw").to_pylist(), kind, d) for t in (left, right))
        ka, kb = left.column("key").to_numpy(), right.column("key").to_numpy()
        ca, cb = left.column("copies").to_numpy(), right.column("copies").to_numpy()
        la, lb = left.column("list").to_numpy(), right.column("list").to_numpy()
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(kb), -1)
        back, least = index.lookup(lb, codes, radius + right.column("lost").to_numpy() + 1e-9)
        single = x.astype(np.float32)
        na, nb = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        lists = np.unique(lb)
        visits = index.probes(x, la, lists, radius)
        for c, at in enumerate(lists.tolist()):
            there, asking = np.flatnonzero(lb == at), np.flatnonzero(visits[:, c])
            coded, enough = back[there].T, least[there].astype(np.float32)[None, :]
            for s in range(0, len(asking), CHUNK):
                q = asking[s:s + CHUNK]
                link = single[q] @ coded >= enough
                if (mine := np.flatnonzero(la[q] == at)).size:
                    link[mine] &= ka[q[mine]][:, None] < kb[there][None, :]
                i, j = np.nonzero(link)
                if len(i) > link.size // 16:
                    link &= x[q] @ y[there].T >= threshold
                elif len(i):
                    for t in range(0, len(i), 1 << 16):
                        u, v = i[t:t + (1 << 16)], j[t:t + (1 << 16)]
                        link[u, v] = np.einsum("ij,ij->i", x[q[u]], y[there[v]]) >= threshold
                if link.any():
                    na[q] += link @ cb[there]
                    nb[there] += ca[q] @ link
                    edges.append(_forest(link, ka[q], kb[there]))
        count = [(k[n > 0], n[n > 0]) for k, n in ((ka, na), (kb, nb))]
        a = np.concatenate([k for k, _ in count] + [e[0] for e in edges])
        counted = sum(len(k) for k, _ in count)
        b = np.concatenate([np.zeros(counted, np.int64)] + [e[1] for e in edges])
        n = np.concatenate([v for _, v in count] + [np.zeros(len(a) - counted, np.int64)])
        is_count = np.arange(len(a)) < counted
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=is_count),
                         "n": pa.array(n, pa.int64(), mask=~is_count)})

    dealt = members.mapInArrow(deal, "shelf int, block int, member boolean, key long, copies long, raw binary, list int, "
                                     "codes binary, lost double")
    return dealt.groupBy("shelf", "block").applyInArrow(match, "a long, b long, n long")


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding",
                           sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    single = dict(df.dtypes)[vector_column] == "array<float>"
    v = F.col("v")
    usable = (v.isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull()
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"),
                     F.col(f"`{vector_column}`").cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.select("vec_id", "v", F.coalesce(usable, F.lit(False)).alias("usable"))
    keyed = rows.filter("usable").select("vec_id", "v", F.xxhash64("v").alias("key"), F.xxhash64(F.lit("second"), "v").alias("check"),
                                         F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    kind = "<f4" if single else "<f8"

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(x, kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), *batch.columns[2:]],
                                             ["vec_id", "raw", "key", "check", "salt"])

    keyed = keyed.mapInArrow(packed, "vec_id long, raw binary, key long, check long, salt int")
    classes = cut_lineage(keyed.groupBy("key", "check").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("raw").alias("raw"),
        F.collect_set("salt").alias("salts")).withColumn("size", (F.length("raw") / (4 if single else 8)).cast("int")))
    found = None
    for r in classes.select("size").distinct().collect():  # one length as a rule
        part = _search(classes, r["size"], kind, threshold, sample)
        found = part if found is None else found.union(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "a long, b long, n long")
    found = cut_lineage(found)
    links = found.filter("n is null").select("a", "b")
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "__k")
    group = components(links).withColumnRenamed("component", "group")
    named = cut_lineage(classes.select("key", "check", "rep", "copies", "salts")
                        .join(group, F.col("key") == F.col("node"), "left")
                        .join(counts, F.col("key") == F.col("__k"), "left")
                        .select("key", "check", "rep", "salts", F.coalesce("group", "key").alias("group"),
                                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    smallest = named.groupBy("group").agg(F.min("rep").alias("component_id")).withColumnRenamed("group", "__group")
    facts = named.join(smallest, F.col("group") == F.col("__group")).select(
        F.col("key").alias("__key"), F.col("check").alias("__check"), F.explode("salts").alias("__salt"), "n_links", "component_id")
    same = (F.col("key") == F.col("__key")) & (F.col("check") == F.col("__check")) & (F.col("salt") == F.col("__salt"))
    out = keyed.select("vec_id", "key", "check", "salt").join(facts, same).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
