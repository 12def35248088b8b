"""Exact k nearest neighbours as a two-round, pruned block join.

Donor rows are grouped by nearest pivot (and by which of their cells are missing), so every group has
a bounding box.  Round one looks into the closest groups of a query until it has seen k donors; that
gives a distance bound.  Round two visits only groups whose box is within the bound.  Nothing is
approximated: a group is skipped only when no row in it can be among the k nearest.  A donor set that
was counted and found small is sent to the tasks whole instead, which needs one job.

Boxes of many features rule little out.  There round two pairs chunks of queries with all blocks, and
a product of matrices rules rows out; the few that its rounding error leaves get the plain distance, so
results are the same to the last bit.

Groups are cut into blocks of bounded size and queries into chunks of bounded size, so a crowded
region becomes many small tasks.  A block is sent once per ``SHARE`` chunks that ask for it, not once per chunk.

Queries of few features that lack the same cells are searched among the donors' other cells only: groups are then tight in
what is compared, and donors that differ elsewhere are copies.  Copies of one donor vector are cut to the k first ids, which cannot
change any result because ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double_sql, q
from tabreg.sources.storage import cut_lineage, discard, spread

MAX_PIVOTS = 1_024
NARROW_PIVOTS = 2_048  # of rows of few features, whose boxes are tight
MAX_GROUPS = 20_000
BLOCK_ROWS = 2_048
CHUNK_ROWS = 256
SCRATCH_CELLS = 2_000_000
SMALL_DONORS = 20_000
SMALL_CELLS = 2_000_000
WIDE = 8               # features from which distances come from a product of matrices first
FEW_GROUPS = 1 / 8     # share of the groups beyond which queries of wide rows visit all of them
TILE_ROWS = 4_096
TASK_BLOCKS = 64
SHARE = 64             # chunks of queries that meet one copy of a block
COMMON = 1 / 16        # share of the queries from which a set of missing cells gets a search of its own


def _vectors(df: DataFrame, features: Sequence[str], row_id: str, payload: str | None = None) -> DataFrame:
    """(id, vec[, value]): missing cells are NaN inside vec."""
    cells = ", ".join(f"coalesce({clean_double_sql(c)}, double('NaN'))" for c in features)
    extra = [F.expr(f"{clean_double_sql(payload)} AS value")] if payload else []
    return df.select(q(row_id).alias("id"), F.expr(f"array({cells})").alias("vec"), *extra)


def _stack(column: pa.ChunkedArray | pa.Array, p: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, p) if len(column) else np.zeros((0, p))


def _pattern(x: np.ndarray) -> list[str]:
    """Which cells of a row are missing; the empty text when none is."""
    holes = np.isnan(x)
    if not holes.any():
        return [""] * len(x)
    packed = np.packbits(holes, axis=1)
    return [b.tobytes().hex() if h else "" for b, h in zip(packed, holes.any(1))]


class Boxes:
    """Bounding boxes of the donor groups, held by every task; their number is bounded."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray, metric: int):
        self.low, self.high, self.rows, self.metric = low, high, rows, metric
        self.seen = ~np.isnan(low)

    def lower_bounds(self, x: np.ndarray) -> np.ndarray:
        """Smallest possible distance of each query to a donor of each group; inf without shared cells."""
        p = x.shape[1]
        both = (~np.isnan(x))[:, None, :] & self.seen[None]
        gap = np.maximum(np.maximum(self.low[None] - x[:, None], x[:, None] - self.high[None]), 0.0)
        gap = np.where(both, gap, 0.0)
        shared = both.sum(2)
        total = (gap ** self.metric).sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(shared > 0, total * p / shared, np.inf)
        return np.sqrt(out) if self.metric == 2 else out

    def home(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Mask of the closest groups that together hold at least k donors."""
        first = bounds.argmin(1)
        more = self.rows[first] < k
        if not more.all():  # most often the closest group is enough
            mask = np.zeros(bounds.shape, bool)
            mask[np.arange(len(first)), first] = True
            if more.any():
                mask[more] = self.home(bounds[more], k)
            return mask & np.isfinite(bounds)
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(np.where(np.isfinite(np.take_along_axis(bounds, order, 1)), self.rows[order], 0), axis=1)
        before = np.concatenate([np.zeros((len(order), 1)), held[:, :-1]], axis=1)
        mask = np.zeros(bounds.shape, bool)
        np.put_along_axis(mask, order, before < k, axis=1)
        return mask & np.isfinite(bounds)


def distances(x: np.ndarray, d: np.ndarray, metric: int) -> np.ndarray:
    """Query x donor distances over shared cells, scaled up to the full width; inf without any."""
    p = x.shape[1]
    if p < WIDE:
        return _narrow_distances(x, d, metric)
    diff = np.abs(x[:, None] - d[None])
    holes = np.isnan(diff)
    some = holes.any()
    if some:
        diff[holes] = 0.0
    total = (diff * diff).sum(2) if metric == 2 else diff.sum(2)
    if some:
        shared = p - holes.sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(shared > 0, total * p / shared, np.inf)
    return np.sqrt(total) if metric == 2 else total


def _narrow_distances(x: np.ndarray, d: np.ndarray, metric: int) -> np.ndarray:
    """``distances`` column by column: the same sums without p cells a pair."""
    p = x.shape[1]
    xholes, dholes = np.isnan(x), np.isnan(d)
    total, shared = np.zeros((len(x), len(d))), np.zeros((1, 1), int)
    for j in range(p):
        if xholes[:, j].all() or dholes[:, j].all():
            continue
        diff = x[:, j, None] - d[None, :, j]
        both = 1
        if xholes[:, j].any() or dholes[:, j].any():
            both = ~(xholes[:, j, None] | dholes[None, :, j])
            diff[~both] = 0.0
        shared = shared + both
        total += diff * diff if metric == 2 else np.abs(diff)
    if xholes.any() or dholes.any():
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(shared > 0, total * p / shared, np.inf)
    return np.sqrt(total) if metric == 2 else total


def _same(qid: np.ndarray, did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, donor) of equal ids; an id that is not equal to itself meets none."""
    if qid.dtype.kind not in "iufUSM" or did.dtype.kind not in "iufUSM":
        return np.nonzero(qid[:, None] == did[None])
    order = np.argsort(did, kind="stable")
    first, last = np.searchsorted(did[order], qid, "left"), np.searchsorted(did[order], qid, "right")
    count = np.where(qid == qid, last - first, 0)
    row = np.repeat(np.arange(len(qid)), count)
    return row, order[first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]


def _step(donors: int, p: int, metric: int) -> int:
    """Queries to compare at a time: a product of matrices needs a cell a pair, plain distances need p."""
    return max(1, SCRATCH_CELLS // (donors * (1 if metric == 2 and p >= WIDE else p)))


def _pair_distances(x: np.ndarray, d: np.ndarray, row: np.ndarray, at: np.ndarray, metric: int) -> np.ndarray:
    """``distances`` of single pairs, with the same roundings."""
    out, step = np.empty(len(row)), max(1, SCRATCH_CELLS // x.shape[1])
    for k in range(0, len(row), step):
        diff = np.abs(x[row[k:k + step]] - d[at[k:k + step]])
        total = (diff * diff).sum(1) if metric == 2 else diff.sum(1)
        out[k:k + step] = np.sqrt(total) if metric == 2 else total
    return out


def _products(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared distances by a product of matrices, and how far off those of a query can be; None where that bound does not hold."""
    p = x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (x * x).sum(1), (d * d).sum(1)
        off = (p + 16) * 4 * np.finfo(float).eps * (a + b.max(initial=0.0)) + np.finfo(float).tiny
    if not np.isfinite(off).all():
        return None
    square = x @ d.T
    square *= -2.0
    square += a[:, None]
    square += b[None]
    return square, off


def _near(x: np.ndarray, d: np.ndarray, qid: np.ndarray, did: np.ndarray, k: int, metric: int, exclude_self: bool,
          within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, donor, distance) of each query's k smallest (distance, id), in that order; ``within`` bounds the distances asked for.

    Wide rows are compared by a product of matrices first; what its error cannot rule out gets the plain distance."""
    k = min(k, len(d))
    found = _products(x, d) if metric == 2 and x.shape[1] >= WIDE else None
    if found is None:
        step, off = max(1, SCRATCH_CELLS // (len(d) * x.shape[1])), 0.0
        rough = np.concatenate([distances(x[at:at + step], d, metric) for at in range(0, len(x), step)])
    else:
        rough, off = found
    if exclude_self:
        rough[_same(qid, did)] = np.inf
    if within is None or np.isinf(within).any():
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
    else:
        edge = within * within * (1 + 1e-12) if found is not None else within
    with np.errstate(invalid="ignore"):
        row, at = np.nonzero((rough <= (edge + 2 * off)[:, None]) & np.isfinite(rough))
    dist = rough[row, at] if found is None else _pair_distances(x, d, row, at, metric)
    order = np.lexsort((did[at], dist, row))
    row, at, dist = row[order], at[order], dist[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
    first = nth < k
    return row[first], at[first], dist[first]


def _visit(chunks: DataFrame, blocks: DataFrame, counts: DataFrame, p: int, k: int, metric: int, exclude_self: bool) -> DataFrame:
    """chunks (group, qid, qx, within) x blocks of that group -> best k per query and block, none beyond the query's ``within``."""
    chunks = cut_lineage(chunks)
    heat = F.broadcast(chunks.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares")))  # at most MAX_GROUPS rows
    from_zero = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # one key per block and share: a crowded group is spread over its blocks, a block that many ask for over its shares
    each = (chunks.join(F.broadcast(counts), "group").withColumn("block", from_zero("blocks"))
            .join(heat, "group").withColumn("share", F.pmod(F.xxhash64("qx", "qid"), F.col("shares"))))
    held = blocks.join(heat, "group").withColumn("share", from_zero("shares"))
    key = ["group", "block", "share"]
    rows = (held.select(*key, F.lit(0).alias("asks"), "did", F.col("dx").alias("x"), F.col("dv").alias("extra"))
            .unionByName(each.select(*key, F.lit(1).alias("asks"), "qid", F.col("qx").alias("x"), F.col("within").alias("extra")),
                         allowMissingColumns=True))
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "asks").select("asks", "did", "qid", "x", "extra")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dids, did, d, dv = None, None, None, None
        for batch in batches:
            asks, out = batch.column(0).to_numpy(), []
            for row in range(batch.num_rows):
                x = np.array(batch.column(3)[row].values).reshape(-1, p)
                extra = np.array(batch.column(4)[row].values)
                if not asks[row]:
                    dids, d, dv = batch.column(1)[row].values, x, extra
                    did = dids.to_numpy(zero_copy_only=False)
                    continue
                qids = batch.column(2)[row].values
                qid, step = qids.to_numpy(zero_copy_only=False), _step(len(d), p, metric)
                for at in range(0, len(x), step):
                    one, best, dist = _near(x[at:at + step], d, qid[at:at + step], did, k, metric, exclude_self, extra[at:at + step])
                    out.append((qids.take(pa.array(at + one)), dids.take(pa.array(best)), pa.array(dist), pa.array(dv[best])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([o[j] for o in out]) for j in range(4)],
                                                 names=["id", "neighbor", "dist", "value"])

    id_type, did_type = (rows.schema[c].dataType.elementType.simpleString() for c in ("qid", "did"))
    return ordered.mapInArrow(compare, f"id {id_type}, neighbor {did_type}, dist double, value double")


def _merge(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("dist", "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pivot_rows(donors: DataFrame, count: int) -> np.ndarray:
    rows = donors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(count).collect()
    return np.array([r[0] for r in rows], float)


def nearest(queries: DataFrame, donors: DataFrame, features: Sequence[str], k: int, query_id: str, donor_id: str,
            payload: str | None = None, metric: int = 2, exclude_self: bool = False,
            small_donors: int = SMALL_DONORS) -> DataFrame:
    """(id, neighbor, rank, dist, value): the k nearest donors of every query, ties by donor id."""
    p = len(features)
    if k < 1 or metric not in (1, 2):
        raise ValueError("k must be positive and metric 1 or 2")
    every = _vectors(donors, features, donor_id, payload)
    if payload is None:
        every = every.withColumn("value", F.lit(None).cast("double"))
    limit = min(small_donors, SMALL_CELLS // p)
    few = every.limit(limit + 1).toPandas() if limit else None
    if few is not None and len(few) == 0:
        raise ValueError("no donor rows")
    if few is not None and len(few) <= limit:
        return _against_all(_vectors(queries, features, query_id), every, few, p, k, metric, exclude_self)
    ask = cut_lineage(_vectors(queries, features, query_id))
    if p >= WIDE:
        return _block_join(ask, every, p, k, metric, exclude_self)
    missing = F.transform("vec", lambda v: F.isnan(v))
    total = ask.count()
    shapes = [r["holes"] for r in ask.groupBy(missing.alias("holes")).count()
              .where(F.col("count") >= max(1, COMMON * total)).orderBy("holes").collect()]  # at most 1 / COMMON
    shapes = [h for h in shapes if any(h) and not all(h)]
    found, rest = [], ask
    for holes in shapes:
        cells = F.array(*[F.lit(float("nan")) if h else F.col("vec")[j] for j, h in enumerate(holes)])
        found.append(_block_join(rest.where(missing == F.lit(holes)), every.withColumn("vec", cells), p, k, metric, exclude_self))
        rest = rest.where(missing != F.lit(holes))
    if not shapes or not rest.isEmpty():
        found.append(_block_join(rest, every, p, k, metric, exclude_self))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _block_join(ask: DataFrame, every: DataFrame, p: int, k: int, metric: int, exclude_self: bool) -> DataFrame:
    """``nearest`` of queries (id, vec) among donors (id, vec, value) by blocks."""
    want = k + 1 if exclude_self else k
    # NaN equals NaN inside grouping keys, so copies with the same missing cells count as copies
    copies = Window.partitionBy("vec").orderBy("id")
    unique = (every.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= want).drop("copy"))
    unique = cut_lineage(unique)
    n = unique.count()
    if n == 0:
        raise ValueError("no donor rows")
    # a query reads every box and a few groups: for tight boxes both are about equal work
    pivots = _pivot_rows(unique, int(np.clip(round(np.sqrt(n) * 2), 1, NARROW_PIVOTS) if p < WIDE else
                                     np.clip(round(np.sqrt(n) / 4), 1, MAX_PIVOTS))).reshape(-1, p)
    centre = np.nansum(pivots, axis=0) / np.maximum((~np.isnan(pivots)).sum(0), 1)
    pivots = np.where(np.isnan(pivots), centre, pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch.column(1), p)
            full = np.where(np.isnan(x), centre, x)
            cells = np.empty(len(x), np.int32)
            step = max(1, SCRATCH_CELLS // (len(pivots) * p))
            for at in range(0, len(x), step):
                part = full[at:at + step]
                far = _narrow_distances(part, pivots, 2) if p < WIDE else ((part[:, None] - pivots[None]) ** 2).sum(2)
                cells[at:at + step] = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_pattern(x), pa.string()), pa.array(cells)],
                names=["id", "vec", "value", "pattern", "cell"])

    id_type = unique.schema["id"].dataType.simpleString()
    placed = unique.mapInArrow(place, f"id {id_type}, vec array<double>, value double, pattern string, cell int")
    sizes = placed.groupBy("pattern", "cell").agg(F.count(F.lit(1)).alias("rows"))
    found = sizes.orderBy("pattern", "cell").limit(MAX_GROUPS + 1).collect()
    coarse = len(found) > MAX_GROUPS
    if coarse:  # too many missing-cell patterns: cells only, boxes switched off, still exact
        placed = placed.withColumn("pattern", F.lit(""))
        sizes = placed.groupBy("pattern", "cell").agg(F.count(F.lit(1)).alias("rows"))
        found = sizes.orderBy("pattern", "cell").collect()
    number = {(r["pattern"], r["cell"]): i for i, r in enumerate(found)}
    table = every.sparkSession.createDataFrame(
        [(pt, c, i, int(r["rows"])) for ((pt, c), i), r in zip(number.items(), found)],
        "pattern string, cell int, group int, rows long")
    counts = table.select("group", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"))  # at most MAX_GROUPS rows
    numbered = placed.join(F.broadcast(table), ["pattern", "cell"])
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK_ROWS))
    blocks = cut_lineage(
        numbered.groupBy("group", block.alias("block")).agg(F.collect_list(F.struct("id", "vec", "value")).alias("m"))
        .select("group", "block", F.col("m.id").alias("did"), F.flatten(F.col("m.vec")).alias("dx"),
                F.transform(F.col("m.value"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias("dv")))
    rows = np.array([r["rows"] for r in found])
    low, high = np.full((len(found), p), -np.inf), np.full((len(found), p), np.inf)
    if not coarse:
        edges = (blocks.select("group", "dx").mapInArrow(_edges(p), "group int, low array<double>, high array<double>")
                 .groupBy("group").agg(
                     F.array(*[F.min(F.col("low")[j]) for j in range(p)]).alias("low"),
                     F.array(*[F.max(F.col("high")[j]) for j in range(p)]).alias("high")).collect())
        for r in edges:
            low[r["group"]], high[r["group"]] = r["low"], r["high"]
    boxes = Boxes(low, high, rows, metric)
    discard(unique)
    first = cut_lineage(_merge(_visit(_routes(ask, boxes, p, want, None), blocks, counts, p, k, metric, exclude_self), k))
    bound = first.groupBy("id").agg(F.max(F.when(F.col("rank") == k, F.col("dist"))).alias("bound"))
    bounded = ask.join(bound, "id", "left")
    if p >= WIDE and _reached(bounded, boxes, p, want) > FEW_GROUPS:
        found = _by_tiles(bounded, blocks, int((-(-rows // BLOCK_ROWS)).sum()), p, k, metric, exclude_self)
    else:
        second = _visit(_routes(bounded, boxes, p, want, "bound"), blocks, counts, p, k, metric, exclude_self)
        found = first.drop("rank").unionByName(second)
    return _merge(found, k).select(
        "id", "neighbor", "rank", "dist", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def _reached(bounded: DataFrame, boxes: Boxes, p: int, want: int) -> float:
    """Share of all (query, group) that the bounds cannot rule out."""
    each = _routes(bounded, boxes, p, want, "bound", count=True).agg(F.sum("reached"), F.sum("asked")).first()
    return (each[0] or 0) / max((each[1] or 0) * len(boxes.rows), 1)


def _by_tiles(bounded: DataFrame, blocks: DataFrame, n_blocks: int, p: int, k: int, metric: int, exclude_self: bool) -> DataFrame:
    """Every query against every block where boxes rule little out: (id, neighbor, dist, value), the k best per query and part of
    the blocks. A row of the product is a chunk of queries and a block, so no query travels once per group; a task keeps its chunk's
    bounds from block to block and holds one chunk, one block and the chunk's best."""
    id_type = bounded.schema["id"].dataType.simpleString()
    did_type = blocks.schema["did"].dataType.elementType.simpleString()
    n_chunks = max(1, -(-bounded.count() // TILE_ROWS))
    cell = F.struct("id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    chunks = (bounded.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n_chunks)))
              .groupBy("chunk").agg(F.collect_list(cell).alias("qs"))
              .select("chunk", F.col("qs.id").alias("qid"), F.flatten(F.col("qs.vec")).alias("qx"), F.col("qs.bound").alias("qb")))
    pairs = chunks.repartition(n_chunks, "chunk").crossJoin(
        blocks.select("did", "dx", "dv").repartition(max(1, -(-n_blocks // TASK_BLOCKS))).hint("shuffle_replicate_nl"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Chunk | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py()
                if state is None or state.key != key:
                    if state is not None:
                        yield state.result()
                    qid, qx, qb = (batch.column(c)[row].values for c in (1, 2, 3))
                    state = _Chunk(key, qid.to_numpy(zero_copy_only=False), np.array(qx).reshape(-1, p), np.array(qb), k)
                did = batch.column(4)[row].values.to_numpy(zero_copy_only=False)
                d, dv = np.asarray(batch.column(5)[row].values).reshape(-1, p), np.asarray(batch.column(6)[row].values)
                step = _step(len(d), p, metric)
                for at in range(0, len(state.qid), step):
                    one, best, dist = _near(state.x[at:at + step], d, state.qid[at:at + step], did, k, metric, exclude_self,
                                            state.within[at:at + step])
                    state.add(at + one, did[best], dist, dv[best])
                state.tighten()
        if state is not None:
            yield state.result()

    return pairs.mapInArrow(compare, f"id {id_type}, neighbor {did_type}, dist double, value double")


class _Chunk:
    """Queries of one chunk with the best donors met so far."""

    def __init__(self, key: int, qid: np.ndarray, x: np.ndarray, within: np.ndarray, k: int):
        self.key, self.qid, self.x, self.within, self.k = key, qid, x, within, k
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, *columns: np.ndarray) -> None:
        self.found.append(columns)

    def tighten(self) -> None:
        """Keep the k best of each query; the k-th bounds what is still looked for."""
        if not self.found:
            return
        row, did, dist, dv = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((did, dist, row))
        row, did, dist, dv = row[order], did[order], dist[order], dv[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
        last, first = nth == self.k - 1, nth < self.k
        self.within[row[last]] = np.minimum(self.within[row[last]], dist[last])
        self.found = [(row[first], did[first], dist[first], dv[first])]

    def result(self) -> pa.RecordBatch:
        self.tighten()
        row, did, dist, dv = self.found[0] if self.found else (np.zeros(0, int), self.qid[:0], np.zeros(0), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.qid[row]), pa.array(did), pa.array(dist), pa.array(dv)],
                                          names=["id", "neighbor", "dist", "value"])


def _against_all(ask: DataFrame, every: DataFrame, few, p: int, k: int, metric: int, exclude_self: bool) -> DataFrame:
    """Every query against a small, counted donor set held by each task."""
    did = few["id"].to_numpy()
    d = np.vstack([np.asarray(v, float) for v in few["vec"]])
    dv = few["value"].to_numpy(float)
    id_type, did_type = ask.schema["id"].dataType.simpleString(), every.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _step(len(d), p, metric)
        for batch in batches:
            qid, x = batch.column(0).to_numpy(zero_copy_only=False), _stack(batch.column(1), p)
            for at in range(0, len(x), step):
                one, best, dist = _near(x[at:at + step], d, qid[at:at + step], did, k, metric, exclude_self)
                rank = (np.arange(1, len(one) + 1) - np.searchsorted(one, one, "left")).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (qid[at + one], did[best], rank, dist, dv[best])],
                                                 names=["id", "neighbor", "rank", "dist", "value"])

    # the comparisons, not the rows, are the work: use every core even if the scan is one split
    found = spread(ask).mapInArrow(compare, f"id {id_type}, neighbor {did_type}, rank int, dist double, value double")
    return found.select("id", "neighbor", "rank", "dist", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def _edges(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, lows, highs = [], [], []
            for row in range(batch.num_rows):
                d = np.asarray(batch.column(1)[row].values).reshape(-1, p)
                groups.append(batch.column(0)[row].as_py())
                lows.append(d.min(0))
                highs.append(d.max(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int32()), pa.array(lows, pa.list_(pa.float64())),
                 pa.array(highs, pa.list_(pa.float64()))], names=["group", "low", "high"])

    return run


def _routes(ask: DataFrame, boxes: Boxes, p: int, want: int, bound: str | None, count: bool = False) -> DataFrame:
    """Chunks of queries (group, qid, qx, within) for their home groups, or the further groups their bound cannot rule out;
    ``count`` adds these up only."""
    rows = CHUNK_ROWS
    id_type = ask.schema["id"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCRATCH_CELLS // (len(boxes.rows) * p))
        kept, gathered = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _stack(batch.column(1), p)
                lower = boxes.lower_bounds(x)
                go = boxes.home(lower, want)
                limit = np.full(len(x), np.inf)
                if bound is not None:
                    limit = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                    limit = np.where(np.isnan(limit), np.inf, limit * (1 + 1e-12))
                    go = ~go & (lower <= limit[:, None]) & np.isfinite(lower)
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([int(go.sum())]), pa.array([len(go)])], names=["reached", "asked"])
                    continue
                who, group = np.nonzero(go)
                kept.append((batch.column(0).take(pa.array(who)), x[who], limit[who], group))
                gathered += len(who)
                if gathered * (p + 2) >= SCRATCH_CELLS:
                    yield _chunked(kept, rows)
                    kept, gathered = [], 0
        if gathered:
            yield _chunked(kept, rows)

    cols = ["id", "vec"] + ([bound] if bound else [])
    # the boxes, not the rows, are the work: use every core even if the queries lie in one file
    return ask.select(*cols).hint("rebalance").mapInArrow(route, "reached long, asked long" if count else
                                         f"group int, qid array<{id_type}>, qx array<double>, within array<double>")


def _chunked(kept: list[tuple], rows: int) -> pa.RecordBatch:
    """Visits (id, vec, within, group) as rows of at most ``rows`` queries of one group."""
    group = np.concatenate([v[3] for v in kept])
    order = np.argsort(group, kind="stable")
    group, x = group[order], np.concatenate([v[1] for v in kept])[order]
    nth = np.arange(len(group)) - np.searchsorted(group, group, "left")
    start = np.flatnonzero(nth % rows == 0)
    cuts = np.r_[start, len(group)].astype(np.int32)

    def lists(values: pa.Array, width: int = 1) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts * np.int32(width)), values)

    return pa.RecordBatch.from_arrays(
        [pa.array(group[start].astype(np.int32)), lists(pa.concat_arrays([v[0] for v in kept]).take(pa.array(order))),
         lists(pa.array(x.ravel()), x.shape[1]), lists(pa.array(np.concatenate([v[2] for v in kept])[order]))],
        names=["group", "qid", "qx", "within"])


def knn_graph(df: DataFrame, features: Sequence[str], row_id: str, k: int = 15, scaled: bool = True,
              small_donors: int = SMALL_DONORS) -> DataFrame:
    """(src, dst, rank, dist): the k nearest other rows of every row, on unit-variance features.

    Up to ``small_donors`` rows are sent whole to every task; more meet in the block join."""
    from tabreg.operators.encode import scale

    base = scale(df, list(features), "standard") if scaled else df
    out = nearest(base, base, features, k, row_id, row_id, exclude_self=True, small_donors=small_donors)
    return out.select(F.col("id").alias("src"), F.col("neighbor").alias("dst"), "rank", "dist")


def knn_impute(df: DataFrame, cols: Sequence[str], k: int, row_id: Sequence[str]) -> DataFrame:
    """Fill each missing cell with the mean of its k nearest rows that have the cell (unique row id needed).

    A row that shares no cell with any donor gets the column mean.
    """
    from tabreg.operators.impute import column_means, fill

    if len(row_id) != 1:
        raise ValueError("neighbour imputation needs one unique row_id column")
    key = row_id[0]
    holes = df.agg(*[F.sum(F.expr(f"CASE WHEN {clean_double_sql(c)} IS NULL THEN 1 ELSE 0 END")).alias(f"h{i}")
                     for i, c in enumerate(cols)]).first()
    gaps = [c for i, c in enumerate(cols) if holes[f"h{i}"]]
    pieces = None
    for c in gaps:
        missing = F.expr(f"{clean_double_sql(c)} IS NULL")
        donors = df.where(~missing)
        if donors.limit(1).count() == 0:
            continue
        near = nearest(df.where(missing), donors, cols, k, key, key, payload=c)
        part = near.groupBy("id").agg(F.avg("value").alias("v")).withColumn("c", F.lit(c))
        pieces = part if pieces is None else pieces.unionByName(part)
    if pieces is None:
        return df
    wide = pieces.groupBy(F.col("id").alias("__id")).agg(*[
        F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"__v{i}") for i, c in enumerate(gaps)])
    joined = df.join(wide, q(key) == F.col("__id"), "left")
    filled = joined.select(*[
        F.coalesce(F.expr(clean_double_sql(c)), F.col(f"__v{gaps.index(c)}")).alias(c) if c in gaps else q(c)
        for c in df.columns])
    return fill(filled, {c: v for c, v in column_means(df, gaps).items()})
