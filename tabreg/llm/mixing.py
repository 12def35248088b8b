"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document of ``size`` words enters the mix at a rate (expected copies) between 0 and ``cap``. Of all rates that give every source its
target of words, those are taken that stay closest in relative entropy to one copy each: with ``x`` the size in units of the source's mean,

    rate = least(cap, exp(lambda * x)),    lambda of the source minimises the convex dual  sum phi(lambda * x) - lambda * target

where phi is exp up to log(cap) and a line beyond. Newton's steps on lambda are taken for all sources at once, each one aggregate over
counted (source, size) pairs; a bracket catches steps that leave it. Rates become whole copies: every document gets the whole part, and
those with a small (keyed draw / fraction) one more, up to the threshold at which the source's words meet its target; the rest is
filled, in the same order, with documents that still fit, and one that overshoots if that is nearer. Thresholds are found by sums over buckets of the draws, in two levels.

Targets: sources in code-point order, NULL last, have the weights ``weights``, repeating, and share ``share`` of all words; a target stops
at ``cap`` times its source's words and the excess goes to the others by weight.

Rows: NULL or empty text has size 0 and takes 0 words, as does a source without words. NULL sources are one source. Repeated rows share a
draw, so they are taken alike. NULL ids are kept. Draws depend on id, text and seed only: results do not depend on partitions. Only id,
text and source are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabreg.llm.common import cut_lineage, discard, narrow
from tabreg.operators.order import with_row_index

WORD = "[^\\x20\\x09-\\x0D]+"
FEW_SOURCES = 100_000   # facts of so many sources are broadcast (a few MB)
SALTS = 64
TOLERANCE = 1e-9        # of a source's target
ROUNDS = 200            # halving the bracket alone ends well before
FILLS = (1.0, 0.5, 0.5, 0.5, 1.0)  # passes: documents up to this part of what a source still needs
BITS = 16               # of a draw's 32 bits, by level
LATE = 1 << 2 * BITS


def word_count(text: Column) -> Column:
    """Words of a whole text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _beside(rows: DataFrame, facts: DataFrame, n: int, spread_by: str) -> DataFrame:
    """Each row with its source's facts (both have ``no``): broadcast if sources are counted as few, else dealt over salts."""
    if n <= FEW_SOURCES:
        return rows.join(F.broadcast(facts), "no")
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    spread = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(spread, ["no", "__salt"]).drop("__salt")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(no, source, source_size, n_docs, target) of the counted sources."""
    keyed = sources.withColumn("__last", F.col("source").isNull().cast("int")).withColumn("__name", F.coalesce("source", F.lit("")))
    numbered = with_row_index(keyed, ["__last", "__name"], "no").drop("__last", "__name")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("no"), F.lit(len(weights))).cast("int"))
    table = cut_lineage(numbered.withColumn("weight", weight))
    every = table.agg(F.sum("source_size"), F.sum("weight")).first()
    words, free = (every[0] or 0) * share, every[1] or 0.0
    level, most = words / free if free else 0.0, F.col("source_size") * F.lit(float(cap))
    while free:  # each round some sources reach their cap, or the level is final
        full = most <= F.lit(level) * F.col("weight")
        got = table.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        before, free = level, got[1] or 0.0
        level = (words - (got[0] or 0.0)) / free if free else level
        if level <= before:
            break
    return table.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("weight")


def _tilts(sizes: DataFrame, sources: DataFrame, n: int, cap: float) -> DataFrame:
    """(no, unit, tilt): rates are least(cap, exp(tilt * size / unit)). ``sizes``: (no, size, n) of documents with words."""
    one = sizes.groupBy("no").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("words"), F.min("size").alias("least"),
                                  F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(38,0)")).cast("double").alias("squares"))
    unit = F.col("words") / F.col("docs")
    want = F.col("target") / F.col("words")
    all_full = F.log(F.lit(float(cap))) / (F.col("least") / unit) * (1 + 1e-9)  # every document at the cap
    start = F.log(want) / (F.col("squares") / F.col("words") / unit)
    state = _beside(one, sources.select("no", "target").filter("target > 0"), n, "docs").select(
        "no", "docs", unit.alias("unit"), want.alias("want"), F.when(want < 1, -1 / (F.exp(F.lit(1.0)) * want)).otherwise(F.lit(0.0)).alias("low"),
        F.when(want < 1, F.lit(0.0)).otherwise(all_full).alias("high"),
        F.when(want >= cap * (1 - 1e-12), all_full).otherwise(start).alias("tilt"), F.lit(None).cast("double").alias("off"))
    state = cut_lineage(state.withColumn("tilt", F.greatest("low", F.least("high", "tilt"))))
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("unit")
        rate = F.exp(F.col("tilt") * x)
        met = (F.col("n") * x * F.least(F.lit(float(cap)), rate)).cast("decimal(38,12)")  # decimals: sums in any order agree
        slope = F.when(rate < cap, F.col("n") * x * x * rate).otherwise(F.lit(0.0)).cast("decimal(38,10)")
        facts = [F.max(c).alias(c) for c in ("docs", "unit", "want", "low", "high", "tilt")]
        sums = _beside(sizes, state, n, "size").groupBy("no").agg(*facts, F.sum(met).alias("met"), F.sum(slope).alias("slope"))
        off = F.col("met").cast("double") / F.col("docs") - F.col("want")
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off < 0, F.col("high")).otherwise(F.col("tilt"))
        sums = sums.withColumns({"off": F.abs(off) / F.col("want"), "low": low, "high": high, "__off": off})
        step = F.col("tilt") - F.col("__off") / (F.col("slope").cast("double") / F.col("docs"))
        moved = F.when((F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
        after = cut_lineage(sums.withColumn("tilt", F.when(F.col("off") <= TOLERANCE, F.col("tilt")).otherwise(moved))
                            .select("no", "docs", "unit", "want", "low", "high", "tilt", "off"))
        discard(state)
        state = after
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("no", "unit", "tilt")


def _filled(open_docs: DataFrame, state: DataFrame, k: int, part: float, n: int) -> DataFrame:
    """``state`` (no, need, ...) after one more fill: open documents of at most ``fit<k>`` words (``part`` of the need) whose draw is at most
    ``bound<k>`` get one more copy, as many in the order of draws as the need allows."""
    by_source = Window.partitionBy("no")
    needs = state.filter("need > 0").select("no", "need", (F.col("need") * F.lit(part)).alias("fit"))

    def first_beyond(rows: DataFrame, key: Column) -> DataFrame:
        sums = rows.groupBy("no", key.alias("at")).agg(F.sum("size").alias("words"), F.max("need").alias("need"), F.max("fit").alias("fit"))
        running = sums.withColumn("upto", F.sum("words").over(by_source.orderBy("at")))
        return running.groupBy("no").agg(F.max("need").alias("need"), F.max("fit").alias("fit"),
                                         F.min(F.when(F.col("upto") > F.col("need"), F.col("at"))).alias("at"),
                                         F.coalesce(F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))), F.lit(0)).alias("under"))

    fitting = _beside(open_docs, needs, n, "late").filter("size <= fit")
    coarse = cut_lineage(first_beyond(fitting, F.shiftright("late", BITS)))
    edge = coarse.filter("at is not null").select("no", (F.col("need") - F.col("under")).alias("need"), "fit", F.col("at").alias("bucket"))
    inside = _beside(open_docs, edge, n, "late").filter((F.col("size") <= F.col("fit")) & (F.shiftright("late", BITS) == F.col("bucket")))
    fine = first_beyond(inside, F.col("late")).select("no", F.col("at").alias("fine"), F.col("under").alias("more"))
    found = coarse.join(fine, "no", "left").select(
        "no", F.col("fit").alias(f"fit{k}"), F.coalesce(F.col("fine") - 1, F.lit(LATE)).alias(f"bound{k}"),
        (F.col("under") + F.coalesce("more", F.lit(0))).alias("got"))
    after = state.join(found, "no", "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).drop("got")
    return cut_lineage(after)


def _nearest(open_docs: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """``state`` with the size and draw (``last_size``, ``last_late``) of the open document whose copy brings a source nearest to its
    target, where one more brings it nearer than none."""
    alike = _beside(open_docs, state.select("no", "need").filter("need > 0"), n, "late").groupBy("no", "size", "late").agg(
        F.sum("size").alias("words"), F.max("need").alias("need"))
    gap = F.abs(F.col("words") - F.col("need"))
    best = alike.filter(gap < F.col("need")).groupBy("no").agg(F.min(F.struct(gap.alias("gap"), "late", "size")).alias("best"))
    return cut_lineage(state.join(best, "no", "left").withColumns({"last_size": F.col("best.size"), "last_late": F.col("best.late")}).drop("best"))


def mix_sources(df: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), share: float = 1.0, cap: int = 3, seed: int = 42,
                id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source), taken (words of all its copies), copies, rate."""
    rows = narrow(df, doc_id=f"{id_column}:long", text=f"{text_column}:string", source=f"{source_column}:string")
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 32) + 0.5) / F.lit(float(1 << 32))
    base = cut_lineage(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw")))
    counted = base.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = cut_lineage(source_targets(cut_lineage(counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))), weights, share, cap))
    n = sources.count()
    named = sources.withColumn("__source", F.col("source")).select("no", "__source", "source_size", "target")

    def numbered(rows: DataFrame, spread_by: str) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("__source"))
        if n <= FEW_SOURCES:
            return rows.join(F.broadcast(named), same).drop("source", "__source")
        salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
        spread = named.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", salt).join(spread, same & (F.col("__salt") == F.col("__s"))).drop("source", "__source", "__salt", "__s")

    sizes = cut_lineage(numbered(counted.filter("size > 0"), "size").select("no", "size", "n"))
    tilts = _tilts(sizes, sources, n, cap)
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("unit")))).otherwise(F.lit(0.0))
    with_tilt = _beside(numbered(base, "draw"), sources.select("no").join(tilts, "no", "left"), n, "draw")
    rated = with_tilt.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("whole", F.floor("rate"))
    part = F.col("rate") - F.col("whole")
    late = F.when(part > 0, F.floor(F.col("draw") / (F.col("draw") + part) * LATE)).cast("long")  # small: first to get one more copy
    docs = cut_lineage(rated.select("doc_id", "no", "size", "source_size", "target", "rate", "whole", late.alias("late")))
    state = docs.groupBy("no").agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("given"))
    state = cut_lineage(state.select("no", (F.col("target") - F.col("given")).alias("need")))
    more, left = F.lit(False), docs.filter("late is not null and size > 0").select("no", "size", "late")
    for k, part in enumerate(FILLS):
        state = _filled(left, state, k, part, n)
        here = F.coalesce((F.col("size") <= F.col(f"fit{k}")) & (F.col("late") <= F.col(f"bound{k}")), F.lit(False))
        more = more | here
        left = _beside(left, state.select("no", f"fit{k}", f"bound{k}"), n, "late").filter(~here).select("no", "size", "late")
    state = _nearest(left, state, n)
    more = more | F.coalesce((F.col("size") == F.col("last_size")) & (F.col("late") == F.col("last_late")), F.lit(False))
    copies = (F.col("whole") + more.cast("int")).cast("int")
    return _beside(docs, state, n, "late").select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), "rate")
