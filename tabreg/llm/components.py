"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import cut_lineage, discard


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round every node hooks to its neighbour of the smallest hash, if that is smaller than its own; one jump doubles the
    reach; links are rewritten between what is left and shrink until none remain. A hub ends a star in two rounds, and a chain
    falls to pieces of random length, so rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder; a hub's rows meet its row in a plain join, which Spark may split."""
    edges = cut_lineage(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").distinct())
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    steps: list[DataFrame] = []  # each maps the nodes of a round to what is left of them
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("low")).select("a", F.least("low", rank("a"))["node"].alias("to"))
        far = hook.select(F.col("a").alias("via"), F.col("to").alias("far"))
        step = cut_lineage(hook.join(far, F.col("to") == F.col("via")).select("a", F.col("far").alias("to")))
        steps.append(step)
        left, right = (step.select(F.col("a").alias(f"{x}0"), F.col("to").alias(f"{x}1")) for x in "lr")
        rest = cut_lineage(edges.join(left, F.col("a") == F.col("l0")).join(right, F.col("b") == F.col("r0"))
                           .filter("l1 != r1").select(F.least("l1", "r1").alias("a"), F.greatest("l1", "r1").alias("b")).distinct())
        discard(edges)
        edges = rest
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for k, step in enumerate(steps[1:]):
        later = step.select(F.col("a").alias(f"a{k}"), F.col("to").alias(f"to{k}"))
        whole = (whole.join(later, F.col("root") == F.col(f"a{k}"), "left")
                 .select("node", F.coalesce(f"to{k}", "root").alias("root")))
    whole = cut_lineage(whole)
    names = whole.groupBy("root").agg(F.min("node").alias("component")).withColumnRenamed("root", "__root")
    names = cut_lineage(names)
    out = cut_lineage(whole.join(names, F.col("root") == F.col("__root")).select("node", "component"))
    for t in (*steps, whole, names):
        discard(t)
    return out
