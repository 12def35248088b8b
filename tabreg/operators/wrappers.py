"""Feature selection around forest models: recursive elimination and all-relevant search."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, clean_double_sql, q
from tabreg.functions.distributions import binomial_tails
from tabreg.operators.encode import label_encode, scale
from tabreg.operators.order import INDEX
from tabreg.operators.permute import from_blocks, random_blocks, shuffler
from tabreg.operators.split import shuffle
from tabreg.roles import Roles
from tabreg.sources.storage import cut_lineage, discard

LABEL = "__y"


def rfe(df: DataFrame, roles: Roles, n: int, num_trees: int = 100, max_depth: int = 10,
        seed: int = 42) -> tuple[DataFrame, Roles]:
    """Drop the least important feature, one per round, until n are left; original values are returned."""
    candidates = list(dict.fromkeys((*roles.features, *roles.categorical)))
    if not 1 <= n <= len(candidates):
        raise ValueError("n must lie between 1 and the number of features")
    texts = [c for c in candidates if df.schema[c].dataType.typeName() == "string"]
    coded = label_encode(df.select(*[q(c) for c in (*candidates, roles.target)]), texts)
    coded = scale(coded, [c for c in candidates if c not in roles.categorical], "standard")
    rows = cut_lineage(
        VectorAssembler(inputCols=candidates, outputCol="__all", handleInvalid="error").transform(coded)
        .select("__all", clean_double(roles.target).alias(LABEL)))
    left = list(range(len(candidates)))
    while len(left) > n:
        sliced = VectorSlicer(inputCol="__all", outputCol="__x", indices=left).transform(rows)
        model = RandomForestRegressor(featuresCol="__x", labelCol=LABEL, numTrees=num_trees, maxDepth=max_depth,
                                      seed=seed).fit(sliced)
        weights = model.featureImportances.toArray()
        left.pop(min(range(len(left)), key=lambda i: (weights[i], -left[i])))
    discard(rows)
    chosen = [candidates[i] for i in left]
    kept = roles.with_features(chosen, [c for c in roles.categorical if c in chosen])
    wanted = dict.fromkeys((*roles.row_id, *roles.order_by, *chosen, roles.target))
    return df.select(*[q(c) for c in wanted]), kept


def with_shadows(blocks: DataFrame, columns: list[str], live: list[int], shadow_of: list[int], seed: int) -> DataFrame:
    """Rows of the live features and target, and s0, s1, ...: copies of the given features, each shuffled by itself."""
    def make(block: int, held: list[np.ndarray]):
        copies = [held[i][shuffler(seed, block, k).permutation(len(held[i]))] for k, i in enumerate(shadow_of)]
        yield [*(held[i] for i in live), held[-1], *copies]

    schema = ", ".join(f"{c} double" for c in (*(f"f{i}" for i in live), LABEL, *(f"s{k}" for k in range(len(shadow_of)))))
    return from_blocks(blocks, columns, schema, make)


def boruta(df: DataFrame, roles: Roles, max_iter: int = 100, alpha: float = 0.05, num_trees: int = 100,
           seed: int = 42) -> DataFrame:
    """(feature, hits, decision): features that beat the best shuffled copy more often than chance.

    Kursa & Rudnicki 2010.  Rows get a random position once and are written in random blocks; in each round every copy is
    shuffled in its own way inside the blocks, without a join.  Fewer than five features are copied until there are five copies.
    """
    if not roles.row_id:
        raise ValueError("row_id columns are required")
    names = list(roles.numeric)
    base = shuffle(df.select(*[q(c) for c in dict.fromkeys((*roles.row_id, *names, roles.target))]), roles.row_id, seed)
    rows = base.select(INDEX, *[F.expr(f"{clean_double_sql(c)} AS f{i}") for i, c in enumerate(names)],
                       clean_double(roles.target).alias(LABEL))
    columns = [*(f"f{i}" for i in range(len(names))), LABEL]
    blocks = random_blocks(rows, columns)
    hits = {c: 0 for c in names}
    state = {c: "tentative" for c in names}
    for r in range(1, max_iter + 1):
        live = [i for i, c in enumerate(names) if state[c] != "rejected"]
        if not live or all(v != "tentative" for v in state.values()):
            break
        shadow_of = live if len(live) >= 5 else (live * 5)[:5]
        paired = with_shadows(blocks, columns, live, shadow_of, seed + r)
        inputs = [f"f{i}" for i in live] + [f"s{k}" for k in range(len(shadow_of))]
        made = VectorAssembler(inputCols=inputs, outputCol="__x", handleInvalid="error").transform(paired)
        model = RandomForestRegressor(featuresCol="__x", labelCol=LABEL, numTrees=num_trees, maxDepth=5,
                                      seed=seed + r).fit(made.select("__x", LABEL))
        weights = model.featureImportances.toArray()
        bar = max(weights[len(live):])
        for at, i in enumerate(live):
            hits[names[i]] += int(weights[at] > bar)
        for c in names:
            if state[c] != "tentative":
                continue
            upper, lower = binomial_tails(hits[c], r)
            if upper * len(names) <= alpha:
                state[c] = "confirmed"
            elif lower * len(names) <= alpha:
                state[c] = "rejected"
    discard(blocks)
    rows_out = [(c, hits[c], state[c]) for c in names]
    return df.sparkSession.createDataFrame(rows_out, "feature string, hits int, decision string")


def boruta_select(df: DataFrame, roles: Roles, **options) -> tuple[DataFrame, Roles]:
    """Keep confirmed and tentative features, categoricals and target."""
    kept = {r["feature"] for r in boruta(df, roles, **options).where("decision <> 'rejected'").collect()}
    new = roles.with_features([c for c in roles.features if c in kept or c in roles.categorical])
    wanted = dict.fromkeys((*roles.row_id, *roles.order_by, *new.columns()))
    return df.select(*[q(c) for c in wanted]), new
