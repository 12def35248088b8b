"""k-nearest-neighbour regression on the exact block join."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, q
from tabreg.models.base import Fitted, Regressor
from tabreg.operators.neighbors import nearest
from tabreg.operators.order import INDEX, with_row_index
from tabreg.sources.storage import cut_lineage


class FittedNeighbors(Fitted):
    def __init__(self, train, features, options):
        self.train, self.features, self.options = train, list(features), options

    def predict(self, df, name="prediction"):
        o = self.options
        if o["row_id"]:
            tagged, key = df, o["row_id"]
        else:
            key = "__row"
            tagged = cut_lineage(df.withColumn(key, F.monotonically_increasing_id()))
        near = nearest(tagged, self.train, self.features, int(o["n_neighbors"]), key, "__id", payload="__y",
                       metric=int(o["p"]))
        if o["weights"] == "distance":
            # a donor at distance zero decides alone, together with its equals
            w = F.try_divide(F.lit(1.0), F.col("dist"))
            exact = F.max((F.col("dist") == 0).cast("int")) == 1
            value = F.when(exact, F.avg(F.when(F.col("dist") == 0, F.col("value")))).otherwise(
                F.try_divide(F.sum(w * F.col("value")), F.sum(w)))
        elif o["weights"] == "uniform":
            value = F.avg("value")
        else:
            raise ValueError("weights must be uniform or distance")
        made = near.groupBy(F.col("id").alias("__q")).agg(value.alias(name))
        out = tagged.join(made, q(key) == F.col("__q"), "left").drop("__q")
        return out if o["row_id"] else out.drop(key)


class KNeighbors(Regressor):
    """``row_id`` names a unique key of the tables to predict; without it rows are numbered first."""

    defaults = {"n_neighbors": 5, "weights": "uniform", "p": 2, "row_id": None}

    def fit(self, df, features, target):
        names = [q(c) for c in features]
        base = df.select(*names, clean_double(target).alias("__y")).where(F.col("__y").isNotNull())
        if self.params["row_id"]:
            train = df.where(clean_double(target).isNotNull()).select(
                *names, clean_double(target).alias("__y"), q(self.params["row_id"]).alias("__id"))
        else:
            train = with_row_index(base, [*features, "__y"]).withColumnRenamed(INDEX, "__id")
        return FittedNeighbors(cut_lineage(train), features, self.params)
