"""Connected components of an undirected graph, by tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, label): for each node of an edge the smallest node of its component.

    In a round each node takes the smallest label among its own and its neighbours', and
    then the label of that label, so long chains shorten quickly.  Each round is written;
    a lost executor repeats one at most.
    """
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    now = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(now.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = now.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        next_ = now.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = written(low.join(next_, "low").select("node", "label", F.least("low", "further").alias("new")), "labels")
        settled = new.where("new <> label").isEmpty()
        now = new.select("node", F.col("new").alias("label"))
        if settled:
            return now
    raise RuntimeError("components did not settle")
