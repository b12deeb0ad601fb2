"""Connected components of a table of links, by hooking to smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.tables import written


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node in edges (a, b): the smallest node reachable. Null ends are
    left out; an empty table gives an empty one. Each round is written to the shared folder, so
    lineage stays short. Rounds grow with the logarithm of a component's diameter."""
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    links = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        seen = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        better = labels.join(seen, labels["node"] == seen["a"]).where("least < label")
        news = better.select("node", "least").unionByName(better.select(F.col("label").alias("node"), "least"))
        news = news.groupBy(F.col("node").alias("to")).agg(F.min("least").alias("least"))
        hooked = written(
            labels.join(news, labels["node"] == news["to"], "left").select(
                "node", F.least("label", F.coalesce("least", "label")).alias("label"), F.col("least").isNotNull().alias("moved")
            )
        )
        if hooked.where("moved").isEmpty():
            return hooked.select("node", F.col("label").alias("component"))
        up = hooked.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        labels = written(hooked.join(up, hooked["label"] == up["mid"]).select("node", F.col("top").alias("label")))
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
