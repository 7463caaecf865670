"""Connected components of a link table, by contraction in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of links(a, b); links with a null or to themselves play no part.

    In each round every node joins the smallest of its neighbours, and links are
    redrawn between what is left, so that at least half of the nodes with links go.
    """
    spark = links.sparkSession
    one = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(one.distinct(), "links")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "moves")
        ends = to.select(F.col("a").alias("end"), "to")
        moved = edges.join(ends.withColumnsRenamed({"end": "a", "to": "x"}), "a").join(ends.withColumnsRenamed({"end": "b", "to": "y"}), "b")
        rest = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fresh = labels.join(ends.withColumnRenamed("end", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        old = [edges, labels, to]
        edges, labels = stored(rest, "links"), stored(fresh, "labels")
        for df in old:
            dropped(spark, df)
    return labels
