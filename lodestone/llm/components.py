"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the smallest node it reaches.

    Each round points every node to its smallest neighbour, follows the pointers to their end by doubling, and contracts the links;
    rounds grow with the logarithm of a component's size.
    """
    spark = links.sparkSession
    edges = scratch.saved(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = scratch.saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    for _ in range(most_rounds):
        if edges.isEmpty():
            return labels
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # partial aggregation before the shuffle keeps a hub's links apart
        up = scratch.saved(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")), "pointers")
        while True:
            far = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
            new = scratch.saved(up.join(far, "p", "left").select("node", F.coalesce("q", "p").alias("q"), (F.coalesce("q", "p") != F.col("p")).alias("moved"), F.lit(0).alias("z")), "pointers")
            up = new.select("node", F.col("q").alias("p"))
            if new.where("moved").isEmpty():
                break
        pa, pb = up.select(F.col("node").alias("a"), F.col("p").alias("pa")), up.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        edges = scratch.saved(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        labels = scratch.saved(labels.join(up.select(F.col("node").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
    raise RuntimeError("the components didn't settle")
