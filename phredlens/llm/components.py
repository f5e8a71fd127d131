"""Connected components over a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.tables import stage, unstage


def connected(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over ``links`` (a long, b long). Nodes without a link are none.

    Every node points to a smaller node, at last to its component's smallest. In each round a node takes the smallest
    grandparent among its neighbours, for itself and for the node it points to, so whole trees are hooked at once, and
    then points to its own grandparent: rounds grow with the logarithm of a component's size. Labels are staged every
    round and the round before is deleted; nothing but one flag comes to the driver. Repeated links and links of a
    node to itself change nothing; rows with a null are no links.
    """
    links = links.where("a is not null and b is not null")
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        grand = labels.join(up, "label").select("node", "label", "grand")
        near = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        seen = grand.join(near, "node").select("node", "label", F.least("grand", "near").alias("low"))
        offers = seen.select("node", F.col("low").alias("label"), F.col("label").alias("old")).unionByName(seen.select(F.col("label").alias("node"), F.col("low").alias("label"), F.lit(None).cast("long").alias("old")))
        fresh = stage(offers.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        settled = fresh.where("old <> label").isEmpty()
        unstage(labels)
        labels = fresh
        if settled:
            unstage(both)
            return labels.select("node", "label")
