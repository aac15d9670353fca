"""Connected components of links, by rounds of minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of `links` (a, b): the least node of each component.

    Each round joins the links with the labels, takes the least label by node
    (combined before the shuffle) and jumps to that label's own label; a
    checkpoint ends it. Rounds stop when no label changes: their number grows as
    the logarithm of the longest path. Nothing but one count comes to the driver.
    """
    both = common.checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = common.checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")))
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        least = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("now"))
        of = labels.select(F.col("node").alias("now"), F.col("label").alias("jump"))
        new = common.checkpointed(least.join(of, "now").select("node", "was", F.least("now", "jump").alias("label")))
        changed = new.where("was <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
