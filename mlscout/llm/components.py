"""Connected components of a link table by label contraction; nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is its smallest node.

    Each round points every node at the smallest node it or its neighbours know, then follows
    the pointers (label doubling), so the rounds grow with the logarithm of the longest chain.
    Labels are aggregated before the shuffle, which keeps a node with very many links small.
    """
    edges = links.select(F.col(links.columns[0]).alias("a"), F.col(links.columns[1]).alias("b"))
    both = stored(
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("c")), "labels")
    while True:
        heard = both.join(label.toDF("b", "cb"), "b").groupBy("a").agg(F.min("cb").alias("n"))
        own = label.join(heard, "a").withColumn("n", F.least("c", "n"))
        # the label of the label
        step = own.alias("o").join(
            label.toDF("k", "kc"), F.col("o.n") == F.col("k"), "left"
        ).select("a", "c", F.least("n", F.coalesce("kc", "n")).alias("n"))
        step = stored(step, "labels")
        changed = step.filter("n <> c").limit(1).count()
        label = step.select("a", F.col("n").alias("c"))
        if not changed:
            return label.toDF("node", "component")
