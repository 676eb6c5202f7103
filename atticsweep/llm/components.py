"""Connected components of links between long keys, by minimum labels that jump ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.operators.lookup import settled
from atticsweep.session import written

# Tables of at most so many bytes (measured) are broadcast, and links of that size are one partition: for them
# exchanges would cost more than the work. Larger ones are dealt out and meet by merge.
FEW_BYTES = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node of its component, for columns ``a`` and ``b``.

    Each round links every node's larger neighbours, then every node, to the smallest
    neighbour it knows; chains halve, so rounds grow with the logarithm of the
    longest. Both halves are aggregations and joins that never gather a node's
    neighbours; each round is written to the shared folder.
    """
    edges = settled(_directed(links), FEW_BYTES)
    few, edges = edges.small, edges.df

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if few else rows

    while True:
        edges = dealt(edges)
        smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(smallest.hint("merge") if few else written(smallest).hint("merge"), "u")
        # Every neighbour learns the smallest node around u; u itself does too.
        ahead = joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u > v")
        behind = smallest.filter("m < u").select("u", F.col("m").alias("v"))
        after = written(dealt(_directed(dealt(ahead.unionByName(behind)).select(F.col("u").alias("a"), F.col("v").alias("b")))))
        # Done when every edge ends in a node without smaller neighbours, and each node has one such end.
        if _settled(dealt(after)):
            return after.filter("u > v").select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                after.filter("v > u").select(F.col("u").alias("node"), F.col("u").alias("comp"))
            ).distinct()
        edges = after


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) with more ``links`` (a, b): only the components that these join are worked out anew. Written."""
    own = settled(comps.select(F.col("node").alias("key_node"), F.col("comp").alias("label")), FEW_BYTES).hinted()
    for c in ("a", "b"):
        links = links.join(own, F.col(c) == F.col("key_node"), "left").withColumn(c, F.coalesce("label", c)).drop("key_node", "label")
    merged = settled(components(links.distinct()), FEW_BYTES)
    changed = merged.df.select(F.col("node").alias("key_comp"), F.col("comp").alias("label"))
    changed = F.broadcast(changed) if merged.small else changed.hint("merge")
    known = comps.join(changed, F.col("comp") == F.col("key_comp"), "left").select("node", F.coalesce("label", "comp").alias("comp"))
    return written(known.unionByName(merged.df.join(own, F.col("node") == F.col("key_node"), "left_anti")))


def _directed(links: DataFrame) -> DataFrame:
    pair = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct()
    return pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether each node has either larger neighbours only, or one neighbour, a smaller one."""
    seen = edges.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    return seen.filter("least < u AND least <> most").isEmpty()
