"""Connected components of a link table by alternating large and small stars, every round written to the shared folder.

Only minima per node are aggregated (with map-side combine) and joined back; no task holds the neighbours of a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modiste.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) but the roots themselves; a root is the smallest node of its component."""
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges, before = stored(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        both = edges.select(F.col("lo").alias("node"), "hi", "lo").union(edges.select(F.col("hi"), F.col("hi"), F.col("lo")))
        least = stored(both.groupBy("node").agg(F.min("lo").alias("least")), "least")
        edges = stored(edges.join(least, edges["lo"] == least["node"]).select("hi", F.col("least").alias("lo")).distinct(), "large-star")
        least = stored(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "least")
        met = edges.join(least, edges["hi"] == least["node"]).where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        edges = stored(met.union(least.select("node", "least")).distinct(), "small-star")
