"""Connected components of links that no driver sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualigraph.llm.common import cut, free


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id that has a link; component is the smallest id reachable.

    Large-star and small-star rounds: each round hangs neighbours under the smallest id near
    them, and the number of rounds grows with the logarithm of the longest chain. Minima are
    aggregated before the shuffle and joined back, so the hub of a hot group is no task's
    whole work. Only a count and a checksum come to the driver. Null ids link nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(edges.where((F.col(a) != F.col(b))).distinct())
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u != v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        free(links.sparkSession)
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
