"""Connected components of a record graph by alternating large and small stars.

Every record links its keys to the smallest of them, inside its own row; equal links merge before the shuffle, so a key
of any number of records is one link per distinct neighbour. The rounds then hang each key under the smallest key it can
reach, until a round changes nothing. Minima are combined on the map side; the lookup joins have one row per key on the
build side, and adaptive execution splits the probe side of a hot key. Every round is cut to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlens.shared import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node; links: (a, b). The root is the smallest node of the component."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges.distinct())
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(low, "u").where("v > u AND v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
