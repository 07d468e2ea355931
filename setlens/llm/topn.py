"""Top N items of every group by descending score bands.

One pass over all rows finds score quantiles, which split the range into bands, and the few groups that hold a large
share of the rows; a second one writes each row into its band. From the top band down, each read once, rows of groups that are not yet filled
are reduced to one best score per (group, item); items already placed and groups already filled are taken out by anti
joins; the rest is ranked exactly (score descending, item ascending), which also settles ties on the band's border. A
band only holds scores below all earlier bands, so its ranks follow those already given. Ranking goes through a limit
per group and input partition (WindowGroupLimit), so a group of any size reaches one task with at most N rows from each
partition.

Defined cases: null, NaN and +infinity are not scores, -infinity is the lowest one; -0.0 equals 0.0; rows without group
or item take no part; repeated items count once, with their best score; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.shared import cut, written

BAND_SHARES = (0.125, 0.5)  # share of rows at or above the border of each band but the last
HOT = 1_000  # a group with more than a thousandth of the rows is hot, so there are as many at most


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, band_shares: tuple = BAND_SHARES) -> DataFrame:
    """(group, item, score, rank_no) of the n best items of each group."""
    s = F.col(score).cast("double")
    base = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s) & (s != float("inf")))
    base = base.select(F.col(group).alias("g"), F.col(item).alias("i"), (s + F.lit(0.0)).alias("s"))

    borders, total, often = base.agg(
        F.percentile_approx("s", [1.0 - x for x in band_shares], 1000) if band_shares else F.lit(None),
        F.count(F.lit(1)), F.call_function("approx_top_k", "g", F.lit(HOT), F.lit(16 * HOT)),
    ).first()
    borders = sorted({b for b in borders or [] if b > float("-inf")}, reverse=True)
    hot = {r["item"] for r in often or [] if r["count"] > max(10_000, total / HOT)}  # HOT at most
    band_of = F.lit(len(borders))
    for k, low in reversed(list(enumerate(borders))):
        band_of = F.when(F.col("s") >= low, F.lit(k)).otherwise(band_of)
    bands = written(base.withColumn("band", band_of), "band")

    placed: DataFrame | None = None
    for k in range(len(borders) + 1):
        band = bands.where(F.col("band") == k).drop("band")
        if placed is not None:
            count = placed.groupBy("g").agg(F.count(F.lit(1)).alias("placed"))
            filled = count.where(F.col("placed") >= n).select("g")
            if hot:  # rows of hot groups that are filled leave before any shuffle
                done = [r["g"] for r in filled.where(F.col("g").isin(*hot)).collect()]
                band = band.where(~F.col("g").isin(*done)) if done else band
            band = band.join(filled, "g", "left_anti")
        best = band.groupBy("g", "i").agg(F.max("s").alias("s"))
        if placed is not None:
            best = best.join(placed.select("g", "i"), ["g", "i"], "left_anti")
        order = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
        ranked = best.withColumn("rank_no", F.row_number().over(order).cast("bigint")).where(F.col("rank_no") <= n)
        if placed is not None:
            ranked = (
                ranked.join(count, "g", "left")
                .withColumn("rank_no", F.col("rank_no") + F.coalesce("placed", F.lit(0)))
                .where(F.col("rank_no") <= n)
                .drop("placed")
                .unionByName(placed)
            )
        placed = ranked if k == len(borders) else cut(ranked)
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank_no")
