"""Complete rankings, population z-scores, fusion, shortlists and reranking with a fixed tail.

Scores are minus infinity for "no evidence", which ranks last but is ranked; NaN and plus infinity are errors and have
to be taken out before. A query's candidates are its scope of the gallery, however many they are: complete ranks are
counted over ranges of scores and moments are aggregated, so that no task sorts a whole query. Windows per query are
for shortlists, whose length is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.operators.audit import running_total

NONE = float("-inf")
FLOOR = 1e-6


def complete_ranks(df: DataFrame, query: str, score: str, tie: str, name: str) -> DataFrame:
    """df with name: 1, 2, ... by score falling, then tie rising, of every candidate of each query; ties must be distinct."""
    down = df.withColumn("_down", -F.col(score))
    counted = running_total(down, query, ["_down", tie], F.lit(1).cast("bigint"), "_before")
    return counted.withColumn(name, F.col("_before") + 1).drop("_before", "_down")


def complete_rank(query: str, score: str | Column, tie: str) -> Column:
    """The rank in a list whose length is bounded, or of which only the first ranks are kept."""
    score = F.col(score) if isinstance(score, str) else score
    return F.row_number().over(Window.partitionBy(query).orderBy(score.desc(), F.col(tie).asc())).cast("bigint")


def zscore(x: Column, valid: Column, *by: str) -> Column:
    """(x - mean) / max(population deviation, 1e-6) over the valid rows of a query; a constant is 0; other rows null."""
    w = Window.partitionBy(*by)
    v = F.when(valid, x)
    low, high = F.min(v).over(w), F.max(v).over(w)
    z = (x - F.avg(v).over(w)) / F.greatest(F.stddev_pop(v).over(w), F.lit(FLOOR))
    return F.when(valid, F.when(low == high, F.lit(0.0)).otherwise(z))


def moments_zscore(df: DataFrame, x: Column, valid: Column, by: str, name: str) -> DataFrame:
    """df with name: zscore() over queries of any size, from moments that are combined before they are shuffled."""
    v = F.when(valid, x)
    m = df.groupBy(by).agg(F.min(v).alias("_low"), F.max(v).alias("_high"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_dev"))
    z = F.when(F.col("_low") == F.col("_high"), F.lit(0.0)).otherwise((x - F.col("_mean")) / F.greatest("_dev", F.lit(FLOOR)))
    return df.join(m, by).withColumn(name, F.when(valid, z)).drop("_low", "_high", "_mean", "_dev")


def shortlist(df: DataFrame, m: int, query: str, score: str, tie: str, name: str = "coarse_rank") -> DataFrame:
    """The first m of each query with their rank; each group is limited before the shuffle."""
    return df.withColumn(name, complete_rank(query, score, tie)).where(F.col(name) <= m)


def fuse(fine: Column, coarse: Column, weight: float | Column, *by: str) -> Column:
    """z(fine) + weight z(coarse) over candidates with a finite coarse score; others minus infinity. Weight 0 keeps fine as it is."""
    valid = coarse > NONE
    fused = zscore(fine, valid, *by) + weight * zscore(coarse, valid, *by)
    fused = F.when(valid, fused).otherwise(F.lit(NONE))
    if isinstance(weight, Column):
        return F.when(weight == 0, fine).otherwise(fused)
    return fine if weight == 0 else fused


def rerank_head(query: str, score: str, m: int, rank: str = "coarse_rank") -> Column:
    """Final rank: the first m by score, equal ones in their old order; all others keep their rank."""
    head = F.col(rank) <= m
    w = Window.partitionBy(query, head).orderBy(F.col(score).desc(), F.col(rank).asc())
    return F.when(head, F.row_number().over(w).cast("bigint")).otherwise(F.col(rank))
