"""Average precision, hit recall, candidate recall and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positive_ranks(ranked: DataFrame, positives: DataFrame, query: str, item: str, rank: str) -> DataFrame:
    """(query, item, rank, hit): ranks of each query's positives, numbered by rank. Only positives are kept."""
    hits = ranked.select(query, item, rank).join(positives.select(query, item), [query, item])
    return hits.withColumn("hit", F.row_number().over(Window.partitionBy(query).orderBy(rank)).cast("bigint"))


def query_metrics(hits: DataFrame, sizes: DataFrame, query: str, rank: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query with positives: average precision over the whole positive set, and hit recall at each k.

    sizes: (query, n_pos), the whole positive set; a positive that is not ranked adds nothing.
    """
    ap = hits.groupBy(query).agg(
        F.sum(F.col("hit") / F.col(rank)).alias("precision_sum"), *[F.max((F.col(rank) <= k).cast("double")).alias(f"r{k}") for k in ks]
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(ap, query, "left").select(
        query, "n_pos", (zero(F.col("precision_sum")) / F.col("n_pos")).alias("ap"), *[zero(F.col(f"r{k}")).alias(f"r{k}") for k in ks]
    )


def candidate_recall(hits: DataFrame, sizes: DataFrame, query: str, rank: str, k: int) -> DataFrame:
    """Share of each query's positives among the first k candidates, and whether any is."""
    found = hits.groupBy(query).agg(F.count(F.when(F.col(rank) <= k, 1)).alias("found"))
    n = F.coalesce("found", F.lit(0))
    return sizes.join(found, query, "left").select(query, (n / F.col("n_pos")).alias("recall"), (n > 0).cast("double").alias("hit"))


def means(names: list[str]) -> list[Column]:
    return [F.avg(n).alias(n) for n in names]
