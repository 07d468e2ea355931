"""Forward values of training objectives as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.functions.vectors import cosine, softplus


def _two_level(pairs: DataFrame, query: str, value: Column) -> DataFrame:
    per = pairs.groupBy(query).agg(F.avg(value).alias("x"))
    return per.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("value"), F.count(F.lit(1)).alias("queries"))


def score_pairs(scored: DataFrame, query: str, score: str, positive: str) -> DataFrame:
    """(query, p, n): every positive with every eligible negative of its query; only finite scores count.

    Made for candidate rows of a fixed size; give it a shortlist, not a whole ranking.
    """
    ok = scored.where(F.abs(F.col(score)) < float("inf"))
    pos = ok.where(F.col(positive)).select(query, F.col(score).alias("p"))
    neg = ok.where(~F.col(positive)).select(query, F.col(score).alias("n"))
    return pos.join(neg, query)


def pairwise_softplus(pairs: DataFrame, query: str, temperature: float) -> DataFrame:
    """Mean over queries of the mean softplus((n - p) / temperature); queries without pairs do not count."""
    return _two_level(pairs, query, softplus((F.col("n") - F.col("p")) / temperature))


def rejection_hinge(pairs: DataFrame, query: str, temperature: float) -> DataFrame:
    """Mean hinge over pairs, then queries: what the context adds to a negative may not exceed the positive's base margin.

    pairs: query, base_p, base_n, context_p, context_n; a margin below zero counts as zero.
    """
    margin = F.greatest(F.col("base_p") - F.col("base_n"), F.lit(0.0))
    over = F.col("context_n") - F.col("context_p") - margin
    return _two_level(pairs, query, F.greatest(over, F.lit(0.0)) / temperature)


def pair_error(scored: DataFrame, query: str, score: str, positive: str) -> DataFrame:
    """Share of (positive, negative) pairs ranked wrong or tied, over queries; counted by windows, without making pairs."""
    ok = scored.where(F.abs(F.col(score)) < float("inf")).withColumn("neg", (~F.col(positive)).cast("bigint"))
    at_least = Window.partitionBy(query).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ok.withColumn("above", F.sum("neg").over(at_least)).withColumn("all", F.sum("neg").over(Window.partitionBy(query)))
    return _two_level(counted.where(F.col(positive) & (F.col("all") > 0)), query, F.col("above") / F.col("all"))


def contrastive(anchors: DataFrame, temperature: float) -> DataFrame:
    """Supervised contrastive loss. anchors: block, id, label, vec; others of the block are the candidates.

    An anchor without another of its label does not count.
    """
    a = anchors.select("block", F.col("id").alias("a"), F.col("label").alias("la"), F.col("vec").alias("va"))
    b = anchors.select("block", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("vec").alias("vb"))
    sims = a.join(b, "block").where("a <> b").select("block", "a", (F.col("la") == F.col("lb")).alias("same"), (F.round(cosine(F.col("va"), F.col("vb")), 9) / temperature).alias("s"))
    top = sims.groupBy("block", "a").agg(F.max("s").alias("top"), F.count(F.when(F.col("same"), 1)).alias("n")).where("n > 0")
    per = sims.join(top, ["block", "a"]).groupBy("block", "a").agg(
        (F.max("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top")))) - F.avg(F.when(F.col("same"), F.col("s")))).alias("loss")
    )
    return per.agg(F.avg("loss").alias("value"), F.count(F.lit(1)).alias("anchors"))


def balanced_bce(cells: DataFrame, query: str, subject: str) -> DataFrame:
    """Grounding loss: inside and outside weigh the same per subject, then mean over subjects, then over queries.

    cells: query, subject, logit, inside.
    """
    loss = F.when(F.col("inside"), softplus(-F.col("logit"))).otherwise(softplus(F.col("logit")))
    per = cells.groupBy(query, subject).agg(F.avg(F.when(F.col("inside"), loss)).alias("i"), F.avg(F.when(~F.col("inside"), loss)).alias("o"))
    both = F.when(F.col("i").isNull(), F.col("o")).when(F.col("o").isNull(), F.col("i")).otherwise((F.col("i") + F.col("o")) / 2)
    return _two_level(per, query, both)


def correspondence(pairs: DataFrame) -> DataFrame:
    """Crop correspondence: mean over an anchor's images, a query's anchors, then queries. pairs: query, anchor, loss."""
    anchor = pairs.groupBy("query", "anchor").agg(F.avg("loss").alias("x"))
    query = anchor.groupBy("query").agg(F.avg("x").alias("x"))
    return query.agg(F.avg("x").alias("value"), F.count(F.lit(1)).alias("queries"))


def correspondence_losses(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loss) of each anchor and image: log of the summed exponentials of all scores, less the mean of the right ones.

    scores: keys, s, right; where nothing is right there is no loss.
    """
    top = scores.groupBy(*keys).agg(F.max("s").alias("top"), F.avg(F.when(F.col("right"), F.col("s"))).alias("hit")).where("hit IS NOT NULL")
    sums = scores.join(top, keys).groupBy(*keys, "top", "hit").agg(F.sum(F.exp(F.col("s") - F.col("top"))).alias("mass"))
    return sums.select(*keys, (F.col("top") + F.log("mass") - F.col("hit")).alias("loss"))
