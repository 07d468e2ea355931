"""Dense ids, votes of label classes, disputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.shared import cut


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers 0, 1, ... in a total order. Rows are range-partitioned and counted, so no task sees more than its range."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # one row a partition
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_i", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def disputed(samples: DataFrame) -> DataFrame:
    """(class_key, image_id, yes, no): images on which the samples of a class differ.

    samples: sample_id, class_key, query_image_id, positives (distinct). Every sample of a class votes on every positive of
    any of them, but not on its own query image. Votes are counted, not listed: the samples that do not name an image vote
    against it, but for those whose query it is.
    """
    sizes = samples.groupBy("class_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # one sample disputes nothing
    named = samples.select("class_key", "query_image_id", F.explode("positives").alias("image_id"))
    own = F.col("image_id").eqNullSafe(F.col("query_image_id"))
    yes = named.groupBy("class_key", "image_id").agg(F.count(F.when(~own, 1)).alias("yes"), F.count(F.when(own, 1)).alias("own"))
    asked = samples.where("query_image_id IS NOT NULL").groupBy("class_key", F.col("query_image_id").alias("image_id")).agg(F.count(F.lit(1)).alias("asked"))
    votes = yes.join(sizes, "class_key").join(asked, ["class_key", "image_id"], "left")
    votes = votes.withColumn("no", F.col("n") - F.col("yes") - F.coalesce("asked", F.lit(0)))
    return votes.where("yes > 0 AND no > 0").select("class_key", "image_id", "yes", "no")


def running_total(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over the rows before each one in its group's order.

    Rows are range-partitioned by group and order; a group of any size is spread over the ranges, and only one sum per
    group and range goes through a window of its own.
    """
    ranged = df.withColumn("_v", value).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    sums = ranged.groupBy(group, "_part").agg(F.sum("_v").alias("_s"))
    starts = sums.withColumn("_start", F.sum("_s").over(Window.partitionBy(group).orderBy("_part")) - F.col("_s")).drop("_s")
    upto = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumn("_w", F.sum("_v").over(upto) - F.col("_v"))
    return within.join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_w")).drop("_v", "_part", "_w", "_start")
