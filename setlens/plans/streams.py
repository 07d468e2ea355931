"""Streaming counterparts run to the end over the events table, as an extension of the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.shared import ensure_checkpoint_dir, table
from setlens.streaming.upsert import windowed_counts


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts per event type as a stream in append-by-update over the whole table, read back as a table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    counts = windowed_counts(events, "ts", "event_type", "1 day", "2 days")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    latest = out.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return latest.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {"event_windows": event_windows}
ORACLE = {"event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"}
