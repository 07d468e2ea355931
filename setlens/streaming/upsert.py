"""Keyed upsert of a stream into a table of generations: each micro-batch writes the next one, the state file names the last.

Beyond the batch operators: events with an event time, late ones dropped by a watermark after the window is closed.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from setlens.operators.relational import keyed_upsert
from setlens.sources.files import write_document


class UpsertStore:
    """A table at <folder>/g<batch>, with state.json naming the last whole generation.

    A batch that is given again after a failure is not applied twice.
    """

    def __init__(self, folder: str, key: str, pos: str):
        self.root, self.key, self.pos = Path(folder), key, pos

    def state(self) -> dict:
        f = self.root / "state.json"
        return json.loads(f.read_text()) if f.exists() else {"batch": -1}

    def read(self, spark: SparkSession) -> DataFrame | None:
        batch = self.state()["batch"]
        return None if batch < 0 else spark.read.parquet(str(self.root / f"g{batch}"))

    def apply(self, rows: DataFrame, batch: int) -> None:
        if batch <= self.state()["batch"]:
            return
        spark = rows.sparkSession
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key]), self.pos).alias("v")).select(self.key, "v.*")
        old = self.read(spark)
        merged = latest if old is None else keyed_upsert(old, latest, self.key, self.pos).drop("is_new")
        merged.write.mode("overwrite").parquet(str(self.root / f"g{batch}"))
        write_document(str(self.root / "state.json"), {"batch": batch})


def upsert_stream(stream: DataFrame, store: UpsertStore, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: store.apply(rows, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per kind and tumbling window; rows later than the watermark are dropped."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = t.groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), kind, "n")
