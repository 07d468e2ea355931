"""Whitespace-delimited index lines: album, photo, x, y, width, height, identity, flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["album", "photo", "x", "y", "width", "height", "identity_id", "flag"]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_index(spark.read.text(path))


def parse_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """(image_id, identity_id, x, y, width, height); blank lines are skipped, a line without eight fields is an error."""
    parts = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    rows = lines.where(F.trim(column) != "").select(parts.alias("p"))
    # the check is part of the value used, so it cannot be pruned away
    checked = F.when(F.size("p") == len(FIELDS), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not eight fields: "), F.array_join("p", " "))))
    rows = rows.select(checked.alias("p"))
    number = lambda k: F.col("p")[k].cast("int").alias(FIELDS[k])
    return rows.select(F.concat_ws("_", F.col("p")[0], F.col("p")[1]).alias("image_id"), F.col("p")[6].alias("identity_id"), *[number(k) for k in range(2, 6)])
