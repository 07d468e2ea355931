"""JSON lines, text lists, CSV summaries, safe publication of results, directory listings and file digests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IMAGE_SUFFIXES = r"(?i)\.(jpg|jpeg|png)$"


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines with null fields; with an order, the parts hold rising ranges of it."""
    rows = df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_split_lists(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(sample_id, split, split_pos) from <folder>/<split>.txt; blank lines do not count. Files are read one per split."""
    out = None
    for split in splits:
        lines = spark.read.option("wholetext", "true").text(f"{folder}/{split}.txt")
        ids = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
        one = lines.select(F.posexplode(ids).alias("split_pos", "sample_id")).select("sample_id", F.lit(split).alias("split"), F.col("split_pos").cast("bigint").alias("split_pos"))
        out = one if out is None else out.unionByName(one)
    return out


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, path, size) of the image files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(IMAGE_SUFFIXES)).select(F.regexp_replace(name, r"\.[^.]+$", "").alias("image_id"), "path", "size")


def write_summary(frames: list[DataFrame], path: str) -> None:
    """One CSV whose header is the union of all columns in first-seen order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(path: str, content: str) -> None:
    """The whole file or none of it: written beside its place, then moved there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(content)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def write_document(path: str, value: object) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def publish(results: DataFrame, folder: str, metadata: dict) -> None:
    """Results with their metadata last: readers take a folder without metadata.json as not published."""
    root = Path(folder)
    for stale in ("metrics.json", "metadata.json"):
        (root / stale).unlink(missing_ok=True)
    results.write.mode("overwrite").parquet(str(root / "results.parquet"))
    write_document(str(root / "metadata.json"), metadata)


def read_published(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    meta = Path(folder) / "metadata.json"
    if not meta.exists():
        raise FileNotFoundError(f"{folder} holds no published results")
    return spark.read.parquet(str(Path(folder) / "results.parquet")), json.loads(meta.read_text())


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
