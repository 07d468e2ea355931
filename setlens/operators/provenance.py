"""Fingerprints of tables and incremental stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlens.shared import cut


def row_digest(*cols: Column | str) -> Column:
    """SHA-256 of the values joined by the unit separator; null is written as its own symbol."""
    null = F.lit("␀")
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), null) for c in cols]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def table_fingerprint(rows: DataFrame, digest: str, *by: str) -> DataFrame:
    """(by, row_count, fingerprint) of a bag of row digests, in any order of rows.

    Four parts of the digests are summed up, each exactly, and the sums hashed with the number of rows; sums are combined
    before the shuffle, so a bag of any size is a few numbers a task.
    """
    part = lambda k: F.sum(F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("row_count"), F.sha2(F.concat_ws(":", n.cast("string"), *map(part, range(4))), 256).alias("fingerprint"))


def append_missing(store: DataFrame | None, wanted: DataFrame, key: str, build) -> DataFrame:
    """The store with rows built for the wanted keys it lacks; what is there is never built again."""
    missing = wanted if store is None else wanted.join(store.select(key), key, "left_anti")
    built = cut(build(missing.dropDuplicates([key])))
    return built if store is None else store.unionByName(built)
