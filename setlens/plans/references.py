"""Queries of problem 2: orphan references of gallery, head_boxes and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions.ids import plain_identity, plain_image
from setlens.operators.references import orphan_references, orphan_report
from setlens.shared import table


def reference_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def refs(df: DataFrame, src: str, kind: str, record: str, key, time: str) -> DataFrame:
        return df.select(
            F.lit(src).alias("src_table"),
            F.lit(kind).alias("kind"),
            F.col(record).cast("string").alias("record_key"),
            key.alias("ref_key"),
            F.col(time).alias("ref_time"),
        )

    samples = table(spark, d, "samples").select(
        "sample_id", "created_at", F.explode("candidate_identity_ids").alias("identity_id")
    )
    all_refs = (
        refs(table(spark, d, "gallery"), "gallery", "image", "gallery_pos", plain_image(F.col("image_id")), "added_at")
        .unionByName(
            refs(table(spark, d, "head_boxes"), "head_boxes", "identity", "box_id", plain_identity(F.col("identity_id")), "created_at")
        )
        .unionByName(refs(samples, "samples", "identity", "sample_id", plain_identity(F.col("identity_id")), "created_at"))
    )

    def parents(name: str, kind: str, key) -> DataFrame:
        return table(spark, d, name).select(
            F.lit(kind).alias("kind"),
            key.alias("key"),
            F.col("registered_at").alias("valid_from"),
            F.col("deleted_at").alias("valid_to"),
        )

    both = parents("images", "image", plain_image(F.col("image_id"))).unionByName(
        parents("identities", "identity", plain_identity(F.col("identity_id")))
    )
    return all_refs, both


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*reference_tables(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p2_found(spark, d))


_IDENTITY = """CASE WHEN {c} IS NULL OR regexp_replace({c}, '^\\s+|\\s+$', '', 'g') IN ('', '-1') THEN NULL
  ELSE regexp_replace(regexp_extract({c}, '([0-9]+)', 1), '^0+([0-9])', '\\1') END"""
_IMAGE = "nullif(regexp_extract({c}, '([0-9]+_[0-9]+)', 1), '')"

_ORPHANS = f"""
WITH refs AS (
  SELECT 'gallery' AS src_table, 'image' AS kind, CAST(gallery_pos AS VARCHAR) AS record_key,
         {_IMAGE.format(c='image_id')} AS ref_key, added_at AS t FROM gallery
  UNION SELECT 'head_boxes', 'identity', box_id, {_IDENTITY.format(c='identity_id')}, created_at FROM head_boxes
  UNION SELECT 'samples', 'identity', sample_id, {_IDENTITY.format(c='i')}, created_at
        FROM (SELECT sample_id, created_at, unnest(candidate_identity_ids) AS i FROM samples)),
parents AS (
  SELECT 'image' AS kind, {_IMAGE.format(c='image_id')} AS k, registered_at AS a, deleted_at AS b FROM images
  UNION SELECT 'identity', {_IDENTITY.format(c='identity_id')}, registered_at, deleted_at FROM identities),
orphans AS (
  SELECT DISTINCT src_table, strftime(t, '%Y-%m') AS ref_month, record_key, ref_key FROM refs
  WHERE ref_key IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.kind = refs.kind AND p.k = refs.ref_key AND p.a <= refs.t AND (p.b IS NULL OR refs.t < p.b)))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLE = {
    "p2_found": _ORPHANS + "SELECT * FROM orphans",
    "p2_report": _ORPHANS
    + """SELECT src_table, ref_month, count(*) AS orphan_refs, count(DISTINCT ref_key) AS missing_keys
         FROM orphans GROUP BY src_table, ref_month""",
}
