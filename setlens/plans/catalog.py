"""The catalog: cleaned views of the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions.ids import plain_case, plain_identity, plain_image, plain_name, stripped
from setlens.shared import table

CASES = ["INDIVIDUAL", "GROUP", "DUAL", "RELATIONAL"]


def sql_identity(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR regexp_replace({c}, '^\\s+|\\s+$', '', 'g') IN ('', '-1') THEN NULL "
        f"ELSE regexp_replace(regexp_extract({c}, '([0-9]+)', 1), '^0+([0-9])', '\\1') END"
    )


def sql_image(c: str) -> str:
    return f"nullif(regexp_extract({c}, '([0-9]+_[0-9]+)', 1), '')"


def images(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, split, gallery_pos): registered images that stand in the gallery; the split is the first folder."""
    registered = (
        table(spark, d, "images").where(F.col("path").isNotNull()).groupBy(plain_image(F.col("image_id")).alias("image_id"))
        .agg(F.min("path").alias("path"))
    )
    positions = gallery(spark, d)
    return registered.join(positions, "image_id").select("image_id", F.split("path", "/")[0].alias("split"), "gallery_pos")


def gallery(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gallery").select(plain_image(F.col("image_id")).alias("image_id"), "gallery_pos")
    return g.where(F.col("image_id").isNotNull()).groupBy("image_id").agg(F.min("gallery_pos").alias("gallery_pos"))


def image_identity(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, identity_id), distinct."""
    b = table(spark, d, "head_boxes")
    b = b.select(plain_image(F.col("image_id")).alias("image_id"), plain_identity(F.col("identity_id")).alias("identity_id"))
    return b.where("image_id IS NOT NULL AND identity_id IS NOT NULL").distinct()


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(box_id, image_id, identity_id, x, y, width, height) with a possible size, each box once."""
    b = table(spark, d, "head_boxes").where("x >= 0 AND y >= 0 AND width > 0 AND height > 0")
    b = b.select(
        "box_id", plain_image(F.col("image_id")).alias("image_id"), plain_identity(F.col("identity_id")).alias("identity_id"), "x", "y", "width", "height"
    )
    return b.where("image_id IS NOT NULL").distinct()


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample with plain ids; positives in their order without repetition."""
    s = table(spark, d, "samples")
    none = F.array().cast("array<string>")
    return s.dropDuplicates(["sample_id"]).select(
        stripped(F.col("sample_id")).alias("sample_id"),
        plain_case(F.col("case_type")).alias("case_type"),
        plain_image(F.col("query_image_id")).alias("query_image_id"),
        plain_image(F.col("target_image_id")).alias("target_image_id"),
        F.array_distinct(F.array_compact(F.transform(F.coalesce("positive_image_ids", none), plain_image))).alias("positives"),
        F.size(F.array_compact(F.transform(F.coalesce("positive_image_ids", none), plain_image))).alias("positive_refs"),
        "subjects", "final_desc", "final_change", "final_instruction", "annotator",
    )


def required(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, subject_id, identity_id), distinct."""
    one = samples(spark, d).select("sample_id", F.explode("subjects").alias("s"))
    ids = one.select("sample_id", F.col("s.subject_id").alias("subject_id"), F.explode("s.identity_ids").alias("i"))
    ids = ids.select("sample_id", "subject_id", plain_identity(F.col("i")).alias("identity_id"))
    return ids.where(F.col("identity_id").isNotNull()).distinct()


def splits(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, split), distinct, of the three known splits."""
    s = table(spark, d, "sample_splits").select(stripped(F.col("sample_id")).alias("sample_id"), plain_name(F.col("split")).alias("split"))
    return s.where(F.col("split").isin("train", "val", "test")).distinct()


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, query_index, gallery_index, coarse, fine): one row per candidate, best valid scores; the query itself is out.

    Minus infinity is a score; null, NaN and plus infinity are none. Scores are rounded, so that equal ones stay equal.
    """
    valid = lambda c: F.when(~F.isnan(c) & (c != float("inf")), F.round(c.cast("double"), 6) + 0.0)
    r = table(spark, d, "rankings").where("sample_id IS NOT NULL AND gallery_index <> query_index")
    r = r.groupBy("sample_id", "query_index", "gallery_index").agg(
        F.max(valid(F.col("coarse_score"))).alias("coarse"), F.max(valid(F.col("fine_score"))).alias("fine")
    )
    return r.where("coarse IS NOT NULL")


def positives(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, gallery_index): labelled positives by gallery position, without the query image."""
    p = samples(spark, d).select("sample_id", "query_image_id", F.explode("positives").alias("image_id"))
    p = p.where(~F.col("image_id").eqNullSafe(F.col("query_image_id"))).join(gallery(spark, d), "image_id")
    return p.select("sample_id", F.col("gallery_pos").alias("gallery_index")).distinct()


_VALID = "CASE WHEN NOT isnan({c}) AND {c} <> 'infinity'::DOUBLE THEN round({c}::DOUBLE, 6) + 0.0 END"

CTE = {
    "gal": f"""SELECT image_id, min(gallery_pos) AS gallery_pos FROM (SELECT {sql_image('image_id')} AS image_id, gallery_pos FROM gallery)
        WHERE image_id IS NOT NULL GROUP BY image_id""",
    "img": f"""SELECT image_id, split_part(min(path), '/', 1) AS split, any_value(gallery_pos) AS gallery_pos
        FROM (SELECT {sql_image('image_id')} AS image_id, path FROM images WHERE path IS NOT NULL) JOIN gal USING (image_id) GROUP BY image_id""",
    "ii": f"""SELECT DISTINCT * FROM (SELECT {sql_image('image_id')} AS image_id, {sql_identity('identity_id')} AS identity_id FROM head_boxes)
        WHERE image_id IS NOT NULL AND identity_id IS NOT NULL""",
    "box": f"""SELECT DISTINCT box_id, {sql_image('image_id')} AS image_id, {sql_identity('identity_id')} AS identity_id, x, y, width, height
        FROM head_boxes WHERE x >= 0 AND y >= 0 AND width > 0 AND height > 0 AND {sql_image('image_id')} IS NOT NULL""",
    "smp": f"""SELECT DISTINCT ON (sample_id) trim(sample_id) AS sample_id, upper(trim(case_type)) AS case_type,
        {sql_image('query_image_id')} AS query_image_id, {sql_image('target_image_id')} AS target_image_id, positive_image_ids, subjects,
        final_desc, final_change, final_instruction, annotator FROM samples""",
    "pos_at": f"""SELECT sample_id, query_image_id, image_id, min(i) AS i FROM (
        SELECT sample_id, query_image_id, unnest(list_transform(positive_image_ids, lambda x: {sql_image('x')})) AS image_id,
        unnest(range(len(positive_image_ids))) AS i FROM smp) WHERE image_id IS NOT NULL GROUP BY ALL""",
    "req": f"""SELECT DISTINCT sample_id, subject_id, identity_id FROM (
        SELECT sample_id, s.subject_id AS subject_id, {sql_identity('i')} AS identity_id FROM (
        SELECT sample_id, s, unnest(s.identity_ids) AS i FROM (SELECT sample_id, unnest(subjects) AS s FROM smp))) WHERE identity_id IS NOT NULL""",
    "spl": """SELECT DISTINCT regexp_replace(sample_id, '^\\s+|\\s+$', '', 'g') AS sample_id, lower(trim(split)) AS split FROM sample_splits
        WHERE lower(trim(split)) IN ('train', 'val', 'test')""",
    "sco": f"""SELECT * FROM (SELECT sample_id, query_index, gallery_index, max({_VALID.format(c='coarse_score')}) AS coarse,
        max({_VALID.format(c='fine_score')}) AS fine FROM rankings WHERE gallery_index <> query_index AND sample_id IS NOT NULL GROUP BY ALL)
        WHERE coarse IS NOT NULL""",
    "pos": """SELECT DISTINCT sample_id, gallery_pos AS gallery_index FROM pos_at JOIN gal USING (image_id)
        WHERE image_id IS DISTINCT FROM query_image_id""",
}


def with_cte(*names: str, more: str = "") -> str:
    """WITH the named views, in the order that they need; more: further views."""
    parts = [f"{n} AS MATERIALIZED ({sql})" for n, sql in CTE.items() if n in names]
    return "WITH " + ",\n".join([*parts, *([more] if more else [])]) + "\n"
