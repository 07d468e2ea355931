"""Fingerprints, benchmark metadata and feature keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions import texts as t
from setlens.operators import provenance as p
from setlens.plans import catalog as c
from setlens.plans.catalog import with_cte
from setlens.shared import table


def split_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """What a model of each split is selected on: its samples with texts and labels inside the split, its gallery in order, and the heads on it."""
    i = c.images(spark, d)
    paths = table(spark, d, "images").where("path IS NOT NULL").groupBy(c.plain_image(F.col("image_id")).alias("image_id")).agg(F.min("path").alias("path"))
    images = i.join(paths, "image_id").select("split", p.row_digest(F.lit("image"), "image_id", "path", "gallery_pos").alias("digest"))
    heads = c.boxes(spark, d).join(i.select("image_id", "split"), "image_id")
    heads = heads.select("split", p.row_digest(F.lit("head"), "image_id", "box_id", "identity_id", "x", "y", "width", "height").alias("digest"))
    s = c.samples(spark, d).join(c.splits(spark, d), "sample_id")
    inside = s.select("sample_id", "split", F.posexplode("positives").alias("i", "image_id")).join(i.select("image_id", "split"), ["image_id", "split"], "left_semi")
    inside = inside.groupBy("sample_id", "split").agg(F.array_sort(F.collect_list(F.struct("i", "image_id"))).alias("p"))
    who = F.array_join(F.transform("subjects", lambda x: F.concat_ws(":", x["subject_id"].cast("string"), F.array_join(x["identity_ids"], "+", "-"))), ";")
    labels = F.coalesce(F.array_join("p.image_id", ","), F.lit(""))
    fields = ["sample_id", "case_type", "query_image_id", "target_image_id", labels, who, "final_desc", "final_change", "final_instruction"]
    samples = s.join(inside, ["sample_id", "split"], "left").select("split", p.row_digest(F.lit("sample"), *fields).alias("digest"))
    return p.table_fingerprint(images.unionByName(heads).unionByName(samples), "digest", "split")


def benchmark_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Samples per case, with zero for absent ones."""
    every = spark.createDataFrame([(x,) for x in c.CASES], "case_type string")
    counts = c.samples(spark, d).groupBy("case_type").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counts), "case_type", "left").select("case_type", F.coalesce("n", F.lit(0)).alias("samples"))


def condition_keys(spark: SparkSession, d: str) -> DataFrame:
    """One feature per (query image, condition): its key and how many (sample, subject) share it."""
    s = c.samples(spark, d).select("sample_id", "query_image_id", "final_change", F.explode("subjects.subject_id").alias("subject_id")).distinct()
    s = s.withColumn("key", p.row_digest("query_image_id", t.condition(F.col("final_change"), F.col("subject_id"))))
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))


def incremental_store(spark: SparkSession, d: str) -> DataFrame:
    """A store of box counts per image, first for one half of the gallery, then completed; each image is built once."""
    b = c.boxes(spark, d)
    build = lambda keys: keys.select("image_id").join(b, "image_id", "left").groupBy("image_id").agg(F.count("box_id").alias("boxes"))
    g = c.gallery(spark, d)
    store = p.append_missing(None, g.where("gallery_pos % 2 = 0"), "image_id", build)
    return p.append_missing(store, g, "image_id", build)


QUERIES = {f.__name__: f for f in (split_fingerprint, benchmark_metadata, condition_keys, incremental_store)}

from setlens.plans.texts import _COND  # noqa: E402

_digest = lambda *x: " || chr(31) || ".join(f"coalesce(({y})::VARCHAR, chr(9216))" for y in x)
_PEOPLE = "array_to_string(list_transform(subjects, lambda s: s.subject_id::VARCHAR || ':' || array_to_string(list_transform(s.identity_ids, lambda y: coalesce(y, '-')), '+')), ';')"
_SUMS = ", ".join(f"sum(('0x' || substr(dg, {15 * k + 1}, 15))::BIGINT)::VARCHAR" for k in range(4))
ORACLE = {
    "split_fingerprint": with_cte("gal", "img", "box", "smp", "pos_at", "spl") + f""", path AS (SELECT {c.sql_image('image_id')} AS image_id, min(path) AS path FROM images WHERE path IS NOT NULL GROUP BY 1),
        inside AS (SELECT p.sample_id, i.split, string_agg(p.image_id, ',' ORDER BY p.i) AS labels FROM pos_at p JOIN spl USING (sample_id) JOIN img i ON i.image_id = p.image_id AND i.split = spl.split GROUP BY ALL),
        r AS (SELECT split, sha256({_digest("'image'", 'image_id', 'path', 'gallery_pos')}) AS dg FROM img JOIN path USING (image_id)
          UNION ALL SELECT split, sha256({_digest("'head'", 'image_id', 'box_id', 'identity_id', 'x', 'y', 'width', 'height')}) FROM box JOIN img USING (image_id)
          UNION ALL SELECT spl.split, sha256({_digest("'sample'", 's.sample_id', 'case_type', 'query_image_id', 'target_image_id', "coalesce(labels, '')", _PEOPLE, 'final_desc', 'final_change', 'final_instruction')})
            FROM smp s JOIN spl USING (sample_id) LEFT JOIN inside i ON i.sample_id = s.sample_id AND i.split = spl.split)
        SELECT split, count(*) AS row_count, sha256(concat_ws(':', count(*), {_SUMS})) AS fingerprint FROM r GROUP BY split""",
    "benchmark_metadata": with_cte("smp") + """SELECT case_type, count(smp.sample_id) AS samples FROM (VALUES ('INDIVIDUAL'), ('GROUP'), ('DUAL'), ('RELATIONAL')) t(case_type)
        LEFT JOIN smp USING (case_type) GROUP BY case_type""",
    "condition_keys": with_cte("smp", more="one AS (SELECT DISTINCT sample_id, query_image_id, final_change, unnest(subjects).subject_id AS subject_id FROM smp)")
    + f", {_COND} SELECT sha256(coalesce(query_image_id, chr(9216)) || chr(31) || coalesce(condition, chr(9216))) AS key, count(*) AS uses FROM cond GROUP BY 1",
    "incremental_store": with_cte("gal", "box") + "SELECT image_id, count(box_id) AS boxes FROM gal LEFT JOIN box USING (image_id) GROUP BY image_id",
}
