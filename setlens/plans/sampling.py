"""Sampling over samples, rankings, head_boxes and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.operators import sampling as s
from setlens.plans import catalog as c
from setlens.plans import dataset, matching, retrieval
from setlens.plans.catalog import with_cte
from setlens.shared import cut, unit_hash

SIZE = 16  # candidates of a row


def derive_seed(spark: SparkSession, d: str) -> DataFrame:
    i = F.substring("sample_id", -6, 6).cast("bigint")
    return c.samples(spark, d).select("sample_id", s.derive_seed(17, "mining", i).alias("seed"))


def case_rows(spark: SparkSession, d: str) -> DataFrame:
    return c.samples(spark, d).where(F.col("case_type").isin(*c.CASES)).select("sample_id", "case_type")


def case_balanced_epoch(spark: SparkSession, d: str) -> DataFrame:
    return s.balanced_draws(case_rows(spark, d), "sample_id", "case_type", "epoch").select("draw", "sample_id", "case_type")


def uniform_negatives(spark: SparkSession, d: str) -> DataFrame:
    pool = c.scored(spark, d).select("sample_id", "gallery_index")
    return s.uniform_without(pool, c.positives(spark, d), "sample_id", "gallery_index", 8, "negatives").select("sample_id", "gallery_index", "draw_pos")


def candidate_quota(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every ranked query: positives, same-identity and hard images, partial matches, then random ones.

    A row of SIZE takes from each tier by its own order and leaves out at most what it holds already, so the first SIZE of a
    drawn tier, twice as many of a hard one (drawn from the 2n hardest), and all partial matches give the row of whole pools.
    """
    ranked = retrieval.coarse_ranked(spark, d).select("sample_id", "query_index", "gallery_index", "coarse_rank")
    at = c.image_identity(spark, d).join(c.gallery(spark, d), "image_id").groupBy(F.col("gallery_pos").alias("gallery_index")).agg(F.collect_set("identity_id").alias("has"))
    req = c.required(spark, d).groupBy("sample_id", F.col("subject_id").alias("subject")).agg(F.array_sort(F.collect_set("identity_id")).alias("keys"))
    req = req.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("subject", "keys"))).alias("subjects"))
    pos = c.positives(spark, d).withColumn("positive", F.lit(True))
    r = ranked.join(at, "gallery_index", "left").join(pos, ["sample_id", "gallery_index"], "left").join(req, "sample_id")
    every = F.array_distinct(F.flatten("subjects.keys"))
    r = r.withColumn("have", F.coalesce(F.array_intersect(every, "has"), F.array().cast("array<string>"))).drop("has")
    r = r.withColumn("kind", F.when(F.col("positive"), "positives").when(F.size("have") > 0, "identity").otherwise("hard"))
    key = lambda tier: F.sha2(F.concat_ws(":", "query_index", tier, "gallery_index"), 256)  # noqa: E731  as candidate_row draws
    place = lambda by, *order: F.row_number().over(Window.partitionBy("sample_id", by).orderBy(*order))
    negative = F.col("kind") != "positives"
    r = r.withColumn("drawn", place("kind", key(F.when(negative, "same_identity").otherwise("p")), "gallery_index"))
    r = r.withColumn("hardest", place("kind", "coarse_rank")).withColumn("f", place("positive", key(F.lit("random")), "gallery_index"))
    is_partial = negative & (F.size("have") > 0) & (F.size("have") < F.size(every))
    gone = F.filter("subjects", lambda x: ~F.arrays_overlap(x["keys"], F.col("have")))
    partial = F.struct(
        F.col("gallery_index").alias("item"), F.array_sort(F.array_except(every, "have")).alias("missing"),
        F.transform(gone, lambda x: (x["subject"] - 1).cast("int")).alias("slots"), F.size("have").alias("overlap"),
    )
    tiers = {
        "positives": (~negative & (F.col("drawn") <= SIZE), "drawn"),
        # one more than a row tells whether the pool is larger than any quota
        "identity": ((F.col("kind") == "identity") & ((F.col("drawn") <= SIZE + 1) | (F.col("hardest") <= 2 * SIZE)), "hardest"),
        "hard": ((F.col("kind") == "hard") & (F.col("hardest") <= 2 * SIZE), "hardest"),
        "fill": (negative & (F.col("f") <= SIZE), "f"),
    }
    of = lambda name, when, order: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(order, "gallery_index")))), lambda y: y["gallery_index"]).alias(name)
    pools = r.groupBy("sample_id", "query_index").agg(
        *[of(name, *x) for name, x in tiers.items()], F.collect_list(F.when(is_partial, partial)).alias("partial"), F.first("subjects.keys").alias("slots")
    )
    return s.candidate_rows(pools.withColumn("semantic", F.col("identity")), size=SIZE)


def identity_crops(spark: SparkSession, d: str) -> DataFrame:
    """For every identity in two images or more, two boxes in different images by random key."""
    b = c.boxes(spark, d).where("identity_id IS NOT NULL").groupBy("identity_id", "image_id").agg(F.min("box_id").alias("box_id"))
    many = b.groupBy("identity_id").agg(F.count(F.lit(1)).alias("images")).where("images >= 2").select("identity_id")
    order = Window.partitionBy("identity_id").orderBy(unit_hash("crop", F.col("identity_id"), F.col("image_id")), "image_id")
    drawn = b.join(many, "identity_id", "left_semi").withColumn("crop_pos", F.row_number().over(order).cast("bigint")).where("crop_pos <= 2")
    return drawn.select("identity_id", "image_id", "box_id", "crop_pos")


def hard_crops(spark: SparkSession, d: str) -> DataFrame:
    """Of the persons in a query's shortlist, the three most like any person of its query image, identities of the query left out."""
    p = cut(matching.persons(spark, d))
    q = cut(matching.query_persons(spark, d).select("sample_id", "vec", "norm"))
    there = p.select("gallery_index").distinct().join(dataset.indexed_sets(spark, d), "gallery_index", "left")
    # each pair is tested by what its image holds: all images with a popular identity are never listed
    pairs = matching.short(spark, d).join(q.select("sample_id").distinct(), "sample_id", "left_semi").join(dataset.wanted(spark, d), "sample_id").join(there, "gallery_index")
    pairs = pairs.where(~F.coalesce(F.arrays_overlap("wants", "has"), F.lit(False))).select("sample_id", "gallery_index")
    pairs = pairs.join(p.select("gallery_index", "person_id", F.col("vec").alias("t_vec"), F.col("norm").alias("t_norm")), "gallery_index").join(q, "sample_id")
    hardness = pairs.groupBy("sample_id", "person_id").agg(F.max(matching.similarity()).alias("hardness"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("hardness"), "person_id")
    return hardness.withColumn("crop_pos", F.row_number().over(order).cast("bigint")).where("crop_pos <= 3").select("sample_id", "person_id", F.round("hardness", 6).alias("hardness"), "crop_pos")


QUERIES = {f.__name__: f for f in (derive_seed, case_balanced_epoch, uniform_negatives, candidate_quota, identity_crops, hard_crops)}

_H = "('0x' || substr(sha256({}), 1, 15))::BIGINT"
ORACLE = {
    "derive_seed": with_cte("smp") + """SELECT sample_id, ('0x' || substr(h, 1, 8))::BIGINT * 2147483648 + ('0x' || substr(h, 9, 8))::BIGINT // 2 AS seed
        FROM (SELECT sample_id, sha256('17:mining:' || right(sample_id, 6)::BIGINT) AS h FROM smp)""",
    "case_balanced_epoch": with_cte("smp", more=f"""r AS (SELECT sample_id, case_type, ('0x' || substr(md5(sample_id), 1, 8))::BIGINT % 64 AS b FROM smp WHERE case_type IN ('INDIVIDUAL', 'GROUP', 'DUAL', 'RELATIONAL')),
        n AS (SELECT case_type, count(*) AS n FROM r GROUP BY 1), e AS (SELECT case_type, n, sum(sqrt(n)) OVER (ORDER BY case_type) / (SELECT sum(sqrt(n)) FROM n) AS high FROM n),
        num AS (SELECT sample_id, case_type, row_number() OVER (PARTITION BY case_type ORDER BY b, sample_id) - 1 AS position FROM r),
        dr AS (SELECT i AS draw, {_H.format("'epoch:category:' || i")}::DOUBLE / 1152921504606846976 AS u, {_H.format("'epoch:row:' || i")} AS h FROM range((SELECT count(*) FROM r)) t(i)),
        p AS (SELECT draw, h, (SELECT min(high) FROM e WHERE dr.u < e.high OR e.high = (SELECT max(high) FROM e)) AS high FROM dr)""")
    + "SELECT draw, sample_id, e.case_type FROM p JOIN e USING (high) JOIN num ON num.case_type = e.case_type AND num.position = p.h % e.n",
    "uniform_negatives": with_cte("gal", "smp", "pos_at", "sco", "pos") + f"""SELECT * FROM (SELECT sample_id, gallery_index, row_number() OVER (PARTITION BY sample_id ORDER BY
        {_H.format("'negatives:' || sample_id || ':' || gallery_index")}, gallery_index) AS draw_pos FROM sco ANTI JOIN pos USING (sample_id, gallery_index)) WHERE draw_pos <= 8""",
    "identity_crops": with_cte("box", more="b AS (SELECT identity_id, image_id, min(box_id) AS box_id FROM box WHERE identity_id IS NOT NULL GROUP BY ALL)")
    + f"""SELECT identity_id, image_id, box_id, crop_pos FROM (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY {_H.format("'crop:' || identity_id || ':' || image_id")}, image_id) AS crop_pos,
        count(*) OVER (PARTITION BY identity_id) AS n FROM b) WHERE n >= 2 AND crop_pos <= 2""",
    "hard_crops": with_cte("gal", "ii", "smp", "req", "sco", more=f"{matching._PERS}, {matching._SHORT}, {matching._QP}")
    + f""", sm AS (SELECT DISTINCT sample_id, gallery_pos AS gallery_index FROM req JOIN ii USING (identity_id) JOIN gal USING (image_id)),
        hd AS (SELECT s.sample_id, p.person_id, max(round({matching._COS.format(a='q.vec', b='p.vec')}, 9)) AS hardness FROM short s ANTI JOIN sm USING (sample_id, gallery_index)
          JOIN (SELECT DISTINCT sample_id, q, vec FROM qp) q ON q.sample_id = s.sample_id JOIN pers p ON p.gallery_index = s.gallery_index GROUP BY ALL)
        SELECT sample_id, person_id, round(hardness, 6) AS hardness, crop_pos FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY hardness DESC, person_id) AS crop_pos FROM hd) WHERE crop_pos <= 3""",
}
