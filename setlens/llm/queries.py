"""Queries of the training-data problems over the supplied tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions.ids import plain_case, plain_identity, plain_image, plain_name, stripped
from setlens.llm import encode, mixing, neighbours, overlap, quota_sample, sentences, splits, tokens_sql, topn
from setlens.shared import cut, table

CASES = ["INDIVIDUAL", "GROUP", "DUAL", "RELATIONAL"]


# ---- 1: splits that keep related records together


def sample_keys(spark: SparkSession, d: str) -> DataFrame:
    """(id, root) of each sample. A key of an identity sorts as its number, before all query images."""
    samples = table(spark, d, "samples").where(stripped(F.col("sample_id")) != "")
    ids = F.flatten(F.transform("subjects", lambda s: F.coalesce(s["identity_ids"], F.array().cast("array<string>"))))
    digits = F.transform(ids, plain_identity)
    people = F.transform(digits, lambda x: F.concat(F.lit("a"), F.lpad(F.length(x).cast("string"), 4, "0"), x))
    image = plain_image(F.col("query_image_id"))
    keys = F.concat(
        F.coalesce(people, F.array().cast("array<string>")),
        F.when(image.isNotNull(), F.array(F.concat(F.lit("b"), image))).otherwise(F.array().cast("array<string>")),
    )
    return splits.key_components(samples.withColumn("sample_id", stripped(F.col("sample_id"))), "sample_id", keys)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members = cut(sample_keys(spark, d))
    big = members.where(F.col("root").isNotNull()).groupBy("root").count().where("count > 1").select("root")
    found = members.join(big, "root")
    smallest = F.when(F.col("root").startswith("a"), F.expr("substring(root, 6)"))
    return found.select(F.col("id").alias("sample_id"), smallest.alias("group_id"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    targets = [(r["split"], r["target_share"]) for r in table(spark, d, "split_targets").collect()]  # a fixed, small table
    placed = splits.assign_splits(sample_keys(spark, d), targets)
    return placed.select(F.col("id").alias("sample_id"), F.col("root").alias("group_key"), "split")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = p1_splits(spark, d).groupBy("split", "group_key").count()
    got = sizes.groupBy("split").agg(F.sum("count").alias("samples"), F.count(F.lit(1)).alias("groups"))
    total = F.sum(F.coalesce("samples", F.lit(0))).over(_all())
    wanted = table(spark, d, "split_targets").select("split", "target_share")
    rows = wanted.join(got, "split", "full")
    return rows.select(
        "split", "target_share", F.coalesce("samples", F.lit(0)).alias("samples"), "groups",
        F.try_divide(F.coalesce("samples", F.lit(0)), total).alias("actual_share"),
    )


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0))


_KEYS = """
WITH RECURSIVE raw AS (
  SELECT DISTINCT trim(sample_id) AS s, query_image_id AS q, unnest(subjects).identity_ids AS ids FROM samples),
one AS (SELECT s, unnest(ids) AS i FROM raw),
keys AS (
  SELECT DISTINCT s, 'a' || lpad(CAST(length(n) AS VARCHAR), 4, '0') || n AS k FROM (
    SELECT s, CASE WHEN i IS NULL OR regexp_replace(i, '^\\s+|\\s+$', '', 'g') IN ('', '-1') THEN NULL
      ELSE regexp_replace(regexp_extract(i, '([0-9]+)', 1), '^0+([0-9])', '\\1') END AS n FROM one) WHERE n IS NOT NULL
  UNION SELECT DISTINCT s, 'b' || regexp_extract(q, '([0-9]+_[0-9]+)', 1) FROM raw WHERE regexp_extract(q, '([0-9]+_[0-9]+)', 1) <> ''),
firsts AS (SELECT s, min(k) AS m FROM keys GROUP BY s),
links AS (SELECT DISTINCT k, m FROM keys JOIN firsts USING (s)),
edges AS (SELECT k AS a, m AS b FROM links UNION SELECT m, k FROM links),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
members AS (SELECT s, root FROM firsts JOIN roots ON firsts.m = roots.a)
"""


# ---- 3: top N items within every group


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rankings").where(~F.col("gallery_index").eqNullSafe(F.col("query_index")) | F.col("query_index").isNull())
    return topn.top_n(rows, "sample_id", "gallery_index", "coarse_score", 10).select("sample_id", "gallery_index", "rank_no")


# ---- 4: sample matching target category proportions


def case_rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select(stripped(F.col("sample_id")).alias("id"), plain_case(F.col("case_type")).alias("category"))
    known = s.where((F.col("id") != "") & F.col("category").isin(*CASES))
    return known.groupBy("id").agg(F.min("category").alias("category"))


def case_plan(spark: SparkSession, d: str, rows: DataFrame) -> list[dict]:
    targets = table(spark, d, "case_targets").withColumn("category", plain_case(F.col("case_type")))
    return quota_sample.plan_draws(rows, targets, CASES)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    plan = case_plan(spark, d, cut(case_rows(spark, d)))
    return spark.createDataFrame(plan, quota_sample.PLAN_SCHEMA).where(~F.col("met")).select("draw_id", F.col("category").alias("case_type"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(case_rows(spark, d))
    drawn = quota_sample.draw_samples(rows, case_plan(spark, d, rows))
    return drawn.select("draw_id", F.col("category").alias("case_type"), F.col("id").alias("sample_id"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    plan = case_plan(spark, d, cut(case_rows(spark, d)))
    return spark.createDataFrame(plan, quota_sample.PLAN_SCHEMA).withColumnRenamed("category", "case_type")


# ---- 5: most similar vectors for every vector


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "persons").select(F.col("person_id").alias("id"), F.col("identity_vec").alias("vec"))
    pairs = neighbours.neighbour_pairs(neighbours.nearest(vectors, 5))
    return pairs.select(F.col("a").alias("person_a"), F.col("b").alias("person_b"))


# ---- 6: same or near-same records across splits


def split_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    name = plain_name(F.col("split"))
    listed = table(spark, d, "sample_splits").groupBy(stripped(F.col("sample_id")).alias("id")).agg(
        F.max(name.eqNullSafe("train")).alias("train"),
        F.max(name.eqNullSafe("val")).alias("val"),
        F.max(name.eqNullSafe("test")).alias("test"),
    )
    texts = table(spark, d, "samples").groupBy(stripped(F.col("sample_id")).alias("id")).agg(
        F.min("final_instruction").alias("text"), F.min("annotator").alias("annotator")
    )
    records = listed.where("train OR val OR test").join(texts, "id").withColumn("words", overlap.word_set(F.col("text")))
    records = cut(records.select("id", "words", "train", "val", "test", "annotator"))
    pairs, members = overlap.similar_across(records, F.col("train"), F.expr("val OR test"))
    return cut(pairs), members.join(records.select("id", "val", "test", "annotator"), "id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = split_pairs(spark, d)
    left = members.where("is_left").select(F.col("rep").alias("left_rep"), F.col("id").alias("x"), F.col("is_right").alias("x_right"))
    right = members.where("is_right").select(F.col("rep").alias("right_rep"), F.col("id").alias("y"), F.col("is_left").alias("y_left"))
    both = pairs.join(left, "left_rep").join(right, "right_rep")
    # two samples that each stand on both sides meet twice; keeping one of the two spares a distinct over all pairs
    once = both.where((F.col("x") <= F.col("y")) | ~F.col("x_right") | ~F.col("y_left"))
    return once.select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and annotator: samples with a counterpart in train, and pairs, counted without listing them."""
    pairs, members = split_pairs(spark, d)
    train = members.where("is_left").groupBy(F.col("rep").alias("left_rep")).agg(F.count(F.lit(1)).alias("n"))
    per_rep = pairs.join(train, "left_rep").groupBy(F.col("right_rep").alias("rep")).agg(F.sum("n").alias("pairs"))
    hits = members.where("is_right").join(per_rep, "rep")
    names = F.array(F.when(F.col("val"), F.lit("val")), F.when(F.col("test"), F.lit("test")))
    hits = hits.select(F.explode(F.array_compact(names)).alias("split"), "annotator", "pairs")
    return hits.groupBy("split", "annotator").agg(F.count(F.lit(1)).alias("samples"), F.sum("pairs").alias("pairs"))


# ---- 7: encoding of the whole corpus


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


# ---- 8: mixing sources to target weights


def mix_plan(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    docs = table(spark, d, "documents").select("doc_id", plain_name(F.col("source")).alias("source"), "text")
    docs = cut(encode.count_tokens(docs, F.col("text")).drop("text"))
    targets = [
        {"mix_id": r["mix_id"], "source": r["source"], "weight": r["target_weight"], "max_repeats": r["max_repeats"], "fraction": r["total_fraction"]}
        for r in table(spark, d, "mix_targets").withColumn("source", plain_name(F.col("source"))).collect()  # a fixed, small table
        if r["source"] is not None
    ]
    names = sorted({t["source"] for t in targets})
    per_source = docs.where(F.col("source").isin(*names)).groupBy("source").agg(F.sum("tokens").alias("t"))
    return docs, mixing.shares(targets, {r["source"]: r["t"] for r in per_source.collect()})


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(*mix_plan(spark, d))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    docs, plan = mix_plan(spark, d)
    report = mixing.mix_report(mixing.mix_sources(docs, plan), plan)
    return report.withColumns({"target_share": F.round("target_share", 6), "wanted": F.round("wanted", 3), "actual_share": F.round("actual_share", 6)})


# ---- 9: sentence boundaries


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(~F.col("doc_type").eqNullSafe("log"))
    return sentences.sentences(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_rows(spark, d).select("doc_id", "start_pos", "end_pos")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentence_rows(spark, d).select("doc_id", "seq", "sentence")


# full-width forms and two ligatures: the part of NFKC that these texts need
_WIDE, _PLAIN = ("".join(chr(first + k) for k in range(94)).replace("'", "''") for first in (0xFF01, 0x21))
_OVERLAP = f"""
WITH listed AS (
  SELECT regexp_replace(sample_id, '^\\s+|\\s+$', '', 'g') AS id, coalesce(bool_or(lower(trim(split)) = 'train'), false) AS train,
    coalesce(bool_or(lower(trim(split)) = 'val'), false) AS val, coalesce(bool_or(lower(trim(split)) = 'test'), false) AS test FROM sample_splits GROUP BY 1),
texts AS (SELECT trim(sample_id) AS id, min(final_instruction) AS t, min(annotator) AS annotator FROM samples GROUP BY 1),
words AS (SELECT listed.*, annotator, list_distinct(regexp_extract_all(lower(replace(replace(translate(t, '{_WIDE}', '{_PLAIN}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')),
    '[\\p{{L}}\\p{{N}}]+')) AS w FROM listed JOIN texts USING (id) WHERE t IS NOT NULL),
pairs AS (SELECT a.id AS x, b.id AS y, b.val, b.test, b.annotator FROM words a JOIN words b ON a.train AND (b.val OR b.test) AND len(a.w) > 0
    AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))
"""

# quotas: whole shares between least rows and what is there, then what is left round by round, then what is too much given back
_QUOTAS = """
WITH RECURSIVE known AS (
  SELECT id, min(c) AS c FROM (SELECT trim(sample_id) AS id, upper(trim(case_type)) AS c FROM samples) WHERE id <> '' AND c IN ('INDIVIDUAL', 'GROUP', 'DUAL', 'RELATIONAL') GROUP BY id),
counts AS (SELECT c, count(*) AS there FROM known GROUP BY c),
sizes AS (SELECT draw_id, floor(coalesce(any_value(draw_fraction), 0) * (SELECT count(*) FROM known))::BIGINT AS n FROM case_targets GROUP BY draw_id),
t AS (SELECT draw_id, upper(trim(case_type)) AS c, n, coalesce(target_share, 0) AS share, coalesce(min_rows, 0) AS least_, coalesce(there, 0) AS there,
  coalesce(target_share, 0) * n - floor(coalesce(target_share, 0) * n) AS rest FROM case_targets JOIN sizes USING (draw_id) LEFT JOIN counts ON counts.c = upper(trim(case_type))),
f AS (SELECT *, least(least_, there)::BIGINT AS low, least(there, greatest(least(least_, there), floor(share * n)))::BIGINT AS take FROM t),
rounds AS (
  SELECT draw_id, 0 AS k, list({'c': c, 'share': share, 'cap': there, 'low': low, 'take': take} ORDER BY rest DESC, c) AS x, least(any_value(n), sum(there)) - sum(take) AS left_ FROM f GROUP BY draw_id
  UNION ALL
  SELECT draw_id, k + 1, list_transform(x, lambda y, i: {'c': y.c, 'share': y.share, 'cap': y.cap, 'low': y.low, 'take': y.take + g[i]}), left_ - list_sum(g) FROM (
    SELECT *, CASE WHEN list_sum(e) > 0 THEN e ELSE list_transform(x, lambda y, i: CASE WHEN y.take < y.cap AND len(list_filter(x[1:i], lambda z: z.take < z.cap)) <= left_ THEN 1::BIGINT ELSE 0::BIGINT END) END AS g FROM (
      SELECT *, list_transform(x, lambda y: CASE WHEN y.take < y.cap AND w > 0 THEN least(y.cap - y.take, floor(left_ * y.share / w))::BIGINT ELSE 0::BIGINT END) AS e FROM (
        SELECT *, list_sum(list_transform(list_filter(x, lambda y: y.take < y.cap), lambda y: y.share)) AS w FROM rounds WHERE left_ > 0)))),
last AS (SELECT draw_id, unnest(arg_max(x, k)) AS y, arg_min(left_, -k) AS left_ FROM rounds GROUP BY draw_id),
back AS (SELECT draw_id, y.c AS c, y.take AS take, y.take - y.low AS spare, left_, coalesce(sum(y.take - y.low) OVER (PARTITION BY draw_id ORDER BY y.low - y.take, y.c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM last),
quota AS (SELECT draw_id, c, (take - greatest(0, least(spare, greatest(0, -left_) - before)))::BIGINT AS quota FROM back),
plan AS (SELECT t.draw_id, t.c AS case_type, n AS draw_rows, there AS available, greatest(least_, floor(share * n))::BIGINT AS wanted, quota FROM t JOIN quota q ON q.draw_id = t.draw_id AND q.c IS NOT DISTINCT FROM t.c)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_report": p1_report,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_sample": p4_sample,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
}
ORACLE = {
    "p1_found": _KEYS
    + """SELECT s AS sample_id, CASE WHEN root LIKE 'a%' THEN substr(root, 6) END AS group_id FROM members
         WHERE root IN (SELECT root FROM members GROUP BY root HAVING count(*) > 1)""",
    "p3_found": """
        WITH best AS (
          SELECT sample_id, gallery_index, max(coarse_score) AS s FROM rankings
          WHERE coarse_score IS NOT NULL AND NOT isnan(coarse_score) AND coarse_score <> 'infinity'::DOUBLE
            AND gallery_index IS DISTINCT FROM query_index AND sample_id IS NOT NULL AND gallery_index IS NOT NULL
          GROUP BY sample_id, gallery_index),
        ranked AS (SELECT sample_id, gallery_index, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, gallery_index) AS rank_no FROM best)
        SELECT * FROM ranked WHERE rank_no <= 10""",
    "p4_found": """
        WITH known AS (
          SELECT DISTINCT trim(sample_id) AS id, upper(trim(case_type)) AS c FROM samples
          WHERE upper(trim(case_type)) IN ('INDIVIDUAL', 'GROUP', 'DUAL', 'RELATIONAL')),
        counts AS (SELECT c, count(*) AS n FROM known GROUP BY c),
        targets AS (SELECT *, upper(trim(case_type)) AS c, floor(draw_fraction * (SELECT count(*) FROM known)) AS rows_ FROM case_targets)
        SELECT draw_id, t.c AS case_type FROM targets t LEFT JOIN counts USING (c)
        WHERE coalesce(n, 0) < greatest(min_rows, floor(target_share * rows_))""",
    "p4_report": _QUOTAS + "SELECT *, greatest(0, wanted - available) AS shortfall, available >= wanted AS met FROM plan",
    "p4_sample": _QUOTAS
    + """SELECT draw_id, case_type, id AS sample_id FROM (SELECT draw_id, case_type, id, quota, row_number() OVER (PARTITION BY draw_id, case_type
           ORDER BY ('0x' || substr(sha256('draw:' || draw_id || ':' || id), 1, 15))::BIGINT, id) AS r FROM plan JOIN known ON known.c = plan.case_type) WHERE r <= quota""",
    "p5_found": """
        WITH good AS (
          SELECT person_id AS id, min(list_transform(identity_vec, lambda x: x::DOUBLE)) AS v FROM persons
          WHERE len(identity_vec) = 64 AND len(list_filter(identity_vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(identity_vec, lambda x: x <> 0)) > 0 GROUP BY person_id),
        normed AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM good),
        sims AS (
          SELECT a.id AS a, b.id AS b, row_number() OVER (
            PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v) / (a.n * b.n), 9) DESC, b.id) AS r
          FROM normed a JOIN normed b ON a.id <> b.id)
        SELECT DISTINCT least(a, b) AS person_a, greatest(a, b) AS person_b FROM sims WHERE r <= 5""",
    "p6_found": _OVERLAP + "SELECT DISTINCT least(x, y) AS sample_a, greatest(x, y) AS sample_b FROM pairs",
    "p6_report": _OVERLAP
    + """SELECT split, annotator, count(DISTINCT y) AS samples, count(*) AS pairs FROM (
           SELECT 'val' AS split, annotator, y FROM pairs WHERE val UNION ALL SELECT 'test', annotator, y FROM pairs WHERE test) GROUP BY split, annotator""",
    "p8_mix": tokens_sql.tokens_cte() + tokens_sql.MIX + "SELECT mix_id, source, doc_id, tokens, copies FROM mixed",
    "p8_report": tokens_sql.tokens_cte()
    + tokens_sql.MIX
    + """SELECT mix_id, source, round(CASE WHEN weights > 0 THEN weight / weights ELSE 0 END, 6) AS target_share, round(CASE WHEN weights > 0 THEN total * weight / weights ELSE 0 END, 3) AS wanted, available,
        coalesce(got, 0)::BIGINT AS tokens, round(coalesce(got / sum(got) OVER (PARTITION BY mix_id), 0), 6) AS actual_share, coalesce(documents, 0) AS documents, coalesce(most_copies, 0) AS most_copies
        FROM plan LEFT JOIN (SELECT mix_id, source, sum(tokens * copies) AS got, count(*) AS documents, max(copies) AS most_copies FROM mixed GROUP BY ALL) USING (mix_id, source)""",
}
