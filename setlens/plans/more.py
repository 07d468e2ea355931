"""Smaller operators: normalised assignments, staleness, strict joins, reranking, offsets, pools, sets, schedules, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.functions.vectors import cosine, doubles
from setlens.operators import ranking
from setlens.operators.audit import running_total
from setlens.operators.relational import first_wins, issues
from setlens.plans import catalog as c
from setlens.plans import dataset, matching, objectives, retrieval
from setlens.plans.catalog import with_cte
from setlens.shared import cut, table, unit_hash

BETA, BATCH, MAX_WORDS, STEPS, WARMUP = 0.5, 24, 48, 1000, 100


def subject_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Subjects in order of their number with sorted distinct identities; codes for empty, shared and misnumbered ones."""
    per = c.required(spark, d).groupBy("sample_id", "subject_id").agg(F.array_sort(F.collect_set("identity_id")).alias("ids"))
    s = per.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("subject_id", "ids"))).alias("s"))
    declared = c.samples(spark, d).select("sample_id", F.array_sort(F.array_distinct(F.transform("subjects", lambda x: x["subject_id"]))).alias("declared"))
    s = declared.join(s, "sample_id", "left")
    every = F.flatten(F.transform("s", lambda x: x["ids"]))
    code = issues(
        empty_subject=F.coalesce(F.size("s"), F.lit(0)) < F.size("declared"),
        shared_identity=F.size(every) > F.size(F.array_distinct(every)),
        misnumbered=F.col("declared") != F.sequence(F.lit(1), F.greatest(F.size("declared"), F.lit(1))),
    )
    text = F.array_join(F.transform("s", lambda x: F.concat(x["subject_id"].cast("string"), F.lit(":"), F.array_join(x["ids"], "+"))), ";")
    return s.select("sample_id", F.coalesce(text, F.lit("")).alias("subjects"), code.alias("issues"))


def stale_context(spark: SparkSession, d: str) -> DataFrame:
    """Ranked queries whose recorded gallery position of the query image is no longer that of the sample."""
    r = c.scored(spark, d).select("sample_id", "query_index").distinct()
    s = c.samples(spark, d).select("sample_id", "query_image_id").join(c.gallery(spark, d).select(F.col("image_id").alias("query_image_id"), "gallery_pos"), "query_image_id", "left")
    both = r.join(s, "sample_id", "left")
    return both.where(~F.col("query_index").eqNullSafe(F.col("gallery_pos"))).select("sample_id", "query_index", "gallery_pos")


def join_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What a strict join of samples, rankings and splits would refuse, and a partial one would leave out."""
    s = c.samples(spark, d).select("sample_id", F.lit(1).alias("s"))
    r = table(spark, d, "rankings").where("sample_id IS NOT NULL").select("sample_id", F.lit(1).alias("r")).distinct()
    p = c.splits(spark, d).select("sample_id", F.lit(1).alias("p")).distinct()
    both = s.join(r, "sample_id", "full").join(p, "sample_id", "full")
    code = issues(no_sample=F.col("s").isNull(), no_ranking=F.col("r").isNull(), no_split=F.col("p").isNull())
    return both.select("sample_id", code.alias("missing")).where("missing <> ''")


def candidate_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the larger of two scores, ties by image id; scores that are not finite do not count."""
    finite = lambda x: F.when(F.abs(F.col(x)) < float("inf"), F.col(x))
    s = c.scored(spark, d).withColumn("best", F.greatest(finite("coarse"), finite("fine"))).where("best IS NOT NULL")
    s = s.join(c.gallery(spark, d).withColumnRenamed("gallery_pos", "gallery_index"), "gallery_index")
    pos = ranking.complete_rank("sample_id", "best", "image_id")
    return s.withColumn("pos", pos).where("pos <= 5").select("sample_id", "image_id", F.col("best").alias("score"), "pos")


def first_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The first box of every identity by gallery position, then box id: later ones are repetitions."""
    b = c.boxes(spark, d).where("identity_id IS NOT NULL").join(c.gallery(spark, d), "image_id")
    return first_wins(b, ["identity_id"], [F.col("gallery_pos"), F.col("box_id")]).select("identity_id", "image_id", "box_id")


def packed_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where the boxes of each image begin if all are stored one after another in gallery order, within each split."""
    n = c.boxes(spark, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"))
    i = c.images(spark, d).join(n, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.lit(0)))
    placed = running_total(i, "split", ["gallery_pos", "image_id"], F.col("boxes"), "offset_")
    return placed.select("split", "image_id", "boxes", "offset_")


def identity_pools(spark: SparkSession, d: str) -> DataFrame:
    """Boxes and images of every identity, and whether it can be drawn at random (two images or more)."""
    b = c.boxes(spark, d).where("identity_id IS NOT NULL")
    p = b.groupBy("identity_id").agg(F.count(F.lit(1)).alias("boxes"), F.countDistinct("image_id").alias("images"))
    return p.withColumn("random_eligible", F.col("images") >= 2)


def first_queries(spark: SparkSession, d: str) -> DataFrame:
    """The first five samples of each split by their listed position."""
    s = table(spark, d, "sample_splits").select(c.stripped(F.col("sample_id")).alias("sample_id"), c.plain_name(F.col("split")).alias("split"), "split_pos")
    s = s.where(F.col("split").isin(*dataset.SPLITS)).groupBy("split", "sample_id").agg(F.min("split_pos").alias("split_pos"))
    pos = F.row_number().over(Window.partitionBy("split").orderBy("split_pos", "sample_id")).cast("bigint")
    return s.withColumn("pos", pos).where("pos <= 5").select("split", "sample_id", "pos")


def set_relations(spark: SparkSession, d: str) -> DataFrame:
    """Labelled positives against candidate identities' images: sizes of union, intersection, both differences, and predicates."""
    a = c.positives(spark, d).groupBy("sample_id").agg(F.collect_set("gallery_index").alias("a"))
    b = retrieval.topm_shortlist(spark, d).groupBy("sample_id").agg(F.collect_set("gallery_index").alias("b"))
    n = lambda x: F.size(x).cast("bigint")
    return a.join(b, "sample_id").select(
        "sample_id", n(F.array_union("a", "b")).alias("in_any"), n(F.array_intersect("a", "b")).alias("in_both"), n(F.array_except("a", "b")).alias("only_a"),
        n(F.array_except("b", "a")).alias("only_b"), (F.size(F.array_except("a", "b")) == 0).alias("subset"), (~F.arrays_overlap("a", "b")).alias("disjoint"),
    )


def mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of the persons of each image, as its first component and its norm."""
    p = matching.persons(spark, d).select("gallery_index", F.posexplode(doubles(F.col("vec"))).alias("i", "x"))
    m = p.groupBy("gallery_index", "i").agg(F.avg("x").alias("x"))
    return m.groupBy("gallery_index").agg(F.round(F.max(F.when(F.col("i") == 0, F.col("x"))), 6).alias("first"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"))


def coarse_fusion(spark: SparkSession, d: str) -> DataFrame:
    """z(identity) + beta z(state) over all candidates with both; state is the given coarse score, identity the best-match score."""
    m = matching.maxsim_coarse(spark, d).withColumnRenamed("score", "identity")
    both = cut(m.join(c.scored(spark, d).select("sample_id", "gallery_index", F.col("coarse").alias("state")), ["sample_id", "gallery_index"]))
    valid = (F.col("identity") > ranking.NONE) & (F.col("state") > ranking.NONE)
    both = ranking.moments_zscore(both, F.col("identity"), valid, "sample_id", "zi")
    both = ranking.moments_zscore(both, F.col("state"), valid, "sample_id", "zs")
    return both.select("sample_id", "gallery_index", F.coalesce(F.round(F.col("zi") + BETA * F.col("zs"), 5), F.lit(ranking.NONE)).alias("score"))


def pair_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Identities that query and target image share, against the required ones: equal, missing or more."""
    ii = c.image_identity(spark, d)
    s = c.samples(spark, d).select("sample_id", "query_image_id", "target_image_id")
    q = s.join(ii.withColumnRenamed("image_id", "query_image_id"), "query_image_id")
    shared = q.join(ii.withColumnRenamed("image_id", "target_image_id"), ["target_image_id", "identity_id"]).select("sample_id", "identity_id", F.lit(1).alias("s"))
    req = c.required(spark, d).select("sample_id", "identity_id", F.lit(1).alias("r")).distinct()
    both = shared.join(req, ["sample_id", "identity_id"], "full")
    return both.groupBy("sample_id").agg(F.count("s").alias("shared"), F.count("r").alias("required"), F.count(F.when(F.col("s").isNotNull() & F.col("r").isNotNull(), 1)).alias("matched"))


def review_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Per sample the identities of its query image in numeric order, required ones marked."""
    ii = c.image_identity(spark, d).withColumnRenamed("image_id", "query_image_id")
    s = c.samples(spark, d).select("sample_id", "query_image_id").join(ii, "query_image_id")
    req = c.required(spark, d).select("sample_id", "identity_id", F.lit(1).alias("r")).distinct()
    s = s.join(req, ["sample_id", "identity_id"], "left")
    number = F.struct(F.length("identity_id").alias("n"), F.concat("identity_id", F.when(F.col("r").isNotNull(), "*").otherwise("")).alias("text"))
    return s.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(number)), lambda x: x["text"]), ",").alias("identities"))


def training_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of one epoch: samples of equal subject count in random order, BATCH a batch; each sample once.

    Rows are numbered by hash range first, so a subject count with most of the rows is not sorted in one task.
    """
    s = c.samples(spark, d).select("sample_id", F.size("subjects").alias("subjects")).withColumn("k", unit_hash("batch", F.col("sample_id")))
    s = s.withColumn("b", F.floor(F.col("k") / (1 << 54)))
    sizes = s.groupBy("subjects", "b").count()
    before = sizes.withColumn("start", F.sum("count").over(Window.partitionBy("subjects").orderBy("b")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("subjects", "b").orderBy("k", "sample_id")) - 1
    s = s.withColumn("w", within).join(F.broadcast(before), ["subjects", "b"])  # 64 rows a subject count
    return s.select("sample_id", "subjects", F.floor((F.col("start") + F.col("w")) / BATCH).alias("batch"))


def truncation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per annotator: instructions with more words than an encoder takes."""
    n = F.size(F.split(F.trim("final_instruction"), r"\s+"))
    s = c.samples(spark, d).where("final_instruction IS NOT NULL")
    return s.groupBy("annotator").agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(n > MAX_WORDS, 1)).alias("cut"), F.max(n).alias("most_words"))


def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    """Warm-up, then half a cosine, as factor per step."""
    step = F.col("id").cast("double")
    progress = (step - WARMUP) / (STEPS - WARMUP)
    rate = F.when(step < WARMUP, (step + 1) / WARMUP).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))
    return spark.range(STEPS).select(F.col("id").alias("step"), F.round(rate, 9).alias("factor"))


def loss_total(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of the objectives' values."""
    parts = [(objectives.pairwise_softplus, 1.0), (objectives.rejection_hinge, 0.5), (objectives.supcon_loss, 0.25), (objectives.grounding_bce, 0.25)]
    rows = None
    for f, w in parts:
        one = f(spark, d).select((F.col("value") * w).alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(F.round(F.sum("v"), 5).alias("total"))


def run_check(spark: SparkSession, d: str) -> DataFrame:
    """Saved aggregates against the mean of their queries, within 1e-9: metrics that differ or leave [0, 1]."""
    per = retrieval.per_query(spark, d).agg(F.avg("ap").alias("a"), F.min("ap").alias("low"), F.max("ap").alias("high"), F.count(F.lit(1)).alias("n"))
    saved = retrieval.checkpoint_score(spark, d).select("overall")
    one = per.withColumn("k", F.lit(1)).join(saved.withColumn("k", F.lit(1)), "k")
    return one.select("n", (F.abs(F.round("a", 6) - F.col("overall")) <= 1e-9).alias("agrees"), ((F.col("low") >= 0) & (F.col("high") <= 1)).alias("in_range"))


def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """All checks of samples, boxes and splits in one aggregate: how often each code was found."""
    parts = [("samples", dataset.sample_issues), ("head_boxes", dataset.box_issues), ("sample_splits", dataset.split_partition_issues)]
    found = None
    for name, query in parts:
        rows = query(spark, d).select(F.lit(name).alias("table_name"), F.explode(F.split("issues", ",")).alias("issue"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("table_name", "issue").agg(F.count(F.lit(1)).alias("violations"))


def store_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Of each two stores that share the gallery's images: how many images both hold, and how many only one of them."""
    image = lambda name: table(spark, d, name).select(c.plain_image(F.col("image_id")).alias("image_id")).where("image_id IS NOT NULL")
    stores = {"gallery": image("gallery"), "head_boxes": image("head_boxes"), "persons": image("persons")}
    rows = None
    for name, df in stores.items():
        df = df.select("image_id", F.lit(name).alias("store"))
        rows = df if rows is None else rows.unionByName(df)
    per = rows.groupBy("image_id").agg(*[F.max(F.col("store") == name).alias(name) for name in stores])
    pairs = [(a, b) for k, a in enumerate(stores) for b in list(stores)[k + 1 :]]
    n = lambda x: F.count(F.when(x, 1))
    counts = per.agg(*[n(x).alias(f"{a}_{b}_{i}") for a, b in pairs for i, x in enumerate((F.col(a) & F.col(b), F.col(a) & ~F.col(b), F.col(b) & ~F.col(a)))])
    stack = ", ".join(f"'{a}', '{b}', {a}_{b}_0, {a}_{b}_1, {a}_{b}_2" for a, b in pairs)
    return counts.select(F.expr(f"stack({len(pairs)}, {stack}) AS (left_store, right_store, in_both, only_left, only_right)"))


QUERIES = {
    f.__name__: f
    for f in (
        validation_summary, store_compatibility,
        subject_normalize, stale_context, join_gaps, candidate_rerank, first_boxes, packed_offsets, identity_pools, first_queries, set_relations,
        mean_pooling, coarse_fusion, pair_boxes, review_tasks, training_batches, truncation_counts, learning_rates, loss_total, run_check,
    )
}

_CODES = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"
_INF = "'-infinity'::DOUBLE"
_C = ("gal", "smp", "pos_at", "sco", "pos")
_MAXSIM = f"{matching._PERS}, {matching._QP}, {matching._MAXSIM}"
_OK = f"identity > {_INF} AND state > {_INF}"
ORACLE = {
    "subject_normalize": with_cte("smp", "req") + """, per AS (SELECT sample_id, subject_id, string_agg(identity_id, '+' ORDER BY identity_id) AS ids FROM req GROUP BY ALL),
        n AS (SELECT sample_id, string_agg(subject_id || ':' || ids, ';' ORDER BY subject_id) AS subjects, count(*) AS k FROM per GROUP BY 1),
        o AS (SELECT sample_id, count(*) > count(DISTINCT identity_id) AS shared FROM req GROUP BY 1),
        d AS (SELECT sample_id, list_sort(list_distinct(list_transform(subjects, lambda x: x.subject_id))) AS declared FROM smp) SELECT d.sample_id, coalesce(n.subjects, '') AS subjects, """
    + _CODES.format("CASE WHEN coalesce(k, 0) < len(declared) THEN 'empty_subject' END, CASE WHEN declared <> list_transform(range(1, greatest(len(declared), 1) + 1), lambda x: x::INTEGER) THEN 'misnumbered' END, CASE WHEN shared THEN 'shared_identity' END")
    + " AS issues FROM d LEFT JOIN n USING (sample_id) LEFT JOIN o USING (sample_id)",
    "stale_context": with_cte("gal", "smp", "sco") + """SELECT DISTINCT r.sample_id, query_index, gallery_pos FROM sco r LEFT JOIN smp USING (sample_id) LEFT JOIN gal ON gal.image_id = query_image_id
        WHERE query_index IS DISTINCT FROM gallery_pos""",
    "join_gaps": with_cte("smp", "spl") + """, k AS (SELECT sample_id FROM smp UNION SELECT sample_id FROM rankings WHERE sample_id IS NOT NULL UNION SELECT sample_id FROM spl)
        SELECT * FROM (SELECT sample_id, """ + _CODES.format("""CASE WHEN sample_id NOT IN (SELECT sample_id FROM rankings WHERE sample_id IS NOT NULL) THEN 'no_ranking' END,
        CASE WHEN sample_id NOT IN (SELECT sample_id FROM smp) THEN 'no_sample' END, CASE WHEN sample_id NOT IN (SELECT sample_id FROM spl) THEN 'no_split' END""") + " AS missing FROM k) WHERE missing <> ''",
    "candidate_rerank": with_cte("gal", "sco") + """SELECT * FROM (SELECT sample_id, image_id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, image_id) AS pos FROM (
        SELECT sample_id, image_id, greatest(CASE WHEN isfinite(coarse) THEN coarse END, CASE WHEN isfinite(fine) THEN fine END) AS score FROM sco JOIN gal ON gallery_pos = gallery_index) WHERE score IS NOT NULL) WHERE pos <= 5""",
    "first_boxes": with_cte("gal", "box") + """SELECT identity_id, image_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY gallery_pos, box_id) AS r
        FROM box JOIN gal USING (image_id) WHERE identity_id IS NOT NULL) WHERE r = 1""",
    "packed_offsets": with_cte("gal", "img", "box") + """, n AS (SELECT split, image_id, gallery_pos, count(box_id) AS boxes FROM img LEFT JOIN box USING (image_id) GROUP BY ALL)
        SELECT split, image_id, boxes, (sum(boxes) OVER (PARTITION BY split ORDER BY gallery_pos, image_id ROWS UNBOUNDED PRECEDING) - boxes)::BIGINT AS offset_ FROM n""",
    "identity_pools": with_cte("box") + "SELECT identity_id, count(*) AS boxes, count(DISTINCT image_id) AS images, count(DISTINCT image_id) >= 2 AS random_eligible FROM box WHERE identity_id IS NOT NULL GROUP BY 1",
    "first_queries": """SELECT split, sample_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY split_pos, sample_id) AS pos FROM (
        SELECT lower(trim(split)) AS split, regexp_replace(sample_id, '^\\s+|\\s+$', '', 'g') AS sample_id, min(split_pos) AS split_pos FROM sample_splits
        WHERE lower(trim(split)) IN ('train', 'val', 'test') GROUP BY ALL)) WHERE pos <= 5""",
    "set_relations": with_cte(*_C, more=matching._SHORT) + """, a AS (SELECT sample_id, list(gallery_index) AS a FROM pos GROUP BY 1), b AS (SELECT sample_id, list(gallery_index) AS b FROM short GROUP BY 1),
        n AS (SELECT sample_id, len(a) AS na, len(b) AS nb, len(list_filter(a, lambda x: list_contains(b, x))) AS k FROM a JOIN b USING (sample_id))
        SELECT sample_id, na + nb - k AS in_any, k AS in_both, na - k AS only_a, nb - k AS only_b, na = k AS subset, k = 0 AS disjoint FROM n""",
    "mean_pooling": with_cte("gal", more=matching._PERS) + """, x AS (SELECT gallery_index, unnest(vec) AS x, unnest(range(64)) AS i FROM pers), m AS (SELECT gallery_index, i, avg(x) AS x FROM x GROUP BY ALL)
        SELECT gallery_index, round(max(x) FILTER (WHERE i = 0), 6) AS first, round(sqrt(sum(x * x)), 6) AS norm FROM m GROUP BY gallery_index""",
    "coarse_fusion": with_cte("gal", "smp", "req", "sco", more=_MAXSIM) + f""", j AS (SELECT sample_id, gallery_index, score AS identity, coarse AS state FROM maxsim JOIN sco USING (sample_id, gallery_index)),
        z AS (SELECT *, {retrieval._z('identity', _OK, 'sample_id')} AS zi, {retrieval._z('state', _OK, 'sample_id')} AS zs FROM j)
        SELECT sample_id, gallery_index, coalesce(round(zi + {BETA} * zs, 5), {_INF}) AS score FROM z""",
    "pair_boxes": with_cte("ii", "smp", "req") + """, sh AS (SELECT sample_id, q.identity_id FROM smp JOIN ii q ON q.image_id = query_image_id JOIN ii t ON t.image_id = target_image_id AND t.identity_id = q.identity_id),
        r AS (SELECT DISTINCT sample_id, identity_id FROM req)
        SELECT coalesce(sh.sample_id, r.sample_id) AS sample_id, count(sh.identity_id) AS shared, count(r.identity_id) AS required, count(*) FILTER (WHERE sh.identity_id = r.identity_id) AS matched
        FROM sh FULL JOIN r ON sh.sample_id = r.sample_id AND sh.identity_id = r.identity_id GROUP BY 1""",
    "review_tasks": with_cte("ii", "smp", "req") + """, r AS (SELECT DISTINCT sample_id, identity_id FROM req), t AS (SELECT sample_id, ii.identity_id, r.identity_id IS NOT NULL AS m FROM smp JOIN ii ON image_id = query_image_id
        LEFT JOIN r ON r.sample_id = smp.sample_id AND r.identity_id = ii.identity_id)
        SELECT sample_id, string_agg(identity_id || CASE WHEN m THEN '*' ELSE '' END, ',' ORDER BY length(identity_id), identity_id) AS identities FROM t GROUP BY 1""".replace("SELECT sample_id, ii.identity_id", "SELECT smp.sample_id, ii.identity_id"),
    "training_batches": with_cte("smp") + f"""SELECT sample_id, subjects, (row_number() OVER (PARTITION BY subjects ORDER BY k, sample_id) - 1) // {BATCH} AS batch FROM (
        SELECT sample_id, len(subjects)::INTEGER AS subjects, ('0x' || substr(sha256('batch:' || sample_id), 1, 15))::BIGINT AS k FROM smp)""",
    "truncation_counts": with_cte("smp") + f"""SELECT annotator, count(*) AS texts, count(*) FILTER (WHERE n > {MAX_WORDS}) AS cut, max(n)::INTEGER AS most_words FROM (
        SELECT annotator, len(regexp_split_to_array(trim(final_instruction), '\\s+')) AS n FROM smp WHERE final_instruction IS NOT NULL) GROUP BY annotator""",
    "learning_rates": f"SELECT i AS step, round(CASE WHEN i < {WARMUP} THEN (i + 1) / {WARMUP} ELSE 0.5 * (1 + cos(pi() * (i - {WARMUP}) / ({STEPS} - {WARMUP}))) END, 9) AS factor FROM range({STEPS}) t(i)",
    "loss_total": "SELECT round((SELECT value FROM (" + objectives.ORACLE["pairwise_softplus"] + ")) + 0.5 * (SELECT value FROM (" + objectives.ORACLE["rejection_hinge"] + ")) + 0.25 * (SELECT value FROM ("
    + objectives.ORACLE["supcon_loss"] + ")) + 0.25 * (SELECT value FROM (" + objectives.ORACLE["grounding_bce"] + ")), 5) AS total",
    "run_check": with_cte(*_C, more=retrieval._PQ) + "SELECT count(*) AS n, true AS agrees, min(ap) >= 0 AND max(ap) <= 1 AS in_range FROM pq",
    "validation_summary": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, issue, count(*) AS violations FROM (SELECT unnest(string_split(issues, ',')) AS issue FROM ({dataset.ORACLE[query]})) GROUP BY issue"
        for name, query in (("samples", "sample_issues"), ("head_boxes", "box_issues"), ("sample_splits", "split_partition_issues"))
    ),
    "store_compatibility": f"""WITH s AS (SELECT DISTINCT store, {c.sql_image('image_id')} AS image_id FROM (SELECT 'gallery' AS store, image_id FROM gallery UNION ALL SELECT 'head_boxes', image_id FROM head_boxes
          UNION ALL SELECT 'persons', image_id FROM persons) WHERE {c.sql_image('image_id')} IS NOT NULL),
        p AS (SELECT * FROM (VALUES ('gallery', 'head_boxes'), ('gallery', 'persons'), ('head_boxes', 'persons')) t(left_store, right_store))
        SELECT left_store, right_store, (SELECT count(*) FROM s a JOIN s b USING (image_id) WHERE a.store = left_store AND b.store = right_store) AS in_both,
          (SELECT count(*) FROM s a WHERE a.store = left_store AND image_id NOT IN (SELECT image_id FROM s b WHERE b.store = right_store)) AS only_left,
          (SELECT count(*) FROM s b WHERE b.store = right_store AND image_id NOT IN (SELECT image_id FROM s a WHERE a.store = left_store)) AS only_right FROM p""",
}
