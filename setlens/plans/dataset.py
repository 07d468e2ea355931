"""Dataset construction and audits: split scopes, identity containment, constraints, conflicts, upserts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.operators import audit
from setlens.operators.relational import division, duplicate_keys, issues, key_differences, keyed_upsert, meet, partial_overlap
from setlens.plans import catalog as c
from setlens.plans.catalog import with_cte
from setlens.shared import cut, table

SPLITS = ["train", "val", "test"]


def split_gallery(spark: SparkSession, d: str) -> DataFrame:
    i = c.images(spark, d).where(F.col("split").isin(*SPLITS))
    placed = audit.running_total(i, "split", ["gallery_pos", "image_id"], F.lit(1).cast("bigint"), "before")
    return placed.select("split", "image_id", (F.col("before") + 1).alias("split_pos"))


def scoped_samples(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, split, case_type, query_image_id): samples whose query image stands in the gallery of their split."""
    s = c.samples(spark, d).join(c.splits(spark, d), "sample_id")
    i = c.images(spark, d).select(F.col("image_id").alias("query_image_id"), "split")
    return s.join(i, ["query_image_id", "split"], "left_semi").select("sample_id", "split", "case_type", "query_image_id")


def split_scoped_positives(spark: SparkSession, d: str) -> DataFrame:
    s = c.samples(spark, d).select("sample_id", F.posexplode("positives").alias("i", "image_id"))
    s = s.join(scoped_samples(spark, d).select("sample_id", "split"), "sample_id")
    s = s.join(c.images(spark, d).select("image_id", "split"), ["image_id", "split"], "left_semi")
    per = s.groupBy("sample_id", "split").agg(F.array_sort(F.collect_list(F.struct("i", "image_id"))).alias("p"))
    return per.select("sample_id", "split", F.array_join("p.image_id", ",").alias("positives"))


def public_samples(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.transform("subjects", lambda s: s["subject_id"].cast("string")), ",")
    return c.samples(spark, d).select(
        "sample_id", "case_type", "query_image_id", ids.alias("subject_ids"), "final_desc", "final_change", "final_instruction"
    )


def required_identities(spark: SparkSession, d: str) -> DataFrame:
    per = c.required(spark, d).groupBy("sample_id", "subject_id").agg(F.array_sort(F.collect_set("identity_id")).alias("ids"))
    return per.select("sample_id", "subject_id", F.array_join("ids", ",").alias("identity_ids"), F.size("ids").cast("bigint").alias("n"))


def case_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Declared case against the one its subjects say: two subjects need DUAL or RELATIONAL, one needs GROUP from two identities on."""
    per = c.required(spark, d).groupBy("sample_id").agg(F.countDistinct("subject_id").alias("subjects"), F.countDistinct("identity_id").alias("identities"))
    s = c.samples(spark, d).select("sample_id", "case_type").join(per, "sample_id")
    inferred = F.when(F.col("subjects") > 1, F.when(F.col("case_type") == "RELATIONAL", "RELATIONAL").otherwise("DUAL"))
    inferred = inferred.otherwise(F.when(F.col("identities") > 1, "GROUP").otherwise("INDIVIDUAL"))
    return s.withColumn("inferred_case", inferred).groupBy("case_type", "inferred_case").agg(F.count(F.lit(1)).alias("samples"))


def identity_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    req = c.required(spark, d).select(F.col("sample_id").alias("qid"), "subject_id", F.col("identity_id").alias("key")).distinct()
    return req, c.image_identity(spark, d).select(F.col("image_id").alias("iid"), F.col("identity_id").alias("key"))


def scoped_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """identity_items() of samples in their split and of images in theirs, with the split in the key, so that only images of the own split meet."""
    req, having = identity_items(spark, d)
    key = F.concat_ws("|", "split", "key").alias("key")
    scope = scoped_samples(spark, d).select(F.col("sample_id").alias("qid"), "split")
    there = c.images(spark, d).select(F.col("image_id").alias("iid"), "split")
    return req.join(scope, "qid").select("qid", "subject_id", key), having.join(there, "iid").select("iid", key)


def wanted(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, wants): the identities that a sample requires, sorted, where it requires any."""
    return c.required(spark, d).groupBy("sample_id").agg(F.array_sort(F.collect_set("identity_id")).alias("wants"))


def image_sets(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, has): the identities that are seen in an image, where any is."""
    return c.image_identity(spark, d).groupBy("image_id").agg(F.collect_set("identity_id").alias("has"))


def indexed_sets(spark: SparkSession, d: str) -> DataFrame:
    """image_sets() by gallery_index. A listed pair that meets them learns what its image holds without the list of all such pairs."""
    return image_sets(spark, d).join(c.gallery(spark, d), "image_id").select(F.col("gallery_pos").alias("gallery_index"), "has")


def holds_all() -> Column:
    """Whether has covers wants; false where either is null."""
    return F.coalesce(F.size(F.array_except("wants", "has")) == 0, F.lit(False)) & F.col("wants").isNotNull() & F.col("has").isNotNull()


def placed_sets(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, split, gallery_pos, has) of the images of a split."""
    return c.images(spark, d).join(image_sets(spark, d), "image_id").select("image_id", "split", "gallery_pos", "has")


def eligible_of_several(scope: DataFrame, items: DataFrame) -> DataFrame:
    """scope with image_id and gallery_pos of each image of the split, but the query image, that holds all of two or more wanted identities.

    scope: sample_id, split, query_image_id, wants. Only images with the rarest of them meet the sample.
    """
    keyed = items.withColumn("key", F.explode("has"))
    frequency = keyed.groupBy("split", "key").agg(F.count(F.lit(1)).alias("n"))
    s = scope.where(F.size("wants") > 1)
    rarest = s.select("sample_id", "split", F.explode("wants").alias("key")).join(frequency, ["split", "key"], "left")
    rarest = rarest.groupBy("sample_id", "split").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("rarest"))
    s = s.join(rarest.where("rarest.n > 0").select("sample_id", "split", F.col("rarest.key").alias("key")), ["sample_id", "split"])
    found = meet(s, keyed, ["split", "key"], "sample_id", "image_id")
    return found.where(holds_all() & ~F.col("image_id").eqNullSafe(F.col("query_image_id"))).drop("key", "has")


def eligible_counts(scope: DataFrame, items: DataFrame) -> DataFrame:
    """(sample_id, split, eligible): how many images of the split, but the query image, hold all wanted identities, where any does.

    Images with one wanted identity are counted once for all samples, so a popular one lists no pairs.
    """
    keyed = items.select("split", F.explode("has").alias("key"))
    frequency = keyed.groupBy("split", "key").agg(F.count(F.lit(1)).alias("eligible"))
    one = scope.where(F.size("wants") == 1).withColumn("key", F.col("wants")[0]).join(frequency, ["split", "key"])
    own = items.select(F.col("image_id").alias("query_image_id"), "split", "has")
    one = one.join(own, ["query_image_id", "split"], "left").select("sample_id", "split", (F.col("eligible") - holds_all().cast("bigint")).alias("eligible"))
    several = eligible_of_several(scope, items).groupBy("sample_id", "split").agg(F.count(F.lit(1)).alias("eligible"))
    return one.where("eligible > 0").unionByName(several)


def identity_positives(spark: SparkSession, d: str) -> DataFrame:
    req, having = scoped_items(spark, d)
    found = division(req.select("qid", "key").distinct(), having)
    found = found.join(scoped_samples(spark, d).select(F.col("sample_id").alias("qid"), "split", "query_image_id"), "qid")
    return found.where("iid <> query_image_id").select(F.col("qid").alias("sample_id"), "split", F.col("iid").alias("image_id"))


def partial_identity_pools(spark: SparkSession, d: str) -> DataFrame:
    req, having = identity_items(spark, d)
    scope = scoped_samples(spark, d).select(F.col("sample_id").alias("qid"), F.col("split").alias("scope"), F.col("query_image_id").alias("own"))
    there = c.images(spark, d).select(F.col("image_id").alias("iid"), F.col("split").alias("scope"))
    found = partial_overlap(req.withColumnRenamed("subject_id", "subject").join(scope, "qid"), having.join(there, "iid"))
    return found.select(
        F.col("qid").alias("sample_id"), F.col("iid").alias("image_id"), "overlap",
        F.array_join("missing", ",").alias("missing_ids"),
        F.array_join(F.transform("missing_subjects", lambda s: s.cast("string")), ",").alias("missing_subjects"),
    )


def key_violations(spark: SparkSession, d: str) -> DataFrame:
    keys = {"images": "image_id", "gallery": "gallery_pos", "head_boxes": "box_id", "samples": "sample_id", "persons": "person_id"}
    parts = [
        duplicate_keys(table(spark, d, t).select(F.col(k).cast("string").alias("key")), "key").withColumn("table_name", F.lit(t))
        for t, k in keys.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "key", "row_count")


def gallery_registry_gaps(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "images").select(c.plain_image(F.col("image_id")).alias("image_id"))
    return key_differences(c.gallery(spark, d), registry, "image_id").withColumn(
        "problem", F.when(F.col("side") == "left", "not registered").otherwise("not in gallery")
    ).select("image_id", "problem")


def split_partition_issues(spark: SparkSession, d: str) -> DataFrame:
    per = c.splits(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("splits"))
    both = c.samples(spark, d).select("sample_id", F.lit(True).alias("known")).join(per, "sample_id", "full")
    code = issues(in_no_split=F.col("splits").isNull(), in_several_splits=F.col("splits") > 1, unknown_sample=F.col("known").isNull())
    return both.select("sample_id", code.alias("issues")).where("issues <> ''")


def sample_issues(spark: SparkSession, d: str) -> DataFrame:
    s = c.samples(spark, d).join(c.required(spark, d).groupBy("sample_id").agg(F.countDistinct("identity_id").alias("n_ids"), F.count(F.lit(1)).alias("n_refs"), F.countDistinct("subject_id").alias("n_subjects")), "sample_id", "left")
    pair = Window.partitionBy("query_image_id", "target_image_id")
    s = s.withColumn("pairs", F.when(F.col("query_image_id").isNotNull() & F.col("target_image_id").isNotNull(), F.count(F.lit(1)).over(pair)))
    code = issues(
        unknown_case=~F.coalesce(F.col("case_type").isin(*c.CASES), F.lit(False)),
        no_query=F.col("query_image_id").isNull(),
        no_target=F.col("target_image_id").isNull(),
        query_is_target=F.col("query_image_id") == F.col("target_image_id"),
        repeated_pair=F.col("pairs") > 1,
        no_identity=F.col("n_ids").isNull(),
        shared_identity=F.col("n_refs") > F.col("n_ids"),
        target_not_positive=~F.array_contains("positives", F.col("target_image_id")),
        query_is_positive=F.array_contains("positives", F.col("query_image_id")),
        case_needs_two=F.col("case_type").isin("DUAL", "RELATIONAL") & (F.col("n_subjects") < 2),
        instruction_differs=F.col("final_instruction") != F.concat("final_desc", F.lit("; "), "final_change", F.lit(".")),
    )
    return s.select("sample_id", code.alias("issues")).where("issues <> ''")


def box_issues(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "head_boxes").select(
        "box_id", c.plain_image(F.col("image_id")).alias("image_id"), c.plain_identity(F.col("identity_id")).alias("identity_id"), "x", "y", "width", "height"
    ).distinct()
    twice = Window.partitionBy("image_id", "identity_id")
    b = b.withColumn("same", F.when(F.col("identity_id").isNotNull() & F.col("image_id").isNotNull(), F.count(F.lit(1)).over(twice)))
    missing = F.col("x").isNull() | F.col("y").isNull() | F.col("width").isNull() | F.col("height").isNull()
    code = issues(
        missing_number=missing, negative_origin=(F.col("x") < 0) | (F.col("y") < 0), empty_size=(F.col("width") <= 0) | (F.col("height") <= 0),
        nobody=F.col("identity_id").isNull(), repeated_identity=F.col("same") > 1,
    )
    return b.select("box_id", code.alias("issues")).where("issues <> ''")


def pair_split_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Ordered (query, target) pairs whose images stand in different splits, or in none."""
    s = c.samples(spark, d).select("sample_id", "query_image_id", "target_image_id")
    i = c.images(spark, d)
    s = s.join(i.select(F.col("image_id").alias("query_image_id"), F.col("split").alias("query_split")), "query_image_id", "left")
    s = s.join(i.select(F.col("image_id").alias("target_image_id"), F.col("split").alias("target_split")), "target_image_id", "left")
    return s.where("query_split IS NULL OR target_split IS NULL OR query_split <> target_split").select("sample_id", "query_split", "target_split")


def positive_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each sample: the target first, then the other identity positives by image id."""
    found = identity_positives(spark, d).join(c.samples(spark, d).select("sample_id", "target_image_id"), "sample_id")
    seed = F.coalesce(F.col("image_id") == F.col("target_image_id"), F.lit(False))
    per = found.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct((~seed).alias("later"), "image_id"))).alias("p"))
    return per.select("sample_id", F.array_join("p.image_id", ",").alias("candidates"), F.size("p").cast("bigint").alias("n"))


def positive_set_issues(spark: SparkSession, d: str) -> DataFrame:
    """Decisions (labelled positives) against the candidates; the normalised set keeps the order of the candidates."""
    tasks = positive_tasks(spark, d).withColumn("cand", F.split("candidates", ","))
    s = c.samples(spark, d).select("sample_id", "target_image_id", "positives").join(tasks, "sample_id")
    kept = F.filter("cand", lambda x: F.array_contains(F.col("positives"), x))
    code = issues(
        empty=F.size("positives") == 0,
        not_candidate=F.size(F.array_except("positives", "cand")) > 0,
        seed_missing=~F.array_contains("positives", F.col("target_image_id")),
    )
    return s.select("sample_id", F.array_join(kept, ",").alias("normalized"), code.alias("issues"))


def completion_flags(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with whether somebody has decided: any candidate of the sample has a scored ranking row."""
    decided = table(spark, d, "rankings").where("scored_at IS NOT NULL").select("sample_id", F.lit(True).alias("d")).distinct()
    tasks = c.samples(spark, d).select("sample_id", "annotator").join(decided, "sample_id", "left")
    return tasks.groupBy("annotator").agg(F.count(F.lit(1)).alias("tasks"), F.count("d").alias("completed"))


def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events up to the middle day as catalog, all later ones as prepared batch, latest event per user."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.to_date("ts").alias("day"))
    low, high = e.agg(F.min("day"), F.max("day")).first()
    middle = F.lit(low + (high - low) / 2 if low else None).cast("date")

    def side(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("e"))
        return last.select("user_id", F.col("e.event_id").alias("pos"), F.col("e.event_type").alias("event_type"), F.col("e.value").alias("value"))

    return keyed_upsert(side(e.where(F.col("day") <= middle)), side(e.where(F.col("day") > middle)), "user_id", "pos")


def identity_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of identities in first-seen order by gallery position."""
    first = c.image_identity(spark, d).join(c.gallery(spark, d), "image_id").groupBy("identity_id").agg(F.min("gallery_pos").alias("first_pos"))
    return audit.dense_ids(first, ["first_pos", "identity_id"], "label").select("identity_id", "first_pos", "label")


def label_classes(spark: SparkSession, d: str) -> DataFrame:
    """(split, sample_id, class_key, query_image_id, positives): samples of one class ask the same of the same people in one split.

    The key holds the case, the subjects in their order with their identities, and the change; positives are those of the
    split's gallery.
    """
    s = c.samples(spark, d).join(c.splits(spark, d), "sample_id")
    who = F.transform("subjects", lambda x: F.concat_ws(":", x["subject_id"].cast("string"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(x["identity_ids"], c.plain_identity)))), ",")))
    s = s.withColumn("class_key", F.md5(F.concat_ws("|", "split", F.coalesce("case_type", F.lit("-")), F.array_join(who, ";"), F.coalesce("final_change", F.lit("-")))))
    inside = s.select("sample_id", "split", F.explode("positives").alias("image_id")).join(c.images(spark, d).select("image_id", "split"), ["image_id", "split"], "left_semi")
    inside = inside.groupBy("sample_id", "split").agg(F.collect_set("image_id").alias("inside"))  # a sample's own list bounds it
    s = s.drop("positives").join(inside, ["sample_id", "split"], "left")
    return s.select("split", "sample_id", "class_key", "query_image_id", F.coalesce("inside", F.array().cast("array<string>")).alias("positives"))


def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return audit.disputed(label_classes(spark, d))


def negative_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Disputed images of each query's class but its own positives and its own image: never negatives of this query."""
    s = cut(label_classes(spark, d))
    bad = audit.disputed(s).select("class_key", "image_id")
    open_ = s.join(bad, "class_key").where(~F.array_contains("positives", F.col("image_id")) & ~F.col("image_id").eqNullSafe(F.col("query_image_id")))
    return open_.select("sample_id", "image_id").distinct()


def split_stats(spark: SparkSession, d: str) -> DataFrame:
    scope = scoped_samples(spark, d)
    queries = scope.groupBy("split").agg(
        F.count(F.lit(1)).alias("queries"), *[F.count(F.when(F.col("case_type") == x, 1)).alias(f"n_{x.lower()}") for x in c.CASES]
    )
    sizes = c.images(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("gallery_size"))
    people = c.images(spark, d).join(c.image_identity(spark, d), "image_id").select("split", "identity_id").distinct()
    shared = people.groupBy("identity_id").agg(F.count(F.lit(1)).alias("in_splits"))
    people = people.join(shared, "identity_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("identities"), F.count(F.when(F.col("in_splits") > 1, 1)).alias("shared_identities")
    )
    return queries.join(sizes, "split").join(people, "split")


def detection_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Required identities that have a box in their query image, by split and case, with totals."""
    req = scoped_samples(spark, d).join(c.required(spark, d).select("sample_id", "identity_id").distinct(), "sample_id")
    seen = c.image_identity(spark, d).select(F.col("image_id").alias("query_image_id"), "identity_id", F.lit(1).alias("seen"))
    both = req.join(seen, ["query_image_id", "identity_id"], "left")
    both = both.withColumn("case_type", F.coalesce("case_type", F.lit("NONE")))
    rolled = both.rollup("split", "case_type").agg(F.count(F.lit(1)).alias("required"), F.count("seen").alias("detected"))
    return rolled.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("case_type", F.lit("overall")).alias("case_type"), "required", "detected")


def review_catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stand-ins for the annotation tool's files: (sample_id, image_id, candidate) and (sample_id, has_decision).

    A ranked sample has a task, whose candidates are its target and its ranked images; it is decided once any of them has
    been scored, and the decision names the labelled positives among the candidates.
    """
    at = c.gallery(spark, d).select("image_id", F.col("gallery_pos").alias("gallery_index"))
    r = table(spark, d, "rankings").where("sample_id IS NOT NULL")
    tasks = r.groupBy("sample_id").agg((F.count("scored_at") > 0).alias("has_decision"))
    ranked = r.select("sample_id", "gallery_index").distinct().join(at, "gallery_index").select("sample_id", "image_id")
    seeds = tasks.join(c.samples(spark, d).select("sample_id", F.col("target_image_id").alias("image_id")), "sample_id").where("image_id IS NOT NULL")
    return ranked.unionByName(seeds.select("sample_id", "image_id")), tasks


def positive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, split, image_id, eligible, positive, full, registered, fits, candidate) of all labelled and catalogued pairs, one row each."""
    s = c.samples(spark, d).join(c.splits(spark, d), "sample_id").select("sample_id", "split", "query_image_id", "positives")
    positive = s.select("sample_id", "split", F.explode("positives").alias("image_id"), F.lit("positive").alias("what"))
    candidates = review_catalog(spark, d)[0].join(s.select("sample_id", "split"), "sample_id").select("sample_id", "split", "image_id", F.lit("candidate").alias("what"))
    flag = lambda name: F.max(F.col("what") == name).alias(name)
    pairs = positive.unionByName(candidates).groupBy("sample_id", "split", "image_id").agg(flag("positive"), flag("candidate"))
    known = c.images(spark, d).select("image_id", F.col("split").alias("image_split")).join(image_sets(spark, d), "image_id", "full")
    pairs = pairs.join(known, "image_id", "left").join(s.select("sample_id", "split", "query_image_id"), ["sample_id", "split"]).join(wanted(spark, d), "sample_id", "left")
    inside = F.coalesce(F.col("image_split") == F.col("split"), F.lit(False))
    # an image fits a sample that requires nothing, but is not eligible for it
    return pairs.select(
        "sample_id", "split", "image_id", (holds_all() & inside & ~F.col("image_id").eqNullSafe(F.col("query_image_id"))).alias("eligible"), "positive",
        (F.col("positive") & inside).alias("full"), (F.col("positive") & F.col("image_split").isNotNull()).alias("registered"),
        (holds_all() | F.col("wants").isNull()).alias("fits"), "candidate",
    )


def positive_scope_audit(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each sample of a split against all images that hold its identities: codes, scope of the review, counts.

    issues are faults of the labels themselves, source_issues of the review's files. A review that is neither faulty nor
    missing is complete if its catalog holds all eligible images, else partial; only then the images that it shows and
    nobody chose count as negatives. Only labelled and catalogued pairs are listed; eligible images are counted by identity.
    """
    pairs = positive_pairs(spark, d)
    n = lambda condition: F.count(F.when(F.expr(condition), 1))
    counts = pairs.groupBy("sample_id", "split").agg(
        n("full").alias("full_positives"), n("positive AND NOT full").alias("out_of_split"), n("positive AND NOT registered").alias("unregistered"),
        n("positive AND NOT fits").alias("invalid_identity"), n("eligible AND candidate").alias("catalogued"), n("eligible AND full").alias("chosen"),
        n("eligible AND (full OR candidate)").alias("settled"), n("eligible AND candidate AND NOT full").alias("shown"), n("full AND NOT candidate").alias("undecided"),
    )
    req = c.required(spark, d).select("sample_id", "identity_id").distinct()
    need = req.groupBy("sample_id").agg(F.count(F.lit(1)).alias("need"))
    s = c.samples(spark, d).select("sample_id", "query_image_id", "target_image_id", "positives", "positive_refs").join(c.splits(spark, d), "sample_id")
    on_query = s.select("sample_id", F.col("query_image_id").alias("image_id")).distinct().join(req, "sample_id").join(c.image_identity(spark, d), ["image_id", "identity_id"])
    on_query = on_query.groupBy("sample_id").agg(F.count(F.lit(1)).alias("on_query"))
    i = c.images(spark, d).select("image_id", "split", F.lit(True).alias("there"))
    q = i.select(F.col("image_id").alias("query_image_id"), "split", F.col("there").alias("query_in"))
    t = i.select(F.col("image_id").alias("target_image_id"), "split", F.col("there").alias("seed_in"))
    scope = s.select("sample_id", "split", "query_image_id").join(wanted(spark, d), "sample_id")
    eligible = eligible_counts(scope, cut(placed_sets(spark, d)))
    s = s.join(counts, ["sample_id", "split"], "left").join(eligible, ["sample_id", "split"], "left").join(need, "sample_id", "left").join(on_query, "sample_id", "left")
    s = s.join(q, ["query_image_id", "split"], "left").join(t, ["target_image_id", "split"], "left").join(review_catalog(spark, d)[1], "sample_id", "left")
    names = ["eligible", "full_positives", "out_of_split", "unregistered", "invalid_identity", "catalogued", "chosen", "settled", "shown", "undecided", "need", "on_query"]
    s = s.withColumns({x: F.coalesce(x, F.lit(0)) for x in names})
    s = s.withColumns({x: F.col("eligible") - F.col(y) for x, y in (("uncatalogued", "catalogued"), ("open_all", "chosen"), ("open_uncatalogued", "settled"))})
    labelled_seed = F.coalesce(F.array_contains("positives", F.col("target_image_id")), F.lit(False))
    code = issues(
        empty_required_identities=F.col("need") == 0, query_outside_split=F.col("query_in").isNull(), query_missing_required_identities=F.col("on_query") < F.col("need"),
        seed_outside_split=F.col("seed_in").isNull(), missing_seed_positive=~labelled_seed | F.col("seed_in").isNull(), empty_split_positive_set=F.col("full_positives") == 0,
        duplicate_positive_ids=F.col("positive_refs") > F.size("positives"), self_positive=F.array_contains("positives", F.col("query_image_id")),
        unregistered_positive_ids=F.col("unregistered") > 0, positive_missing_required_identities=F.col("invalid_identity") > 0,
    )
    source = issues(invalid_decision=F.col("has_decision") & ~labelled_seed, decision_differs_from_final=F.col("has_decision") & labelled_seed & (F.col("undecided") > 0))
    s = s.withColumn("issues", code).withColumn("source_issues", source)
    status = F.when(F.col("source_issues") != "", "stale").when(~F.coalesce("has_decision", F.lit(False)), "unknown")
    s = s.withColumn("status", status.when(F.col("uncatalogued") == 0, "complete_catalog").otherwise("partial_catalog"))
    reviewed = F.col("status").isin("complete_catalog", "partial_catalog")
    return s.select(
        "sample_id", "split", "issues", "source_issues", "status", "eligible", "full_positives", "out_of_split", "invalid_identity",
        F.when(reviewed, F.col("uncatalogued")).otherwise(F.col("eligible")).alias("missing_catalog"),
        F.when(reviewed, F.col("open_uncatalogued")).otherwise(F.col("open_all")).alias("unconfirmed"),
        F.when(reviewed, F.col("shown")).otherwise(F.lit(0)).cast("bigint").alias("catalog_negatives"),
    )


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of samples without label faults whose review is not complete or disputed: the target first, then eligible images by gallery position.

    Without label faults the target and the query image stand in the split and hold all required identities. So the place
    of an image for a sample that requires one identity is its place among all images with that one, moved by those two:
    images are numbered once per identity, and the pairs go from their join to the result.
    """
    classes = cut(label_classes(spark, d))
    disputed = classes.join(audit.disputed(classes).select("class_key", "image_id"), "class_key").where(~F.col("image_id").eqNullSafe(F.col("query_image_id")))
    disputed = disputed.select("sample_id", "split", F.lit(True).alias("disputed")).distinct()
    open_ = positive_scope_audit(spark, d).where("issues = ''").join(disputed, ["sample_id", "split"], "left")
    open_ = open_.where("status <> 'complete_catalog' OR disputed").select("sample_id", "split")
    asked = c.samples(spark, d).select("sample_id", "query_image_id", "target_image_id").join(wanted(spark, d), "sample_id")
    open_ = cut(open_.join(asked, "sample_id"))
    seeds = open_.select("sample_id", "split", F.col("target_image_id").alias("image_id"), F.lit(1).cast("bigint").alias("queue_pos"))
    items = cut(placed_sets(spark, d))
    one = open_.where(F.size("wants") == 1).withColumn("key", F.concat_ws("|", "split", F.col("wants")[0])).drop("wants")
    keyed = items.select("image_id", "gallery_pos", F.explode("has").alias("key"), "split").withColumn("key", F.concat_ws("|", "split", "key")).drop("split")
    keyed = keyed.join(one.select("key").distinct(), "key", "left_semi")
    numbered = cut(audit.running_total(keyed, "key", ["gallery_pos", "image_id"], F.lit(1).cast("bigint"), "place"))
    for x in ("query", "target"):
        one = one.join(numbered.select("key", F.col("image_id").alias(f"{x}_image_id"), F.col("place").alias(f"{x}_place")), ["key", f"{x}_image_id"])
    found = meet(one, numbered.select("key", "image_id", "place"), ["key"], "sample_id", "image_id")
    found = found.where("image_id <> query_image_id AND image_id <> target_image_id")
    earlier = F.expr("cast(query_place < place AS int) + cast(target_place < place AS int)")
    found = found.select("sample_id", "split", "image_id", (F.col("place") - earlier + 2).alias("queue_pos"))
    several = eligible_of_several(open_, items).where("image_id <> target_image_id").withColumn("task", F.concat_ws("|", "split", "sample_id"))
    several = audit.running_total(several.select("sample_id", "split", "image_id", "gallery_pos", "task"), "task", ["gallery_pos"], F.lit(1).cast("bigint"), "before")
    return seeds.unionByName(found).unionByName(several.select("sample_id", "split", "image_id", (F.col("before") + 2).alias("queue_pos")))


def final_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples that pass every check, joined with their split; the split of the query image decides."""
    bad = sample_issues(spark, d).where(~F.col("issues").isin("repeated_pair")).select("sample_id")
    ok = c.samples(spark, d).join(bad, "sample_id", "left_anti")
    i = c.images(spark, d).select(F.col("image_id").alias("query_image_id"), "split")
    return ok.join(i, "query_image_id").select("sample_id", "split", "case_type", F.size("positives").cast("bigint").alias("positives"))


QUERIES = {
    f.__name__: f
    for f in (
        split_gallery, split_scoped_positives, public_samples, required_identities, case_subjects, identity_positives,
        partial_identity_pools, key_violations, gallery_registry_gaps, split_partition_issues, sample_issues, box_issues,
        pair_split_conflicts, positive_tasks, positive_set_issues, completion_flags, catalog_upsert, identity_vocabulary,
        label_conflicts, negative_exclusions, split_stats, detection_coverage, positive_scope_audit, review_queue, final_samples,
    )
}

_SCOPE = """scope AS (SELECT s.sample_id, p.split, s.case_type, s.query_image_id FROM smp s JOIN spl p USING (sample_id)
    JOIN img i ON i.image_id = s.query_image_id AND i.split = p.split)"""
_IDPOS = _SCOPE + """,
need AS (SELECT sample_id, count(DISTINCT identity_id) AS n FROM req GROUP BY 1),
idpos AS (SELECT s.sample_id, s.split, i.image_id FROM scope s JOIN (SELECT DISTINCT sample_id, identity_id FROM req) r USING (sample_id)
    JOIN ii USING (identity_id) JOIN img i ON i.image_id = ii.image_id AND i.split = s.split JOIN need n ON n.sample_id = s.sample_id
    WHERE i.image_id <> s.query_image_id GROUP BY s.sample_id, s.split, i.image_id, n.n HAVING count(*) = n.n)"""
_ALL = ("gal", "img", "ii", "smp", "pos_at", "req", "spl")
_CODES = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def _codes(**conditions: str) -> str:
    return _CODES.format(", ".join(f"CASE WHEN {sql} THEN '{code}' END" for code, sql in sorted(conditions.items())))


_SAMPLE_ISSUES = f"""counts AS (SELECT sample_id, count(DISTINCT identity_id) AS n_ids, count(*) AS n_refs, count(DISTINCT subject_id) AS n_subjects FROM req GROUP BY 1),
pl AS (SELECT sample_id, list(image_id) AS p FROM pos_at GROUP BY 1),
pr AS (SELECT query_image_id AS q, target_image_id AS t, count(*) AS n FROM smp GROUP BY ALL),
bad AS (SELECT sample_id, {_codes(
    unknown_case="case_type IS NULL OR case_type NOT IN ('INDIVIDUAL', 'GROUP', 'DUAL', 'RELATIONAL')",
    no_query='query_image_id IS NULL', no_target='target_image_id IS NULL', query_is_target='query_image_id = target_image_id',
    repeated_pair='pr.n > 1', no_identity='n_ids IS NULL', shared_identity='n_refs > n_ids',
    target_not_positive='target_image_id IS NOT NULL AND NOT list_contains(coalesce(p, []), target_image_id)',
    query_is_positive='query_image_id IS NOT NULL AND list_contains(coalesce(p, []), query_image_id)',
    case_needs_two="case_type IN ('DUAL', 'RELATIONAL') AND n_subjects < 2",
    instruction_differs="final_instruction <> final_desc || '; ' || final_change || '.'",
)} AS issues FROM smp LEFT JOIN counts USING (sample_id) LEFT JOIN pl USING (sample_id)
    LEFT JOIN pr ON pr.q = query_image_id AND pr.t = target_image_id)"""
_WHO = f"""array_to_string(list_transform(subjects, lambda s: s.subject_id::VARCHAR || ':' || array_to_string(list_sort(list_distinct(list_filter(
    list_transform(s.identity_ids, lambda x: {c.sql_identity('x')}), lambda y: y IS NOT NULL))), ',')), ';')"""
_VOTES = f"""key AS (SELECT sample_id, split, query_image_id, md5(split || '|' || coalesce(case_type, '-') || '|' || {_WHO} || '|' || coalesce(final_change, '-')) AS class_key FROM smp JOIN spl USING (sample_id)),
named AS (SELECT DISTINCT k.class_key, k.sample_id, k.split, p.image_id FROM key k JOIN pos_at p USING (sample_id) JOIN img i ON i.image_id = p.image_id AND i.split = k.split),
votes AS (SELECT k.class_key, k.sample_id, x.image_id, n.image_id IS NOT NULL AS vote FROM key k JOIN (SELECT DISTINCT class_key, image_id FROM named) x USING (class_key)
    LEFT JOIN named n ON n.sample_id = k.sample_id AND n.class_key = k.class_key AND n.image_id = x.image_id WHERE x.image_id IS DISTINCT FROM k.query_image_id),
disputed AS (SELECT class_key, image_id, count(*) FILTER (WHERE vote) AS yes, count(*) FILTER (WHERE NOT vote) AS no FROM votes GROUP BY ALL HAVING yes > 0 AND no > 0),
excluded AS (SELECT DISTINCT sample_id, image_id FROM votes JOIN disputed USING (class_key, image_id) WHERE NOT vote)"""
_AUDIT = f"""task AS (SELECT sample_id, count(scored_at) > 0 AS decided FROM rankings WHERE sample_id IS NOT NULL GROUP BY 1),
cat AS (SELECT DISTINCT r.sample_id, image_id FROM rankings r JOIN gal g ON g.gallery_pos = r.gallery_index WHERE r.sample_id IS NOT NULL
    UNION SELECT sample_id, target_image_id FROM task JOIN smp USING (sample_id) WHERE target_image_id IS NOT NULL),
wants AS (SELECT sample_id, list(DISTINCT identity_id) AS w FROM req GROUP BY 1), has AS (SELECT image_id, list(identity_id) AS h FROM ii GROUP BY 1),
listed AS (SELECT sample_id, list(image_id) AS p FROM pos_at GROUP BY 1), shown AS (SELECT sample_id, list(image_id) AS k FROM cat GROUP BY 1),
able AS (SELECT s.sample_id, s.split, list(i.image_id) AS e FROM (SELECT sample_id, split, query_image_id, w FROM smp JOIN spl USING (sample_id) JOIN wants USING (sample_id)) s
    JOIN img i ON i.split = s.split AND i.image_id IS DISTINCT FROM s.query_image_id JOIN has USING (image_id) WHERE list_has_all(h, w) GROUP BY ALL),
one AS (SELECT s.sample_id, p.split, s.query_image_id AS q, s.target_image_id AS t, coalesce(w, []) AS w, coalesce(e, []) AS e, coalesce(l.p, []) AS p, coalesce(k, []) AS k, decided,
    len(list_filter(list_transform(positive_image_ids, lambda x: {c.sql_image('x')}), lambda y: y IS NOT NULL)) AS refs, coalesce(qh.h, []) AS qh
    FROM smp s JOIN spl p USING (sample_id) LEFT JOIN wants USING (sample_id) LEFT JOIN able a ON a.sample_id = s.sample_id AND a.split = p.split LEFT JOIN listed l ON l.sample_id = s.sample_id
    LEFT JOIN shown USING (sample_id) LEFT JOIN task USING (sample_id) LEFT JOIN has qh ON qh.image_id = s.query_image_id),
lab AS (SELECT o.sample_id, o.split, count(i.image_id) AS registered, count(*) FILTER (WHERE i.split = o.split) AS inside, count(*) FILTER (WHERE NOT list_has_all(coalesce(h, []), w)) AS misfit,
    list(u.image_id) FILTER (WHERE i.split = o.split) AS f FROM one o, unnest(o.p) u(image_id) LEFT JOIN img i ON i.image_id = u.image_id LEFT JOIN has ON has.image_id = u.image_id GROUP BY ALL),
two AS (SELECT o.*, coalesce(registered, 0) AS registered, coalesce(inside, 0) AS inside, coalesce(misfit, 0) AS misfit, coalesce(f, []) AS f, qi.image_id IS NOT NULL AS query_in, ti.image_id IS NOT NULL AS seed_in, list_contains(p, t) AS seed_named
    FROM one o LEFT JOIN lab USING (sample_id, split) LEFT JOIN img qi ON qi.image_id = q AND qi.split = o.split LEFT JOIN img ti ON ti.image_id = t AND ti.split = o.split),
three AS (SELECT *, {_codes(empty_required_identities='len(w) = 0', query_outside_split='NOT query_in', query_missing_required_identities='NOT list_has_all(qh, w)', seed_outside_split='NOT seed_in',
    missing_seed_positive='NOT coalesce(list_contains(f, t), false)', empty_split_positive_set='inside = 0', duplicate_positive_ids='coalesce(refs, 0) > len(p)', self_positive='coalesce(list_contains(p, q), false)',
    unregistered_positive_ids='registered < len(p)', positive_missing_required_identities='misfit > 0')} AS issues,
    {_codes(invalid_decision='coalesce(decided, false) AND NOT coalesce(seed_named, false)', decision_differs_from_final='coalesce(decided, false) AND coalesce(seed_named, false) AND NOT list_has_all(k, f)')} AS source_issues FROM two),
audit AS MATERIALIZED (SELECT sample_id, split, issues, source_issues, CASE WHEN source_issues <> '' THEN 'stale' WHEN NOT coalesce(decided, false) THEN 'unknown' WHEN list_has_all(k, e) THEN 'complete_catalog' ELSE 'partial_catalog' END AS status,
    t, e, f, CASE WHEN status IN ('complete_catalog', 'partial_catalog') THEN list_filter(e, lambda x: list_contains(k, x)) ELSE [] END AS scope, len(p) AS labelled, inside, misfit FROM three)"""

ORACLE = {
    "split_gallery": with_cte("gal", "img") + """SELECT split, image_id, row_number() OVER (PARTITION BY split ORDER BY gallery_pos, image_id) AS split_pos
        FROM img WHERE split IN ('train', 'val', 'test')""",
    "split_scoped_positives": with_cte(*_ALL, more=_SCOPE) + """SELECT sample_id, split, string_agg(image_id, ',' ORDER BY i) AS positives
        FROM (SELECT s.sample_id, s.split, p.image_id, p.i FROM scope s JOIN pos_at p USING (sample_id)) WHERE (image_id, split) IN (SELECT image_id, split FROM img)
        GROUP BY sample_id, split""",
    "public_samples": with_cte("smp") + """SELECT sample_id, case_type, query_image_id,
        array_to_string(list_transform(subjects, lambda s: s.subject_id::VARCHAR), ',') AS subject_ids, final_desc, final_change, final_instruction FROM smp""",
    "required_identities": with_cte("smp", "req") + """SELECT sample_id, subject_id, string_agg(identity_id, ',' ORDER BY identity_id) AS identity_ids,
        count(*) AS n FROM req GROUP BY ALL""",
    "case_subjects": with_cte("smp", "req") + """SELECT case_type, CASE WHEN s > 1 THEN CASE WHEN case_type = 'RELATIONAL' THEN 'RELATIONAL' ELSE 'DUAL' END
        WHEN i > 1 THEN 'GROUP' ELSE 'INDIVIDUAL' END AS inferred_case, count(*) AS samples FROM smp JOIN (SELECT sample_id, count(DISTINCT subject_id) AS s,
        count(DISTINCT identity_id) AS i FROM req GROUP BY 1) USING (sample_id) GROUP BY ALL""",
    "identity_positives": with_cte(*_ALL, more=_IDPOS) + "SELECT * FROM idpos",
    "partial_identity_pools": with_cte(*_ALL, more=_IDPOS) + """, r AS (SELECT DISTINCT sample_id, identity_id FROM req),
        hits AS (SELECT s.sample_id, i.image_id, count(*) AS overlap FROM scope s JOIN r USING (sample_id) JOIN ii USING (identity_id)
          JOIN img i ON i.image_id = ii.image_id AND i.split = s.split JOIN need n ON n.sample_id = s.sample_id
          WHERE i.image_id <> s.query_image_id GROUP BY s.sample_id, i.image_id, n.n HAVING count(*) < n.n)
        SELECT sample_id, image_id, overlap,
          (SELECT string_agg(DISTINCT q.identity_id, ',' ORDER BY q.identity_id) FROM req q WHERE q.sample_id = h.sample_id AND NOT EXISTS
            (SELECT 1 FROM ii WHERE ii.image_id = h.image_id AND ii.identity_id = q.identity_id)) AS missing_ids,
          coalesce((SELECT string_agg(subject_id::VARCHAR, ',' ORDER BY subject_id) FROM (SELECT q.subject_id FROM req q LEFT JOIN ii ON ii.image_id = h.image_id
            AND ii.identity_id = q.identity_id WHERE q.sample_id = h.sample_id GROUP BY q.subject_id HAVING count(ii.identity_id) = 0)), '') AS missing_subjects FROM hits h""",
    "key_violations": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {k}::VARCHAR AS key, count(*) AS row_count FROM {t} GROUP BY {k} HAVING count(*) > 1"
        for t, k in {"images": "image_id", "gallery": "gallery_pos", "head_boxes": "box_id", "samples": "sample_id", "persons": "person_id"}.items()
    ),
    "gallery_registry_gaps": with_cte("gal") + f""", reg AS (SELECT DISTINCT {c.sql_image('image_id')} AS image_id FROM images)
        SELECT image_id, 'not registered' AS problem FROM gal WHERE image_id NOT IN (SELECT image_id FROM reg WHERE image_id IS NOT NULL)
        UNION ALL SELECT image_id, 'not in gallery' FROM reg WHERE image_id NOT IN (SELECT image_id FROM gal)""",
    "split_partition_issues": with_cte("smp", "spl") + f"""SELECT * FROM (SELECT coalesce(s.sample_id, p.sample_id) AS sample_id,
        {_codes(in_no_split='n IS NULL', in_several_splits='n > 1', unknown_sample='s.sample_id IS NULL')} AS issues
        FROM smp s FULL JOIN (SELECT sample_id, count(*) AS n FROM spl GROUP BY 1) p ON s.sample_id = p.sample_id) WHERE issues <> ''""",
    "sample_issues": with_cte("smp", "pos_at", "req", more=_SAMPLE_ISSUES) + "SELECT * FROM bad WHERE issues <> ''",
    "box_issues": f"""WITH b AS (SELECT DISTINCT box_id, {c.sql_image('image_id')} AS image_id, {c.sql_identity('identity_id')} AS identity_id, x, y, width, height FROM head_boxes),
        t AS (SELECT image_id, identity_id, count(*) AS n FROM b GROUP BY ALL)
        SELECT * FROM (SELECT box_id, {_codes(missing_number='x IS NULL OR y IS NULL OR width IS NULL OR height IS NULL', negative_origin='x < 0 OR y < 0',
        empty_size='width <= 0 OR height <= 0', nobody='b.identity_id IS NULL', repeated_identity='t.n > 1')} AS issues
        FROM b LEFT JOIN t ON b.image_id = t.image_id AND b.identity_id = t.identity_id) WHERE issues <> ''""",
    "pair_split_conflicts": with_cte("gal", "img", "smp") + """SELECT sample_id, q.split AS query_split, t.split AS target_split FROM smp LEFT JOIN img q ON q.image_id = query_image_id
        LEFT JOIN img t ON t.image_id = target_image_id WHERE q.split IS NULL OR t.split IS NULL OR q.split <> t.split""",
    "positive_tasks": with_cte(*_ALL, more=_IDPOS) + """SELECT sample_id, string_agg(image_id, ',' ORDER BY (image_id IS NOT DISTINCT FROM target_image_id) DESC, image_id) AS candidates,
        count(*) AS n FROM idpos JOIN smp USING (sample_id) GROUP BY sample_id""",
    "positive_set_issues": with_cte(*_ALL, more=_IDPOS) + f""", t AS (SELECT sample_id, list(image_id ORDER BY (image_id IS NOT DISTINCT FROM target_image_id) DESC, image_id) AS cand
          FROM idpos JOIN smp USING (sample_id) GROUP BY sample_id), pl AS (SELECT sample_id, list(image_id) AS p0 FROM pos_at GROUP BY 1),
        j AS (SELECT sample_id, cand, coalesce(p0, []) AS p, target_image_id FROM smp JOIN t USING (sample_id) LEFT JOIN pl USING (sample_id))
        SELECT sample_id, array_to_string(list_filter(cand, lambda x: list_contains(p, x)), ',') AS normalized, {_codes(empty='len(p) = 0',
        not_candidate='len(list_filter(p, lambda x: NOT list_contains(cand, x))) > 0', seed_missing='target_image_id IS NOT NULL AND NOT list_contains(p, target_image_id)')} AS issues FROM j""",
    "completion_flags": with_cte("smp") + """SELECT annotator, count(*) AS tasks, count(r.sample_id) AS completed FROM smp
        LEFT JOIN (SELECT DISTINCT sample_id FROM rankings WHERE scored_at IS NOT NULL) r USING (sample_id) GROUP BY annotator""",
    "catalog_upsert": """WITH e AS (SELECT *, ts::DATE AS day FROM events), m AS (SELECT min(day) + ((max(day) - min(day)) // 2)::INT AS middle FROM e),
        o AS (SELECT user_id, max(event_id) AS pos, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM e, m WHERE day <= middle GROUP BY 1),
        n AS (SELECT user_id, max(event_id) AS pos, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM e, m WHERE day > middle GROUP BY 1)
        SELECT user_id, CASE WHEN n.pos IS NOT NULL THEN n.event_type ELSE o.event_type END AS event_type, CASE WHEN n.pos IS NOT NULL THEN n.value ELSE o.value END AS value,
        o.pos IS NULL AS is_new, coalesce(o.pos, n.pos) AS pos FROM o FULL JOIN n USING (user_id)""",
    "identity_vocabulary": with_cte("gal", "ii") + """SELECT identity_id, first_pos, row_number() OVER (ORDER BY first_pos, identity_id) - 1 AS label
        FROM (SELECT identity_id, min(gallery_pos) AS first_pos FROM ii JOIN gal USING (image_id) GROUP BY 1)""",
    "label_conflicts": with_cte(*_ALL, more=_VOTES) + "SELECT class_key, image_id, yes, no FROM disputed",
    "negative_exclusions": with_cte(*_ALL, more=_VOTES) + "SELECT * FROM excluded",
    "split_stats": with_cte(*_ALL, more=_SCOPE) + """, people AS (SELECT DISTINCT split, identity_id FROM img JOIN ii USING (image_id)),
        shared AS (SELECT identity_id, count(*) AS k FROM people GROUP BY 1)
        SELECT * FROM (SELECT split, count(*) AS queries, count(*) FILTER (WHERE case_type = 'INDIVIDUAL') AS n_individual, count(*) FILTER (WHERE case_type = 'GROUP') AS n_group,
          count(*) FILTER (WHERE case_type = 'DUAL') AS n_dual, count(*) FILTER (WHERE case_type = 'RELATIONAL') AS n_relational FROM scope GROUP BY split)
        JOIN (SELECT split, count(*) AS gallery_size FROM img GROUP BY split) USING (split)
        JOIN (SELECT split, count(*) AS identities, count(*) FILTER (WHERE k > 1) AS shared_identities FROM people JOIN shared USING (identity_id) GROUP BY split) USING (split)""",
    "detection_coverage": with_cte(*_ALL, more=_SCOPE) + """, r AS (SELECT DISTINCT sample_id, identity_id FROM req),
        j AS (SELECT split, coalesce(case_type, 'NONE') AS case_type, ii.identity_id AS seen FROM scope JOIN r USING (sample_id)
          LEFT JOIN ii ON ii.image_id = query_image_id AND ii.identity_id = r.identity_id)
        SELECT coalesce(split, 'all') AS split, coalesce(case_type, 'overall') AS case_type, count(*) AS required, count(seen) AS detected FROM j GROUP BY ROLLUP (split, case_type)""",
    "positive_scope_audit": with_cte(*_ALL, more=_AUDIT) + """SELECT sample_id, split, issues, source_issues, status, len(e) AS eligible, inside AS full_positives, labelled - inside AS out_of_split, misfit AS invalid_identity,
        len(e) - len(scope) AS missing_catalog, len(list_filter(e, lambda x: NOT list_contains(f, x) AND NOT list_contains(scope, x))) AS unconfirmed,
        len(list_filter(scope, lambda x: NOT list_contains(f, x))) AS catalog_negatives FROM audit""",
    "review_queue": with_cte(*_ALL, more=f"{_AUDIT}, {_VOTES}") + """, bad AS (SELECT DISTINCT k.sample_id, k.split FROM key k JOIN disputed d USING (class_key) WHERE d.image_id IS DISTINCT FROM k.query_image_id),
        todo AS (SELECT * FROM audit WHERE issues = '' AND (status <> 'complete_catalog' OR (sample_id, split) IN (SELECT sample_id, split FROM bad))),
        rows_ AS (SELECT sample_id, split, t, unnest(list_distinct(list_append(e, t))) AS image_id FROM todo)
        SELECT sample_id, split, image_id, row_number() OVER (PARTITION BY sample_id, split ORDER BY image_id = t DESC, gallery_pos) AS queue_pos FROM rows_ JOIN gal USING (image_id)""",
    "final_samples": with_cte("gal", "img", "smp", "pos_at", "req", more=_SAMPLE_ISSUES) + """SELECT s.sample_id, split, case_type, coalesce(len(p), 0) AS positives
        FROM smp s JOIN img ON img.image_id = s.query_image_id LEFT JOIN pl USING (sample_id) JOIN bad USING (sample_id) WHERE issues IN ('', 'repeated_pair')""",
}
