"""Person-level matching between query images and shortlisted images, over persons and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions import geometry as g
from setlens.functions import vectors as v
from setlens.operators import matching as m
from setlens.plans import catalog as c
from setlens.plans import retrieval
from setlens.plans.catalog import with_cte
from setlens.shared import cut, table

SELECTION, IDENTITY, PENALTY, TOKENS, TOP = 0.5, 0.2, 1.1, 4, 6


def persons(spark: SparkSession, d: str) -> DataFrame:
    """(gallery_index, person_id, vec, box columns) of persons with a usable vector."""
    p = table(spark, d, "persons").where("size(identity_vec) = 64 AND forall(identity_vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30) AND exists(identity_vec, x -> x <> 0)")
    p = p.select(c.plain_image(F.col("image_id")).alias("image_id"), "person_id", F.col("identity_vec").alias("vec"), *[F.col(x).cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")]).distinct()
    return p.join(c.gallery(spark, d), "image_id").select(F.col("gallery_pos").alias("gallery_index"), "person_id", "vec", v.norm(F.col("vec")).alias("norm"), "x1", "y1", "x2", "y2")


def query_persons(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, q, vec, logits): persons of the query image with a logit per active subject, taken from the vector."""
    active = c.required(spark, d).select("sample_id", "subject_id").distinct()
    q = c.scored(spark, d).select("sample_id", F.col("query_index").alias("gallery_index")).distinct()
    q = q.join(persons(spark, d), "gallery_index").join(active, "sample_id")
    logit = F.round(6 * F.element_at(v.doubles(F.col("vec")), F.col("subject_id").cast("int") + 1), 6)
    per = q.groupBy("sample_id", F.col("person_id").alias("q")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("subject_id").alias("subject"), logit.alias("logit")))).alias("logits"),
        *[F.first(x).alias(x) for x in ("vec", "norm", "x1", "y1", "x2", "y2")],
    )
    return per


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Query persons that a subject owns: confident enough, likelier than the background, and not suppressed by a better box."""
    q = query_persons(spark, d).withColumn("o", m.owner(F.col("logits")))
    q = q.where((F.col("o.confidence") >= SELECTION) & (F.col("o.p_owner") > 1 - F.col("o.confidence")))
    entry = F.struct(F.round("o.confidence", 9).alias("priority"), F.col("q").alias("slot"), "x1", "y1", "x2", "y2")
    kept = q.groupBy("sample_id").agg(F.collect_list(entry).alias("b")).select("sample_id", F.explode(g.keep_boxes(F.col("b"), 0.9)).alias("q"))
    return q.join(kept, ["sample_id", "q"], "left_semi").select("sample_id", "q", F.col("o.owner").alias("subject"), F.round("o.confidence", 9).alias("weight"), "vec", "norm")


def exclusive_membership(spark: SparkSession, d: str) -> DataFrame:
    return membership(spark, d).select("sample_id", F.col("q").alias("person_id"), "subject", F.round("weight", 6).alias("membership"))


def short(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.topm_shortlist(spark, d).select("sample_id", "gallery_index")


def similarity():
    """Cosine of vec and t_vec from norms that are made once per vector."""
    return F.round(v.dot(F.col("vec"), F.col("t_vec")) / F.greatest(F.col("norm") * F.col("t_norm"), F.lit(1e-12)), 9)


def maxsim_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Of every ranked pair: weighted mean over query persons of their best target, per subject, then over subjects; minus infinity without targets, 0 without query persons."""
    targets = cut(persons(spark, d)).select("gallery_index", F.col("vec").alias("t_vec"), F.col("norm").alias("t_norm"))
    every = c.scored(spark, d).select("sample_id", "gallery_index")
    pairs = every.join(query_persons(spark, d).select("sample_id", "q", "vec", "norm", "logits"), "sample_id").join(targets, "gallery_index")
    # the best target of a query person is the same for all subjects
    best = pairs.groupBy("sample_id", "gallery_index", "q").agg(F.max(similarity()).alias("best"), F.first("logits").alias("logits"))
    best = best.select("sample_id", "gallery_index", "q", "best", F.explode("logits").alias("l"))
    best = best.select("sample_id", "gallery_index", "best", F.col("l.subject").alias("subject"), v.sigmoid(F.col("l.logit")).alias("w"))
    per = best.groupBy("sample_id", "gallery_index", "subject").agg((F.sum(F.col("w") * F.col("best")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("s"))
    score = per.groupBy("sample_id", "gallery_index").agg(F.avg("s").alias("score"))
    has = targets.select("gallery_index", F.lit(True).alias("has")).distinct()
    out = every.join(has, "gallery_index", "left").join(score, ["sample_id", "gallery_index"], "left")
    value = F.when(F.col("has").isNull(), F.lit(float("-inf"))).otherwise(F.round(F.coalesce("score", F.lit(0.0)), 6))
    return out.select("sample_id", "gallery_index", value.alias("score"))


def edges(mem: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, iid, q, t, gain): possible matches; gain is the member's share in its subject times the similarity above the threshold."""
    share = mem.groupBy("sample_id", "subject").agg(F.sum("weight").alias("all"))
    mem = mem.join(share, ["sample_id", "subject"]).withColumn("share", F.col("weight") / F.greatest("all", F.lit(1e-6)))
    targets = targets.select("gallery_index", F.col("person_id").alias("t"), F.col("vec").alias("t_vec"), F.col("norm").alias("t_norm"))
    pairs = pairs.join(mem, "sample_id").join(targets, "gallery_index")
    pairs = pairs.withColumn("cos", similarity()).where(F.col("cos") > IDENTITY)
    return pairs.select(F.col("sample_id").alias("qid"), F.col("gallery_index").alias("iid"), "q", "t", F.round(F.col("share") * (F.col("cos") - IDENTITY), 9).alias("gain"))


def assignment(mem: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    return m.partial_assignment(edges(mem, targets, pairs).where("gain > 0"))


def partial_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Sum of gains of the best assignment of each (sample, image) with any possible match."""
    got = assignment(cut(membership(spark, d)), persons(spark, d), short(spark, d))
    return got.groupBy(F.col("qid").alias("sample_id"), F.col("iid").alias("gallery_index")).agg(F.round(F.sum("gain"), 6).alias("gain"))


def binding(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """Poolings and coverage of written pairs (sample_id, gallery_index) from the token scores of matched members."""
    mem, people = cut(membership(spark, d)), cut(persons(spark, d))
    got = assignment(mem, people, pairs).select(F.col("qid").alias("sample_id"), F.col("iid").alias("gallery_index"), "q", "t")
    targets = people.select("gallery_index", F.col("person_id").alias("t"), F.col("vec").alias("t_vec"))
    all_ = pairs.join(mem, "sample_id").join(got, ["sample_id", "gallery_index", "q"], "left").join(targets, ["gallery_index", "t"], "left")
    score = m.token_score(F.col("vec"), F.col("t_vec"), TOKENS, TOP)
    rows = all_.select("sample_id", "gallery_index", "subject", "weight", F.col("t").isNotNull().alias("matched"), F.coalesce(score, F.lit(0.0)).alias("score"))
    pooled = m.poolings(rows, ["sample_id", "gallery_index"], PENALTY)
    return pooled.select("sample_id", "gallery_index", *[F.round(x, 5).alias(x) for x in ("penalized", "matched_mean", "subject_mean", "coverage")])


def binding_poolings(spark: SparkSession, d: str) -> DataFrame:
    """Poolings and coverage of shortlisted images."""
    return binding(spark, d, cut(short(spark, d)))


def token_topk(spark: SparkSession, d: str) -> DataFrame:
    """Token score of every pair of persons of one image."""
    p = persons(spark, d)
    a = p.select("gallery_index", F.col("person_id").alias("person_a"), F.col("vec").alias("a"))
    b = p.select("gallery_index", F.col("person_id").alias("person_b"), F.col("vec").alias("b"))
    both = a.join(b, "gallery_index").where("person_a < person_b")
    return both.select("person_a", "person_b", F.round(m.token_score(F.col("a"), F.col("b"), TOKENS, TOP), 6).alias("score"))


QUERIES = {f.__name__: f for f in (exclusive_membership, maxsim_coarse, partial_assignment, binding_poolings, token_topk)}

_INF = "'-infinity'::DOUBLE"
_PERS = f"""pers AS MATERIALIZED (SELECT DISTINCT gallery_pos AS gallery_index, person_id, list_transform(identity_vec, lambda x: x::DOUBLE) AS vec, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2
    FROM (SELECT *, {c.sql_image('image_id')} AS plain FROM persons) JOIN gal ON gal.image_id = plain WHERE len(identity_vec) = 64
    AND len(list_filter(identity_vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(identity_vec, lambda x: x <> 0)) > 0)"""
_SHORT = f"""short AS MATERIALIZED (SELECT sample_id, gallery_index FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coarse DESC, gallery_index) AS r FROM sco) WHERE r <= {retrieval.M})"""
_QP = """qp AS MATERIALIZED (SELECT DISTINCT s.sample_id, p.person_id AS q, r.subject_id AS subject, round(6 * p.vec[r.subject_id + 1], 6) AS logit, p.vec, x1, y1, x2, y2
    FROM (SELECT DISTINCT sample_id, query_index FROM sco) s JOIN pers p ON p.gallery_index = s.query_index JOIN (SELECT DISTINCT sample_id, subject_id FROM req) r ON r.sample_id = s.sample_id)"""
_COS = "list_inner_product({a}, {b}) / greatest(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 1e-12)"
_MEM = """ow AS (SELECT sample_id, q, any_value(vec) AS vec, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2, 1 - 1 / (1 + sum(exp(logit))) AS conf,
    max(exp(logit)) / (1 + any_value(tot)) AS pown, arg_min(subject, -logit) AS subject FROM (SELECT *, sum(exp(logit)) OVER (PARTITION BY sample_id, q) AS tot FROM qp) GROUP BY sample_id, q),
sel AS (SELECT sample_id, q, subject, vec, x1, y1, x2, y2, round(conf, 9) AS weight, row_number() OVER (PARTITION BY sample_id ORDER BY round(conf, 9) DESC, q) AS r FROM ow WHERE conf >= 0.5 AND pown > 1 - conf AND x2 > x1 AND y2 > y1),
walk AS (SELECT sample_id, 1::BIGINT AS r, [{'q': q, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM sel WHERE r = 1
  UNION ALL SELECT o.sample_id, w.r + 1, CASE WHEN len(list_filter(w.kept, lambda k: greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0)
    / greatest((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0), 1e-12) > 0.9)) > 0
    THEN w.kept ELSE list_append(w.kept, {'q': o.q, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}) END FROM walk w JOIN sel o ON o.sample_id = w.sample_id AND o.r = w.r + 1),
kept AS (SELECT sample_id, unnest(arg_max(kept, r)).q AS q FROM walk GROUP BY sample_id),
mem AS MATERIALIZED (SELECT sel.* FROM sel JOIN kept USING (sample_id, q))"""
_EDGES = f"""mw AS (SELECT *, weight / greatest(sum(weight) OVER (PARTITION BY sample_id, subject), 1e-6) AS share FROM mem),
ec AS (SELECT sample_id, gallery_index, q, person_id AS t, share, round({_COS.format(a='mw.vec', b='p.vec')}, 9) AS cos FROM short JOIN mw USING (sample_id) JOIN pers p USING (gallery_index)),
edge AS MATERIALIZED (SELECT sample_id, gallery_index, q, t, round(share * (cos - 0.2), 9) AS gain FROM ec WHERE cos > 0.2 AND round(share * (cos - 0.2), 9) > 0),
slot AS (SELECT sample_id, gallery_index, q, row_number() OVER (PARTITION BY sample_id, gallery_index ORDER BY q) AS k FROM (SELECT DISTINCT sample_id, gallery_index, q FROM edge)),
try AS (SELECT sample_id, gallery_index, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS qs, 0.0::DOUBLE AS total FROM slot WHERE k = 1
  UNION ALL SELECT t.sample_id, t.gallery_index, t.k + 1, CASE WHEN e.t IS NULL THEN t.used ELSE list_append(t.used, e.t) END, CASE WHEN e.t IS NULL THEN t.qs ELSE list_append(t.qs, e.q) END, t.total + coalesce(e.gain, 0)
  FROM try t JOIN slot s ON s.sample_id = t.sample_id AND s.gallery_index = t.gallery_index AND s.k = t.k + 1
  JOIN (SELECT * FROM edge UNION ALL SELECT DISTINCT sample_id, gallery_index, q, NULL, 0 FROM edge) e ON e.sample_id = s.sample_id AND e.gallery_index = s.gallery_index AND e.q = s.q
  WHERE e.t IS NULL OR NOT list_contains(t.used, e.t))"""
_BINDING = f"""got AS (SELECT sample_id, gallery_index, unnest(arg_max(qs, total)) AS q, unnest(arg_max(used, total)) AS t
    FROM try t WHERE k = (SELECT max(k) FROM slot s WHERE s.sample_id = t.sample_id AND s.gallery_index = t.gallery_index) GROUP BY sample_id, gallery_index),
tk AS (SELECT got.*, m.vec[i * 16 + 1:i * 16 + 16] AS x, p.vec[j * 16 + 1:j * 16 + 16] AS y FROM got JOIN mem m USING (sample_id, q) JOIN pers p ON p.gallery_index = got.gallery_index AND p.person_id = t, range(4) u(i), range(4) w(j)),
sm AS (SELECT sample_id, gallery_index, q, {_COS.format(a='x', b='y')} AS s FROM tk),
sc AS (SELECT sample_id, gallery_index, q, avg(s) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, gallery_index, q ORDER BY s DESC) AS r FROM sm) WHERE r <= {TOP} GROUP BY ALL),
per AS (SELECT sample_id, gallery_index, subject, sum(weight) AS a, sum(CASE WHEN score IS NULL THEN 0 ELSE weight * score END) AS h, sum(CASE WHEN score IS NULL THEN 0 ELSE weight END) AS m
    FROM short JOIN mem USING (sample_id) LEFT JOIN sc USING (sample_id, gallery_index, q) GROUP BY ALL),
shares AS (SELECT sample_id, gallery_index, h / greatest(a, 1e-6) AS h, m / greatest(a, 1e-6) AS m, a / greatest(a, 1e-6) AS w FROM per),
binding AS MATERIALIZED (SELECT sample_id, gallery_index, round(avg(h - {PENALTY}::DOUBLE * (w - m)), 5) AS penalized, round(CASE WHEN sum(m) = 0 THEN -{PENALTY}::DOUBLE ELSE sum(h) / sum(m) END, 5) AS matched_mean,
    round(avg(CASE WHEN m = 0 THEN -{PENALTY}::DOUBLE ELSE h / m END), 5) AS subject_mean, round(greatest(0, least(1, avg(m))), 5) AS coverage FROM shares GROUP BY ALL)"""
_BASE = ("gal", "smp", "req", "sco")


_MAXSIM = f"""b AS (SELECT sample_id, gallery_index, subject, q, max(round({_COS.format(a='qp.vec', b='p.vec')}, 9)) AS best, 1 / (1 + exp(-any_value(logit))) AS w
    FROM sco JOIN qp USING (sample_id) JOIN pers p USING (gallery_index) GROUP BY ALL),
s AS (SELECT sample_id, gallery_index, subject, sum(w * best) / greatest(sum(w), 1e-6) AS s FROM b GROUP BY ALL), a AS (SELECT sample_id, gallery_index, avg(s) AS score FROM s GROUP BY ALL),
maxsim AS (SELECT sample_id, gallery_index, CASE WHEN gallery_index NOT IN (SELECT gallery_index FROM pers) THEN {_INF} ELSE round(coalesce(score, 0.0), 6) END AS score FROM sco LEFT JOIN a USING (sample_id, gallery_index))"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


ORACLE = {
    "exclusive_membership": _recursive(with_cte(*_BASE, more=f"{_PERS}, {_QP}, {_MEM}")) + "SELECT sample_id, q AS person_id, subject, round(weight, 6) AS membership FROM mem",
    "maxsim_coarse": with_cte(*_BASE, more=f"{_PERS}, {_QP}, {_MAXSIM}") + "SELECT sample_id, gallery_index, score FROM maxsim",
    "partial_assignment": _recursive(with_cte(*_BASE, more=f"{_PERS}, {_SHORT}, {_QP}, {_MEM}, {_EDGES}")) + "SELECT sample_id, gallery_index, round(max(total), 6) AS gain FROM try GROUP BY ALL",
    "binding_poolings": _recursive(with_cte(*_BASE, more=f"{_PERS}, {_SHORT}, {_QP}, {_MEM}, {_EDGES}, {_BINDING}")) + "SELECT * FROM binding",
    "token_topk": with_cte("gal", more=_PERS) + f""", pr AS (SELECT a.person_id AS person_a, b.person_id AS person_b, a.vec AS a, b.vec AS b FROM pers a JOIN pers b ON a.gallery_index = b.gallery_index AND a.person_id < b.person_id),
        tk AS (SELECT person_a, person_b, a[i * 16 + 1:i * 16 + 16] AS x, b[j * 16 + 1:j * 16 + 16] AS y FROM pr, range(4) t(i), range(4) u(j)),
        sm AS (SELECT person_a, person_b, {_COS.format(a='x', b='y')} AS s FROM tk)
        SELECT person_a, person_b, round(avg(s), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY person_a, person_b ORDER BY s DESC) AS r FROM sm) WHERE r <= 6 GROUP BY ALL""",
}
