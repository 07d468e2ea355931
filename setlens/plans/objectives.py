"""Forward values of the objectives on shortlists and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions.vectors import cosine
from setlens.operators import objectives as o
from setlens.plans import catalog as c
from setlens.plans import calibrated, geometry, matching
from setlens.plans.catalog import with_cte
from setlens.shared import cut

TEMPERATURE = 0.1


def labelled(spark: SparkSession, d: str) -> DataFrame:
    e = calibrated.evidence(spark, d).withColumn("s", F.col("binding"))
    pos = c.positives(spark, d).withColumn("hit", F.lit(True))
    e = e.join(pos, ["sample_id", "gallery_index"], "left").withColumn("positive", F.coalesce("hit", F.lit(False)))
    return e.where(F.abs("s") < float("inf"))


def _out(df: DataFrame, count: str = "queries") -> DataFrame:
    return df.select(F.round("value", 6).alias("value"), count)


def pairwise_softplus(spark: SparkSession, d: str) -> DataFrame:
    return _out(o.pairwise_softplus(o.score_pairs(labelled(spark, d), "sample_id", "s", "positive"), "sample_id", TEMPERATURE))


def rejection_hinge(spark: SparkSession, d: str) -> DataFrame:
    e = labelled(spark, d)
    side = lambda flag, x: e.where(flag).select("sample_id", F.col("s").alias(f"base_{x}"), (F.col("context") * 0.1).alias(f"context_{x}"))
    pairs = side(F.col("positive"), "p").join(side(~F.col("positive"), "n"), "sample_id")
    return _out(o.rejection_hinge(pairs, "sample_id", TEMPERATURE))


def binding_pair_error(spark: SparkSession, d: str) -> DataFrame:
    return _out(o.pair_error(labelled(spark, d), "sample_id", "s", "positive"))


def supcon_loss(spark: SparkSession, d: str) -> DataFrame:
    """Blocks are stretches of the gallery, labels the identities of the persons; persons without one are no anchors."""
    p = matching.persons(spark, d).join(geometry.person_identity(spark, d), "person_id")
    p = p.select((F.floor(F.col("gallery_index") / 16)).alias("block"), F.col("person_id").alias("id"), F.col("identity_id").alias("label"), "vec")
    return _out(o.contrastive(p, TEMPERATURE), "anchors")


def grounding_bce(spark: SparkSession, d: str) -> DataFrame:
    """Inside a subject are the query persons with one of its identities; persons without identity do not count."""
    q = matching.query_persons(spark, d).select("sample_id", F.explode("logits").alias("l"), F.col("q").alias("person_id"))
    q = q.join(geometry.person_identity(spark, d), "person_id").select("sample_id", F.col("l.subject").alias("subject"), F.col("l.logit").alias("logit"), "identity_id")
    members = c.required(spark, d).select("sample_id", F.col("subject_id").alias("subject"), "identity_id", F.lit(True).alias("member")).distinct()
    cells = q.join(members, ["sample_id", "subject", "identity_id"], "left").withColumn("inside", F.coalesce("member", F.lit(False)))
    return _out(o.balanced_bce(cells, "sample_id", "subject"))


def crop_correspondence(spark: SparkSession, d: str) -> DataFrame:
    """Query persons against the persons of each positive image; right are those of the same identity, and an image without one does not count."""
    known = cut(geometry.person_identity(spark, d))
    q = matching.query_persons(spark, d).select("sample_id", F.col("q").alias("person_id"), "vec").join(known, "person_id")
    q = q.select("sample_id", F.col("person_id").alias("q"), "vec", F.col("identity_id").alias("who"))
    t = matching.persons(spark, d).select("gallery_index", "person_id", F.col("vec").alias("t")).join(known, "person_id", "left")
    s = q.join(c.positives(spark, d), "sample_id").join(t, "gallery_index")
    s = s.select("sample_id", "q", "gallery_index", F.coalesce(F.col("identity_id") == F.col("who"), F.lit(False)).alias("right"), (F.round(cosine(F.col("vec"), F.col("t")), 9) / TEMPERATURE).alias("s"))
    return _out(o.correspondence(o.correspondence_losses(s, ["sample_id", "q", "gallery_index"]).withColumnsRenamed({"sample_id": "query", "q": "anchor"})))


QUERIES = {f.__name__: f for f in (pairwise_softplus, rejection_hinge, binding_pair_error, supcon_loss, grounding_bce, crop_correspondence)}

_C = ("gal", "smp", "pos_at", "req", "sco", "pos")
_R = matching._recursive
_LAB = calibrated._EV + """, lab AS MATERIALIZED (SELECT ev.*, binding AS s, pos.sample_id IS NOT NULL AS positive FROM ev LEFT JOIN pos USING (sample_id, gallery_index) WHERE isfinite(binding))"""
_PAIRS = _LAB + """, pr AS (SELECT a.sample_id, a.s AS p, b.s AS n, a.context * 0.1 AS cp, b.context * 0.1 AS cn FROM lab a JOIN lab b USING (sample_id) WHERE a.positive AND NOT b.positive)"""


def _mean(x: str) -> str:
    return f", pq AS (SELECT sample_id, avg({x}) AS x FROM pr GROUP BY 1) SELECT round(coalesce(avg(x), 0), 6) AS value, count(*) AS queries FROM pq"


_SOFT = "ln(1 + exp(-abs({x}))) + greatest({x}, 0)"
_PID = geometry._PERSON_IDENTITY
ORACLE = {
    "pairwise_softplus": _R(with_cte(*_C, more=_PAIRS)) + _mean(_SOFT.format(x=f"((n - p) / {TEMPERATURE}::DOUBLE)")),
    "rejection_hinge": _R(with_cte(*_C, more=_PAIRS)) + _mean(f"greatest(cn - cp - greatest(p - n, 0), 0) / {TEMPERATURE}::DOUBLE"),
    "binding_pair_error": _R(with_cte(*_C, more=_PAIRS)) + _mean("(p <= n)::INT::DOUBLE"),
    "supcon_loss": _R(with_cte("gal", "box", more=f"{matching._PERS}, {_PID}")) + f""", k AS (SELECT p.*, identity_id FROM pers p JOIN pid USING (person_id)),
        s AS (SELECT a.gallery_index // 16 AS block, a.person_id AS a, a.identity_id = b.identity_id AS same, round({matching._COS.format(a='a.vec', b='b.vec')}, 9) / {TEMPERATURE}::DOUBLE AS s
        FROM k a JOIN k b ON a.gallery_index // 16 = b.gallery_index // 16 AND a.person_id <> b.person_id),
        l AS (SELECT a, max(s) + ln(sum(exp(s - m))) - avg(s) FILTER (WHERE same) AS loss FROM (SELECT *, max(s) OVER (PARTITION BY a) AS m FROM s) GROUP BY a HAVING count(*) FILTER (WHERE same) > 0)
        SELECT round(avg(loss), 6) AS value, count(*) AS anchors FROM l""",
    "grounding_bce": _R(with_cte("gal", "smp", "req", "sco", "box", more=f"{matching._PERS}, {matching._QP}, {_PID}")) + f""", c AS (
          SELECT qp.sample_id, subject, r.sample_id IS NOT NULL AS inside, CASE WHEN r.sample_id IS NOT NULL THEN {_SOFT.format(x='(-logit)')} ELSE {_SOFT.format(x='logit')} END AS loss
          FROM qp JOIN pid ON pid.person_id = qp.q LEFT JOIN req r ON r.sample_id = qp.sample_id AND r.subject_id = qp.subject AND r.identity_id = pid.identity_id),
        p AS (SELECT sample_id, subject, avg(loss) FILTER (WHERE inside) AS i, avg(loss) FILTER (WHERE NOT inside) AS o FROM c GROUP BY ALL),
        pq AS (SELECT sample_id, avg(CASE WHEN i IS NULL THEN o WHEN o IS NULL THEN i ELSE (i + o) / 2 END) AS x FROM p GROUP BY 1) SELECT round(coalesce(avg(x), 0), 6) AS value, count(*) AS queries FROM pq""",
    "crop_correspondence": _R(with_cte(*_C, "box", more=f"{matching._PERS}, {matching._QP}, {_PID}")) + f""", s AS (
          SELECT q.sample_id, q.q, gallery_index, coalesce(a.identity_id = b.identity_id, false) AS ok, round({matching._COS.format(a='q.vec', b='p.vec')}, 9) / {TEMPERATURE}::DOUBLE AS s
          FROM (SELECT DISTINCT sample_id, q, vec FROM qp) q JOIN pid a ON a.person_id = q.q JOIN pos USING (sample_id) JOIN pers p USING (gallery_index) LEFT JOIN pid b ON b.person_id = p.person_id),
        i AS (SELECT sample_id, q, gallery_index, max(m) + ln(sum(exp(s - m))) - avg(s) FILTER (WHERE ok) AS loss FROM (SELECT *, max(s) OVER (PARTITION BY sample_id, q, gallery_index) AS m FROM s) GROUP BY ALL HAVING count(*) FILTER (WHERE ok) > 0),
        a AS (SELECT sample_id, q, avg(loss) AS x FROM i GROUP BY ALL), pq AS (SELECT sample_id, avg(x) AS x FROM a GROUP BY 1) SELECT round(avg(x), 6) AS value, count(*) AS queries FROM pq""",
}
