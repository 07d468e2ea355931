"""Calibration, replay, mining and evaluation on both positive sets, from rankings, persons and labels together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.operators import calibration, metrics, ranking
from setlens.plans import catalog as c
from setlens.plans import dataset, matching, retrieval
from setlens.plans.catalog import with_cte
from setlens.shared import cut

POOL = 64
# The grid of the calibration.
COVERAGE = (0.0, 0.02, 0.04, 0.06, 0.08, 0.09, 0.12, 0.16)
CONTEXT = (0.0, 0.005, 0.01, 0.0125, 0.015, 0.0175, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2)
FUSION = (0.1, 0.125, 0.1375, 0.15, 0.175, 0.2)


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Saved evidence of the shortlist: binding and coverage of its persons, and the model's fine score as the context.

    Without members there is nothing to bind: the binding is minus the penalty, the coverage 0; no fine score is context 0.
    """
    short = cut(retrieval.coarse_head(spark, d).withColumn("context", F.round(F.coalesce(F.when(F.col("fine") > ranking.NONE, F.col("fine")), F.lit(0.0)), 6)))
    bound = matching.binding(spark, d, short.select("sample_id", "gallery_index"))
    bound = bound.select("sample_id", "gallery_index", F.col("penalized").alias("binding"), "coverage")
    e = short.join(bound, ["sample_id", "gallery_index"], "left")
    fill = {"binding": -matching.PENALTY, "coverage": 0.0}
    return e.select("sample_id", "gallery_index", "coarse", "coarse_rank", *[F.coalesce(x, F.lit(v)).alias(x) for x, v in fill.items()], "context")


def grid_inputs(spark: SparkSession, d: str):
    hits = metrics.positive_ranks(retrieval.coarse_ranked(spark, d), c.positives(spark, d), "sample_id", "gallery_index", "coarse_rank")
    return evidence(spark, d), hits, retrieval.sizes(spark, d)


def calibration_grid(spark: SparkSession, d: str) -> DataFrame:
    scores = calibration.grid_scores(*grid_inputs(spark, d), calibration.grid(COVERAGE, CONTEXT, FUSION), retrieval.M)
    return scores.select("grid_index", "coverage_weight", "context_weight", "fusion_weight", F.round("score", 6).alias("score"))


def calibration_winner(spark: SparkSession, d: str) -> DataFrame:
    return calibration.winner(calibration_grid(spark, d), "score", "grid_index")


def replay_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of the shortlist with other coefficients, from saved evidence alone."""
    e = evidence(spark, d)
    f = calibration.linear_score(F.col("binding"), F.col("coverage"), F.col("context"), 0.12, 0.1)
    e = e.withColumn("f", f).withColumn("fused", F.round(ranking.fuse(F.col("f"), F.col("coarse"), 0.2, "sample_id"), 6))
    return e.select("sample_id", "gallery_index", ranking.rerank_head("sample_id", "fused", retrieval.M).alias("final_rank"))


def forbidden(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, gallery_index) that may not be a negative: labelled positives, and images that are disputed for the query."""
    at = c.gallery(spark, d).select("image_id", F.col("gallery_pos").alias("gallery_index"))
    disputed = dataset.negative_exclusions(spark, d).join(at, "image_id").select("sample_id", "gallery_index")
    return c.positives(spark, d).unionByName(disputed).distinct()


def mined(spark: SparkSession, d: str) -> DataFrame:
    """The screened union of each query, fused: (sample_id, pool, gallery_index, coarse_rank, coverage, fused).

    Candidates with a finite coarse score that nothing forbids fall into the semantic group (every required identity is
    there) and the identity group; of each the first POOL in coarse order are screened. Binding and coverage are fused
    with the coarse score over both groups together.
    """
    r = c.scored(spark, d).where(F.col("coarse") > ranking.NONE)
    r = r.join(forbidden(spark, d), ["sample_id", "gallery_index"], "left_anti")
    # each candidate is tested by what its image holds: all images with a popular identity are never listed
    r = r.join(dataset.wanted(spark, d), "sample_id").join(dataset.indexed_sets(spark, d), "gallery_index", "left")
    r = r.withColumn("pool", F.when(dataset.holds_all(), "semantic").otherwise("identity"))
    place = F.row_number().over(Window.partitionBy("sample_id", "pool").orderBy(F.desc("coarse"), "gallery_index"))
    union = cut(r.withColumn("place", place).where(F.col("place") <= POOL).select("sample_id", "pool", "gallery_index", "coarse"))
    bound = matching.binding(spark, d, union.select("sample_id", "gallery_index")).select("sample_id", "gallery_index", "penalized", "coverage")
    u = union.join(bound, ["sample_id", "gallery_index"], "left")
    u = u.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    u = u.withColumn("f", calibration.linear_score(F.coalesce("penalized", F.lit(-matching.PENALTY)), F.col("coverage"), F.lit(0.0), 0.09, 0.0))
    u = u.withColumn("coarse_rank", ranking.complete_rank("sample_id", "coarse", "gallery_index"))
    return u.withColumn("fused", F.round(ranking.fuse(F.col("f"), F.col("coarse"), retrieval.WEIGHT, "sample_id"), 6)).drop("f", "penalized")


def hard_negative_pools(spark: SparkSession, d: str) -> DataFrame:
    """Mined negatives that cover some subject, hardest first by the fused score, equal ones in coarse order."""
    pos = F.row_number().over(Window.partitionBy("sample_id", "pool").orderBy(F.desc("fused"), "coarse_rank")).cast("bigint")
    return mined(spark, d).where("coverage > 0").select("sample_id", "pool", "gallery_index", pos.alias("pool_pos"))


def identity_matches(pairs: DataFrame, scope: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (sample_id, gallery_index, ...) whose image is an identity positive: in the sample's split, not its query image, with all its identities."""
    items = items.select(F.col("gallery_pos").alias("gallery_index"), "image_id", "split", "has")
    found = pairs.join(scope, "sample_id").join(items, ["gallery_index", "split"]).where(dataset.holds_all() & (F.col("image_id") != F.col("query_image_id")))
    return found.select(*pairs.columns)


def evaluation_per_query(spark: SparkSession, d: str) -> DataFrame:
    """Both positive sets of every ranked query that has full positives: sizes, precision, recall, and candidate recall of the shortlist."""
    items = cut(dataset.placed_sets(spark, d))
    scope = dataset.scoped_samples(spark, d).join(dataset.wanted(spark, d), "sample_id").select("sample_id", "split", "query_image_id", "wants")
    # a pair is tested by what its image holds; identity positives are counted, and only the ranked and the labelled ones listed
    full = cut(identity_matches(c.positives(spark, d), scope, items).join(c.scored(spark, d).select("sample_id").distinct(), "sample_id", "left_semi"))
    scope = cut(scope.join(full.select("sample_id").distinct(), "sample_id", "left_semi"))
    ranked = cut(identity_matches(retrieval.final_ranked(spark, d), scope, items))
    out = full.select("sample_id").distinct().join(
        c.samples(spark, d).where(F.col("case_type").isin(*c.CASES)).select("sample_id", "case_type"), "sample_id"
    )
    sizes = {"id": dataset.eligible_counts(scope, items).select("sample_id", F.col("eligible").alias("n_pos")), "full": full.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pos"))}
    for kind in ("id", "full"):
        own, n_pos = full if kind == "full" else ranked.select("sample_id", "gallery_index").distinct(), sizes[kind]
        hits = metrics.positive_ranks(ranked, own, "sample_id", "gallery_index", "final_rank")
        m = metrics.query_metrics(hits, n_pos, "sample_id", "final_rank", retrieval.KS)
        names = [F.col("n_pos").alias(f"num_{kind}_positives"), F.round("ap", 6).alias(f"{kind}_ap"), *[F.col(f"r{k}").alias(f"{kind}_r{k}") for k in retrieval.KS]]
        out = out.join(m.select("sample_id", *names), "sample_id")
        if kind == "full":
            coarse = metrics.positive_ranks(ranked, own, "sample_id", "gallery_index", "coarse_rank")
            found = metrics.candidate_recall(coarse, n_pos, "sample_id", "coarse_rank", retrieval.K)
            out = out.join(found.select("sample_id", F.round("recall", 6).alias(f"candidate_recall_{retrieval.K}"), F.col("hit").alias(f"candidate_hit_{retrieval.K}")), "sample_id")
    return out


def five_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval from persons: (sample_id, gallery_index, coarse_rank, binding_rank, fine_rank, final_rank) of every candidate.

    The coarse rank is that of the fused identity and state scores. Of its first M candidates the persons are matched: they
    are ranked by the binding alone, by the fine score (binding, coverage and context) and by the fine score fused with the
    coarse one; all others keep their coarse rank in each ranking.
    """
    from setlens.plans import more

    coarse = more.coarse_fusion(spark, d).withColumnRenamed("score", "coarse")
    r = ranking.complete_ranks(coarse, "sample_id", "coarse", "gallery_index", "coarse_rank")
    head = cut(r.where(F.col("coarse_rank") <= retrieval.M))
    bound = matching.binding(spark, d, head.select("sample_id", "gallery_index")).select("sample_id", "gallery_index", "penalized", "coverage")
    context = c.scored(spark, d).select("sample_id", "gallery_index", F.round(F.coalesce(F.when(F.col("fine") > ranking.NONE, F.col("fine")), F.lit(0.0)), 6).alias("context"))
    head = head.join(bound, ["sample_id", "gallery_index"], "left").join(context, ["sample_id", "gallery_index"])
    head = head.withColumn("binding", F.coalesce("penalized", F.lit(-matching.PENALTY))).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    head = head.withColumn("fine", calibration.linear_score(F.col("binding"), F.col("coverage"), F.col("context"), 0.09, 0.0125))
    head = head.withColumn("fused", F.round(ranking.fuse(F.col("fine"), F.col("coarse"), retrieval.WEIGHT, "sample_id"), 6))
    ranks = {"binding_rank": "binding", "fine_rank": "fine", "final_rank": "fused"}
    head = head.select("sample_id", "gallery_index", "coarse_rank", *[ranking.rerank_head("sample_id", by, retrieval.M).alias(name) for name, by in ranks.items()])
    tail = r.where(F.col("coarse_rank") > retrieval.M).select("sample_id", "gallery_index", "coarse_rank", *[F.col("coarse_rank").alias(name) for name in ranks])
    return head.unionByName(tail)


QUERIES = {
    f.__name__: f for f in (calibration_grid, calibration_winner, replay_rankings, hard_negative_pools, evaluation_per_query, five_rankings)
}

_INF = "'-infinity'::DOUBLE"
_POINTS = [(a, b, w) for a in COVERAGE for b in CONTEXT for w in FUSION]
_C = ("gal", "smp", "pos_at", "req", "sco", "pos")
_MATCH = f"{matching._QP}, {matching._MEM}, {matching._EDGES}, {matching._BINDING}"
_EV = f"""{retrieval._RANKED}, {matching._PERS}, {matching._SHORT}, {_MATCH},
ev AS MATERIALIZED (SELECT r.sample_id, r.gallery_index, coarse, coarse_rank, coalesce(penalized, -{matching.PENALTY}::DOUBLE) AS binding, coalesce(b.coverage, 0.0) AS coverage,
    round(coalesce(CASE WHEN fine > {_INF} THEN fine END, 0.0), 6) AS context FROM ranked r LEFT JOIN binding b USING (sample_id, gallery_index) WHERE coarse_rank <= {retrieval.M})"""
_GRID = f"""{_EV}, {retrieval._SIZES}, grid AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE)' for i, (a, b, w) in enumerate(_POINTS))}) t(grid_index, coverage_weight, context_weight, fusion_weight)),
live AS (SELECT * FROM ev WHERE sample_id IN (SELECT sample_id FROM ev JOIN pos USING (sample_id, gallery_index))),
x AS (SELECT live.*, grid.*, round(binding + coverage_weight * coverage + context_weight * context, 9) AS f FROM live, grid),
zz AS (SELECT *, {retrieval._z('f', f'coarse > {_INF}', 'grid_index, sample_id')} AS zf, {retrieval._z('coarse', f'coarse > {_INF}', 'grid_index, sample_id')} AS zc FROM x),
fu AS (SELECT *, CASE WHEN coarse > {_INF} THEN round(zf + fusion_weight * zc, 6) ELSE {_INF} END AS fused FROM zz),
hr AS (SELECT grid_index, sample_id, gallery_index, row_number() OVER (PARTITION BY grid_index, sample_id ORDER BY fused DESC, coarse_rank) AS r FROM fu),
allr AS (SELECT grid_index, sample_id, gallery_index, r FROM hr JOIN pos USING (sample_id, gallery_index)
  UNION ALL SELECT grid_index, sample_id, gallery_index, coarse_rank FROM ranked JOIN pos USING (sample_id, gallery_index), grid WHERE coarse_rank > {retrieval.M}),
ap AS (SELECT grid_index, sample_id, sum(hit / r) AS s FROM (SELECT *, row_number() OVER (PARTITION BY grid_index, sample_id ORDER BY r) AS hit FROM allr) GROUP BY ALL),
scores AS (SELECT grid_index, coverage_weight, context_weight, fusion_weight, round(sum(coalesce(s, 0) / n_pos) / count(*), 6) AS score
  FROM grid CROSS JOIN sizes LEFT JOIN ap USING (grid_index, sample_id) GROUP BY ALL)"""
_ALL = ("gal", "img", "ii", "smp", "pos_at", "req", "spl", "sco", "pos")
_MINED = f"""{matching._PERS}, {dataset._VOTES}, forbid AS (SELECT sample_id, gallery_index FROM pos UNION SELECT sample_id, gallery_pos FROM excluded JOIN gal USING (image_id)),
want AS (SELECT sample_id, count(DISTINCT identity_id) AS n FROM req GROUP BY 1),
same AS (SELECT r.sample_id, g.gallery_pos AS gallery_index FROM (SELECT DISTINCT sample_id, identity_id FROM req) r JOIN ii USING (identity_id) JOIN gal g USING (image_id) JOIN want w ON w.sample_id = r.sample_id
    GROUP BY r.sample_id, g.gallery_pos, w.n HAVING count(DISTINCT identity_id) = w.n),
elig AS (SELECT s.*, CASE WHEN m.sample_id IS NOT NULL THEN 'semantic' ELSE 'identity' END AS pool FROM sco s LEFT JOIN same m USING (sample_id, gallery_index)
    WHERE coarse > {_INF} AND (sample_id, gallery_index) NOT IN (SELECT sample_id, gallery_index FROM forbid) AND sample_id IN (SELECT sample_id FROM req)),
short AS MATERIALIZED (SELECT sample_id, pool, gallery_index, coarse FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pool ORDER BY coarse DESC, gallery_index) AS p FROM elig) WHERE p <= {POOL}),
{_MATCH}, u AS (SELECT s.*, coalesce(b.coverage, 0.0) AS coverage, round(coalesce(penalized, -{matching.PENALTY}::DOUBLE) + 0.09 * coalesce(b.coverage, 0.0), 9) AS f FROM short s LEFT JOIN binding b USING (sample_id, gallery_index)),
z AS (SELECT *, {retrieval._z('f', 'true', 'sample_id')} AS zf, {retrieval._z('coarse', 'true', 'sample_id')} AS zc FROM u),
mined AS (SELECT *, round(zf + {retrieval.WEIGHT} * zc, 6) AS fused FROM z)"""
_RATES = lambda p: ", ".join(f"coalesce(max((final_rank <= {k})::INT::DOUBLE), 0) AS {p}_r{k}" for k in retrieval.KS)
_EVAL = f"""{retrieval._HEAD}, {dataset._IDPOS}, idset AS (SELECT DISTINCT sample_id, gallery_pos AS gallery_index FROM idpos JOIN gal USING (image_id) WHERE sample_id IN (SELECT sample_id FROM sco)),
fullset AS (SELECT * FROM idset SEMI JOIN pos USING (sample_id, gallery_index)),
""" + ",\n".join(
    f"""{k}_n AS (SELECT sample_id, count(*) AS num_{k}_positives FROM {k}set GROUP BY 1),
{k}_m AS (SELECT sample_id, any_value(num_{k}_positives) AS num_{k}_positives, round(coalesce(sum(hit / final_rank), 0) / any_value(num_{k}_positives), 6) AS {k}_ap, {_RATES(k)} FROM {k}_n LEFT JOIN
    (SELECT sample_id, final_rank, row_number() OVER (PARTITION BY sample_id ORDER BY final_rank) AS hit FROM final JOIN {k}set USING (sample_id, gallery_index)) USING (sample_id) GROUP BY sample_id)"""
    for k in ("id", "full")
)

ORACLE = {
    "calibration_grid": matching._recursive(with_cte(*_C, more=_GRID)) + "SELECT * FROM scores",
    "calibration_winner": matching._recursive(with_cte(*_C, more=_GRID)) + "SELECT * FROM scores ORDER BY score DESC, grid_index LIMIT 1",
    "replay_rankings": matching._recursive(with_cte(*_C, more=_EV)) + f""", x AS (SELECT *, round(binding + 0.12 * coverage + 0.1 * context, 9) AS f FROM ev),
        zz AS (SELECT *, {retrieval._z('f', f'coarse > {_INF}', 'sample_id')} AS zf, {retrieval._z('coarse', f'coarse > {_INF}', 'sample_id')} AS zc FROM x),
        fu AS (SELECT *, CASE WHEN coarse > {_INF} THEN round(zf + 0.2 * zc, 6) ELSE {_INF} END AS fused FROM zz)
        SELECT sample_id, gallery_index, row_number() OVER (PARTITION BY sample_id ORDER BY fused DESC, coarse_rank) AS final_rank FROM fu""",
    "hard_negative_pools": matching._recursive(with_cte(*_ALL, more=_MINED)) + """SELECT sample_id, pool, gallery_index, row_number() OVER (PARTITION BY sample_id, pool ORDER BY fused DESC, coarse DESC, gallery_index) AS pool_pos
        FROM mined WHERE coverage > 0""",
    "evaluation_per_query": with_cte(*_ALL, more=_EVAL) + f""", cand AS (SELECT sample_id, round(count(*) FILTER (WHERE coarse_rank <= {retrieval.K}) / any_value(num_full_positives), 6) AS candidate_recall_{retrieval.K},
          (count(*) FILTER (WHERE coarse_rank <= {retrieval.K}) > 0)::INT::DOUBLE AS candidate_hit_{retrieval.K} FROM full_n LEFT JOIN (SELECT sample_id, coarse_rank FROM final JOIN fullset USING (sample_id, gallery_index)) USING (sample_id) GROUP BY sample_id)
        SELECT s.sample_id, s.case_type, i.* EXCLUDE (sample_id), f.* EXCLUDE (sample_id), c.* EXCLUDE (sample_id) FROM full_m f JOIN id_m i USING (sample_id) JOIN cand c USING (sample_id) JOIN smp s USING (sample_id)
        WHERE case_type IN ('INDIVIDUAL', 'GROUP', 'DUAL', 'RELATIONAL')""",
    "five_rankings": matching._recursive(with_cte("gal", "smp", "req", "sco", more=f"{matching._PERS}, {matching._QP}, {matching._MAXSIM}"))
    + f""", j AS (SELECT m.sample_id, m.gallery_index, score AS identity, coarse AS state, fine FROM maxsim m JOIN sco USING (sample_id, gallery_index)),
        zj AS (SELECT *, {retrieval._z('identity', f'identity > {_INF} AND state > {_INF}', 'sample_id')} AS zi, {retrieval._z('state', f'identity > {_INF} AND state > {_INF}', 'sample_id')} AS zs FROM j),
        cr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coarse DESC, gallery_index) AS coarse_rank FROM (SELECT *, coalesce(round(zi + 0.5 * zs, 5), {_INF}) AS coarse FROM zj)),
        short AS MATERIALIZED (SELECT sample_id, gallery_index FROM cr WHERE coarse_rank <= {retrieval.M}), {matching._MEM}, {matching._EDGES}, {matching._BINDING},
        fh AS (SELECT r.*, coalesce(penalized, -{matching.PENALTY}::DOUBLE) AS binding, round(coalesce(penalized, -{matching.PENALTY}::DOUBLE) + 0.09 * coalesce(b.coverage, 0.0)
          + 0.0125 * round(coalesce(CASE WHEN fine > {_INF} THEN fine END, 0.0), 6), 9) AS f FROM cr r LEFT JOIN binding b USING (sample_id, gallery_index) WHERE coarse_rank <= {retrieval.M}),
        zh AS (SELECT *, {retrieval._z('f', f'coarse > {_INF}', 'sample_id')} AS zf, {retrieval._z('coarse', f'coarse > {_INF}', 'sample_id')} AS zc FROM fh),
        fu AS (SELECT *, CASE WHEN coarse > {_INF} THEN round(zf + {retrieval.WEIGHT} * zc, 6) ELSE {_INF} END AS fused FROM zh)
        SELECT sample_id, gallery_index, coarse_rank, row_number() OVER (PARTITION BY sample_id ORDER BY binding DESC, coarse_rank) AS binding_rank, row_number() OVER (PARTITION BY sample_id ORDER BY f DESC, coarse_rank) AS fine_rank,
          row_number() OVER (PARTITION BY sample_id ORDER BY fused DESC, coarse_rank) AS final_rank FROM fu
        UNION ALL SELECT sample_id, gallery_index, coarse_rank, coarse_rank, coarse_rank, coarse_rank FROM cr WHERE coarse_rank > {retrieval.M}""",
}
