"""Rankings and their evaluation over the tables rankings, samples and gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.operators import metrics, ranking
from setlens.plans import catalog as c
from setlens.plans.catalog import with_cte
from setlens.shared import cut

M, K, WEIGHT = 500, 500, 0.15
KS = (1, 5, 10)


def coarse_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranking.complete_ranks(c.scored(spark, d), "sample_id", "coarse", "gallery_index", "coarse_rank")


def coarse_head(spark: SparkSession, d: str, m: int = M) -> DataFrame:
    return ranking.shortlist(c.scored(spark, d), m, "sample_id", "coarse", "gallery_index")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, n_pos) of ranked samples with at least one positive."""
    ranked = c.scored(spark, d).select("sample_id").distinct()
    return c.positives(spark, d).join(ranked, "sample_id", "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pos"))


def complete_ranking(spark: SparkSession, d: str) -> DataFrame:
    return coarse_ranked(spark, d).select("sample_id", "gallery_index", "coarse_rank")


def topm_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return coarse_head(spark, d).select("sample_id", "gallery_index", "coarse", "coarse_rank")


def zscore_coarse(spark: SparkSession, d: str) -> DataFrame:
    z = ranking.moments_zscore(c.scored(spark, d), F.col("coarse"), F.col("coarse") > ranking.NONE, "sample_id", "z")
    return z.select("sample_id", "gallery_index", F.round("z", 6).alias("z"))


def fine_coarse_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fused score of the shortlist; a missing fine score counts as minus infinity's stand-in, the coarse score."""
    short = coarse_head(spark, d).withColumn("f", fine())
    return short.select("sample_id", "gallery_index", "coarse_rank", F.round(ranking.fuse(F.col("f"), F.col("coarse"), WEIGHT, "sample_id"), 6).alias("fused"))


def fine():
    return F.when(F.col("fine") > ranking.NONE, F.col("fine")).otherwise(F.greatest(F.col("coarse"), F.lit(-1.0)))


def final_ranked(spark: SparkSession, d: str) -> DataFrame:
    r = coarse_ranked(spark, d)
    head = r.where(F.col("coarse_rank") <= M).withColumn("f", fine())
    head = head.withColumn("fused", F.round(ranking.fuse(F.col("f"), F.col("coarse"), WEIGHT, "sample_id"), 6))
    head = head.withColumn("final_rank", ranking.rerank_head("sample_id", "fused", M)).select("sample_id", "gallery_index", "coarse_rank", "final_rank")
    tail = r.where(F.col("coarse_rank") > M).select("sample_id", "gallery_index", "coarse_rank", F.col("coarse_rank").alias("final_rank"))
    return head.unionByName(tail)


def rerank_fixed_tail(spark: SparkSession, d: str) -> DataFrame:
    return final_ranked(spark, d)


def average_precision_per_query(spark: SparkSession, d: str) -> DataFrame:
    hits = metrics.positive_ranks(coarse_ranked(spark, d), c.positives(spark, d), "sample_id", "gallery_index", "coarse_rank")
    m = metrics.query_metrics(hits, sizes(spark, d), "sample_id", "coarse_rank", KS)
    return m.select("sample_id", "n_pos", F.round("ap", 6).alias("ap"), *[f"r{k}" for k in KS])


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    m = average_precision_per_query(spark, d).select("sample_id", F.expr(f"stack({len(KS)}, " + ", ".join(f"{k}, r{k}" for k in KS) + ") AS (k, r)"))
    return m.groupBy("k").agg(F.round(F.avg("r"), 6).alias("recall"), F.count(F.lit(1)).alias("queries"))


def candidate_recall(spark: SparkSession, d: str) -> DataFrame:
    hits = metrics.positive_ranks(coarse_ranked(spark, d), c.positives(spark, d), "sample_id", "gallery_index", "coarse_rank")
    r = metrics.candidate_recall(hits, sizes(spark, d), "sample_id", "coarse_rank", K)
    return r.select("sample_id", F.round("recall", 6).alias("recall"), "hit")


def per_query(spark: SparkSession, d: str) -> DataFrame:
    hits = metrics.positive_ranks(final_ranked(spark, d), c.positives(spark, d), "sample_id", "gallery_index", "final_rank")
    m = metrics.query_metrics(hits, sizes(spark, d), "sample_id", "final_rank", KS)
    cases = c.samples(spark, d).where(F.col("case_type").isin(*c.CASES)).select("sample_id", "case_type")
    return m.join(cases, "sample_id")


def retrieval_metrics_overall(spark: SparkSession, d: str) -> DataFrame:
    names = ["ap", *[f"r{k}" for k in KS]]
    r = per_query(spark, d).rollup("case_type").agg(F.count(F.lit(1)).alias("queries"), *metrics.means(names))
    return r.select(F.coalesce("case_type", F.lit("overall")).alias("case_type"), "queries", *[F.round(n, 6).alias(n) for n in names])


def metrics_by_case(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_metrics_overall(spark, d).where("case_type <> 'overall'")


def checkpoint_score(spark: SparkSession, d: str) -> DataFrame:
    """Half the mean over queries and half the mean over cases."""
    by_case = per_query(spark, d).groupBy("case_type").agg(F.sum("ap").alias("s"), F.count(F.lit(1)).alias("n"))
    r = by_case.agg((F.sum("s") / F.sum("n")).alias("overall"), F.avg(F.col("s") / F.col("n")).alias("macro"))
    return r.select(*[F.round(x, 6).alias(x) for x in ("overall", "macro")], F.round((F.col("overall") + F.col("macro")) / 2, 6).alias("score"))


def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One row per ranking, one column per case: mean average precision in percent."""
    # ranks of the positives are all that both lines need
    found = cut(final_ranked(spark, d).join(c.positives(spark, d), ["sample_id", "gallery_index"], "left_semi"))
    n_pos, cases = sizes(spark, d), c.samples(spark, d).select("sample_id", "case_type")
    rows = None
    for name, rank in (("coarse", "coarse_rank"), ("final", "final_rank")):
        hits = metrics.positive_ranks(found, found, "sample_id", "gallery_index", rank)
        m = metrics.query_metrics(hits, n_pos, "sample_id", rank, KS).join(cases, "sample_id").withColumn("method", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    p = rows.groupBy("method").pivot("case_type", c.CASES).agg(F.avg("ap"))
    return p.select("method", *[F.round(F.col(x) * 100, 4).alias(f"map_{x.lower()}") for x in c.CASES])


def artifact_issues(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a ranking artifact in one aggregate per query; correct rankings give no rows."""
    r = final_ranked(spark, d).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("gallery_index").alias("items"), F.countDistinct("final_rank").alias("ranks"),
        F.min("final_rank").alias("low"), F.max("final_rank").alias("high"),
        F.count(F.when((F.col("coarse_rank") > M) & (F.col("final_rank") != F.col("coarse_rank")), 1)).alias("moved_tail"),
        F.count(F.when((F.col("coarse_rank") <= M) & (F.col("final_rank") > M), 1)).alias("left_head"),
    )
    return r.where("n <> items OR n <> ranks OR low <> 1 OR high <> n OR moved_tail > 0 OR left_head > 0").select("sample_id", "n")


def rank_improved_pool(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's new top ten, the first two negatives that the new score moved up."""
    f = final_ranked(spark, d).join(c.positives(spark, d), ["sample_id", "gallery_index"], "left_anti")
    better = f.where("final_rank <= 10 AND final_rank < coarse_rank")
    return better.withColumn("pool_pos", ranking.complete_rank("sample_id", -F.col("final_rank"), "gallery_index")).where("pool_pos <= 2").select("sample_id", "gallery_index", "pool_pos")


QUERIES = {
    f.__name__: f
    for f in (
        complete_ranking, topm_shortlist, zscore_coarse, fine_coarse_fusion, rerank_fixed_tail, average_precision_per_query, recall_at_k,
        candidate_recall, retrieval_metrics_overall, metrics_by_case, checkpoint_score, report_pivot, artifact_issues, rank_improved_pool,
    )
}

_INF = "'-infinity'::DOUBLE"


def _z(x: str, valid: str, by: str) -> str:
    v = f"CASE WHEN {valid} THEN {x} END"
    over = f"OVER (PARTITION BY {by})"
    return (
        f"CASE WHEN {valid} THEN CASE WHEN min({v}) {over} = max({v}) {over} THEN 0.0 "
        f"ELSE ({x} - avg({v}) {over}) / greatest(stddev_pop({v}) {over}, 1e-6) END END"
    )


_RANKED = """ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY coarse DESC, gallery_index) AS coarse_rank FROM sco)"""
_FINE = f"CASE WHEN fine > {_INF} THEN fine ELSE greatest(coarse, -1.0) END"
_HEAD = _RANKED + f""", head AS MATERIALIZED (SELECT *, {_FINE} AS f FROM ranked WHERE coarse_rank <= {M}),
fz AS (SELECT *, {_z('f', f'coarse > {_INF}', 'sample_id')} AS zf, {_z('coarse', f'coarse > {_INF}', 'sample_id')} AS zc FROM head),
fused AS (SELECT *, CASE WHEN coarse > {_INF} THEN round(zf + {WEIGHT} * zc, 6) ELSE {_INF} END AS fused FROM fz),
final AS MATERIALIZED (SELECT sample_id, gallery_index, coarse_rank, row_number() OVER (PARTITION BY sample_id ORDER BY fused DESC, coarse_rank) AS final_rank FROM fused
  UNION ALL SELECT sample_id, gallery_index, coarse_rank, coarse_rank FROM ranked WHERE coarse_rank > {M})"""
_SIZES = """sizes AS (SELECT sample_id, count(*) AS n_pos FROM pos WHERE sample_id IN (SELECT sample_id FROM sco) GROUP BY 1)"""


def _metrics(source: str, rank: str, name: str) -> str:
    recalls = ", ".join(f"coalesce(max(({rank} <= {k})::INT::DOUBLE), 0) AS r{k}" for k in KS)
    return f"""{name} AS (SELECT sample_id, any_value(n_pos) AS n_pos, coalesce(sum(hit / {rank}), 0) / any_value(n_pos) AS ap, {recalls} FROM sizes LEFT JOIN (
        SELECT sample_id, {rank}, row_number() OVER (PARTITION BY sample_id ORDER BY {rank}) AS hit FROM {source} JOIN pos USING (sample_id, gallery_index)) USING (sample_id) GROUP BY sample_id)"""


_C = ("gal", "smp", "pos_at", "sco", "pos")
_PQ = f"{_HEAD}, {_SIZES}, {_metrics('final', 'final_rank', 'm')}, pq AS (SELECT m.*, case_type FROM m JOIN smp USING (sample_id) WHERE case_type IN ('INDIVIDUAL', 'GROUP', 'DUAL', 'RELATIONAL'))"
_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in ("ap", *[f"r{k}" for k in KS]))
ORACLE = {
    "complete_ranking": with_cte("sco", more=_RANKED) + "SELECT sample_id, gallery_index, coarse_rank FROM ranked",
    "topm_shortlist": with_cte("sco", more=_RANKED) + f"SELECT sample_id, gallery_index, coarse, coarse_rank FROM ranked WHERE coarse_rank <= {M}",
    "zscore_coarse": with_cte("sco") + f"SELECT sample_id, gallery_index, round({_z('coarse', f'coarse > {_INF}', 'sample_id')}, 6) AS z FROM sco",
    "fine_coarse_fusion": with_cte("sco", more=_HEAD) + "SELECT sample_id, gallery_index, coarse_rank, fused FROM fused",
    "rerank_fixed_tail": with_cte("sco", more=_HEAD) + "SELECT * FROM final",
    "average_precision_per_query": with_cte(*_C, more=f"{_RANKED}, {_SIZES}, {_metrics('ranked', 'coarse_rank', 'm')}") + "SELECT sample_id, n_pos, round(ap, 6) AS ap, r1, r5, r10 FROM m",
    "recall_at_k": with_cte(*_C, more=f"{_RANKED}, {_SIZES}, {_metrics('ranked', 'coarse_rank', 'm')}")
    + " UNION ALL ".join(f"SELECT {k}::INT AS k, round(avg(r{k}), 6) AS recall, count(*) AS queries FROM m" for k in KS),
    "candidate_recall": with_cte(*_C, more=f"{_RANKED}, {_SIZES}")
    + f"""SELECT sample_id, round(count(*) FILTER (WHERE coarse_rank <= {K}) / any_value(n_pos), 6) AS recall, (count(*) FILTER (WHERE coarse_rank <= {K}) > 0)::INT::DOUBLE AS hit
        FROM sizes LEFT JOIN (SELECT sample_id, coarse_rank FROM ranked JOIN pos USING (sample_id, gallery_index)) USING (sample_id) GROUP BY sample_id""",
    "retrieval_metrics_overall": with_cte(*_C, more=_PQ) + f"SELECT coalesce(case_type, 'overall') AS case_type, count(*) AS queries, {_MEANS} FROM pq GROUP BY ROLLUP (case_type)",
    "metrics_by_case": with_cte(*_C, more=_PQ) + f"SELECT case_type, count(*) AS queries, {_MEANS} FROM pq GROUP BY case_type",
    "checkpoint_score": with_cte(*_C, more=_PQ) + """, b AS (SELECT sum(ap) AS s, count(*) AS n FROM pq GROUP BY case_type), r AS (SELECT sum(s) / sum(n) AS overall, avg(s / n) AS macro FROM b)
        SELECT round(overall, 6) AS overall, round(macro, 6) AS macro, round((overall + macro) / 2, 6) AS score FROM r""",
    "report_pivot": with_cte(*_C, more=f"{_HEAD}, {_SIZES}, {_metrics('final', 'final_rank', 'mf')}, {_metrics('final', 'coarse_rank', 'mc')}")
    + ", a AS (SELECT 'coarse' AS method, sample_id, ap FROM mc UNION ALL SELECT 'final', sample_id, ap FROM mf) SELECT method, "
    + ", ".join(f"round(100 * avg(ap) FILTER (WHERE case_type = '{x}'), 4) AS map_{x.lower()}" for x in c.CASES)
    + " FROM a JOIN smp USING (sample_id) GROUP BY method",
    "artifact_issues": with_cte("sco", more=_HEAD) + "SELECT sample_id, count(*) AS n FROM final GROUP BY 1 HAVING count(*) <> count(DISTINCT final_rank)",
    "rank_improved_pool": with_cte(*_C, more=_HEAD) + """, b AS (SELECT sample_id, gallery_index, final_rank FROM final ANTI JOIN pos USING (sample_id, gallery_index) WHERE final_rank <= 10 AND final_rank < coarse_rank)
        SELECT * FROM (SELECT sample_id, gallery_index, row_number() OVER (PARTITION BY sample_id ORDER BY final_rank) AS pool_pos FROM b) WHERE pool_pos <= 2""",
}
