"""Grid search over score coefficients from saved evidence of the shortlist.

The shortlist of a query becomes one row of arrays, which meets all points of the grid in the task that holds it: nothing
is multiplied by the grid before a shuffle, and each task hands on one sum per point. Ranks below the shortlist never
change, so their positives enter as constants; their share of the average precision depends on how many positives the
head holds, which is the same at every point, as the head keeps its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINTS = 64  # points compared at a time


def grid(coverage: tuple, context: tuple, fusion: tuple) -> list[tuple]:
    """Points in nested-loop order, numbered from 0."""
    points = [(a, b, w) for a in coverage for b in context for w in fusion]
    return [(i, float(a), float(b), float(w)) for i, (a, b, w) in enumerate(points)]


def linear_score(binding: Column, coverage: Column, context: Column, a: float | Column, b: float | Column, scale: float = 1.0) -> Column:
    return F.round(scale * binding + a * coverage + b * context, 9)


def _z(x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Population z-score along the last axis over the valid places, 0 for a constant."""
    v = x[..., valid]
    low, high = v.min(axis=-1, keepdims=True), v.max(axis=-1, keepdims=True)
    return np.where(low == high, 0.0, (x - v.mean(axis=-1, keepdims=True)) / np.maximum(v.std(axis=-1, keepdims=True), 1e-6))


def head_precision(points: np.ndarray, coarse: np.ndarray, binding: np.ndarray, coverage: np.ndarray, context: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Sum of hit / rank over the positives of one shortlist in coarse order, for each point (coverage, context, fusion)."""
    valid, out = np.isfinite(coarse), np.zeros(len(points))
    where = np.flatnonzero(positive)
    zc = _z(np.where(valid, coarse, 0.0), valid) if valid.any() else coarse
    for at in range(0, len(points), POINTS):
        a, b, w = (points[at : at + POINTS, [k]] for k in range(3))
        f = np.round(binding + a * coverage + b * context, 9)
        fused = np.where(valid, np.round(_z(f, valid) + w * zc, 6), -np.inf) if valid.any() else np.full(f.shape, -np.inf)
        fused = np.where(w == 0, f, fused)
        ranks = np.empty(fused.shape, np.int64)
        order = np.argsort(-fused, axis=1, kind="stable")
        np.put_along_axis(ranks, order, np.arange(1, fused.shape[1] + 1)[None, :], axis=1)
        hit = np.sort(ranks[:, where], axis=1)
        out[at : at + POINTS] = (np.arange(1, len(where) + 1) / hit).sum(axis=1)
    return out


def grid_scores(evidence: DataFrame, hits: DataFrame, sizes: DataFrame, points: list[tuple], m: int) -> DataFrame:
    """Mean average precision of every grid point.

    evidence: sample_id, gallery_index, coarse, coarse_rank, binding, coverage, context of the shortlist; hits: the ranks
    (coarse_rank) and numbers (hit) of positives; sizes: (sample_id, n_pos).
    """
    spark = evidence.sparkSession
    g = spark.createDataFrame(points, "grid_index int, coverage_weight double, context_weight double, fusion_weight double")
    head_hits = hits.where(F.col("coarse_rank") <= m).select("sample_id", "gallery_index", F.lit(True).alias("positive"))
    # queries without a positive in the shortlist have the same value at every point and skip the grid
    live = evidence.join(head_hits.select("sample_id").distinct(), "sample_id", "left_semi").join(head_hits, ["sample_id", "gallery_index"], "left")
    names = ("coarse", "binding", "coverage", "context")
    entry = F.struct("coarse_rank", *names, F.coalesce("positive", F.lit(False)).alias("positive"))
    lists = live.groupBy("sample_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # m entries at most
    lists = lists.join(sizes, "sample_id").select("n_pos", *[F.col(f"e.{n}").alias(n) for n in (*names, "positive")])
    weights = np.array([p[1:] for p in points], float).reshape(-1, 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(points))
        for pdf in batches:
            for n, *arrays, positive in pdf.itertuples(index=False):
                total += head_precision(weights, *(np.asarray(x, float) for x in arrays), np.asarray(positive, bool)) / n
        yield pd.DataFrame({"grid_index": [p[0] for p in points], "heads": total})

    heads = lists.mapInPandas(run, "grid_index int, heads double").groupBy("grid_index").agg(F.sum("heads").alias("heads"))
    tail = hits.where(F.col("coarse_rank") > m).groupBy("sample_id").agg(F.sum(F.col("hit") / F.col("coarse_rank")).alias("tail"))
    tails, queries = (
        sizes.join(tail, "sample_id", "left").agg(F.sum(F.coalesce("tail", F.lit(0.0)) / F.col("n_pos")), F.count(F.lit(1))).first()
    )
    score = (F.coalesce("heads", F.lit(0.0)) + F.lit(tails or 0.0)) / F.lit(queries) if queries else F.lit(None).cast("double")
    return g.join(heads, "grid_index", "left").withColumn("score", score).drop("heads")


def winner(scores: DataFrame, metric: str, index: str) -> DataFrame:
    """The best point, the first of equals."""
    return scores.orderBy(F.col(metric).desc(), F.col(index).asc()).limit(1)


def select(artifacts: list[tuple[str, DataFrame]], metric: str = "score") -> DataFrame:
    """The best point over the grids of several artifacts of one checkpoint: (artifact, artifact_pos, point columns, global_index).

    The first artifact wins ties, then the first point; points are numbered on over the artifacts in their order.
    """
    every = None
    for pos, (name, scores) in enumerate(artifacts):
        rows = scores.select(F.lit(name).alias("artifact"), F.lit(pos).alias("artifact_pos"), "*")
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        raise ValueError("no artifacts")
    sizes = every.groupBy("artifact_pos").agg(F.count(F.lit(1)).alias("n"))  # one row an artifact
    offset = sizes.withColumn("offset", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("artifact_pos")) - F.col("n")).drop("n")
    numbered = every.join(F.broadcast(offset), "artifact_pos").withColumn("global_index", F.col("offset") + F.col("grid_index")).drop("offset")
    return numbered.orderBy(F.col(metric).desc(), "artifact_pos", "grid_index").limit(1)


def frozen(config: dict, chosen: dict) -> dict:
    """The configuration with the chosen coefficients set and the search taken out; weights that the search did not set stay."""
    retrieval = dict(config.get("retrieval", {}))
    for key in ("coverage_weight", "context_weight", "fusion_weight"):
        if key in chosen:
            retrieval[key] = float(chosen[key])
    out = {k: v for k, v in config.items() if k != "calibration"}
    return out | {"retrieval": retrieval}


def refuse_changes(saved: dict, wanted: dict, defining: tuple[str, ...]) -> None:
    """Raises if a replay asks for another value of a setting that defined the saved shortlist or its evidence."""
    changed = [k for k in defining if k in wanted and wanted[k] != saved.get(k)]
    if changed:
        raise ValueError(f"replay cannot change {', '.join(changed)}: saved evidence depends on it")
