"""A sample that matches target category proportions.

Categories are counted; each draw gets integer quotas: the whole part of its share, raised to the minimum and capped by
what is there; what is left of the draw's size goes out one by one by largest remainder (ties by name) to categories that
still have rows. Where minimums exceed the size, the largest quotas above their minimum give back. Each category then
keeps its rows with the smallest random keys. A histogram of key buckets finds the bucket in which the quota ends; all
lower buckets are in whole, and only the last bucket is ranked, so a category of any size is never sorted in one task.

Defined cases: a category no row has, or an unknown one, has no rows and its target is reported when it asks for any;
repeated ids count once; rows without a known category take no part; targets with null share or minimum count as zero;
empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.shared import cut, unit_hash

BUCKETS = 1024  # at least
IN_BUCKET = 65_536  # rows of a category aimed at per bucket at most


def quotas(n: int, targets: list[tuple[str, float, int]], available: dict[str, int]) -> dict[str, int]:
    """Rows to take of each category for a draw of n rows; targets: (category, share, least rows)."""
    caps = {c: available.get(c, 0) for c, _, _ in targets}
    floors = {c: min(least, caps[c]) for c, _, least in targets}
    take = {c: min(caps[c], max(floors[c], math.floor(share * n))) for c, share, _ in targets}
    by_rest = sorted(targets, key=lambda t: (-(t[1] * n - math.floor(t[1] * n)), t[0]))
    left = min(n, sum(caps.values())) - sum(take.values())
    while left > 0:  # what capped categories leave goes to the open ones by their shares
        open_ = [(c, share) for c, share, _ in by_rest if take[c] < caps[c]]
        weight = sum(share for _, share in open_)
        extra = {c: min(caps[c] - take[c], math.floor(left * share / weight)) if weight > 0 else 0 for c, share in open_}
        if not any(extra.values()):
            extra = {c: 1 for c, _ in open_[:left]}
        for c, more in extra.items():
            take[c] += more
            left -= more
    for c in sorted(take, key=lambda c: (floors[c] - take[c], c)):
        back = min(take[c] - floors[c], max(0, -left))
        take[c] -= back
        left += back
    return take


def plan_draws(rows: DataFrame, targets: DataFrame, known: list[str]) -> list[dict]:
    """One dict per target: counts, wanted rows, quota and whether it can be met. rows: (id, category), ids distinct."""
    counts = {r["category"]: r["count"] for r in rows.where(F.col("category").isin(*known)).groupBy("category").count().collect()}
    total = sum(counts.values())
    draws: dict[int, list] = {}
    for t in targets.collect():  # a fixed, small table
        draws.setdefault(t["draw_id"], []).append(t)
    plan = []
    for draw, ts in sorted(draws.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        n = math.floor(next((t["draw_fraction"] for t in ts if t["draw_fraction"] is not None), 0.0) * total)
        quota = quotas(n, [(t["category"], t["target_share"] or 0.0, t["min_rows"] or 0) for t in ts], counts)
        for t in ts:
            wanted = max(t["min_rows"] or 0, math.floor((t["target_share"] or 0.0) * n))
            there = counts.get(t["category"], 0)
            plan.append(
                {
                    "draw_id": draw, "category": t["category"], "draw_rows": n, "available": there, "wanted": wanted,
                    "quota": quota[t["category"]], "shortfall": max(0, wanted - there), "met": there >= wanted,
                }
            )
    return plan


PLAN_SCHEMA = (
    "draw_id int, category string, draw_rows bigint, available bigint, wanted bigint, quota bigint, shortfall bigint, met boolean"
)


def draw_samples(rows: DataFrame, plan: list[dict], seed: str = "draw") -> DataFrame:
    """(draw_id, category, id): the quota rows of each draw and category with the smallest random keys."""
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([p for p in plan if p["quota"] > 0], PLAN_SCHEMA).select("draw_id", "category", "quota"))
    keyed = rows.join(wanted, "category").withColumn("k", unit_hash(seed, F.col("draw_id"), F.col("id")))
    most = max((p["available"] for p in plan), default=0)
    buckets = 1 << max(BUCKETS.bit_length() - 1, (most // IN_BUCKET).bit_length())  # unit_hash has 60 bits
    keyed = keyed.withColumn("bucket", F.floor(F.col("k") / ((1 << 60) // buckets)))
    per_bucket = keyed.groupBy("draw_id", "category", "quota", "bucket").count()  # buckets many rows a target at most
    upto = Window.partitionBy("draw_id", "category").orderBy("bucket")
    ends = (
        per_bucket.withColumn("before", F.sum("count").over(upto) - F.col("count"))
        .where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("count") >= F.col("quota")))
        .select("draw_id", "category", F.col("bucket").alias("end"), (F.col("quota") - F.col("before")).alias("rest"))
    )
    marked = keyed.join(F.broadcast(cut(ends)), ["draw_id", "category"])  # one row a target
    inside = marked.where(F.col("bucket") < F.col("end")).select("draw_id", "category", "id")
    order = Window.partitionBy("draw_id", "category").orderBy("k", "id")
    last = marked.where(F.col("bucket") == F.col("end")).withColumn("r", F.row_number().over(order))
    return inside.unionByName(last.where(F.col("r") <= F.col("rest")).select("draw_id", "category", "id"))
