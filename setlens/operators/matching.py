"""Membership, partial one-to-one assignment and binding scores between the persons of two images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlens.functions import vectors as v


def owner(logits: Column, background: float = 0.0) -> Column:
    """struct(owner, confidence, p_owner) of array<struct(subject, logit)>; softmax over background and active subjects."""
    top = F.greatest(F.array_max(F.transform(logits, lambda x: x["logit"])), F.lit(background))
    mass = lambda x: F.exp(x - top)
    total = F.aggregate(logits, mass(F.lit(background)), lambda acc, x: acc + mass(x["logit"]))
    best = F.array_min(F.transform(logits, lambda x: F.struct((-x["logit"]).alias("minus"), x["subject"].alias("subject"))))
    return F.struct(
        best["subject"].alias("owner"), (1 - mass(F.lit(background)) / total).alias("confidence"), (mass(-best["minus"]) / total).alias("p_owner")
    )


def assign(utility: np.ndarray) -> np.ndarray:
    """Target of each query row, -1 for none, with the largest sum of utilities; a target is used once, only positive ones count.

    Shortest augmenting paths: rows are added one by one, each may also stay alone at utility 0.
    """
    rows, cols = utility.shape
    cost = np.concatenate([np.where(utility > 0, -utility, 1.0), np.full((rows, rows), 0.0)], axis=1)
    cost[:, :cols][utility <= 0] = 1.0
    width = cols + rows
    row_of = np.full(width, -1)
    u, w = np.zeros(rows), np.zeros(width)
    for r in range(rows):
        reach, prev, done = np.full(width, np.inf), np.full(width, -1), np.zeros(width, bool)
        i, j_in, base = r, -1, 0.0
        while True:
            slack = base + cost[i] - u[i] - w
            closer = ~done & (slack < reach - 1e-15)
            reach[closer], prev[closer] = slack[closer], j_in
            j = int(np.argmin(np.where(done, np.inf, reach)))
            base, done[j] = reach[j], True
            if row_of[j] < 0:
                break
            i, j_in = row_of[j], j
        u[r] += base
        for k in np.flatnonzero(done):
            if row_of[k] >= 0:
                u[row_of[k]] += base - reach[k]
                w[k] -= base - reach[k]
        while j >= 0:
            before = prev[j]
            row_of[j] = r if before < 0 else row_of[before]
            j = before
    out = np.full(rows, -1)
    for j in range(cols):
        if row_of[j] >= 0 and utility[row_of[j], j] > 0:
            out[row_of[j]] = j
    return out


def partial_assignment(edges: DataFrame) -> DataFrame:
    """(qid, iid, q, t, gain) of the best partial one-to-one assignment of every (qid, iid).

    edges: qid, iid, q, t, gain with gain > 0. The edges of one (qid, iid) become one row (the persons of two images bound
    it), so a batch of many assignments goes to Python at once; where no two edges share an end, none has to go.
    """
    entry = F.struct("q", "t", "gain")
    per = edges.groupBy("qid", "iid").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    kind = per.schema["e"].dataType.simpleString()

    @F.pandas_udf(kind)
    def solve(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            if group is None:
                out.append(None)
                continue
            q, t, g = (np.array([x[n] for x in group]) for n in ("q", "t", "gain"))
            qs, ts = np.unique(q), np.unique(t)
            gain = np.zeros((len(qs), len(ts)))
            gain[np.searchsorted(qs, q), np.searchsorted(ts, t)] = g
            got = assign(gain)
            out.append([{"q": int(qs[r]), "t": int(ts[c]), "gain": float(gain[r, c])} for r, c in enumerate(got) if c >= 0])
        return pd.Series(out)

    alone = (F.size(F.array_distinct("e.q")) == F.size("e")) & (F.size(F.array_distinct("e.t")) == F.size("e"))
    # one pass over the groups: those that need no solver reach Python as null
    chosen = per.select("qid", "iid", F.coalesce(solve(F.when(~alone, F.col("e"))), "e").alias("e"))
    return chosen.select("qid", "iid", F.explode("e").alias("x")).select("qid", "iid", "x.q", "x.t", "x.gain")


def token_score(a: Column, b: Column, tokens: int, k: int) -> Column:
    """Mean of the k largest cosines between the equal slices ("tokens") of two vectors."""
    width = F.size(a) / tokens
    part = lambda x, i: F.slice(x, (i * width + 1).cast("int"), width.cast("int"))
    steps = F.sequence(F.lit(0), F.lit(tokens - 1))
    sims = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: v.cosine(part(a, i), part(b, j)))))
    return v.mean_of_top(sims, k)


def poolings(members: DataFrame, keys: list[str], penalty: float) -> DataFrame:
    """Three poolings and coverage per key. members: keys, subject, weight (of the member), matched, score.

    Weights are shares of the subject's sum. penalized: mean over subjects of scores with minus the penalty for unmatched
    members; matched_mean: over all matched members together; subject_mean: mean over subjects of the matched mean.
    """
    hit = F.when(F.col("matched"), F.col("weight") * F.col("score")).otherwise(F.lit(0.0))
    mass = F.when(F.col("matched"), F.col("weight")).otherwise(F.lit(0.0))
    per = members.groupBy(*keys, "subject").agg(F.sum("weight").alias("all"), F.sum(hit).alias("hit"), F.sum(mass).alias("mass"))
    floor = F.greatest("all", F.lit(1e-6))
    per = per.withColumn("h", F.col("hit") / floor).withColumn("m", F.col("mass") / floor).withColumn("w", F.col("all") / floor)
    return per.groupBy(*keys).agg(
        F.avg(F.col("h") - penalty * (F.col("w") - F.col("m"))).alias("penalized"),
        F.coalesce(F.try_divide(F.sum("h"), F.sum("m")), F.lit(-penalty)).alias("matched_mean"),
        F.avg(F.coalesce(F.try_divide(F.col("h"), F.col("m")), F.lit(-penalty))).alias("subject_mean"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("m"))).alias("coverage"),
    )
