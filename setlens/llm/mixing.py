"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. Each source of a mix gets its share of the wanted total; a source that would need
more than max_repeats copies is held there, and what it leaves goes to the others by their weights. Every document of a
source first gets the certain whole copies. The fractional copy goes to a Pareto order sample with unequal probabilities:
a document's inclusion is proportional to its weight, by default its own size. Where that would exceed one the copy is
certain, and the others share what is left; this repeats until no further one is certain. The others are ranked by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order up to the fixed number of tokens
still wanted (the document on the border only if that comes closer). Ranks are cut into buckets whose token sums find the
border; only the bucket on the border is sorted, and there are more buckets the more documents there are, so a source of
any size is never sorted in one task.

Defined cases: sources compare without letter case and outer white space; a null source belongs to no mix; documents
without tokens are never listed; a null, negative or infinite weight of a document counts as zero, and such a document
comes in last; a mix's source written several times adds its weights and takes the largest limit; null or negative
weights of targets count as zero; sources without documents get nothing and are reported with share zero; repeated rows
are documents of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.shared import cut, unit_hash

BUCKETS = 1024  # at least
IN_BUCKET = 65_536  # documents of a source aimed at per bucket at most


def shares(targets: list[dict], available: dict[str, int]) -> list[dict]:
    """For each (mix, source): wanted and reachable tokens, whole copies, and the tokens of the fractional copy.

    targets: mix_id, source, weight, max_repeats, fraction.
    """
    out = []
    for mix in sorted({t["mix_id"] for t in targets}):
        ts: dict[str, dict] = {}
        for t in (t for t in targets if t["mix_id"] == mix):
            x = ts.setdefault(t["source"], dict(t, weight=0.0))
            x["weight"] += max(0.0, t["weight"] or 0.0)
            x["max_repeats"] = max(x["max_repeats"] or 0, t["max_repeats"] or 0)
        total = max((t["fraction"] or 0.0 for t in ts.values()), default=0.0) * sum(available.get(s, 0) for s in ts)
        weights = sum(t["weight"] for t in ts.values())
        size: dict[str, float] = {}
        open_ = {s for s in ts if available.get(s, 0) and ts[s]["weight"] > 0}
        left = total
        while open_:
            weight = sum(ts[s]["weight"] for s in open_)
            capped = {s for s in open_ if left * ts[s]["weight"] / weight >= ts[s]["max_repeats"] * available[s]}
            if not capped:
                size |= {s: left * ts[s]["weight"] / weight for s in open_}
                break
            for s in sorted(capped):
                size[s] = float(ts[s]["max_repeats"] * available[s])
            left = max(0.0, left - sum(size[s] for s in capped))
            open_ -= capped
        for s, t in sorted(ts.items()):
            there, want = available.get(s, 0), size.get(s, 0.0)
            whole = int(want // there) if there else 0
            out.append(
                {
                    "mix_id": mix, "source": s, "target_share": t["weight"] / weights if weights else 0.0,
                    "wanted": total * t["weight"] / weights if weights else 0.0, "available": there,
                    "whole": whole, "rest": want - whole * there,
                }
            )
    return out


SHARE_SCHEMA = "mix_id int, source string, target_share double, wanted double, available bigint, whole int, rest double"


def pareto_rank(u: Column, p: Column) -> Column:
    """q / (1 + q) of the Pareto rank q = (u / (1 - u)) / (p / (1 - p)): the same order, between 0 and 1."""
    a, b = u * (1 - p), p * (1 - u)
    return a / (a + b)


def inclusion(per_weight: DataFrame, plan: list[dict]) -> list[dict]:
    """For each target with a fractional copy: factor, so that a document's inclusion is min(1, factor * weight), and the
    tokens still wanted once the certain documents (inclusion 1) are taken.

    per_weight: source, weight, t (tokens), wt (weight times tokens). The sums of tokens of all included documents meet
    the wanted rest in expectation. Each round is one aggregate; a round only ever adds certain documents.
    """
    state = [{"mix_id": p["mix_id"], "source": p["source"], "rest": p["rest"], "factor": 0.0, "open": -1.0} for p in plan if p["rest"] > 0]
    while state:
        known = F.broadcast(per_weight.sparkSession.createDataFrame(state, ODDS_SCHEMA))  # as many rows as the targets
        certain = F.col("factor") * F.col("weight") >= 1
        sums = per_weight.join(known, "source").groupBy("mix_id", "source").agg(
            F.coalesce(F.sum(F.when(certain, F.col("t"))), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~certain, F.col("wt"))), F.lit(0.0)).alias("wt")
        )
        found = {(r["mix_id"], r["source"]): r for r in sums.collect()}  # one row a target
        new = []
        for x in state:
            r = found.get((x["mix_id"], x["source"]))
            taken, wt = (r["taken"], r["wt"]) if r else (0, 0.0)
            open_ = max(0.0, x["rest"] - taken)
            new.append(dict(x, open=open_, factor=max(x["factor"], open_ / wt) if wt > 0 else x["factor"]))
        if [x["open"] for x in new] == [x["open"] for x in state]:
            break
        state = new
    return state


ODDS_SCHEMA = "mix_id int, source string, rest double, factor double, open double"


def mix_sources(docs: DataFrame, plan: list[dict], seed: str = "mix") -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies). docs: doc_id, source, tokens and, if wanted, a weight instead of the size."""
    spark = docs.sparkSession
    weight = F.col("weight").cast("double") if "weight" in docs.columns else F.col("tokens").cast("double")
    weight = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(F.lit(0.0))
    live = docs.where((F.col("tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "tokens", weight.alias("weight"))
    per_weight = live.groupBy("source", "weight").agg(
        F.sum("tokens").alias("t"), F.sum(F.col("weight") * F.col("tokens")).alias("wt"), F.count(F.lit(1)).alias("n")
    )
    per_weight = cut(per_weight)
    most = per_weight.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(BUCKETS, -(-most // IN_BUCKET))

    odds = {(x["mix_id"], x["source"]): x for x in inclusion(per_weight, plan)}
    targets = [
        (p["mix_id"], p["source"], p["whole"], odds.get(k, {}).get("factor", 0.0), odds.get(k, {}).get("open", 0.0), k in odds)
        for p in plan
        if (k := (p["mix_id"], p["source"])) in odds or p["whole"] > 0
    ]
    schema = "mix_id int, source string, whole int, factor double, open double, has_rest boolean"
    m = live.join(F.broadcast(spark.createDataFrame(targets, schema)), "source")  # as many rows as the targets
    odds_of = F.col("factor") * F.col("weight")
    certain = F.col("has_rest") & (odds_of >= 1)
    u = (unit_hash(seed, F.col("mix_id"), F.col("doc_id")) + 0.5) / float(1 << 60)
    m = m.withColumn("q", F.when(certain, F.lit(-1.0)).otherwise(pareto_rank(u, F.greatest(odds_of, F.lit(1e-12)))))
    m = m.withColumn("bucket", F.when(certain, F.lit(-1)).otherwise(F.least(F.floor(F.col("q") * buckets), F.lit(buckets - 1))))
    sums = m.where("has_rest AND bucket >= 0").groupBy("mix_id", "source", "open", "bucket").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("mix_id", "source").orderBy("bucket")
    ends = (
        sums.withColumn("before", F.sum("t").over(upto) - F.col("t"))
        .where("before < open AND before + t >= open")
        .select("mix_id", "source", F.col("bucket").alias("end"), "before")
    )
    m = m.join(F.broadcast(cut(ends)), ["mix_id", "source"], "left")  # one row a target
    cols = ["mix_id", "source", "doc_id", "tokens", "whole"]
    extra = F.col("has_rest") & (F.coalesce(F.expr("bucket < end"), F.lit(False)) | (F.col("bucket") < 0))
    below = m.where("end IS NULL OR bucket <> end").select(*cols, extra.cast("int").alias("extra"))
    order = Window.partitionBy("mix_id", "source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    border = m.where("bucket = end").withColumn("sum", F.col("before") + F.sum("tokens").over(order))
    # taken if at least half of the document lies within the wanted size
    border = border.select(*cols, (F.col("sum") - F.col("tokens") / 2 <= F.col("open")).cast("int").alias("extra"))
    both = below.unionByName(border).withColumn("copies", F.col("whole") + F.col("extra"))
    return both.where("copies > 0").select("mix_id", "source", "doc_id", "tokens", "copies")


def mix_report(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """Target and actual share of every source of every mix."""
    spark = mixed.sparkSession
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    rows = spark.createDataFrame(plan, SHARE_SCHEMA).join(got, ["mix_id", "source"], "left")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_id"))
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select(
        "mix_id", "source", "target_share", "wanted", "available",
        tokens.alias("tokens"),
        F.when(total > 0, tokens / total).otherwise(F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
