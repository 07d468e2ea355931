"""Relational division, partial overlap, keyed upsert and key constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def division(required: DataFrame, having: DataFrame) -> DataFrame:
    """(qid, iid): the items that have every key a query requires. required: (qid, key); having: (iid, key), both distinct.

    Only items that have the query's rarest key are candidates, so a popular key does not fan out unless nothing rarer
    is required. A query without keys has no items.
    """
    frequency = having.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rated = required.join(frequency, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    need = rated.groupBy("qid").agg(F.min(F.struct("n", "key")).alias("rarest"), F.count(F.lit(1)).alias("need"))
    candidates = need.where("rarest.n > 0").select("qid", "need", F.col("rarest.key").alias("key")).join(having, "key")
    single = candidates.where("need = 1").select("qid", "iid")
    several = (
        candidates.where("need > 1").select("qid", "iid", "need")
        .join(required, "qid").join(having, ["iid", "key"])
        .groupBy("qid", "iid", "need").count().where("count = need").select("qid", "iid")
    )
    return single.unionByName(several)


def meet(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, rows: int = 4000) -> DataFrame:
    """left and right joined on keys. Where a key has many rows on both sides its pairs are divided into blocks of rows x rows,
    each of which may fall to another task; the rows of a side are repeated for the blocks of the other.
    """
    n, m = (df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name)) for df, name in ((left, "_n"), (right, "_m")))
    blocks = n.join(m, keys)
    of = lambda by, count: F.pmod(F.xxhash64(by), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    a = left.join(blocks, keys).withColumn("_a", of(left_id, "_n")).withColumn("_b", every("_m")).drop("_n", "_m")
    b = right.join(blocks, keys).withColumn("_b", of(right_id, "_m")).withColumn("_a", every("_n")).drop("_n", "_m")
    return a.join(b, [*keys, "_a", "_b"]).drop("_a", "_b")


def partial_overlap(required: DataFrame, having: DataFrame) -> DataFrame:
    """(qid, iid, overlap, missing, missing_subjects) of items that have some but not all keys of a query with two or more.

    required: (qid, subject, key). missing: sorted keys; missing_subjects: sorted subjects none of whose keys is there. With
    a column scope on both sides only items of the query's scope meet it; with a column own an item of that id is left out.

    A pair comes out where it meets by the smallest common key, so pairs are neither grouped nor shuffled; what is missing
    beside a single common key is known before the join.
    """
    by = ["scope"] * ("scope" in required.columns)
    query = ["qid", *by, *["own"] * ("own" in required.columns)]
    wants = required.groupBy(*query, "subject").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    wants = wants.groupBy(*query).agg(F.array_sort(F.collect_list(F.struct("subject", "keys"))).alias("subjects"))
    wants = wants.withColumn("every", F.array_sort(F.array_distinct(F.flatten("subjects.keys")))).where(F.size("every") > 1)
    without = lambda keys: F.transform(F.filter("subjects", lambda s: ~F.arrays_overlap(s["keys"], keys)), lambda s: s["subject"])
    asked = wants.withColumn("key", F.explode("every"))
    asked = asked.withColumn("others", F.array_remove("every", F.col("key"))).withColumn("without", without(F.array("key")))
    there = having.join(asked.select(*by, "key").distinct(), [*by, "key"], "left_semi")
    there = there.groupBy("iid", *by).agg(F.array_sort(F.collect_set("key")).alias("have")).withColumn("key", F.explode("have"))
    pairs = meet(asked, there, [*by, "key"], "qid", "iid")
    if "own" in query:
        pairs = pairs.where(F.col("iid") != F.col("own"))
    common = F.when(F.size("have") == 1, F.col("have")).otherwise(F.array_intersect("every", "have"))
    pairs = pairs.withColumn("common", common).where((F.col("common")[0] == F.col("key")) & (F.size("common") < F.size("every")))
    alone = F.size("common") == 1
    return pairs.select(
        "qid", "iid", F.size("common").cast("bigint").alias("overlap"),
        F.when(alone, F.col("others")).otherwise(F.array_except("every", "have")).alias("missing"),
        F.when(alone, F.col("without")).otherwise(without(F.col("have"))).alias("missing_subjects"),
    )


def keyed_upsert(existing: DataFrame, prepared: DataFrame, key: str, pos: str) -> DataFrame:
    """Prepared rows take the place of existing ones with their key; new keys follow in their own order, from position 1."""
    cols = [c for c in existing.columns if c not in (key, pos)]
    old = existing.select(F.col(key), F.col(pos).alias("old_pos"), *[F.col(c).alias(f"old_{c}") for c in cols])
    new = prepared.select(F.col(key), F.col(pos).alias("new_pos"), *[F.col(c).alias(f"new_{c}") for c in cols])
    both = old.join(new, key, "full")
    taken = [F.when(F.col("new_pos").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in cols]
    return both.select(
        key, *taken, F.col("old_pos").isNull().alias("is_new"), F.coalesce("old_pos", "new_pos").alias(pos)
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right"))
    )


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def issues(**conditions: Column) -> Column:
    """Sorted codes of the conditions that hold, joined by commas; a null condition does not hold."""
    codes = [F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in sorted(conditions.items())]
    return F.array_join(F.array_compact(F.array(*codes)), ",")
