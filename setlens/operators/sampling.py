"""Reproducible sampling: named seeds, weighted epochs, uniform negatives, candidate rows with quotas, crops.

Random order is the order of SHA-256 keys of (seed, stream, ids), so every engine draws the same.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.shared import unit_hash


def derive_seed(seed: Column | int, stream: str, index: Column | int = 0) -> Column:
    """63-bit seed: the first eight bytes of SHA-256 of "seed:stream:index", shifted right by one."""
    text = F.concat_ws(":", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in (seed, stream, index)])
    high = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(F.sha2(text, 256), 9, 8), 16, 10).cast("bigint")
    return high * F.lit(1 << 31) + F.shiftrightunsigned(low, 1)


def balanced_draws(rows: DataFrame, key: str, category: str, seed: str) -> DataFrame:
    """(draw, key, category): as many draws with replacement as rows, a row's weight is 1 / sqrt(rows of its category).

    Each draw first falls into a category by its share of the weight (a handful of rows), then on a position within it;
    rows of a category are numbered in parallel by hash blocks, so no category is sorted in one task.
    """
    spark = rows.sparkSession
    counts = sorted((r[category], r["count"]) for r in rows.groupBy(category).count().collect())  # one row a category
    if not counts:
        return spark.createDataFrame([], f"draw bigint, {category} string, {key} string")
    weights = [math.sqrt(n) for _, n in counts]
    total, edge, edges = sum(weights), 0.0, []
    for (name, n), w in zip(counts, weights):
        edges.append((name, n, edge / total, (edge + w) / total))
        edge += w
    numbered = number_within(rows.select(key, category), category, key, "position")
    n_rows = sum(n for _, n in counts)
    draws = spark.range(n_rows).withColumnRenamed("id", "draw")
    u = unit_hash(seed, "category", F.col("draw")) / float(1 << 60)
    pick = F.lit(None).cast("string")
    size = F.lit(None).cast("bigint")
    for name, n, low, high in reversed(edges):
        pick, size = F.when(u < high, F.lit(name)).otherwise(pick), F.when(u < high, F.lit(n)).otherwise(size)
    last = edges[-1]
    draws = draws.withColumn(category, F.coalesce(pick, F.lit(last[0]))).withColumn("n", F.coalesce(size, F.lit(last[1])))
    draws = draws.withColumn("position", F.pmod(unit_hash(seed, "row", F.col("draw")), F.col("n")))
    return draws.join(numbered, [category, "position"]).select("draw", key, category)


def number_within(rows: DataFrame, group: str, order: str, name: str, blocks: int = 64) -> DataFrame:
    """rows with name: 0, 1, ... within each group, by hash block and then by order; large groups spread over all blocks."""
    block = F.pmod(F.conv(F.substring(F.md5(F.col(order).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(blocks))
    b = rows.withColumn("_b", block)
    sizes = b.groupBy(group, "_b").count()  # blocks rows a group at most
    before = F.sum("count").over(Window.partitionBy(group).orderBy("_b")) - F.col("count")
    starts = sizes.select(group, "_b", before.alias("_s"))
    within = F.row_number().over(Window.partitionBy(group, "_b").orderBy(order)) - 1
    return b.withColumn("_w", within).join(starts, [group, "_b"]).withColumn(name, F.col("_s") + F.col("_w")).drop("_b", "_s", "_w")


def uniform_without(pool: DataFrame, forbidden: DataFrame, query: str, item: str, n: int, seed: str) -> DataFrame:
    """n items of each query's pool, none of them forbidden, by smallest random key."""
    free = pool.join(forbidden.select(query, item), [query, item], "left_anti")
    k = unit_hash(seed, F.col(query), F.col(item))
    return free.withColumn("draw_pos", F.row_number().over(Window.partitionBy(query).orderBy(k, item)).cast("bigint")).where(F.col("draw_pos") <= n)


def _key(*parts: object) -> str:
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def top_up_partial(pool: dict, row: list, free: int, quota: int, slots: list[set], draw) -> list:
    """Items with part of the required identities: one per uncovered kind of error if all fit, then single omissions of the
    identity left out least often, then larger overlaps with more weight.

    pool: item -> (missing ids, missing slots, overlap); slots: the identities of each subject; draw orders items at random.
    """
    present = [pool[i] for i in row if i in pool]
    count = min(free, max(0, quota - len(present)))
    left = {i: x for i, x in pool.items() if i not in set(row)}
    omitted = Counter(m for x in present for m in x[0])
    chosen: list = []

    def take(item) -> None:
        info = left.pop(item)
        chosen.append(item)
        present.append(info)
        omitted.update(info[0])

    def best(items: list):
        singles = [i for i in items if len(left[i][0]) == 1]
        if singles:
            often = {i: omitted[next(iter(left[i][0]))] for i in singles}
            items = [i for i in singles if often[i] == min(often.values())]
        return draw(items, len(chosen))[0]

    kinds = [lambda x: bool(x[1]), lambda x: not x[1]]
    if len(slots) == 2 and all(len(s) == 1 for s in slots):
        kinds = [lambda x, s=s: s in x[1] for s in range(2)]
    open_kinds = [k for k in kinds if not any(map(k, present)) and any(map(k, left.values()))]
    if len(open_kinds) <= count:
        for k in open_kinds:
            items = [i for i in left if k(left[i])]
            if items:
                take(best(items))
    while len(chosen) < count:
        singles = [i for i in left if len(left[i][0]) == 1]
        if not singles or sum(len(x[0]) == 1 for x in present) >= min(4, quota):
            break
        take(best(singles))
    while len(chosen) < count and left:
        groups = defaultdict(list)
        for i, x in left.items():
            groups[x[2]].append(i)
        most = max(groups)
        spread = [(r, 2.0 ** (r - most)) for r in sorted(groups)]
        at = int(_key("overlap", len(chosen), *sorted(left))[:12], 16) / 16**12 * sum(w for _, w in spread)
        for r, w in spread:
            at -= w
            if at < 0:
                break
        item = draw(groups[r], len(chosen))[0]
        take(item)
    return chosen


def candidate_row(
    query: str, positives: list, identity: list, semantic: list, hard: list, partial: dict, gallery: list, slots: list[set],
    size: int = 16, most_positives: int = 2, f_identity: float = 0.5, f_semantic: float = 0.3, f_hard: float = 0.1, partial_quota: int = 4,
    context: list = (), known: set | None = None,
) -> list[tuple]:
    """(item, role) of one query's candidates: tiers fill in turn, each leaves out what is taken. semantic and hard: hardest first.

    known: all images that may be taken, where gallery holds only those that the fill can reach.
    """
    draw = lambda items, k: sorted(dict.fromkeys(items), key=lambda i: (_key(query, k, i), i))
    taken = {query, *positives}
    row: list[tuple] = [(i, "positive") for i in draw(positives, "p")[: max(0, min(most_positives, len(positives), size - 1))]]
    negatives = size - len(row)
    known = set(gallery) if known is None else known

    def tier(items: list, n: int, role: str, window: bool = False) -> int:
        free = [i for i in dict.fromkeys(items) if i in known and i not in taken]
        got = draw(free[: 2 * n] if window else free, role)[: max(0, n)]
        row.extend((i, role) for i in got)
        taken.update(got)
        return len(got)

    same = set(identity)
    quota = int(negatives * f_identity)
    got = tier([i for i in semantic if i in same], math.ceil(quota * f_semantic), "semantic_hard", True) if len(same) > quota else 0
    tier(identity, quota - got, "same_identity")
    hard_quota = int(negatives * f_hard)
    first = tier([i for i in list(context)[:2] if i not in same], 1, "context_hard") if hard_quota else 0
    tier([i for i in hard if i not in same], hard_quota - first, "identity_hard", True)
    topped = top_up_partial(partial, [i for i, _ in row], size - len(row), partial_quota, slots, draw)
    row += [(i, "partial") for i in topped if i not in taken]
    taken.update(topped)
    tier(gallery, size - len(row), "random")
    return sorted(row, key=lambda x: (_key(query, "shuffle", x[0]), x[0]))


def candidate_rows(pools: DataFrame, **options) -> DataFrame:
    """(sample_id, pos, gallery_index, role) for one row per query with its pools; see candidate_row.

    pools: sample_id, query_index, positives, identity, semantic, hard, fill (array<bigint>), partial
    (array<struct<item, missing array<string>, slots array<int>, overlap>>), slots (array<array<string>>). All pools are of
    the query's gallery and hold no positive but those of positives; fill may be the part of it that is drawn first.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                partial = {p["item"]: (frozenset(p["missing"]), frozenset(p["slots"]), p["overlap"]) for p in r.partial}
                known = {i for pool in (r.identity, r.semantic, r.hard, r.fill) for i in pool}
                row = candidate_row(
                    r.query_index, list(r.positives), list(r.identity), list(r.semantic), list(r.hard), partial, list(r.fill), [set(s) for s in r.slots], known=known, **options
                )
                out += [(r.sample_id, k, i, role) for k, (i, role) in enumerate(row)]
            yield pd.DataFrame(out, columns=["sample_id", "pos", "gallery_index", "role"])

    return pools.mapInPandas(run, "sample_id string, pos bigint, gallery_index bigint, role string")
