"""Splits that keep related records together.

Records that share a key, directly or through others, form a component that is never divided. Component weights go into
many equal bins by largest differencing: two loads are combined by laying the heavy bins of one on the light bins of the
other, always taking the two with the largest spread. This happens first inside each slice of components (equal weights
fill all bins once without any spread, so only the rest of each weight is combined), then once over the few slices.
Whole bins go to the splits: heaviest first to the split furthest below its target.

A component heavier than a bin stays whole, its bin counts with its true load.

Defined cases: null and nobody keys link nothing, so a record without keys is a component of its own; repeated records
count once, and if their keys differ all of them link; no split targets or non-positive shares give a null split; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlens.llm.components import components
from setlens.shared import cut

BINS, SLICES = 256, 32  # slices at least
IN_SLICE = 1_000_000  # components aimed at per slice
MOST_SLICES = 4_096  # slices at most, whose loads the driver combines


def key_components(records: DataFrame, id_col: str, keys: Column) -> DataFrame:
    """(id, root): the component of each record by its smallest reachable key; root is null for a record without keys."""
    ks = records.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(keys))).alias("keys"))
    ks = ks.where(F.col("id").isNotNull())
    # a repeated record with other keys links these too, through its id
    rows = ks.select("id", F.explode_outer("keys").alias("key")).groupBy("id").agg(
        F.array_sort(F.collect_set("key")).alias("keys")
    )
    rows = cut(rows)
    links = rows.where(F.size("keys") > 1).select(F.explode("keys").alias("a"), F.col("keys")[0].alias("b"))
    roots = components(links)
    first = rows.select("id", F.get("keys", F.lit(0)).alias("node"))
    return first.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))


def _combine(one: tuple, two: tuple) -> tuple:
    """Two (loads, bin members) with loads falling: the heavy bins of one meet the light bins of the other."""
    loads = one[0] + two[0][::-1]
    order = np.argsort(-loads, kind="stable")
    members = [one[1][k] + two[1][len(loads) - 1 - k] for k in order]
    return loads[order], members


def differencing(items: list[tuple[float, object]], bins: int, start: list[tuple] | None = None) -> tuple[np.ndarray, list]:
    """Loads, falling, and members of each bin after combining all items (and started loads) by largest spread."""
    heap: list[tuple] = []
    for k, state in enumerate(start or []):
        heap.append((-(state[0][0] - state[0][-1]), k, state))
    for k, (weight, what) in enumerate(items, len(heap)):
        loads = np.zeros(bins)
        loads[0] = weight
        heap.append((-weight, k, (loads, [(what,)] + [()] * (bins - 1))))
    if not heap:
        return np.zeros(bins), [()] * bins
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        state = _combine(one, two)
        heapq.heappush(heap, (-(state[0][0] - state[0][-1]), number, state))
        number += 1
    return heap[0][2]


def _slice_bins(bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by slice, weight and component: a full set of equal weights is laid over all bins at once."""
        waiting: dict[int, list] = {}
        number, names = None, ["slice", "root", "weight", "bin"]

        def rest() -> pd.DataFrame:
            # equal bins change no spread, so only the rest of each weight has to be combined
            left = [(w, (w, r)) for w, held in sorted(waiting.items(), reverse=True) for r in held]
            _, members = differencing(left, bins)
            return pd.DataFrame([(number, r, w, b) for b, ms in enumerate(members) for w, r in ms], columns=names)

        for pdf in batches:
            out = []
            for slice_, root, weight in zip(pdf["slice"], pdf["root"], pdf["weight"]):
                if slice_ != number:
                    if waiting:
                        yield rest()
                        waiting.clear()
                    number = slice_
                held = waiting.setdefault(int(weight), [])
                held.append(root)
                if len(held) == bins:
                    out += [(slice_, r, weight, b) for b, r in enumerate(held)]
                    held.clear()
            yield pd.DataFrame(out, columns=names)
        if waiting:
            yield rest()

    return run


def balanced_bins(weights: DataFrame, bins: int = BINS, slices: int = SLICES) -> DataFrame:
    """(root, weight, slice, bin) for weights (root, weight): slices many independent balances of bins bins."""
    sliced = weights.withColumn("slice", F.pmod(F.xxhash64("root"), F.lit(slices)).cast("int"))
    # a partition holds whole slices, and works them off one after the other in a fixed order
    fixed = sliced.repartition("slice").sortWithinPartitions("slice", "weight", "root")
    return fixed.select("slice", "root", "weight").mapInPandas(_slice_bins(bins), "slice int, root string, weight bigint, bin int")


def allocate(loads: dict[int, float], targets: list[tuple[str, float]]) -> dict[int, str | None]:
    """Whole bins to splits: heaviest first, each to the split furthest below its target."""
    total, share = sum(loads.values()), sum(max(0.0, s or 0.0) for _, s in targets)
    if share <= 0:
        return dict.fromkeys(loads)
    need = {name: total * max(0.0, s or 0.0) / share for name, s in targets}
    out: dict[int, str | None] = {}
    for b in sorted(loads, key=lambda b: (-loads[b], b)):
        name = max(sorted(need), key=lambda x: need[x])
        out[b] = name
        need[name] -= loads[b]
    return out


def assign_splits(members: DataFrame, targets: list[tuple[str, float]], bins: int = BINS, slices: int = SLICES) -> DataFrame:
    """(id, root, split) for members (id, root); members without root are components of their own."""
    own = members.select("id", F.coalesce(F.concat(F.lit("k"), "root"), F.concat(F.lit("i"), "id")).alias("root"))
    own = cut(own)
    weights = cut(own.groupBy("root").agg(F.count(F.lit(1)).alias("weight")))
    slices = min(MOST_SLICES, max(slices, -(-weights.count() // IN_SLICE)))
    binned = cut(balanced_bins(weights, bins, slices))
    loads = binned.groupBy("slice", "bin").agg(F.sum("weight").alias("load")).collect()  # slices x bins rows at most
    states: dict[int, np.ndarray] = {}
    for r in loads:
        states.setdefault(r["slice"], np.zeros(bins))[r["bin"]] = r["load"]
    start = []
    for s, load in sorted(states.items()):
        order = np.argsort(-load, kind="stable")
        start.append((load[order], [((s, int(b)),) for b in order]))
    total, merged = differencing([], bins, start)
    split_of = allocate(dict(enumerate(total)), targets)
    where = [(s, b, split_of[k]) for k, ms in enumerate(merged) for s, b in ms]
    spark = members.sparkSession
    placed = binned.join(F.broadcast(spark.createDataFrame(where, "slice int, bin int, split string")), ["slice", "bin"])
    return own.join(placed.select("root", "split"), "root").select("id", "root", "split")
