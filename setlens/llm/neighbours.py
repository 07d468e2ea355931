"""The most similar vectors of every vector, by cosine.

Equal vectors form one class; one representative goes on and carries the smallest ids of its class. Representatives are
filed in the lists of an inverted file, whose centroids are fitted on at most SAMPLE vectors; all are indexed. Lists whose
centroids lie close together make up a unit, and a query travels once to each unit that holds any of its lists.

Every probed list is scanned in the same way: vectors, turned by a random rotation, are read in blocks of columns, and
after each block a hypothesis test on the partial distance gives up the candidates that cannot lie within the query's
bound on its distance to the k-th neighbour (the partial distance, scaled up, exceeds the bound by a factor that grows
with the uncertainty at so few columns). What survives all blocks gets its exact cosine in double precision. The bound
comes from the first vectors of the query's own list, becomes tighter with every list of its own unit, and closes most of
its PROBES nearest lists (those behind a plane between two centroids that is farther away than the bound). Queries of a
unit that many lists send to are divided into slices.

Defined cases: a vector that is null, of another width, all zero or holds a null, NaN or infinity takes no part; a
repeated id counts once, with its smallest vector; ties go to the smaller id; with fewer than k others, all of them are
neighbours; ids are bigint, further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setlens.shared import cut

WIDTH = 64
SAMPLE = 20_000  # vectors at most that fit the centroids
LISTS = 16_384  # centroids at most
PROBES = 32
UNIT = 65_536  # vectors aimed at per unit at most
UNITS = 48  # units aimed at where there are fewer vectors
SLICE = 32_768  # queries aimed at per task at most
PILOT = 128  # vectors of the own list that give the first bound
COLUMNS = 16  # columns read between two tests
EPSILON = 2.5  # of the hypothesis test: larger gives up later
ROWS = 512  # queries compared at a time
SEED = 7_919


def usable(vec: Column, width: int = WIDTH) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.forall(vec, number) & F.exists(vec, lambda x: x != 0)
    return F.coalesce((F.size(vec) == width) & good, F.lit(False))


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres.astype(np.float32)


def rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED + 1).normal(size=(width, width)))[0]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(raw, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, width)


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each q: similarity falling, id rising."""
    order = np.lexsort((c, -s, q))
    starts = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def scan(qx: np.ndarray, tau: np.ndarray, cx: np.ndarray, cid: np.ndarray, turn: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON):
    """(query row, candidate id, cosine) of the k best candidates of each query within its squared distance tau."""
    return scan_turned((qx, (qx @ turn).astype(np.float32)), tau, (cx, (cx @ turn).astype(np.float32)), cid, k, columns, epsilon)


def scan_turned(queries: tuple, tau: np.ndarray, candidates: tuple, cid: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON):
    """scan() of vectors that come with their rotation."""
    (qx, qr), (cx, cr) = queries, candidates
    width = qx.shape[1]
    none = np.zeros(0, np.int64)
    found = [(none, none.astype(cid.dtype), np.zeros(0))]
    for at in range(0, len(qx), ROWS):
        q, t = qr[at : at + ROWS], tau[at : at + ROWS]
        a, b = q[:, :columns], cr[:, :columns]
        part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        slack = (1 + epsilon / np.sqrt(columns)) ** 2 * columns / width
        qi, ci = np.nonzero(part <= t[:, None] * slack + 1e-6)
        dist = part[qi, ci]
        for done in range(columns, width, columns):
            edge = min(done + columns, width)
            diff = q[qi, done:edge] - cr[ci, done:edge]
            dist = dist + np.einsum("ij,ij->i", diff, diff)
            slack = (1 + epsilon / np.sqrt(edge)) ** 2 * edge / width if edge < width else 1.0 + 1e-5
            keep = dist <= t[qi] * slack + 1e-6
            qi, ci, dist = qi[keep], ci[keep], dist[keep]
        sims = np.round(np.einsum("ij,ij->i", qx[at + qi], cx[ci]), 9)
        best = _best(qi, cid[ci], sims, k)
        found.append((at + qi[best], cid[ci[best]], sims[best]))
    return [np.concatenate(x) for x in zip(*found)]


def bounds(n: int, q: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Squared distance of each of n queries to its k-th best found candidate (q, s); 4 where fewer are found."""
    order = np.lexsort((-s, q))
    starts = np.searchsorted(q[order], np.arange(n))
    ends = np.r_[starts[1:], len(order)]
    out = np.full(n, 4.0, np.float32)
    full = ends - starts >= k
    out[full] = 2 - 2 * s[order][starts[full] + k - 1]
    return out


def arrange(centres: np.ndarray, sizes: dict[int, int], most: int) -> list[list[int]]:
    """Lists grouped into units of about most vectors: halved by weight along the widest direction until they are small enough."""
    done, todo = [], [np.array(sorted(sizes), int)]
    while todo:
        some = todo.pop()
        weight = np.array([sizes[int(x)] for x in some])
        if len(some) < 2 or weight.sum() <= most:
            done.append([int(x) for x in some])
            continue
        x = centres[some] - centres[some].mean(axis=0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        order = np.argsort(along, kind="stable")
        half = int(np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)) + 1
        half = min(max(half, 1), len(some) - 1)
        todo += [some[order[half:]], some[order[:half]]]
    return done


def nearest(vectors: DataFrame, k: int = 5, width: int = WIDTH, probes: int = PROBES, epsilon: float = EPSILON) -> DataFrame:
    """(id, neighbours: array of (minus_sim, id)) for vectors (id, vec): the k most similar others, best first."""
    spark = vectors.sparkSession
    top = k + 1  # a vector's own class counts as one
    good = vectors.where(usable(F.col("vec"), width) & F.col("id").isNotNull())
    people = good.groupBy("id").agg(F.min("vec").alias("vec"))
    # equal vectors have equal 128 bits, so that the vectors themselves need not be compared or sent again
    people = cut(people.withColumn("v1", F.xxhash64("vec")).withColumn("v2", F.xxhash64(F.lit(SEED), "vec")))

    count = people.count()
    lists = int(min(LISTS, max(1, count**0.5)))
    share = min(1.0, SAMPLE / max(1, count))
    in_sample = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    sample = people.where(in_sample).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()
    if not len(sample):
        return spark.createDataFrame([], f"id {people.schema['id'].dataType.simpleString()}, neighbours array<struct<minus_sim: double, id: bigint>>")
    centres = fit_centroids(_unit(np.stack(sample["vec"].to_numpy())), lists)
    turn = rotation(width)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                raw = np.stack(pdf["vec"].to_numpy()).astype(np.float32)
                near = np.argmax(_unit(raw).astype(np.float32) @ centres.T, axis=1)
                yield pdf.drop(columns="vec").assign(list=near.astype("int32"), raw=[x.tobytes() for x in raw])

    order = Window.partitionBy("v1", "v2").orderBy("id")
    firsts = people.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    classes = firsts.groupBy("v1", "v2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    routed = cut(classes.mapInPandas(route, "v1 bigint, v2 bigint, ids array<bigint>, rep bigint, list int, raw binary"))
    sizes = {r["list"]: r["count"] for r in routed.groupBy("list").count().collect()}  # one row a centroid
    most = min(UNIT, max(1, -(-sum(sizes.values()) // UNITS)))
    first_unit, split, number = {}, {}, 0
    for unit in arrange(centres, sizes, most):
        n = -(-sizes[unit[0]] // (2 * most)) if len(unit) == 1 else 1  # a list too large for a unit has several
        for x in unit:
            first_unit[x], split[x] = number, n
        number += n
    where = spark.createDataFrame([(x, first_unit[x], split[x]) for x in sizes], "list int, first int, n int")
    placed = routed.select("rep", "raw", "list").join(F.broadcast(where), "list")  # one row a centroid
    placed = placed.select("rep", "raw", "list", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("n"))).cast("int").alias("unit"))

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["list", "rep"])
        unit, ids, raw, own = int(pdf["unit"].iloc[0]), pdf["rep"].to_numpy(), _vectors(pdf["raw"], width), pdf["list"].to_numpy()
        x = _unit(raw)
        xr, n = (x @ turn).astype(np.float32), len(x)
        here, starts = np.unique(own, return_index=True)
        ranges = {int(a): (int(b), int(c)) for a, b, c in zip(here, starts, np.r_[starts[1:], n])}
        got = []

        def compare(rows: np.ndarray, bound: np.ndarray, a: int, b: int) -> None:
            q, c, s = scan_turned((x[rows], xr[rows]), bound, (x[a:b], xr[a:b]), ids[a:b], top, epsilon=epsilon)
            got.append((rows[q], c, s))

        def found() -> tuple:
            q, c, s = (np.concatenate(y) for y in zip(*got))
            best = _best(q, c, s, top)
            got[:] = [(q[best], c[best], s[best])]
            return got[0]

        for a, b in ranges.values():
            compare(np.arange(a, b), np.full(b - a, 4.0, np.float32), a, min(b, a + PILOT))
        q, _, s = found()
        bound = bounds(n, q, s, top)
        for a, b in ranges.values():
            if b > a + PILOT:
                compare(np.arange(a, b), bound[a:b], a + PILOT, b)
        q, _, s = found()
        bound = bounds(n, q, s, top)

        # a list's vectors are nearer to its centroid than to this one, so they lie beyond the plane between the two
        many = min(probes, len(centres))
        goes, beyond = np.zeros((n, many), np.int32), np.zeros((n, many), np.float32)
        for a, b in ranges.values():
            home_list = int(own[a])
            apart = np.maximum(np.linalg.norm(centres - centres[home_list], axis=1), 1e-6)
            for at in range(a, b, ROWS):
                near = x[at : min(at + ROWS, b)].astype(np.float32) @ centres.T
                to = np.argpartition(-near, many - 1, axis=1)[:, :many]
                gap = (near[:, [home_list]] - np.take_along_axis(near, to, 1)) / apart[to]
                goes[at : at + len(near)], beyond[at : at + len(near)] = to, gap
        is_open = lambda: (beyond <= np.sqrt(np.maximum(bound, 0.0))[:, None] + 1e-3) & (goes != own[:, None])

        mine = np.isin(goes, here)
        who, at = np.nonzero(is_open() & mine)
        order_ = np.argsort(goes[who, at], kind="stable")
        who, to = who[order_], goes[who, at][order_]
        edges = np.flatnonzero(np.r_[True, np.diff(to) != 0, True]) if len(to) else []
        for a, b in zip(edges, edges[1:]):
            compare(who[a:b], bound[who[a:b]], *ranges[int(to[a])])
        q, c, s = found()
        bound = bounds(n, q, s, top)

        packed = [(None, 0.0, None, None, None, ids[q].tobytes(), c.tobytes(), s.tobytes())]
        target = np.array([first_unit.get(k, -1) for k in range(len(centres))])
        pieces = np.array([split.get(k, 1) for k in range(len(centres))])
        elsewhere = is_open() & (target[goes] >= 0) & ~(mine & (pieces[goes] == 1))
        own_too = pieces[own] > 1  # the rest of a list that has several units
        for i in np.flatnonzero(elsewhere.any(axis=1) | own_too):
            lists_ = goes[i][elsewhere[i]]
            lists_ = np.append(lists_, own[i]) if own_too[i] else lists_
            per: dict[int, list[int]] = {}
            for x_ in lists_:
                for u in range(target[x_], target[x_] + pieces[x_]):
                    if u != unit:
                        per.setdefault(int(u), []).append(int(x_))
            if per:
                packed.append((ids[i], float(bound[i]), raw[i].tobytes(), list(per), [np.array(v, np.int32).tobytes() for v in per.values()], None, None, None))
        return pd.DataFrame(packed, columns=["q", "bound", "raw", "units", "lists", "qs", "cs", "ss"])

    sent = placed.groupBy("unit").applyInPandas(
        home, "q bigint, bound float, raw binary, units array<int>, lists array<binary>, qs binary, cs binary, ss binary"
    )
    sent = cut(sent)
    travel = sent.where("q IS NOT NULL")
    loads = travel.select(F.explode("units").alias("unit")).groupBy("unit").count().collect()  # one row a unit
    cuts = spark.createDataFrame([(r["unit"], -(-r["count"] // SLICE)) for r in loads], "unit int, slices int")
    packs = travel.select("q", "bound", "raw", F.explode(F.arrays_zip("units", "lists")).alias("to")).select("q", "bound", "raw", "to.units", "to.lists")
    packs = packs.withColumnRenamed("units", "unit").join(F.broadcast(cuts), "unit").withColumn("slice", F.pmod(F.xxhash64("q"), F.col("slices")).cast("int"))
    wanted = placed.join(F.broadcast(cuts), "unit").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def visit(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": np.zeros(0, "int64"), "c": np.zeros(0, "int64"), "s": np.zeros(0)})
        if not len(queries) or not len(stored):
            return none
        stored = stored.sort_values("list")
        qid, bound, own = queries["q"].to_numpy(), queries["bound"].to_numpy(np.float32), stored["list"].to_numpy()
        qx, cx, cid = _unit(_vectors(queries["raw"], width)), _unit(_vectors(stored["raw"], width)), stored["rep"].to_numpy()
        qr, cr = (qx @ turn).astype(np.float32), (cx @ turn).astype(np.float32)
        asked = np.concatenate([np.frombuffer(x, np.int32) for x in queries["lists"]])
        who = np.repeat(np.arange(len(qid)), [len(x) // 4 for x in queries["lists"]])
        order_ = np.argsort(asked, kind="stable")
        asked, who = asked[order_], who[order_]
        edges = np.flatnonzero(np.r_[True, np.diff(asked) != 0, True])
        got = []
        for a, b in zip(edges, edges[1:]):
            lo, hi = np.searchsorted(own, [asked[a], asked[a] + 1])
            if lo < hi:
                rows = who[a:b]
                q, c, s = scan_turned((qx[rows], qr[rows]), bound[rows], (cx[lo:hi], cr[lo:hi]), cid[lo:hi], top, epsilon=epsilon)
                got.append((rows[q], c, s))
        if not got:
            return none
        q, c, s = (np.concatenate(y) for y in zip(*got))
        best = _best(q, c, s, top)
        return pd.DataFrame({"q": qid[q[best]], "c": c[best], "s": s[best]})

    keys = ["unit", "slice"]
    visits = packs.select(*keys, "q", "bound", "raw", "lists").groupBy(*keys).cogroup(wanted.select(*keys, "rep", "raw", "list").groupBy(*keys))
    visited = visits.applyInPandas(visit, "q bigint, c bigint, s double")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, c, s in zip(pdf["qs"], pdf["cs"], pdf["ss"]):
                yield pd.DataFrame({"q": np.frombuffer(q, np.int64), "c": np.frombuffer(c, np.int64), "s": np.frombuffer(s)})

    at_home = sent.where("q IS NULL").select("qs", "cs", "ss").mapInPandas(unpack, "q bigint, c bigint, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))
    best = at_home.unionByName(visited).withColumn("r", rank).where(F.col("r") <= top)

    named = best.join(routed.select(F.col("rep").alias("c"), "ids"), "c")
    listed = named.groupBy("q").agg(F.collect_list(F.struct("s", "ids")).alias("near"))
    entry = lambda x: F.transform(x["ids"], lambda i: F.struct((-x["s"]).alias("minus_sim"), i.alias("id")))
    listed = listed.select(F.col("q").alias("rep"), F.slice(F.array_sort(F.flatten(F.transform("near", entry))), 1, top).alias("near"))
    members = people.select("id", "v1", "v2").join(routed.select("v1", "v2", "rep"), ["v1", "v2"]).select("id", "rep")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return members.join(listed, "rep").select("id", others.alias("neighbours"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b) with a < b where at least one is a neighbour of the other, each pair once."""
    n = neighbours.select("id", F.explode("neighbours.id").alias("other"))
    return n.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
