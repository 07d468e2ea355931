"""Operators on small fixtures with answers worked out by hand, and against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from setlens.functions import geometry, texts
from setlens.functions.ids import plain_identity, plain_image, plain_name
from setlens.operators import calibration, matching, metrics, objectives, provenance, ranking, references, relational, sampling
from setlens.operators.audit import dense_ids


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_plain_ids(spark):
    df = spark.createDataFrame([(" 0020 ",), ("PID7",), ("-1",), ("",), (None,), ("\t",), ("000",), ("x",)], "i string")
    assert [r[0] for r in df.select(plain_identity(F.col("i"))).collect()] == ["20", "7", None, None, None, None, "0", "x"]
    df = spark.createDataFrame([("./val/1_02.JPG",), ("1_2  ",), (" ",), (None,), ("odd",)], "i string")
    assert [r[0] for r in df.select(plain_image(F.col("i"))).collect()] == ["1_02", "1_2", None, None, "odd"]
    assert spark.range(1).select(plain_name(F.lit("  Train \r"))).first()[0] == "train"


# ---- references


def test_orphans_equal_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(5)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=12 * n)
    parents = []
    for k in range(60):
        for _ in range(rng.randrange(3)):
            a = rng.randrange(300)
            parents.append(("image" if k % 2 else "identity", str(k), day(a), None if rng.random() < 0.3 else day(a + rng.randrange(1, 200))))
    parents += parents[:5] + [("image", "1", None, None), ("image", None, day(0), None)]
    refs = [("g" if rng.random() < 0.5 else "h", "image" if rng.random() < 0.5 else "identity", f"r{i % 400}", rng.choice([None, *map(str, range(70))]), rng.choice([None, *map(day, range(0, 480, 3))])) for i in range(900)]
    refs += [("g", "image", "r", "1", dt.datetime(2024, 2, 1))] * 300
    r = spark.createDataFrame([(*x, 1) for x in refs], "src_table string, kind string, record_key string, ref_key string, ref_time timestamp_ntz, m int")
    p = spark.createDataFrame([(*x, 1) for x in parents], "kind string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz, chunk int")
    want = set()
    for s, k, rec, key, t in refs:
        if key is not None and not any(pk == k and pkey == key and a is not None and t is not None and a <= t and (b is None or t < b) for pk, pkey, a, b in parents):
            want.add((s, t and t.strftime("%Y-%m"), rec, key))
    got = references.orphan_references(r, p).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert references.orphan_references(r.where("false"), p).count() == 0
    everything = references.orphan_references(r, p.where("false")).count()
    assert everything == len({(s, t and t.strftime("%Y-%m"), rec, key) for s, _, rec, key, t in refs if key is not None})
    report = references.orphan_report(references.orphan_references(r, p))
    assert report.agg(F.sum("orphan_refs")).first()[0] == len(want)


def test_a_reference_in_a_distant_year_costs_no_bit_for_each_month_between(spark):
    import datetime as dt
    import time

    t = dt.datetime(2024, 1, 5)
    parents = [("image", str(k), t, None) for k in range(20_000)]
    parents += [("image", "x", dt.datetime(2024, m, 1), dt.datetime(2024, m + 2, 1)) for m in (1, 2, 6)]
    refs = [("g", "image", "r1", "7", dt.datetime(9999, 12, 1)), ("g", "image", "r2", "8", dt.datetime(1900, 1, 1)), ("g", "image", "r3", "gone", t)]
    refs += [("g", "image", f"x{m}", "x", dt.datetime(2024, m, 20)) for m in range(1, 11)]
    r = spark.createDataFrame(refs, "src_table string, kind string, record_key string, ref_key string, ref_time timestamp_ntz")
    p = spark.createDataFrame(parents, "kind string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    began = time.time()
    got = {x["record_key"] for x in references.orphan_references(r, p).collect()}
    assert got == {"r2", "r3", "x4", "x5", "x8", "x9", "x10"}
    assert time.time() - began < 120


def test_bitmap_packing_round_trip():
    for on in ([], [0], [32767], range(2000), range(0, 32768, 3)):
        bits = np.zeros(references.BITS, np.uint8)
        bits[list(on)] = 1
        raw = np.packbits(bits, bitorder="little").tobytes()
        assert np.flatnonzero(references._unpack(references._pack(raw))).tolist() == list(on)


# ---- relational


def test_division_and_partial_overlap(spark):
    having = [(i, x) for i, xs in {"ABC": "ABC", "ABCD": "ABCD", "AC": "AC", "AB": "AB", "C": "C", "D": "D", "BC": "BC"}.items() for x in xs]
    have = spark.createDataFrame(having, "iid string, key string")
    need = spark.createDataFrame([("q", "A"), ("q", "B"), ("q", "C"), ("one", "D"), ("none", "Z")], "qid string, key string")
    assert rows(relational.division(need, have)) == [("one", "ABCD"), ("one", "D"), ("q", "ABC"), ("q", "ABCD")]
    subjects = spark.createDataFrame([("q", 0, "A"), ("q", 0, "B"), ("q", 1, "C"), ("one", 0, "D")], "qid string, subject int, key string")
    got = {r["iid"]: (r["overlap"], r["missing"], r["missing_subjects"]) for r in relational.partial_overlap(subjects, have).collect()}
    assert got == {"AC": (2, ["B"], []), "AB": (2, ["C"], [1]), "C": (1, ["A", "B"], [0]), "BC": (2, ["A"], [])}


def test_upsert_and_keys(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 11)], "k int, v string, pos bigint")
    new = spark.createDataFrame([(2, None, 1), (3, "c", 2)], "k int, v string, pos bigint")
    assert rows(relational.keyed_upsert(old, new, "k", "pos").select("k", "is_new", "pos")) == [(1, False, 10), (2, False, 11), (3, True, 2)]
    assert {r["k"]: r["v"] for r in relational.keyed_upsert(old, new, "k", "pos").collect()} == {1: "a", 2: None, 3: "c"}
    assert rows(relational.duplicate_keys(old.union(old.limit(1)), "k")) == [(1, 2)]
    assert rows(relational.key_differences(old, new, "k")) == [(1, "left"), (3, "right")]
    assert rows(relational.first_wins(old.union(new), ["k"], [F.col("pos").desc()]).select("k", "pos")) == [(1, 10), (2, 11), (3, 2)]


def test_dense_ids(spark):
    df = spark.createDataFrame([(x, f"n{x}") for x in (5, 1, 9, 3)], "a int, b string")
    assert rows(dense_ids(df, ["a"], "i").select("a", "i")) == [(1, 0), (3, 1), (5, 2), (9, 3)]


# ---- ranking and metrics


def test_average_precision_and_recall(spark):
    ranked = spark.createDataFrame([("q", i, r) for r, i in enumerate(["w", "p1", "s", "p2"], 1)], "q string, i string, r bigint")
    full = spark.createDataFrame([("q", "p1"), ("q", "p2")], "q string, i string")
    idp = spark.createDataFrame([("q", "p1"), ("q", "s"), ("q", "p2")], "q string, i string")
    for pos, n, want in ((full, 2, 0.5), (idp, 3, (1 / 2 + 2 / 3 + 3 / 4) / 3), (full, 4, 0.25)):
        sizes = spark.createDataFrame([("q", n), ("empty", 1)], "q string, n_pos bigint")
        hits = metrics.positive_ranks(ranked, pos, "q", "i", "r")
        got = {r["q"]: r for r in metrics.query_metrics(hits, sizes, "q", "r", (1, 5)).collect()}
        assert math.isclose(got["q"]["ap"], want) and (got["q"]["r1"], got["q"]["r5"]) == (0.0, 1.0)
        assert got["empty"]["ap"] == 0.0
        recall = {r["q"]: (r["recall"], r["hit"]) for r in metrics.candidate_recall(hits, sizes, "q", "r", 2).collect()}
        assert math.isclose(recall["q"][0], 1 / n) and recall["q"][1] == 1.0


def test_fusion_ties_and_unsupported(spark):
    inf = float("-inf")
    df = spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(zip([0.6, 0.6001, 0.2, 0.3], [1.0, 2.0, 0.0, inf]))], "i int, f double, c double").withColumn("q", F.lit(1))
    fused = df.withColumn("s", ranking.fuse(F.col("f"), F.col("c"), 0.15, "q")).withColumn("coarse_rank", F.lit(1) + F.col("i"))
    order = [r["i"] for r in fused.withColumn("n", ranking.rerank_head("q", "s", 4)).orderBy("n").collect()]
    assert order == [1, 0, 2, 3]
    assert fused.where("i = 3").first()["s"] == inf
    assert df.withColumn("s", ranking.fuse(F.col("f"), F.col("c"), 0, "q")).where("i = 3").first()["s"] == 0.3
    same = df.withColumn("z", ranking.zscore(F.lit(0.7), F.col("c") > inf, "q"))
    assert [r["z"] for r in same.orderBy("i").collect()] == [0.0, 0.0, 0.0, None]


def test_reranking_never_touches_the_tail(spark):
    df = spark.createDataFrame([(1, i, i + 1, float(i)) for i in range(10)], "q int, i int, coarse_rank bigint, s double")
    got = [r["n"] for r in df.withColumn("n", ranking.rerank_head("q", "s", 3)).orderBy("i").collect()]
    assert got == [3, 2, 1, 4, 5, 6, 7, 8, 9, 10]


def test_grid_equals_replay_and_first_maximum_wins(spark):
    rng = np.random.default_rng(3)
    data = [(f"q{q}", g, float(rng.normal()), float(rng.random()), float(rng.random()), float(rng.random())) for q in range(6) for g in range(12)]
    df = spark.createDataFrame(data, "sample_id string, gallery_index bigint, coarse double, binding double, coverage double, context double")
    df = df.withColumn("coarse_rank", ranking.complete_rank("sample_id", "coarse", "gallery_index"))
    pos = spark.createDataFrame([(f"q{q}", int(g)) for q in range(6) for g in rng.choice(12, 3, replace=False)], "sample_id string, gallery_index bigint")
    sizes = pos.groupBy("sample_id").count().withColumnRenamed("count", "n_pos")
    hits = metrics.positive_ranks(df, pos, "sample_id", "gallery_index", "coarse_rank")
    points = calibration.grid((0.0, 0.1), (0.0, 0.2), (0.0, 0.15))
    got = {r["grid_index"]: r["score"] for r in calibration.grid_scores(df.where("coarse_rank <= 5"), hits, sizes, points, 5).collect()}
    for i, a, b, w in points:
        head = df.where("coarse_rank <= 5").withColumn("f", calibration.linear_score(F.col("binding"), F.col("coverage"), F.col("context"), a, b))
        head = head.withColumn("s", ranking.fuse(F.col("f"), F.col("coarse"), w, "sample_id")).withColumn("s", F.col("s") if w == 0 else F.round("s", 6))
        final = head.withColumn("r", ranking.rerank_head("sample_id", "s", 5)).select("sample_id", "gallery_index", "r")
        final = final.unionByName(df.where("coarse_rank > 5").select("sample_id", "gallery_index", F.col("coarse_rank").alias("r")))
        h = metrics.positive_ranks(final, pos, "sample_id", "gallery_index", "r")
        want = metrics.query_metrics(h, sizes, "sample_id", "r").agg(F.avg("ap")).first()[0]
        assert math.isclose(got[i], want, rel_tol=1e-9)
    tied = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "grid_index int, score double")
    assert calibration.winner(tied, "score", "grid_index").first()["grid_index"] == 1


# ---- geometry and matching


def test_suppression_chain_and_threshold(spark):
    boxes = [(3.0, 0, 0.0, 0.0, 1.0, 1.0), (2.0, 1, 0.3, 0.0, 1.3, 1.0), (1.0, 2, 0.6, 0.0, 1.6, 1.0), (9.0, 3, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(boxes, "priority double, slot int, x1 double, y1 double, x2 double, y2 double")
    one = df.agg(F.collect_list(F.struct(*df.columns)).alias("b"))
    assert one.select(geometry.keep_boxes(F.col("b"), 0.5)).first()[0] == [0, 2]
    assert one.select(geometry.keep_boxes(F.col("b"), 1.0)).first()[0] == [0, 1, 2]
    exactly = (1 - 0.3) / 1.3
    assert one.select(geometry.keep_boxes(F.col("b"), exactly + 1e-12)).first()[0] == [0, 1, 2]


def test_letterbox_rounds_half_to_even(spark):
    b = geometry.letterbox(F.lit(0), F.lit(0), F.lit(5), F.lit(2), F.lit(5), F.lit(2), 25)
    r = spark.range(1).select(b.alias("b")).first()["b"]
    assert (r["x1"], r["x2"]) == (0.0, 1.0) and math.isclose(r["y1"], 8 / 25) and math.isclose(r["y2"], 18 / 25)


def test_greedy_pairs(spark):
    df = spark.createDataFrame([(0.2, "h1", 1), (0.1, "h1", 2), (0.3, "h2", 2), (0.4, "h2", 1)], "cost double, head string, person int")
    got = df.agg(geometry.greedy_pairs(F.collect_list(F.struct("cost", "head", "person"))).alias("m")).first()["m"]
    assert [(m["head"], m["person"]) for m in got] == [("h1", 2), ("h2", 1)]


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        rows_, cols = rng.integers(1, 5), rng.integers(1, 6)
        u = np.round(rng.random((rows_, cols)) - 0.3, 3)
        got = matching.assign(u)
        taken = [t for t in got if t >= 0]
        assert len(set(taken)) == len(taken)
        value = sum(u[q, t] for q, t in enumerate(got) if t >= 0)
        best = 0.0
        for pick in itertools.product(range(-1, cols), repeat=rows_):
            used = [t for t in pick if t >= 0]
            if len(set(used)) == len(used):
                best = max(best, sum(u[q, t] for q, t in enumerate(pick) if t >= 0))
        assert math.isclose(value, best, abs_tol=1e-9)


def test_partial_assignment_groups(spark):
    e = spark.createDataFrame([("a", 1, 1, 1, 0.5), ("a", 1, 2, 1, 0.9), ("a", 1, 2, 2, 0.8), ("b", 1, 1, 1, 0.1)], "qid string, iid bigint, q bigint, t bigint, gain double")
    assert rows(matching.partial_assignment(e).select("qid", "q", "t")) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]


def test_poolings(spark):
    members = [(1, 0.9, True, 0.8), (1, 0.1, False, 0.0), (2, 0.2, True, 0.2), (2, 0.8, False, 0.0)]
    df = spark.createDataFrame([(7, *m) for m in members], "k int, subject int, weight double, matched boolean, score double")
    r = matching.poolings(df, ["k"], 1.1).first()
    want = ((0.9 * 0.8 - 1.1 * 0.1) + (0.2 * 0.2 - 1.1 * 0.8)) / 2
    assert math.isclose(r["penalized"], want) and math.isclose(r["matched_mean"], 0.76 / 1.1) and math.isclose(r["subject_mean"], 0.5)
    assert math.isclose(r["coverage"], 0.55)


# ---- texts


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(texts.mentions(F.lit("Subject 1 and Subject  12, Subjects 3"))) == [1, 12]
    parts = one(texts.selection_parts(F.lit("Identify Subject 1 as the man and woman and Subject 2 as a cat")))
    assert [(p["subject_id"], p["description"]) for p in parts] == [(1, "the man and woman"), (2, "a cat")]
    change = F.lit("Then retrieve target images where the members of Subject 1 are near Subject 2 who were there")
    assert one(texts.condition(change, F.lit(1))) == "the reference person is near the other referenced person (Subject 2) who were there"
    swap = one(texts.swapped(F.lit("x where Subject 1 is now standing directly to the left of Subject 2 today")))
    assert swap == "x where Subject 1 is now standing directly to the right of Subject 2 today"
    assert one(texts.swapped(F.lit("Subject 1 to the left of Subject 1"))) is None
    for url, want in (("http://h/data/?d=a%2FPIPA%2Fimages%2Ftrain%2F1.jpg", "train/1.jpg"), ("/x/images/val\\2.jpg", "val/2.jpg"), ("/images/../etc", None), ("http://h", None), ("plain/3.jpg", "plain/3.jpg")):
        assert one(texts.safe_path(F.lit(url))) == want, url


def test_long_addresses_stay_whole(spark, tmp_path):
    from setlens.plans.texts import url_paths

    paths = {f"7_{k}": "train/" + "folder/" * 300 + f"7_{k}.jpg" for k in range(10, 15)}
    spark.createDataFrame(list(paths.items()), "image_id string, path string").write.parquet(f"{tmp_path}/images.parquet")
    assert {r["image_id"]: r["safe"] for r in url_paths(spark, str(tmp_path)).collect()} == paths | {"7_13": None}  # that one climbs up


# ---- sampling


def test_derived_seed(spark):
    import hashlib

    for seed, stream, i in ((0, "a", 0), (17, "mining", 5), (3, "é", 99)):
        want = int.from_bytes(hashlib.sha256(f"{seed}:{stream}:{i}".encode()).digest()[:8], "big") >> 1
        assert spark.range(1).select(sampling.derive_seed(seed, stream, i)).first()[0] == want


def test_candidate_quotas():
    gallery = list(range(1000, 1200))
    same, hard = gallery[2:60], gallery[60:120]
    row = sampling.candidate_row(7, gallery[:2], same, same[:40], hard, {}, gallery, [{"A"}], size=32, f_identity=0.5, f_semantic=0.3, f_hard=0.1, partial_quota=0)
    roles = [r for _, r in row]
    assert len(row) == 32 and len({i for i, _ in row}) == 32
    assert roles.count("positive") == 2 and roles.count("semantic_hard") == 5 and roles.count("identity_hard") == 3
    assert {i for i, r in row if r == "semantic_hard"} <= set(same[:10]) and {i for i, r in row if r == "identity_hard"} <= set(hard[:6])
    assert sum(i in same for i, _ in row) >= 15
    assert row == sampling.candidate_row(7, gallery[:2], same, same[:40], hard, {}, gallery, [{"A"}], size=32, f_identity=0.5, f_semantic=0.3, f_hard=0.1, partial_quota=0)


def test_candidate_rows_are_those_of_whole_pools(spark):
    from setlens.plans import catalog as c
    from setlens.plans.sampling import candidate_quota

    d = "/root/testdata/sf0.01"
    listed = lambda df: {r[0]: r[1] for r in df.collect()}
    pos = listed(c.positives(spark, d).groupBy("sample_id").agg(F.collect_set("gallery_index")))
    has = listed(c.image_identity(spark, d).join(c.gallery(spark, d), "image_id").groupBy("gallery_pos").agg(F.collect_set("identity_id")))
    ranked = c.scored(spark, d).groupBy("sample_id", "query_index").agg(F.array_sort(F.collect_list(F.struct(-F.col("coarse"), "gallery_index"))).alias("all"))
    req: dict = {}
    for r in c.required(spark, d).collect():
        req.setdefault(r["sample_id"], {}).setdefault(r["subject_id"], set()).add(r["identity_id"])
    want, large = {}, 0
    for q in ranked.collect():
        subjects = req.get(q["sample_id"])
        if not subjects:
            continue
        keys, items = set().union(*subjects.values()), [x["gallery_index"] for x in q["all"]]
        positives = [i for i in items if i in set(pos.get(q["sample_id"], ()))]
        rest = [i for i in items if i not in set(positives)]
        have = {i: keys & set(has.get(i, ())) for i in rest}
        same = [i for i in rest if have[i]]
        partial = {i: (frozenset(keys - have[i]), frozenset(int(s) - 1 for s, k in subjects.items() if not k & have[i]), len(have[i])) for i in same if len(have[i]) < len(keys)}
        row = sampling.candidate_row(q["query_index"], positives, same, same, [i for i in rest if not have[i]], partial, rest, [subjects[s] for s in sorted(subjects)])
        want |= {(q["sample_id"], k): x for k, x in enumerate(row)}
        large += len(items) > 256
    got = {(r["sample_id"], r["pos"]): (r["gallery_index"], r["role"]) for r in candidate_quota(spark, d).collect()}
    assert large and got == want


def test_partial_top_up():
    draw = lambda items, k: sorted(items)
    pool = {f"s{i}": (frozenset(["A" if i % 2 else "B"]), frozenset(), 2) for i in range(6)} | {f"m{i}": (frozenset(["A", "B"]), frozenset([0]), 1) for i in range(3)}
    slots = [{"A", "B"}, {"C"}]
    got = sampling.top_up_partial(pool, ["m0", "m1"], 10, 6, slots, draw)
    assert len(got) == 4 and sum(len(pool[i][0]) == 1 for i in got) == 4
    got = sampling.top_up_partial(pool, [], 1, 6, slots, draw)
    assert got == ["s0"]
    assert len(sampling.top_up_partial({"m0": pool["m0"]}, [], 9, 6, slots, draw)) == 1
    assert sampling.top_up_partial({}, [], 9, 6, slots, draw) == []
    balanced = sampling.top_up_partial(pool, ["s1", "s3"], 1, 3, slots, draw)
    assert pool[balanced[0]][1] or pool[balanced[0]][0] == frozenset(["B"])


def test_number_within(spark):
    df = spark.createDataFrame([("a" if i < 90 else "b", f"x{i}") for i in range(100)], "g string, o string")
    got = sampling.number_within(df, "g", "o", "n")
    per = {}
    for r in got.collect():
        per.setdefault(r["g"], []).append(r["n"])
    assert sorted(per["a"]) == list(range(90)) and sorted(per["b"]) == list(range(10))


# ---- objectives


@pytest.mark.parametrize(
    "margin,residual,temperature,want",
    [(0.08, 0.03, 0.1, 0), (0.08, 0.11, 0.1, 0.3), (-0.08, -0.03, 0.1, 0), (-0.08, 0.03, 0.1, 0.3), (0, 0.03, 0.1, 0.3), (0, -0.03, 0.1, 0), (0.08, 0.11, 0.2, 0.15)],
)
def test_hinge(spark, margin, residual, temperature, want):
    df = spark.createDataFrame([(1, float(margin), 0.0, 0.0, float(residual))], "q int, base_p double, base_n double, context_p double, context_n double")
    assert math.isclose(objectives.rejection_hinge(df, "q", temperature).first()["value"], want, abs_tol=1e-9)
    assert objectives.rejection_hinge(df.where("false"), "q", temperature).first()["value"] == 0


def test_softplus_pairs_and_pair_error(spark):
    inf = float("-inf")
    df = spark.createDataFrame([(1, 1.0, True), (1, 2.0, False), (1, 0.0, False), (1, inf, False), (2, 1.0, True), (3, 1.0, True), (3, 1.0, False)], "q int, s double, p boolean")
    pairs = objectives.score_pairs(df, "q", "s", "p")
    sp = lambda x: math.log1p(math.exp(x))
    r = objectives.pairwise_softplus(pairs, "q", 1.0).first()
    assert math.isclose(r["value"], ((sp(1) + sp(-1)) / 2 + sp(0)) / 2) and r["queries"] == 2
    assert objectives.pair_error(df, "q", "s", "p").first()["value"] == (0.5 + 1) / 2


def test_contrastive_and_grounding(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(1, i, 0 if i < 2 else 1, x) for i, x in enumerate(v)], "block int, id int, label int, vec array<double>")
    r = objectives.contrastive(df, 1.0).first()
    assert math.isclose(r["value"], math.log(math.e + 1) - 1, rel_tol=1e-9) and r["anchors"] == 2
    cells = spark.createDataFrame([(1, 1, 0.0, True), (1, 1, 0.0, False), (1, 1, 0.0, False), (1, 2, 0.0, True)], "q int, s int, logit double, inside boolean")
    assert math.isclose(objectives.balanced_bce(cells, "q", "s").first()["value"], math.log(2))


# ---- provenance


def test_fingerprints_ignore_order_and_see_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    fp = lambda x: provenance.table_fingerprint(x.select(F.lit(1).alias("g"), provenance.row_digest("i", "s").alias("h")), "h", "g").first()["fingerprint"]
    assert fp(df) == fp(df.orderBy(F.desc("i")).repartition(3))
    assert fp(df) != fp(df.withColumn("s", F.coalesce("s", F.lit(""))))


def test_append_missing_builds_each_key_once(spark):
    seen = []

    def build(keys):
        seen.append(sorted(r["k"] for r in keys.collect()))
        return keys.select("k", (F.col("k") * 10).alias("v"))

    store = provenance.append_missing(None, spark.createDataFrame([(1,), (1,)], "k int"), "k", build)
    store = provenance.append_missing(store, spark.createDataFrame([(1,), (2,)], "k int"), "k", build)
    assert rows(store) == [(1, 10), (2, 20)] and seen == [[1], [2]]


# ---- rankings of hot queries, conflicts, calibration


def test_complete_ranks_and_moments_of_a_query_with_half_of_all_rows(spark):
    import random

    rng = random.Random(31)
    data = [("hot", i, rng.choice([float("-inf"), 0.0, -0.0, round(rng.random(), 2)])) for i in range(3000)]
    data += [(f"q{i % 60}", i, round(rng.random(), 1)) for i in range(3000)] + [("flat", i, 0.5) for i in range(5)] + [("none", i, float("-inf")) for i in range(3)]
    df = spark.createDataFrame([(*x, 1) for x in data], "q string, i bigint, s double, before int")
    got = {(r["q"], r["i"]): r["rank"] for r in ranking.complete_ranks(df, "q", "s", "i", "rank").collect()}
    want = {}
    for q in {x[0] for x in data}:
        for k, (_, i) in enumerate(sorted((-s + 0.0, i) for g, i, s in data if g == q), 1):
            want[(q, i)] = k
    assert got == want
    valid = F.col("s") > ranking.NONE
    a = {(r["q"], r["i"]): r["z"] for r in ranking.moments_zscore(df, F.col("s"), valid, "q", "z").collect()}
    b = {(r["q"], r["i"]): r["z"] for r in df.withColumn("z", ranking.zscore(F.col("s"), valid, "q")).collect()}
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)
    assert ranking.complete_ranks(df.where("false"), "q", "s", "i", "rank").count() == 0


def test_disputed_counts_equal_listed_votes(spark):
    import random

    from setlens.operators import audit

    rng = random.Random(37)
    data = [(f"s{k}", f"c{rng.randrange(6)}", rng.choice([None, "a", "b", "x"]), sorted(set(rng.choices("abcdxy", k=rng.randrange(4))))) for k in range(60)]
    df = spark.createDataFrame(data, "sample_id string, class_key string, query_image_id string, positives array<string>")
    want = set()
    for c in {x[1] for x in data}:
        rows = [x for x in data if x[1] == c]
        for image in sorted({p for x in rows for p in x[3]}):
            votes = [image in x[3] for x in rows if x[2] != image]
            if len(set(votes)) > 1:
                want.add((c, image, sum(votes), len(votes) - sum(votes)))
    assert {tuple(x) for x in audit.disputed(df).collect()} == want and want


def test_selection_over_artifacts_and_frozen_settings(spark):
    import pytest

    a = spark.createDataFrame([(0, 0.1, 0.5), (1, 0.2, 0.7)], "grid_index int, coverage_weight double, score double")
    b = spark.createDataFrame([(0, 0.1, 0.7), (1, 0.3, 0.6)], "grid_index int, coverage_weight double, score double")
    best = calibration.select([("one", a), ("two", b)]).first()
    assert (best["artifact"], best["grid_index"], best["global_index"]) == ("one", 1, 1)
    best = calibration.select([("two", b.withColumn("score", F.col("score") + 1)), ("one", a)]).first()
    assert (best["artifact"], best["global_index"]) == ("two", 0)
    config = {"calibration": {"x": 1}, "retrieval": {"coverage_weight": 0.0, "topm": 500}}
    assert calibration.frozen(config, {"coverage_weight": 0.2}) == {"retrieval": {"coverage_weight": 0.2, "topm": 500}}
    calibration.refuse_changes({"topm": 500, "beta": 1}, {"topm": 500, "coverage_weight": 0.3}, ("topm", "beta"))
    with pytest.raises(ValueError, match="topm"):
        calibration.refuse_changes({"topm": 500}, {"topm": 20}, ("topm", "beta"))
    with pytest.raises(ValueError):
        calibration.select([])


def test_relations_are_read_between_mentions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    cases = [
        ("Subject 1 sitting on the right of Subject 2.", "Subject 1 sitting on the right of Subject 2.", None),
        ("Subject 1 is sitting on the right of subject 2.", None, "Subject 1 is sitting on the left of subject 2."),
        ("Subject 1 to the left of Subject 2 to the left of Subject 3", None, "Subject 1 to the right of Subject 2 to the left of Subject 3"),
        ("Subject 1 to the left of Subject 2, Subject 3 to the left of Subject 4", "two", None),
        ("", "empty", None),
        (None, "null", None),
    ]
    for text, _, want in cases:
        assert one(texts.swapped(F.lit(text).cast("string"))) == want, text
    assert one(texts.condition(F.lit("then retrieve target images where  Subject 02 have members of Subject 10 are"), F.lit(2))) == (
        "the reference person has the other referenced person (Subject 10) is"
    )
    assert one(texts.condition(F.lit(None).cast("string"), F.lit(2))) is None


def test_meet_divides_a_popular_key(spark):
    """All pairs come out once, and those of one key from several blocks."""
    left = spark.createDataFrame([(f"q{i}", "hot" if i < 7 else "cold") for i in range(9)], "qid string, key string")
    right = spark.createDataFrame([(f"i{i}", "hot" if i < 8 else "cold") for i in range(10)], "iid string, key string")
    got = relational.meet(left, right, ["key"], "qid", "iid", rows=2)
    assert got.exceptAll(left.join(right, "key")).isEmpty() and got.count() == 7 * 8 + 2 * 2
    assert "_a" in got._jdf.queryExecution().executedPlan().toString()
