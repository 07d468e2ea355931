"""The training-data operators against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest

from setlens.llm import components, encode, mixing, neighbours, overlap, quota_sample, sentences, splits, topn
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- 1


def union_find(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_chain_hub_and_singletons(spark):
    rng = random.Random(3)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [(f"h{i:03}", "h000") for i in range(80)]
    links += [(f"r{rng.randrange(90):02}", f"r{rng.randrange(90):02}") for _ in range(60)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a string, b string"))))
    want = union_find([x for x in links if x[0] != x[1]])
    assert got == want


def test_key_components_nulls_repeats_and_clashing_columns(spark):
    data = [("s1", ["a", None], 1), ("s1", ["b"], 2), ("s2", ["b", "b"], 3), ("s3", [], 4), ("s4", None, 5), (None, ["a"], 6), ("s5", ["z"], 7)]
    df = spark.createDataFrame(data, "sample string, keys array<string>, root int")
    got = rows(splits.key_components(df, "sample", F.coalesce(F.col("keys"), F.array().cast("array<string>"))).fillna("-"))
    assert got == [("s1", "a"), ("s2", "a"), ("s3", "-"), ("s4", "-"), ("s5", "z")]
    empty = df.where("false")
    assert rows(splits.key_components(empty, "sample", F.col("keys"))) == []


def test_differencing_balances_and_keeps_all():
    rng = random.Random(5)
    items = [(float(w), k) for k, w in enumerate(rng.choices(range(1, 30), k=300))]
    loads, members = splits.differencing(items, 8)
    assert sorted(m for ms in members for m in ms) == list(range(300))
    assert np.allclose(loads, [sum(items[m][0] for m in ms) for ms in members])
    assert loads.max() - loads.min() <= 2
    assert splits.differencing([], 4)[0].tolist() == [0, 0, 0, 0]


def test_assign_splits_keeps_groups_whole_and_meets_shares(spark):
    rng = random.Random(7)
    data = [(f"s{i:05}", None if rng.random() < 0.2 else f"g{rng.randrange(400):04}") for i in range(3000)]
    data += [(f"t{i:05}", "g_hot") for i in range(1500)]
    members = spark.createDataFrame(data, "id string, root string")
    got = rows(splits.assign_splits(members, [("train", 0.6875), ("val", 0.125), ("test", 0.1875)], bins=64, slices=4))
    assert [x[0] for x in got] == sorted(x[0] for x in data)
    per = {}
    for _, root, split in got:
        per.setdefault(root, set()).add(split)
    assert all(len(x) == 1 for x in per.values())
    share = {s: sum(x[2] == s for x in got) / len(got) for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.6875) < 0.02 and abs(share["val"] - 0.125) < 0.02 and abs(share["test"] - 0.1875) < 0.02
    assert rows(splits.assign_splits(members.where("false"), [("train", 1.0)])) == []
    none = splits.assign_splits(members.limit(5), [])
    assert none.where("split IS NOT NULL").count() == 0


# ---- 3


def brute_top(data, n):
    best = {}
    for g, i, s in data:
        if g is None or i is None or s is None or s != s or s == float("inf"):
            continue
        best[(g, i)] = max(best.get((g, i), float("-inf")), s)
    out = []
    for g in {k[0] for k in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, i, -s + 0.0, r) for r, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("shares", [(), (0.125, 0.5), (0.02, 0.1, 0.3, 0.9)])
def test_top_n_equals_brute_force(spark, shares):
    rng = random.Random(11)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.5]
    data = [(f"g{min(rng.randrange(1, 40), 30)}", rng.randrange(60), rng.choice(odd) if rng.random() < 0.2 else round(rng.random(), 1)) for _ in range(3000)]
    data += [("hot", rng.randrange(900), round(rng.random(), 2)) for _ in range(1500)] + [(None, 1, 0.5), ("g1", None, 0.5)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(data)], "g string, i bigint, s double, placed int")
    got = rows(topn.top_n(df, "g", "i", "s", 10, shares))
    assert got == brute_top(data, 10)
    assert rows(topn.top_n(df.where("false"), "g", "i", "s", 10, shares)) == []


def test_the_report_counts_groups_exactly(spark):
    from setlens.llm.queries import QUERIES

    d = "/root/testdata/sf0.1"
    want: dict = {}
    for r in QUERIES["p1_splits"](spark, d).collect():
        want.setdefault(r["split"], []).append(r["group_key"])
    got = {r["split"]: (r["samples"], r["groups"]) for r in QUERIES["p1_report"](spark, d).collect() if r["samples"]}
    assert got == {s: (len(keys), len(set(keys))) for s, keys in want.items()}


def test_top_n_drops_rows_of_filled_hot_groups(spark):
    data = [("hot", i, float(i % 997)) for i in range(25_000)] + [("small", i, float(-i)) for i in range(5)]
    df = spark.createDataFrame(data, "g string, i bigint, s double")
    assert rows(topn.top_n(df, "g", "i", "s", 3, (0.1,))) == brute_top(data, 3)


# ---- 4


def test_quotas_floors_caps_and_redistribution():
    t = [("A", 0.5, 2), ("B", 0.25, 2), ("C", 0.25, 2)]
    assert quota_sample.quotas(100, t, {"A": 1000, "B": 1000, "C": 1000}) == {"A": 50, "B": 25, "C": 25}
    got = quota_sample.quotas(100, t, {"A": 1000, "B": 1000, "C": 3})
    assert got["C"] == 3 and sum(got.values()) == 100
    assert quota_sample.quotas(3, t, {"A": 9, "B": 9, "C": 9}) == {"A": 2, "B": 2, "C": 2}
    assert quota_sample.quotas(10, [("A", 0.5, 0), ("B", 0.5, 7)], {"A": 9, "B": 9}) == {"A": 3, "B": 7}
    assert quota_sample.quotas(10, t, {}) == {"A": 0, "B": 0, "C": 0}
    assert sum(quota_sample.quotas(7, [("A", 1 / 3, 0), ("B", 1 / 3, 0), ("C", 1 / 3, 0)], {"A": 9, "B": 9, "C": 9}).values()) == 7


def test_draw_samples_takes_the_smallest_keys(spark):
    data = [(f"s{i}", "A" if i % 3 else "B") for i in range(5000)]
    df = spark.createDataFrame(data, "id string, category string")
    targets = spark.createDataFrame([(1, "A", 0.5, 5, 0.25), (1, "B", 0.5, 5, 0.25), (2, "B", 1.0, 9999, 0.1), (2, "X", None, None, 0.1)], "draw_id int, category string, target_share double, min_rows int, draw_fraction double")
    plan = quota_sample.plan_draws(df, targets, ["A", "B"])
    got = quota_sample.draw_samples(df, plan)
    counts = {(r["draw_id"], r["category"]): r["count"] for r in got.groupBy("draw_id", "category").count().collect()}
    assert counts == {(p["draw_id"], p["category"]): p["quota"] for p in plan if p["quota"]}
    assert [(p["category"], p["met"], p["shortfall"]) for p in plan if p["draw_id"] == 2] == [("B", False, 9999 - 1667), ("X", True, 0)]
    from setlens.shared import unit_hash

    keys = sorted((r[1], r[0]) for r in df.where("category = 'A'").select("id", unit_hash("draw", F.lit(1), F.col("id"))).collect())
    want = {i for _, i in keys[: counts[(1, "A")]]}
    assert {r["id"] for r in got.where("draw_id = 1 AND category = 'A'").collect()} == want
    none = quota_sample.plan_draws(df.where("false"), targets, ["A", "B"])
    assert quota_sample.draw_samples(df, none).count() == 0


# ---- 5


def exact_neighbours(vectors, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(m @ m.T, 9)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-sims[a, j], ids[j]))[:k]] for a, i in enumerate(ids)}


def test_neighbours_are_exact_on_clusters_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    vectors = {i: (centres[i % 12] + 0.2 * rng.normal(size=64)).astype(np.float32) for i in range(500)}
    for i in range(500, 540):
        vectors[i] = vectors[3]
    vectors[541] = vectors[5] * np.float32(2)
    data = [(int(i), [float(x) for x in v]) for i, v in vectors.items()]
    bad = [(900, None), (901, [0.0] * 64), (902, [1.0] * 32), (903, [float("nan")] * 64), (904, [None] * 64), (None, [1.0] * 64), data[7]]
    df = spark.createDataFrame([(*x, 1) for x in data + bad], "id bigint, vec array<float>, unit int")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbours.nearest(df, 5).collect()}
    assert got == exact_neighbours(vectors, 5)
    assert neighbours.nearest(df.where("false"), 5).count() == 0
    few = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbours.nearest(df.where("id < 3"), 5).collect()}
    assert few == exact_neighbours({i: vectors[i] for i in range(3)}, 5)


def test_neighbours_across_units_slices_and_divided_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "UNITS", 9)
    monkeypatch.setattr(neighbours, "SLICE", 40)
    monkeypatch.setattr(neighbours, "PILOT", 8)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 64))
    near = {i: (centres[0] + 0.05 * rng.normal(size=64)).astype(np.float32) for i in range(300)}  # a third and more in one list
    vectors = near | {i: (centres[i % 6] + 0.3 * rng.normal(size=64)).astype(np.float32) for i in range(300, 700)}
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors.items()], "id bigint, vec array<float>")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbours.nearest(df, 5).collect()}
    want = exact_neighbours(vectors, 5)
    assert got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.99 * 5 * len(want)


def test_units_hold_all_lists_and_keep_to_their_size():
    rng = np.random.default_rng(6)
    sizes = {i: int(rng.integers(1, 50)) for i in range(90)} | {90: 5000}
    units = neighbours.arrange(rng.normal(size=(91, 64)), sizes, 200)
    assert sorted(x for u in units for x in u) == sorted(sizes)
    assert all(sum(sizes[x] for x in u) <= 200 or len(u) == 1 for u in units) and len(units) > 9


def test_scan_gives_up_only_distant_candidates():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    c = base[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 64))
    q = base + 0.3 * rng.normal(size=(40, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    sims = np.round(q @ c.T, 9)
    kth = -np.sort(-sims, axis=1)[:, 5]
    qi, ci, _ = neighbours.scan(q, (2 - 2 * kth).astype(np.float32), c, np.arange(3000), neighbours.rotation(64), 6)
    found = sum(len(set(ci[qi == k]) & set(np.argsort(-sims[k])[:6])) for k in range(40))
    assert found >= 0.99 * 240


# ---- 6


def words(text):
    return frozenset(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower()))


@pytest.mark.parametrize("least", [None, 0])
def test_overlap_equals_brute_force(spark, monkeypatch, least):
    if least is not None:  # every bucket of two classes or more counts as full and is divided
        monkeypatch.setattr(overlap, "LEAST", least)
        monkeypatch.setattr(overlap, "SEEN", 1)
        monkeypatch.setattr(overlap, "FULL", 0.005)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.sample(vocabulary, 30)) for _ in range(60)]
    data = []
    for i in range(300):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(5)):
            t[rng.randrange(30)] = rng.choice(vocabulary)
        data.append((f"s{i:03}", " ".join(t).upper() if i % 7 == 0 else ", ".join(t), rng.random() < 0.5, rng.random() < 0.5))
    data += [("n1", None, True, True), ("n2", "...", True, True), ("n3", "", True, False), ("u1", "ﬁne Ｗｏｒｄ", True, True), ("u2", "fine word", False, True)]
    df = spark.createDataFrame(data, "id string, text string, l boolean, r boolean").withColumn("words", overlap.word_set(F.col("text")))
    pairs, members = overlap.similar_across(df, F.col("l"), F.col("r"))
    left = members.where("is_left").select(F.col("rep").alias("left_rep"), F.col("id").alias("x"))
    right = members.where("is_right").select(F.col("rep").alias("right_rep"), F.col("id").alias("y"))
    got = {tuple(x) for x in pairs.join(left, "left_rep").join(right, "right_rep").select("x", "y").collect()}
    w = {i: words(t) for i, t, _, _ in data if t and words(t)}
    want = {(a, b) for a, _, la, _ in data if la for b, _, _, rb in data if rb and a in w and b in w and len(w[a] & w[b]) >= 0.8 * len(w[a] | w[b])}
    assert got == want
    pairs, _ = overlap.similar_across(df.where("false"), F.col("l"), F.col("r"))
    assert pairs.count() == 0


# ---- 7


def test_encoding_equals_the_tokenizer_for_long_and_odd_texts(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    rng = random.Random(13)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    letters = "".join(chr(c) for c in range(0x4E00, 0x4E60)) + "abcdefgh" * 4 + "ภาพที่กนส"
    texts = [None, "", " ", "a", "<|endoftext|> it's", "​🙂" * 50, "x" * 5000, "ab" * 3001, "   " * 900 + "y", "don't " * 900]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 6000))) for _ in range(25)]
    texts += ["".join(rng.choices(letters + "   \n.'!", k=4000)) for _ in range(10)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(0, None, 2)], "doc_id bigint, text string, seq int")
    got = sorted((r["id"], list(r["ids"])) for r in encode.encode_texts(df, "doc_id", "text", limit=256).collect())
    want = sorted((i, t.encode(x or "", add_special_tokens=False).ids) for i, x in [*enumerate(texts), (0, None)])
    assert got == want


def test_encoding_joins_at_every_border(spark):
    enc = encode.encoding(*encode.default_vocabulary())
    texts = ["x" * k + " a.\n\nFoo\t\tbar  9\r\n\r\n." * 12 for k in range(64)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: list(r["ids"]) for r in encode.encode_texts(df, "doc_id", "text", limit=64).collect()}
    assert got == {i: enc.encode_ordinary(x) for i, x in enumerate(texts)}
    counted = encode.count_tokens(df, F.col("text"), limit=64)
    assert counted.columns == ["doc_id", "text", "tokens"]
    assert {r["doc_id"]: r["tokens"] for r in counted.collect()} == {i: len(x) for i, x in got.items()}


def joined(text, limit):
    e = encode.Encoder.of(*encode.default_vocabulary(), limit=limit)
    parts = [e.part(x) for x in encode.halves(text, 1 << (-(-len(text) // limit) - 1).bit_length())]
    while len(parts) > 1:
        parts = [e.join(parts[k], parts[k + 1]) for k in range(0, len(parts), 2)]
    return parts[0]


@pytest.mark.parametrize("limit", [16, 100])
def test_joins_of_odd_texts_are_exact(limit):
    enc = encode.encoding(*encode.default_vocabulary())
    rng = random.Random(limit)
    bits = ["a", "  ", "'ll", "'", "re", "!!", " ", "\n\n", "é", "戴", "9"]
    texts = ["!'" * 900, "'s" * 900, "\n \n" * 500, " " * 1500 + "x", "\t" * 900 + "  x" * 10, "!" * 700 + "'ll " + "9" * 700]
    texts += ["".join(rng.choice(bits) * rng.choice([1, 1, 1, 2, 30, 200]) for _ in range(60)) for _ in range(60)]
    for text in texts:
        part = joined(text, limit)
        assert part.text == text and part.ids.tolist() == enc.encode_ordinary(text)
        assert part.chars.sum() == len(text) and part.counts.sum() == len(part.ids)


def test_a_long_text_without_breaks_goes_through_the_tree(spark):
    enc = encode.encoding(*encode.default_vocabulary())
    rng = random.Random(19)
    text = "".join(rng.choices("abcdefghijklmnop", k=400_000))
    long = text * 26  # more than 10 MB without any break
    df = spark.createDataFrame([(1, text), (2, long)], "doc_id bigint, text string")
    got = {r["id"]: r["ids"] for r in encode.encode_texts(df, "doc_id", "text").collect()}
    assert got[1] == enc.encode_ordinary(text)
    assert enc.decode_bytes(got[2]) == long.encode()
    # a sequence is the encoding of its bytes if every two neighbours are the encoding of theirs
    pairs = {x for x in zip(got[2], got[2][1:])}
    assert all(enc._encode_single_piece(enc.decode_bytes(list(p))) == list(p) for p in pairs)


# ---- 8


def test_shares_hold_limits_and_hand_on_what_is_left():
    t = [{"mix_id": 1, "source": s, "weight": w, "max_repeats": r, "fraction": 1.0} for s, w, r in (("a", 1.0, 2), ("b", 1.0, 5), ("c", 2.0, 1), ("none", 1.0, 3))]
    plan = {p["source"]: p for p in mixing.shares(t, {"a": 10, "b": 1000, "c": 400})}
    assert plan["a"]["whole"] == 2 and plan["a"]["rest"] == 0
    assert plan["c"]["whole"] == 1 and plan["c"]["rest"] == 0
    assert plan["none"]["available"] == 0 and plan["none"]["whole"] == 0
    assert abs(plan["b"]["whole"] * 1000 + plan["b"]["rest"] - (1410 - 420)) < 1e-6


def test_mix_reaches_sizes_and_limits(spark):
    rng = random.Random(17)
    docs = [(i, "big" if i % 10 else "small", rng.randrange(0, 80)) for i in range(4000)] + [(9001, None, 50), (9002, "other", 70)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    there = {s: sum(t for _, x, t in docs if x == s) for s in ("big", "small")}
    t = [{"mix_id": 1, "source": "big", "weight": 0.4, "max_repeats": 1, "fraction": 0.3}, {"mix_id": 1, "source": "small", "weight": 0.6, "max_repeats": 3, "fraction": 0.3}]
    plan = mixing.shares(t, there)
    got = mixing.mix_sources(df, plan).collect()
    size = {s: sum(r["tokens"] * r["copies"] for r in got if r["source"] == s) for s in there}
    for p in plan:
        want = p["whole"] * p["available"] + p["rest"]
        assert abs(size[p["source"]] - want) <= 80
        assert max(r["copies"] for r in got if r["source"] == p["source"]) <= p["whole"] + 1
    assert len({r["doc_id"] for r in got}) == len(got)
    assert mixing.mix_sources(df.where("false"), plan).count() == 0
    report = {r["source"]: r for r in mixing.mix_report(mixing.mix_sources(df, plan), plan).collect()}
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9


def test_weights_tilt_the_sample(spark):
    df = spark.createDataFrame([(i, "a", 10, 3.0 if i % 2 else 1.0) for i in range(4000)], "doc_id bigint, source string, tokens bigint, weight double")
    plan = mixing.shares([{"mix_id": 1, "source": "a", "weight": 1.0, "max_repeats": 1, "fraction": 0.2}], {"a": 40_000})
    got = mixing.mix_sources(df, plan).collect()
    assert sum(r["tokens"] for r in got) == 8000
    heavy = sum(r["doc_id"] % 2 for r in got)
    assert 2.4 < heavy / (len(got) - heavy) < 3.8


def brute_inclusion(docs, rest):
    """Factor and certain documents by taking one certain document at a time."""
    certain: set = set()
    while True:
        open_ = [x for x in docs if x[0] not in certain]
        wt = sum(w * t for _, t, w in open_)
        left = rest - sum(t for i, t, _ in docs if i in certain)
        factor = left / wt if wt else 0.0
        best = max(open_, key=lambda x: x[2], default=None)
        if best is None or factor * best[2] < 1:
            return factor, certain
        certain.add(best[0])


def test_large_documents_become_certain_until_none_is_left(spark):
    rng = random.Random(23)
    docs = [(i, rng.randrange(1, 50), 0.0) for i in range(600)] + [(1000 + i, 2_000 * 2**i, 0.0) for i in range(5)]
    docs = [(i, t, float(t)) for i, t, _ in docs]
    there = sum(t for _, t, _ in docs)
    df = spark.createDataFrame([(i, "a", t, 7) for i, t, _ in docs], "doc_id bigint, source string, tokens bigint, factor int")
    for fraction in (0.05, 0.5, 0.9, 0.97, 1.0):
        plan = mixing.shares([{"mix_id": 1, "source": "a", "weight": 1.0, "max_repeats": 1, "fraction": fraction}], {"a": there})
        got = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df, plan).collect()}
        assert set(got.values()) <= {1}
        size = sum(t for i, t, _ in docs if i in got)
        if fraction == 1.0:
            assert size == there
            continue
        _, certain = brute_inclusion(docs, plan[0]["rest"])
        assert certain <= set(got)
        rest = [t for i, t, _ in docs if i not in certain]
        assert abs(size - plan[0]["rest"]) <= max(rest)
    odd = spark.createDataFrame([(1, "a", 5, None), (2, "a", 5, -1.0), (3, "a", 5, float("inf")), (4, "a", 5, 2.0)], "doc_id bigint, source string, tokens bigint, weight double")
    plan = mixing.shares([{"mix_id": 1, "source": "a", "weight": 1.0, "max_repeats": 1, "fraction": 0.25}], {"a": 20})
    assert [r["doc_id"] for r in mixing.mix_sources(odd, plan).collect()] == [4]


def test_inclusion_follows_the_size(spark):
    """Over many seeds, each document is drawn as often as its size says."""
    docs = [(i, 1 + i % 8) for i in range(80)]
    df = spark.createDataFrame([(1000 * s + i, f"s{s}", t) for s in range(150) for i, t in docs], "doc_id bigint, source string, tokens bigint")
    there = sum(t for _, t in docs)
    targets = [{"mix_id": 1, "source": f"s{s}", "weight": 1.0, "max_repeats": 1, "fraction": 0.25} for s in range(150)]
    plan = mixing.shares(targets, {f"s{s}": there for s in range(150)})
    hits = [0] * 9
    for r in mixing.mix_sources(df, plan).collect():
        hits[r["tokens"]] += 1
    factor = 0.25 * there / sum(t * t for _, t in docs)
    for t in range(1, 9):
        want = 150 * 10 * factor * t
        assert abs(hits[t] - want) < 5 * want**0.5 + 0.05 * want, (t, hits[t], want)


# ---- 9

CASES = [
    ("Hello there. How are you?", ["Hello there.", "How are you?"]),
    ("At 10 a.m. Subject 2 left. It ended at 5 p.m. She waited.", ["At 10 a.m. Subject 2 left.", "It ended at 5 p.m.", "She waited."]),
    ("Prof. B. V. and St. Orlo crew, a.k.a. Team 12, agreed.", ["Prof. B. V. and St. Orlo crew, a.k.a. Team 12, agreed."]),
    ("“It is gone!” That was all. \"Keep both.\" So said she.", ["“It is gone!”", "That was all.", "\"Keep both.\"", "So said she."]),
    ('The note reads "keep it. Drop the rest." and nothing else.', ['The note reads "keep it. Drop the rest." and nothing else.']),
    ("See img.example.invalid/12_3.html for it.It is 9.5 m wide!Yes", ["See img.example.invalid/12_3.html for it.", "It is 9.5 m wide!", "Yes"]),
    ("We list maps, etc. Stop! Wait... is it, or... not?!", ["We list maps, etc.", "Stop!", "Wait... is it, or... not?!"]),
    ("The group (see Fig. 2. It is blurred.) stays. (All were redrawn.) No. 3 is ok.", ["The group (see Fig. 2. It is blurred.) stays.", "(All were redrawn.)", "No. 3 is ok."]),
    ("Heading\n\n- One. Two\n- Three\n\n1. A. Is it?\n2. B", ["Heading", "- One. Two", "- Three", "1. A. Is it?", "2. B"]),
    ("A line\nbreak inside. Next", ["A line\nbreak inside.", "Next"]),
    ("Am 8. Mai kam z. B. Nr. 3, ca. 2 m. Das ist Abschn. 2, d. h. S. 6. Halt!", ["Am 8. Mai kam z. B. Nr. 3, ca. 2 m.", "Das ist Abschn. 2, d. h. S. 6.", "Halt!"]),
    ("„Ist das so?“, fragte sie. Ja.", ["„Ist das so?“, fragte sie.", "Ja."]),
    ("Он видит зонт и т. д. «Это он?» — спросил К. М. тихо.", ["Он видит зонт и т. д.", "«Это он?» — спросил К. М. тихо."]),
    ("Τι είναι; Ο κήπος· μένει.", ["Τι είναι;", "Ο κήπος· μένει."]),
    ("真的吗？他说：“保留。删除。”然后走了。没有；其他", ["真的吗？", "他说：“保留。删除。”然后走了。", "没有；其他"]),
    ("वह है । क्या? हाँ॥ ठीक", ["वह है ।", "क्या?", "हाँ॥", "ठीक"]),
    ("قال «هل هذا؟» ثم سكت. نعم؟ لا؛ هذا", ["قال «هل هذا؟» ثم سكت.", "نعم؟", "لا؛ هذا"]),
    ("คนสวนยืน เด็กชายถือร่ม คะแนน 32.21 เป็น", ["คนสวนยืน", "เด็กชายถือร่ม", "คะแนน 32.21 เป็น"]),
    ('검토자는 "누구지?"라고 적었다. 끝.', ['검토자는 "누구지?"라고 적었다.', "끝."]),
    ("« C'est lui ! » a noté le relecteur. Vraiment ? Oui", ["« C'est lui ! » a noté le relecteur.", "Vraiment ?", "Oui"]),
    (" \n　", []),
    (" odd. Two", [" odd.", "Two"]),
    ("It turns.戴面具。끝났다.또 9.字", ["It turns.", "戴面具。", "끝났다.", "또 9.", "字"]),
    ("El n.º 9 sale. Fin", ["El n.º 9 sale.", "Fin"]),
    ("🙂 One 🙂. Two 🙂", ["🙂 One 🙂.", "Two 🙂"]),
]


def test_sentences(spark):
    data = [(i, t, 0) for i, (t, _) in enumerate(CASES)] + [(900, None, 0), (901, "", 0), (902, "x. " * 3000, 0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, seq int")
    got: dict = {}
    texts = dict((i, t) for i, t, _ in data)
    for r in sentences.sentences(df, "doc_id", "text").orderBy("id", "seq").collect():
        assert texts[r["id"]][r["start_pos"] : r["end_pos"]] == r["sentence"]
        got.setdefault(r["id"], []).append(r["sentence"])
    for i, (_, want) in enumerate(CASES):
        assert got.get(i, []) == want
    assert 900 not in got and 901 not in got
    assert sentences.sentences(df.where("false"), "doc_id", "text").count() == 0


def test_long_quotations_brackets_and_items(spark):
    long = "He left. " * 9000 + "So."
    texts = [f"{a}{long}{b} we read. Yes." for a, b in ('""', "“”", "„“", "«»", "「」", "''")]
    texts = [f"The note {x}" for x in texts] + [f"The note ({long}) is here. Yes.", f"The note [{long}] is here. Yes."]
    listed = f"List:\n\n- x\n1) {'word ' * 100}\n2) B. C"
    df = spark.createDataFrame([*enumerate([*texts, listed, f"It “{long}\n\nEnd” is."])], "doc_id bigint, text string")
    got: dict = {}
    for r in sentences.sentences(df, "doc_id", "text").orderBy("id", "seq").collect():
        got.setdefault(r["id"], []).append(r["sentence"])
    for i, t in enumerate(texts):
        assert got[i] == [t[:-5], "Yes."], i
    assert got[len(texts)][-1] == "2) B. C"
    assert len(got[len(texts) + 1]) > 9000  # a blank line ends what isn't closed


def test_queries_run_over_the_small_tables(spark):
    from setlens.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
