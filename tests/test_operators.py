"""Ordered and vector operators against plain Python."""

import random

import numpy as np

from oracle import ROOT
from quirework.operators import ordered, skew, vectors


def test_rotation_of_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice(["a", "b", "c", None]), i) for i in range(60)] + [(None, "a", 100), (None, "b", 101), ("cold", "z", 102)]
    df = spark.createDataFrame(rows, "g string, s string, i int")
    got = {(r.g, r.i): r.turn for r in ordered.rotate(df, ["g"], "s", ["i"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] or "", r[2]))
        lists = {}
        for _, s, i in own:
            lists.setdefault(s or "", []).append(i)
        n = 0
        for k in range(60):
            for s in sorted(lists):
                if k < len(lists[s]):
                    n += 1
                    want[(g, lists[s][k])] = n
    assert got == want
    assert ordered.covering(ordered.rotate(df, ["g"], "s", ["i"]), ["g"], "s", 2).count() == 4 + 2 + 1


def test_batches_pass_through(spark):
    rnd = random.Random(4)
    rows = [(g, i, rnd.choice([None, 1, 5, 9, 30])) for g in ("a", "b", None) for i in range(200)]
    got = {(r.g, r.i): r.batch for r in ordered.batches(spark.createDataFrame(rows, "g string, i int, s int"), ["g"], "i", "s", 20, most=5).collect()}
    for g in ("a", "b", None):
        batch = used = n = 0
        for i, s in sorted((i, s or 0) for x, i, s in rows if x == g):
            if (n and used + s > 20) or n >= 5:
                batch, used, n = batch + 1, 0, 0
            used, n = used + s, n + 1
            assert got[(g, i)] == batch


def test_bags_of_a_large_label_are_those_of_a_small_one(spark):
    rnd = np.random.default_rng(5)
    centers = rnd.normal(size=(6, 16))
    rows = [(i, 7, [float(x) for x in centers[i % 6] + 0.15 * rnd.normal(size=16)]) for i in range(240)]
    rows += [(1000, None, [1.0] * 16), (1001, 7, None), (1002, 7, [0.0] * 16), (5, 7, rows[5][2])]
    df = spark.createDataFrame(rows, "k bigint, l int, v array<double>")
    whole = {r.id: r.bag for r in vectors.linkage_bags(df, "k", "v", "l", 0.4).collect()}
    parts = {r.id: r.bag for r in vectors.linkage_bags(df, "k", "v", "l", 0.4, block=20).collect()}
    assert whole == parts and whole[1000] == 1000 and 1001 not in whole and len(set(whole.values())) == 7
    assert all(whole[i] == whole[i % 6] for i in range(240))
    assert vectors.linkage_bags(df.limit(0), "k", "v", "l", 0.4).count() == 0


def test_pairs_of_a_large_key_are_met_once(spark):
    rows = [("hot", i) for i in range(50)] + [("small", 3), ("small", 9), ("one", 1), (None, 4), (None, 5)]
    got = [(r.k, r.a, r.b) for r in skew.pairs_within(spark.createDataFrame(rows, "k string, i int"), block=8).collect()]
    assert len(got) == len(set(got)) and set(got) == {("hot", a, b) for a in range(50) for b in range(a + 1, 50)} | {("small", 3, 9)}


def test_exact_scan_and_nearest_of_another_label(spark):
    rnd = np.random.default_rng(6)
    m = rnd.normal(size=(60, 8))
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(m)], "k int, l int, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u @ u.T
    asked = df.filter("k % 5 = 0")
    got = {(r.query, r.neighbour) for r in vectors.within(asked, df, "k", "v", 0.3, block=4).collect()}
    assert got == {(i, j) for i in range(0, 60, 5) for j in range(60) if i != j and sim[i, j] >= 0.3}
    near = {r.query: r.neighbour for r in vectors.neighbours(asked, df, "k", "v", 1, block=4, label="l").collect()}
    assert near == {i: max((j for j in range(60) if j % 3 != i % 3), key=lambda j: sim[i, j]) for i in range(0, 60, 5)}


def test_items_of_unions(spark):
    rnd = random.Random(5)
    keys = [f"k{i}" for i in range(60)]
    asks = {f"o{i}": set(rnd.sample(keys, rnd.choice([1, 2, 5, 40]))) for i in range(50)} | {"none": {"other"}}
    has = {i: {k for j, k in enumerate(keys) if rnd.random() < (0.6 if j < 3 else 0.0002 * j)} for i in range(6000)}
    owners, numbers = skew.asked_keys(spark.createDataFrame([(o, k) for o, ks in asks.items() for k in ks], "owner string, key string"), "owner", "key")
    number = {r.key: r.k for r in numbers.collect()}
    items = spark.createDataFrame([(i * 7919, [number[k] for k in ks if k in number], 1 + i % 2) for i, ks in has.items() if ks], "h bigint, ks array<bigint>, w int")
    want = {o: (sum(1 for x in has.values() if x & ks), sum((1 + i % 2) * len(x & ks) for i, x in has.items())) for o, ks in asks.items()}
    want = {o: x for o, x in want.items() if x[0]}
    for item_keys, asked in ((skew.ITEM_KEYS, skew.ASKED_KEYS), (2000, 200)):
        got = owners.join(skew.union_counts(owners, items, item_keys, asked), "o").collect()
        assert {r.owner: (r["items"], r.weight) for r in got} == want and "none" not in want
        assert len(got) == len(want)
    assert skew.union_counts(owners, items.limit(0)).count() == 0 and skew.union_counts(owners.limit(0), items).count() == 0


def test_pairs_of_owner_and_item_are_not_shuffled(spark):
    from quirework.plans import coverage

    for query in (coverage.agg33_available_notes, coverage.agg68_composition):
        plan = query(spark, f"{ROOT}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Cogroup" in plan or "CoGroup" in plan
