"""Near-duplicates: banding, brute force and odd rows."""

import random

import numpy as np

from quirework import session
from quirework.llm import neardup
from quirework.llm.blocks import bucket_pairs, may_share

WORDS = [f"w{i}" for i in range(400)]


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        base = rnd.sample(WORDS, 30)
        out.append((f"t{i}", " ".join(base)))
        if i % 2 == 0:
            edit = list(base)
            edit[rnd.randrange(30)] = "new" + str(i)
            rnd.shuffle(edit)
            out.append((f"t{i}e", " ".join(edit).upper() + "!"))
        if i % 5 == 0:
            out.append((f"t{i}c", "  ".join(base)))
    return out


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "key string, body string, class string")
    found = neardup.near_duplicates(df, "key", "body")
    cls = {r.id: bytes(r["class"]) for r in found.members.collect()}
    linked = {(bytes(r.a), bytes(r.b)) for r in found.pairs.collect()}
    got = {(x, y) for x in cls for y in cls if x < y and (cls[x] == cls[y] or (min(cls[x], cls[y]), max(cls[x], cls[y])) in linked)}
    sets = {i: set(t.lower().replace("!", "").split()) for i, t in rows}
    want = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) >= 0.78 * max(len(sets[x]), len(sets[y]))}
    assert got == want and len(want) > 30


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [("a", None), ("b", ""), ("c", "?!"), (None, "one two"), ("d", "one two"), ("d", "one two"), ("e", "Two, one"), ("l1", long), ("l2", long + " more")]
    df = spark.createDataFrame(rows, "id string, text string")
    found = neardup.near_duplicates(df, "id", "text")
    members = {r.id: bytes(r["class"]) for r in found.members.collect()}
    assert set(members) == {"d", "e", "l1", "l2"} and members["d"] == members["e"]
    assert found.pairs.count() == 1
    empty = neardup.near_duplicates(df.limit(0), "id", "text")
    assert empty.members.count() == 0 and empty.pairs.count() == 0
    five = neardup.near_duplicates(df, "id", "text", settings=neardup.Settings(words=5, share=0.8))
    assert five.members.count() >= 4


def test_sampling_collides_as_often_as_sets_are_alike():
    rnd = np.random.default_rng(1)
    h = rnd.integers(-(2**62), 2**62, 40)
    w = rnd.uniform(0.5, 4, 40)
    v = w.copy()
    v[:10] *= 0.5
    (la, ma), (lb, mb) = (neardup.icws(h, x, 4000, 1) for x in (w, v))
    hits = (np.take_along_axis(ma, la.argmin(0)[None], 0) == np.take_along_axis(mb, lb.argmin(0)[None], 0)).mean()
    assert abs(hits - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.03


def test_large_buckets_meet_every_pair_once(spark):
    rows = [(1, i) for i in range(70)] + [(2, i) for i in range(3)] + [(3, 9), (3, 11)] + [(4, 5)]
    df = spark.createDataFrame(rows, "k bigint, id bigint")
    got = [(r.a, r.b) for r in bucket_pairs(df, "k", "id", block=8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(70) for b in range(a + 1, 70)}


def hot_texts(hot, other, seed=4):
    """(id, words): one statement of 29 words with 0 to 6 edits, half of them unseen words, and unlike statements."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    base = rnd.sample(vocab, 29)
    out = []
    for i in range(hot):
        words = list(base)
        for j, at in enumerate(rnd.sample(range(29), rnd.randrange(1, 7))):
            words[at] = f"new{i}x{j}" if j % 2 else rnd.choice(vocab)
        out.append((f"h{i}", words))
    return out + [(f"o{i}", rnd.sample(vocab, 29)) for i in range(other)]


def test_a_statement_of_a_third_of_all_rows_is_found_whole(spark):
    rows = hot_texts(200, 400)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id string, text string")
    found = neardup.near_duplicates(df, "id", "text")
    cls = {bytes(r["class"]): r.id for r in found.members.collect()}
    got = {tuple(sorted((cls[bytes(r.a)], cls[bytes(r.b)]))) for r in found.pairs.collect()}
    sets = {i: set(w) for i, w in rows}
    want = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) >= 0.78 * max(len(sets[x]), len(sets[y]))}
    assert got <= want and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_maps_of_bits_lose_no_pair_that_may_be_alike(spark):
    """In small and in large buckets, pairs of the least share are met whatever their maps."""
    rnd = random.Random(11)
    sets = [set(rnd.sample(range(60), 20)) for _ in range(90)]
    sets += [set(list(s)[:17]) | {100 + i, 101 + i, 102 + i} for i, s in enumerate(sets[:40])]
    rows = []
    for i, s in enumerate(sets):
        bits = 0
        for x in s:
            bits |= 1 << (x % 64)
        rows.append((7, i, bits - (1 << 64) if bits >= 1 << 63 else bits, len(s)))
    df = spark.createDataFrame(rows, "k bigint, id bigint, m bigint, s int")
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.78 * max(len(sets[a]), len(sets[b]))}
    for block in (1024, 16):
        got = {(r.a, r.b) for r in bucket_pairs(df, "k", "id", block, bits="m", size="s", share=0.78).collect()}
        assert want <= got and len(got) < 0.5 * len(sets) ** 2 / 2 and len(want) >= 40


def test_bands_in_ranges_are_the_bands():
    rnd = np.random.default_rng(2)
    docs = [np.sort(rnd.integers(-(2**62), 2**62, n)) for n in (1, 5, 40)] + [np.sort(np.repeat(rnd.integers(-(2**62), 2**62, 9), 2))]
    s, idf = neardup.Settings(), rnd.uniform(0.05, 4.5, 1 << 18)
    whole = neardup.band_hashes(docs, idf, s)
    parts = [neardup.band_hashes(docs, idf, s, range(b, b + 12)) for b in range(0, 60, 12)]
    assert (np.concatenate(parts, 1) == whole).all()


def test_maps_of_unlike_texts_tell_them_apart():
    """Texts of 28 words of which 11 are common: maps of 128 bits leave few of their pairs, and every pair that is alike."""
    rnd = np.random.default_rng(3)
    left = [rnd.integers(-(2**62), 2**62, 28) for _ in range(2000)]
    sizes = np.full(2000, 28)
    for common, few in ((11, True), (22, False)):
        right = [np.r_[x[:common], rnd.integers(-(2**62), 2**62, 28 - common)] for x in left]
        x, y = (np.stack(neardup._maps([np.sort(d) for d in docs]), 1) for docs in (left, right))
        met = may_share(x, sizes, y, sizes, 0.78).mean()
        assert met < 0.005 if few else met == 1


def test_shuffle_files_of_a_cut_are_deleted(spark):
    from pathlib import Path

    folder = Path(spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    files = lambda: {p.name for p in folder.parent.rglob("shuffle_*.data")}
    before = files()
    out = session.cut(spark.range(50_000).selectExpr("id % 1000 AS k", "id").groupBy("k").count())
    assert not files() - before and out.count() == 1000 and spark.conf.get(session.CLEANUP) == "false"
    spark.range(50_000).selectExpr("id % 1000 AS k", "id").groupBy("k").count().collect()
    assert files() - before
    path = out._cut_path.removeprefix("file://")
    session.discard(out)
    assert not Path(path).exists()
