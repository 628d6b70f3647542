"""Packing, mixing and reading levels."""

import numpy as np
import pytest

from quirework.llm import mixing, packing, reading, tokens


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (4, "<|endoftext|> " + "long " * 50_000, 9)], "id int, text string, tokens int")
    got = {r.id: r.tokens for r in tokens.token_sizes(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 50_000
    e = tokens.encoder()
    assert e.decode(e.encode_ordinary("Ünïcode\n\n text")) == "Ünïcode\n\n text"


def brute(sizes, capacity):
    """Sum-of-squares by trying every open container."""
    gaps, where = [], []
    for s in sizes:
        def cost(gs):
            return sum(n * n for g in set(gs) if g for n in [sum(x == g for x in gs)])

        fits = [(cost([*gaps[:i], g - s, *gaps[i + 1 :]]), g, i) for i, g in enumerate(gaps) if g >= s and g]
        new = (cost([*gaps, capacity - s]), capacity, len(gaps))
        best = min(fits, default=None, key=lambda f: (f[0], f[1]))
        if best is None or best[0] > new[0]:
            where.append(len(gaps))
            gaps.append(capacity - s)
        else:
            where.append(best[2])
            gaps[best[2]] -= s
    return sorted(g for g in gaps)


def test_sum_of_squares_against_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        sizes = rnd.integers(1, 13, 60)
        where = packing.sum_of_squares(sizes, 12)
        assert sorted((12 - np.bincount(where, weights=sizes)).astype(int).tolist()) == brute(sizes.tolist(), 12)


def test_packing(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rnd.integers(1, 900, 3000))] + [(9001, 0), (9002, 1024), (9003, 512), (9004, 5000)]
    sized = spark.createDataFrame(rows, "doc bigint, tokens bigint")
    specs = spark.createDataFrame([(1, 512), (2, 2048), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    for shard in (500, 25_000):
        got = packing.pack(sized, "doc", specs, shard).toPandas()
        for spec, cap in ((1, 512), (2, 2048)):
            g = got[got.spec_id == spec]
            assert g.groupby("id").tokens.sum().to_dict() == dict(rows)
            fill = g.dropna(subset=["container"]).groupby("container").tokens.sum()
            assert fill.max() <= cap and fill.mean() > (0.9 if shard == 500 else 0.97) * cap
            assert set(g[g.pieces > 1].id) == {i for i, n in rows if n > cap}
            assert g[g.id == 9001].container.isna().all()
        assert set(got.spec_id) == {1, 2}
    assert packing.pack(sized.limit(0), "doc", specs).count() == 0


def test_mixing(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, s, l, t, int(rnd.integers(5, 300))) for i, (s, l, t) in enumerate(zip(rnd.choice(["big", "Big ", "mid", "small"], 6000, p=[0.6, 0.1, 0.25, 0.05]), rnd.choice(["en", "fr", None], 6000), rnd.choice(["a", "b", None], 6000)))]
    rows += [(9001, None, "en", "a", 50), (9002, "mid", "en", "a", 0), (9003, "other", "en", "a", 70)]
    docs = spark.createDataFrame(rows, "id bigint, source string, lang string, topic string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("SMALL", 0.15, 3), ("none", 0.05, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    draws, report = mixing.mixed(docs, targets)
    d = draws.toPandas()
    assert d.id.is_unique and not {9001, 9002, 9003} & set(d.id)
    assert (d.times <= d.source.map({"big": 1, "mid": 2, "small": 3})).all()
    r = report.toPandas().set_index("source")
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(r.actual_share[s] - share / 0.95) < 0.004 and r.wanted_share[s] == share
    assert r.drawn_tokens["none"] == 0 and r.drawn_tokens["other"] == 0
    draws, report = mixing.mixed(docs.limit(0), targets)
    assert draws.count() == 0 and report.count() == 4
    assert mixing.mixed(docs, targets.limit(0))[0].count() == 0


def test_raking_meets_all_margins():
    rnd = np.random.default_rng(0)
    t = rnd.uniform(1, 9, 12)
    at = [np.repeat([0, 1, 2], 4), np.tile([0, 1], 6)]
    goals = [np.array([10.0, 12.0, 8.0]), np.array([16.0, 14.0])]
    rate = mixing.rake(t, at, goals, np.full(12, 50.0), 500, 1e-12)
    for a, g in zip(at, goals):
        assert np.allclose(np.bincount(a, t * rate), g, rtol=1e-6)


EASY = "The cat sat by the door. He saw the dog run. She had a red hat. They ran to the big hill. "
HARD = "Insofar as the hegemonic intelligibility of sovereignty presupposes the institutionalisation of alterity, historiography naturalises the constitutive dispossession which it purports to explain. "
MID = "Because the province weakened the economic government, its leaders developed new forms of administration. The parliament supported commercial reform in most of the coastal provinces. "
TALK = "My father remembered the border when the trains stopped and we followed the family before the war. Nobody counted the old town, so the workers had to promise again. "


@pytest.fixture(scope="module")
def graded(spark):
    texts = {1: EASY, 2: TALK, 3: MID, 4: HARD}
    docs = [(i, texts[1 + i % 4] * (4 + i % 5), f"s{i % 7}") for i in range(240)]
    odd = [(900, None, None), (901, "", "s1"), (902, "Too short to grade.", "s1"), (903, "Die Provinz und das Dorf ordnete der Markt, aber der Rat bezahlte die Ernte nicht mit dem Statthalter. " * 4, "s1"), (904, "Abc\t1910\t3940\t44.9\nDef\t1863\t17297\t19.3\n" * 9, "s2"), (905, HARD * 3000, "s2"), (906, MID * 6 + HARD, "s3")]
    labels = [(i, 1 + i % 4) for i in range(200)] + [(0, None), (3, 3), (905, 9), (12345, 1)]
    d = spark.createDataFrame([(*r, 0) for r in docs + odd], "doc_id bigint, text string, source string, level int")
    return d, spark.createDataFrame(labels, "doc_id bigint, level int")


def test_levels(graded):
    got = {r.doc_id: r.level for r in reading.levels(*graded).collect()}
    assert sum(got[i] == 1 + i % 4 for i in range(240)) >= 235
    assert got[905] == 4 and got[906] == 3 and not {900, 901, 902, 903, 904} & set(got)


def test_levels_without_labels(spark, graded):
    d, l = graded
    assert reading.levels(d, l.limit(0)).count() == 0
    assert reading.levels(d.limit(0), l).count() == 0


def test_held_out_error(graded):
    m = reading.fit(*graded)
    # one fold holds three of the seven sources, and all texts of a level are alike: its scores shift as a whole
    assert (m.held_out.said == m.held_out.level).mean() > 0.85


def test_trees_learn_a_step():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 3))
    y = (x[:, 1] > 0.3) * 2.0 + (x[:, 0] > 0) * 1.0
    p = reading.Trees(60, 3, 0.2).fit(x, y).predict(x)
    assert np.abs(p - y).mean() < 0.1


def test_all_topics_and_languages_keep_their_margins(spark):
    """Sixty topics and twenty languages are raked, none as a rest."""
    from quirework.llm import mixing

    rows = [(i, ("a", "b")[i % 2], f"l{i % 20:02d}"[::-1], f"topic{i % 60}", 100) for i in range(6000)]
    docs = spark.createDataFrame(rows, "id bigint, source string, lang string, topic string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    draws, report = mixing.mixed(docs, targets)
    shares = {r.source: r.actual_share for r in report.collect()}
    assert abs(shares["a"] - 0.75) < 0.01 and abs(shares["b"] - 0.25) < 0.01
    topics = draws.join(docs.select("id", "topic"), "id").groupBy("topic").count().collect()
    assert len(topics) == 60
