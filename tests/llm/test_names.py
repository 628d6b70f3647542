"""Spellings, stars, clusters and communities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import clusters, communities, knn, spelling, stars
from quirework.llm.nameparts import Words, distance, fold, parts

FORMS = {"robert": ["bob", "rob"], "elizabeth": ["liz"]}


def test_fold_and_distance():
    assert fold("‘Dre-vibanto’ R0bert, Bankʾo") == ["drevibanto", "robert", "banko"]
    assert distance("abcd", "abdc", 2) == 1 and distance("abcd", "xxxx", 2) == 3


def test_parts():
    w = Words({"robert": 50, "lucia": 40}, frozenset({"dept"}), {}, {"grain board": 5, "land registry department": 4, "general strike": 4})
    p = lambda s: parts(s, w, True)
    assert p("Gazelruwa, Robert") == p("Dr. Robert T. Gazelruwa") == ("gazelruwa", "p", "robert", "", "", "")
    assert p("Gazelruwa R.") == ("gazelruwa", "p", "", "r", "", "")
    assert p("Lower Gazelruwa Land Registry Dept") == p("Gazelruwa (Lower Land Registry Department)")
    assert p("Gazelruwa GB")[4] == "=gb"
    assert p("1901 Gazelruwa Gen. Strike") == p("Gazelruwa General Strike of 1901")
    assert p("the state")[0] == ""


@pytest.fixture(scope="module")
def linked(spark):
    names = """Robert Gazelruwa|Gazelruwa, Robert|Bob Gazelruwa|Robert Gazelruva|R. Gazelruwa|Gazelruwa|Lucia Dentrovolho|Leopold Dentrovolho|L. Dentrovolho|Dentrovolho
        |Mobonmem Grain Board|Grain Board of Mobonmem|Mobonmem Grain Bd|Mobonmem Land Board|Northern Mobonmem Grain Board|Mobonmem Congress of 1901|Mobonmem Congress of 1911|1901 Mobonmem Congress|the state|""".split("|")
    fill = [f"{f} {s}" for f in ("Robert", "Lucia", "Leopold", "Haldor") for s in ("Abcdefgo", "Bcdefghu", "Cdefghik", "Zzyxwvut", "Kapolimo", "Nomumanu", "Wewiwowu", "Tatetito", "Sosusysa")]
    fill += [f"{s} {k}" for s in ("Abcdefgo", "Bcdefghu", "Cdefghik", "Zzyxwvut") for k in ("Grain Board", "Land Board", "Congress of 1950")]
    rows = [(n.strip(), 1) for n in names + fill] + [(None, 1), ("Robert Gazelruwa", 5)]
    df = spark.createDataFrame(rows, "name string, weight int")
    return {r.name: r.entity for r in spelling.link_spellings(df, "name", "weight", FORMS).collect()}


def test_spellings_of_one(linked):
    same = lambda *xs: len({linked[x] for x in xs}) == 1
    assert same("Robert Gazelruwa", "Gazelruwa, Robert", "Bob Gazelruwa", "Robert Gazelruva", "R. Gazelruwa", "Gazelruwa")
    assert same("Mobonmem Grain Board", "Grain Board of Mobonmem", "Mobonmem Grain Bd")
    assert same("Mobonmem Congress of 1901", "1901 Mobonmem Congress")


def test_namesakes_stay_apart(linked):
    apart = ["Lucia Dentrovolho", "Leopold Dentrovolho", "L. Dentrovolho", "Dentrovolho", "Mobonmem Grain Board", "Mobonmem Land Board", "Northern Mobonmem Grain Board", "Mobonmem Congress of 1901", "Mobonmem Congress of 1911"]
    assert len({linked[x] for x in apart}) == len(apart)
    assert "the state" not in linked and "" not in linked


def test_empty_names(spark):
    assert spelling.link_spellings(spark.createDataFrame([], "name string, weight int"), "name", "weight", {}).count() == 0


def test_band_recall(spark):
    import random

    rnd = random.Random(2)
    words = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(5)) for _ in range(300)]
    typed = [w[:4] + "x" + w[5:] for w in words]
    near = {(r.a, r.b) for r in spelling.near_words(spark.createDataFrame([(w,) for w in {*words, *typed}], "word string")).collect()}
    assert sum((min(a, b), max(a, b)) in near for a, b in zip(words, typed)) >= 297


def test_stars(spark):
    nodes = spark.createDataFrame([(x, w) for x, w in zip("abcdef", (9, 1, 8, 1, 7, 1))], "id string, weight int")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.9), ("d", "e", 0.99)], "a string, b string, sim double")
    assert {r.id: r.center for r in stars.star_clusters(nodes, edges).collect()} == {"a": "a", "b": "c", "c": "c", "d": "e", "e": "e", "f": "f"}
    assert stars.star_clusters(nodes, edges.limit(0)).filter("id = center").count() == 6


def test_communities(spark):
    a = [(f"a{i}", f"a{j}", 1.0) for i in range(6) for j in range(i)]
    b = [(f"b{i}", f"b{j}", 1.0) for i in range(6) for j in range(i)]
    edges = spark.createDataFrame([*a, *b, ("a0", "b0", 0.2)], "a string, b string, w double")
    by_tasks = {r.id: r.community for r in communities.modularity_communities(edges, held=3).collect()}
    got = communities.modularity_communities(edges)
    by = {r.id: r.community for r in got.collect()}
    assert len({by[f"a{i}"] for i in range(6)}) == 1 and len({by[f"b{i}"] for i in range(6)}) == 1 and by["a0"] != by["b0"] and by_tasks == by
    top = {r.community: r for r in communities.typical_members(got, edges).collect()}
    assert all(r["size"] == 6 and len(r.typical) == 3 for r in top.values())
    assert communities.modularity_communities(edges.limit(0)).count() == 0


def test_neighbour_graph_recall(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    sets = []
    for c in range(40):
        core = rnd.integers(0, 10**9, 8)
        sets += [np.r_[core, rnd.integers(0, 10**9, 4)] for _ in range(8)]
    items = spark.createDataFrame([(i, [int(x) for x in s], [1.0] * len(s)) for i, s in enumerate(sets)], "id bigint, feats array<int>, weights array<float>")
    got = {(r.v, r.u) for r in knn.neighbour_graph(items, knn.Descent(k=7)).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and i // 8 == j // 8}
    assert len(got & want) >= 0.95 * len(want)


def test_text_clusters_of_odd_rows(spark):
    claim = "In {p} the red market was {v} by the old guild since the tall tower fell"
    rows = [(f"c{i}", claim.format(p="Mobonmem", v=v)) for i, v in enumerate(("taxed", "fed", "sold", "moved"))]
    rows += [(f"n{i}", " ".join(f"word{i}x{j}" for j in range(12))) for i in range(4000)] + [("x", None), (None, "a b"), ("y", ""), ("c0b", rows[0][1])]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "key string, body string, words string")
    members, edges = clusters.cluster_texts(df, "key", "body")
    by = {r.id: r.community for r in members.collect()}
    assert len({by[k] for k in ("c0", "c1", "c2", "c3", "c0b")}) == 1 and len(by) == 4005 and "x" not in by and "y" not in by
    members, _ = clusters.cluster_texts(df.limit(0), "key", "body")
    assert members.count() == 0


def test_word_clusters(spark):
    words = ["golhezalef", "golhezalfe", "jesembeldel", "jesembelrdel", "taampalsalge", "komhudroda", "other1word", "bbbbbbbb"]
    members, edges = clusters.cluster_words(spark.createDataFrame([(w,) for w in words], "id string"))
    by = {r.id: r.community for r in members.collect()}
    assert by["golhezalef"] == by["golhezalfe"] and by["jesembeldel"] == by["jesembelrdel"] and len(set(by.values())) == 6
    assert edges.count() == 2


def test_a_point_of_a_third_of_all_claims_keeps_its_words(spark):
    said = "In {p} the red market was {v} by the old guild {w} while tall towers fell"
    phrases = ("by way of tribute", "in hill villages", "on paper only")
    rows = [(f"h{i}", said.format(p="Mobonmem", v=f"verb{i}", w=phrases[i % 3])) for i in range(100)]
    rows += [(f"n{i}", f"In Place{i // 4} some thing{i} met other{i} {phrases[i % 3]}") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, text string")
    proper = spark.createDataFrame([("mobonmem",), *[(f"place{i}",) for i in range(50)]], "word string")
    nodes = df.select(F.monotonically_increasing_id().alias("n"), "id", clusters._words("text").alias("tokens"))
    number = {r.id: r.n for r in nodes.collect()}
    told = {r.n: {tuple(t) for t in r.tell} for r in clusters.text_features(nodes.select("n", "tokens"), proper).collect()}
    tell = {i: told[n] for i, n in number.items()}
    assert len(tell["h0"] & tell["h1"]) >= 3  # red market, old guild, tall towers
    assert not tell["n0"] & tell["n9"]  # a phrase beside all places
    members, _ = clusters.cluster_texts(df.filter("id < 'h2' OR id LIKE 'n%'"), "id", "text", proper=proper)
    by = {r.id: r.community for r in members.collect()}
    assert len({c for k, c in by.items() if k[0] == "h"}) == 1
    assert all(by[f"n{i}"] != by["h0"] for i in range(200))


def test_communities_of_a_large_part_converge(spark):
    # communities of fifty, sparse inside, in one connected part
    import random

    rnd = random.Random(5)
    n, size = 2000, 50
    edges = {(min(i, j), max(i, j)) for i in range(n) for j in [i // size * size + rnd.randrange(size) for _ in range(3)] if i != j}
    edges |= {(i // size * size + k, i // size * size + k + 1) for i in range(0, n, size) for k in range(size - 1)}
    edges |= {(i, (i + size) % n) if i + size < n else (0, i) for i in range(0, n, size)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(edges)], "a bigint, b bigint, w double")

    def quality(found):
        by = {r.id: r.community for r in found.collect()}
        degree, inside = {}, 0
        for a, b in edges:
            inside += by[a] == by[b]
            for x in (a, b):
                degree[by[x]] = degree.get(by[x], 0) + 1
        return inside / len(edges) - sum(d * d for d in degree.values()) / (2 * len(edges)) ** 2, len(degree)

    (q, k), (q_joins, k_joins) = quality(communities.modularity_communities(df)), quality(communities.modularity_communities(df, held=10))
    assert q_joins >= q - 0.01 and abs(k - k_joins) <= 2


def test_a_frequent_surname_is_no_common_word(spark):
    import random

    from quirework.llm.nameparts import common_words

    rnd = random.Random(1)
    coined = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(400)]
    given = ["Robert", "Lucia", "Leopold", "Haldor", "Umar", "Ingrid", "Zacharias", "Tariq"]
    names = [f"{g} {x} Gazelruwa" for g in given for x in [*"ABCDEFGHIJKLMNOP"]] + [f"{g} Gazelruwa {i}" for g in given for i in range(50)]
    names += [f"{c.title()} Lighthouse" for c in coined] + [f"{g} {c.title()}" for g in given for c in coined[:60]] + [f"{c.title()} Smith" for c in given]
    df = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    words = common_words(df, "name", FORMS)
    assert "gazelruwa" not in words.known and "lighthouse" in words.common and {"haldor", "tariq"} <= set(words.forenames)
    assert parts("Robert Gazelruwa", words, True)[0] == "gazelruwa" and parts("Robert Smith", words, True)[0] == "smith"


def test_words_as_they_are_read(spark):
    words = ["gelkelmepa", "gelkelrnepa", "balsaagafa", "balzagafa", "zenvelbreusbom", "zenvelbrubom", "smith", "smyth"]
    df = spark.createDataFrame([(w,) for w in words], "id string")
    by = {r.id: r.community for r in clusters.cluster_words(df)[0].collect()}
    assert by["gelkelmepa"] == by["gelkelrnepa"] and by["balsaagafa"] == by["balzagafa"] and by["zenvelbreusbom"] != by["zenvelbrubom"] and by["smith"] != by["smyth"]
    beside = spark.createDataFrame([(w, "t|grain board") for w in words], "id string, with string")
    by = {r.id: r.community for r in clusters.cluster_words(df, beside=beside)[0].collect()}
    assert by["zenvelbreusbom"] == by["zenvelbrubom"]


def test_one_changed_word_is_the_same_point_and_another_place_is_not(spark):
    import random

    rnd = random.Random(8)
    adj, noun = [f"adj{i}" for i in range(30)], [f"noun{i}" for i in range(40)]
    said = ("In {p} the {o} was sold by the {a} while the {g} stood", "It was the {g} that moved {p}: the {a} fed the {o} in the end", "Of the {o} little was left in {p}, where the {a} met the {g} at night")
    rows, point = [], {}
    for i in range(120):
        slots = {k: f"{rnd.choice(adj)} {rnd.choice(noun)}" for k in "oag"}
        for j in range(6):
            own = dict(slots)
            if j == 5:
                own["g"] = f"other {own['g'].split()[1]}"
            rows.append((f"{i}-{j}", said[j % 3].format(p=f"Placename{i // 2}", **own) + " for" + "".join(f" filler{rnd.randrange(400)}" for _ in range(6))))
            point[f"{i}-{j}"] = i
    df = spark.createDataFrame(rows, "id string, text string")
    proper = spark.createDataFrame([(f"placename{i}",) for i in range(60)], "word string")
    by = {r.id: r.community for r in clusters.cluster_texts(df, "id", "text", proper=proper)[0].collect()}
    pairs = [(x, y) for x in by for y in by if x < y and by[x] == by[y]]
    right = sum(point[x] == point[y] for x, y in pairs)
    assert right >= 0.95 * 120 * 15 and right >= 0.99 * len(pairs), (right, len(pairs))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_every_pair_of_spellings_is_an_edge(spark):
    rnd = random.Random(11)
    word, typed = "vanterimolk", set()
    while len(typed) < 40:
        w = list(word)
        w[rnd.randrange(len(w))] = rnd.choice("abdegjopstuvz")
        typed.add("".join(w))
    typed = sorted(typed)
    df, beside = spark.createDataFrame([(w,) for w in typed], "id string"), spark.createDataFrame([(w, "p|anna") for w in typed], "id string, with string")
    got = [(r.a, r.b) for r in clusters.cluster_words(df, beside=beside)[1].collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in typed for b in typed if a < b and _edits(a, b) <= 2}


def test_words_within_edits_are_all_met(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcde") for _ in range(rnd.randint(6, 9))) for _ in range(400)}
    long = "".join(rnd.choice("abcdefghijklmnop") for _ in range(66))
    words |= {long, long[1:], long[:30] + "z" + long[31:], long[2:], long + "zz"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    for edits in (1, 2):
        met = [(r.a, r.b) for r in spelling.words_within(df, edits).collect()]
        assert len(met) == len(set(met)) and all(a < b for a, b in met)
        assert {(a, b) for a in words for b in words if a < b and _edits(a, b) <= edits} <= set(met)
    read = spark.createDataFrame([("karrnennes", "kamenes"), ("kamenes", "kamenes"), ("other words", "other words")], "word string, read string")
    assert [(r.a, r.b) for r in spelling.words_within(read, 2, 1).collect()] == [("kamenes", "karrnennes")]
    assert spelling.words_within(df.limit(0), 2).count() == 0


def test_a_hot_point_is_one_and_no_rare_one_is_lost(spark):
    tell = lambda place, *pairs: [(place, a << 31 | b, 1.0, 9) for a, b in pairs]
    hot = [(i, tell(1, (2, 3), (4, 5), (6, 7))) for i in range(3000)]
    # two of three pairs in common; a word in both pairs; one pair in common; pairs of two places; no pair
    rest = [(5000, tell(8, (2, 3), (4, 5), (10, 11))), (5001, tell(8, (2, 3), (4, 5), (12, 13))), (5002, tell(9, (2, 3), (3, 5))), (5003, tell(9, (2, 3), (3, 5)))]
    rest += [(5004, tell(7, (20, 21), (22, 23))), (5005, tell(7, (20, 21), (24, 25))), (5006, tell(30, (2, 3)) + tell(31, (4, 5))), (5007, tell(30, (2, 3)) + tell(31, (4, 5))), (5008, [])]
    feats = spark.createDataFrame(hot + rest, "n bigint, tell array<struct<place:int,unit:bigint,weight:float,k:int>>")
    got = [(r.a, r.b) for r in clusters._argued(feats).collect()]
    assert len(got) == len(set(got)) and {p for p in got if p[1] >= 5000} == {(5000, 5001), (5006, 5007)}
    inside = [p for p in got if p[1] < 5000]
    assert len(inside) <= clusters.POINT_ORDERS * clusters.POINT_STEPS * len(hot)
    # beside twice as many edges of other texts the point is one community
    a, b = zip(*inside)
    ids, at = communities._louvain(np.array(a), np.array(b), np.ones(len(a)), 3.0 * len(a), 1.0)
    assert len(ids) == len(hot) and len(set(at.tolist())) == 1


def test_components_against_union_find(spark):
    from quirework.session import cut

    rnd = random.Random(2)
    edges = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(420)] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, 2000), (2001, 2002), (2002, 2001)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = [(r.id, r.root) for r in communities.components(spark.createDataFrame(edges, "a bigint, b bigint"), cut).collect()]
    assert len(got) == len(root) and dict(got) == {x: find(x) for x in root}
    assert communities.components(spark.createDataFrame([], "a bigint, b bigint"), cut).count() == 0
