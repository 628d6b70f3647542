"""The three-source fixture: relations, rotation and their limits."""

import pytest

from quirework.operators import relations as R
from quirework.operators.ordered import batches, covering, last_of_each, rotate, within_budget
from quirework.operators.skew import hot_keys, keyed_counts


@pytest.fixture(scope="module")
def store(spark):
    notes = [("a1", "S_A", False), ("a2", "S_A", False), ("b1", "S_B", False), ("b2", "S_B", False), ("c1", "S_C", False), ("c2", "S_C", True)]
    names = [("a1", "N1"), ("a2", "N1"), ("a2", "N2"), ("b1", "N2"), ("b2", "N3"), ("c1", "N2"), ("c2", "N1")]
    source = {c: s for c, s, _ in notes}
    return {
        "notes": spark.createDataFrame([(c, s, "claim", "position", b) for c, s, b in notes], "chunk_id string, source_id string, claim string, position string, back_matter boolean"),
        "note_names": spark.createDataFrame([(c, source[c], n, "person") for c, n in names] * 2, "chunk_id string, source_id string, canonical string, kind string"),
        "names": spark.createDataFrame([(n, "person") for n in ("N1", "N2", "N3", "N4")], "canonical string, kind string"),
        "sources": spark.createDataFrame([("S_A", "A", "TA", 2015), ("S_B", "B", "TB", 2008), ("S_C", "C", "TC", 1997)], "source_id string, author string, title string, year int"),
        "against": spark.createDataFrame([("b2", "S_B", "the view of N One", "N1"), ("a1", "S_A", "nobody", None)], "chunk_id string, source_id string, target string, resolved_canonical string"),
    }


def find(store, **kw):
    rows = R.find_notes("N2", store["note_names"], store["notes"], store["sources"], store["against"], **kw).orderBy("turn").collect()
    return [r.chunk_id for r in rows], rows[0].total if rows else 0


def test_find_notes(store):
    assert find(store) == (["a2", "b1", "c1"], 3)
    assert find(store, opposing="N1") == (["b1"], 1)
    assert find(store, after=2000)[0] == ["a2", "b1"]
    assert find(store, after=2008)[0] == ["a2"]
    assert find(store, before=2008)[0] == ["c1"]
    assert len(find(store, limit=1)[0]) == 3
    assert find(store, opposing="N9") == ([], 0)


def test_doors_keep_names_without_evidence(store):
    got = {r.canonical: (r.member_count, r.source_count) for r in R.doors(store["names"], store["note_names"], store["notes"]).collect()}
    assert got == {"N1": (2, 1), "N2": (3, 3), "N3": (1, 1), "N4": (0, 0)}


def test_concept_sources(store):
    got = [(r.source_id, r.note_count) for r in R.concept_sources(store["note_names"], store["notes"], store["sources"]).filter("canonical = 'N1'").collect()]
    assert got == [("S_A", 2)]


def test_opposition(store):
    rows = R.against_names(store["against"], store["note_names"]).collect()
    assert [(r.target, r.canonical, r.note_count, r.source_count) for r in rows] == [("N1", "N3", 1, 1)]
    pairs = R.opposition_pairs(store["against"], store["note_names"], store["notes"])
    assert {(r.opposing_chunk, r.about_chunk) for r in pairs.collect()} == {("b2", "a1"), ("b2", "a2")}
    assert [(r.canonical, r.pairs) for r in R.opposition_sizes(store["against"], store["note_names"], store["notes"]).collect()] == [("N1", 2)]


def test_meet_counts_back_matter(store):
    assert [r.chunk_id for r in R.meet(store["note_names"], "N1", "N2").collect()] == ["a2"]


def test_word_grams(spark):
    df = spark.createDataFrame([("the red old market", 1)], "t string, n int")
    assert {r.gram for r in R.word_grams(df, "t", 2, 3).collect()} == {"the red", "red old", "old market", "the red old", "red old market"}


def test_rotation_and_window(spark):
    df = spark.createDataFrame([("k", s, i) for i, s in enumerate("aaabbc")] + [("k", None, 9)], "k string, s string, i int")
    got = [r.i for r in rotate(df, ["k"], "s", ["i"]).orderBy("turn").collect()]
    assert got == [9, 0, 3, 5, 1, 4, 2]
    assert covering(rotate(df, ["k"], "s", ["i"]), ["k"], "s", 2).count() == 4
    weighted = df.filter("s IS NOT NULL").selectExpr("*", "CASE s WHEN 'a' THEN 2.0 WHEN 'b' THEN 1.0 ELSE 0.0 END AS w")
    assert [r.s for r in rotate(weighted, ["k"], "s", ["i"], "w").orderBy("turn").collect()] == ["a", "a", "b", "a", "b", "c"]


def test_budget_and_batches(spark):
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate((5, 4, 9, 1, 12, 2))], "k string, i int, n int")
    assert [r.i for r in within_budget(df, ["k"], ["i"], "n", 10).collect()] == [0, 1]
    assert [r.batch for r in batches(df, ["k"], "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]
    assert [r.batch for r in batches(df, ["k"], "i", "n", 100, most=2).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2]


def test_last_of_each(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "k string, n int, v string")
    assert {(r.k, r.v) for r in last_of_each(df, ["k"], ["n"]).collect()} == {("a", None), ("b", "y")}


def test_keyed_counts_of_odd_rows(spark):
    df = spark.createDataFrame([("a", "c1", "s"), ("a", "c1", "s"), ("a", None, None), (None, "c2", "s"), ("", "c3", "s")], "key string, member string, tag string")
    got = {r.key: (r.mentions, r.notes, r.sources) for r in keyed_counts(df, "key", {"notes": "member", "sources": "tag"}).collect()}
    assert got == {"a": (3, 1, 1), "": (1, 1, 1)}
    assert keyed_counts(df.limit(0), "key", {"notes": "member"}).count() == 0
    assert {(r.key_column, r.key_value) for r in hot_keys(df, ["key", "tag"], (3, 5)).collect()} == {("key", "a"), ("tag", "s")}


def test_components(spark):
    from quirework.session import cut

    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30] + [("n000", "n002")], "a string, b string")
    got = {r.id: r.root for r in R.components(edges, cut).collect()}
    assert set(got.values()) == {"n000", "n031"} and got["n030"] == "n000" and got["n060"] == "n031"
