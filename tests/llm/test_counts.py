"""Frequencies and co-occurrence: SQL on the smallest tables, brute force and odd rows."""

from collections import defaultdict
from itertools import combinations

import pytest

from oracle import ROOT, bag, connect
from quirework.llm import cooccurrence, frequency

CASES = {k: (f, m.SQL[k]) for m in (frequency, cooccurrence) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_against_sql(spark, name):
    query, sql = CASES[name]
    assert bag(query(spark, f"{ROOT}/sf0.001").toPandas()) == bag(connect("sf0.001").execute(sql).df())


def test_frequency_of_odd_rows(spark):
    rows = [("a", "r1", "g1", 1), ("a", "r1", "g1", 1), ("a", None, "g2", 2), ("b", "r2", None, 3), (None, "r1", "g1", 4), ("", "r3", "g3", 5)]
    df = spark.createDataFrame(rows, "word string, rec string, src string, term int")
    got = {r.term: tuple(r)[1:] for r in frequency.term_frequencies(df, "word", "rec", "src").collect()}
    assert got == {"a": (3, 1, 2, False, True), "b": (1, 1, 0, True, False), "": (1, 1, 1, True, True)}
    assert frequency.term_frequencies(df.limit(0), "word", "rec", "src").count() == 0


def test_pairs_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for b in range(400):
        rows += [(f"b{b}", f"i{i}", b) for i in rnd.sample(range(12), rnd.randint(1, 4))]
        if b % 3 == 0:
            rows += [(f"b{b}", "x", b), (f"b{b}", "y", b), (f"b{b}", "y", b)]
    rows += [("huge", f"i{i}", 0) for i in range(12)] + [("huge", f"z{i}", 0) for i in range(500)] + [(None, "x", 0), ("b1", None, 0)]
    df = spark.createDataFrame(rows, "basket string, item string, n int")
    sets = defaultdict(set)
    for b, i, _ in rows:
        if b and i:
            sets[i].add(b)
    for overlap, least in ((0.5, 5), (0.2, 3), (0.05, 1), (0, 2)):
        want = {(x, y, len(sets[x] & sets[y])) for x, y in combinations(sorted(sets), 2) if len(sets[x] & sets[y]) >= max(least, overlap * len(sets[x] | sets[y]))}
        if least == 1:
            want = {w for w in want}
        got = {(r.item_a, r.item_b, r.n_both) for r in cooccurrence.pair_counts(df, "basket", "item", least, overlap).collect()}
        assert got == want
    assert cooccurrence.pair_counts(df.limit(0), "basket", "item").count() == 0
    with pytest.raises(ValueError):
        cooccurrence.pair_counts(df, "basket", "item", 0, 0)


def test_all_pairs_with_lift_against_sql(spark):
    """The plain count of all pairs, in blocks of a few items, with lift and pointwise mutual information."""
    con = connect("sf0.001")
    con.execute("CREATE TABLE h AS SELECT DISTINCT chunk_id, canonical FROM note_names WHERE chunk_id IS NOT NULL AND canonical IS NOT NULL")
    sql = """WITH f AS (SELECT canonical, count(*) AS n FROM h GROUP BY 1), p AS (SELECT a.canonical AS item_a, b.canonical AS item_b, count(*) AS n_both FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND a.canonical < b.canonical GROUP BY ALL HAVING count(*) >= 2)
        , q AS (SELECT item_a, item_b, n_both, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT chunk_id) FROM h) AS n_baskets FROM p JOIN f x ON x.canonical = item_a JOIN f y ON y.canonical = item_b)
        SELECT *, n_both * n_baskets / (n_a::DOUBLE * n_b) AS lift, log2(n_both * n_baskets / (n_a::DOUBLE * n_b)) AS pmi FROM q"""
    got = cooccurrence.pair_counts(spark.read.parquet(f"{ROOT}/sf0.001/note_names.parquet"), "chunk_id", "canonical", 2, 0).toPandas()
    assert len(got) and bag(got) == bag(con.execute(sql).df())
