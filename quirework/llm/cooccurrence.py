"""Problem 4: items that appear together, against chance.

Items are deduplicated per basket. A pair whose baskets overlap by at least `overlap` (Jaccard)
has at least c = max(min_count, overlap * n) common baskets, n being the baskets of either item; so
its first s common ones are within the first n - c + s baskets of each, when both order their
baskets alike. These are the leading baskets, s being a part of c, and a pair that shares fewer
than s of them is none. The order puts huge baskets last, where they are hardly ever paired.
Ordered pairs are emitted from these leading incidences only,
counted map-side, and every candidate's common baskets are then counted over all baskets. All
bounds are exact: no pair that meets them is lost, no basket or item is capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import pairs_within
from ..session import cut, table

#: Hash steps among baskets of like size, and the most baskets that are told apart by size (they are broadcast).
STEPS, LARGE = 64, 10_000
#: Baskets that a pair must share among the leading ones, at least; and how many items of candidates are broadcast.
SHARED, FEW = 3, 100_000


def pair_counts(df: DataFrame, basket: str, item: str, min_count: int = 5, overlap: float = 0.5) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_baskets, lift, pmi) with item_a < item_b.

    Pairs with n_both >= min_count and n_both >= overlap * baskets with either. Rows with a null
    basket or item are in no pair; repeated rows count once; n_baskets counts the distinct baskets
    with an item. lift = n_both * n_baskets / (n_a * n_b), pmi is its binary logarithm. Without
    two items in one basket the result is empty. With overlap 0 every pair of every basket is counted
    and nothing else decides than min_count; a basket of many items is then paired in blocks, by many tasks.
    """
    if not 0 <= overlap <= 1 or min_count < 1:
        raise ValueError("overlap must be in [0, 1] and min_count at least 1")
    held = cut(df.select(F.col(f"`{basket}`").alias("basket"), F.col(f"`{item}`").alias("item")).dropna().distinct())
    n_baskets = held.select("basket").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    if overlap == 0:
        return _all_pairs(held, n_baskets, min_count)
    # the common order of baskets, in steps by hash; the largest, at most LARGE of them, come last by size
    least = max(64, held.count() // LARGE)
    large = held.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    step = F.coalesce(F.floor(F.log2("size") * 2).cast("int"), F.lit(0)) * STEPS + F.pmod(F.xxhash64("basket"), F.lit(STEPS)).cast("int")
    items = cut(held.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).withColumn("id", F.monotonically_increasing_id()))
    # numbers for items and hashes for baskets: a clash of hashes only adds a candidate
    inc = held.join(F.broadcast(large), "basket", "left").select("item", F.xxhash64("basket").alias("b"), step.alias("step")).join(items, "item")
    leading = inc.join(_last_steps(inc, min_count, overlap), "item").filter("step <= last").select("id", "b", "n")
    shared = F.first(F.least(_share(F.col("a.n"), min_count, overlap), _share(F.col("b.n"), min_count, overlap)))
    a, b = leading.alias("a"), leading.alias("b")
    cond = (F.col("a.b") == F.col("b.b")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(overlap))
    met = a.join(b, cond).groupBy(F.col("a.id").alias("x"), F.col("b.id").alias("y")).agg(F.count(F.lit(1)).alias("k"), shared.alias("least")).filter("k >= least").select("x", "y")
    named = items.select("id", "item", "n")
    met = met.join(named.toDF("x", "item_x", "n_x"), "x").join(named.toDF("y", "item_y", "n_y"), "y")
    first = F.col("item_x") < F.col("item_y")
    candidates = cut(met.select(F.least("item_x", "item_y").alias("item_a"), F.greatest("item_x", "item_y").alias("item_b"), F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b")))
    paired = candidates.select(F.col("item_a").alias("item")).unionAll(candidates.select("item_b")).distinct()
    # items of candidates are broadcast only where they are counted to be few
    paired = cut(paired)
    inc = cut(held.join(F.broadcast(paired) if paired.count() <= FEW else paired, "item", "left_semi").select("item", "basket"))
    left = candidates.join(inc.withColumnRenamed("item", "item_a"), "item_a")
    both = left.join(inc.withColumnRenamed("item", "item_b"), ["item_b", "basket"], "left_semi")
    counted = both.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    kept = counted.filter((F.col("n_both") >= min_count) & (F.col("n_both") >= F.lit(overlap) * (F.col("n_a") + F.col("n_b") - F.col("n_both"))))
    return _against_chance(kept, n_baskets)


def _against_chance(counted: DataFrame, n_baskets) -> DataFrame:
    lift = F.col("n_both") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return counted.withColumn("n_baskets", n_baskets).select("item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets", lift.alias("lift"), F.log2(lift).alias("pmi"))


def _all_pairs(held: DataFrame, n_baskets, min_count: int) -> DataFrame:
    """Every pair in min_count baskets: pairs are emitted by number, counted in each task first, and named at the end."""
    items = cut(held.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).withColumn("id", F.monotonically_increasing_id()))
    met = pairs_within(cut(held.join(items, "item").select(F.col("basket").alias("k"), F.col("id").alias("i"))))
    counts = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= min_count)
    x, y = items.select(F.col("id").alias("a"), F.col("item").alias("x"), F.col("n").alias("n_x")), items.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("n").alias("n_y"))
    first = F.col("x") < F.col("y")
    named = counts.join(x, "a").join(y, "b").select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_both", F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"))
    return _against_chance(named, n_baskets)


def _fewest(n, min_count: int, overlap: float):
    """The fewest common baskets of any pair of an item with n baskets."""
    return F.greatest(F.lit(min_count), F.ceil(n * F.lit(overlap)))


def _share(n, min_count: int, overlap: float):
    """Of these, how many its leading baskets are to hold."""
    return F.greatest(F.lit(min(SHARED, min_count)), F.floor(n * F.lit(overlap / 2)))


def _last_steps(inc: DataFrame, min_count: int, overlap: float) -> DataFrame:
    """(item, last): the step in which the leading baskets of the item end."""
    per = inc.groupBy("item", "n", "step").agg(F.count(F.lit(1)).alias("k"))
    run = per.select("item", "n", "step", F.sum("k").over(W.partitionBy("item").orderBy("step")).alias("run"))
    n = F.col("n")
    return run.filter(F.col("run") >= n - _fewest(n, min_count, overlap) + _share(n, min_count, overlap)).groupBy("item").agg(F.min("step").alias("last"))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "notes").filter("back_matter").select("chunk_id")
    return table(spark, sf_dir, "note_names").select("chunk_id", "canonical").join(back, "chunk_id", "left_anti")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in at least 5 common notes and at least a third of the notes of either."""
    return pair_counts(_baskets(spark, sf_dir), "chunk_id", "canonical", 5, 1 / 3).withColumns({"lift": F.round("lift", 6), "pmi": F.round("pmi", 6)}).withColumnsRenamed({"item_a": "canonical_a", "item_b": "canonical_b"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_counts(_baskets(spark, sf_dir), "chunk_id", "canonical", 5, 0.5)
    far = F.col("n_both") * F.col("n_baskets") >= F.lit(3) * F.col("n_a") * F.col("n_b")
    return pairs.filter(far).select(F.col("item_a").alias("canonical_a"), F.col("item_b").alias("canonical_b"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}

_SQL = """
WITH h AS (SELECT DISTINCT chunk_id, canonical FROM note_names m WHERE chunk_id IS NOT NULL AND canonical IS NOT NULL
             AND NOT EXISTS (SELECT 1 FROM notes t WHERE t.chunk_id = m.chunk_id AND t.back_matter)),
 f AS (SELECT canonical, count(*) AS n FROM h GROUP BY canonical),
 p AS (SELECT a.canonical AS canonical_a, b.canonical AS canonical_b, count(*) AS n_both FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND a.canonical < b.canonical
       GROUP BY ALL HAVING count(*) >= 5),
 q AS (SELECT p.*, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT chunk_id) FROM h) AS n_baskets FROM p JOIN f x ON x.canonical = canonical_a JOIN f y ON y.canonical = canonical_b)
"""

SQL = {
    "p4_found": _SQL + "SELECT canonical_a, canonical_b FROM q WHERE 2 * n_both >= n_a + n_b - n_both AND n_both * n_baskets >= 3 * n_a * n_b",
    "p4_pairs": _SQL + "SELECT *, round(n_both * n_baskets / (n_a::DOUBLE * n_b), 6) AS lift, round(log2(n_both * n_baskets / (n_a::DOUBLE * n_b)), 6) AS pmi FROM q WHERE 3 * n_both >= n_a + n_b - n_both",
}
