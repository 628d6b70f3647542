"""Queries over the embeddings."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..session import table


def src33_unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scaled to length 1: their first place and their length before."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm("embedding"), 5).alias("length"), F.round(F.element_at("embedding", 1).cast("double") / V.norm("embedding"), 5).alias("first"))


def vec01_cosine_scan(spark: SparkSession, d: str) -> DataFrame:
    """All vectors within cosine 0.2 of each whose id is divisible by 50, exact."""
    e = table(spark, d, "embeddings")
    return V.within(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 0.2).select("query", "neighbour", F.round("cosine", 4).alias("cosine"))


def top01_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest of every vector whose id is divisible by 50, against all."""
    e = table(spark, d, "embeddings")
    return V.neighbours(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 4).select("query", "neighbour", "place", F.round("cosine", 4).alias("cosine"))


def top05_borderline(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of another label, for every id divisible by 50."""
    e = table(spark, d, "embeddings")
    return V.neighbours(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 1, label="label").select("query", "neighbour")


def agg63_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = V.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "size", F.round(F.element_at("centroid", 1), 5).alias("first"), F.round(V.norm("centroid"), 5).alias("length"))


def agg60_similarity_spread(spark: SparkSession, d: str) -> DataFrame:
    """Per label: least, greatest and mean cosine of the members to their centroid."""
    e = table(spark, d, "embeddings")
    c = V.centroids(e, "label", "embedding").select("label", "centroid")
    s = e.join(c, "label").withColumn("cosine", V.dot("embedding", "centroid") / (V.norm("embedding") * V.norm("centroid")))
    return s.groupBy("label").agg(*[F.round(f("cosine"), 5).alias(n) for f, n in ((F.min, "least"), (F.max, "greatest"), (F.avg, "mean"))])


def vec02_pca(spark: SparkSession, d: str) -> DataFrame:
    """Normalise, standardise, reduce to eight places: the variance of each."""
    e = V.unit(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", array_to_vector("embedding").alias("v"))
    s = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(e).transform(e)
    r = PCA(k=8, inputCol="s", outputCol="p").fit(s).transform(s)
    x = r.select(F.posexplode(vector_to_array("p")).alias("place", "x"))
    return x.groupBy("place").agg(F.round(F.var_samp("x"), 3).alias("variance"))


def vec12_linkage_distance(spark: SparkSession, d: str) -> DataFrame:
    """1 - v.mean of every vector to the mean of its label's unit vectors."""
    e = V.unit(table(spark, d, "embeddings"), "embedding")
    c = V.centroids(e, "label", "embedding").select("label", "centroid")
    return e.join(c, "label").select("vec_id", "label", F.round(1 - V.dot("embedding", "centroid"), 5).alias("distance"))


def vec13_incremental_bags(spark: SparkSession, d: str) -> DataFrame:
    """Even ids keep their label; odd ones go to the nearest mean within 0.55, else to none."""
    e = V.unit(table(spark, d, "embeddings"), "embedding")
    c = V.centroids(e.filter("vec_id % 2 = 0"), "label", "embedding").select("label", "centroid")
    return V.assign(e.filter("vec_id % 2 = 1"), c, "vec_id", "embedding", "label", 0.55).select("vec_id", "label", F.round("distance", 5).alias("distance"))


def _incremental(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The known unit vectors, and the new ones with the label of the nearest mean within 0.55."""
    e = V.unit(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding")
    known, new = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")
    c = V.centroids(known, "label", "embedding").select("label", "centroid")
    return known, new.drop("label").join(V.assign(new, c, "vec_id", "embedding", "label", 0.55), "vec_id")


def vec13_running_means(spark: SparkSession, d: str) -> DataFrame:
    """The means of the labels after the new vectors have joined them: size and length."""
    known, new = _incremental(spark, d)
    return V.moved_means(known, new, "label", "embedding").select("label", "size", F.round(V.norm("centroid"), 5).alias("length"))


def vec13_residue_bags(spark: SparkSession, d: str) -> DataFrame:
    """New vectors that no mean is near, clustered by average linkage under labels above the greatest, by least id."""
    known, new = _incremental(spark, d)
    bags = V.linkage_bags(new.filter("label IS NULL").withColumn("one", F.lit(0)), "vec_id", "embedding", "one", 0.55)
    firsts = bags.select("bag").distinct()
    # bags are numbered by range: what stands before is counted, no task sorts all
    part = firsts.repartitionByRange("bag").withColumn("p", F.spark_partition_id())
    before = part.groupBy("p").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.coalesce(F.sum("k").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    number = part.join(F.broadcast(before), "p").withColumn("n", F.row_number().over(W.partitionBy("p").orderBy("bag")) + F.col("before")).select("bag", "n")
    top = known.agg(F.coalesce(F.max("label"), F.lit(-1)).alias("top"))
    return bags.join(number, "bag").select(F.col("id").alias("vec_id"), (F.col("n") + top.scalar()).cast("int").alias("label"))


def vec09_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage bags at 0.55 of every label's vectors."""
    return V.linkage_bags(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.55).select(F.col("id").alias("vec_id"), "label", "bag")


def vec06_floors(spark: SparkSession, d: str) -> DataFrame:
    """The acceptance floor of a label: the least cosine of its members to its mean."""
    return agg60_similarity_spread(spark, d).select("label", F.col("least").alias("floor"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("src", "vec", "top", "agg") and getattr(v, "__module__", "") == __name__}

_U = "WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)"
_C = ", p AS (SELECT vec_id, label, unnest(v) / {0} AS x, generate_subscripts(v, 1) AS i FROM u {1}), c AS (SELECT label, list(x ORDER BY i) AS c, max(n) AS size FROM (SELECT label, i, avg(x) AS x, count(*) AS n FROM p GROUP BY ALL) GROUP BY label)"
_NEAR = "SELECT q.vec_id AS query, b.vec_id AS neighbour, list_dot_product(q.v, b.v) / (q.l * b.l) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, b.v) / (q.l * b.l), 9) DESC, b.vec_id) AS place, q.label AS a, b.label AS b FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0"
_SPREAD = f"{_U}{_C.format('1.0', '')}, s AS (SELECT u.label, list_dot_product(v, c) / (l * sqrt(list_dot_product(c, c))) AS k FROM u JOIN c USING (label)) "

_M = _C.format("l", "WHERE vec_id % 2 = 0")

SQL = {
    "vec13_running_means": f"{_U}{_M}, d AS (SELECT vec_id, c.label, 1 - list_dot_product(v, c) / l AS d FROM u, c WHERE vec_id % 2 = 1), a AS (SELECT vec_id, arg_min(label, (d, label)) AS label FROM d GROUP BY vec_id HAVING min(d) <= 0.55), o AS (SELECT vec_id, label FROM u WHERE vec_id % 2 = 0 UNION ALL SELECT * FROM a), x AS (SELECT o.label, unnest(u.v) / u.l AS x, generate_subscripts(u.v, 1) AS i FROM o JOIN u USING (vec_id)), m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL) SELECT label, max(n) AS size, round(sqrt(sum(x * x)), 5) AS length FROM m GROUP BY label",
    "src33_unit_vectors": f"{_U} SELECT vec_id, round(l, 5) AS length, round(v[1] / l, 5) AS first FROM u",
    "vec01_cosine_scan": f"{_U} SELECT query, neighbour, round(cosine, 4) AS cosine FROM ({_NEAR}) WHERE round(cosine, 9) >= 0.2",
    "top01_nearest": f"{_U} SELECT query, neighbour, place, round(cosine, 4) AS cosine FROM ({_NEAR}) WHERE place <= 4",
    "top05_borderline": f"{_U} SELECT query, arg_min(neighbour, place) AS neighbour FROM ({_NEAR}) WHERE a <> b GROUP BY query",
    "agg63_centroids": f"{_U}{_C.format('1.0', '')} SELECT label, size, round(c[1], 5) AS first, round(sqrt(list_dot_product(c, c)), 5) AS length FROM c",
    "agg60_similarity_spread": f"{_SPREAD} SELECT label, round(min(k), 5) AS least, round(max(k), 5) AS greatest, round(avg(k), 5) AS mean FROM s GROUP BY label",
    "vec06_floors": f"{_SPREAD} SELECT label, round(min(k), 5) AS floor FROM s GROUP BY label",
    "vec12_linkage_distance": f"{_U}{_C.format('l', '')} SELECT vec_id, u.label, round(1 - list_dot_product(v, c) / l, 5) AS distance FROM u JOIN c USING (label)",
    "vec13_incremental_bags": f"{_U}{_C.format('l', 'WHERE vec_id % 2 = 0')}, d AS (SELECT vec_id, c.label, 1 - list_dot_product(v, c) / l AS d FROM u, c WHERE vec_id % 2 = 1) SELECT vec_id, CASE WHEN min(d) <= 0.55 THEN arg_min(label, (d, label)) END AS label, round(min(d), 5) AS distance FROM d GROUP BY vec_id",
}
