"""Vectors as array columns: norms, cosine, exact neighbours, centroids and incremental assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))


def unit(df: DataFrame, col: str) -> DataFrame:
    """df with col scaled to length 1; null, empty and zero vectors are left out."""
    return df.withColumn("_norm", norm(col)).filter("_norm > 0").withColumn(col, F.transform(col, lambda v: v.cast("double") / F.col("_norm"))).drop("_norm")


def _query_blocks(queries: DataFrame, base: DataFrame, id_col: str, vec: str, label: str | None, block: int, meet) -> DataFrame:
    """(query, neighbour, cosine) of a stated query set against all rows, by matrix products.

    The queries come to the driver in blocks of `block` by range of id, so it never holds more, and each block
    is broadcast; meet(batches, ids, matrix, labels) is run over the rows of base. With a label, rows of the query's own are no neighbours.
    """
    spark = base.sparkSession
    cols = [id_col, vec] + ([label] if label else [])
    q = cut(unit(queries.select(*cols), vec))
    rows = unit(base.select(*cols), vec)
    kind = base.schema[id_col].dataType.simpleString()
    schema = f"query {kind}, neighbour {kind}, cosine double"
    out, last = None, None
    while True:
        part = (q if last is None else q.filter(F.col(id_col) > F.lit(last))).orderBy(id_col).limit(block).toPandas()
        if not len(part):
            return spark.createDataFrame([], schema) if out is None else out
        last = part[id_col].iloc[-1].item() if hasattr(part[id_col].iloc[-1], "item") else part[id_col].iloc[-1]
        held = spark.sparkContext.broadcast((part[id_col].to_numpy(), np.stack(part[vec].to_list()), part[label].to_numpy() if label else None))

        def compared(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qi, qm, ql = held.value

            def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for pdf in batches:
                    if len(pdf):
                        bi = pdf[id_col].to_numpy()
                        sim = qm @ np.stack(pdf[vec].to_list()).T
                        sim[qi[:, None] == bi[None, :]] = -np.inf
                        if label:
                            sim[ql[:, None] == pdf[label].to_numpy()[None, :]] = -np.inf
                        yield bi, sim

            yield from meet(qi, each())

        one = rows.mapInPandas(compared, schema)
        out = one if out is None else out.unionByName(one)


def neighbours(queries: DataFrame, base: DataFrame, id_col: str, vec: str, k: int, block: int = 2048, label: str | None = None) -> DataFrame:
    """(query, neighbour, cosine, place): the exact k nearest of every query in base, itself left out; ties by id.

    Each task keeps the k best of its rows, and only these are merged. With a label, the nearest of another label.
    """

    def best(qi: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        kept_s, kept_i = np.full((len(qi), 0), 0.0), np.empty((len(qi), 0), dtype=object)
        for bi, sim in parts:
            s = np.concatenate([kept_s, sim], 1)
            i = np.concatenate([kept_i, np.broadcast_to(bi.astype(object), sim.shape)], 1)
            # of equal ones the smaller id; cosines are ranked to nine places, as in the merge
            order = np.lexsort((i, -np.round(s, 9)), axis=1)[:, :k]
            kept_s, kept_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        ok = np.isfinite(kept_s)
        yield pd.DataFrame({"query": np.repeat(qi, kept_s.shape[1])[ok.ravel()], "neighbour": kept_i.ravel()[ok.ravel()], "cosine": kept_s.ravel()[ok.ravel()]})

    out = _query_blocks(queries, base, id_col, vec, label, block, best)
    w = W.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def within(queries: DataFrame, base: DataFrame, id_col: str, vec: str, least: float, block: int = 2048) -> DataFrame:
    """(query, neighbour, cosine): every row of base whose cosine to a query is `least` or more, itself left out; exact."""

    def near(qi: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for bi, sim in parts:
            x, y = np.nonzero(np.round(sim, 9) >= least)
            yield pd.DataFrame({"query": qi[x], "neighbour": bi[y], "cosine": sim[x, y]})

    return _query_blocks(queries, base, id_col, vec, None, block, near)


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, size, centroid): plain means per place."""
    parts = df.select(label, F.posexplode(vec).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(label).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def assign(df: DataFrame, centers: DataFrame, id_col: str, vec: str, label: str, most: float) -> DataFrame:
    """(id, label, distance): each vector to the center of the least 1 - v.c within `most`, else a null label; ties: smaller label.

    The centers are few by design; they are counted, and at most 10 000 are held by each task.
    """
    if centers.count() > 10_000:
        raise ValueError("more than 10 000 centers: cluster the centers first")
    c = centers.select(label, "centroid").orderBy(label).toPandas()
    spark = df.sparkSession
    kinds = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{label}` {centers.schema[label].dataType.simpleString()}, distance double"
    if not len(c):
        return df.select(id_col, F.lit(None).cast(centers.schema[label].dataType).alias(label), F.lit(None).cast("double").alias("distance"))
    held = spark.sparkContext.broadcast((c[label].to_numpy(), np.stack(c.centroid.to_list()).astype(float)))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = held.value
        for pdf in batches:
            if len(pdf):
                d = 1 - np.stack(pdf[vec].to_list()) @ m.T
                at = d.round(12).argmin(1)
                least = d[np.arange(len(d)), at]
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), label: pd.array([n if x <= most else None for n, x in zip(names[at].tolist(), least)], dtype=object), "distance": least})

    return unit(df.select(id_col, vec), vec).mapInPandas(nearest, kinds)


def average_linkage(vectors: np.ndarray, threshold: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of average-linkage clustering by cosine distance, cut at the threshold, for one block.

    vectors: rows of any length; with sizes they are the means of so many unit vectors and are taken
    as they are, since the mean cosine of two clusters is the product of their means.
    """
    n = len(vectors)
    if n < 2:
        return np.zeros(n, np.int64)
    v = vectors if sizes is not None else vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - v @ v.T
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if sizes is None else np.asarray(sizes, float).copy()
    labels = np.arange(n)
    while True:
        i, j = divmod(int(d.argmin()), n)
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        labels[labels == j] = i
    return np.unique(labels, return_inverse=True)[1]


def linkage_bags(df: DataFrame, id_col: str, vec: str, label: str, threshold: float, block: int = 400) -> DataFrame:
    """(id, label, bag): average-linkage bags of each label's vectors, cut at the threshold; a bag is named by its least id.

    A label of at most `block` vectors is clustered at once. A larger one is clustered in blocks by
    hash, and the bags of all blocks are merged in turn by average linkage of their means, in new
    blocks each time, until they fit one block or two rounds merge nothing. Null and zero vectors
    are in no bag; repeated ids count once. An empty table gives no rows.
    """
    start = unit(df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).alias("v")), "v").dropDuplicates(["id"])
    kind, name = start.schema["id"].dataType.simpleString(), start.schema["label"].dataType.simpleString()
    bags = cut(start.select("label", F.col("id").alias("bag"), "v", F.lit(1.0).alias("size")))
    members, turn, idle = None, 0, 0

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bag")
        v, size = np.stack(pdf.v.to_list()).astype(float), pdf["size"].to_numpy(float)
        found = average_linkage(v, threshold, size)
        to = pd.Series(pdf.bag.to_numpy()).groupby(found).transform("min").to_numpy()
        mean = np.zeros((found.max() + 1, v.shape[1]))
        np.add.at(mean, found, v * size[:, None])
        total = np.bincount(found, size)
        return pd.DataFrame({"label": pdf.label.to_numpy(), "was": pdf.bag.to_numpy(), "bag": to, "v": list((mean / total[:, None])[found]), "size": total[found]})

    while True:
        counts = bags.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        counts = counts.withColumnRenamed("label", "_l")
        cuts = bags.join(counts, F.col("label").eqNullSafe(F.col("_l"))).select("label", "bag", "v", "size", F.pmod(F.xxhash64("bag", F.lit(turn)), F.ceil(F.col("_n") / block)).alias("_b"))
        step = cut(cuts.groupBy("label", "_b").applyInPandas(merged, f"label {name}, was {kind}, bag {kind}, v array<double>, size double"))
        to = step.select("was", F.col("bag").alias("now"))
        members = to.toDF("id", "bag") if members is None else members.join(to, F.col("bag") == F.col("was")).select("id", F.col("now").alias("bag"))
        members = cut(members)
        fresh = cut(step.filter("was = bag").select("label", "bag", "v", "size"))
        idle = idle + 1 if fresh.count() == bags.count() else 0
        bags, turn = fresh, turn + 1
        if most <= block or idle == 2:
            break
    return members.join(bags.select("bag", "label"), "bag").select("id", "label", "bag")


def moved_means(known: DataFrame, fresh: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, size, centroid): the running means of the labels after the fresh rows have come. Rows without a label move none."""
    both = known.select(label, vec).unionByName(fresh.filter(F.col(label).isNotNull()).select(label, vec))
    return centroids(both, label, vec)
