"""Approximate nearest-neighbour graph by neighbour descent over weighted feature sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Descent:
    """k neighbours kept; orders and steps of the first graph; neighbours joined per node; rounds of descent.

    The first graph compares each record with the next `steps` in each of `orders` random orders
    that put records with the same two sampled features side by side. Each round compares the
    sampled neighbours, both ways, of every record with each other, and keeps the k best. Pairs
    less alike than `floor` are no neighbours.
    """

    k: int = 10
    orders: int = 8
    steps: int = 3
    joined: int = 8
    rounds: int = 2
    floor: float = 0.06


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _orders(pdf: pd.DataFrame, n: int) -> Iterator[pd.DataFrame]:
    """The rows with turn, first and second: for each order the two features of least weighted hash."""
    lengths = np.array([len(x) for x in pdf.feats])
    flat = np.concatenate([np.asarray(x, np.int64) for x in pdf.feats]).view(np.uint64)
    weight = np.concatenate([np.asarray(x, np.float64) for x in pdf.weights])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    row = np.repeat(np.arange(len(pdf)), lengths)
    for t in range(n):
        with np.errstate(over="ignore"):
            u = _mix(flat + np.uint64(t + 1) * np.uint64(0x9E3779B97F4A7C15))
        e = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        order = np.lexsort((e, row))
        one = flat[order[starts]].astype(np.int64).astype(np.int32)
        two = flat[order[np.where(lengths > 1, starts + 1, starts)]].astype(np.int64).astype(np.int32)
        yield pd.DataFrame({"id": pdf.id.to_numpy(), "feats": pdf.feats.to_numpy(), "weights": pdf.weights.to_numpy(), "turn": np.int32(t), "first": one, "second": two})


def _likeness(fa: np.ndarray, wa: np.ndarray, fb: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of padded rows: (n, f) features (0 pads) and weights."""
    met = (fa[:, :, None] == fb[:, None, :]).any(2) & (fa != 0)
    both = (wa * met).sum(1)
    return both / np.maximum(wa.sum(1) + wb.sum(1) - both, 1e-9)


#: Features above which pairs are compared one by one.
WIDE = 256


def _one_by_one(fa, wa, fb, wb) -> np.ndarray:
    """Weighted Jaccard of pairs of feature lists of any length."""
    out = np.zeros(len(fa))
    for i, (x, p, y) in enumerate(zip(fa, wa, fb)):
        _, at, _ = np.intersect1d(x, y, return_indices=True)
        both = float(np.asarray(p)[at].sum())
        out[i] = both / max(float(np.sum(p)) + float(np.sum(wb[i])) - both, 1e-9)
    return out


def _padded(lists, width: int, dtype) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


#: Similarities are ranked by steps of this size, and by chance inside a step.
GRAIN = 0.1


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar u of each v; edges: (v, u, sim), each once. Every task sends at most k rows of a v.

    Among about equal ones chance decides (by hash), so that a record with many near copies keeps
    ties to others as alike, and no group of copies is cut off.
    """
    rank = [F.desc(F.round(F.col("sim") / GRAIN)), F.xxhash64("v", "u")]
    return edges.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(*rank))).filter(F.col("r") <= k).select("v", "u", "sim")


def _compare(fa: list, wa: list, fb: list, wb: list) -> np.ndarray:
    """Weighted Jaccard of pairs of feature lists, in slices of like width."""
    out = np.zeros(len(fa))
    width = np.array([max(len(a), len(b)) for a, b in zip(fa, fb)])
    for cls in np.unique(np.ceil(np.log2(np.maximum(width, 2)))):
        at = np.flatnonzero(np.ceil(np.log2(np.maximum(width, 2))) == cls)
        wide = int(width[at].max())
        pick = lambda x, i: [x[j] for j in i]
        if wide > WIDE:
            out[at] = _one_by_one(pick(fa, at), pick(wa, at), pick(fb, at), pick(wb, at))
            continue
        step = max(1, 4_000_000 // (wide * wide))
        for i in range(0, len(at), step):
            p = at[i : i + step]
            out[p] = _likeness(_padded(pick(fa, p), wide, np.int32), _padded(pick(wa, p), wide, np.float32), _padded(pick(fb, p), wide, np.int32), _padded(pick(wb, p), wide, np.float32))
    return out


def neighbour_graph(items: DataFrame, settings: Descent = Descent(), seeds: DataFrame | None = None) -> DataFrame:
    """(v, u, sim): up to k approximate nearest neighbours of each item.

    items: (id bigint, feats array<int>, weights array<float>), ids distinct, features not 0; sim is
    the weighted Jaccard similarity. Items without a feature have no neighbour. An empty table
    gives no rows. seeds: (v, u), v < u, each once: pairs met elsewhere, which the descent starts from too.
    """
    s = settings
    edge = "v bigint, u bigint, sim float"
    items = cut(items.select("id", "feats", "weights").filter(F.size("feats") > 0))

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                yield from _orders(pdf.iloc[i : i + 2000], s.orders)

    turns = items.mapInPandas(ordered, "id bigint, feats array<int>, weights array<float>, turn int, first int, second int")
    # a bucket is passed through in order, whatever its size: only `steps` rows are looked back at
    turns = turns.repartition("turn", "first").sortWithinPartitions("turn", "first", "second", F.xxhash64("id"))

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            rows = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
            fresh = np.arange(len(rows)) >= (0 if last is None else len(last))
            key = rows.turn.to_numpy(np.int64) << 32 | rows["first"].to_numpy(np.int64) & 0xFFFFFFFF
            ids, feats, weights = rows.id.to_numpy(), rows.feats.to_list(), rows.weights.to_list()
            for d in range(1, s.steps + 1):
                b = np.flatnonzero(fresh[d:] & (key[d:] == key[:-d])) + d
                a = b - d
                if len(b):
                    sim = _compare([feats[i] for i in a], [weights[i] for i in a], [feats[i] for i in b], [weights[i] for i in b])
                    ok = (sim >= s.floor) & (ids[a] != ids[b])
                    a, b, sim = a[ok], b[ok], sim[ok]
                    yield pd.DataFrame({"v": np.r_[ids[a], ids[b]], "u": np.r_[ids[b], ids[a]], "sim": np.r_[sim, sim].astype(np.float32)}).drop_duplicates(["v", "u"])
            last = rows.iloc[-s.steps :]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sim = _compare(pdf.fa.to_list(), pdf.wa.to_list(), pdf.fb.to_list(), pdf.wb.to_list())
                v, u, sim = pdf.v[sim >= s.floor], pdf.u[sim >= s.floor], sim[sim >= s.floor].astype(np.float32)
                yield pd.DataFrame({"v": np.r_[v, u], "u": np.r_[u, v], "sim": np.r_[sim, sim]})

    start = turns.mapInPandas(beside, edge)
    if seeds is not None:
        x, y = items.toDF("v", "fa", "wa"), items.toDF("u", "fb", "wb")
        start = start.unionByName(seeds.select("v", "u").join(x, "v").join(y, "u").mapInPandas(compared, edge))
    graph = cut(_best(start.groupBy("v", "u").agg(F.max("sim").alias("sim")), s.k))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf.near.map(len) > 1]
            for i in range(0, len(pdf), 512):
                lists = [list({r["u"]: r for r in near}.values()) for near in pdf.near.iloc[i : i + 512]]
                rows = [r for near in lists for r in near]
                x, y, at = [], [], 0
                for near in lists:
                    p, q = np.triu_indices(len(near), 1)
                    x.append(p + at)
                    y.append(q + at)
                    at += len(near)
                x, y = np.concatenate(x), np.concatenate(y)
                ids = np.array([r["u"] for r in rows], np.int64)
                least = np.maximum(np.array([r["worst"] for r in rows], np.float32), np.float32(s.floor))
                # a pair met in several lists is compared once
                _, once = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0, return_index=True)
                x, y = x[once], y[once]
                feats, weights = [r["feats"] for r in rows], [r["weights"] for r in rows]
                sim = _compare([feats[j] for j in x], [weights[j] for j in x], [feats[j] for j in y], [weights[j] for j in y]).astype(np.float32)
                for v, u in ((x, y), (y, x)):
                    good = sim > least[v]
                    if good.any():
                        yield pd.DataFrame({"v": ids[v[good]], "u": ids[u[good]], "sim": sim[good]})

    for turn in range(s.rounds):
        full = graph.groupBy("v").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n")).select(F.col("v").alias("id"), F.when(F.col("n") >= s.k, F.col("worst")).otherwise(F.lit(0.0)).cast("float").alias("worst"))
        h = F.xxhash64(F.least("v", "u"), F.greatest("v", "u"), F.lit(turn))
        ways = graph.select("v", "u", h.alias("h")).unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"), h.alias("h")))
        # the window's limit holds in each task already, so a hub sends no more than these rows
        sampled = ways.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("h", "u"))).filter(F.col("r") <= 2 * s.joined).dropDuplicates(["v", "u"])
        sampled = sampled.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("h", "u"))).filter(F.col("r") <= s.joined)
        held = items.join(full, "id").select(F.col("id").alias("u"), "feats", "weights", "worst")
        lists = sampled.select("v", "u").join(held, "u").groupBy("v").agg(F.collect_list(F.struct("u", "feats", "weights", "worst")).alias("near"))
        fresh = lists.select("near").mapInPandas(joined, edge)
        graph = cut(_best(graph.unionByName(fresh).groupBy("v", "u").agg(F.max("sim").alias("sim")), s.k))
    return graph
