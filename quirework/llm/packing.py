"""Problem 7: texts into containers of fixed capacity with little room left.

Sum-of-squares packing: each item goes where the sum over all gaps of the squared number of open
containers with that gap becomes smallest, a new container being one of the choices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .tokens import VOCABULARY, token_sizes

#: Texts packed by one task, about; each shard leaves some containers open at its end.
SHARD = 25_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item, in the given order; sizes in 1 .. capacity.

    An item of size s in a container of gap g changes the sum by 2 (n[g - s] - n[g]) + 2, in a new
    container by 2 n[capacity - s] + 1, a gap of 0 or of an unopened container counting nothing.
    Ties: the smaller gap, an open container before a new one; of equal gaps the last filled.
    """
    n = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        # gaps s .. capacity - 1 of open containers, after which the gap is 0 .. capacity - 1 - s
        before = n[s:capacity]
        cost = n[: capacity - s] - before
        if capacity > s:
            cost = cost * 2 + 2
            cost[0] = 1 - 2 * before[0]
            cost[before == 0] = np.iinfo(np.int64).max
            at = int(cost.argmin())
            best = int(cost[at])
        else:
            best = np.iinfo(np.int64).max
        if best <= 2 * int(n[capacity - s]) + 1 - (s == capacity):
            gap = s + at
            b = stacks[gap].pop()
            n[gap] -= 1
            left = at
        else:
            b, made = made, made + 1
            left = capacity - s
        out[i] = b
        if left:
            n[left] += 1
            stacks[left].append(b)
    return out


def closed(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Containers renumbered after the emptiest are dissolved into the gaps of others, largest item first, best fit.

    A container is dissolved only where all its items find room; items are never split.
    """
    if not len(sizes):
        return where
    fill = np.bincount(where, weights=sizes).astype(np.int64)
    by = pd.Series(np.arange(len(sizes))).groupby(where).apply(lambda x: x.to_numpy())
    gaps = capacity - fill
    from bisect import bisect_left, insort

    held = sorted((int(g), b) for b, g in enumerate(gaps) if g > 0)
    where = where.copy()
    for b in np.argsort(fill, kind="stable").tolist():
        if fill[b] * 2 > capacity:
            break
        held.remove((int(gaps[b]), b))
        moves, ok = [], True
        for i in sorted(by[b].tolist(), key=lambda i: -int(sizes[i])):
            k = bisect_left(held, (int(sizes[i]), -1))
            if k == len(held):
                ok = False
                break
            g, to = held.pop(k)
            moves.append((i, g, to))
            if g > sizes[i]:
                insort(held, (g - int(sizes[i]), to))
        if ok:
            for i, g, to in moves:
                where[i] = to
                gaps[to] -= int(sizes[i])
            gaps[b] = 0
        else:
            for i, g, to in reversed(moves):
                if g > sizes[i]:
                    held.remove((g - int(sizes[i]), to))
                insort(held, (g, to))
            insort(held, (int(gaps[b]), b))
    return np.unique(where, return_inverse=True)[1]


def pack(sized: DataFrame, id_col: str, specs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(spec_id, id, piece, pieces, tokens, container) of every text under every spec.

    sized: (id, tokens), ids distinct; specs: (spec_id, capacity_tokens). A text above the capacity
    is split into full pieces, each a container of its own, and a rest that is packed like a text.
    Texts of no tokens are one piece of 0 tokens in no container (null). Specs with a null or
    non-positive capacity are left out. Shards of about `shard` texts are packed by one task each,
    largest first (ties: by id); container ids are distinct within a spec. Empty tables give no rows.
    """
    sized = cut(sized.select(F.col(id_col).alias("id"), "tokens"))
    shards = max(1, -(-sized.count() // shard))
    caps = specs.filter("capacity_tokens > 0 AND spec_id IS NOT NULL").select("spec_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    # the number of specs is fixed and small: every text is packed once per spec
    work = sized.join(F.broadcast(caps)).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("bigint")
    work = work.withColumn("full", F.when(F.col("tokens") > F.col("capacity"), full).otherwise(F.lit(0).cast("bigint"))).withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity"))
    kind = sized.schema["id"].dataType.simpleString()
    spec = specs.schema["spec_id"].dataType.simpleString()

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        c, base = int(pdf.capacity.iloc[0]), int(pdf.shard.iloc[0]) << 40
        pdf = pdf.sort_values(["rest", "id"], ascending=[False, True], kind="stable")
        rest = pdf.rest.to_numpy(np.int64)
        some = rest > 0
        where = closed(rest[some], sum_of_squares(rest[some], c), c)
        n = pdf.full.to_numpy(np.int64) + (rest > 0)
        made = int(where.max()) + 1 if len(where) else 0
        last = pd.DataFrame({"id": pdf.id[some], "piece": pdf.full[some], "pieces": n[some], "tokens": rest[some], "container": base + where})
        big = pdf[pdf.full > 0]
        reps = big.full.to_numpy(np.int64)
        at = np.repeat(np.arange(len(big)), reps)
        first = np.concatenate([[0], np.cumsum(reps)])[:-1]
        whole = pd.DataFrame({"id": big.id.to_numpy()[at], "piece": np.arange(reps.sum()) - first[at], "pieces": n[pdf.full.to_numpy() > 0][at], "tokens": np.int64(c), "container": base + made + np.arange(reps.sum())})
        none = pdf[pdf.tokens == 0]
        empty = pd.DataFrame({"id": none.id, "piece": np.int64(0), "pieces": np.int64(1), "tokens": np.int64(0), "container": pd.array([None] * len(none), dtype="Int64")})
        out = pd.concat([x.astype({"container": "Int64"}) for x in (whole, last, empty)])
        out.insert(0, "spec_id", pdf.spec_id.iloc[0])
        return out[["spec_id", "id", "piece", "pieces", "tokens", "container"]]

    return work.groupBy("spec_id", "shard").applyInPandas(packed, f"spec_id {spec}, id {kind}, piece bigint, pieces bigint, tokens bigint, container bigint")


def _packed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    sized = token_sizes(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary)
    return pack(sized, "doc_id", table(spark, sf_dir, "pack_specs"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of each container."""
    caps = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens")
    fill = _packed(spark, sf_dir).filter("container IS NOT NULL").groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    return fill.join(F.broadcast(caps), "spec_id").select("spec_id", "container", "texts", "tokens", "capacity_tokens", (F.col("tokens") / F.col("capacity_tokens")).alias("fill"))


QUERIES = {"p7_pieces": p7_pieces, "p7_containers": p7_containers}
SQL: dict[str, str] = {}
