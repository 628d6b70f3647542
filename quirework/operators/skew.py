"""Per-key counts that no hot key can hold up.

Every step is an algebraic aggregate: tasks fold their own rows into a bounded hash table (it
spills when full), and what is shuffled is one small state per task and key. Distinct counts take
a step on (key, member) first, so a key with a third of all rows is spread over all tasks by its
members; the step on the key alone then sees at most one partial state per task and key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def keyed_counts(df: DataFrame, key: str, members: dict[str, str], rows_as: str = "mentions") -> DataFrame:
    """Rows and distinct non-null members of each key.

    members maps an output column to the column whose distinct values it counts. Repeated rows
    count as rows but once as members; late rows count like any other. A null key is no key: its
    rows are left out. A null member counts as a row only. An empty table gives an empty result.
    """
    tags = [F.struct(F.lit(i).alias("tag"), F.col(f"`{c}`").cast("string").alias("member")) for i, c in enumerate(members.values())]
    told = df.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.explode(F.array(*tags)).alias("m")).select("key", "m.tag", "m.member")
    per_member = told.groupBy("key", "tag", "member").agg(F.count(F.lit(1)).alias("n"))
    out = per_member.groupBy("key").agg(
        F.sum(F.when(F.col("tag") == 0, F.col("n")).otherwise(0)).alias(rows_as),
        *[F.sum(F.when((F.col("tag") == i) & F.col("member").isNotNull(), 1).otherwise(0)).alias(name) for i, name in enumerate(members)],
    )
    return out.withColumnRenamed("key", key)


def hot_keys(df: DataFrame, keys: Sequence[str], share: tuple[int, int] = (1, 50)) -> DataFrame:
    """(key_column, key_value) of the values that hold at least share[0]/share[1] of all rows of df.

    All rows make up the whole, those with a null key too. One scan serves all key columns.
    Integer arithmetic, so that a value of exactly the share is in.
    """
    part, whole = share
    pairs = F.array(*[F.struct(F.lit(k).alias("key_column"), F.col(f"`{k}`").cast("string").alias("key_value")) for k in keys])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("key_column", "key_value").agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("key_value").isNotNull() & (F.col("rows") * whole >= F.lit(part) * total.scalar())).select("key_column", "key_value")


#: Rows of a key that are paired in one step; larger keys are split into blocks of about so many.
BLOCK = 1024


def pairs_within(rows: DataFrame, block: int = BLOCK, where: Column | None = None) -> DataFrame:
    """(k, a, b), a < b, of all rows (k, i) of one key k, of any types, each (k, i) once; a key above `block` rows is done by many tasks.

    A large key is cut into blocks by the hash of i; each row goes once to every pair of blocks that its own
    block is in, and the pairs of blocks are joined as separate keys. Null keys and ids are in no pair.
    Further columns are carried for `where`, a condition on the sides a and b. An empty table gives no rows.
    """
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    held = rows.join(sizes, "k").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("i"), F.col("_blocks")).cast("int")
    partners = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.least(k, F.col("_mine")).alias("p"), F.greatest(k, F.col("_mine")).alias("q")))
    spread = held.withColumn("_mine", mine).withColumn("_p", F.explode(partners)).select(*rows.columns, "_mine", "_p.p", "_p.q")
    a, b = spread.alias("a"), spread.alias("b")
    cond = (F.col("a.k") == F.col("b.k")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q")) & (F.col("a.i") < F.col("b.i"))
    # within a block pair (p, q) with p < q only rows of different blocks are paired; p == q pairs the block itself
    cond &= (F.col("a.p") == F.col("a.q")) | (F.col("a._mine") != F.col("b._mine"))
    if where is not None:
        cond &= where
    return a.join(b, cond).select(F.col("a.k").alias("k"), F.col("a.i").alias("a"), F.col("b.i").alias("b"))


#: Keys of items, and owners' keys, that one task of union_counts holds; words of 64 bits that it works on at a time.
ITEM_KEYS, ASKED_KEYS, WORDS = 1 << 17, 1 << 20, 1 << 22
#: A key that at least one in so many items of a task has is a map of bits there, any other a list.
DENSE = 2048


def asked_keys(asks: DataFrame, owner: str, key: str) -> tuple[DataFrame, DataFrame]:
    """((owner, o, ks), (key, k)), cut: owners with the numbers of their distinct keys, and the keys' numbers. asks: (owner, key), none null."""
    keys = cut(asks.select(key).distinct().withColumn("k", F.monotonically_increasing_id()))
    owners = asks.join(keys, key).groupBy(owner).agg(F.collect_set("k").alias("ks"))
    return cut(owners.withColumn("o", F.monotonically_increasing_id())), keys


def union_counts(owners: DataFrame, items: DataFrame, item_keys: int = ITEM_KEYS, asked: int = ASKED_KEYS) -> DataFrame:
    """(o, items, weight): of each owner, the items that have one of its keys, each once, and the sum over keys of their weights.

    owners: (o, ks), o distinct; items: (h, ks, w), a row for each item, h a hash of it, w its weight; the numbers in ks
    distinct. Owners without an item have no row. Pairs of owner and item are not shuffled, whose number grows as the square
    of the input: blocks of items meet blocks of owners, and a task folds the items of each owner's keys as maps of bits.
    """
    items, owners = cut(items.select("h", "ks", "w")), owners.select("o", "ks")
    blocks = lambda df, most: int((df.agg(F.sum(F.size("ks"))).first()[0] or 0) // most + 1)
    p, q = blocks(items, item_keys), blocks(owners, asked)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = owners.select(F.pmod(F.xxhash64("o"), F.lit(q)).cast("int").alias("q"), "o", "ks").withColumn("p", all_of(p))
    right = items.select(F.pmod("h", F.lit(p)).cast("int").alias("p"), "ks", "w").withColumn("q", all_of(q))
    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(_unions, "o bigint, items bigint, weight bigint")
    return met.groupBy("o").agg(F.sum("items").alias("items"), F.sum("weight").alias("weight"))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and the row of each."""
    lengths = lists.map(len).to_numpy(np.int64)
    return np.concatenate([np.asarray(x, np.int64) for x in lists]), np.repeat(np.arange(len(lists)), lengths)


def _unions(owners: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    if not len(owners) or not len(items):
        return pd.DataFrame({"o": [], "items": [], "weight": []}, dtype=np.int64)
    key, item = _flat(items.ks)
    keys, key = np.unique(key, return_inverse=True)
    order = np.argsort(key, kind="stable")
    key, item = key[order], item[order]
    length = np.bincount(key, minlength=len(keys))
    weight = np.zeros(len(keys), np.int64)
    np.add.at(weight, key, items.w.to_numpy(np.int64)[item])
    starts = np.cumsum(length) - length

    asked, row = _flat(owners.ks)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    row, asked = row[keys[at] == asked], at[keys[at] == asked]
    total, out = np.zeros(len(owners), np.int64), np.zeros(len(owners), np.int64)
    np.add.at(total, row, weight[asked])
    several = np.bincount(row, minlength=len(owners))[row] > 1
    out[row[~several]] = length[asked[~several]]
    row, asked = row[several], asked[several]

    # maps of bits of the keys that many items have
    words = len(items) // 64 + 1
    dense = length * DENSE >= len(items)
    turn = np.cumsum(dense) - 1
    bits = np.zeros((int(dense.sum()), words), np.uint64)
    own = dense[key]
    word = turn[key[own]] * words + (item[own] >> 6)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
    if len(word):
        bits.ravel()[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (item[own] & 63).astype(np.uint64), first)

    new = np.r_[True, row[1:] != row[:-1]][: len(row)]
    cost = np.cumsum(np.where(dense[asked], words, length[asked]) + words * new)
    for part in _parts(cost, new):
        r, k = row[part], asked[part]
        mine, r = np.unique(r, return_inverse=True)
        held = np.zeros((len(mine), words), np.uint64)
        if (d := dense[k]).any():
            heads = np.flatnonzero(np.r_[True, r[d][1:] != r[d][:-1]])
            held[r[d][heads]] = np.bitwise_or.reduceat(bits[turn[k[d]]], heads, axis=0)
        got = np.bitwise_count(held).sum(1, dtype=np.int64)
        r, k = r[~d], k[~d]
        n = length[k]
        x = item[np.repeat(starts[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        r = np.repeat(r, n)
        fresh = (held[r, x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 0
        got += np.bincount(np.unique(r[fresh] * len(items) + x[fresh]) // len(items), minlength=len(mine))
        out[mine] = got
    hit = out > 0
    return pd.DataFrame({"o": owners.o.to_numpy()[hit], "items": out[hit], "weight": total[hit]})


def _parts(cost: np.ndarray, new: np.ndarray) -> list[slice]:
    """Slices of rows of about WORDS together, ending where a new owner begins."""
    if not len(cost):
        return []
    heads = np.flatnonzero(new)
    part = cost[heads] // WORDS
    ends = np.r_[heads[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])], len(cost)]
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
