"""Rotation, budgets and first occurrences: the ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rotate(df: DataFrame, within: list[str], by: str, order: list[Column | str], weight: str | None = None, as_col: str = "turn") -> DataFrame:
    """Number rows 1, 2, ... so that the values of `by` take turns, in each group of `within`.

    A null `by` is the empty value and goes first. With a weight, a value's k-th row stands at
    k / weight, and weights of 0 and less come last.

    Without a weight no task holds a group: rows are numbered inside (group, value), the values
    inside (group, round), and the rows of earlier rounds are added from counts by round.
    """
    value = F.coalesce(F.col(by), F.lit(""))
    at = df.withColumn("_own", F.row_number().over(W.partitionBy(*within, value).orderBy(*order)))
    if weight is not None:
        keys: list[Column] = [(F.col(weight) <= 0), F.when(F.col(weight) > 0, F.col("_own") / F.col(weight)).otherwise(F.col("_own"))]
        return at.withColumn(as_col, F.row_number().over(W.partitionBy(*within).orderBy(*keys, value))).drop("_own")
    at = at.withColumn("_place", F.row_number().over(W.partitionBy(*within, "_own").orderBy(value)))
    keys_of = [F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]
    rounds = at.groupBy(*keys_of, F.col("_own").alias("_round")).agg(F.count(F.lit(1)).alias("_k"))
    before = rounds.withColumn("_before", F.sum("_k").over(W.partitionBy(*[f"_w{i}" for i in range(len(within))]).orderBy("_round").rowsBetween(W.unboundedPreceding, -1)))
    cond = F.col("_own") == F.col("_round")
    for i, c in enumerate(within):
        cond &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
    met = at.join(before.drop("_k"), cond)
    return met.withColumn(as_col, (F.coalesce("_before", F.lit(0)) + F.col("_place")).cast("int")).select(*df.columns, as_col)


def covering(df: DataFrame, within: list[str], by: str, limit: int, turn: str = "turn") -> DataFrame:
    """The first rows by turn: `limit`, or as many as there are values of `by`, whichever is more."""
    keys_of = [F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]
    sizes = df.groupBy(*keys_of).agg(F.count_distinct(F.coalesce(F.col(by), F.lit(""))).alias("_n"))
    cond = F.lit(True)
    for i, c in enumerate(within):
        cond &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return df.join(sizes, cond).filter(F.col(turn) <= F.greatest(F.lit(limit), F.col("_n"))).select(*df.columns)


def within_budget(df: DataFrame, within: list[str], order: list[Column | str], size: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes add up to the budget at most; it ends at the first row too many."""
    run = F.sum(size).over(W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("used", run).filter(F.col("used") <= budget)


def batches(df: DataFrame, within: list[str], order: str, size: str, budget: int, most: int | None = None) -> DataFrame:
    """(within, order, batch): greedy batches in order; a row goes to a new batch where the sizes would pass the budget.

    A row above the budget is a batch of its own; a null size is 0. The rows of a group pass through a task in
    order, and nothing is kept of them but the state of the last batch.
    """
    rows = df.select(*within, order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_size")

    def pass_through(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, used, n = None, 0, 0, 0
        for pdf in parts:
            out = np.zeros(len(pdf), np.int32)
            keys = list(pdf[within].astype(object).where(pdf[within].notna(), None).itertuples(index=False, name=None))
            for i, (k, s) in enumerate(zip(keys, pdf["_size"].tolist())):
                if k != key:
                    key, batch, used, n = k, 0, 0, 0
                if (n > 0 and used + s > budget) or (most is not None and n >= most):
                    batch, used, n = batch + 1, 0, 0
                used, n = used + s, n + 1
                out[i] = batch
            yield pdf.drop(columns="_size").assign(batch=out)

    return rows.repartition(*within).sortWithinPartitions(*within, order, "_size").mapInPandas(pass_through, f"{kinds}, batch int")


def first_of_each(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key, keys in the order of their first rows left to the caller."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def last_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key as a running aggregate: no sort of a key's rows."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*")
