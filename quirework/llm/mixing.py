"""Problem 8: documents drawn so that each source supplies its target share of all tokens.

Iterative proportional fitting: the tokens of the cells source x language x topic are raked to the
source targets and to the language and topic margins of the collection, then documents are drawn
by the calibrated rates of their cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .tokens import VOCABULARY, token_sizes


@dataclass(frozen=True)
class Mix:
    """total: tokens to draw, or None for the most that all shares and repeats allow.

    All sources, languages and topics are told apart; their cells, as they occur, are held by the driver, so
    there may be `cells` of them and more are an error. The draw of a source's texts of like
    size is cut by hash at one of `steps` thresholds, and the next smaller size makes up for the rest.
    """

    total: float | None = None
    cells: int = 1_000_000
    rounds: int = 200
    tolerance: float = 1e-9
    steps: int = 2048
    seed: int = 11


def source_key(col: str):
    """A source's name without case, outer blanks and kind of separator."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s_\-]+", "_")


def rake(tokens: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], most: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Repeats per token of each cell, within [0, most]; at[k] is the cell's place in margin k, targets[k] its tokens.

    The first margin is met last in each round. A cell at its limit keeps it and the others of the
    margin make up for it where they can.
    """
    rate = np.minimum(np.ones(len(tokens)), most)
    for _ in range(rounds):
        start = rate
        for k in reversed(range(len(at))):
            for _ in range(20):
                free = (rate < most) | (k > 0)
                got = np.bincount(at[k], tokens * rate, len(targets[k]))
                held = np.bincount(at[k], tokens * rate * ~free, len(targets[k]))
                loose = got - held
                f = np.where(loose > 0, (targets[k] - held) / np.where(loose > 0, loose, 1), 1.0).clip(0)
                new = np.minimum(np.where(free, rate * f[at[k]], rate), most)
                done = np.allclose(new, rate, rtol=tolerance, atol=0)
                rate = new
                if done or k > 0:
                    break
        if np.allclose(rate, start, rtol=tolerance, atol=0):
            break
    return rate


def mixed(docs: DataFrame, targets: DataFrame, settings: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(draws, report). docs: (id, source, lang, topic, tokens); targets: (source, target_share, max_repeats).

    draws: (id, source, tokens, times) of every document with times >= 1, its source normalised.
    report: (source, documents, tokens, max_repeats, drawn_documents, drawn_tokens, wanted_share,
    reachable_share, actual_share) of every source with a target or documents. Sources without a
    target or with a null name are not drawn; targets without documents cannot be supplied: their
    share is spread over the others in proportion (reachable_share). Null shares are 0, null
    repeats 1. A repeated source in targets is taken once (the greater share). Texts of no tokens
    are not drawn. Languages and topics may be null. Empty tables give no draws.
    """
    s = settings
    want = targets.select(source_key("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")).filter("source IS NOT NULL").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most")).toPandas().sort_values("source")
    plain = docs.select("id", source_key("source").alias("source"), F.coalesce(F.substring(F.lower(F.trim("lang")), 1, 2), F.lit("-")).alias("lang"), F.coalesce("topic", F.lit("-")).alias("topic"), "tokens")
    plain = cut(plain)
    cells = plain.filter("source IS NOT NULL AND tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    known = cells.filter(F.col("source").isin(want.source.tolist()) if len(want) else F.lit(False)).limit(s.cells + 1).toPandas()
    if len(known) > s.cells:
        raise ValueError(f"more than {s.cells} cells of source, language and topic")
    known = known.merge(want, on="source")
    known = known[(known.share > 0) & (known.most > 0)].sort_values(["source", "lang", "topic"], ignore_index=True)
    spark = docs.sparkSession
    rates = pd.DataFrame({"source": pd.Series(dtype=str), "lang": pd.Series(dtype=str), "topic": pd.Series(dtype=str), "rate": pd.Series(dtype=float), "most": pd.Series(dtype=int)})
    if len(known):
        by = known.groupby("source").agg(tokens=("tokens", "sum"), share=("share", "first"), most=("most", "first"))
        reach = by.share / by.share.sum()
        total = min((by.tokens * by.most / reach).min(), s.total or np.inf)
        places, goals = [], []
        for col in ("source", "lang", "topic"):
            codes, names = pd.factorize(known[col], sort=True)
            places.append(codes)
            part = known.groupby(col).tokens.sum() / known.tokens.sum()
            goals.append((reach[names] if col == "source" else part[names]).to_numpy(float) * total)
        rate = rake(known.tokens.to_numpy(float), places, goals, known.most.to_numpy(float), s.rounds, s.tolerance)
        rates = known.assign(rate=rate)[["source", "lang", "topic", "rate", "most"]]
    told = spark.createDataFrame(list(rates.itertuples(index=False, name=None)), "source string, lang string, topic string, rate double, most int")
    u = (F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    base = F.floor("rate").cast("int")
    drawn = plain.join(F.broadcast(told), ["source", "lang", "topic"]).filter("tokens > 0").withColumn("base", base).withColumn("part", F.col("rate") - F.col("base"))
    # the place of a document in its source's order of drawing; 1 is where the calibrated rate alone would cut
    place = F.when((F.col("part") > 0) & (F.col("base") < F.col("most")), u / F.col("part"))
    drawn = drawn.withColumn("step", F.least(F.floor(place * (s.steps // 2)), F.lit(s.steps - 1)).cast("int")).withColumn("size", F.floor(F.log2("tokens")).cast("int"))
    drawn = cut(drawn.select("id", "source", "tokens", "base", "step", "size", (F.col("tokens") * F.col("rate")).alias("due")))
    sums = drawn.groupBy("source", "size", "step").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("base")).alias("based"), F.sum("due").alias("due")).toPandas()
    cuts = []
    for source, own in sums.groupby("source"):
        left = 0.0
        # from the longest texts to the shortest, each size making up for what the one before left
        for size in sorted(own["size"].unique(), reverse=True):
            g = own[own["size"] == size]
            left += g.due.sum() - g.based.sum()
            g = g.dropna(subset=["step"]).sort_values("step")
            run = np.concatenate([[0], g.tokens.cumsum().to_numpy(float)])
            k = int(np.abs(run - left).argmin())
            left -= run[k]
            cuts.append((source, int(size), int(g.step.iloc[k - 1]) if k else -1))
    last = spark.createDataFrame(cuts, "source string, size int, last int")
    times = F.col("base") + F.coalesce((F.col("step") <= F.col("last")).cast("int"), F.lit(0))
    draws = drawn.join(F.broadcast(last), ["source", "size"]).select("id", "source", "tokens", times.alias("times"))
    draws = cut(draws.filter("times > 0"))
    got = draws.groupBy("source").agg(F.sum("times").alias("drawn_documents"), F.sum(F.col("tokens") * F.col("times")).alias("drawn_tokens")).toPandas()
    held = plain.filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    reach = want.share * want.source.isin(known.source if len(known) else [])
    goals = spark.createDataFrame(list(zip(want.source, want.most.astype(int), want.share, (reach / (reach.sum() or 1)).astype(float))), "source string, max_repeats int, wanted_share double, reachable_share double")
    all_drawn = float(got.drawn_tokens.sum()) if len(got) else 0.0
    got = spark.createDataFrame([(r.source, int(r.drawn_documents), int(r.drawn_tokens), float(r.drawn_tokens / all_drawn)) for r in got.itertuples()], "source string, drawn_documents bigint, drawn_tokens bigint, actual_share double")
    zero = {"documents": 0, "tokens": 0, "drawn_documents": 0, "drawn_tokens": 0, "actual_share": 0.0}
    report = held.join(goals, "source", "full").join(got, "source", "left").fillna(zero)
    return draws, report.select("source", "documents", "tokens", "max_repeats", "drawn_documents", "drawn_tokens", "wanted_share", "reachable_share", "actual_share")


def _mixed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.col("section").alias("topic"), "text")
    return mixed(token_sizes(docs, "text", vocabulary), table(spark, sf_dir, "source_targets"))


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p8_draws": p8_draws, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
