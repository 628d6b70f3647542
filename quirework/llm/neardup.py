"""Problem 5: records that are another record with small edits.

Improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles, banded, verified by the
share of distinct shingles that recur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard, table
from .blocks import bucket_pairs


@dataclass(frozen=True)
class Settings:
    """words per shingle; bands of rows samples; least share of distinct shingles.

    A pair of weighted similarity s is met with probability 1 - (1 - s**rows)**bands: 0.9993 at 0.65,
    0.992 at 0.6, 0.85 at 0.5 and 0.06 at 0.25, where most pairs of one topic lie, for 60 bands of 5.
    The logarithmic frequency is held within `least_idf` and `most_idf`, so that a mistyped word, the
    rarest of all, weighs no more than other rare ones. A pair that is met is judged by `share`
    alone, the part of the distinct shingles of each that recur in the other. Frequencies are kept
    by hash in 2**df_bits counters, whatever the size of the input.
    """

    words: int = 1
    bands: int = 60
    rows: int = 5
    share: float = 0.78
    least_idf: float = 0.05
    most_idf: float = 4.5
    df_bits: int = 18
    seed: int = 7


def shingled(df: DataFrame, text: str, words: int, as_col: str) -> DataFrame:
    """df with the sorted 64-bit hashes of the word shingles of a text column, repeated ones repeated; case, spacing and punctuation aside.

    Words are hashed once, into a column of their own; a shingle is the hash of a window of these.
    """
    toks = F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    if words == 1:
        return df.withColumn(as_col, F.array_sort(F.transform(toks, lambda g: F.xxhash64(g))))
    k = np.uint64(words)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for seq in pdf["_h"]:
                h = np.asarray(seq, np.int64).view(np.uint64)
                n = max(len(h) - words + 1, 1)
                z = np.full(n if len(h) else 0, k, np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(min(words, len(h))):
                        z = (z ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                        z ^= z >> np.uint64(29)
                out.append(np.sort(z.view(np.int64)))
            yield pdf.drop(columns="_h").assign(**{as_col: out})

    hashed = df.withColumn("_h", F.transform(toks, lambda g: F.xxhash64(g)))
    kept = [f for f in df.schema if f.name != as_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{as_col}` array<bigint>"
    return hashed.select(*[f.name for f in kept], "_h").mapInPandas(windows, schema)


def _uniform(h: np.ndarray, j: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from a hash of (h, j, salt): rows by columns."""
    with np.errstate(over="ignore"):
        z = h[:, None] + (j[None, :] * np.uint64(8) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


#: Bands that are shuffled at a time.
BANDS_AT_ONCE = 10

#: Shingles of a single text that are sampled at a time.
LARGE_BATCH = 20_000


def icws(h: np.ndarray, weight: np.ndarray, samples: int, seed: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each weighted element: ln a (the least wins) and a hash of (element, t), for each sample from the first on."""
    h = h.astype(np.int64).view(np.uint64)
    j = np.arange(first, first + samples, dtype=np.uint64) + np.uint64(seed * 1_000_003)
    r = -np.log(_uniform(h, j, 0) * _uniform(h, j, 1))
    c = -np.log(_uniform(h, j, 2) * _uniform(h, j, 3))
    beta = _uniform(h, j, 4)
    t = np.floor(np.log(weight)[:, None] / r + beta)
    ln_a = np.log(c) - r * (t - beta) - r
    with np.errstate(over="ignore"):
        mark = (h[:, None] ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        mark ^= mark >> np.uint64(32)
    return ln_a, mark


def band_hashes(docs: list[np.ndarray], idf: np.ndarray, s: Settings, bands: range | None = None) -> np.ndarray:
    """(documents, bands) 64-bit hashes, of all bands or a range of them. docs: sorted shingle hashes of each, none empty."""
    bands = bands or range(s.bands)
    lengths = np.array([len(d) for d in docs])
    flat = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), lengths)
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(flat)))
    flat, doc = flat[at], doc[at]
    values, code = np.unique(flat, return_inverse=True)
    code, inv = np.unique(code * (tf.max() + 1) + tf, return_inverse=True)
    both = np.stack([values[code // (tf.max() + 1)], code % (tf.max() + 1)], 1)
    w = (1 + np.log(both[:, 1])) * idf[(both[:, 0] & (len(idf) - 1)).astype(np.int64)]
    k, j = len(bands) * s.rows, bands[0] * s.rows
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    if len(both) > LARGE_BATCH and len(docs) == 1:
        # one very long text: the least so far is carried over parts of its shingles
        best, won = np.full(k, np.inf), np.zeros((1, k), np.uint64)
        for at in range(0, len(both), LARGE_BATCH):
            ln_a, mark = icws(both[at : at + LARGE_BATCH, 0], w[at : at + LARGE_BATCH], k, s.seed, j)
            i = ln_a.argmin(0)
            less = ln_a[i, np.arange(k)] < best
            best = np.where(less, ln_a[i, np.arange(k)], best)
            won[0, less] = mark[i, np.arange(k)][less]
    else:
        ln_a, mark = icws(both[:, 0], w, k, s.seed, j)
        order = np.argsort(ln_a, axis=0, kind="stable")
        rank = np.empty_like(order, dtype=np.int32)
        np.put_along_axis(rank, order, np.arange(len(both), dtype=np.int32)[:, None], axis=0)
        least = np.minimum.reduceat(rank[inv], starts, axis=0)
        won = np.take_along_axis(mark, np.take_along_axis(order, least, axis=0), axis=0)
    out = np.tile(np.array(bands, np.uint64), (len(docs), 1))
    with np.errstate(over="ignore"):
        for i in range(s.rows):
            out = (out ^ won[:, i :: s.rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


#: A shingle in fewer texts than this may be an edit and does not name a text's group.
KNOWN = 4


def idf_table(docs: DataFrame, shingles: str, s: Settings) -> np.ndarray:
    """ln(groups / groups with the shingle) by the low bits of the shingle's hash.

    A group is all texts with the same two sampled shingles (of those in several texts): a statement
    repeated with edits in a third of all rows falls into few groups, so its words stay as rare as those of
    other statements. Groups are counted approximately, in each task first.
    """
    slots = 1 << s.df_bits
    seen = cut(docs.select(F.explode(F.array_distinct(shingles)).alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))).toPandas()
    freq = np.zeros(slots, np.int64)
    freq[seen.k.to_numpy(np.int64)] = seen.n.to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(freq >= KNOWN)

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf[shingles].map(len).to_numpy()
            if not len(lengths):
                continue
            flat = np.concatenate([np.asarray(x, np.int64) for x in pdf[shingles]])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            known = held.value[(flat & (slots - 1))]
            group = np.zeros(len(lengths), np.uint64)
            for salt in (1, 2):
                with np.errstate(over="ignore"):
                    z = (flat.view(np.uint64) ^ np.uint64(salt * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    z = (z ^ (z >> np.uint64(29))) >> np.uint64(1)
                    # one that is not known wins only where none is
                    least = np.minimum.reduceat(np.where(known, z, z | np.uint64(1 << 63)), starts)
                    group = (group ^ least) * np.uint64(0xD6E8FEB86659FD93)
            yield pd.DataFrame({"g": group.view(np.int64), "sh": pdf[shingles]})

    groups = docs.select(shingles).mapInPandas(grouped, "g bigint, sh array<bigint>")
    each = groups.select("g", F.explode(F.array_distinct("sh")).alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("k")).agg(F.approx_count_distinct("g", 0.1).alias("n"))
    found = cut(each).toPandas()
    n = groups.agg(F.approx_count_distinct("g", 0.02)).first()[0]
    count = np.ones(slots)
    count[found.k.to_numpy(np.int64)] = np.maximum(found.n.to_numpy(float), 1)
    return np.clip(np.log(max(n, 1) / count), s.least_idf, s.most_idf)


@dataclass
class NearDuplicates:
    """members: (scope, id, class) of every record with a shingle. pairs: (a, b, weighted, share) of classes, a < b."""

    members: DataFrame
    pairs: DataFrame


def near_duplicates(df: DataFrame, id_col: str, text_col: str, scope_col: str | None = None, settings: Settings = Settings()) -> NearDuplicates:
    """Group records whose texts are equal but for small edits, within their scope.

    Records with the same shingles in the same numbers are one class and enter the search once;
    classes are compared with each other, so copies are never multiplied. Null and empty texts and
    texts without a letter or digit belong to no class. Texts are used whole, however long; a text
    shorter than a shingle is one shingle. Records with equal ids in a scope count once. An empty
    table gives empty results. Other columns are ignored.
    """
    s = settings
    scope = F.col(f"`{scope_col}`").cast("string") if scope_col else F.lit("")
    recs = df.select(scope.alias("scope"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("_text")).filter("id IS NOT NULL AND _text IS NOT NULL")
    recs = shingled(recs, "_text", s.words, "sh").select("scope", "id", "sh").filter(F.size("sh") > 0)
    full = cut(recs.withColumn("class", F.unhex(F.md5(F.concat_ws(" ", F.coalesce("scope", F.lit("")), F.array_join(F.col("sh").cast("array<string>"), " "))))))
    spark = df.sparkSession
    classes = cut(full.groupBy("class").agg(F.any_value("sh").alias("sh")).withColumn("n", F.monotonically_increasing_id()))
    recs = cut(full.select("scope", "id", "class"))
    discard(full)
    idf = spark.sparkContext.broadcast(idf_table(classes, "sh", s))

    def banded(bands: range):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in _by_size(pdf, 40_000):
                    docs = [np.asarray(x, np.int64) for x in part.sh]
                    low, high = _maps(docs)
                    sizes = np.array([1 + np.count_nonzero(d[1:] != d[:-1]) for d in docs], np.int32)
                    each = {"n": part.n.to_numpy(), "low": low, "high": high, "size": sizes}
                    yield pd.DataFrame({"hash": band_hashes(docs, idf.value, s, bands).reshape(-1), **{c: np.repeat(x, len(bands)) for c, x in each.items()}})

        return rows

    # a few bands at a time are on disk; pairs that cannot share enough by their maps of 128 bits are dropped where they meet
    met = None
    for b in range(0, s.bands, BANDS_AT_ONCE):
        rows = classes.select("n", "sh").mapInPandas(banded(range(b, min(b + BANDS_AT_ONCE, s.bands))), "hash bigint, n bigint, low bigint, high bigint, size int")
        some = bucket_pairs(rows, "hash", "n", bits=("low", "high"), size="size", share=s.share)
        met = some if met is None else met.unionByName(some)
    near = cut(met.distinct())

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = len(idf.value) - 1
        for pdf in batches:
            got = []
            for x, y in zip(pdf.sh_a, pdf.sh_b):
                (u, m), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
                _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                wx, wy = (1 + np.log(m)) * idf.value[u & mask], (1 + np.log(n)) * idf.value[v & mask]
                least = np.minimum(wx[i], wy[j]).sum()
                got.append((least / (wx.sum() + wy.sum() - least), len(i) / max(len(u), len(v))))
            out = pd.DataFrame(got, columns=["weighted", "share"], index=pdf.index)
            out = pd.concat([pdf[["a", "b"]], out], axis=1)
            yield out[out.share >= s.share - 1e-9]

    # only classes in a pair are shuffled for it; candidates may fall to the share of short hashes, the rest are compared in full
    held = near.select(F.col("a").alias("n")).unionByName(near.select(F.col("b").alias("n"))).distinct()
    paired = cut(classes.join(held, "n", "left_semi"))
    brief = paired.select("n", F.array_distinct(F.transform("sh", lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int"))).alias("u"))
    told = near.join(brief.select(F.col("n").alias("a"), F.col("u").alias("ua")), "a").join(brief.select(F.col("n").alias("b"), F.col("u").alias("ub")), "b")
    close = told.filter(F.size(F.array_intersect("ua", "ub")) >= F.greatest(F.size("ua"), F.size("ub")) * F.lit(s.share - 1e-6)).select("a", "b")
    both = close.join(paired.select(F.col("n").alias("a"), F.col("sh").alias("sh_a"), F.col("class").alias("class_a")), "a").join(paired.select(F.col("n").alias("b"), F.col("sh").alias("sh_b"), F.col("class").alias("class_b")), "b")
    pairs = both.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "sh_a", "sh_b")
    found = cut(pairs.mapInPandas(verified, "a binary, b binary, weighted double, share double"))
    for spent in (classes, near, paired):
        discard(spent)
    return NearDuplicates(recs, found)


def _maps(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Two maps of 64 bits of each text: one bit of 128 for each shingle."""
    flat = np.concatenate(docs).view(np.uint64) >> np.uint64(40)
    starts = np.cumsum([0, *[len(d) for d in docs[:-1]]])
    bit = np.uint64(1) << flat % np.uint64(64)
    return [np.bitwise_or.reduceat(np.where((flat >> np.uint64(6)) % np.uint64(2) == i, bit, np.uint64(0)), starts).view(np.int64) for i in (0, 1)]


def _by_size(pdf: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Slices of rows with about `most` shingles together; one row at least."""
    if len(pdf):
        part = (np.cumsum([len(x) for x in pdf.sh]) // most).tolist()
        for _, rows in pdf.groupby(part, sort=False):
            yield rows


def _statements(spark: SparkSession, sf_dir: str, least_words: int = 8) -> DataFrame:
    """(field, chunk_id, text) of claims and positions that state something."""
    notes = table(spark, sf_dir, "notes").select("chunk_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("claim", "position")])).alias("s")).select("chunk_id", "s.*")
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    return notes.filter(F.col("text").isNotNull() & (F.lower(F.trim("text")) != "not-in-passage") & ((F.col("field") == "claim") | (words >= least_words)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_statements(spark, sf_dir), "chunk_id", "text", "field")
    members = cut(found.members.distinct())
    linked = found.pairs.select("a", "b").unionByName(members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b")))
    x = linked.join(members.select(F.col("class").alias("a"), F.col("id").alias("id_a"), "scope"), "a")
    y = x.join(members.select(F.col("class").alias("b"), F.col("id").alias("id_b")), "b").filter((F.col("a") != F.col("b")) | (F.col("id_a") < F.col("id_b")))
    y = y.filter(F.col("id_a") != F.col("id_b"))
    return y.select(F.least("id_a", "id_b").alias("chunk_id_a"), F.greatest("id_a", "id_b").alias("chunk_id_b"), F.col("scope").alias("field")).distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement with the class of its exact copies, the class size and its links to other classes."""
    found = near_duplicates(_statements(spark, sf_dir), "chunk_id", "text", "field")
    pairs = cut(found.pairs.select("a", "b"))
    links = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    members = found.members.distinct()
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(sizes, "class").join(links, "class", "left").select(F.col("scope").alias("field"), F.col("id").alias("chunk_id"), F.lower(F.hex("class")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
SQL: dict[str, str] = {}
