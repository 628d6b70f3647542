"""Problem 9: the reading level of each document.

Gradient-boosted regression trees over distributions of length, vocabulary, syntax and cohesion,
cross-validated by source, their predictions cut into levels where the held-out ones agree best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table

# Frequent function words by language.
ENGLISH = frozenset("the of and to was that by its it is with as for on were had but not so they he she we his her this which from or an be been at their there no who have".split())
OTHER = frozenset(
    """le la les des une du et est dans pour qui que au aux par sur ne pas ce cette ces leur avait
    der das und den dem des ein eine einen nicht mit zu im von auf aber diese dieser wurde ist sich
    el los las del una y que por con para se su este esta como fue pero
    il lo gli della che di un per con non sono het een van niet met dat zijn o os do da em não uma com
    et cum non est sed qui quod""".split()
) - {"a", "in", "on", "an", "as", "so", "no", "be", "we", "for", "is", "was", "do", "die", "me", "of"}


@dataclass(frozen=True)
class Settings:
    """The bound on labelled documents (the first by hash) and the trees.

    least_chars: texts below it have no level. digits: the share of digits above which a text is
    apparatus (prose holds below 0.035, reference lists 0.045 and more). foreign: a text is not
    English where the function words of other languages are more than half as many as the English
    ones and more than this share. piece: words after which an unpunctuated run is cut.
    """

    labelled: int = 20_000
    least_chars: int = 200
    digits: float = 0.04
    foreign: float = 0.06
    piece: int = 40
    buckets: int = 1 << 15
    trees: int = 120
    depth: int = 3
    rate: float = 0.1
    folds: int = 5


_TOKENS = re.compile(r"[^\W\d_]+|[.!?]+(?=[\"'”’)\s]|$)|\n\s*\n")
_BROKEN = re.compile(r"(?<=[a-z])-\n(?=[a-z])")
QUANTILES = np.array([0.1, 0.25, 0.5, 0.75, 0.9])
BANDS = 12


def bucket(w: str, n: int) -> int:
    h = 1469598103934665603
    for c in w.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 29)) % n


class Lexicon(dict):
    """A number for every token, with what is known of it by number.

    score is the mean level of the labelled documents that hold the word (by hash bucket, drawn to
    the mean of all), sure is 0 for words of no labelled document. Started anew when it holds `most`.
    """

    def __init__(self, total: np.ndarray, count: np.ndarray, mean: float, prior: float = 2.0, most: int = 400_000):
        super().__init__()
        self.by_bucket, self.counted, self.mean, self.most = (total + prior * mean) / (count + prior), count > 0, mean, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows: list[tuple[float, float, int, int, int, int]] = []
        self.known = np.zeros((0, 6))

    def __missing__(self, w: str) -> int:
        if w[0].isalpha():
            b = bucket(w, len(self.by_bucket))
            self.rows.append((self.by_bucket[b], float(self.counted[b]), len(w), w in ENGLISH, w in OTHER, 0))
        else:
            self.rows.append((self.mean, 0.0, 0, 0, 0, 1))
        n = len(self)
        self[w] = n
        return n

    def table(self) -> np.ndarray:
        """Rows by number: score, sure, letters, English, other, end of sentence."""
        if len(self.known) < len(self.rows):
            self.known = np.concatenate([self.known, np.array(self.rows[len(self.known) :], float)])
        return self.known


def measured(texts: list[str], lex: Lexicon, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(running English prose or not, features) of each text; all texts hold something.

    Features are distributions over the sentences of a text, weighted by their words. An
    unpunctuated run of more than twice s.piece words is cut into pieces.
    """
    if len(lex) > lex.most:
        lex.reset()
    ids, counts, plain = [], [], np.zeros((len(texts), 7))
    for i, t in enumerate(texts):
        if "-\n" in t:
            t = _BROKEN.sub("", t)
        b = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        plain[i] = len(t), np.count_nonzero((b >= 48) & (b <= 57)), np.count_nonzero((b >= 65) & (b <= 90)), t.count(","), t.count(";"), t.count('"'), t.count("?")
        toks = _TOKENS.findall(t.lower())
        ids.append(np.fromiter(map(lex.__getitem__, toks), np.int64, len(toks)))
        counts.append(len(toks))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    about = lex.table()[flat]
    end = about[:, 5] > 0
    # sentences by number over all texts; a new one after each end and at each text
    new = np.zeros(len(flat), np.int64)
    new[1:] = end[:-1] | (doc[1:] != doc[:-1])
    sent = np.cumsum(new)
    word = ~end
    flat, doc, sent, about = flat[word], doc[word], sent[word], about[word]
    n_docs = len(texts)
    per_doc = np.bincount(doc, minlength=n_docs)
    if not len(flat):
        return np.zeros(n_docs, bool), np.zeros((n_docs, 0))
    starts = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
    size = np.diff(np.append(starts, len(flat)))
    place = np.arange(len(flat)) - np.repeat(starts, size)
    piece = np.where(np.repeat(size, size) > 2 * s.piece, place // s.piece, 0)
    starts = np.flatnonzero(np.r_[True, (sent[1:] != sent[:-1]) | (piece[1:] != piece[:-1])])
    size = np.diff(np.append(starts, len(flat))).astype(float)
    at = doc[starts]
    score, sure, letters = about[:, 0], about[:, 1], about[:, 2]
    known = np.add.reduceat(sure, starts)
    level = np.where(known > 0, np.add.reduceat(score * sure, starts) / np.maximum(known, 1), lex.mean)
    high = np.maximum.reduceat(score * sure, starts)
    wide = np.add.reduceat(letters, starts) / size
    long = np.add.reduceat((letters >= 9).astype(float), starts) / size
    total = np.maximum(np.bincount(at, size, n_docs), 1)
    base = np.concatenate([[0], np.cumsum(np.bincount(at, size, n_docs))])[:-1]
    ends = np.cumsum(np.bincount(at, minlength=n_docs)) - 1
    cols = []
    for x in (level, high, wide, size, long):
        order = np.lexsort((x, at))
        run = np.cumsum(size[order])
        for q in QUANTILES:
            cols.append(x[order[np.minimum(np.searchsorted(run, base + q * total), np.maximum(ends, 0))]])
        cols.append(np.bincount(at, x * size, n_docs) / total)
    edges = np.linspace(1, 4, BANDS + 1)[1:-1]
    cols += list((np.bincount(at * BANDS + np.digitize(level, edges), size, n_docs * BANDS).reshape(n_docs, BANDS) / total[:, None]).T)
    n = np.maximum(per_doc, 1)
    same = np.unique(doc * np.int64(len(lex) + 1) + flat) // np.int64(len(lex) + 1)
    cols += [per_doc, np.bincount(same, minlength=n_docs) / n, *(plain[:, 3:] / n[:, None]).T, plain[:, 2] / np.maximum(plain[:, 0], 1)]
    for w in ("and", "of", "the"):
        cols.append(np.bincount(doc, flat == lex[w], n_docs) / n)
    # cohesion: words of five letters and more that the sentence before holds too
    long5 = letters >= 5
    nth = np.repeat(np.arange(len(starts)), size.astype(np.int64))[long5]
    key = np.unique(flat[long5] * np.int64(len(starts) + 1) + nth)
    again = (key[1:] == key[:-1] + 1) & (key[1:] // (len(starts) + 1) == key[:-1] // (len(starts) + 1))
    where = key[1:][again] % (len(starts) + 1)
    met = np.bincount(where, minlength=len(starts)) * np.r_[False, at[1:] == at[:-1]]
    ratio = met / np.maximum(size, 1)
    pairs = np.maximum(np.bincount(at, minlength=n_docs) - 1, 1)
    mean = np.bincount(at, ratio, n_docs) / pairs
    cols += [mean, np.sqrt(np.maximum(np.bincount(at, ratio**2, n_docs) / pairs - mean**2, 0))]
    english, other = np.bincount(doc, about[:, 3], n_docs), np.bincount(doc, about[:, 4], n_docs)
    prose = (plain[:, 0] >= s.least_chars) & (plain[:, 1] <= s.digits * plain[:, 0]) & (per_doc > 0) & ~((other > s.foreign * per_doc) & (2 * other > english))
    return prose, np.stack(cols, 1)


def slices(pdf: pd.DataFrame, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows with a text, in slices of about `most` characters; one row at least."""
    pdf = pdf[pdf.text.map(lambda t: bool(t) and not t.isspace())]
    if len(pdf):
        for _, part in pdf.groupby((pdf.text.map(len).cumsum() // most).to_numpy(), sort=False):
            yield part


class Trees:
    """Gradient-boosted regression trees of fixed depth on binned features, squared loss."""

    def __init__(self, trees: int, depth: int, rate: float, bins: int = 48, least: int = 8, shrink: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.shrink = trees, depth, rate, bins, least, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        self.start = float(y.mean()) if len(y) else 0.0
        at = np.full(len(y), self.start)
        self.made = []
        m, f = 2**self.depth - 1, x.shape[1]
        for _ in range(self.n):
            r = y - at
            col, cut_at = np.zeros(m, np.int64), np.full(m, self.bins, np.int64)
            node = np.zeros(len(y), np.int64)
            for d in range(self.depth):
                first, width = 2**d - 1, 2**d
                local = node - first
                key = (local[:, None] * f + np.arange(f)) * self.bins + b
                cnt = np.bincount(key.ravel(), minlength=width * f * self.bins).reshape(width, f, self.bins).cumsum(2)
                tot = np.bincount(key.ravel(), np.repeat(r, f), minlength=width * f * self.bins).reshape(width, f, self.bins).cumsum(2)
                n, t = cnt[:, :, -1:], tot[:, :, -1:]
                gain = tot**2 / (cnt + self.shrink) + (t - tot) ** 2 / (n - cnt + self.shrink) - t**2 / (n + self.shrink)
                gain[(cnt < self.least) | (n - cnt < self.least)] = -np.inf
                best = gain.reshape(width, -1).argmax(1)
                ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                col[first : first + width] = np.where(ok, best // self.bins, 0)
                cut_at[first : first + width] = np.where(ok, best % self.bins, self.bins)
                node = 2 * node + 1 + (b[np.arange(len(y)), col[node]] > cut_at[node])
            leaf = node - m
            n = np.bincount(leaf, minlength=m + 1)
            value = self.rate * np.bincount(leaf, r, minlength=m + 1) / (n + self.shrink)
            self.made.append((col, cut_at, value))
            at += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1).astype(np.int64) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, m = self._bin(x), 2**self.depth - 1
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for col, cut_at, value in self.made:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, col[node]] > cut_at[node])
            out += value[node - m]
        return out


def cut_points(predicted: np.ndarray, wanted: np.ndarray) -> list[float]:
    """Between each two levels the prediction that parts the held-out documents with the fewest errors."""
    out = []
    for k in (1, 2, 3):
        grid = np.linspace(k + 0.2, k + 0.8, 61)
        wrong = [((predicted >= g) != (wanted >= k + 0.5)).sum() for g in grid]
        best = np.flatnonzero(np.array(wrong) == min(wrong))
        out.append(float(grid[best[len(best) // 2]]) if len(predicted) else k + 0.5)
    return out


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray, float]
    trees: Trees
    cuts: list[float]
    held_out: pd.DataFrame


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on at most settings.labelled documents with a level; None where there is no usable label.

    docs: (doc_id, text, source); labels: (doc_id, level), several per document are averaged, null
    and out-of-range levels are ignored, as are labels of documents that are no running English.
    """
    s = settings
    spark = docs.sparkSession
    sc = spark.sparkContext
    wanted = labels.filter("level BETWEEN 1 AND 4 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("level").alias("level"))
    wanted = wanted.orderBy(F.xxhash64("doc_id")).limit(s.labelled)
    fold = F.pmod(F.xxhash64(F.lower(F.trim(F.coalesce("source", F.lit(""))))), F.lit(s.folds)).cast("int")
    seen = docs.select("doc_id", "text", "source").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), fold.alias("fold"), "level")

    def prose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(np.zeros(1), np.zeros(1), 0.0)
        for pdf in batches:
            for part in slices(pdf):
                yield part[measured(part.text.to_list(), lex, s)[0]]

    seen = cut(seen.mapInPandas(prose, seen.schema).dropDuplicates(["doc_id"]))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(s.folds * s.buckets), np.zeros(s.folds * s.buckets)
        for pdf in batches:
            for t, f, y in zip(pdf.text, pdf.fold, pdf.level):
                b = np.fromiter({bucket(w, s.buckets) for w in set(_TOKENS.findall(t.lower())) if w[0].isalpha()}, np.int64) + int(f) * s.buckets
                total[b] += y
                count[b] += 1
        k = np.flatnonzero(count)
        yield pd.DataFrame({"k": k, "total": total[k], "count": count[k]})

    sums = seen.select("text", "fold", "level").mapInPandas(counts, "k bigint, total double, count double").groupBy("k").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).toPandas()
    total, count = np.zeros((s.folds, s.buckets)), np.zeros((s.folds, s.buckets))
    total.ravel()[sums.k.to_numpy(np.int64)] = sums.total.to_numpy(float)
    count.ravel()[sums.k.to_numpy(np.int64)] = sums["count"].to_numpy(float)
    mean = seen.agg(F.avg("level")).first()[0]
    if mean is None:
        return None
    held = sc.broadcast((total, count, mean))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, c, m = held.value
        lex = [Lexicon(t.sum(0) - t[f], c.sum(0) - c[f], m) for f in range(s.folds)]
        for pdf in batches:
            for f, own in pdf.groupby("fold"):
                for part in slices(own):
                    yield part[["doc_id", "source", "fold", "level"]].assign(x=list(measured(part.text.to_list(), lex[int(f)], s)[1]))

    rows = seen.mapInPandas(told, "doc_id bigint, source string, fold int, level double, x array<double>").toPandas().sort_values("doc_id", ignore_index=True)
    x, y, f = np.stack(rows.x.to_list()), rows.level.to_numpy(float), rows.fold.to_numpy(int)
    held_out = np.full(len(y), y.mean())
    for k in range(s.folds):
        if (f == k).any() and (f != k).any():
            held_out[f == k] = Trees(s.trees, s.depth, s.rate).fit(x[f != k], y[f != k]).predict(x[f == k])
    cuts = cut_points(held_out, y)
    said = rows[["doc_id", "source", "level"]].assign(predicted=held_out, said=1 + np.digitize(held_out, cuts))
    return Model((total.sum(0), count.sum(0), float(mean)), Trees(s.trees, s.depth, s.rate).fit(x, y), cuts, said)


def levels(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, level, score) of every document of running English prose of the least length.

    Null, empty and short texts, other languages, reference lists, index pages and tables have no
    row. Whole texts are read. A document stands for itself however often its text occurs. Without
    a usable label the result is empty.
    """
    s = settings
    model = fit(docs, labels, s)
    if model is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, level int, score double")
    held = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.trees, model.cuts))

    def graded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, trees, cuts = held.value
        lex = Lexicon(*lexicon)
        for pdf in batches:
            for part in slices(pdf):
                prose, x = measured(part.text.to_list(), lex, s)
                if prose.any():
                    score = trees.predict(x[prose])
                    yield pd.DataFrame({"doc_id": part.doc_id[prose], "level": (1 + np.digitize(score, cuts)).astype(np.int32), "score": score})

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInPandas(graded, "doc_id bigint, level int, score double")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "reading_labels").select("doc_id", "level")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(*_tables(spark, sf_dir)).select("doc_id", "level")


def p9_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: labelled documents, mean absolute error and share of right levels of the held-out predictions."""
    model = fit(*_tables(spark, sf_dir))
    if model is None:
        return spark.createDataFrame([], "source string, documents bigint, mean_error double, right double")
    h = model.held_out
    h = h.assign(source=h.source.str.lower().str.strip().str.replace(r"[\s_]+", "_", regex=True), error=(h.predicted - h.level).abs(), right=((h.said - h.level).abs() <= 0.5).astype(float))
    by = h.groupby("source").agg(documents=("level", "size"), mean_error=("error", "mean"), right=("right", "mean")).reset_index()
    return spark.createDataFrame(list(by.itertuples(index=False, name=None)), "source string, documents bigint, mean_error double, right double")


QUERIES = {"p9_found": p9_found, "p9_held_out": p9_held_out}
SQL: dict[str, str] = {}
