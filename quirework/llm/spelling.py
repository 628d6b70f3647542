"""Problem 1: the typed spellings of one person, body, place, work, event or period.

Proper words are banded by MinHash over padded q-grams; names whose proper words meet and whose
other parts agree are verified by Monge-Elkan similarity and clustered by stars. Names that leave
a part open (an initial, a surname alone, initials of a body) join the one entity that fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import pairs_within
from ..session import cut, table
from .blocks import bucket_pairs
from .nameparts import PROPER, parsed
from .stars import star_clusters


@dataclass(frozen=True)
class Banding:
    """Words of Jaccard similarity s over padded q-grams meet with probability 1 - (1 - s**rows)**bands.

    One letter changed in a word of ten leaves s = 0.60 (two swapped 0.50, two changed 0.33) with
    q = 3; forty bands of three meet these with 0.9999, 0.995 and 0.78, and unrelated words of
    s = 0.05 with 0.005.
    """

    q: int = 3
    bands: int = 40
    rows: int = 3
    edits: int = 2
    likeness: float = 0.9


def qgram_bands(words: list[str], s: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, bands) hashes of the minima over the padded q-grams of each word; the q-grams' map of 64 bits, and their number."""
    pad = "\x02" * (s.q - 1)
    grams = [sorted({(pad + w + pad)[i : i + s.q] for i in range(len(w) + s.q - 1)}) for w in words]
    flat = pd.util.hash_array(np.array([g for gs in grams for g in gs], dtype=object), categorize=True)
    starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])[:-1]]).astype(np.int64)
    k = np.arange(1, s.bands * s.rows + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (flat[:, None] ^ (k * np.uint64(0x9E3779B97F4A7C15))[None, :]) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        least = np.minimum.reduceat(h, starts, axis=0)
        out = np.tile(np.arange(s.bands, dtype=np.uint64), (len(words), 1))
        for i in range(s.rows):
            out = (out ^ least[:, i :: s.rows]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    maps = np.bitwise_or.reduceat(np.uint64(1) << (flat >> np.uint64(20)) % np.uint64(64), starts)
    return out.view(np.int64), maps.view(np.int64), np.array([len(gs) for gs in grams], np.int32)


def near_words(words: DataFrame, settings: Banding = Banding()) -> DataFrame:
    """(a, b, edits), a < b, of distinct words within `edits` edits, met by MinHash banding. words: (word)."""
    s = settings

    numbered = cut(words.select(F.monotonically_increasing_id().alias("n"), "word"))

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i : i + 2000]
                hashes, maps, sizes = qgram_bands(part.word.tolist(), s)
                yield pd.DataFrame({"n": np.repeat(part.n.to_numpy(), s.bands), "hash": hashes.reshape(-1), "bits": np.repeat(maps, s.bands), "size": np.repeat(sizes, s.bands)})

    # an edit changes q q-grams at most, so words whose maps show more are dropped where they meet
    met = bucket_pairs(numbered.mapInPandas(banded, "n bigint, hash bigint, bits bigint, size int"), "hash", "n", bits="bits", size="size", differ=s.q * s.edits)
    met = met.join(numbered.select(F.col("n").alias("a"), F.col("word").alias("x")), "a").join(numbered.select(F.col("n").alias("b"), F.col("word").alias("y")), "b")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).withColumn("edits", F.levenshtein("a", "b", s.edits)).filter("edits >= 0")


def deletions(words: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every string that is left of words[row] without 0 to `most` (at most 2) of its letters, each once."""
    rows, out = [], []
    sizes = np.array([len(w) for w in words])
    with np.errstate(over="ignore"):
        for at in (part for n in np.unique(sizes[sizes > most]) for part in _slices(np.flatnonzero(sizes == n), 1 + 4_000_000 // int(n) ** most)):
            n = int(sizes[at[0]])
            letters = np.array([words[i] for i in at], f"U{n}").view(np.uint32).reshape(len(at), n).astype(np.uint64) + np.uint64(1)
            power = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
            # sums of the letters up to each place, as they stand and moved by one and two places
            sums = [np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum(letters * np.r_[np.zeros(d, np.uint64), power[: n - d]], 1, dtype=np.uint64)], 1) for d in range(most + 1)]
            left = [sums[0][:, n:]]
            if most:
                i = np.arange(n)
                left.append(sums[0][:, i] + sums[1][:, n:] - sums[1][:, i + 1])
            if most > 1:
                i, j = np.triu_indices(n, 1)
                left.append(sums[0][:, i] + sums[1][:, j] - sums[1][:, i + 1] + sums[2][:, n:] - sums[2][:, j + 1])
            got = np.concatenate(left, 1)
            got.sort(1)
            new = np.concatenate([np.ones((len(at), 1), bool), got[:, 1:] != got[:, :-1]], 1)
            x, _ = np.nonzero(new)
            got = got[new]
            rows.append(at[x])
            out.append((got ^ (got >> np.uint64(31))) * np.uint64(0x94D049BB133111EB))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(out).view(np.int64)


def _slices(x: np.ndarray, most: int) -> list[np.ndarray]:
    return [x[i : i + most] for i in range(0, len(x), most)]


#: Letters of a word up to which two are left out; longer words within two edits are met by one left out and by MinHash banding.
LETTERS = 64


def words_within(words: DataFrame, edits: int, read_edits: int = 1) -> DataFrame:
    """(a, b), a < b, of all distinct words within `edits` (1 or 2) edits, each of more letters than that, and some others.

    Such words have a string in common that is left of them without `edits` letters; so have two words with one swap of
    neighbours without one letter. Two edits above LETTERS letters are met by banding, not surely. words: (word), or (word, read), where words are met too whose readings are within `read_edits`.
    """
    numbered = cut(words.withColumn("n", F.monotonically_increasing_id()))
    forms = [("word", edits), *[("read", read_edits)] * ("read" in words.columns)]

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i : i + 2000]
                got = []
                for form, most in forms:
                    size = part[form].str.len().to_numpy()
                    for fit, n in (((size <= LETTERS), most), ((size > LETTERS), 1)):
                        row, code = deletions(part[form][fit].tolist(), n)
                        got.append((np.flatnonzero(fit)[row], code))
                row, code = (np.concatenate(x) for x in zip(*got))
                yield pd.DataFrame({"n": part.n.to_numpy()[row], "hash": code}).drop_duplicates()

    met = bucket_pairs(numbered.mapInPandas(left, "n bigint, hash bigint"), "hash", "n")
    met = met.join(numbered.select(F.col("n").alias("a"), F.col("word").alias("x")), "a").join(numbered.select(F.col("n").alias("b"), F.col("word").alias("y")), "b")
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    long = numbered.filter(F.length("word") > LETTERS - edits)
    if edits > 1 and not long.filter(F.length("word") > LETTERS).isEmpty():
        met = met.unionByName(near_words(long.select("word"), Banding(edits=edits)).select("a", "b")).distinct()
    return met


def _monge_elkan(a: str, b: str):
    """Mean over the words of each side of the best likeness to a word of the other; the less of both ways."""

    def one(x: str, y: str):
        best = F.transform(F.split(x, " "), lambda u: F.array_max(F.transform(F.split(y, " "), lambda v: 1 - F.levenshtein(u, v) / F.greatest(F.length(u), F.length(v), F.lit(1)))))
        return F.aggregate(best, F.lit(0.0), lambda t, v: t + v) / F.size(best)

    return F.least(one(a, b), one(b, a))


def link_spellings(strings: DataFrame, name: str, weight: str, forms: dict[str, list[str]], settings: Banding = Banding()) -> DataFrame:
    """(name, entity) of every name with a proper word. strings: distinct names with a weight.

    Names of one entity have one entity id, itself a spelling's parts. Null and empty names and
    names without a proper word (six letters, or four where none has six, that are no common word) have no row. Persons are
    told apart by forename, other names by kind, direction and year. An initial or a surname alone
    joins a person only where one person alone fits, initials of a body likewise; else they stand
    for themselves. Repeated names count once. An empty table gives no rows.
    """
    strings = strings.filter(F.col(f"`{name}`").isNotNull() & (F.col(f"`{name}`") != "")).groupBy(F.col(f"`{name}`").alias("name")).agg(F.sum(f"`{weight}`").alias("weight"))
    read, _ = parsed(cut(strings), "name", forms)
    read = read.filter("core != ''")
    fore = cut(_forenames(read, forms))
    read = read.join(fore, "fore", "left").withColumn("fore", F.coalesce("fore_full", "fore"))
    rest = F.when(F.col("kind") == "t", F.concat_ws("|", F.lit("t"), "phrase", "rest")).when(F.col("fore") != "", F.concat_ws("|", F.lit("p"), "fore")).otherwise(F.concat_ws("|", F.lit("q"), "initial"))
    named = cut(read.select("name", "weight", "core", "kind", "fore", "initial", "phrase", "rest", rest.alias("slots"), F.concat_ws("|", "core", rest).alias("node")))
    nodes = named.groupBy("node", "core", "slots").agg(F.sum("weight").alias("weight"), F.first("kind").alias("kind"), F.first("fore").alias("fore"), F.first("initial").alias("initial"), F.first("phrase").alias("phrase"), F.first("rest").alias("rest"))
    nodes = cut(nodes)
    # words of fewer letters stand for nobody but themselves
    words = near_words(nodes.filter(F.length("core") >= PROPER).select(F.col("core").alias("word")).distinct(), settings)
    words = cut(words)
    a = nodes.select(F.col("core").alias("a"), "slots", F.col("node").alias("node_a"))
    b = nodes.select(F.col("core").alias("b"), "slots", F.col("node").alias("node_b"))
    text = lambda n: F.regexp_replace(n, r"\|[tpq]\||\|", " ")
    met = words.join(a, "a").join(b, ["b", "slots"])
    met = met.withColumns({"x": F.trim(text("node_a")), "y": F.trim(text("node_b"))}).withColumn("sim", _monge_elkan("x", "y"))
    sure = (F.col("sim") >= settings.likeness) | (F.col("edits") <= 1)
    edges = met.filter(sure & ((F.col("edits") <= 1) | ~F.col("slots").startswith("q"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "sim")
    stars = cut(star_clusters(nodes.select(F.col("node").alias("id"), "weight"), edges).select(F.col("id").alias("node"), F.col("center").alias("entity")))
    placed = nodes.join(stars, "node")
    # words that stand for a partial name: its own and those one edit away
    close = words.filter("edits <= 1")
    close = close.select(F.col("a").alias("core"), F.col("b").alias("other")).unionByName(close.select(F.col("b").alias("core"), F.col("a").alias("other")))
    partial = placed.filter("slots LIKE 'q|%' OR phrase LIKE '=%'")
    whole = placed.filter("NOT (slots LIKE 'q|%' OR phrase LIKE '=%')")
    own = partial.select("entity", "core", "initial", "phrase", "rest", "kind").distinct()
    reach = own.withColumn("other", F.col("core")).unionByName(own.join(close, "core"))
    against = whole.select(F.col("core").alias("other"), F.col("entity").alias("full"), "fore", F.col("kind").alias("kind_f"), F.col("rest").alias("rest_f"), F.col("phrase").alias("phrase_f"))
    cand = reach.join(against, "other").filter(F.col("kind") == F.col("kind_f"))
    letters = F.concat(F.lit("="), F.array_join(F.transform(F.split("phrase_f", " "), lambda w: F.substring(w, 1, 1)), ""))
    fits = ((F.col("kind") == "p") & (F.col("initial") != "") & F.col("fore").startswith(F.col("initial"))) | ((F.col("kind") == "t") & (F.col("rest") == F.col("rest_f")) & (letters == F.col("phrase")))
    one = cut(cand.filter(fits).groupBy("entity").agg(F.count_distinct("full").alias("n"), F.min("full").alias("full")).filter("n = 1").select("entity", "full"))
    # surnames alone: all persons there, with the initials that joined nobody
    left = placed.filter("slots LIKE 'q|_%'").join(one, "entity", "left_anti").select(F.col("core").alias("other"), F.col("entity").alias("full"))
    persons = whole.filter("kind = 'p'").select(F.col("core").alias("other"), F.col("entity").alias("full")).unionByName(left).distinct()
    bare = reach.filter("kind = 'p' AND initial = ''").join(persons, "other").groupBy("entity").agg(F.count_distinct("full").alias("n"), F.min("full").alias("full")).filter("n = 1").select("entity", "full")
    joins = one.unionByName(bare)
    final = stars.join(joins, "entity", "left").select("node", F.coalesce("full", "entity").alias("entity"))
    return named.select("name", "node").join(final, "node").select("name", "entity")


def _forenames(read: DataFrame, forms: dict[str, list[str]], least: int = 3, part: float = 0.5) -> DataFrame:
    """(fore, fore_full): short forms by the given table and by the company they keep.

    A forename that stands, on at least `least` proper words and `part` of all that it stands on,
    beside one more frequent forename with which it shares two letters or more is a short form of it.
    Both sides are common words, whose number is bounded.
    """
    spark = read.sparkSession
    by_short: dict[str, list[str]] = {}
    for f, ss in forms.items():
        for s in ss:
            if s not in forms:
                by_short.setdefault(s, []).append(f)
    told = spark.createDataFrame([(s, sorted(fs)[0]) for s, fs in by_short.items() if len(fs) == 1] or [("", "")], "fore string, fore_full string")
    on = read.filter("kind = 'p' AND fore != ''").select("core", "fore").distinct()
    many = on.groupBy("fore").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    on = on.join(many, "fore")
    x, y = on.alias("x"), on.alias("y")
    common = F.size(F.array_intersect(F.split(F.col("x.fore"), ""), F.split(F.col("y.fore"), "")))
    both = x.join(y, (F.col("x.core") == F.col("y.core")) & (F.col("x.fore") != F.col("y.fore")) & (F.col("y.n") >= 4 * F.col("x.n")) & (common >= 2))
    pairs = both.groupBy(F.col("x.fore").alias("fore"), F.col("y.fore").alias("fore_full")).agg(F.count(F.lit(1)).alias("k"), F.first("x.n").alias("n"))
    learnt = pairs.filter((F.col("k") >= least) & (F.col("k") >= part * F.col("n"))).groupBy("fore").agg(F.max_by("fore_full", F.struct("k", "fore_full")).alias("fore_full"))
    learnt = learnt.join(told.select("fore"), "fore", "left_anti")
    return told.unionByName(learnt.select("fore", "fore_full"))


def forename_forms(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Short forms by forename, lower case. The table is of fixed size."""
    out: dict[str, list[str]] = {}
    for r in table(spark, sf_dir, "forename_forms").select(F.lower("forename").alias("f"), F.lower("short_form").alias("s")).dropna().distinct().collect():
        out.setdefault(r.f, []).append(r.s)
    return out


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "names").select("canonical", F.lit(1).alias("weight")).unionByName(table(spark, sf_dir, "note_names").select("canonical", F.lit(1).alias("weight")))
    return typed.groupBy("canonical").agg(F.sum("weight").alias("weight"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with a proper word, its entity and how many spellings that has."""
    linked = cut(link_spellings(_strings(spark, sf_dir), "canonical", "weight", forename_forms(spark, sf_dir)))
    sizes = linked.groupBy("entity").agg(F.count(F.lit(1)).alias("spellings"))
    return linked.join(sizes, "entity").select(F.col("name").alias("canonical"), "entity", "spellings")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = cut(link_spellings(_strings(spark, sf_dir), "canonical", "weight", forename_forms(spark, sf_dir)))
    return pairs_within(linked.select(F.col("entity").alias("k"), F.col("name").alias("i"))).select(F.col("a").alias("canonical_a"), F.col("b").alias("canonical_b"))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
SQL: dict[str, str] = {}
