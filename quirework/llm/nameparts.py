"""Typed names split into the parts that tell entities apart.

A name is read as a proper word (the coined surname, place or house it is built on) and the rest:
forename or initial for persons; kind words, direction and year for everything else. Which words
are common (forenames, kind words, their short forms) is learnt from how many names hold them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# English words that stand in names of bodies, places, events, periods and works.
DIRECTIONS = frozenset("northern southern eastern western upper lower north south east west inner outer".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir gen sheikh comrade lady rev col capt lt maj sgt hon fr".split())
STOPS = frozenset("the of in and a an on from for to at de la".split())
KINDS = frozenset(
    """academy administration agency agrarian alliance archive archives armistice army assembly assizes association authority awakening
    bank basin battle bay board bread brotherhood bureau cabinet canal central chamber charter church city college colony commerce commission committee
    company conference confederation congregation congress constitution convention cooperative council court crisis delta department depression desert
    district dockers dynasty emergency empire era essays estate expedition famine federation festival forest foundation free front fund general
    government grain guild gulf harbour health hills historical history household hospital independence industrial institute interregnum island
    journal kingdom labour lake land league letters liberation library lords making mandate market massacre memoirs military mill mine mission
    monarchy mosque mountains movement museum mutiny national notables oasis observatory occupation office order organisation palace parliament
    partition party peasants peninsula people peoples period plain plan plateau police political popular port post press prison province question railway
    rebellion reform reformation regency regiment region registry renaissance republic restoration revival revolt revolution riot rising river royal
    rule school schools senate settlement siege society state station street strike students sultanate survey synod taxation teachers temple territory theatre
    trade transition treaty tribunal union university uprising valley veterans village war water women workers works youth""".split()
)
#: Short forms that are no subsequence of their word.
SHORT = {"bros": "brotherhood"}

#: A word is common from this many names on, if it stands beside so many different proper words, and beside another one in
#: this part of its names: a kind of body stands beside many places, a surname, however frequent, beside few words.
COMMON_NAMES, COMMON_MATES, COMMON_PART = 40, 20, 0.2
#: A forename stands before this many different words in names of two words.
FORENAME_PARTNERS = 7
#: Letters of a proper word; where a name has none, its longest unknown word of the second number is one.
PROPER, SHORT_PROPER = 6, 4
#: Words and phrases that the driver may hold; they are those of a language, not of the data.
MOST_WORDS = 1_000_000

_INNER = re.compile(r"(?<=[^\W\d_])[-‐‑–'’ʼ`´](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_OCR = (("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"))


def fold(name: str) -> list[str]:
    """Lower-case words without accents, modifier letters and marks inside words; digits read as the letters they stand for."""
    s = unicodedata.normalize("NFKD", name)
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) not in ("Lm", "Sk", "Cf")).lower().replace("&", " and ")
    s = _INNER.sub("", s)
    out = []
    for w in _WORD.findall(s):
        if not w.isdigit() and any(c.isdigit() for c in w) and sum(c.isalpha() for c in w) > sum(c.isdigit() for c in w):
            for a, b in _OCR:
                w = w.replace(a, b)
        out.append(w)
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits (swaps of neighbours count one) between a and b; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _is_short_of(short: str, word: str) -> bool:
    if SHORT.get(short) == word:
        return True
    if len(short) >= len(word) or len(short) < 2 or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


@dataclass
class Words:
    """What is common in the names at hand. All parts are those of a language: see MOST_WORDS."""

    forenames: dict[str, int]
    common: frozenset[str]
    full_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    phrases: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.known = set(self.forenames) | self.common | KINDS | DIRECTIONS | TITLES | STOPS
        self.near = defaultdict(set)
        for w in self.known - TITLES - STOPS:
            if len(w) >= 4:
                for d in _deletes(w, 1):
                    self.near[d].add(w)
        self.cache: dict[str, str | None] = {}
        self.read: dict[str, str] = {}
        self.by_size = defaultdict(list)
        for p in self.phrases:
            self.by_size[p.count(" ") + 1].append(p.split())
        self.initials = defaultdict(set)
        for p in self.phrases:
            self.initials["".join(w[0] for w in p.split())].add(p)

    def common_word(self, w: str) -> str | None:
        """The known word that w is, or is a mistyping of; None for a proper word."""
        if w in self.known:
            return w
        if w not in self.cache:
            best = None
            if len(w) >= 4:
                plain = w.replace("rn", "m")
                if plain in self.known:
                    best = plain
                else:
                    hits = {x for d in (*_deletes(w, 1), *_deletes(plain, 1)) for x in self.near.get(d, ())}
                    near = [(min(distance(w, x, 1), distance(plain, x, 1)), -self.forenames.get(x, 0), x) for x in hits]
                    near = [x for x in near if x[0] <= 1]
                    best = min(near)[2] if near else None
            if len(self.cache) < 500_000:
                self.cache[w] = best
            return best
        return self.cache[w]

    def phrase(self, words: list[str]) -> str:
        """The kind words in full, their short forms resolved by the phrases in use; '=xy' for initials alone."""
        key = " ".join(words)
        if key in self.phrases or not words:
            return key
        if key not in self.read:
            out = key
            rest = [w for i, w in enumerate(words) if not (len(w) > 1 and w == "".join(x[0] for j, x in enumerate(words) if j != i))]
            if " ".join(rest) in self.phrases:
                out = " ".join(rest)
            elif len(rest) == 1 and rest[0] in self.initials and len(rest[0]) > 1:
                out = "=" + rest[0]
            else:
                fits = [p for p in self.by_size[len(rest)] if all(a == b or _is_short_of(a, b) for a, b in zip(rest, p))]
                if fits:
                    out = " ".join(max(fits, key=lambda p: (sum(a == b for a, b in zip(rest, p)), self.phrases[" ".join(p)])))
                else:
                    out = " ".join(rest)
            if len(self.read) < 100_000:
                self.read[key] = out
            return out
        return self.read[key]


def _deletes(w: str, most: int) -> set[str]:
    out = {w}
    for _ in range(most):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def parts(name: str, words: Words, final: bool) -> tuple[str, str, str, str, str, str]:
    """(core, kind, forename, initial, phrase, rest) of a name; core '' where it holds no proper word.

    kind 'p' for a person, 't' otherwise; rest is the direction and year.
    """
    toks = fold(name)
    comma = "," in name
    year, way, kinds, fores, initials, proper, brief = "", "", [], [], [], [], []
    for w in toks:
        if w.isdigit():
            year = year or (w if len(w) == 4 else "")
            continue
        if len(w) == 1:
            initials.append(w)
            continue
        c = words.common_word(w)
        if c is None:
            (proper if len(w) >= PROPER else kinds).append(w)
            if SHORT_PROPER <= len(w) < PROPER:
                brief.append(w)
        elif c in DIRECTIONS:
            way = c
        elif c in STOPS:
            continue
        elif c in words.forenames and c not in KINDS:
            fores.append(c)
        elif c in TITLES:
            initials.append("." + c)
        else:
            kinds.append(c)
    if not proper and brief:
        proper = [max(brief, key=len)]
        kinds.remove(proper[0])
    if not proper:
        return "", "", "", "", "", ""
    titles = [x[1:] for x in initials if x[0] == "."]
    initials = [x for x in initials if x[0] != "."]
    bare = kinds and not fores and not initials and not comma and toks[0] not in kinds
    if year or way or bare or any(k in KINDS or k in words.common for k in kinds):
        if "gen" in titles and kinds:
            kinds = ["gen", *kinds]
        core = max(proper, key=len)
        return core, "t", "", "", words.phrase(kinds) if final else " ".join(kinds), f"{way} {year}"
    if len(proper) > 1:
        core = proper[0] if comma else proper[-1]
        fores += [w for w in proper if w != core]
    else:
        core = proper[0]
    fores += kinds
    fore = fores[0] if fores else ""
    return core, "p", fore, "" if fore or not initials else initials[0], "", ""


def _learnt(df: DataFrame) -> pd.DataFrame:
    out = df.limit(MOST_WORDS + 1).toPandas()
    if len(out) > MOST_WORDS:
        raise ValueError("more common words than a language has: the column holds no names")
    return out


def common_words(strings: DataFrame, name: str, forms: dict[str, list[str]]) -> Words:
    """Learn forenames, common words and kind phrases from the distinct names. forms: forename by short form.

    The bounds are of evidence, the same at every size; only the words that meet them come to the driver.
    """
    given = {w for f, ss in forms.items() for w in (f, *ss)}
    known = KINDS | DIRECTIONS | given

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf[name]:
                toks = list(dict.fromkeys(w for w in fold(s) if len(w) > 1 and not w.isdigit() and w not in TITLES and w not in STOPS))
                two = len(toks) == 2 and not any(w in KINDS or w in DIRECTIONS for w in toks)
                at = 1 if "," in s else 0
                long = sorted((w for w in toks if len(w) >= PROPER and w not in known), key=len)[-2:]
                for i, w in enumerate(toks):
                    mate = next((x for x in reversed(long) if x != w), "") if w not in known else ""
                    rows.append((w, toks[1 - i] if two and i == at else "", int(two and i != at), mate))
            yield pd.DataFrame(rows, columns=["word", "other", "last", "mate"])

    pairs = strings.select(name).mapInPandas(tokens, "word string, other string, last int, mate string").groupBy("word", "other", "mate").agg(F.count(F.lit(1)).alias("n"), F.sum("last").alias("last"))
    seen = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.count_distinct(F.when(F.col("other") != "", F.col("other"))).alias("partners"), F.count_distinct(F.when(F.col("mate") != "", F.col("mate"))).alias("mates"), F.sum(F.when(F.col("other") != "", F.col("n")).otherwise(0)).alias("first"), F.sum("last").alias("last"))
    forename = (F.col("partners") >= FORENAME_PARTNERS) & (F.col("first") > F.col("last"))
    common = (F.col("n") >= COMMON_NAMES) & (F.col("mates") >= COMMON_MATES) & (F.col("mates") >= COMMON_PART * F.col("n"))
    seen = _learnt(seen.filter(forename | common | F.col("word").isin(sorted(given))).select("word", "n", forename.alias("forename"), common.alias("common")))
    df = dict(zip(seen.word, seen.n))
    fores = {w: int(k) for w, k, f in zip(seen.word, seen.n, seen.forename) if w not in KINDS and len(w) >= 2 and (w in given or f)}
    near = defaultdict(set)
    for w in fores:
        for d in _deletes(w, 1):
            near[d].add(w)
    for w in sorted(fores, key=fores.get):
        if w not in given:
            like = {x for v in (w, w.replace("rn", "m")) for d in _deletes(v, 1) for x in near.get(d, ()) if x != w and distance(v, x, 1) <= 1}
            if any(fores.get(x, 0) >= 5 * fores[w] for x in like):
                del fores[w]
    fores |= {w: int(df.get(w, 0)) for w in given}
    return Words(fores, frozenset(w for w, c in zip(seen.word, seen.common) if c and w not in fores))


SCHEMA = "core string, kind string, fore string, initial string, phrase string, rest string"


def parsed(strings: DataFrame, name: str, forms: dict[str, list[str]]) -> tuple[DataFrame, Words]:
    """Every distinct name with its parts, cut, and the words learnt. Kind phrases in use by few names are no phrases."""
    words = common_words(strings, name, forms)
    sc = strings.sparkSession.sparkContext

    def reader(words: Words, final: bool):
        held = sc.broadcast((words.forenames, words.common, words.phrases))
        made: list[Words] = []

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not made:
                f, c, p = held.value
                made.append(Words(f, c, {}, p))
            for pdf in batches:
                got = pd.DataFrame([parts(s, made[0], final) for s in pdf[name]], columns=["core", "kind", "fore", "initial", "phrase", "rest"], index=pdf.index)
                yield pd.concat([pdf, got], axis=1)

        return read

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strings.schema) + ", " + SCHEMA
    first = strings.mapInPandas(reader(words, False), schema)
    full = F.forall(F.split("phrase", " "), lambda w: w.isin(sorted(KINDS | {w for w in words.common if len(w) > 5})))
    used = first.filter((F.col("kind") == "t") & (F.col("phrase") != "") & full).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 3)
    used = _learnt(used)
    words = Words(words.forenames, words.common, {}, dict(zip(used.phrase, used.n.astype(int))))
    return cut(strings.mapInPandas(reader(words, True), schema)), words
