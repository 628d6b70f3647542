"""Name search over a table of asks, phrases, identifiers and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shapes import LOCATOR, folded
from ..operators import relations as R
from ..session import table
from .store import _DOORS, _FOLD

#: Words that a search passes over.
STOPS = ("a", "an", "and", "at", "by", "de", "for", "from", "in", "la", "of", "on", "or", "the", "to", "with")
LIMIT = 10


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _asks(spark: SparkSession, d: str) -> DataFrame:
    """(target, fold): every distinct phrase that some note argues against, cites or cites about, as an ask."""
    a, c = _t(spark, d, "note_arguing_against", "note_citations")
    said = a.select("target").unionByName(c.select(F.col("cited").alias("target"))).unionByName(c.select(F.col("about").alias("target")))
    return said.filter("target IS NOT NULL").distinct().withColumn("fold", folded(F.col("target"))).filter("fold <> ''")


def _ranked_doors(spark: SparkSession, d: str) -> DataFrame:
    """(canonical, f, rank): names with their order among hits: works last, then sources, then notes, then the name."""
    doors = R.doors(*_t(spark, d, "names", "note_names", "notes"))
    rank = F.struct(F.coalesce(F.col("kind") == "work", F.lit(False)).alias("work"), (-F.col("source_count")).alias("s"), (-F.col("member_count")).alias("m"), F.col("canonical").alias("c"))
    return doors.select("canonical", folded(F.col("canonical")).alias("f"), rank.alias("rank"))


def _literal(spark: SparkSession, d: str) -> DataFrame:
    """(target, canonical, tier, rank): names that are the ask, fold like it, or hold it as words; the first tier wins."""
    asks, doors = _asks(spark, d), _ranked_doors(spark, d)
    longest = asks.agg(F.max(F.size(F.split("fold", " ")))).first()[0] or 1
    held = R.word_grams(doors, "f", 1, longest).select("canonical", "f", "rank", "gram")
    met = asks.join(held, asks.fold == held.gram)
    tier = F.when(F.col("target") == F.col("canonical"), 1).when(F.col("fold") == F.col("f"), 2).otherwise(3)
    return met.select("target", "canonical", tier.alias("tier"), "rank")


def win12_find_names(spark: SparkSession, d: str) -> DataFrame:
    """For every ask its ten best doors: exact, folded and containing names in one order."""
    w = W.partitionBy("target").orderBy("rank")
    return _literal(spark, d).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= LIMIT).select("target", "canonical", "tier", "place")


def win11_compound_fallback(spark: SparkSession, d: str) -> DataFrame:
    """For asks that no name holds: the best door of each word, the word in fewest names first; a door once."""
    lost = _asks(spark, d).join(_literal(spark, d).select("target").distinct(), "target", "left_anti")
    words = _ranked_doors(spark, d).select("canonical", "rank", F.explode(F.array_distinct(F.split("f", " "))).alias("word"))
    best = words.groupBy("word").agg(F.count(F.lit(1)).alias("names"), F.min_by("canonical", "rank").alias("canonical"))
    asked = lost.select("target", F.explode(F.array_distinct(F.split("fold", " "))).alias("word")).filter((F.col("word") != "") & ~F.col("word").isin(*STOPS))
    once = asked.join(best, "word").groupBy("target", "canonical").agg(F.min(F.struct("names", "word")).alias("m"))
    return once.select("target", "canonical", F.col("m.word").alias("word"), F.row_number().over(W.partitionBy("target").orderBy("m")).alias("place"))


def sca27_content_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs of words between stop words of every ask."""
    marked = F.array_join(F.transform(F.split("fold", " "), lambda w: F.when(w.isin(*STOPS), "|").otherwise(w)), " ")
    runs = F.filter(F.transform(F.split(marked, r"\|"), lambda r: F.trim(r)), lambda r: r != "")
    return _asks(spark, d).select("target", F.explode(runs).alias("run")).distinct()


def sca02_normal_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims in one case and with single blanks, as a key; how many share it."""
    n = table(spark, d, "notes").filter("claim IS NOT NULL")
    k = n.select("chunk_id", F.md5(F.lower(F.trim(F.regexp_replace("claim", r"[ \t\n\r\f]+", " ")))).alias("key"))
    return k.join(k.groupBy("key").agg(F.count(F.lit(1)).alias("same")), "key").select("chunk_id", "key", "same")


def sca06_unscoped(spark: SparkSession, d: str) -> DataFrame:
    """Scoped surfaces read back: the surface and the source in them."""
    nn = table(spark, d, "note_names").filter("canonical IS NOT NULL AND source_id IS NOT NULL").select("canonical", "source_id").distinct()
    s = nn.filter(F.col("canonical").rlike(LOCATOR)).select(F.concat("canonical", F.lit(" ["), "source_id", F.lit("]")).alias("scoped"))
    return s.select("scoped", F.regexp_extract("scoped", r"^(.*) \[([^\]]*)\]$", 1).alias("surface"), F.regexp_extract("scoped", r"^(.*) \[([^\]]*)\]$", 2).alias("source"))


def _isbn10(s):
    """The check digit of a number of ten places holds; X is ten, in the last place only."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda t, i: t + (11 - i) * F.substr(s, i, F.lit(1)).cast("int"))
    last = F.when(F.substr(s, F.lit(10), F.lit(1)) == "X", 10).otherwise(F.substr(s, F.lit(10), F.lit(1)).try_cast("int"))
    return s.rlike("^[0-9]{9}[0-9X]$") & ((total + last) % 11 == 0)


def sca29_isbn10(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers, padded to ten places, that would pass as an ISBN-10."""
    o = table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("number"))
    return o.withColumn("valid", _isbn10(F.col("number"))).groupBy("valid").agg(F.count(F.lit(1)).alias("numbers"), F.min("number").alias("first"))


def sca32_dois(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of works that stand in documents, sentence marks at their end off."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    found = t.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(10\.[0-9]{4,9}/[^ \t\n\r\f\"<>]+)"), F.lit(1))).alias("doi"))
    return found.select("doc_id", F.regexp_replace("doi", r"[.,;:)\]}]+$", "").alias("doi")).distinct()


def sca51_source_ids(spark: SparkSession, d: str) -> DataFrame:
    """A readable id for each source: its title as a slug of at most forty signs and twelve signs of its hash."""
    s = table(spark, d, "sources")
    stem = F.substring(F.regexp_replace(F.lower(F.coalesce("title", F.lit("untitled"))), "[^a-z0-9]+", "-"), 1, 40)
    return s.select("source_id", F.concat(stem, F.lit("-"), F.substring(F.sha2("source_id", 256), 1, 12)).alias("id"))


def sca54_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document: how many, and the length of the longest."""
    t = table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''")
    parts = F.split(F.regexp_replace("text", r"([.!?])[ \t\n\r\f]+", "$1\u0001"), "\u0001")
    return t.select("doc_id", F.size(parts).alias("sentences"), F.array_max(F.transform(parts, lambda p: F.length(p))).alias("longest"))


def win23_claim_ids(spark: SparkSession, d: str) -> DataFrame:
    """The claims of each source numbered in order."""
    n = table(spark, d, "notes").filter("claim IS NOT NULL")
    return n.select("chunk_id", F.concat("source_id", F.lit("#"), F.row_number().over(W.partitionBy("source_id").orderBy("chunk_id")).cast("string")).alias("claim_id"))


def win24_citation_index(spark: SparkSession, d: str) -> DataFrame:
    """Works cited in each source, numbered by where they first occur."""
    c = table(spark, d, "note_citations").filter("source_id IS NOT NULL AND cited IS NOT NULL")
    first = c.groupBy("source_id", "cited").agg(F.min("chunk_id").alias("first"), F.count(F.lit(1)).alias("times"))
    return first.select("source_id", "cited", "times", F.row_number().over(W.partitionBy("source_id").orderBy(F.asc_nulls_last("first"), "cited")).alias("number"))


def joi09_ids_of_names(spark: SparkSession, d: str) -> DataFrame:
    """The notes of every name, evidence or not, each once."""
    return table(spark, d, "note_names").select("canonical", "chunk_id").dropna().distinct()


def joi35_names_of_grounds(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand in the names table, of every note cited from."""
    c, nn, names = _t(spark, d, "note_citations", "note_names", "names")
    g = c.select("chunk_id").dropna().distinct()
    return nn.select("chunk_id", "canonical").dropna().distinct().join(g, "chunk_id", "left_semi").join(names.select("canonical"), "canonical", "left_semi").select("chunk_id", "canonical")


def joi37_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Per source: citations, and those whose note and whose source resolve."""
    c, n, s = _t(spark, d, "note_citations", "notes", "sources")
    c = c.filter("source_id IS NOT NULL").join(n.select("chunk_id", F.lit(1).alias("a")), "chunk_id", "left").join(s.select("source_id", F.lit(1).alias("b")), "source_id", "left")
    return c.groupBy("source_id").agg(F.count(F.lit(1)).alias("citations"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("resolved"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("win", "sca", "joi") and getattr(v, "__module__", "") == __name__}

_STOP = ", ".join(f"'{w}'" for w in STOPS)
_ASKS = f"asks AS (SELECT target, f AS fold FROM (SELECT target, {_FOLD.format('target')} AS f FROM (SELECT target FROM note_arguing_against UNION SELECT cited FROM note_citations UNION SELECT about FROM note_citations) WHERE target IS NOT NULL) WHERE f <> '')"
_RANKED = f"doors AS (SELECT canonical, {_FOLD.format('canonical')} AS f, coalesce(kind = 'work', false) AS work, -source_count AS s, -member_count AS m FROM ({_DOORS}))"
_LIT = "lit AS (SELECT target, canonical, CASE WHEN target = canonical THEN 1 WHEN fold = f THEN 2 ELSE 3 END AS tier, work, s, m FROM asks JOIN doors ON contains(' ' || f || ' ', ' ' || fold || ' '))"

SQL = {
    "win12_find_names": f"WITH {_ASKS}, {_RANKED}, {_LIT} SELECT target, canonical, tier, row_number() OVER (PARTITION BY target ORDER BY work, s, m, canonical) AS place FROM lit QUALIFY place <= {LIMIT}",
    "win11_compound_fallback": f"""WITH {_ASKS}, {_RANKED}, {_LIT}, w AS (SELECT DISTINCT canonical, work, s, m, unnest(string_split(f, ' ')) AS word FROM doors),
        b AS (SELECT word, count(*) AS names, arg_min(canonical, (work, s, m, canonical)) AS canonical FROM w GROUP BY 1),
        a AS (SELECT DISTINCT target, unnest(string_split(fold, ' ')) AS word FROM asks WHERE target NOT IN (SELECT target FROM lit)),
        o AS (SELECT target, canonical, names, a.word AS word, row_number() OVER (PARTITION BY target, canonical ORDER BY names, a.word) AS r FROM a JOIN b ON a.word = b.word WHERE a.word <> '' AND a.word NOT IN ({_STOP}))
        SELECT target, canonical, word, row_number() OVER (PARTITION BY target ORDER BY names, word) AS place FROM o WHERE r = 1""",
    "sca27_content_runs": f"WITH {_ASKS} SELECT DISTINCT target, run FROM (SELECT target, trim(unnest(string_split(array_to_string(list_transform(string_split(fold, ' '), lambda w: CASE WHEN w IN ({_STOP}) THEN '|' ELSE w END), ' '), '|'))) AS run FROM asks) WHERE run <> ''",
    "sca02_normal_claims": r"SELECT chunk_id, key, count(*) OVER (PARTITION BY key) AS same FROM (SELECT chunk_id, md5(lower(trim(regexp_replace(claim, '[ \t\n\r\f]+', ' ', 'g')))) AS key FROM notes WHERE claim IS NOT NULL)",
    "sca06_unscoped": "SELECT canonical || ' [' || source_id || ']' AS scoped, canonical AS surface, source_id AS source FROM (SELECT DISTINCT canonical, source_id FROM note_names WHERE canonical IS NOT NULL AND source_id IS NOT NULL) WHERE regexp_matches(canonical, '" + LOCATOR + "')",
    "sca29_isbn10": "SELECT valid, count(*) AS numbers, min(n) AS first FROM (SELECT n, list_sum(list_transform(range(1, 11), lambda i: (11 - i) * substr(n, i, 1)::INT)) % 11 = 0 AS valid FROM (SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS n FROM orders)) GROUP BY 1",
    "sca32_dois": r"""SELECT DISTINCT doc_id, regexp_replace(doi, '[.,;:)\]}]+$', '') AS doi FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(10\.[0-9]{4,9}/[^ \t\n\r\f"<>]+)', 1)) AS doi FROM documents WHERE text IS NOT NULL)""",
    "sca51_source_ids": "SELECT source_id, left(regexp_replace(lower(coalesce(title, 'untitled')), '[^a-z0-9]+', '-', 'g'), 40) || '-' || left(sha256(source_id), 12) AS id FROM sources",
    "sca54_sentences": r"SELECT doc_id, len(p) AS sentences, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL AND text <> '')",
    "win23_claim_ids": "SELECT chunk_id, source_id || '#' || row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS claim_id FROM notes WHERE claim IS NOT NULL",
    "win24_citation_index": "SELECT source_id, cited, times, row_number() OVER (PARTITION BY source_id ORDER BY first NULLS LAST, cited) AS number FROM (SELECT source_id, cited, min(chunk_id) AS first, count(*) AS times FROM note_citations WHERE source_id IS NOT NULL AND cited IS NOT NULL GROUP BY 1, 2)",
    "joi09_ids_of_names": "SELECT DISTINCT canonical, chunk_id FROM note_names WHERE canonical IS NOT NULL AND chunk_id IS NOT NULL",
    "joi35_names_of_grounds": "SELECT DISTINCT chunk_id, canonical FROM note_names WHERE chunk_id IN (SELECT chunk_id FROM note_citations WHERE chunk_id IS NOT NULL) AND canonical IN (SELECT canonical FROM names)",
    "joi37_provenance": "SELECT c.source_id, count(*) AS citations, count(*) FILTER (n.chunk_id IS NOT NULL AND s.source_id IS NOT NULL) AS resolved FROM note_citations c LEFT JOIN notes n USING (chunk_id) LEFT JOIN sources s ON s.source_id = c.source_id WHERE c.source_id IS NOT NULL GROUP BY 1",
}
