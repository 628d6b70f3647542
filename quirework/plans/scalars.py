"""Predicates and scalar functions over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.chunking import chunked
from ..operators.skew import pairs_within
from ..session import table

# Words that carry no content in a query, and word lists of routes.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def flt01_abstentions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer of a note is an answer, an abstention or absent."""
    n = table(spark, d, "notes")
    state = lambda c: F.when(F.col(c).isNull(), "absent").when(F.lower(F.trim(c)) == S.ABSTENTION, "abstained").otherwise("answer")
    return n.select("chunk_id", state("claim").alias("claim_state"), state("position").alias("position_state"))


def flt03_stated_position(spark: SparkSession, d: str) -> DataFrame:
    """The first of position and claim that is neither blank nor an abstention."""
    n = table(spark, d, "notes")
    real = lambda c: F.when(F.lower(F.trim(c)) != S.ABSTENTION, F.nullif(F.trim(c), F.lit("")))
    return n.select("chunk_id", F.coalesce(real("position"), real("claim")).alias("stated"))


def flt04_argument_passages(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes")
    return n.filter(F.col("claim").isNotNull() & (F.lower(F.trim("claim")) != S.ABSTENTION) & ~F.col("back_matter") & ~S.no_evidence(F.col("section"))).select("chunk_id", "source_id", "section")


def flt05_evidence_sections(spark: SparkSession, d: str) -> DataFrame:
    n, docs = table(spark, d, "notes"), table(spark, d, "documents")
    s = n.select("section").union(docs.select("section")).filter("section IS NOT NULL").distinct()
    return s.select("section", S.no_evidence(F.col("section")).alias("no_evidence"), S.no_content(F.col("section")).alias("no_content"), S.title(F.col("section")).alias("title"))


def flt08_back_matter_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of neighbouring back-matter notes of a source: gaps and islands over the note order."""
    n = table(spark, d, "notes").select("source_id", "chunk_id", "back_matter")
    w = W.partitionBy("source_id").orderBy("chunk_id")
    runs = n.withColumn("run", F.row_number().over(w) - F.row_number().over(W.partitionBy("source_id", "back_matter").orderBy("chunk_id")))
    return runs.filter("back_matter").groupBy("source_id", "run").agg(F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"), F.count(F.lit(1)).alias("notes")).drop("run")


def flt16_cut_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Which shapes each distinct cited surface or name has."""
    names, c = table(spark, d, "names"), table(spark, d, "note_citations")
    s = names.select(F.col("canonical").alias("surface")).union(c.select("cited")).filter("surface IS NOT NULL").distinct()
    return s.select("surface", *[F.col("surface").rlike(p).alias(k) for k, p in S.CUTS.items()], S.cut_from_names(F.col("surface")).alias("cut"))


def flt17_text_guard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    t = F.col("text")
    return docs.select("doc_id", S.skip_reason(t).alias("reason"), F.round(S.other_share(t), 9).alias("other_share"), F.when(1 - S.other_share(t) < S.LEAST_LETTERS, True).otherwise(False).alias("fragment"))


def flt22_citation_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts with five inverted author names or more."""
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[A-Z][a-z]+,\s+[A-Z]")).alias("authors")).filter("authors >= 5")


def flt24_bibliographic(spark: SparkSession, d: str) -> DataFrame:
    """Cited surfaces with a year within the first 80 characters, and their share per source of the citing note."""
    c = table(spark, d, "note_citations").filter("cited IS NOT NULL AND source_id IS NOT NULL")
    flag = F.substring("cited", 1, 80).rlike(r"\b(1[5-9]|20)[0-9]{2}\b")
    g = c.groupBy("source_id").agg(F.count(F.lit(1)).alias("citations"), F.sum(flag.cast("int")).alias("dated"))
    return g.filter("citations >= 5").withColumn("bibliographic", F.col("dated") * 5 >= F.col("citations") * 4)


def flt27_notes_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Evidence notes of every source, numbered by id."""
    n = table(spark, d, "notes").filter(~F.col("back_matter") & ~S.no_evidence(F.col("section")))
    return n.select("source_id", "chunk_id", F.row_number().over(W.partitionBy("source_id").orderBy("chunk_id")).alias("n"))


def flt28_ids_by_ending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").filter(F.col("chunk_id").endswith("_0001")).select("chunk_id")


def flt29_ids_by_beginning(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").filter(F.col("chunk_id").startswith("b")).select("chunk_id")


def flt32_repaired_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of citing notes without their author, back to the one note that ends in them."""
    c, n = table(spark, d, "note_citations"), table(spark, d, "notes")
    part = lambda x: F.regexp_extract(x, "^[^-]+(-.*)$", 1)
    refs = c.select(part("chunk_id").alias("ref")).filter("ref <> ''").distinct()
    ends = n.select("chunk_id", part("chunk_id").alias("ref")).filter("ref <> ''").distinct()
    return refs.join(ends, "ref").groupBy("ref").agg(F.count(F.lit(1)).alias("k"), F.min("chunk_id").alias("chunk_id")).filter("k = 1").select("ref", "chunk_id")


def flt34_thin_names(spark: SparkSession, d: str) -> DataFrame:
    nn = table(spark, d, "note_names")
    return nn.groupBy("canonical").agg(F.count(F.lit(1)).alias("mentions")).withColumn("thin", F.col("mentions") < 3)


def flt35_capped_sources(spark: SparkSession, d: str) -> DataFrame:
    """Citing notes in first-seen order, without opposing sources and at most three of each other source."""
    c, a = table(spark, d, "note_citations"), table(spark, d, "note_arguing_against")
    foes = a.filter("resolved_canonical = 'sovereignty' AND source_id IS NOT NULL").select("source_id").distinct()
    own = c.filter("source_id IS NOT NULL").select("source_id", "chunk_id").distinct().join(foes, "source_id", "left_anti")
    return own.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("chunk_id"))).filter("n <= 3")


def flt36_unresolved_targets(spark: SparkSession, d: str) -> DataFrame:
    a, names = table(spark, d, "note_arguing_against"), table(spark, d, "names")
    t = a.filter("target IS NOT NULL").groupBy("target").agg(F.max("resolved_canonical").alias("canonical"), F.count(F.lit(1)).alias("n"))
    return t.join(names.select("canonical"), "canonical", "left_anti").select("target", "n")


def flt37_notes_with_opponent(spark: SparkSession, d: str) -> DataFrame:
    n, a = table(spark, d, "notes"), table(spark, d, "note_arguing_against")
    return n.join(a, "chunk_id", "left_semi").select("chunk_id", "source_id")


def sca01_folds(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its fold now and whether the stored one is of an older fold."""
    n = table(spark, d, "names")
    f = S.folded(F.col("canonical"))
    return n.select("canonical", f.alias("fold"), (f != F.col("folded")).alias("stale"))


def sca04_clean_titles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("source_id", F.nullif(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("")).alias("title"))


def sca08_slugs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter("title IS NOT NULL").select("title").distinct()
    return s.select("title", S.slug(F.col("title"), 40).alias("slug"))


def sca10_parsed_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes")
    return n.select("chunk_id", F.regexp_extract("chunk_id", "^(.+)_[0-9]+$", 1).alias("source_part"), F.regexp_extract("chunk_id", "_([0-9]+)$", 1).cast("int").alias("number"), S.year_of(F.col("source_id")).alias("year"))


def sca11_years(spark: SparkSession, d: str) -> DataFrame:
    """The year in the id, in the free-text date and in the table, and whether they agree."""
    s = table(spark, d, "sources")
    dated = F.nullif(F.regexp_extract("date", "(1[5-9][0-9]{2}|20[0-9]{2})", 1), F.lit("")).cast("int")
    return s.select("source_id", S.year_of(F.col("source_id")).alias("id_year"), dated.alias("date_year"), "year", (S.year_of(F.col("source_id")) == F.col("year")).alias("agrees"))


def sca12_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, lines and paragraphs per text."""
    t = table(spark, d, "documents")
    n = lambda p: F.size(F.filter(F.split("text", p), lambda x: F.trim(x) != ""))
    return t.filter("text IS NOT NULL").select("doc_id", n(r"(?<=[.!?])\s+").alias("sentences"), n("\n").alias("lines"), n("\n\n").alias("paragraphs"))


def sca19_passages(spark: SparkSession, d: str) -> DataFrame:
    """Texts in passages of 3 500 to 9 000 characters: number and length of each."""
    return chunked(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "n", F.length("text").alias("length"))


def sca20_normal_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts without soft hyphens and detached marks, spaces collapsed: the length and a hash of what is left."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("­"), F.lit("")), r"\p{Sk}", ""), r"[ \t\r\n]+", " "))
    return t.select("doc_id", F.length(clean).alias("length"), F.md5(clean).alias("hash"))


def sca26_content_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of a title that carry content, in order."""
    s = table(spark, d, "sources").filter("title IS NOT NULL").select("title").distinct()
    words = F.filter(F.split(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return s.select("title", F.array_join(words, " ").alias("words"))


def sca30_isbn13(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen digits made from a source's hash: whether they happen to be a valid number."""
    s = table(spark, d, "sources")
    digits = F.rpad(F.concat(F.lit("978"), F.regexp_replace("source_id", "[^0-9]", "")), 13, "0")
    return s.select("source_id", digits.alias("digits"), S.isbn13(digits).alias("valid"))


def sca34_author_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sources of one year whose authors share a word of three letters or more."""
    s = table(spark, d, "sources").filter("author IS NOT NULL AND year IS NOT NULL")
    w = s.select("source_id", "year", F.explode(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("author"), r"[^\p{L}]+", " "), " "), lambda x: F.length(x) >= 3))).alias("word"))
    return pairs_within(w.select(F.struct("year", "word").alias("k"), F.col("source_id").alias("i")).distinct()).select(F.col("a").alias("source_a"), F.col("b").alias("source_b")).distinct()


def sca37_clean_authors(spark: SparkSession, d: str) -> DataFrame:
    """`Surname, Forename` turned round; several authors by semicolon."""
    s = table(spark, d, "sources").filter("author IS NOT NULL")
    turned = F.transform(F.split("author", r"\s*;\s*"), lambda a: F.when(a.contains(","), F.concat_ws(" ", F.trim(F.regexp_replace(a, "^[^,]*,", "")), F.trim(F.regexp_replace(a, ",.*$", "")))).otherwise(F.trim(a)))
    return s.select("source_id", F.array_join(turned, "; ").alias("author"), F.size(turned).alias("authors"))


def sca39_citations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("source_id", F.concat_ws(". ", F.coalesce("author", F.lit("Unknown")), F.concat(F.lit("("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(")")), F.coalesce("title", F.lit("Untitled"))).alias("line"))


def sca44_truncated_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims cut at the last blank within 80 characters, where that lies past half of them."""
    n = table(spark, d, "notes").filter("claim IS NOT NULL")
    head = F.substring("claim", 1, 80)
    whole = F.regexp_replace(head, " [^ ]*$", "")
    return n.select("chunk_id", F.when(F.length("claim") <= 80, F.col("claim")).when(head.contains(" ") & (F.length(whole) > 40), whole).otherwise(head).alias("claim"))


def sca50_content_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys by content: of a claim, and of the set of notes of a source."""
    n = table(spark, d, "notes")
    return n.filter("claim IS NOT NULL").select("chunk_id", F.substring(F.sha2(F.concat_ws("\n", "source_id", "claim"), 256), 1, 16).alias("claim_key"))


def sca55_shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct eight-word shingles per text."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    # words are hashed once; a shingle is the hash of a window of these
    t = t.select("doc_id", F.transform(w, lambda x: F.xxhash64(x)).alias("h"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for seq in pdf.h:
                h = np.asarray(seq, np.int64).view(np.uint64)
                z = np.zeros(max(len(h) - 7, 0), np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(8 if len(z) else 0):
                        z = (z ^ h[i : i + len(z)]) * np.uint64(0x9E3779B97F4A7C15)
                        z ^= z >> np.uint64(29)
                out.append(len(np.unique(z)))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "shingles": np.array(out, np.int32)})

    return t.mapInPandas(counted, "doc_id bigint, shingles int")


def sca56_durations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_log").select("duration_sec").filter("duration_sec IS NOT NULL").distinct()
    return r.select("duration_sec", S.duration(F.col("duration_sec") * 60).alias("as_minutes"))


def sca57_quota_windows(spark: SparkSession, d: str) -> DataFrame:
    """Start of day and month of each log row, and the next resets."""
    r = table(spark, d, "run_log").select("logged_at").distinct()
    day, month = F.date_trunc("DAY", "logged_at"), F.date_trunc("MONTH", "logged_at")
    return r.select("logged_at", day.alias("day"), month.alias("month"), (day + F.expr("INTERVAL 1 DAY")).alias("next_day"), F.expr("date_trunc('MONTH', logged_at) + INTERVAL 1 MONTH").alias("next_month"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("flt", "sca") and getattr(v, "__module__", "") == __name__}

_TITLE = r"trim(regexp_replace(lower(coalesce(section, '')), '\s+', ' ', 'g'), ' .:-–—')"


def _words(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _told(t: str) -> str:
    bare = f"regexp_replace({t}, '^[ivxlcdm]+\\.?\\s+', '')"
    return f"({t} IN ({_words(S.NO_CONTENT + S.NO_EVIDENCE)}) OR regexp_matches({t}, '^(appendix|annex|notes? to page)') OR ({bare} <> {t} AND {bare} IN ({_words(S.AFTER_ORDINAL)})) OR regexp_matches({t}, '({'|'.join(S.ENDINGS)})$'))"


_NO_EV = f"({_told(_TITLE)} OR {_told(f'''regexp_replace({_TITLE}, '^([0-9]+\\s+)+', '')''')})"
_FOLD = r"regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(canonical, '[-‐‑‒–—]', ' ', 'g'), '[^\p{L}\p{N}\p{M}_\s]|\p{Lm}', '', 'g'), '[\s\x{00A0}]+', ' ', 'g'))), 'aa+', 'a', 'g')"
_OTHER = r"(1.0 - length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::DOUBLE)"
_CUTS = ", ".join(f"regexp_matches(surface, '{p}') AS {k}" for k, p in S.CUTS.items())
_ANY = " OR ".join(f"regexp_matches(surface, '{p}')" for p in S.CUTS.values())
_ABS = f"'{S.ABSTENTION}'"

SQL = {
    "flt01_abstentions": f"SELECT chunk_id, CASE WHEN claim IS NULL THEN 'absent' WHEN lower(trim(claim)) = {_ABS} THEN 'abstained' ELSE 'answer' END AS claim_state, CASE WHEN position IS NULL THEN 'absent' WHEN lower(trim(position)) = {_ABS} THEN 'abstained' ELSE 'answer' END AS position_state FROM notes",
    "flt03_stated_position": f"SELECT chunk_id, coalesce(CASE WHEN lower(trim(position)) <> {_ABS} THEN nullif(trim(position), '') END, CASE WHEN lower(trim(claim)) <> {_ABS} THEN nullif(trim(claim), '') END) AS stated FROM notes",
    "flt04_argument_passages": f"SELECT chunk_id, source_id, section FROM notes WHERE claim IS NOT NULL AND lower(trim(claim)) <> {_ABS} AND NOT back_matter AND NOT {_NO_EV}",
    "flt05_evidence_sections": f"SELECT section, {_NO_EV} AS no_evidence, {_TITLE} IN ({_words(S.NO_CONTENT)}) AS no_content, {_TITLE} AS title FROM (SELECT section FROM notes UNION SELECT section FROM documents) WHERE section IS NOT NULL",
    "flt08_back_matter_runs": "SELECT source_id, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) - row_number() OVER (PARTITION BY source_id, back_matter ORDER BY chunk_id) AS run FROM notes) WHERE back_matter GROUP BY source_id, run",
    "flt16_cut_surfaces": f"SELECT surface, {_CUTS}, (lower(trim(surface)) = {_ABS} OR {_ANY}) AS cut FROM (SELECT canonical AS surface FROM names UNION SELECT cited FROM note_citations) WHERE surface IS NOT NULL",
    "flt17_text_guard": f"SELECT doc_id, CASE WHEN length(text) > {S.MOST_CHARS} THEN 'size' WHEN length(text) > 0 AND {_OTHER} > {S.MOST_OTHER} THEN 'letters' END AS reason, CASE WHEN length(text) > 0 THEN round({_OTHER}, 9) END AS other_share, coalesce(length(text) > 0 AND 1 - {_OTHER} < {S.LEAST_LETTERS}, false) AS fragment FROM documents",
    "flt22_citation_blocks": r"SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+,\s+[A-Z]')) AS authors FROM documents WHERE len(regexp_extract_all(text, '[A-Z][a-z]+,\s+[A-Z]')) >= 5",
    "flt24_bibliographic": r"SELECT source_id, count(*) AS citations, count(*) FILTER (regexp_matches(left(cited, 80), '\b(1[5-9]|20)[0-9]{2}\b')) AS dated, count(*) FILTER (regexp_matches(left(cited, 80), '\b(1[5-9]|20)[0-9]{2}\b')) * 5 >= count(*) * 4 AS bibliographic FROM note_citations WHERE cited IS NOT NULL AND source_id IS NOT NULL GROUP BY source_id HAVING count(*) >= 5",
    "flt27_notes_by_source": f"SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS n FROM notes WHERE NOT back_matter AND NOT {_NO_EV}",
    "flt28_ids_by_ending": "SELECT chunk_id FROM notes WHERE ends_with(chunk_id, '_0001')",
    "flt29_ids_by_beginning": "SELECT chunk_id FROM notes WHERE starts_with(chunk_id, 'b')",
    "flt32_repaired_ids": "WITH r AS (SELECT DISTINCT regexp_extract(chunk_id, '^[^-]+(-.*)$', 1) AS ref FROM note_citations), e AS (SELECT DISTINCT chunk_id, regexp_extract(chunk_id, '^[^-]+(-.*)$', 1) AS ref FROM notes) SELECT ref, min(chunk_id) AS chunk_id FROM r JOIN e USING (ref) WHERE ref <> '' GROUP BY ref HAVING count(*) = 1",
    "flt34_thin_names": "SELECT canonical, count(*) AS mentions, count(*) < 3 AS thin FROM note_names GROUP BY canonical",
    "flt35_capped_sources": "SELECT * FROM (SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS n FROM (SELECT DISTINCT source_id, chunk_id FROM note_citations WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM note_arguing_against WHERE resolved_canonical = 'sovereignty' AND source_id IS NOT NULL))) WHERE n <= 3",
    "flt36_unresolved_targets": "SELECT target, n FROM (SELECT target, max(resolved_canonical) AS c, count(*) AS n FROM note_arguing_against WHERE target IS NOT NULL GROUP BY target) WHERE c IS NULL OR c NOT IN (SELECT canonical FROM names WHERE canonical IS NOT NULL)",
    "flt37_notes_with_opponent": "SELECT chunk_id, source_id FROM notes WHERE chunk_id IN (SELECT chunk_id FROM note_arguing_against)",
    "sca01_folds": f"SELECT canonical, {_FOLD} AS fold, {_FOLD} <> folded AS stale FROM names",
    "sca04_clean_titles": r"SELECT source_id, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS title FROM sources",
    "sca08_slugs": "WITH s AS (SELECT DISTINCT title, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM sources WHERE title IS NOT NULL) SELECT title, coalesce(nullif(CASE WHEN length(s) > 40 THEN rtrim(CASE WHEN instr(left(s, 40), '-') > 1 THEN regexp_replace(left(s, 40), '-[^-]*$', '') ELSE left(s, 40) END, '-') ELSE s END, ''), 'section') AS slug FROM s",
    "sca10_parsed_ids": "SELECT chunk_id, regexp_extract(chunk_id, '^(.+)_[0-9]+$', 1) AS source_part, regexp_extract(chunk_id, '_([0-9]+)$', 1)::INT AS number, list_filter(string_split(source_id, '-'), lambda x: regexp_matches(x, '^[0-9]{4}$'))[-1]::INT AS year FROM notes",
    "sca11_years": "WITH s AS (SELECT source_id, list_filter(string_split(source_id, '-'), lambda x: regexp_matches(x, '^[0-9]{4}$'))[-1]::INT AS id_year, nullif(regexp_extract(date, '(1[5-9][0-9]{2}|20[0-9]{2})', 1), '')::INT AS date_year, year FROM sources) SELECT *, id_year = year AS agrees FROM s",
    "sca20_normal_text": r"SELECT doc_id, length(c) AS length, md5(c) AS hash FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(173), ''), '\p{Sk}', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS c FROM documents WHERE text IS NOT NULL)",
    "sca26_content_words": f"SELECT DISTINCT title, array_to_string(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({_words(STOP_WORDS)})), ' ') AS words FROM sources WHERE title IS NOT NULL",
    "sca30_isbn13": r"WITH s AS (SELECT source_id, rpad('978' || regexp_replace(source_id, '[^0-9]', '', 'g'), 13, '0') AS digits FROM sources) SELECT source_id, digits, NOT regexp_matches(digits, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AND list_sum(list_transform(range(1, 14), lambda i: substring(digits, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS valid FROM s",
    "sca34_author_overlap": r"WITH w AS (SELECT DISTINCT source_id, year, unnest(list_filter(string_split(regexp_replace(lower(author), '[^\p{L}]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS word FROM sources WHERE author IS NOT NULL AND year IS NOT NULL) SELECT DISTINCT a.source_id AS source_a, b.source_id AS source_b FROM w a JOIN w b ON a.year = b.year AND a.word = b.word AND a.source_id < b.source_id",
    "sca37_clean_authors": r"SELECT source_id, array_to_string(list_transform(regexp_split_to_array(author, '\s*;\s*'), lambda a: CASE WHEN contains(a, ',') THEN concat_ws(' ', trim(regexp_replace(a, '^[^,]*,', '')), trim(regexp_replace(a, ',.*$', ''))) ELSE trim(a) END), '; ') AS author, len(regexp_split_to_array(author, '\s*;\s*')) AS authors FROM sources WHERE author IS NOT NULL",
    "sca39_citations": "SELECT source_id, concat_ws('. ', coalesce(author, 'Unknown'), '(' || coalesce(year::VARCHAR, 'n.d.') || ')', coalesce(title, 'Untitled')) AS line FROM sources",
    "sca44_truncated_claims": "SELECT chunk_id, CASE WHEN length(claim) <= 80 THEN claim WHEN contains(left(claim, 80), ' ') AND length(regexp_replace(left(claim, 80), ' [^ ]*$', '')) > 40 THEN regexp_replace(left(claim, 80), ' [^ ]*$', '') ELSE left(claim, 80) END AS claim FROM notes WHERE claim IS NOT NULL",
    "sca50_content_keys": "SELECT chunk_id, left(sha256(concat_ws(chr(10), source_id, claim)), 16) AS claim_key FROM notes WHERE claim IS NOT NULL",
    "sca55_shingle_counts": "WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(w) >= 8 THEN len(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) ELSE 0 END AS shingles FROM t",
    "sca56_durations": "WITH s AS (SELECT DISTINCT duration_sec, duration_sec * 60 AS s FROM run_log WHERE duration_sec IS NOT NULL) SELECT duration_sec, CASE WHEN s >= 3600 THEN printf('%dh %02dm', floor(floor(s) / 3600)::BIGINT, (floor(floor(s) / 60)::BIGINT % 60)) WHEN s >= 60 THEN printf('%dm %02ds', floor(floor(s) / 60)::BIGINT, floor(s)::BIGINT % 60) ELSE printf('%.1fs', s) END AS as_minutes FROM s",
    "sca57_quota_windows": "SELECT DISTINCT logged_at, date_trunc('day', logged_at)::TIMESTAMP AS day, date_trunc('month', logged_at)::TIMESTAMP AS month, date_trunc('day', logged_at) + INTERVAL 1 DAY AS next_day, date_trunc('month', logged_at) + INTERVAL 1 MONTH AS next_month FROM run_log",
    "sca12_sentences": r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentences, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '')) AS paragraphs FROM documents WHERE text IS NOT NULL",
}
