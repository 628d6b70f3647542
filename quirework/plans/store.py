"""Queries over the store tables: joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shapes import ABSTENTION, folded
from ..operators import relations as R
from ..operators.ordered import covering, last_of_each, rotate
from ..session import cut, table

ABOUT, OTHER = "sovereignty", "nationalism"


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def joi01_name_members(spark: SparkSession, d: str) -> DataFrame:
    nn, n, s = _t(spark, d, "note_names", "notes", "sources")
    return R.members(nn, n, s)


def joi02_doors(spark: SparkSession, d: str) -> DataFrame:
    return R.doors(*_t(spark, d, "names", "note_names", "notes"))


def joi03_concept_sources(spark: SparkSession, d: str) -> DataFrame:
    return R.concept_sources(*_t(spark, d, "note_names", "notes", "sources"))


def joi04_note_locators(spark: SparkSession, d: str) -> DataFrame:
    n, s = _t(spark, d, "notes", "sources")
    return n.join(s, "source_id", "left").select("chunk_id", "source_id", "author", "title", "date", "section", "chapter")


def joi06_find_notes(spark: SparkSession, d: str) -> DataFrame:
    nn, n, s, a = _t(spark, d, "note_names", "notes", "sources", "note_arguing_against")
    return R.find_notes(ABOUT, nn, n, s, a, opposing=OTHER, after=1950, before=2016, limit=20).select("chunk_id", "source_id", "author", "year", "claim", "position", "turn", "total")


def joi07_names_arguing_against(spark: SparkSession, d: str) -> DataFrame:
    return R.against_names(*_t(spark, d, "note_arguing_against", "note_names"))


def joi08_opposition_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.opposition_pairs(*_t(spark, d, "note_arguing_against", "note_names", "notes"), canonical=OTHER)


def joi08_opposition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return R.opposition_sizes(*_t(spark, d, "note_arguing_against", "note_names", "notes"))


def joi10_resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Cited surfaces to names: exact, else by fold, else verbatim; of several names with a fold the least."""
    c, names = _t(spark, d, "note_citations", "names")
    surfaces = c.filter("cited IS NOT NULL").select(F.col("cited").alias("surface")).distinct().withColumn("fold", folded(F.col("surface")))
    exact = names.select(F.col("canonical").alias("surface"), F.col("canonical").alias("exact")).distinct()
    by_fold = names.withColumn("fold", folded(F.col("canonical"))).groupBy("fold").agg(F.min("canonical").alias("near"))
    out = surfaces.join(exact, "surface", "left").join(by_fold, "fold", "left")
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "fold")
    return out.select("surface", F.coalesce("exact", "near", "surface").alias("canonical"), tier.alias("tier"))


def joi12_where_names_meet(spark: SparkSession, d: str) -> DataFrame:
    met = R.meet(table(spark, d, "note_names"), ABOUT, OTHER).withColumn("k", F.lit(1))
    return rotate(met, ["k"], "source_id", ["chunk_id"]).select("chunk_id", "source_id", "turn")


def joi13_who_cites(spark: SparkSession, d: str) -> DataFrame:
    """(canonical, chunk_id, source_id, cited, stance): citations whose surface folds to a name."""
    c, names = _t(spark, d, "note_citations", "names")
    key = names.select("canonical", folded(F.col("canonical")).alias("fold")).distinct()
    return c.withColumn("fold", folded(F.col("cited"))).join(key, "fold").select("canonical", "chunk_id", "source_id", "cited", F.lower("stance").alias("stance")).distinct()


def joi14_who_argues_against(spark: SparkSession, d: str) -> DataFrame:
    a, n = _t(spark, d, "note_arguing_against", "notes")
    return a.filter("resolved_canonical IS NOT NULL").join(n.select("chunk_id", "position"), "chunk_id", "left").select("resolved_canonical", "chunk_id", "source_id", "target", "position").distinct()


def joi18_targets_by_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Targets to every name whose fold of two words or more stands in them as words."""
    a, names = _t(spark, d, "note_arguing_against", "names")
    phrases = names.select("canonical", folded(F.col("canonical")).alias("gram")).filter("gram LIKE '% %'").distinct()
    longest = phrases.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 2
    targets = a.filter("target IS NOT NULL").select("target").distinct().withColumn("fold", folded(F.col("target")))
    return R.word_grams(targets, "fold", 2, longest).select("target", "gram").join(phrases, "gram").select("target", "canonical").distinct()


def joi26_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Ids in derived tables that no live table holds."""
    nn, n, names, s = _t(spark, d, "note_names", "notes", "names", "sources")
    chunk = nn.select(F.col("chunk_id").alias("id")).distinct().join(n.select(F.col("chunk_id").alias("id")), "id", "left_anti").withColumn("kind", F.lit("chunk"))
    name = nn.select(F.col("canonical").alias("id")).distinct().join(names.select(F.col("canonical").alias("id")), "id", "left_anti").withColumn("kind", F.lit("name"))
    source = nn.filter("source_id IS NOT NULL").select(F.col("source_id").alias("id")).distinct().join(s.select(F.col("source_id").alias("id")), "id", "left_anti").withColumn("kind", F.lit("source"))
    return chunk.unionByName(name).unionByName(source).select("kind", "id")


def joi27_source_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Mentions without a source to the longest known source id that their chunk id begins with."""
    nn, s = _t(spark, d, "note_names", "sources")
    lost = nn.filter("source_id IS NULL").select("chunk_id").distinct()
    heads = lost.withColumn("source_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("chunk_id")), lambda i: F.substring("chunk_id", F.lit(1), i))))
    return heads.join(s.select("source_id"), "source_id", "left_semi").groupBy("chunk_id").agg(F.max_by("source_id", F.length("source_id")).alias("source_id"))


def joi28_kind_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Full outer check of the names' kinds against the most frequent label of their mentions."""
    names, nn = _t(spark, d, "names", "note_names")
    said = nn.filter("kind IS NOT NULL").groupBy("canonical", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("canonical").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("said"))
    both = names.select("canonical", "kind").join(said, "canonical", "full")
    why = F.when(F.col("kind").isNull() & F.col("said").isNull(), "none").when(F.col("kind").isNull(), "no kind").when(F.col("said").isNull(), "no mention").when(F.col("kind") != F.col("said"), "differ")
    return both.select("canonical", "kind", "said", why.alias("why")).filter("why IS NOT NULL")


def joi31_unlabelled_names(spark: SparkSession, d: str) -> DataFrame:
    names, nn = _t(spark, d, "names", "note_names")
    counts = nn.groupBy("canonical").agg(F.count(F.lit(1)).alias("mentions"))
    return names.filter("kind IS NULL").join(counts, "canonical", "left").select("canonical", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def joi41_ids_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Documents' source ids to sources by the shared twelve hex digits; hashes of one source only."""
    docs, s = _t(spark, d, "documents", "sources")
    key = F.regexp_extract("source_id", "-([0-9a-f]{12})$", 1)
    mine = docs.filter("source_id IS NOT NULL").select("source_id", key.alias("hash")).filter("hash <> ''").groupBy("source_id", "hash").agg(F.count(F.lit(1)).alias("documents"))
    theirs = s.select(F.col("source_id").alias("known_id"), key.alias("hash")).filter("hash <> ''").distinct()
    one = theirs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("known_id").alias("known_id")).filter("n = 1").drop("n")
    return mine.join(one, "hash").select("source_id", "known_id", "documents")


def agg01_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Names with mentions, distinct notes and their most frequent kind (ties: least)."""
    nn = table(spark, d, "note_names")
    part = nn.groupBy("canonical", "kind").agg(F.count(F.lit(1)).alias("n"))
    kind = part.filter("kind IS NOT NULL").groupBy("canonical").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"))
    notes = nn.groupBy("canonical", "chunk_id").agg(F.count(F.lit(1)).alias("n")).groupBy("canonical").agg(F.sum("n").alias("count"), F.count("chunk_id").alias("notes"))
    return notes.join(kind, "canonical", "left").select("canonical", "kind", "count", "notes")


def agg05_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Notes per name, back matter too, with the band: thin below 20, moderate below 100, dense."""
    nn = table(spark, d, "note_names")
    c = nn.groupBy("canonical", "chunk_id").agg(F.lit(1).alias("x")).groupBy("canonical").agg(F.count("chunk_id").alias("note_count"))
    return c.withColumn("band", F.when(F.col("note_count") < 20, "thin").when(F.col("note_count") < 100, "moderate").otherwise("dense"))


def agg06_bands(spark: SparkSession, d: str) -> DataFrame:
    return agg05_coverage(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("names"), F.sum("note_count").alias("notes"))


def agg11_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Per source: the lower median of its names' bands weighted by its notes, capped at medium where any is thin."""
    nn = table(spark, d, "note_names").filter("source_id IS NOT NULL")
    ranks = agg05_coverage(spark, d).select("canonical", F.when(F.col("band") == "thin", 0).when(F.col("band") == "moderate", 1).otherwise(2).alias("rank"))
    mine = nn.groupBy("source_id", "canonical").agg(F.count_distinct("chunk_id").alias("w")).join(ranks, "canonical").groupBy("source_id", "rank").agg(F.sum("w").alias("w"))
    run = mine.withColumn("run", F.sum("w").over(W.partitionBy("source_id").orderBy("rank"))).withColumn("all", F.sum("w").over(W.partitionBy("source_id"))).withColumn("least", F.min("rank").over(W.partitionBy("source_id")))
    mid = run.filter("2 * run >= all").groupBy("source_id").agg(F.min("rank").alias("m"), F.first("least").alias("least"))
    level = F.when(F.col("least") == 0, F.least("m", F.lit(1))).otherwise(F.col("m"))
    return mid.select("source_id", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1).alias("confidence"))


def agg25_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Per name: the share of its largest source and the sum of squared shares."""
    m = R.concept_sources(*_t(spark, d, "note_names", "notes", "sources"))
    s = m.withColumn("share", F.col("note_count") / F.sum("note_count").over(W.partitionBy("canonical")))
    return s.groupBy("canonical").agg(F.round(F.max("share"), 9).alias("top_share"), F.round(F.sum(F.col("share") * F.col("share")), 9).alias("hhi"))


def agg34_source_usage(spark: SparkSession, d: str) -> DataFrame:
    """Per source: its share of citing notes over its share of all notes; null where it has no note."""
    n, c = _t(spark, d, "notes", "note_citations")
    have = n.filter("NOT back_matter").groupBy("source_id").agg(F.count(F.lit(1)).alias("available"))
    used = c.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.count_distinct("chunk_id").alias("evidence"))
    both = have.join(used, "source_id", "full").fillna(0, ["available", "evidence"])
    a, e = both.agg(F.sum("available").alias("a")).scalar(), both.agg(F.sum("evidence").alias("e")).scalar()
    share = F.try_divide(F.col("evidence") * a, e * F.col("available"))
    return both.select("source_id", "available", "evidence", F.round(share, 9).alias("usage"))


def agg62_section_index(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").filter("section IS NOT NULL AND position IS NOT NULL").filter(F.lower(F.trim("position")) != ABSTENTION)
    return n.groupBy("section").agg(F.count_distinct("position").alias("positions"), F.count(F.lit(1)).alias("notes"))


def agg74_question_measure(spark: SparkSession, d: str) -> DataFrame:
    """Per name of at least 20 notes: notes, sources and the share of the largest source."""
    m = R.concept_sources(*_t(spark, d, "note_names", "notes", "sources"))
    out = m.groupBy("canonical").agg(F.sum("note_count").alias("notes"), F.count("source_id").alias("sources"), F.max("note_count").alias("top"))
    return out.filter("notes >= 20").select("canonical", "notes", "sources", F.round(F.col("top") / F.col("notes"), 9).alias("top_share"))


def agg80_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "note_names").groupBy("kind").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("canonical").alias("names"))


def win01_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Every name's notes in rotation over sources, the covering window of 10."""
    nn = table(spark, d, "note_names").filter("canonical IS NOT NULL")
    m = nn.groupBy("canonical", "chunk_id").agg(F.max("source_id").alias("source_id"))
    turned = rotate(m, ["canonical"], "source_id", ["chunk_id"])
    return covering(turned, ["canonical"], "source_id", 10).select("canonical", "chunk_id", "source_id", "turn")


def win09_rank_doors(spark: SparkSession, d: str) -> DataFrame:
    """Names by kind: works last, then sources, then notes, then the name."""
    doors = R.doors(*_t(spark, d, "names", "note_names", "notes"))
    w = W.partitionBy(F.substring("canonical", 1, 1)).orderBy(F.coalesce(F.col("kind") == "work", F.lit(False)), F.desc("source_count"), F.desc("member_count"), "canonical")
    return doors.withColumn("place", F.row_number().over(w)).filter("place <= 10").select("canonical", "source_count", "member_count", "place")


def win13_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Names that meet one name, by common notes times ln(notes / notes with the neighbour)."""
    nn = table(spark, d, "note_names").select("chunk_id", "canonical").dropna().distinct()
    n = nn.select("chunk_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    mine = nn.filter(F.col("canonical") == ABOUT).select("chunk_id")
    near = nn.filter(F.col("canonical") != ABOUT).join(mine, "chunk_id", "left_semi").groupBy("canonical").agg(F.count(F.lit(1)).alias("both"))
    df = nn.groupBy("canonical").agg(F.count(F.lit(1)).alias("df"))
    score = F.col("both") * F.log(F.lit(1.0) * n.scalar() / F.greatest("df", F.lit(1)))
    return near.join(df, "canonical").select("canonical", "both", "df", F.round(score, 6).alias("score"))


def win20_latest_target(spark: SparkSession, d: str) -> DataFrame:
    """Per note the last resolved target by text, else the last target."""
    a = table(spark, d, "note_arguing_against")
    return a.groupBy("chunk_id").agg(F.coalesce(F.max_by("target", F.when(F.col("resolved_canonical").isNotNull(), F.col("target"))), F.max("target")).alias("target"))


def win21_position_ids(spark: SparkSession, d: str) -> DataFrame:
    """Positions with stable ids by size, then text; ids come from ranks inside sizes, not from one global sort."""
    n = table(spark, d, "notes").filter("position IS NOT NULL").filter(F.lower(F.trim("position")) != ABSTENTION)
    p = cut(n.groupBy("position").agg(F.count(F.lit(1)).alias("size")))
    sizes = p.groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    # distinct sizes are few (at most the root of twice the notes): one ordered pass over them
    ahead = sizes.select("size", F.coalesce(F.sum("k").over(W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    # ranks inside a size: by text, in ranges of its hash-free prefix, so a size shared by most positions is split
    head = F.substring("position", 1, 12)
    heads = p.groupBy("size", head.alias("head")).agg(F.count(F.lit(1)).alias("k")).withColumn("skip", F.sum("k").over(W.partitionBy("size").orderBy("head").rowsBetween(W.unboundedPreceding, -1)))
    ranked = p.withColumn("head", head).withColumn("r", F.row_number().over(W.partitionBy("size", "head").orderBy("position"))).join(heads.select("size", "head", "skip"), ["size", "head"]).join(ahead, "size")
    n = F.col("ahead") + F.coalesce("skip", F.lit(0)) + F.col("r")
    return ranked.select(F.format_string("pos-%07d", n).alias("position_id"), "position", "size")


def set01_first_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Each name's first note by id, as an order-keeping dedupe."""
    return table(spark, d, "note_names").filter("canonical IS NOT NULL").groupBy("canonical").agg(F.min("chunk_id").alias("first_chunk"))


def set02_reached_names(spark: SparkSession, d: str) -> DataFrame:
    """Names reached by mention, by opposition, or both."""
    nn, a = _t(spark, d, "note_names", "note_arguing_against")
    m = nn.select("canonical").distinct().withColumn("m", F.lit(1))
    o = a.filter("resolved_canonical IS NOT NULL").select(F.col("resolved_canonical").alias("canonical")).distinct().withColumn("o", F.lit(1))
    both = m.join(o, "canonical", "full")
    return both.select("canonical", F.when(F.col("m").isNull(), "opposition").when(F.col("o").isNull(), "mention").otherwise("both").alias("reached"))


def set06_cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a citation."""
    s, c = _t(spark, d, "sources", "note_citations")
    return s.join(c, "source_id", "left_semi").select("source_id", "title")


def set07_fold_groups(spark: SparkSession, d: str) -> DataFrame:
    """Spellings equal after folding, where there are several."""
    names, nn = _t(spark, d, "names", "note_names")
    s = names.select("canonical").union(nn.select("canonical")).filter("canonical IS NOT NULL").distinct()
    g = s.withColumn("fold", folded(F.col("canonical"))).groupBy("fold").agg(F.count(F.lit(1)).alias("spellings"), F.array_join(F.array_sort(F.collect_list("canonical")), "|").alias("members"))
    return g.filter("spellings > 1 AND fold <> ''")


def top09_elected_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Of each fold the spelling with the most mentions (ties: least)."""
    nn = table(spark, d, "note_names").filter("canonical IS NOT NULL")
    c = nn.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", folded(F.col("canonical")))
    return c.groupBy("fold").agg(F.min_by("canonical", F.struct(-F.col("n"), F.col("canonical"))).alias("elected"), F.sum("n").alias("mentions"))


def top10_elected_kind(spark: SparkSession, d: str) -> DataFrame:
    nn = table(spark, d, "note_names").filter("canonical IS NOT NULL AND kind IS NOT NULL").withColumn("fold", folded(F.col("canonical")))
    c = nn.groupBy("fold", "kind").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("fold").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"))


def vec16_components(spark: SparkSession, d: str) -> DataFrame:
    """Names joined by opposition inside a note: the connected components, root the least name."""
    a, nn = _t(spark, d, "note_arguing_against", "note_names")
    e = a.filter("resolved_canonical IS NOT NULL").join(nn.filter("kind = 'person'").select("chunk_id", "canonical"), "chunk_id").filter("canonical <> resolved_canonical")
    return R.components(e.select(F.col("resolved_canonical").alias("a"), F.col("canonical").alias("b")).distinct(), cut)


def vec20_initial_forenames(spark: SparkSession, d: str) -> DataFrame:
    """`X. Surname` to the one full name of that surname and initial; refused where there are several."""
    n = table(spark, d, "names").filter("kind = 'person'").select("canonical").distinct()
    short = n.select(F.col("canonical").alias("short"), F.regexp_extract("canonical", r"^([A-Z])\.? ([A-Z][a-z]+)$", 1).alias("i"), F.regexp_extract("canonical", r"^([A-Z])\.? ([A-Z][a-z]+)$", 2).alias("s")).filter("s <> ''")
    full = n.select(F.col("canonical").alias("full"), F.regexp_extract("canonical", r"^([A-Z])[a-z]+ ([A-Z][a-z]+)$", 1).alias("i"), F.regexp_extract("canonical", r"^([A-Z])[a-z]+ ([A-Z][a-z]+)$", 2).alias("s")).filter("s <> ''")
    return short.join(full, ["i", "s"]).groupBy("short").agg(F.count(F.lit(1)).alias("k"), F.min("full").alias("full")).filter("k = 1").select("short", "full")


def vec22_acronyms(spark: SparkSession, d: str) -> DataFrame:
    """`Name (ABC)` carriers of an acronym, with how many names carry it."""
    n = table(spark, d, "names").select("canonical", F.regexp_extract("canonical", r"^(.+) \(([A-Z]{2,6})\)$", 2).alias("acronym"), F.regexp_extract("canonical", r"^(.+) \(([A-Z]{2,6})\)$", 1).alias("body")).filter("acronym <> ''").distinct()
    return n.withColumn("carriers", F.count(F.lit(1)).over(W.partitionBy("acronym")))


def src23_last_decision(spark: SparkSession, d: str) -> DataFrame:
    """The last run of each source and pass by arrival; later rows of the log win."""
    r = table(spark, d, "run_log").dropDuplicates()
    return last_of_each(r.select("source_id", "pass_name", "arrived_at", "logged_at", "status", "tokens"), ["source_id", "pass_name"], ["arrived_at", "logged_at", "status", "tokens"]).select("source_id", "pass_name", "status", "arrived_at")


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("joi", "agg", "win", "set", "top", "vec", "src") and getattr(v, "__module__", "") == __name__}

_FOLD = r"regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '[-‐‑‒–—]', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_\s]|\p{{Lm}}', '', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))), 'aa+', 'a', 'g')"
_EV = "JOIN notes n ON n.chunk_id = nn.chunk_id AND NOT n.back_matter"
_MEMBERS = f"SELECT DISTINCT nn.canonical, n.chunk_id, n.source_id FROM note_names nn {_EV}"
_CONCEPT = f"SELECT canonical, m.source_id, s.author, s.year, count(*) AS note_count FROM ({_MEMBERS}) m LEFT JOIN sources s USING (source_id) GROUP BY ALL"
_COVER = "SELECT canonical, count(DISTINCT chunk_id) AS note_count, CASE WHEN count(DISTINCT chunk_id) < 20 THEN 'thin' WHEN count(DISTINCT chunk_id) < 100 THEN 'moderate' ELSE 'dense' END AS band FROM note_names GROUP BY canonical"
_DOORS = "SELECT a.canonical, a.kind, count(DISTINCT n.chunk_id) AS member_count, count(DISTINCT n.source_id) AS source_count FROM names a LEFT JOIN note_names nn USING (canonical) LEFT JOIN notes n ON n.chunk_id = nn.chunk_id AND NOT n.back_matter GROUP BY a.canonical, a.kind"
_SAID = "SELECT canonical, arg_min(kind, (-n, kind)) AS said FROM (SELECT canonical, kind, count(*) AS n FROM note_names WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY canonical"

SQL = {
    "joi01_name_members": f"SELECT canonical, chunk_id, source_id, author, title, year FROM ({_MEMBERS}) LEFT JOIN sources USING (source_id)",
    "joi02_doors": _DOORS,
    "joi03_concept_sources": _CONCEPT,
    "joi04_note_locators": "SELECT n.chunk_id, n.source_id, author, title, date, section, chapter FROM notes n LEFT JOIN sources s USING (source_id)",
    "joi06_find_notes": f"""WITH h AS (SELECT DISTINCT n.chunk_id, n.source_id, s.author, s.year, n.claim, n.position FROM note_names nn {_EV} LEFT JOIN sources s ON s.source_id = n.source_id
        WHERE nn.canonical = '{ABOUT}' AND n.source_id IN (SELECT source_id FROM note_arguing_against WHERE resolved_canonical = '{OTHER}') AND s.year > 1950 AND s.year < 2016),
        r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS k, count(*) OVER () AS total FROM h), t AS (SELECT *, row_number() OVER (ORDER BY k, source_id) AS turn FROM r)
        SELECT chunk_id, source_id, author, year, claim, position, turn, total FROM t WHERE turn <= greatest(20, (SELECT count(DISTINCT source_id) FROM h))""",
    "joi07_names_arguing_against": "SELECT aa.resolved_canonical AS target, nn.canonical, min(nn.kind) AS kind, count(DISTINCT nn.chunk_id) AS note_count, count(DISTINCT nn.source_id) AS source_count FROM note_arguing_against aa JOIN note_names nn ON nn.chunk_id = aa.chunk_id WHERE nn.canonical <> aa.resolved_canonical GROUP BY 1, 2",
    "joi08_opposition_pairs": f"""SELECT DISTINCT aa.resolved_canonical AS canonical, aa.chunk_id AS opposing_chunk, aa.source_id AS opposing_source, aa.target, n.chunk_id AS about_chunk, n.source_id AS about_source
        FROM note_arguing_against aa JOIN notes o ON o.chunk_id = aa.chunk_id AND NOT o.back_matter JOIN note_names nn ON nn.canonical = aa.resolved_canonical {_EV}
        WHERE aa.resolved_canonical = '{OTHER}' AND aa.source_id IS NOT NULL AND nn.source_id <> aa.source_id""",
    "joi08_opposition_sizes": """SELECT canonical, count(*) AS pairs FROM (SELECT DISTINCT aa.resolved_canonical AS canonical, aa.chunk_id, aa.source_id, aa.target, n.chunk_id AS about, nn.source_id AS s
        FROM note_arguing_against aa JOIN notes o ON o.chunk_id = aa.chunk_id AND NOT o.back_matter JOIN note_names nn ON nn.canonical = aa.resolved_canonical JOIN notes n ON n.chunk_id = nn.chunk_id AND NOT n.back_matter
        WHERE aa.source_id IS NOT NULL AND nn.source_id <> aa.source_id) GROUP BY canonical""",
    "joi10_resolve_names": f"""WITH s AS (SELECT DISTINCT cited AS surface FROM note_citations WHERE cited IS NOT NULL), f AS (SELECT {_FOLD.format('canonical')} AS fold, min(canonical) AS near FROM names GROUP BY 1), e AS (SELECT DISTINCT canonical FROM names)
        SELECT surface, coalesce(e.canonical, f.near, surface) AS canonical, CASE WHEN e.canonical IS NOT NULL THEN 'exact' WHEN f.near IS NOT NULL THEN 'fold' END AS tier FROM s LEFT JOIN e ON e.canonical = surface LEFT JOIN f ON f.fold = {_FOLD.format('surface')}""",
    "joi12_where_names_meet": f"""WITH m AS (SELECT chunk_id, min(source_id) AS source_id FROM note_names WHERE canonical = '{ABOUT}' AND chunk_id IN (SELECT chunk_id FROM note_names WHERE canonical = '{OTHER}') GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, '') ORDER BY chunk_id) AS k FROM m) SELECT chunk_id, source_id, row_number() OVER (ORDER BY k, coalesce(source_id, '')) AS turn FROM r""",
    "joi13_who_cites": f"SELECT DISTINCT k.canonical, c.chunk_id, c.source_id, c.cited, lower(c.stance) AS stance FROM note_citations c JOIN (SELECT DISTINCT canonical, {_FOLD.format('canonical')} AS fold FROM names) k ON k.fold = {_FOLD.format('c.cited')}",
    "joi14_who_argues_against": "SELECT DISTINCT a.resolved_canonical, a.chunk_id, a.source_id, a.target, n.position FROM note_arguing_against a LEFT JOIN notes n USING (chunk_id) WHERE a.resolved_canonical IS NOT NULL",
    "joi18_targets_by_phrase": f"""WITH p AS (SELECT DISTINCT canonical, {_FOLD.format('canonical')} AS f FROM names), t AS (SELECT DISTINCT target, {_FOLD.format('target')} AS f FROM note_arguing_against WHERE target IS NOT NULL)
        SELECT DISTINCT target, canonical FROM t JOIN p ON contains(p.f, ' ') AND contains(' ' || t.f || ' ', ' ' || p.f || ' ')""",
    "joi26_orphans": "SELECT DISTINCT 'chunk' AS kind, chunk_id AS id FROM note_names WHERE chunk_id NOT IN (SELECT chunk_id FROM notes) UNION SELECT 'name', canonical FROM note_names WHERE canonical NOT IN (SELECT canonical FROM names) UNION SELECT 'source', source_id FROM note_names WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)",
    "joi27_source_by_prefix": "SELECT chunk_id, arg_max(s.source_id, length(s.source_id)) AS source_id FROM (SELECT DISTINCT chunk_id FROM note_names WHERE source_id IS NULL) l JOIN sources s ON starts_with(l.chunk_id, s.source_id) GROUP BY chunk_id",
    "joi28_kind_mismatches": f"SELECT * FROM (SELECT coalesce(a.canonical, b.canonical) AS canonical, a.kind, b.said, CASE WHEN a.kind IS NULL AND b.said IS NULL THEN 'none' WHEN a.kind IS NULL THEN 'no kind' WHEN b.said IS NULL THEN 'no mention' WHEN a.kind <> b.said THEN 'differ' END AS why FROM names a FULL JOIN ({_SAID}) b ON a.canonical = b.canonical) WHERE why IS NOT NULL",
    "joi31_unlabelled_names": "SELECT a.canonical, count(b.canonical) AS mentions FROM names a LEFT JOIN note_names b USING (canonical) WHERE a.kind IS NULL GROUP BY a.canonical",
    "joi41_ids_by_hash": "WITH k AS (SELECT right(source_id, 12) AS hash, min(source_id) AS known_id FROM (SELECT DISTINCT source_id FROM sources) GROUP BY 1 HAVING count(*) = 1) SELECT d.source_id, known_id, count(*) AS documents FROM documents d JOIN k ON k.hash = right(d.source_id, 12) WHERE d.source_id IS NOT NULL GROUP BY 1, 2",
    "agg01_inventory": f"SELECT canonical, said AS kind, count(*) AS count, count(DISTINCT chunk_id) AS notes FROM note_names LEFT JOIN ({_SAID}) USING (canonical) GROUP BY 1, 2",
    "agg05_coverage": _COVER,
    "agg06_bands": f"SELECT band, count(*) AS names, sum(note_count)::BIGINT AS notes FROM ({_COVER}) GROUP BY band",
    "agg11_confidence": f"""WITH c AS (SELECT canonical, CASE band WHEN 'thin' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS rank FROM ({_COVER})), w AS (SELECT source_id, rank, sum(w) AS w FROM (SELECT source_id, canonical, count(DISTINCT chunk_id) AS w FROM note_names WHERE source_id IS NOT NULL GROUP BY ALL) JOIN c USING (canonical) GROUP BY ALL),
        r AS (SELECT *, sum(w) OVER (PARTITION BY source_id ORDER BY rank) AS run, sum(w) OVER (PARTITION BY source_id) AS a, min(rank) OVER (PARTITION BY source_id) AS least FROM w), m AS (SELECT source_id, min(rank) AS m, min(least) AS least FROM r WHERE 2 * run >= a GROUP BY source_id)
        SELECT source_id, CASE CASE WHEN least = 0 THEN least(m, 1) ELSE m END WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM m""",
    "agg25_concentration": f"SELECT canonical, round(max(share), 9) AS top_share, round(sum(share * share), 9) AS hhi FROM (SELECT canonical, note_count / sum(note_count) OVER (PARTITION BY canonical) AS share FROM ({_CONCEPT})) GROUP BY canonical",
    "agg34_source_usage": """WITH h AS (SELECT source_id, count(*) AS available FROM notes WHERE NOT back_matter GROUP BY 1), u AS (SELECT source_id, count(DISTINCT chunk_id) AS evidence FROM note_citations WHERE source_id IS NOT NULL GROUP BY 1),
        b AS (SELECT source_id, coalesce(available, 0) AS available, coalesce(evidence, 0) AS evidence FROM h FULL JOIN u USING (source_id))
        SELECT *, round(CASE WHEN available > 0 THEN evidence * (SELECT sum(available) FROM b) / ((SELECT sum(evidence) FROM b) * available)::DOUBLE END, 9) AS usage FROM b""",
    "agg62_section_index": f"SELECT section, count(DISTINCT position) AS positions, count(*) AS notes FROM notes WHERE section IS NOT NULL AND position IS NOT NULL AND lower(trim(position)) <> '{ABSTENTION}' GROUP BY section",
    "agg74_question_measure": f"SELECT canonical, sum(note_count)::BIGINT AS notes, count(source_id) AS sources, round(max(note_count) / sum(note_count), 9) AS top_share FROM ({_CONCEPT}) GROUP BY canonical HAVING sum(note_count) >= 20",
    "agg80_kind_counts": "SELECT kind, count(*) AS mentions, count(DISTINCT canonical) AS names FROM note_names GROUP BY kind",
    "win01_rotation": """WITH m AS (SELECT canonical, chunk_id, max(source_id) AS source_id FROM note_names GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY canonical, coalesce(source_id, '') ORDER BY chunk_id) AS k FROM m),
        t AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY k, coalesce(source_id, '')) AS turn FROM r), c AS (SELECT canonical, count(DISTINCT coalesce(source_id, '')) AS n FROM m GROUP BY 1)
        SELECT canonical, chunk_id, source_id, turn FROM t JOIN c USING (canonical) WHERE turn <= greatest(10, n)""",
    "win09_rank_doors": f"SELECT canonical, source_count, member_count, place FROM (SELECT *, row_number() OVER (PARTITION BY left(canonical, 1) ORDER BY coalesce(kind = 'work', false), source_count DESC, member_count DESC, canonical) AS place FROM ({_DOORS})) WHERE place <= 10",
    "win13_neighbours": f"""WITH h AS (SELECT DISTINCT chunk_id, canonical FROM note_names WHERE chunk_id IS NOT NULL AND canonical IS NOT NULL), d AS (SELECT canonical, count(*) AS df FROM h GROUP BY 1)
        SELECT canonical, count(*) AS both, any_value(df) AS df, round(count(*) * ln((SELECT count(DISTINCT chunk_id) FROM h) / greatest(any_value(df), 1)), 6) AS score FROM h JOIN d USING (canonical) WHERE canonical <> '{ABOUT}' AND chunk_id IN (SELECT chunk_id FROM h WHERE canonical = '{ABOUT}') GROUP BY canonical""",
    "win20_latest_target": "SELECT chunk_id, coalesce(max(target) FILTER (resolved_canonical IS NOT NULL), max(target)) AS target FROM note_arguing_against GROUP BY chunk_id",
    "win21_position_ids": f"SELECT printf('pos-%07d', row_number() OVER (ORDER BY size DESC, position)) AS position_id, position, size FROM (SELECT position, count(*) AS size FROM notes WHERE position IS NOT NULL AND lower(trim(position)) <> '{ABSTENTION}' GROUP BY position)",
    "set01_first_mentions": "SELECT canonical, min(chunk_id) AS first_chunk FROM note_names WHERE canonical IS NOT NULL GROUP BY canonical",
    "set02_reached_names": "SELECT canonical, CASE WHEN NOT m THEN 'opposition' WHEN NOT o THEN 'mention' ELSE 'both' END AS reached FROM (SELECT canonical, bool_or(m) AS m, bool_or(NOT m) AS o FROM (SELECT canonical, true AS m FROM note_names UNION ALL SELECT resolved_canonical, false FROM note_arguing_against WHERE resolved_canonical IS NOT NULL) GROUP BY canonical)",
    "set06_cited_sources": "SELECT source_id, title FROM sources WHERE source_id IN (SELECT source_id FROM note_citations)",
    "set07_fold_groups": f"SELECT fold, count(*) AS spellings, string_agg(canonical, '|' ORDER BY canonical) AS members FROM (SELECT canonical, {_FOLD.format('canonical')} AS fold FROM (SELECT canonical FROM names UNION SELECT canonical FROM note_names) WHERE canonical IS NOT NULL) WHERE fold <> '' GROUP BY fold HAVING count(*) > 1",
    "top09_elected_spelling": f"SELECT fold, arg_min(canonical, (-n, canonical)) AS elected, sum(n)::BIGINT AS mentions FROM (SELECT canonical, {_FOLD.format('canonical')} AS fold, count(*) AS n FROM note_names WHERE canonical IS NOT NULL GROUP BY 1) GROUP BY fold",
    "top10_elected_kind": f"SELECT fold, arg_min(kind, (-n, kind)) AS kind FROM (SELECT {_FOLD.format('canonical')} AS fold, kind, count(*) AS n FROM note_names WHERE canonical IS NOT NULL AND kind IS NOT NULL GROUP BY 1, 2) GROUP BY fold",
    "vec20_initial_forenames": r"""WITH n AS (SELECT DISTINCT canonical FROM names WHERE kind = 'person'), s AS (SELECT canonical AS short, regexp_extract(canonical, '^([A-Z])\.? ([A-Z][a-z]+)$', 1) AS i, regexp_extract(canonical, '^([A-Z])\.? ([A-Z][a-z]+)$', 2) AS s FROM n),
        f AS (SELECT canonical AS full_name, regexp_extract(canonical, '^([A-Z])[a-z]+ ([A-Z][a-z]+)$', 1) AS i, regexp_extract(canonical, '^([A-Z])[a-z]+ ([A-Z][a-z]+)$', 2) AS s FROM n)
        SELECT short, min(full_name) AS "full" FROM s JOIN f USING (i, s) WHERE s.s <> '' GROUP BY short HAVING count(*) = 1""",
    "vec22_acronyms": r"SELECT *, count(*) OVER (PARTITION BY acronym) AS carriers FROM (SELECT DISTINCT canonical, regexp_extract(canonical, '^(.+) \(([A-Z]{2,6})\)$', 2) AS acronym, regexp_extract(canonical, '^(.+) \(([A-Z]{2,6})\)$', 1) AS body FROM names) WHERE acronym <> ''",
    "src23_last_decision": "SELECT source_id, pass_name, status, arrived_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, pass_name ORDER BY arrived_at DESC, logged_at DESC, status DESC, tokens DESC NULLS LAST) AS r FROM (SELECT DISTINCT * FROM run_log)) WHERE r = 1",
    "vec16_components": """WITH RECURSIVE e AS (SELECT DISTINCT a.resolved_canonical AS a, nn.canonical AS b FROM note_arguing_against a JOIN note_names nn ON nn.chunk_id = a.chunk_id AND nn.kind = 'person' WHERE a.resolved_canonical IS NOT NULL AND nn.canonical <> a.resolved_canonical),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a AS id, a AS root FROM u UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.id WHERE c.root < u.b) SELECT id, min(root) AS root FROM c GROUP BY id""",
}
